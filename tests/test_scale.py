"""Hot keys and parents, many patterns, buckets, one pass, and streams that don't read their target."""

import random
from dataclasses import replace
from itertools import pairwise
from statistics import median

import pytest
from pyspark.sql import functions as F

from keelvault import Binding, StageSpec, VaultConfig, hub, link, satellite, satellite_end_dated, stage
from keelvault.functions.hashing import packed, unpacked
from keelvault.operators import hwm
from keelvault.operators.anti_join import not_in
from keelvault.operators.hwm import TargetFacts, sql_like
from keelvault.operators.patterns import beginning, fitting
from keelvault.operators.seams import SLICES, hot_splitters, place_of, slice_of
from keelvault.plans import catalogue
from keelvault.plans.one_pass import _Entity, load_vault_once, tagged_rows
from keelvault.plans.pipeline import load_vault
from keelvault.sources.bucketed import append_bucketed, create_bucketed, near_keys
from keelvault.sources.committed import CommittedTable
from keelvault.sources.tables import spread
from keelvault.streaming.first_rows import earliest, first_rows, load_first_rows
from metrics import executed, metric, shuffled_records


def same(df, other):
    return sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, map(tuple, other)))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- hot keys of hubs and links --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("load", [hub, link])
def test_a_task_sends_one_row_of_a_key(spark, load, no_broadcast):
    """Half of all rows have one key; so much the fewer are shuffled, for the join as well as for the ranking."""
    source = spark.range(20_000).selectExpr("if(id % 2 = 0, repeat('0', 32), cast(id as string)) hk", "cast(id as string) id", "cast(id as string) ldts", "'x' rsrc")
    source = source.repartition(8)
    target = spark.range(500).selectExpr("cast(id as string) hk", "cast(id as string) id", "'' ldts", "'x' rsrc")
    delta = load([Binding(source)], "hk", ["id"], target=target, incremental=True, disable_hwm=True)
    plan = delta._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(hk") == 1 and plan.index("Exchange hashpartitioning(hk") < plan.index("row_number(), 1, Partial")
    records = shuffled_records(delta)
    assert 10_001 <= records[0] <= 10_000 + 8
    tasks = [r["n"] for r in delta.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(tasks) <= 3 * median(tasks)


def test_keys_of_a_first_load_travel_as_bytes(spark, no_broadcast):
    """A link's three keys of 32 characters are 17 bytes each in its only shuffle; any text comes back as it was."""
    odd = ["0" * 32, "f" * 32, "F" * 32, "abc", "ab", "", None, "zz", "é" * 16, "\x00", "\x0161", "0" * 40]
    keys = spark.createDataFrame([(k,) for k in odd], "k string")
    assert [r[0] for r in keys.select(unpacked(packed(F.col("k")))).collect()] == odd
    source = spark.range(20_000).selectExpr("md5(cast(id as string)) hk", "md5(concat('a', id)) a", "md5(concat('b', id)) b", "'2031' ldts", "'x' rsrc")
    first = link([Binding(source)], "hk", ["a", "b"])
    assert first.columns == ["hk", "a", "b", "ldts", "rsrc"]
    size = sum(metric(n, "shuffleBytesWritten") for n in executed(first) if n.nodeName() == "Exchange")
    assert size < 80 * 20_000  # over 96 as text
    assert same(first, source.collect())


def test_a_first_link_load_is_ranked_before_it_is_hashed(spark, tmp_path, no_broadcast):
    """Of a line, four numbers are shuffled once, not two links of three keys each; an order's links lie together."""
    lines = spark.range(20_000).selectExpr("id div 4 l_orderkey", "id * 7 % 500 l_partkey", "id % 30 l_suppkey", "timestamp_ntz'2031-01-01' + make_interval(0, 0, 0, id % 9) l_shipdate")
    lines.repartition(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = catalogue.QUERIES["link_multi_source"](spark, str(tmp_path))
    plan = executed(df)
    exchanges = [n for n in plan if n.nodeName() == "Exchange"]
    assert [metric(n, "shuffleRecordsWritten") for n in exchanges] == [20_000]
    assert metric(exchanges[0], "shuffleBytesWritten") < 40 * 20_000  # over 160 as keys
    links = [r["hk_order"] for r in df.collect()]
    assert sum(a != b for a, b in pairwise(links)) == 20_000 // 4 - 1


@pytest.mark.parametrize("seed", range(2))
def test_ranked_by_numbers_as_by_hashes(spark, seed):
    """A link over stages that aren't computed yet is that over the staged rows, whether it is ranked by numbers or not."""
    rng = random.Random(seed)
    some = lambda: rng.choice([None, 0, 1, -1, 10, 11, 2**15 - 1])
    raw = spark.createDataFrame([(some(), some(), some(), f"{some()}", rng.choice(["2031-01-01", "2031-01-02", None]), rng.choice("xyz"), rng.choice("pq")) for _ in range(300)], "`a` long, `b.c` int, `d` short, e string, ldts string, rsrc string, more string")
    other = raw.selectExpr("d a", "a `b.c`", "`b.c` d", "e", "ldts", "'o' rsrc", "more")
    keys = {"hk_a": ["a"], "hk_b": ["b.c"], "hk_d": ["d"], "hk_e": ["e"], "hk_ab": ["a", "b.c"], "hk_ad": ["a", "d"], "hk_ba": ["b.c", "a"], "hk_ae": ["a", "e"]}
    spec, late = StageSpec(raw, hashed_columns=keys, derived_columns={"second": "upper(rsrc)"}), StageSpec(other, hashed_columns=keys)
    ghosts = StageSpec(raw, hashed_columns=keys, ghost_record_types={"a": "BIGINT", "b.c": "INT", "d": "SMALLINT", "e": "VARCHAR", "ldts": "VARCHAR", "rsrc": "VARCHAR", "more": "VARCHAR"})
    bound = lambda s, hk, *fks, **o: Binding(s, hash_key_col=hk, fk_columns=list(fks), **o)
    by_numbers = [
        [bound(spec, "hk_ab", "hk_a", "hk_b")],
        [bound(spec, "hk_ab", "hk_a", "hk_b"), bound(spec, "hk_ad", "hk_a", "hk_d", record_source_col="second")],
        [bound(late, "hk_ad", "hk_a", "hk_d"), bound(spec, "hk_ab", "hk_a", "hk_b"), bound(late, "hk_ab", "hk_a", "hk_b")],
        [bound(spec, "hk_ab", "hk_ab", "hk_b")],
    ]
    by_hashes = [
        [bound(spec, "hk_ae", "hk_a", "hk_e")],
        [bound(spec, "hk_ab", "hk_a", "hk_d")],
        [bound(spec, "hk_ab", "hk_a", "hk_b"), bound(spec, "hk_ba", "hk_a", "hk_b")],
        [bound(spec, "hk_ab", "hk_a", "hk_b"), Binding(stage(late), hash_key_col="hk_ab", fk_columns=["hk_a", "hk_b"])],
        [bound(spec, "hk_ab", "hk_a", "hk_b", record_source_col="hk_e")],
        [bound(ghosts, "hk_ab", "hk_a", "hk_b")],
    ]
    cfg = VaultConfig(hash="SHA256", use_trim=False, empty_as_null=True) if seed else VaultConfig()
    for n, sources in enumerate(by_numbers + by_hashes):
        staged = {id(b.source): stage(b.source, cfg=cfg) for b in sources if isinstance(b.source, StageSpec)}
        plain = [replace(b, source=staged.get(id(b.source), b.source)) for b in sources]
        found, want = (link(s, "hk", ["x", "y"], additional_columns=["more", "e"] if (n + seed) % 2 else [], cfg=cfg) for s in (sources, plain))
        assert found.dtypes == want.dtypes
        assert ("_number0" in found._jdf.queryExecution().optimizedPlan().toString()) == (n < len(by_numbers))
        assert same(found, want.collect())
    target = link([bound(spec, "hk_ab", "hk_a", "hk_b")], "hk", ["x", "y"]).limit(5)
    delta = [link([bound(s, "hk_ab", "hk_a", "hk_b")], "hk", ["x", "y"], target=target, incremental=True, disable_hwm=True).count() for s in (spec, stage(spec))]
    assert delta[0] == delta[1] > 0


def test_a_large_table_is_dealt_into_small_pieces(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(df, "id").rdd.getNumPartitions() == max(cores, 1)
    assert spread(df, "id", piece_bytes=1 << 40).rdd.getNumPartitions() == max(cores, 1)
    assert spread(df, "id", piece_bytes=4000).count() == 20_000 and spread(df, "id", piece_bytes=4000)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_the_latest_state_of_a_hot_parent_is_one_row_a_task(spark, no_broadcast):
    target = spark.range(20_000).selectExpr("if(id % 2 = 0, 'hot', cast(id as string)) hk", "cast(id as string) hd", "cast(id as string) ldts", "'x' rsrc").repartition(8)
    source = spark.range(10).selectExpr("if(id % 2 = 0, 'hot', cast(id as string)) hk", "cast(id as string) hd", "concat('9', id) ldts", "'x' rsrc")
    delta = satellite(Binding(source), "hk", "hd", target=target, incremental=True, disable_hwm=True)
    assert 10_001 <= sorted(shuffled_records(delta))[-2] <= 10_008  # the most is the dealing out of this test


# --- hot parents of satellites ---------------------------------------------------------------------------------------------

SAT = "hk string, hd string, status string, ldts string, rsrc string"


def states(rng, size):
    """Mostly of one parent, with ties of the load date, NULLs, and rows that repeat."""
    return [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice(["p", "q", None]), "s", rng.choice([f"2031-07-{rng.randint(1, 28):02}"] * 9 + [None]), "r") for _ in range(size)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot_rows", [1, 7])
def test_hot_parents(spark, seed, hot_rows):
    rng = random.Random(seed)
    rows = [spark.createDataFrame(states(rng, n), SAT).repartition(3) for n in (rng.randint(0, 60), 20)]
    for options in ({}, {"target": rows[1], "incremental": True, "disable_hwm": seed % 2 == 0}):
        found = [satellite(Binding(rows[0]), "hk", "hd", payload=["status"], hot_rows=n, **options).collect() for n in (None, hot_rows)]
        assert sorted(map(str, found[0])) == sorted(map(str, found[1]))
    dated = [satellite_end_dated(rows[0], "hk", hot_rows=n).collect() for n in (None, hot_rows)]
    assert sorted(map(str, dated[0])) == sorted(map(str, dated[1]))


def test_slices_of_a_hot_parent_are_even(spark):
    rows = spark.range(30_000).selectExpr("if(id % 2 = 0, 'hot', cast(id as string)) hk", "cast(id * 7919 % 30000 as string) ldts", "cast(id % 3 as string) hd")
    cuts = hot_splitters(rows, "hk", place_of(rows, ["ldts", "hd"]), 1000).collect()
    assert [r["key"] for r in cuts] == ["hot"] and 10 <= len(cuts[0]["splitters"]) < 16
    places = sorted((r["ldts"], r["hd"]) for r in rows.filter("hk = 'hot'").collect())
    bounds = [(s["v0"], s["v1"]) for s in cuts[0]["splitters"]]
    sizes = [sum(1 for p in places if a <= p and (b is None or p < b)) for a, b in zip([("", ""), *bounds], [*bounds, None], strict=True)]
    assert sum(sizes) == 15_000 and max(sizes) <= 3 * median(sizes) and max(sizes) < 2000


def test_no_task_sorts_a_hot_parent(spark):
    """Half of all rows have one parent; slices spread them over the tasks of the window."""
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 'hot', cast(id as string)) hk", "cast(id % 5 as string) hd", "lpad(cast(id as string), 9, '0') ldts", "'x' rsrc").repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        delta = satellite(Binding(rows), "hk", "hd", hot_rows=500)
        tasks = [r["n"] for r in delta.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(tasks) == satellite(Binding(rows), "hk", "hd").count() and max(tasks) <= 3 * median(tasks)


@pytest.mark.parametrize("n", [0, 1, 2, 7, SLICES - 1])
def test_a_slice_is_found_by_bisection(spark, n):
    cuts = list(range(0, 2 * n, 2))
    found = spark.range(-1, 2 * n + 1).select("id", slice_of(F.array(*map(F.lit, cuts)).cast("array<long>"), F.col("id")).alias("at")).collect()
    assert all(r["at"] == sum(c <= r["id"] for c in cuts) for r in found)


def test_both_steps_of_a_hot_parent_are_sliced(spark, monkeypatch):
    """No window of the query is by the parent alone, neither the comparison's nor the end dates'."""
    sliced = []
    for name in ("satellite", "satellite_end_dated"):
        made = getattr(catalogue, name)
        monkeypatch.setattr(catalogue, name, lambda *a, made=made, **b: sliced.append(b.get("hot_rows")) or made(*a, **b))
    catalogue.sat_v1_hot_parent(spark, "/root/testdata/sf0.001").count()
    assert sliced == [2000, 2000]


# --- patterns --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_patterns_by_join_equal_patterns_by_expression(spark, monkeypatch, seed):
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    rows = [(f"k{i}", "1", f"2031-07-{rng.randint(1, 9)}", rng.choice([some("ab/\\", 4), None, "9%"])) for i in range(60)]
    target = [(f"t{i}", "1", rng.choice([f"2031-07-{rng.randint(1, 9)}", "9999-12-31"]), some("ab/\\", 4)) for i in range(20)]
    patterns = [some("ab/\\%_", 4) for _ in range(12)] + ["%", "a%", "a_", "\\%"][: rng.randint(0, 4)]
    source, known = (spark.createDataFrame(r, "hk string, id string, ldts string, rsrc string") for r in (rows, target))
    bindings = [Binding(source, rsrc_statics=patterns[:6]), Binding(source.withColumn("hk", F.concat("hk", F.lit("x"))), rsrc_statics=patterns[6:])]
    found = []
    for many in (1000, 0):
        monkeypatch.setattr(hwm, "MANY", many)
        found.append(hub(bindings, "hk", ["id"], target=known, incremental=True).collect())
    assert sorted(map(str, found[0])) == sorted(map(str, found[1]))


def test_fitting(spark):
    texts, patterns = ["", "a", "ab", "a%", "a_b", "\\x", "b/c", "%"], ["", "a", "a%", "%", "_", "a_", "%b", "\\_", "b/%", "__%"]
    got = {(r["text"], r["pattern"]) for r in fitting(spark.createDataFrame([(t,) for t in texts], "rsrc string"), "rsrc", patterns * 2).collect()}
    assert got == {(t, p) for t in texts for p in patterns if sql_like(t, p)}
    assert [beginning(p) for p in ("a%b_", "_a", "abc", "")] == ["a", "", "abc", ""]


def test_two_thousand_patterns(spark):
    rows = spark.range(4000).selectExpr("cast(id as string) hk", "'1' id", "'2031-07-02' ldts", "concat('S', id % 2500, '/x') rsrc")
    target = spark.range(1000).selectExpr("concat('t', id) hk", "'1' id", "'2031-07-03' ldts", "concat('S', id, '/y') rsrc")
    delta = hub([Binding(rows, rsrc_statics=[f"S{i}/%" for i in range(2000)])], "hk", ["id"], target=target, incremental=True)
    assert delta._jdf.queryExecution().optimizedPlan().toString().count("LIKE") <= 10
    want = [i for i in range(4000) if 1000 <= i % 2500 < 2000]
    assert sorted(int(r["hk"]) for r in delta.collect()) == want
    assert TargetFacts(target, VaultConfig(), patterns=[f"S{i}/%" for i in range(2000)], key="hk").row is not None


# --- buckets ---------------------------------------------------------------------------------------------------------------


def test_a_bucketed_target_does_not_move(spark, tmp_path, no_broadcast):
    known = spark.range(3000).selectExpr("md5(cast(id as string)) hk", "cast(id as string) id", "'2031-07-01' ldts", "'x' rsrc")
    spark.sql("DROP TABLE IF EXISTS hub_in_buckets")
    create_bucketed(spark, "hub_in_buckets", known.schema, "hk", 4, str(tmp_path / "hub"))
    try:
        append_bucketed(known.filter("id % 2 = 0"), "hub_in_buckets", "hk", 4)
        delta = hub([Binding(known)], "hk", ["id"], target=spark.table("hub_in_buckets"), incremental=True, disable_hwm=True)
        plan = delta._jdf.queryExecution().executedPlan().toString()
        target = plan[plan.index("LeftAnti") :].rsplit("FileScan", 1)[0].rsplit("\n", 8)
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and target
        append_bucketed(delta.select("rsrc", "ldts", "id", "hk"), "hub_in_buckets", "hk", 4)
        assert same(spark.table("hub_in_buckets").select("hk", "id"), known.select("hk", "id").collect())
        assert len(list((tmp_path / "hub").glob("part-*"))) <= 8  # a file a bucket and load
    finally:
        spark.sql("DROP TABLE hub_in_buckets")


def test_near_keys(spark):
    target = spark.range(20_000).selectExpr("md5(cast(id as string)) hk", "id").unionByName(spark.range(1).selectExpr("cast(null as string) hk", "-1L id"))
    delta = spark.range(100).selectExpr("md5(cast(id * 500 as string)) hk", "1 as _bits").unionByName(spark.range(3).selectExpr("concat('new', id) hk", "1 as _bits"))
    near = near_keys(target, delta, "hk")
    assert near.columns == target.columns and {r["hk"] for r in target.join(delta, "hk").collect()} <= {r["hk"] for r in near.collect()}
    assert 41 <= near.count() < 100 and near.filter("hk IS NULL").count() == 1
    new = delta.select("hk")
    assert same(not_in(new, near.filter("hk IS NOT NULL").select("hk"), "hk"), not_in(new, target.filter("hk IS NOT NULL").select("hk"), "hk").collect())


# --- streams ---------------------------------------------------------------------------------------------------------------


def test_first_rows_of_a_stream(spark, tmp_path, monkeypatch):
    """Late rows correct what went out; what hasn't changed isn't sent again; the table isn't read."""
    schema, cfg = "hk string, id string, ldts string, rsrc string", VaultConfig()
    given = [
        [("a", "1", "2031-07-05", "x"), ("b", "1", "2031-07-05", "x"), ("b", "0", "2031-07-05", "y"), (None, "n", "2031-07-05", "x"), ("z", "1", None, "x")],
        [("a", "1", "2031-07-06", "x"), ("a", "2", "2031-07-04", "x"), ("c", "1", "2031-07-01", "x"), (None, "n", "2031-07-09", "x")],
        [("a", "3", "2031-07-09", "x"), ("z", "1", "2031-07-01", "x"), ("b", "0", "2031-07-05", "x")],
    ]
    table = CommittedTable(str(tmp_path / "hub"), key="hk")
    with monkeypatch.context() as m:
        m.setattr(CommittedTable, "rows", lambda *a: (_ for _ in ()).throw(AssertionError("the target was read")))
        for i, rows in enumerate(given):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
            load_first_rows(stream, table, "hk", ["id"], str(tmp_path / "cp"), available_now=True).awaitTermination()
    every = spark.createDataFrame([r for rows in given for r in rows], schema)
    assert same(first_rows(table, spark, ["id"]), hub([Binding(every)], "hk", ["id"]).collect())
    assert same(first_rows(table, spark, ["id"]), earliest(every, "hk", ["id"], cfg).collect())
    sent = sorted(map(str, map(tuple, table.rows(spark).collect())))
    assert len(sent) == 4 + 2 + 2  # four keys; a's earlier row and c; z's load date and b's lower source


# --- one pass --------------------------------------------------------------------------------------------------------------


def test_one_pass(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(1, 9), rng.randint(1, 5), rng.choice("pq"), f"2031-07-{i % 27 + 1:02}", rng.choice("xy")) for i in range(60)]
    rows = list({(r[0], r[3]): r for r in rows}.values())  # one state of a parent a day
    raw = str(tmp_path / "raw")
    spark.createDataFrame(rows, "o int, c int, status string, ldts string, rsrc string").write.parquet(raw)
    spec = StageSpec(raw, hashed_columns={"hk": ["o"], "hc": ["c"], "hl": ["o", "c"], "hd": {"columns": ["status"], "is_hashdiff": True}})
    names = {"hash_key": "hk", "business_keys": ["o"], "link_key": "hl", "foreign_keys": ["hk", "hc"], "hash_diff": "hd", "payload": ["status"]}
    once, each = load_vault_once(spec, str(tmp_path / "vault"), **names), load_vault(spec, **names)
    for part in ("hub", "link", "satellite", "end_dated"):
        a, b = getattr(once, part), getattr(each, part)
        assert a.columns == b.columns and same(a, b.collect())
    entities = [_Entity("hub", "hk", ("hk", "o", "ldts", "rsrc")), _Entity("link", "hl", ("hl", "hk", "hc", "ldts", "rsrc")), _Entity("satellite", "hk", ("hk", "hd", "status", "ldts", "rsrc"))]
    found = executed(tagged_rows(each.staged, entities, "hd", VaultConfig()))
    assert sum(n.nodeName().startswith("Scan") for n in found) == 1 and sum(n.nodeName() == "Exchange" for n in found) == 1
    assert [metric(n, "shuffleRecordsWritten") for n in found if n.nodeName() == "Exchange"] == [3 * len(rows)]
