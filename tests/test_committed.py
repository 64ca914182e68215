"""Committed tables: batches that die, repeat or race; what is kept beside the rows; end-dated tables."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from keelvault import Binding, hub, satellite, satellite_end_dated
from keelvault.operators.hwm import TargetFacts
from keelvault.sources import files
from keelvault.sources.committed import CommittedTable
from keelvault.sources.end_dated import EndDatedTable
from keelvault.specs import Kept
from keelvault.streaming.batches import load_stream
from metrics import executed, metric, shuffled_records

SCHEMA = "hk string, hd string, ldts string, rsrc string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def same(df, rows):
    return sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, map(tuple, rows)))


def test_a_batch_counts_once(spark, tmp_path):
    table = CommittedTable(str(tmp_path / "t"))
    assert table.rows(spark) is None and table.target(spark) is None
    one, two = [("a", "1", "2024-01-01", "X")], [("b", "2", "2024-01-02", "X")]
    assert table.commit(frame(spark, one), 0) and not table.commit(frame(spark, two), 0)
    assert table.commit(frame(spark, two), "other") and same(table.rows(spark), one + two)
    assert table.commit(frame(spark, []), 7) and same(table.rows(spark), one + two) and sorted(table.batches(spark)) == ["0", "7", "other"]
    made = []
    assert not table.load(spark, 0, lambda known: made.append(known)) and not made


def test_an_attempt_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    table, rows = CommittedTable(str(tmp_path / "t"), key="hk", hash_diff="hd"), [("a", "1", "2024-01-01", "X")]
    with monkeypatch.context() as m:
        m.setattr(files, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            table.commit(frame(spark, rows), 0)
    assert list((tmp_path / "t" / "batch=0").iterdir()) and table.rows(spark) is None and table.marks(spark) is None
    assert table.commit(frame(spark, rows), 0) and same(table.rows(spark), rows)
    assert len(list((tmp_path / "t" / "batch=0").glob("attempt=*"))) == 1  # what died is removed


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    table, publish = CommittedTable(str(tmp_path / "t")), files.publish
    with monkeypatch.context() as m:
        def raced(session, path, text):
            m.setattr(files, "publish", publish)
            assert table.commit(frame(spark, [("other", "1", "2024-01-01", "X")]), 0)
            return publish(session, path, text)

        m.setattr(files, "publish", raced)
        assert not table.commit(frame(spark, [("mine", "1", "2024-01-01", "X")]), 0)
    assert [r["hk"] for r in table.rows(spark).collect()] == ["other"]


def test_a_delta_of_other_columns_is_an_error(spark, tmp_path):
    table = CommittedTable(str(tmp_path / "t"))
    table.commit(frame(spark, [("a", "1", "2024-01-01", "X")]), 0)
    with pytest.raises(ValueError, match="delta"):
        table.commit(frame(spark, []).drop("hd"), 1)
    assert table.commit(frame(spark, [("b", "1", "2024-01-01", "X")]).select("rsrc", "ldts", "hd", "hk"), 2)
    assert same(table.rows(spark), [("a", "1", "2024-01-01", "X"), ("b", "1", "2024-01-01", "X")])


@pytest.mark.parametrize("seed", range(3))
def test_loads_with_near_keys(spark, tmp_path, seed):
    """Facts are of all rows, though only those near the load are joined: NULL keys and marks count as ever."""
    hubs = [CommittedTable(str(tmp_path / f"hub{n}"), key="hk") for n in (0, 1)]
    sats = [CommittedTable(str(tmp_path / f"sat{n}"), key="hk", hash_diff="hd") for n in (0, 1)]
    for number, rows in enumerate(batches(seed + 50, 4)):
        rows = frame(spark, rows + ([(None, "n", "2031-07-29", "s")] if number == seed + 1 else []))
        for close, (keyed, sat) in enumerate(zip(hubs, sats, strict=True)):
            near = rows if close else None
            keyed.load(spark, number, lambda known, rows=rows: hub([Binding(rows)], "hk", ["hd"], target=known, incremental=known is not None, disable_hwm=True), near)
            sat.load(spark, number, lambda known, rows=rows: satellite(Binding(rows), "hk", "hd", target=known, incremental=known is not None), near)
    for tables in (hubs, sats):
        assert same(tables[0].rows(spark), tables[1].rows(spark).collect())


def test_near_keys_shuffle_little_of_the_target(spark, tmp_path):
    table = CommittedTable(str(tmp_path / "t"), key="hk", hash_diff="hd")
    table.commit(spark.range(50_000).selectExpr("md5(cast(id as string)) hk", "'1' hd", "'2024-01-01' ldts", "'X' rsrc"), 0)
    few = spark.range(20).selectExpr("md5(cast(id * 2 as string)) hk", "cast(id % 2 as string) hd", "'2024-01-02' ldts", "'X' rsrc")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for delta, n in ((hub([Binding(few)], "hk", ["hd"], target=table.target(spark, few), incremental=True), 0), (satellite(Binding(few), "hk", "hd", target=table.target(spark, few), incremental=True), 10)):
            assert delta.count() == n and max(r or 0 for r in shuffled_records(delta)) < 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_publish_never_overwrites(spark, tmp_path):
    path = str(tmp_path / "deep" / "entry.json")
    assert files.publish(spark, path, "é1") and not files.publish(spark, path, "2")
    assert files.read_text(spark, path) == "é1" and [n for n in files.names(spark, str(tmp_path / "deep")) if not n.startswith(".")] == ["entry.json"]


def test_stream_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    """A satellite of several batches without marks has no other protection from a repeated batch."""
    source, target = str(tmp_path / "in"), str(tmp_path / "sat")
    rows = [("a", "1", "2024-01-01", "X"), ("a", "2", "2024-01-02", "X"), ("a", "1", "2024-01-03", "X")]
    frame(spark, rows).write.parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        delta = lambda batch, known: satellite(Binding(batch), "hk", "hd", target=known, incremental=known is not None, disable_hwm=True)
        load_stream(stream, target, delta, str(tmp_path / "cp"), available_now=True).awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(files, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(StreamingQueryException):
            run()
    run()
    table = CommittedTable(target)
    assert same(table.rows(spark), rows)
    frame(spark, [("a", "3", "2024-01-04", "X")]).write.mode("append").parquet(source)
    run()
    assert table.rows(spark).count() == 4 and len(table.batches(spark)) == 2


@pytest.fixture
def whole_paths(spark):
    """Plans name their files in full."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def batches(seed, many):
    rng = random.Random(seed)
    return [[(rng.choice("abcd"), rng.choice(["p", "q", None]), f"2031-07-{day:02}", rng.choice(["n/1", "n/2", "s", None])) for day in range(3 * i + 1, 3 * i + 4) for _ in range(rng.randint(0, 3))] + ([("f", None, "9999-12-31", "ERROR")] if i == 1 else []) for i in range(many)]


@pytest.mark.parametrize("fold_after", [64, 2])
def test_kept_facts(spark, tmp_path, fold_after):
    """Marks and states follow the rows, folded or not, and after they are made anew."""
    table = CommittedTable(str(tmp_path / "t"), key="hk", hash_diff="hd", fold_after=fold_after)
    for number, rows in enumerate(batches(fold_after, 5)):
        table.commit(frame(spark, rows), number)
    rows = table.rows(spark)
    for again in (False, True):
        if again:
            table.rebuild(spark)
        assert sorted(table.batches(spark)) == list("01234") and table.rows(spark).count() == rows.count()
        assert same(table.marks(spark), table.marks_of(rows).collect())
        assert same(table.states(spark), table.states_of(rows).collect())
    kept, plain = (TargetFacts(t, table.cfg, whole=True, patterns=["n/%", "s", "none"], key="hk") for t in (table.target(spark), rows))
    found = [spark.range(1).select(f.row.alias("f")).first()["f"].asDict() for f in (kept, plain)]
    assert found[0] == found[1]


def test_folded_entries_go_and_stay_committed(spark, tmp_path):
    table = CommittedTable(str(tmp_path / "t"), key="hk", fold_after=2)
    for number in range(7):
        assert table.commit(frame(spark, [(f"k{number}", "1", "2024-01-01", "X")]), number)
    entries = [n for n in files.names(spark, str(tmp_path / "t" / "_commits")) if n.startswith("batch-")]
    assert entries == ["batch-4.json", "batch-5.json", "batch-6.json"]  # the base before the last covers the others
    assert not any(table.commit(frame(spark, [("again", "1", "2024-01-01", "X")]), n) for n in range(7))
    assert sorted(r["hk"] for r in table.rows(spark).collect()) == [f"k{n}" for n in range(7)]
    table.rebuild(spark)
    assert table.marks(spark).first()["n"] == 7 and table.rows(spark).count() == 7


@pytest.mark.parametrize("seed", range(4))
def test_loads_with_kept_facts_equal_loads_without(spark, tmp_path, seed):
    marked = seed % 2 == 0
    tables = [CommittedTable(str(tmp_path / n), key="hk", hash_diff="hd", fold_after=2) for n in ("kept", "plain")]
    for number, rows in enumerate(batches(seed + 10, 4)):
        for table in tables:
            def delta(known, table=table, rows=rows):
                known = known if table is tables[0] or known is None else known.rows
                return satellite(Binding(frame(spark, rows)), "hk", "hd", target=known, incremental=known is not None, disable_hwm=not marked)

            table.load(spark, number, delta)
    assert same(tables[0].rows(spark), tables[1].rows(spark).collect())


def test_an_incremental_satellite_does_not_read_the_history(spark, tmp_path, whole_paths):
    table = CommittedTable(str(tmp_path / "t"), key="hk", hash_diff="hd")
    table.commit(frame(spark, [("a", "1", "2024-01-01", "X")]), 0)
    delta = satellite(Binding(frame(spark, [("a", "1", "2024-01-02", "X"), ("a", "2", "2024-01-03", "X")])), "hk", "hd", target=table.target(spark), incremental=True)
    assert same(delta, [("a", "2", "2024-01-03", "X")])
    plan = delta._jdf.queryExecution().toString()
    assert "_states" in plan and "_marks" in plan and "batch=0" not in plan and "Window" in plan


def test_marks_of_a_hub_do_not_read_the_target(spark, tmp_path, whole_paths):
    table = CommittedTable(str(tmp_path / "t"), key="hk")
    table.commit(frame(spark, [("a", "1", "2024-01-01", "X/1"), ("b", "1", "2024-01-05", "Y")]), 0)
    new = frame(spark, [("c", "1", "2024-01-02", "X/2"), ("d", "1", "2024-01-01", "X/1"), ("e", "1", "2024-01-06", "Y")])
    delta = hub([Binding(new, rsrc_statics=["X/%"])], "hk", ["hd"], target=table.target(spark), incremental=True)
    assert same(delta, [("c", "1", "2024-01-02", "X/2")])
    plan = delta._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert all("ReadSchema: struct<hk:string>" in line for line in scans if "batch=0" in line) and any("_marks" in line for line in scans)


@pytest.mark.parametrize("seed", range(3))
def test_end_dated_table(spark, tmp_path, seed):
    rng, table = random.Random(seed), EndDatedTable(str(tmp_path / "t"), "hk")
    every = []
    for number in range(4):
        rows = [(p, rng.choice("pqr"), f"2031-07-{day:02}", "s") for p in "abcdef" for day in range(4 * number + 1, 4 * number + 5) if rng.random() < 0.3]
        every += rows
        assert table.load(frame(spark, rows), number) and not table.load(frame(spark, rows), number)
    assert same(table.view(spark), satellite_end_dated(frame(spark, every), "hk").collect())


def test_an_end_dated_load_follows_its_delta(spark, tmp_path):
    table = EndDatedTable(str(tmp_path / "t"), "hk")
    assert table.view(spark) is None and table.open_rows(spark) is None
    first = [(f"k{i % 500}", str(i), f"2031-07-{i // 500 + 1:02}", "s") for i in range(2000)]
    table.load(frame(spark, first), 0)
    opened = table.open_rows(spark)
    assert opened.count() == 500
    assert [metric(n, "numOutputRows") for n in executed(opened) if n.nodeName().startswith("Scan parquet")] == [500]  # closed rows aren't read
    table.load(frame(spark, [("k7", "x", "2031-08-01", "s"), ("k7", "y", "2031-08-02", "s"), ("new", "z", "2031-08-01", "s")]), 1)
    written = spark.read.parquet(str(tmp_path / "t" / "batch=1"))
    assert sorted((r["hk"], r["hd"], r["is_current"]) for r in written.collect()) == [("k7", "1507", "false"), ("k7", "x", "false"), ("k7", "y", "true"), ("new", "z", "true")]
    assert table.open_rows(spark).count() == 501 and table.view(spark).count() == 2003


def test_late_rows_are_an_error_of_the_end_dated_table(spark, tmp_path):
    table = EndDatedTable(str(tmp_path / "t"), "hk")
    table.load(frame(spark, [("a", "1", "2031-07-05", "s")]), 0)
    with pytest.raises(ValueError, match="later"):
        table.load(frame(spark, [("a", "0", "2031-07-04", "s")]), 1)
    assert table.load(frame(spark, [("b", "0", "2031-07-04", "s")]), 1)


def test_an_end_dated_table_is_made_anew_with_late_rows(spark, tmp_path):
    table, rows = EndDatedTable(str(tmp_path / "t"), "hk"), [("a", "1", "2031-07-05", "s"), ("b", "1", "2031-07-01", "s"), ("a", "2", "2031-07-08", "s")]
    table.load(frame(spark, rows[:2]), 0)
    table.load(frame(spark, rows[2:]), 1)
    late = ("a", "0", "2031-07-06", "s")
    assert table.remake(frame(spark, [*rows, late]), "with late rows") and not table.remake(frame(spark, rows), "with late rows")
    assert same(table.view(spark), satellite_end_dated(frame(spark, [*rows, late]), "hk").collect())
    more = ("b", "2", "2031-07-09", "s")
    assert table.load(frame(spark, [more]), 2) and not table.load(frame(spark, [more]), 1)
    want = satellite_end_dated(frame(spark, [*rows, late, more]), "hk").collect()
    assert same(table.view(spark), want) and table.table.rows(spark).count() == 6  # b's first row was open once
    assert table.compact(spark, "compact") and same(table.view(spark), want) and table.table.rows(spark).count() == 5


def test_replaced_rows_bring_their_facts(spark, tmp_path):
    table = CommittedTable(str(tmp_path / "t"), key="hk", hash_diff="hd", fold_after=2)
    for number in range(3):
        table.commit(frame(spark, [("a", str(number), f"2024-01-0{number + 1}", "X")]), number)
    assert table.replace(frame(spark, [("b", "1", "2023-01-01", "Y")]), "anew") and not table.commit(frame(spark, []), 1)
    assert same(table.rows(spark), [("b", "1", "2023-01-01", "Y")]) and [r["rsrc"] for r in table.marks(spark).collect()] == ["Y"] and table.states(spark).count() == 1
    assert table.commit(frame(spark, [("c", "1", "2023-01-02", "Y")]), 3) and table.rows(spark).count() == 2 and table.marks(spark).first()["n"] == 2


def test_kept_without_facts_is_a_target(spark):
    rows = frame(spark, [("a", "1", "2024-01-01", "X")])
    new = frame(spark, [("a", "1", "2024-01-02", "X"), ("b", "1", "2024-01-02", "X")])
    assert same(satellite(Binding(new), "hk", "hd", target=Kept(rows), incremental=True), [("b", "1", "2024-01-02", "X")])
    assert hub([Binding(new)], "hk", ["hd"], target=Kept(rows), incremental=True).filter(F.col("hk") == "b").count() == 1
