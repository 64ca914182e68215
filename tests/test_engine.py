"""Hashing, staging, high-water marks, NULL rules, settings, sources and streams."""

import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from keelvault import Binding, StageSpec, TableRef, VaultConfig, append, hub, link, read_table, satellite, stage
from keelvault.functions.hashing import hash_expr
from keelvault.functions.types import family, spark_type
from keelvault.operators.anti_join import not_in
from keelvault.operators.hwm import sql_like
from keelvault.plans.pipeline import load_vault
from keelvault.sources.tables import spread
from keelvault.streaming.batches import load_stream


def key_of(*values, upper=True):
    parts = ["^^" if v is None else '"' + v.strip(" ").replace("\\", "\\\\").replace("^^", "--") + '"' for v in values]
    text = "||".join(parts)
    text = text.upper() if upper else text
    text = text.translate({9: None, 10: None, 11: None, 13: None})
    return "0" * 32 if set(parts) == {"^^"} else hashlib.md5(text.encode()).hexdigest()


VALUES = [None, "", " a ", "A", "^^", "a\\b", 'q"q', "x\ty\nz\x0bw\r", "a \n", "f\x0cf", "||", "éü"]


def test_hash_of_one_and_two_columns(spark):
    pairs = [(a, b) for a in VALUES for b in VALUES]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", hash_expr(["a"]).alias("one"), hash_expr(["a", "b"]).alias("two"), hash_expr(["a", "b"], case_sensitive=True).alias("exact"))
    for r in df.collect():
        assert (r["one"], r["two"], r["exact"]) == (key_of(r["a"]), key_of(r["a"], r["b"]), key_of(r["a"], r["b"], upper=False))


@pytest.mark.parametrize(("name", "fn", "size"), [("MD5", "md5", 32), ("SHA1", "sha1", 40), ("sha256", "sha256", 64), ("SHA2", "sha256", 64), ("nonsense", "md5", 32)])
def test_algorithms(spark, name, fn, size):
    row = spark.createDataFrame([("a", None)], "a string, b string").select(hash_expr(["a"], VaultConfig(hash=name)).alias("x"), hash_expr(["b"], VaultConfig(hash=name)).alias("y")).first()
    assert row["x"] == getattr(hashlib, fn)(b'"A"').hexdigest() and row["y"] == "0" * size


def test_empty_as_null_and_no_columns(spark):
    row = spark.createDataFrame([("",)], "a string").select(hash_expr(["a"], VaultConfig(empty_as_null=True)).alias("x")).first()
    assert row["x"] == "0" * 32
    with pytest.raises(ValueError):
        hash_expr([])


def source(spark):
    return spark.createDataFrame([(1, "a", "2024-01-01", "X"), (2, None, "2024-01-02", "Y")], "id int, name string, ldts string, rsrc string")


def test_stage_order_of_columns_and_precedence(spark):
    rules = {"hk": ["name"], "hd": {"columns": ["name"], "is_hashdiff": True, "case_sensitivity": True}, "cfg": {"columns": ["name"], "case_sensitivity": None}}
    spec = StageSpec(source(spark), hashed_columns=rules, derived_columns={"twice": "id * 2"}, missing_columns={"gone": "VARCHAR", "odd": "NO_SUCH_TYPE"}, case_sensitivity=True, sequence="n", sequence_order=["id"])
    got = stage(spec)
    assert got.columns == ["id", "name", "ldts", "rsrc", "twice", "hk", "hd", "cfg", "gone", "odd", "n"]
    first = got.filter("id = 1").first()
    assert first["hk"] == key_of("a", upper=False) and first["cfg"] == key_of("a") and first["twice"] == 2
    assert [r["n"] for r in got.orderBy("id").collect()] == [1, 2] and first["gone"] is None


def test_stage_without_source_columns_drops_derived(spark):
    spec = StageSpec(source(spark), hashed_columns={"hk": ["twice"]}, derived_columns={"twice": "id * 2"}, include_source_columns=False)
    assert stage(spec).columns == ["hk"]


def test_stage_errors(spark):
    with pytest.raises(ValueError, match="at least one column"):
        stage(StageSpec(source(spark), include_source_columns=False))
    with pytest.raises(ValueError, match="derived"):
        stage(StageSpec(source(spark), derived_columns={"NAME": "1"}))
    with pytest.raises(ValueError, match="ghost"):
        stage(StageSpec(source(spark), ghost_record_types={"id": "INT"}))
    with pytest.raises(ValueError, match="target"):
        stage(StageSpec(source(spark)), incremental=True)


def test_ghosts(spark, rows):
    types = {"id": "INT", "name": "VARCHAR(20)", "ldts": "VARCHAR", "rsrc": "VARCHAR"}
    got = stage(StageSpec(source(spark), hashed_columns={"hk": ["id"]}, ghost_record_types=types, missing_columns={"gone": "DATE"}))
    ghosts = rows(got.filter("id < 0"), "id", "name", "ldts", "rsrc", "hk", "gone")
    assert ghosts == [(-1, "(unknown)", "0001-01-01", "SYSTEM", "0" * 32, None), (-2, "(error)", "9999-12-31", "ERROR", "f" * 32, None)]


def test_type_names():
    assert [family(t) for t in ("TIMESTAMP_NTZ", "datetime2", "DATE", "VARCHAR(9)", "INTERVAL", "POINT", "BOOL", "BOOLEAN", "TIME", "ARRAY")] == ["time", "time", "date", "string", "number", "number", "other", "boolean", "other", "other"]
    assert [spark_type(t) for t in ("VARCHAR", "number(10, 2)", "DECIMAL(5)", "nothing at all", "BIGINT")] == ["string", "decimal(10,2)", "decimal(5,0)", "string", "bigint"]


def hub_rows(spark, found):
    return spark.createDataFrame(found, "hk string, id string, ldts string, rsrc string")


def test_stage_mark_of_empty_target(spark):
    empty = hub_rows(spark, [])
    assert stage(StageSpec(source(spark)), target=empty, incremental=True).count() == 0
    assert stage(StageSpec(source(spark)), target=empty, incremental=True, pass_empty_target=True).count() == 2


def test_global_mark_is_strict_and_skips_the_error_ghost(spark, rows):
    target = hub_rows(spark, [("t", "t", "2024-01-05", "X"), ("f" * 32, "(error)", "9999-12-31", "ERROR")])
    new = hub_rows(spark, [("a", "a", "2024-01-05", "X"), ("b", "b", "2024-01-06", "X"), ("c", "c", None, "X")])
    assert rows(hub([Binding(new)], "hk", ["id"], target=target, incremental=True), "hk") == [("b",)]
    assert rows(hub([Binding(new)], "hk", ["id"], target=target, incremental=True, disable_hwm=True), "hk") == [("a",), ("b",), ("c",)]
    assert rows(hub([Binding(new), Binding(new)], "hk", ["id"], target=target, incremental=True), "hk") == [("a",), ("b",), ("c",)]


def test_marks_by_pattern(spark, rows):
    target = hub_rows(spark, [("t1", "1", "2024-01-05", "SAP/ORDERS"), ("t2", "2", "2024-01-09", "WEB/EU")])
    new = hub_rows(spark, [("a", "a", "2024-01-06", "SAP/ORDERS"), ("b", "b", "2024-01-06", "WEB/EU"), ("c", "c", "2024-01-10", "OTHER"), ("d", "d", "2024-01-01", "FRESH/1")])
    one = hub([Binding(new, rsrc_statics=["SAP/%", "WEB/__", "FRESH/_"])], "hk", ["id"], target=target, incremental=True)
    assert rows(one, "hk") == [("a",), ("d",)]  # OTHER fits no pattern
    assert hub([Binding(new, rsrc_statics=["SAP/%"])], "hk", ["id"]).count() == 4  # initial load: no filter
    wide = hub([Binding(new, rsrc_statics=["SAP/ORDERS", "%"])], "hk", ["id"], target=target, incremental=True)
    assert rows(wide, "hk") == [("a",), ("c",)]
    mixed = hub([Binding(new.filter("rsrc LIKE 'SAP%'"), rsrc_statics=["SAP/%"]), Binding(new.filter("rsrc NOT LIKE 'SAP%'"))], "hk", ["id"], target=target, incremental=True)
    assert rows(mixed, "hk") == [("a",), ("b",), ("c",), ("d",)]  # a source without patterns isn't filtered beside others


def test_patterns():
    assert sql_like("SAP/ORDERS", "SAP/%") and sql_like("ab", "a_") and not sql_like("abc", "a_") and sql_like("a\\b", "a\\_")


@pytest.mark.parametrize(("keys", "expected"), [([], ["a", None]), (["a"], []), (["b"], ["a"]), (["b", None], [])])
def test_not_in(spark, keys, expected):
    got = not_in(spark.createDataFrame([("a",), (None,)], "k string"), spark.createDataFrame([(k,) for k in keys], "k string"), "k")
    assert [r["k"] for r in got.collect()] == expected


def test_not_in_does_not_broadcast_keys(spark):
    plan = not_in(spark.range(10).selectExpr("cast(id as string) k"), spark.range(5).selectExpr("cast(id as string) k"), "k")
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "null-aware" not in plan._jdf.queryExecution().toString().lower()


def test_satellite_shuffles_by_parent_once_a_side(spark):
    events = spark.range(1000).selectExpr("cast(id % 50 as string) hk", "cast(id % 3 as string) hd", "cast(id as string) ldts", "'x' rsrc").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        delta = satellite(Binding(events), "hk", "hd", target=events.repartition(3), incremental=True, disable_hwm=True)
        plan = delta._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(hk") == 2


def test_key_checks(spark):
    df = hub_rows(spark, [])
    for call in (lambda: hub([Binding(df)], "hk", []), lambda: link([Binding(df)], "hk", []), lambda: hub([Binding(df, bk_columns=["a", "b"])], "hk", ["id"]), lambda: link([Binding(df, fk_columns=["a", "b"])], "hk", ["id"]), lambda: hub([], "hk", ["id"]), lambda: hub([Binding(df)], "hk", ["id"], incremental=True)):
        with pytest.raises(ValueError):
            call()


def test_additional_columns(spark):
    df = hub_rows(spark, [("a", "1", "2024-01-01", "X")]).withColumn("tag", F.lit("t"))
    assert hub([Binding(df)], "hk", ["id"], additional_columns=["tag"]).columns == ["hk", "id", "tag", "ldts", "rsrc"]
    assert hub([Binding(df, additional_columns=["tag"])], "hk", ["id"]).first()["tag"] == "t"
    with pytest.raises(ValueError, match="additional"):
        hub([Binding(df, additional_columns=["tag"]), Binding(df)], "hk", ["id"])


def test_settings(tmp_path):
    file = tmp_path / "config.json"
    file.write_text(json.dumps({"ldts_alias": "load_dts", "nothing": 1}))
    assert VaultConfig.from_json(file).ldts_alias == "load_dts"
    assert VaultConfig.from_json(tmp_path / "none.json") == VaultConfig()
    file.write_text("{broken")
    assert VaultConfig.from_json(file) == VaultConfig()


def test_tables(spark, tmp_path):
    assert TableRef("t", "s", "d").identifier() == "`d`.`s`.`t`" and TableRef("t").identifier(quote=False) == "t"
    with pytest.raises(ValueError):
        TableRef("")
    df = hub_rows(spark, [("a", "1", "2024-01-01", "X")])
    append(df, str(tmp_path / "hub"))
    append(df, str(tmp_path / "hub"))
    assert read_table(str(tmp_path / "hub"), spark=spark).count() == 2
    df.createOrReplaceTempView("hub_view")
    assert read_table(TableRef("hub_view")).count() == 1 and hub([Binding("hub_view")], "hk", ["id"]).count() == 1


def test_stream_loads_once(spark, tmp_path):
    source = str(tmp_path / "in")
    hub_rows(spark, [("a", "1", "2024-01-01", "X"), ("a", "1", "2024-01-02", "X")]).write.parquet(source)

    def run():
        stream = spark.readStream.schema("hk string, id string, ldts string, rsrc string").parquet(source)
        delta = lambda batch, known: hub([Binding(batch)], "hk", ["id"], target=known, incremental=known is not None, disable_hwm=True)
        load_stream(stream, str(tmp_path / "hub"), delta, str(tmp_path / "cp"), available_now=True).awaitTermination()

    run()
    hub_rows(spark, [("a", "1", "2024-01-03", "X"), ("b", "2", "2024-01-03", "X")]).write.mode("append").parquet(source)
    run()
    assert sorted(r["hk"] for r in spark.read.parquet(str(tmp_path / "hub")).collect()) == ["a", "b"]


def test_stream_marks_its_batches(spark, tmp_path):
    """A satellite of several batches without marks would insert a repeated batch again; its mark prevents that."""
    source, target = str(tmp_path / "in"), str(tmp_path / "sat")
    schema = "hk string, hd string, ldts string, rsrc string"
    spark.createDataFrame([("a", "1", "2024-01-01", "X"), ("a", "2", "2024-01-02", "X")], schema).write.parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(source)
        delta = lambda batch, known: satellite(Binding(batch), "hk", "hd", target=known, incremental=known is not None, disable_hwm=True)
        load_stream(stream, target, delta, checkpoint, available_now=True).awaitTermination()

    run(str(tmp_path / "cp"))
    shutil.rmtree(tmp_path / "cp" / "commits")  # as after a failure between append and commit
    run(str(tmp_path / "cp"))
    assert spark.read.parquet(target).count() == 2


def test_append_by_name(spark):
    one = spark.createDataFrame([("k", "x", "y")], "hk string, a string, b string")
    spark.sql("DROP TABLE IF EXISTS append_by_name")
    append(one, "append_by_name")
    append(one.select("b", "hk", "a"), "append_by_name")
    assert {tuple(r) for r in spark.table("append_by_name").collect()} == {("k", "x", "y")}
    with pytest.raises(ValueError, match="columns"):
        append(one.drop("b"), "append_by_name")
    spark.sql("DROP TABLE append_by_name")


def test_map_as_an_additional_column(spark):
    df = hub_rows(spark, [("a", "1", "2024-01-01", "X"), ("a", "1", "2024-01-01", "X")]).withColumn("tags", F.create_map(F.lit("t"), "id"))
    assert [r["tags"] for r in hub([Binding(df)], "hk", ["id"], additional_columns=["tags"]).collect()] == [{"t": "1"}]


def test_sequence_is_numbered_by_ranges(spark):
    df = spark.range(5000).selectExpr("id % 7 AS g", "id", "if(id % 3 = 0, null, id) AS v").repartition(9)
    got = stage(StageSpec(df, sequence="n", sequence_order=["g", "id"]))
    assert got.columns == ["g", "id", "v", "n"]
    assert [r["n"] for r in got.orderBy("g", "id").collect()] == list(range(1, 5001))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["n"] for r in stage(StageSpec(df.limit(50), sequence="n")).collect()) == list(range(1, 51))
    assert stage(StageSpec(df.limit(0), sequence="n")).count() == 0


def test_one_aggregate_over_the_target(spark):
    target, new = hub_rows(spark, [("t", "t", "2024-01-05", "X")]), hub_rows(spark, [("a", "a", "2024-01-06", "X")])
    plan = hub([Binding(new)], "hk", ["id"], target=target, incremental=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ScalarSubquery") == 0 or plan.split("Subquery")[0].count("Aggregate") == 0
    assert plan.index("LeftAnti") < plan.index("Window")  # keys are ranked first, so that each task sends one row of a key


def test_stage_is_written_once(spark, tmp_path):
    spec = StageSpec(source(spark), hashed_columns={"hk": ["id"], "hl": ["id", "name"], "hd": {"columns": ["name"], "is_hashdiff": True}})
    load = load_vault(spec, hash_key="hk", business_keys=["id"], link_key="hl", foreign_keys=["hk"], hash_diff="hd", payload=["name"], stage_to=str(tmp_path / "stage"))
    assert load.hub.count() == load.link.count() == load.end_dated.count() == 2
    assert "md5" not in load.satellite._jdf.queryExecution().optimizedPlan().toString()


def test_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(9).write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert spread(one, "id").rdd.getNumPartitions() > 1 and spread(one, "id").count() == 1000
    pieces = many.rdd.getNumPartitions()
    assert pieces < spark.sparkContext.defaultParallelism or "Exchange" not in spread(many, "id")._jdf.queryExecution().executedPlan().toString()
