"""The driver's queries: each operator and option, over whole tables of the test data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from functools import reduce
from itertools import pairwise
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VaultConfig
from ..functions.hashing import hash_expr, zero_key
from ..operators.anti_join import not_in
from ..operators.keyed import hub, link
from ..operators.satellite import satellite, satellite_end_dated
from ..operators.stage import stage
from ..sources.bucketed import append_bucketed, create_bucketed
from ..sources.committed import CommittedTable
from ..sources.end_dated import EndDatedTable
from ..sources.scratch import scratch_path, stored
from ..sources.tables import TableRef, append, read_table, spread
from ..specs import Binding, Kept, StageSpec
from ..streaming.first_rows import first_rows, load_first_rows
from .one_pass import load_vault_once
from .oracles import HOT_USER, NO_ERRORS, ODD_A, ODD_B
from .pipeline import VaultLoad, load_vault

ORDERS_BEFORE, EVENTS_BEFORE = "TIMESTAMP_NTZ '2000-01-01'", "TIMESTAMP_NTZ '2024-01-20'"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: Columns by which a table of few pieces is dealt out; smaller tables stay as they are.
DEALT = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}


def raw(spark: SparkSession, d: str, name: str, piece_bytes: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df, DEALT[name], piece_bytes=piece_bytes) if name in DEALT else df


def orders_spec(spark: SparkSession, d: str) -> StageSpec:
    hashes = {"hk_order": ["o_orderkey"], "hk_customer": ["o_custkey"], "hk_link": ["o_orderkey", "o_custkey"], "hd_order": {"columns": ["o_orderstatus", "o_orderpriority"], "is_hashdiff": True}}
    return StageSpec(raw(spark, d, "orders"), hashed_columns=hashes, derived_columns={"ldts": "CAST(o_orderdate AS TIMESTAMP_NTZ)", "rsrc": "'ERP/ORDERS'"})


def orders(spark: SparkSession, d: str) -> DataFrame:
    return stage(orders_spec(spark, d))


def systems(spark: SparkSession, d: str) -> DataFrame:
    derived = {"ldts": "CAST(o_orderdate AS TIMESTAMP_NTZ)", "rsrc": "CASE o_orderkey % 3 WHEN 0 THEN 'SAP/ORDERS' WHEN 1 THEN 'WEB/EU/x' ELSE 'WEB/US/x' END"}
    return stage(StageSpec(raw(spark, d, "orders"), hashed_columns={"hk_order": ["o_orderkey"]}, derived_columns=derived))


def events(spark: SparkSession, d: str) -> DataFrame:
    hashes = {"hk_user": ["user_id"], "hd_event": {"columns": ["event_type"], "is_hashdiff": True}}
    return stage(StageSpec(raw(spark, d, "events"), hashed_columns=hashes, derived_columns={"ldts": "CAST(ts AS TIMESTAMP_NTZ)", "rsrc": "'APP/EVENTS'"}))


def customer_spec(spark: SparkSession, d: str, **more: object) -> StageSpec:
    source = raw(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.expr("TIMESTAMP_NTZ '2024-01-01'").alias("ldts"), F.lit("CRM").alias("rsrc"))
    types = {"c_custkey": "BIGINT", "c_name": "VARCHAR", "c_mktsegment": "VARCHAR", "ldts": "TIMESTAMP_NTZ", "rsrc": "VARCHAR"}
    derived = more.get("derived_columns", {})
    return StageSpec(source, hashed_columns={"hk_customer": ["c_custkey"]}, ghost_record_types=types | dict.fromkeys(derived, "BIGINT"), **more)


def spelled(df: DataFrame, *columns: str) -> DataFrame:
    """Load dates as text, as some readers can't hold the sentinels."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def hash_query(table: str, key: str, columns: list[str], algorithm: str = "MD5", **options: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: raw(spark, d, table).select(key, hash_expr(columns, VaultConfig(hash=algorithm), **options).alias("h"))


QUERIES |= {
    "hash_single": hash_query("orders", "o_orderkey", ["o_orderkey"]),
    "hash_multi": hash_query("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderpriority"]),
    "hash_sha256": hash_query("orders", "o_orderkey", ["o_orderkey", "o_custkey"], "SHA256"),
    "hash_sha1": hash_query("orders", "o_orderkey", ["o_orderkey", "o_custkey"], "SHA1"),
    "hash_case_sensitive": hash_query("events", "event_id", ["event_type", "props"], case_sensitive=True),
    "hash_no_trim": hash_query("events", "event_id", ["event_type", "props"], trim=False),
    "hash_unknown_algorithm": hash_query("orders", "o_orderkey", ["o_orderkey", "o_custkey"], "BLAKE9"),
}


def odd(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "events").select("event_id", F.expr(ODD_A).alias("a"), F.expr(ODD_B).alias("b"))


@query
def hash_null_and_escape(spark: SparkSession, d: str) -> DataFrame:
    return odd(spark, d).select("event_id", hash_expr(["a"]).alias("h1"), hash_expr(["a", "b"]).alias("h2"), hash_expr(["a", "b"], case_sensitive=True, trim=False).alias("h3"))


@query
def hash_empty_as_null(spark: SparkSession, d: str) -> DataFrame:
    cfg = VaultConfig(empty_as_null=True)
    return odd(spark, d).select("event_id", hash_expr(["a"], cfg).alias("h1"), hash_expr(["a", "b"], cfg).alias("h2"))


@query
def stage_basic(spark: SparkSession, d: str) -> DataFrame:
    spec = StageSpec(raw(spark, d, "orders"), hashed_columns={"hk_order": ["o_orderkey"], "hd_order": {"columns": ["o_orderstatus", "o_orderpriority"], "is_hashdiff": True}})
    return stage(spec).select("o_orderkey", "o_custkey", "o_orderstatus", "hk_order", "hd_order")


@query
def stage_derived(spark: SparkSession, d: str) -> DataFrame:
    spec = StageSpec(raw(spark, d, "orders"), hashed_columns={"hk_order": ["o_orderkey"]}, derived_columns={"ldts": "CAST(o_orderdate AS TIMESTAMP_NTZ)", "rsrc": "'ERP/ORDERS'", "twice": "o_orderkey * 2"})
    return stage(spec).select("o_orderkey", "ldts", "rsrc", "twice", "hk_order")


@query
def stage_missing(spark: SparkSession, d: str) -> DataFrame:
    spec = StageSpec(raw(spark, d, "orders").select("o_orderkey"), hashed_columns={"hk_order": ["o_orderkey"]}, missing_columns={"legacy_flag": "BOOLEAN", "region_code": "VARCHAR", "discount_rate": "DECIMAL(18,2)"})
    return stage(spec)


@query
def stage_hash_only(spark: SparkSession, d: str) -> DataFrame:
    return stage(StageSpec(raw(spark, d, "orders"), hashed_columns={"hk_order": ["o_orderkey"], "hk_link": ["o_orderkey", "o_custkey"]}, include_source_columns=False))


@query
def stage_ghost(spark: SparkSession, d: str) -> DataFrame:
    return spelled(stage(customer_spec(spark, d)), "ldts")


@query
def stage_ghost_derived(spark: SparkSession, d: str) -> DataFrame:
    return spelled(stage(customer_spec(spark, d, derived_columns={"next_key": "c_custkey + 1"})), "ldts")


def _orders_since(spark: SparkSession, d: str, target: DataFrame) -> DataFrame:
    source = raw(spark, d, "orders").withColumn("ldts", F.col("o_orderdate").cast("timestamp_ntz"))
    return stage(StageSpec(source, hashed_columns={"hk_order": ["o_orderkey"]}), target=target, incremental=True).select("o_orderkey", "ldts", "hk_order")


@query
def stage_incremental(spark: SparkSession, d: str) -> DataFrame:
    return _orders_since(spark, d, orders(spark, d).filter(f"ldts < {ORDERS_BEFORE}"))


@query
def stage_incremental_empty_target(spark: SparkSession, d: str) -> DataFrame:
    return _orders_since(spark, d, orders(spark, d).filter("false"))


@query
def stage_sequence(spark: SparkSession, d: str) -> DataFrame:
    source = raw(spark, d, "nation").select("n_nationkey", "n_name")
    return stage(StageSpec(source, hashed_columns={"hk_nation": ["n_nationkey"]}, sequence="seq", sequence_order=["n_nationkey"]))


@query
def stage_sequence_orders(spark: SparkSession, d: str) -> DataFrame:
    source = raw(spark, d, "orders").select("o_orderkey", "o_custkey")
    return stage(StageSpec(source, sequence="seq", sequence_order=["o_custkey", "o_orderkey"]))


@query
def stage_ghost_types(spark: SparkSession, d: str) -> DataFrame:
    """A ghost value of each family of types, and ghost keys of SHA-256."""
    derived = {"born": "DATE '2020-02-29'", "good": "c_acctbal > 0", "seen": "TIMESTAMP_NTZ '2024-05-06 07:08:09'", "raw": "CAST(c_name AS BINARY)", "ldts": "TIMESTAMP_NTZ '2024-01-01'", "rsrc": "'CRM'"}
    types = {"c_custkey": "BIGINT", "c_name": "VARCHAR(25)", "c_acctbal": "DOUBLE", "born": "DATE", "good": "BOOLEAN", "seen": "TIMESTAMP_NTZ", "raw": "BINARY", "ldts": "TIMESTAMP_NTZ", "rsrc": "VARCHAR"}
    spec = StageSpec(raw(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), hashed_columns={"hk_customer": ["c_custkey"]}, derived_columns=derived, ghost_record_types=types)
    return spelled(stage(spec, cfg=VaultConfig(hash="SHA256")), "born", "seen", "raw", "ldts")


def _raw_orders(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp_ntz").alias("ldts"), F.lit("ERP").alias("rsrc"))


@query
def stage_ghost_incremental(spark: SparkSession, d: str) -> DataFrame:
    types = {"o_orderkey": "BIGINT", "o_orderstatus": "VARCHAR", "ldts": "TIMESTAMP_NTZ", "rsrc": "VARCHAR"}
    spec = StageSpec(_raw_orders(spark, d), hashed_columns={"hk_order": ["o_orderkey"]}, ghost_record_types=types)
    return spelled(stage(spec, target=orders(spark, d).filter(f"ldts < {ORDERS_BEFORE}"), incremental=True), "ldts")


@query
def stage_all_features(spark: SparkSession, d: str) -> DataFrame:
    """Incremental, derived and missing columns, hash key and hash diff, a sequence, and ghost rows."""
    types = {"o_orderkey": "BIGINT", "o_orderstatus": "VARCHAR", "ldts": "TIMESTAMP_NTZ", "rsrc": "VARCHAR", "twice": "BIGINT"}
    hashes = {"hk_order": ["o_orderkey"], "hd_order": {"columns": ["o_orderstatus", "twice"], "is_hashdiff": True, "case_sensitivity": True}}
    spec = StageSpec(_raw_orders(spark, d), hashed_columns=hashes, derived_columns={"twice": "o_orderkey * 2"}, missing_columns={"legacy_flag": "BOOLEAN", "region_code": "VARCHAR"}, sequence="seq", sequence_order=["o_orderkey"], ghost_record_types=types)
    return spelled(stage(spec, target=orders(spark, d).filter(f"ldts < {ORDERS_BEFORE}"), incremental=True), "ldts")


def order_hub(source: DataFrame, **options: object) -> DataFrame:
    return hub([Binding(source)], "hk_order", ["o_orderkey"], **options)


def known_orders(spark: SparkSession, d: str) -> DataFrame:
    return order_hub(orders(spark, d).filter(f"ldts < {ORDERS_BEFORE}"))


@query
def hub_order_initial(spark: SparkSession, d: str) -> DataFrame:
    return order_hub(orders(spark, d))


@query
def hub_customer_from_orders(spark: SparkSession, d: str) -> DataFrame:
    return hub([Binding(orders(spark, d))], "hk_customer", ["o_custkey"])


@query
def hub_multi_source(spark: SparkSession, d: str) -> DataFrame:
    lines = stage(StageSpec(raw(spark, d, "lineitem"), hashed_columns={"hk_line_order": ["l_orderkey"]}, derived_columns={"shipped": "CAST(l_shipdate AS TIMESTAMP_NTZ)", "origin": "'ERP/LINES'"}))
    sources = [Binding(orders(spark, d), bk_columns=["o_orderkey"]), Binding(lines, "shipped", "origin", bk_columns=["l_orderkey"], hash_key_col="hk_line_order")]
    return hub(sources, "hk_order", ["order_id"])


@query
def hub_incremental_global_hwm(spark: SparkSession, d: str) -> DataFrame:
    return order_hub(orders(spark, d), target=known_orders(spark, d), incremental=True)


@query
def hub_incremental_disable_hwm(spark: SparkSession, d: str) -> DataFrame:
    return order_hub(orders(spark, d), target=known_orders(spark, d), incremental=True, disable_hwm=True)


def _known_by_system(spark: SparkSession, d: str) -> DataFrame:
    return order_hub(systems(spark, d).filter(f"ldts < {ORDERS_BEFORE}"))


@query
def hub_incremental_statics(spark: SparkSession, d: str) -> DataFrame:
    return hub([Binding(systems(spark, d), rsrc_statics=["SAP/%"])], "hk_order", ["o_orderkey"], target=_known_by_system(spark, d), incremental=True)


@query
def hub_incremental_multi_statics(spark: SparkSession, d: str) -> DataFrame:
    patterns = ["SAP/ORDERS", "WEB/_U/%", "WEB/EU/%"]
    return hub([Binding(systems(spark, d), rsrc_statics=patterns)], "hk_order", ["o_orderkey"], target=_known_by_system(spark, d), incremental=True)


@query
def hub_incremental_mixed(spark: SparkSession, d: str) -> DataFrame:
    rows = systems(spark, d)
    sources = [Binding(rows.filter("rsrc LIKE 'SAP/%'"), rsrc_statics=["SAP/%"]), Binding(rows.filter("rsrc LIKE 'WEB/%'"))]
    return hub(sources, "hk_order", ["o_orderkey"], target=_known_by_system(spark, d), incremental=True)


@query
def hub_custom_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Load date and record source under other names, in the settings and in the source."""
    cfg = VaultConfig(ldts_alias="load_dts", rsrc_alias="record_source")
    source = Binding(orders(spark, d), "ldts", "rsrc")
    known = hub([Binding(orders(spark, d).filter(f"ldts < {ORDERS_BEFORE}"), "ldts", "rsrc")], "hk_order", ["o_orderkey"], cfg=cfg)
    return hub([source], "hk_order", ["o_orderkey"], target=known, incremental=True, cfg=cfg)


@query
def hub_json_settings(spark: SparkSession, d: str) -> DataFrame:
    """Names of columns and the hash from a JSON file."""
    cfg = VaultConfig.from_json(Path(__file__).parent / "settings.json")
    rows = stage(replace(orders_spec(spark, d), load_date_col="ldts", record_source_col="rsrc"), cfg=cfg)
    known = hub([Binding(rows.filter(f"ldts < {ORDERS_BEFORE}"), "ldts", "rsrc")], "hk_order", ["o_orderkey"], cfg=cfg)
    return hub([Binding(rows, "ldts", "rsrc")], "hk_order", ["o_orderkey"], target=known, incremental=True, cfg=cfg)


@contextmanager
def fresh_table(spark: SparkSession, name: str) -> Iterator[tuple[str, str]]:
    """A name that no table has, and a path for it; the name is dropped at the end, the files when the driver exits."""
    path = scratch_path(spark, name)
    table = f"keelvault_{path.rsplit('-', 1)[1]}"
    try:
        yield table, path
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


@query
def hub_stored_target(spark: SparkSession, d: str) -> DataFrame:
    """Two loads into a catalog table that is read by name: the table as it is then."""
    first = known_orders(spark, d)
    with fresh_table(spark, "hub-stored") as (name, path):
        spark.catalog.createTable(name, path, "parquet", first.schema)
        append(first, name)
        append(order_hub(orders(spark, d), target=read_table(name, spark=spark), incremental=True), name)
        columns = read_table(TableRef(name), spark=spark).columns
    return read_table(path, spark=spark).select(*columns)


@query
def hub_bucketed_target(spark: SparkSession, d: str) -> DataFrame:
    """Two loads into a table in buckets by hash key, of which the second one's exclusion doesn't move."""
    first, buckets = known_orders(spark, d), 8
    with fresh_table(spark, "hub-bucketed") as (name, path):
        create_bucketed(spark, name, first.schema, "hk_order", buckets, path)
        append_bucketed(first, name, "hk_order", buckets)
        append_bucketed(order_hub(orders(spark, d), target=read_table(name, spark=spark), incremental=True), name, "hk_order", buckets)
    return read_table(path, spark=spark).select(*first.columns)


@query
def hub_not_in_null_target(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion with no keys, with keys, and with a NULL among them."""
    rows = orders(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("hk_order")).alias("hk"))
    keys = rows.filter("o_orderkey % 3 = 0").select("hk")
    variants = {"empty": keys.filter("false"), "full": keys.filter("hk IS NOT NULL"), "null": keys}
    parts = [not_in(rows, k, "hk").select(F.lit(v).alias("variant"), "o_orderkey", "hk") for v, k in variants.items()]
    return reduce(DataFrame.unionAll, parts)


@query
def hub_hot_key(spark: SparkSession, d: str) -> DataFrame:
    """Half of all rows have the zero key: each task sends one of them."""
    zero = F.when(F.col("o_orderkey") % 2 == 0, F.lit(zero_key("MD5"))).otherwise(F.col("hk_order"))
    return order_hub(orders(spark, d).withColumn("hk_order", zero), target=known_orders(spark, d), incremental=True, disable_hwm=True)


@query
def hub_kept_marks(spark: SparkSession, d: str) -> DataFrame:
    """Two loads of a committed table: the marks of the second come from what the first kept by record source."""
    table = CommittedTable(scratch_path(spark, "hub-marks"), key="hk_order")
    table.load(spark, 1, lambda known: _known_by_system(spark, d))
    source = Binding(systems(spark, d), rsrc_statics=["SAP/%", "WEB/EU/%"])
    table.load(spark, 2, lambda known: hub([source], "hk_order", ["o_orderkey"], target=known, incremental=True))
    return table.rows(spark)


@query
def hub_near_keys(spark: SparkSession, d: str) -> DataFrame:
    """A second load that is small beside its target, of which only keys near its own are joined."""
    table = CommittedTable(scratch_path(spark, "hub-near"), key="hk_order")
    table.load(spark, 1, lambda known: known_orders(spark, d))
    few = orders(spark, d).filter("o_orderkey % 50 = 0")
    table.load(spark, 2, lambda known: order_hub(few, target=known, incremental=True, disable_hwm=True), near=few)
    return table.rows(spark)


@query
def hub_many_patterns(spark: SparkSession, d: str) -> DataFrame:
    """A hundred patterns, which are matched with the distinct record sources alone."""
    source = F.concat(F.lit("SRC/"), (F.col("o_custkey") % 150).cast("string"), F.lit("/"), F.col("o_orderstatus"))
    rows = orders(spark, d).withColumn("rsrc", source)
    known = order_hub(rows.filter(f"ldts < {ORDERS_BEFORE}"))
    return hub([Binding(rows, rsrc_statics=[f"SRC/{i}/%" for i in range(100)])], "hk_order", ["o_orderkey"], target=known, incremental=True)


@query
def hub_stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Users of the events, from a stream that gives the latest events first."""
    table, place = CommittedTable(scratch_path(spark, "hub-stream"), key="hk_user"), scratch_path(spark, "stream")
    rows = events(spark, d).select("hk_user", "user_id", "ldts", "rsrc")
    # files of the latest first
    for i, (low, high) in enumerate((("2024-01-20", "9999-01-01"), ("2024-01-10", "2024-01-20"), ("0001-01-01", "2024-01-10"))):
        rows.filter(f"ldts >= TIMESTAMP_NTZ '{low}' AND ldts < TIMESTAMP_NTZ '{high}'").write.parquet(f"{place}/in/{i}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in/*")
        load_first_rows(stream, table, "hk_user", ["user_id"], f"{place}/checkpoint", available_now=True).awaitTermination()
    return first_rows(table, spark, ["user_id"])


@query
def hub_additional_columns(spark: SparkSession, d: str) -> DataFrame:
    return order_hub(orders(spark, d), additional_columns=["o_orderstatus"])


@query
def link_order_customer(spark: SparkSession, d: str) -> DataFrame:
    return link([Binding(orders(spark, d))], "hk_link", ["hk_order", "hk_customer"])


@query
def link_multi_source(spark: SparkSession, d: str) -> DataFrame:
    hashes = {"hk_order": ["l_orderkey"], "hk_part": ["l_partkey"], "hk_supplier": ["l_suppkey"], "hk_order_part": ["l_orderkey", "l_partkey"], "hk_order_supplier": ["l_orderkey", "l_suppkey"]}
    lines = StageSpec(raw(spark, d, "lineitem", piece_bytes=4 << 20), hashed_columns=hashes, derived_columns={"ldts": "CAST(l_shipdate AS TIMESTAMP_NTZ)", "parts": "'ERP/PARTS'", "suppliers": "'ERP/SUPPLIERS'"})
    sources = [Binding(lines, record_source_col="parts", fk_columns=["hk_order", "hk_part"], hash_key_col="hk_order_part"), Binding(lines, record_source_col="suppliers", fk_columns=["hk_order", "hk_supplier"], hash_key_col="hk_order_supplier")]
    return link(sources, "hk_link", ["hk_order", "hk_item"])


@query
def link_fk_rename(spark: SparkSession, d: str) -> DataFrame:
    return link([Binding(orders(spark, d), fk_columns=["hk_order", "hk_customer"])], "hk_link", ["hk_o", "hk_c"])


@query
def link_incremental(spark: SparkSession, d: str) -> DataFrame:
    known = link([Binding(orders(spark, d).filter(f"ldts < {ORDERS_BEFORE}"))], "hk_link", ["hk_order", "hk_customer"])
    return link([Binding(orders(spark, d))], "hk_link", ["hk_order", "hk_customer"], target=known, incremental=True)


def _system_link(spark: SparkSession, d: str) -> DataFrame:
    derived = {"ldts": "CAST(o_orderdate AS TIMESTAMP_NTZ)", "rsrc": "CASE o_orderkey % 3 WHEN 0 THEN 'SAP/ORDERS' WHEN 1 THEN 'WEB/EU/x' ELSE 'WEB/US/x' END"}
    return stage(StageSpec(raw(spark, d, "orders"), hashed_columns={"hk_order": ["o_orderkey"], "hk_customer": ["o_custkey"], "hk_link": ["o_orderkey", "o_custkey"]}, derived_columns=derived))


def _link_by_system(rows: DataFrame, *bindings: Binding, **options: object) -> DataFrame:
    return link(bindings or [Binding(rows)], "hk_link", ["hk_order", "hk_customer"], **options)


@query
def link_incremental_statics(spark: SparkSession, d: str) -> DataFrame:
    rows = _system_link(spark, d)
    known = _link_by_system(rows.filter(f"ldts < {ORDERS_BEFORE}"))
    return _link_by_system(rows, Binding(rows, rsrc_statics=["SAP/%", "WEB/EU/%"]), target=known, incremental=True)


@query
def link_multi_source_statics(spark: SparkSession, d: str) -> DataFrame:
    rows = _system_link(spark, d)
    known = _link_by_system(rows.filter(f"ldts < {ORDERS_BEFORE} AND rsrc NOT LIKE 'WEB/US/%'"))
    return _link_by_system(rows, Binding(rows.filter("rsrc LIKE 'SAP/%'"), rsrc_statics=["SAP/%"]), Binding(rows.filter("rsrc LIKE 'WEB/%'"), rsrc_statics=["WEB/EU/%", "WEB/US/%"]), target=known, incremental=True)


def event_sat(source: DataFrame, **options: object) -> DataFrame:
    return satellite(Binding(source), "hk_user", "hd_event", payload=["event_type"], **options)


def known_events(spark: SparkSession, d: str) -> DataFrame:
    return event_sat(events(spark, d).filter(f"ldts < {EVENTS_BEFORE}"))


@query
def sat_initial_multi_batch(spark: SparkSession, d: str) -> DataFrame:
    return event_sat(events(spark, d))


@query
def sat_initial_single_batch(spark: SparkSession, d: str) -> DataFrame:
    return event_sat(events(spark, d), source_is_single_batch=True)


@query
def sat_incremental_multi_batch(spark: SparkSession, d: str) -> DataFrame:
    return event_sat(events(spark, d), target=known_events(spark, d), incremental=True)


@query
def sat_incremental_single_batch(spark: SparkSession, d: str) -> DataFrame:
    return event_sat(events(spark, d), target=known_events(spark, d), incremental=True, source_is_single_batch=True)


@query
def sat_incremental_disable_hwm(spark: SparkSession, d: str) -> DataFrame:
    return event_sat(events(spark, d), target=known_events(spark, d), incremental=True, disable_hwm=True)


@query
def sat_hashdiff_rename(spark: SparkSession, d: str) -> DataFrame:
    return satellite(Binding(events(spark, d)), "hk_user", {"source_column": "hd_event", "alias": "hd"}, payload=["event_type"])


@query
def sat_empty_payload(spark: SparkSession, d: str) -> DataFrame:
    return satellite(Binding(events(spark, d)), "hk_user", "hd_event")


@query
def sat_null_hashdiff(spark: SparkSession, d: str) -> DataFrame:
    return event_sat(events(spark, d).withColumn("hd_event", F.expr(NO_ERRORS)))


#: Load dates at which the events are cut into batches.
CUTS = ("0001-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "9999-01-01")


def event_batches(spark: SparkSession, d: str) -> list[DataFrame]:
    rows = events(spark, d)
    return [rows.filter(f"ldts >= TIMESTAMP_NTZ '{low}' AND ldts < TIMESTAMP_NTZ '{high}'") for low, high in pairwise(CUTS)]


@query
def sat_committed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches without marks, each given twice, and one that died after its rows were written: none counts twice."""
    table = CommittedTable(scratch_path(spark, "sat-committed"))
    for number, batch in enumerate(event_batches(spark, d)):
        def delta(known: Kept | None, batch: DataFrame = batch) -> DataFrame:
            return event_sat(batch, target=known, incremental=known is not None, disable_hwm=True)

        if number == 2:  # written, but not published
            delta(table.target(spark)).write.parquet(f"{table.path}/batch={number}/attempt=died")
        for _ in range(2):
            table.load(spark, number, delta)
    return table.rows(spark)


@query
def sat_kept_state(spark: SparkSession, d: str) -> DataFrame:
    """Loads that compare with the kept latest states; the history isn't read."""
    table = CommittedTable(scratch_path(spark, "sat-states"), key="hk_user", hash_diff="hd_event", fold_after=3)
    for number, batch in enumerate(event_batches(spark, d)):
        table.load(spark, number, lambda known, batch=batch: event_sat(batch, target=known, incremental=known is not None))
    return table.rows(spark)


def hot_user(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hk_user", F.expr(HOT_USER))


@query
def sat_hot_parent(spark: SparkSession, d: str) -> DataFrame:
    """One parent has half of all events: it is compared in slices."""
    rows = hot_user(events(spark, d)).withColumn("hd_event", F.expr(NO_ERRORS))
    return event_sat(rows, hot_rows=2000)


@query
def sat_v1_hot_parent(spark: SparkSession, d: str) -> DataFrame:
    history = stored(event_sat(hot_user(events(spark, d)), hot_rows=2000), "sat-hot-history")  # dating reads it several times
    dated = satellite_end_dated(history, "hk_user", add_is_current=False, hot_rows=2000)
    return spelled(dated, "ldts", "ledts").select("hk_user", "hd_event", "ldts", "ledts")


@query
def sat_v1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The end-dated view, kept up to date batch by batch."""
    history = CommittedTable(scratch_path(spark, "sat-history"), key="hk_user", hash_diff="hd_event")
    dated = EndDatedTable(scratch_path(spark, "sat-dated"), "hk_user")
    for number, batch in enumerate(event_batches(spark, d)):
        known = history.target(spark)
        delta = stored(event_sat(batch, target=known, incremental=known is not None), "sat-delta")
        history.commit(delta, number)
        dated.load(delta, number)
    return spelled(dated.view(spark), "ldts", "ledts").select("hk_user", "hd_event", "ldts", "ledts", "is_current")


@query
def sat_v1_end_dated(spark: SparkSession, d: str) -> DataFrame:
    return spelled(satellite_end_dated(event_sat(events(spark, d)), "hk_user"), "ldts", "ledts").select("hk_user", "hd_event", "ldts", "ledts", "is_current")


@query
def sat_v1_no_flag(spark: SparkSession, d: str) -> DataFrame:
    return spelled(satellite_end_dated(event_sat(events(spark, d)), "hk_user", add_is_current=False), "ldts", "ledts").select("hk_user", "hd_event", "ldts", "ledts")


@query
def sat_v1_custom_alias(spark: SparkSession, d: str) -> DataFrame:
    cfg = VaultConfig(end_of_all_times="2999-12-31")
    dated = satellite_end_dated(event_sat(events(spark, d)), "hk_user", ledts_alias="valid_to", is_current_col="open_row", cfg=cfg)
    return spelled(dated, "ldts", "valid_to").select("hk_user", "hd_event", "ldts", "valid_to", "open_row")


ORDER_VAULT = {"hash_key": "hk_order", "business_keys": ["o_orderkey"], "link_key": "hk_link", "foreign_keys": ["hk_order", "hk_customer"], "hash_diff": "hd_order", "payload": ["o_orderstatus"]}


def order_states(load: VaultLoad) -> DataFrame:
    states = load.end_dated.select("hk_order", "hd_order", "o_orderstatus", "ledts", "is_current")
    joined = load.hub.join(states, "hk_order").join(load.link.select("hk_order", "hk_customer"), "hk_order")
    return spelled(joined, "ldts", "ledts").select("o_orderkey", "hk_order", "hk_customer", "hd_order", "o_orderstatus", "ldts", "ledts", "is_current")


@query
def vault_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Stage, hub, link, satellite and its end-dated view, joined back into one row per order and state."""
    return order_states(load_vault(orders_spec(spark, d), **ORDER_VAULT))


@query
def vault_one_pass(spark: SparkSession, d: str) -> DataFrame:
    """The same from one scan of the raw table, without a stage."""
    return order_states(load_vault_once(orders_spec(spark, d), scratch_path(spark, "vault-once"), **ORDER_VAULT))
