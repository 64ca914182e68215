"""DuckDB SQL for the catalogue's queries, written by hand from the definitions, piece by piece."""

from __future__ import annotations

STRIP = "replace(replace(replace(replace({}, chr(9), ''), chr(10), ''), chr(11), ''), chr(13), '')"
ORDERS_BEFORE, EVENTS_BEFORE = "TIMESTAMP '2000-01-01'", "TIMESTAMP '2024-01-20'"


def hashed(*columns: str, fn: str = "md5", zeros: int = 32, upper: bool = True, trim: bool = True, empty: bool = True) -> str:
    """The hash of some columns."""
    def clean(c: str) -> str:
        text = f"CAST({c} AS VARCHAR)"
        text = f"trim({text})" if trim else text
        text = f"""'"' || replace(replace({text}, '\\', '\\\\'), '^^', '--') || '"'"""
        return f"coalesce({text}, '^^')" if empty else f"""coalesce(nullif({text}, '""'), '^^')"""

    joined = f"concat_ws('||', {', '.join(map(clean, columns))})"
    joined = STRIP.format(f"upper({joined})" if upper else joined)
    return f"coalesce({fn}(nullif({joined}, '{'||'.join(['^^'] * len(columns))}')), '{'0' * zeros}')"


ORDERS = f"""orders_staged AS (
  SELECT *, o_orderdate AS ldts, 'ERP/ORDERS' AS rsrc, {hashed('o_orderkey')} AS hk_order, {hashed('o_custkey')} AS hk_customer,
         {hashed('o_orderkey', 'o_custkey')} AS hk_link, {hashed('o_orderstatus', 'o_orderpriority')} AS hd_order
  FROM orders)"""
SYSTEMS = f"""orders_by_system AS (
  SELECT o_orderkey, o_orderdate AS ldts, CASE o_orderkey % 3 WHEN 0 THEN 'SAP/ORDERS' WHEN 1 THEN 'WEB/EU/x' ELSE 'WEB/US/x' END AS rsrc, {hashed('o_orderkey')} AS hk_order
  FROM orders)"""
SYSTEM_LINKS = f"""links_by_system AS (
  SELECT o_orderdate AS ldts, CASE o_orderkey % 3 WHEN 0 THEN 'SAP/ORDERS' WHEN 1 THEN 'WEB/EU/x' ELSE 'WEB/US/x' END AS rsrc, {hashed('o_orderkey')} AS hk_order, {hashed('o_custkey')} AS hk_customer,
         {hashed('o_orderkey', 'o_custkey')} AS hk_link
  FROM orders)"""
EVENTS = f"""events_staged AS (
  SELECT *, ts AS ldts, 'APP/EVENTS' AS rsrc, {hashed('user_id')} AS hk_user, {hashed('event_type')} AS hd_event FROM events)"""


def first_of(source: str, key: str, columns: str, order: str = "ldts") -> str:
    return f"SELECT {columns} FROM {source} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


def deduplicated(source: str, extra: str = "") -> str:
    """Rows of a satellite's source that differ from their predecessor."""
    return f"""SELECT * FROM (SELECT hk_user, hd_event, event_type, ldts, rsrc, lag(hd_event) OVER w AS prev, row_number() OVER w AS place FROM {source}{extra}
  WINDOW w AS (PARTITION BY hk_user ORDER BY ldts NULLS LAST, hd_event NULLS LAST)) WHERE NOT coalesce(hd_event = prev, false)"""


LATEST = """latest AS (SELECT hk_user, hd_event FROM target QUALIFY row_number() OVER (PARTITION BY hk_user ORDER BY ldts DESC NULLS LAST, hd_event DESC NULLS LAST) = 1)"""
SAT_TARGET = f"""{EVENTS}, target AS ({deduplicated('events_staged', f" WHERE ldts < {EVENTS_BEFORE}")})"""
SAT_COLUMNS = "hk_user, hd_event, event_type, ldts, rsrc"
ABOVE = "ldts > (SELECT coalesce(max(ldts), TIMESTAMP '0001-01-01') FROM target WHERE ldts <> TIMESTAMP '9999-12-31')"
HUB_TARGET = f"target AS (SELECT * FROM orders_staged WHERE ldts < {ORDERS_BEFORE} QUALIFY row_number() OVER (PARTITION BY hk_order ORDER BY ldts) = 1)"
SYSTEM_TARGET = f"target AS (SELECT * FROM orders_by_system WHERE ldts < {ORDERS_BEFORE})"
#: Odd values of two columns of the events, for both engines: NULL, empty, marks, backslashes, control characters, quotes.
ODD_A = """CASE event_id % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '^^' || user_id WHEN 3 THEN event_type || chr(92) || user_id WHEN 4 THEN ' ' || event_type || ' '
  WHEN 5 THEN event_type || chr(9) || user_id || chr(10) || chr(11) || 'x' || chr(13) WHEN 6 THEN upper(event_type) WHEN 7 THEN '"' || event_type || '"' WHEN 8 THEN '||' || user_id
  WHEN 9 THEN event_type || ' ' || chr(10) WHEN 10 THEN chr(12) || event_type ELSE '^^' END"""
ODD_B = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN props WHEN 3 THEN '^^' || chr(92) || event_type ELSE event_type END"
ODD = f"odd AS (SELECT event_id, {ODD_A} AS a, {ODD_B} AS b FROM events)"
#: Some hash diffs are NULL.
NO_ERRORS = "CASE WHEN event_type <> 'error' THEN hd_event END"
#: Half of all events have one parent.
HOT_USER = "CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE hk_user END"

def mark(pattern: str, others: tuple[str, ...] = ()) -> str:
    parts = " OR ".join(f"rsrc LIKE '{p}'" for p in (pattern, *others))
    return f"(rsrc LIKE '{pattern}' AND ldts > (SELECT coalesce(max(ldts), TIMESTAMP '0001-01-01') FROM target WHERE ({parts}) AND ldts <> TIMESTAMP '9999-12-31'))"


def new_keys(source: str, condition: str, columns: str = "hk_order, o_orderkey, ldts, rsrc", key: str = "hk_order") -> str:
    return f"""SELECT {columns} FROM (SELECT * FROM {source} WHERE {condition} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ldts) = 1)
  WHERE {key} NOT IN (SELECT {key} FROM target)"""


CUSTOMERS = f"""customers AS (
  SELECT c_custkey, c_name, c_mktsegment, TIMESTAMP '2024-01-01' AS ldts, 'CRM' AS rsrc, {hashed('c_custkey')} AS hk_customer FROM customer)"""
GHOSTS = """ghosts(c_custkey, c_name, c_mktsegment, ldts, rsrc, hk_customer) AS (VALUES
  (-1, '(unknown)', '(unknown)', TIMESTAMP '0001-01-01', 'SYSTEM', repeat('0', 32)), (-2, '(error)', '(error)', TIMESTAMP '9999-12-31', 'ERROR', repeat('f', 32)))"""
END = "coalesce(lead(ldts) OVER (PARTITION BY hk_user ORDER BY ldts NULLS LAST), TIMESTAMP '9999-12-31')"
V0 = f"{EVENTS}, v0 AS ({deduplicated('events_staged')})"

SQL: dict[str, str] = {
    "hash_single": f"SELECT o_orderkey, {hashed('o_orderkey')} AS h FROM orders",
    "hash_multi": f"SELECT o_orderkey, {hashed('o_orderkey', 'o_custkey', 'o_orderpriority')} AS h FROM orders",
    "hash_sha256": f"SELECT o_orderkey, {hashed('o_orderkey', 'o_custkey', fn='sha256', zeros=64)} AS h FROM orders",
    "hash_sha1": f"SELECT o_orderkey, {hashed('o_orderkey', 'o_custkey', fn='sha1', zeros=40)} AS h FROM orders",
    "hash_case_sensitive": f"SELECT event_id, {hashed('event_type', 'props', upper=False)} AS h FROM events",
    "hash_no_trim": f"SELECT event_id, {hashed('event_type', 'props', trim=False)} AS h FROM events",
    "hash_null_and_escape": f"WITH {ODD} SELECT event_id, {hashed('a')} AS h1, {hashed('a', 'b')} AS h2, {hashed('a', 'b', upper=False, trim=False)} AS h3 FROM odd",
    "hash_empty_as_null": f"WITH {ODD} SELECT event_id, {hashed('a', empty=False)} AS h1, {hashed('a', 'b', empty=False)} AS h2 FROM odd",
    "hash_unknown_algorithm": f"SELECT o_orderkey, {hashed('o_orderkey', 'o_custkey')} AS h FROM orders",
    "stage_sequence_orders": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS seq FROM orders",
    "stage_ghost_types": f"""SELECT c_custkey, c_name, c_acctbal, '2020-02-29' AS born, c_acctbal > 0 AS good, '2024-05-06 07:08:09' AS seen, c_name AS raw, '2024-01-01 00:00:00' AS ldts, 'CRM' AS rsrc, {hashed('c_custkey', fn='sha256', zeros=64)} AS hk_customer FROM customer
      UNION ALL VALUES (-1, '(unknown)', -1.0, '0001-01-01', false, '0001-01-01 00:00:00', NULL, '0001-01-01 00:00:00', 'SYSTEM', repeat('0', 64)),
      (-2, '(error)', -2.0, '9999-12-31', false, '9999-12-31 00:00:00', NULL, '9999-12-31 00:00:00', 'ERROR', repeat('f', 64))""",
    "stage_ghost_incremental": f"""WITH {ORDERS} SELECT o_orderkey, o_orderstatus, CAST(ldts AS VARCHAR) AS ldts, 'ERP' AS rsrc, hk_order FROM orders_staged WHERE ldts > (SELECT max(ldts) FROM orders_staged WHERE ldts < {ORDERS_BEFORE})
      UNION ALL VALUES (-1, '(unknown)', '0001-01-01 00:00:00', 'SYSTEM', repeat('0', 32)), (-2, '(error)', '9999-12-31 00:00:00', 'ERROR', repeat('f', 32))""",
    "stage_all_features": f"""WITH {ORDERS}, n AS (SELECT *, o_orderkey * 2 AS twice FROM orders_staged WHERE ldts > (SELECT max(ldts) FROM orders_staged WHERE ldts < {ORDERS_BEFORE}))
      SELECT o_orderkey, o_orderstatus, CAST(ldts AS VARCHAR) AS ldts, 'ERP' AS rsrc, twice, hk_order, {hashed('o_orderstatus', 'twice', upper=False)} AS hd_order, CAST(NULL AS BOOLEAN) AS legacy_flag, CAST(NULL AS VARCHAR) AS region_code, row_number() OVER (ORDER BY o_orderkey) AS seq FROM n
      UNION ALL VALUES (-1, '(unknown)', '0001-01-01 00:00:00', 'SYSTEM', -1, repeat('0', 32), repeat('0', 32), NULL, NULL, NULL), (-2, '(error)', '9999-12-31 00:00:00', 'ERROR', -2, repeat('f', 32), repeat('f', 32), NULL, NULL, NULL)""",
    "stage_basic": f"SELECT o_orderkey, o_custkey, o_orderstatus, {hashed('o_orderkey')} AS hk_order, {hashed('o_orderstatus', 'o_orderpriority')} AS hd_order FROM orders",
    "stage_derived": f"WITH {ORDERS} SELECT o_orderkey, ldts, rsrc, o_orderkey * 2 AS twice, hk_order FROM orders_staged",
    "stage_missing": f"SELECT o_orderkey, {hashed('o_orderkey')} AS hk_order, CAST(NULL AS BOOLEAN) AS legacy_flag, CAST(NULL AS VARCHAR) AS region_code, CAST(NULL AS DECIMAL(18,2)) AS discount_rate FROM orders",
    "stage_hash_only": f"SELECT {hashed('o_orderkey')} AS hk_order, {hashed('o_orderkey', 'o_custkey')} AS hk_link FROM orders",
    "stage_ghost": f"WITH {CUSTOMERS}, {GHOSTS} SELECT c_custkey, c_name, c_mktsegment, CAST(ldts AS VARCHAR) AS ldts, rsrc, hk_customer FROM (SELECT * FROM customers UNION ALL SELECT * FROM ghosts)",
    "stage_ghost_derived": f"WITH {CUSTOMERS}, {GHOSTS}, t AS (SELECT c_custkey, c_name, c_mktsegment, ldts, rsrc, c_custkey + 1 AS next_key, hk_customer FROM customers UNION ALL SELECT c_custkey, c_name, c_mktsegment, ldts, rsrc, c_custkey, hk_customer FROM ghosts) SELECT c_custkey, c_name, c_mktsegment, CAST(ldts AS VARCHAR) AS ldts, rsrc, next_key, hk_customer FROM t",
    "stage_incremental": f"WITH {ORDERS} SELECT o_orderkey, ldts, hk_order FROM orders_staged WHERE ldts > (SELECT max(ldts) FROM orders_staged WHERE ldts < {ORDERS_BEFORE})",
    "stage_incremental_empty_target": f"WITH {ORDERS} SELECT o_orderkey, ldts, hk_order FROM orders_staged WHERE ldts > (SELECT max(ldts) FROM orders_staged WHERE false)",
    "stage_sequence": f"SELECT n_nationkey, n_name, {hashed('n_nationkey')} AS hk_nation, row_number() OVER (ORDER BY n_nationkey) AS seq FROM nation",
    "hub_order_initial": f"WITH {ORDERS} {first_of('orders_staged', 'hk_order', 'hk_order, o_orderkey, ldts, rsrc')}",
    "hub_customer_from_orders": f"WITH {ORDERS} {first_of('orders_staged', 'hk_customer', 'hk_customer, o_custkey, ldts, rsrc')}",
    "hub_multi_source": f"""WITH {ORDERS}, u AS (SELECT hk_order, o_orderkey AS order_id, ldts, rsrc, 0 AS s FROM orders_staged
      UNION ALL SELECT {hashed('l_orderkey')}, l_orderkey, l_shipdate, 'ERP/LINES', 1 FROM lineitem) {first_of('u', 'hk_order', 'hk_order, order_id, ldts, rsrc', 'ldts, s')}""",
    "hub_incremental_global_hwm": f"WITH {ORDERS}, {HUB_TARGET} {new_keys('orders_staged', ABOVE)}",
    "hub_incremental_disable_hwm": f"WITH {ORDERS}, {HUB_TARGET} {new_keys('orders_staged', 'true')}",
    "hub_incremental_statics": f"WITH {SYSTEMS}, {SYSTEM_TARGET} {new_keys('orders_by_system', mark('SAP/%'))}",
    "hub_incremental_multi_statics": f"WITH {SYSTEMS}, {SYSTEM_TARGET} {new_keys('orders_by_system', mark('SAP/ORDERS') + ' OR ' + mark('WEB/_U/%', ('WEB/EU/%',)) + ' OR ' + mark('WEB/EU/%'))}",
    "hub_incremental_mixed": f"""WITH {SYSTEMS}, {SYSTEM_TARGET}, u AS (SELECT * FROM orders_by_system WHERE rsrc LIKE 'SAP/%' AND {mark('SAP/%')}
      UNION ALL SELECT * FROM orders_by_system WHERE rsrc LIKE 'WEB/%') {new_keys('u', 'true')}""",
    "hub_custom_aliases": f"WITH {ORDERS}, {HUB_TARGET} {new_keys('orders_staged', ABOVE, 'hk_order, o_orderkey, ldts AS load_dts, rsrc AS record_source')}",
    "hub_stored_target": f"WITH {ORDERS}, {HUB_TARGET} SELECT hk_order, o_orderkey, ldts, rsrc FROM target UNION ALL ({new_keys('orders_staged', ABOVE)})",
    "hub_not_in_null_target": f"""WITH {ORDERS}, c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN hk_order END AS hk FROM orders_staged), t AS (SELECT hk FROM c WHERE o_orderkey % 3 = 0)
      SELECT 'empty' AS variant, o_orderkey, hk FROM c WHERE hk NOT IN (SELECT hk FROM t WHERE false)
      UNION ALL SELECT 'full', o_orderkey, hk FROM c WHERE hk NOT IN (SELECT hk FROM t WHERE hk IS NOT NULL)
      UNION ALL SELECT 'null', o_orderkey, hk FROM c WHERE hk NOT IN (SELECT hk FROM t)""",
    "hub_json_settings": f"""WITH {ORDERS}, k AS (SELECT *, {hashed('o_orderkey', fn='sha256', zeros=64)} AS hk FROM orders_staged)
      SELECT hk AS hk_order, o_orderkey, ldts AS loaded_at, rsrc AS origin FROM k WHERE ldts > (SELECT coalesce(max(ldts), TIMESTAMP '0001-01-01') FROM k WHERE ldts < {ORDERS_BEFORE})""",
    "hub_hot_key": f"""WITH {ORDERS}, hot AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN repeat('0', 32) ELSE hk_order END AS hk_order, o_orderkey, ldts, rsrc FROM orders_staged), target AS (SELECT hk_order FROM orders_staged WHERE ldts < {ORDERS_BEFORE})
      SELECT * FROM (SELECT * FROM hot QUALIFY row_number() OVER (PARTITION BY hk_order ORDER BY ldts, o_orderkey) = 1) WHERE hk_order NOT IN (SELECT hk_order FROM target)""",
    "hub_kept_marks": f"""WITH {SYSTEMS}, target AS (SELECT * FROM orders_by_system WHERE ldts < {ORDERS_BEFORE})
      SELECT hk_order, o_orderkey, ldts, rsrc FROM target UNION ALL ({new_keys('orders_by_system', mark('SAP/%') + ' OR ' + mark('WEB/EU/%'))})""",
    "hub_bucketed_target": f"WITH {ORDERS}, {HUB_TARGET} SELECT hk_order, o_orderkey, ldts, rsrc FROM target UNION ALL ({new_keys('orders_staged', ABOVE)})",
    "hub_near_keys": f"WITH {ORDERS}, {HUB_TARGET} SELECT hk_order, o_orderkey, ldts, rsrc FROM target UNION ALL ({new_keys('orders_staged', 'o_orderkey % 50 = 0')})",
    "hub_many_patterns": f"""WITH p AS (SELECT o_orderkey, o_orderdate AS ldts, 'SRC/' || (o_custkey % 150) || '/' || o_orderstatus AS rsrc, {hashed('o_orderkey')} AS hk_order FROM orders),
      target AS (SELECT * FROM p WHERE ldts < {ORDERS_BEFORE}), marks AS (SELECT split_part(rsrc, '/', 2) AS n, max(ldts) AS mark FROM target GROUP BY 1)
      SELECT hk_order, o_orderkey, ldts, p.rsrc FROM p LEFT JOIN marks ON split_part(p.rsrc, '/', 2) = n
      WHERE CAST(split_part(p.rsrc, '/', 2) AS INTEGER) < 100 AND ldts > coalesce(mark, TIMESTAMP '0001-01-01') AND hk_order NOT IN (SELECT hk_order FROM target)""",
    "hub_stream_late": f"WITH {EVENTS} {first_of('events_staged', 'hk_user', 'hk_user, user_id, ldts, rsrc')}",
    "hub_additional_columns": f"WITH {ORDERS} {first_of('orders_staged', 'hk_order', 'hk_order, o_orderkey, o_orderstatus, ldts, rsrc')}",
    "link_order_customer": f"WITH {ORDERS} {first_of('orders_staged', 'hk_link', 'hk_link, hk_order, hk_customer, ldts, rsrc')}",
    "link_multi_source": f"""WITH u AS (SELECT {hashed('l_orderkey', 'l_partkey')} AS hk_link, {hashed('l_orderkey')} AS hk_order, {hashed('l_partkey')} AS hk_item, l_shipdate AS ldts, 'ERP/PARTS' AS rsrc, 0 AS s FROM lineitem
      UNION ALL SELECT {hashed('l_orderkey', 'l_suppkey')}, {hashed('l_orderkey')}, {hashed('l_suppkey')}, l_shipdate, 'ERP/SUPPLIERS', 1 FROM lineitem)
      {first_of('u', 'hk_link', 'hk_link, hk_order, hk_item, ldts, rsrc', 'ldts, s')}""",
    "link_fk_rename": f"WITH {ORDERS} {first_of('orders_staged', 'hk_link', 'hk_link, hk_order AS hk_o, hk_customer AS hk_c, ldts, rsrc')}",
    "link_incremental": f"WITH {ORDERS}, target AS (SELECT * FROM orders_staged WHERE ldts < {ORDERS_BEFORE} QUALIFY row_number() OVER (PARTITION BY hk_link ORDER BY ldts) = 1) {new_keys('orders_staged', ABOVE, 'hk_link, hk_order, hk_customer, ldts, rsrc', 'hk_link')}",
    "link_incremental_statics": f"WITH {SYSTEM_LINKS}, target AS (SELECT * FROM links_by_system WHERE ldts < {ORDERS_BEFORE}) {new_keys('links_by_system', mark('SAP/%') + ' OR ' + mark('WEB/EU/%'), 'hk_link, hk_order, hk_customer, ldts, rsrc', 'hk_link')}",
    "link_multi_source_statics": f"""WITH {SYSTEM_LINKS}, target AS (SELECT * FROM links_by_system WHERE ldts < {ORDERS_BEFORE} AND rsrc NOT LIKE 'WEB/US/%')
      {new_keys('links_by_system', ' OR '.join(map(mark, ('SAP/%', 'WEB/EU/%', 'WEB/US/%'))), 'hk_link, hk_order, hk_customer, ldts, rsrc', 'hk_link')}""",
    "sat_initial_multi_batch": f"WITH {EVENTS} SELECT {SAT_COLUMNS} FROM ({deduplicated('events_staged')})",
    "sat_initial_single_batch": f"WITH {EVENTS} SELECT {SAT_COLUMNS} FROM events_staged",
    "sat_incremental_multi_batch": f"WITH {SAT_TARGET}, {LATEST}, s AS ({deduplicated('events_staged', f' WHERE {ABOVE}')}) SELECT {SAT_COLUMNS} FROM s WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.hk_user = s.hk_user AND l.hd_event = s.hd_event AND s.place = 1)",
    "sat_incremental_single_batch": f"WITH {SAT_TARGET}, {LATEST} SELECT {SAT_COLUMNS} FROM events_staged s WHERE {ABOVE} AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.hk_user = s.hk_user AND l.hd_event = s.hd_event)",
    "sat_incremental_disable_hwm": f"WITH {SAT_TARGET}, {LATEST}, s AS ({deduplicated('events_staged')}) SELECT {SAT_COLUMNS} FROM s WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.hk_user = s.hk_user AND l.hd_event = s.hd_event AND s.place = 1)",
    "sat_hashdiff_rename": f"WITH {EVENTS} SELECT hk_user, hd_event AS hd, event_type, ldts, rsrc FROM ({deduplicated('events_staged')})",
    "sat_empty_payload": f"WITH {EVENTS} SELECT hk_user, hd_event, ldts, rsrc FROM ({deduplicated('events_staged')})",
    "sat_null_hashdiff": f"WITH {EVENTS}, n AS (SELECT * REPLACE ({NO_ERRORS} AS hd_event) FROM events_staged) SELECT {SAT_COLUMNS} FROM ({deduplicated('n')})",
    "sat_committed_batches": f"WITH {EVENTS} SELECT {SAT_COLUMNS} FROM ({deduplicated('events_staged')})",
    "sat_kept_state": f"WITH {EVENTS} SELECT {SAT_COLUMNS} FROM ({deduplicated('events_staged')})",
    "sat_hot_parent": f"WITH {EVENTS}, n AS (SELECT * REPLACE ({HOT_USER} AS hk_user, {NO_ERRORS} AS hd_event) FROM events_staged) SELECT {SAT_COLUMNS} FROM ({deduplicated('n')})",
    "sat_v1_hot_parent": f"WITH {EVENTS}, n AS (SELECT * REPLACE ({HOT_USER} AS hk_user) FROM events_staged), v0 AS ({deduplicated('n')}) SELECT hk_user, hd_event, CAST(ldts AS VARCHAR) AS ldts, CAST({END} AS VARCHAR) AS ledts FROM v0",
    "sat_v1_incremental": f"WITH {V0}, e AS (SELECT *, {END} AS ledts FROM v0) SELECT hk_user, hd_event, CAST(ldts AS VARCHAR) AS ldts, CAST(ledts AS VARCHAR) AS ledts, ledts = TIMESTAMP '9999-12-31' AS is_current FROM e",
    "sat_v1_end_dated": f"WITH {V0}, e AS (SELECT *, {END} AS ledts FROM v0) SELECT hk_user, hd_event, CAST(ldts AS VARCHAR) AS ldts, CAST(ledts AS VARCHAR) AS ledts, ledts = TIMESTAMP '9999-12-31' AS is_current FROM e",
    "sat_v1_no_flag": f"WITH {V0} SELECT hk_user, hd_event, CAST(ldts AS VARCHAR) AS ldts, CAST({END} AS VARCHAR) AS ledts FROM v0",
    "sat_v1_custom_alias": f"WITH {V0}, e AS (SELECT *, {END.replace('9999-12-31', '2999-12-31')} AS valid_to FROM v0) SELECT hk_user, hd_event, CAST(ldts AS VARCHAR) AS ldts, CAST(valid_to AS VARCHAR) AS valid_to, valid_to = TIMESTAMP '2999-12-31' AS open_row FROM e",
    "vault_pipeline": f"""WITH {ORDERS}, h AS ({first_of('orders_staged', 'hk_order', 'hk_order, o_orderkey, ldts')}),
      e AS (SELECT hk_order, hd_order, o_orderstatus, coalesce(lead(ldts) OVER (PARTITION BY hk_order ORDER BY ldts), TIMESTAMP '9999-12-31') AS ledts FROM orders_staged),
      l AS ({first_of('orders_staged', 'hk_link', 'hk_order, hk_customer')})
      SELECT h.o_orderkey, h.hk_order, l.hk_customer, e.hd_order, e.o_orderstatus, CAST(h.ldts AS VARCHAR) AS ldts, CAST(e.ledts AS VARCHAR) AS ledts, e.ledts = TIMESTAMP '9999-12-31' AS is_current
      FROM h JOIN e USING (hk_order) JOIN l USING (hk_order)""",
}
SQL["vault_one_pass"] = SQL["vault_pipeline"]  # the same rows, by another way
