"""Generated loads, judged by small loaders in plain Python that follow the definitions row by row."""

import random

import pytest

from keelvault import Binding, hub, link, satellite, satellite_end_dated
from keelvault.config import VaultConfig

KEYS = ["ada", "bob", "cyd", "dee", "eve", None]
SYSTEMS = ["north/1", "north/2", "south/1", "west"]


def moment(rng):
    return f"2031-07-{rng.randint(1, 9):02}"


def history(rng, size, keys=KEYS):
    """Rows key, own id, load date, record source."""
    return [(rng.choice(keys), f"i{rng.randint(0, 3)}", moment(rng), rng.choice(SYSTEMS)) for _ in range(size)]


def fits(system, pattern):
    return system == pattern or (pattern.endswith("%") and system.startswith(pattern[:-1]))


def loaded(sources, target, marked):
    """What a hub or link inserts.  sources: (rows, patterns)."""
    rows = []
    for place, (found, patterns) in enumerate(sources):
        for key, own, day, system in found:
            if target is not None and marked and patterns:
                hits = [p for p in patterns if fits(system, p)]
                ok = any(day > max([t[2] for t in target if fits(t[3], p)], default="0001-01-01") for p in hits)
            elif target is not None and marked and len(sources) == 1:
                ok = day > max([t[2] for t in target], default="0001-01-01")
            else:
                ok = True
            if ok:
                rows.append((key, own, day, system, place))
    known = None if target is None else [t[0] for t in target]
    out = {}
    for key, own, day, system, place in sorted(rows, key=lambda r: (r[2], r[4], r[1], r[3])):
        if known and (None in known or key is None or key in known):
            continue
        out.setdefault(key, (key, own, day, system))
    return list(out.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, "hk string, own string, ldts string, rsrc string")


def same(df, rows):
    return sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, rows))


@pytest.mark.parametrize("seed", range(14))
def test_keyed(spark, seed):
    rng = random.Random(seed)
    several, statics, marked = seed % 2 == 1, seed % 3 == 0, seed % 5 != 4
    patterns = [["north/%"], ["south/1", "west"]] if statics else [None, None]
    sources = [(history(rng, rng.randint(0, 12)), p) for p in patterns[: 1 + several]]
    target = None if seed % 7 == 6 else [t for t in loaded([(history(rng, rng.randint(0, 6), KEYS[: 5 + (seed == 3)]), None)], None, False)]
    bindings = [Binding(frame(spark, rows), rsrc_statics=p or ()) for rows, p in sources]
    load = hub if seed % 4 < 2 else link
    got = load(bindings, "hk", ["own"], target=None if target is None else frame(spark, target), incremental=target is not None, disable_hwm=not marked)
    assert got.columns == ["hk", "own", "ldts", "rsrc"]
    assert same(got, loaded(sources, target, marked))


def changes(rows, target, marked, single):
    """What a satellite inserts; a row is parent, hash diff, status, load date, record source."""
    if target is not None and marked:
        mark = max([t[3] for t in target], default="0001-01-01")
        rows = [r for r in rows if r[3] > mark]
    latest = {}
    for r in sorted(target or [], key=lambda r: (r[3], r[1] is not None, r[1] or "")):
        latest[r[0]] = r[1]
    out, before, seen = [], {}, set()
    for r in sorted(rows, key=lambda r: (r[3], r[1] is None, r[1] or "")):
        parent, diff = r[0], r[1]
        first = parent not in seen
        seen.add(parent)
        repeats = not single and not first and diff is not None and before[parent] == diff
        before[parent] = diff
        stale = target is not None and (single or first) and parent is not None and diff is not None and latest.get(parent) == diff
        if not repeats and not stale:
            out.append(r)
    return out


def sat_frame(spark, rows):
    return spark.createDataFrame(rows, "hk string, hd string, status string, ldts string, rsrc string")


def states(rng, size):
    """At most one state of a parent a day."""
    found = {}
    for _ in range(size):
        diff = rng.choice(["p", "q", None]) if rng.random() < 0.8 else "r"
        parent, day = rng.choice(KEYS), moment(rng)
        found[parent, day] = (parent, diff, f"status {diff}", day, rng.choice(SYSTEMS))
    return list(found.values())


@pytest.mark.parametrize("seed", range(14))
def test_satellite(spark, seed):
    rng = random.Random(100 + seed)
    single, marked = seed % 2 == 1, seed % 3 != 2
    target = None if seed % 5 == 4 else changes(states(rng, rng.randint(0, 14)), None, False, False)
    rows = states(rng, rng.randint(0, 24))
    got = satellite(Binding(sat_frame(spark, rows)), "hk", "hd", payload=["status"], target=None if target is None else sat_frame(spark, target), incremental=target is not None, disable_hwm=not marked, source_is_single_batch=single)
    assert got.columns == ["hk", "hd", "status", "ldts", "rsrc"]
    assert same(got, changes(rows, target, marked, single))


@pytest.mark.parametrize("seed", range(3))
def test_end_dates(spark, seed):
    rng = random.Random(200 + seed)
    rows, want = states(rng, 30), []
    for r in rows:
        later = [x[3] for x in rows if x[0] == r[0] and x[3] > r[3]]
        want.append((*r, min(later, default="2999-01-01"), not later))
    got = satellite_end_dated(sat_frame(spark, rows), "hk", ledts_alias="until", is_current_col="open", cfg=VaultConfig(end_of_all_times="2999-01-01"))
    assert got.columns[-2:] == ["until", "open"] and same(got, want)
    assert satellite_end_dated(sat_frame(spark, rows), "hk", add_is_current=False).columns[-1] == "ledts"


def test_end_dates_of_ties_agree(spark):
    rows = [("ada", d, f"status {d}", "2031-07-01", "west") for d in ("p", "q", "r")]
    got = [[(r["hd"], r["ledts"]) for r in satellite_end_dated(sat_frame(spark, some).repartition(n), "hk").orderBy("hd").collect()] for some, n in ((rows, 1), (rows[::-1], 3))]
    assert got[0] == got[1] == [("p", "2031-07-01"), ("q", "2031-07-01"), ("r", "9999-12-31")]


def test_foreign_keys_of_other_names(spark, rows):
    one = spark.createDataFrame([("l1", "o1", "c1", "2031-07-01", "north/1")], "lk string, left_id string, right_id string, ldts string, rsrc string")
    two = spark.createDataFrame([("l2", "o2", "c2", "2031-07-01", "west")], "other string, hk_o string, hk_c string, loaded string, origin string")
    delta = link([Binding(one, fk_columns=["left_id", "right_id"]), Binding(two, "loaded", "origin", hash_key_col="other")], "lk", ["hk_o", "hk_c"])
    assert rows(delta) == [("l1", "o1", "c1", "2031-07-01", "north/1"), ("l2", "o2", "c2", "2031-07-01", "west")]


def test_bindings_of_one_table_are_read_once(spark, rows):
    found = spark.createDataFrame([("a1", "b1", "a", "b", "2031-07-01", "west")], "ha string, hb string, a string, b string, ldts string, rsrc string")
    delta = hub([Binding(found, hash_key_col="ha", bk_columns=["a"]), Binding(found, hash_key_col="hb", bk_columns=["b"])], "hk", ["own"])
    assert rows(delta) == [("a1", "a", "2031-07-01", "west"), ("b1", "b", "2031-07-01", "west")]
    assert "Union" not in delta._jdf.queryExecution().optimizedPlan().toString()
