"""Personal data by bootstrapped contextual extraction (operator 1).

Base spans of four kinds are found by fixed patterns and are the seeds; secrets that are assigned to a name (SECRET) are seeds of
a fifth.  What stands around a seed, and its shape, are lexical patterns: the word before it, the two words before it, the words
on either side, its shape (with and without the lengths of its runs), and shape and word together.  Every identifier-like token,
and every run of up to RUN numeric tokens between single blanks, is an instance of the patterns that it fits, seed or not.
Spark scores the graph of patterns and instances: a pattern's score for a kind is the lower bound (at Z standard deviations) of
the share of that kind among its distinct known instances, to which unknown ones are added with the weight UNKNOWN; so few
instances or many others make it small.  Known from the start are the seeds, and as counter-examples what has the form of a base
pattern but fails its check.  Patterns of a score of TRUSTED make the instances that they fit known, by the noisy-or of their
scores, and with those the next round scores all patterns anew, until no pattern is added or ROUNDS are over.  Trusted patterns then claim the unseen identifiers in their
slots as new spans of their kind.  Base spans always stay; a new span overlaps none, and of claims that overlap the highest score
stands, then the longest, then the first.

The graph is a table of distinct edges: each round is two aggregations and two joins, and nothing is gathered on the driver.
The text itself is read once; only identifiers, as hashes with their patterns, are shuffled.

Defined results: a null or empty text has no span; rows are told apart by id and text, and equal rows get equal spans; long runs
of digits, address characters or tokens take linear time; extra columns are ignored by ``find`` and kept by ``redact``; an empty
table gives an empty result.  Whole values, words and texts are read, however long; a secret needs a digit.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._filter import bit_map, parted
from ._store import stored
from ._text import text_slices, trimmed

#: Fixed values of the contract: kinds in order.
KINDS = ("email", "ip", "card", "phone")
#: Letters, digits and marks of an address before its @.
LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=~"
#: What is assigned to a name that says so.
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x20\x09]*+[=:][\x20\x09]*+[\"']?([A-Za-z0-9_+/-]{16,}+)")
#: All kinds of the graph, and those beside the base ones, whose spans have a column of their own.
MORE = ("secret",)
#: Identifier-like: so many digits, or an @.  Numeric tokens of a run, and their digits together.
DIGITS, RUN, RUN_DIGITS = 4, 4, 7
NUMERIC = re.compile(r"[+(]*[0-9][0-9()./-]*")
#: What has the form of a base pattern but fails its check.
NONE = "none"
#: Rounds of scoring, weight of an unknown instance, standard deviations of the lower bound, score from which a pattern is trusted.
ROUNDS, UNKNOWN, Z, TRUSTED = 4, 0.2, 1.645, 0.8
_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; each @ is tried once, with the address characters before it that are still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        size = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if size else None
        if m:
            yield at - size, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    out = [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def shape_of(value: str) -> tuple[str, str]:
    """The value with digits as 9 and letters as a or A, runs as one; and the same with the lengths of the runs."""
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"9+|a+|A+|[^9aA]", re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", re.sub(r"[^\W\d_A-Z9]", "a", value))))]
    return "".join(c for c, _ in runs), "".join(f"{c}{n}" if c in "9aA" else c for c, n in runs)


class Slots:
    """A text's words, to tell what stands around a place."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens = text, [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.starts, self.cores = [a for a, _ in self.tokens], {}

    def core(self, i: int) -> str:
        """A word without its edges, in lower case, digits as 0."""
        if i not in self.cores:
            a, b = self.tokens[i]
            self.cores[i] = re.sub(r"[0-9]+", "0", self.text[a:b].strip(EDGE).lower())
        return self.cores[i]

    def patterns(self, start: int, end: int, since: int) -> list[str]:
        """The lexical patterns of a slot; since: where the span before it ended, as a word that holds several is parted there."""
        i = bisect.bisect_right(self.starts, start) - 1
        glued = re.sub(r"[0-9]+", "0", self.text[max(self.tokens[i][0], since) : start].strip(EDGE).lower())
        left, at = [glued] if glued else [], i - 1
        while len(left) < 2 and at >= max(0, i - 4):  # words that are only edges are passed over
            if word := self.core(at):
                left.append(word)
            at -= 1
        j = bisect.bisect_left(self.starts, end)
        right = self.core(j) if j < len(self.tokens) else ""
        short, exact = shape_of(self.text[start:end])
        found = [f"S {short}", f"X {exact}"]
        if left:
            found += [f"L {left[0]}", f"LS {left[0]} {short}"]
            found += [f"LL {left[1]} {left[0]}"] if len(left) > 1 else []
            found += [f"B {left[0]} {right}"] if right else []
        return found + ([f"R {short} {right}"] if right else [])


def candidates(slots: Slots, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens and runs of numeric tokens that touch no base span."""
    text, starts, ends = slots.text, [a for a, _, _ in base], []
    for _, b, _ in base:
        ends.append(max(b, ends[-1] if ends else 0))

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)  # spans that start before b; one that ends after a overlaps
        return not i or ends[i - 1] <= a

    run: list[tuple[int, int, int]] = []  # start, end, digits of numeric tokens between single blanks
    for a, b in slots.tokens:
        word = text[a:b]
        core = word.strip(EDGE)
        digits = sum(map(core.count, "0123456789"))
        if core and (digits >= DIGITS or "@" in core):
            start = a + word.index(core)
            if free(start, start + len(core)):
                yield start, start + len(core)
        numeric = word.rstrip(EDGE.replace(")", ""))
        if not digits or not NUMERIC.fullmatch(numeric):
            run = []
            continue
        if run and not (run[-1][1] == a - 1 and text[a - 1] == " "):
            run = []
        run = [*run[1 - RUN :], (a, a + len(numeric), digits)]
        for k in range(2, len(run) + 1):
            if sum(x[2] for x in run[-k:]) >= RUN_DIGITS and free(run[-k][0], run[-1][1]):
                yield run[-k][0], run[-1][1]
        if len(numeric) < len(word):  # a mark ends a run
            run = []


def failed(value: str) -> bool:
    """Whether a value has the form of a base pattern but fails its check."""
    digits = re.sub(r"[^0-9]", "", value)
    if IP.fullmatch(value):
        return any(int(p[-4:]) > 255 or len(p.lstrip("0")) > 3 for p in value.split("."))
    if PHONE.fullmatch(value):
        return not 9 <= len(digits) <= 15
    return 12 <= len(digits) <= 19 and bool(CARD.fullmatch(value)) and not luhn(digits)


_MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
_MENTION_SQL = "struct<start:int,end:int,kind:string,value:string,patterns:array<string>>"


def scan(docs: DataFrame, hide: float = 0.0) -> DataFrame:
    """doc_id, row (a number of id and text), n_<kind>, base (spans), secrets (seeds), mentions (seeds and candidates).

    hide: the share of values that are taken for no seeds and no base spans, to measure how many of them are discovered.
    """

    def spans_of(text: str) -> tuple[list, list, list]:
        spans = base_spans(text)
        if hide:
            spans = [s for s in spans if zlib.crc32(text[s[0] : s[1]].encode()) % 1000 >= 1000 * hide]
        secrets = [(m.start(1), m.end(1), "secret") for m in SECRET.finditer(text) if any(c.isdigit() for c in m[1])]
        seeds = sorted([*spans, *secrets])
        slots, mentions, since = Slots(text), [], 0
        for start, end, kind in seeds:
            mentions.append((start, end, kind, slots.patterns(start, end, since if since <= start else 0)))
            since = max(since, end)
        ends = [b for _, b, _ in seeds]
        for start, end in candidates(slots, seeds):
            i = bisect.bisect_right(ends, start)
            mentions.append((start, end, NONE if failed(text[start:end]) else None, slots.patterns(start, end, max(ends[:i][-1:], default=0))))
        return spans, secrets, [{"start": a, "end": b, "kind": k, "value": hashlib.blake2b(text[a:b].encode(), digest_size=12).hexdigest(), "patterns": p} for a, b, k, p in mentions]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for a, b, data, off in text_slices(texts):
                marks = np.concatenate([[0], np.cumsum(_MARK[data])])
                hit = marks[off[1:]] > marks[off[:-1]]
                rows = []
                for i in range(b - a):
                    spans, secrets, mentions = spans_of(texts[a + i].as_py()) if hit[i] else ([], [], [])
                    rows.append((*[sum(s[2] == k for s in spans) for k in KINDS], spell(spans), spell(secrets), mentions))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(_MENTION)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "row", *(f"n_{k}" for k in KINDS), "base", "secrets", "mentions"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_number_of(), "text")
    return rows.mapInArrow(trimmed(work), f"doc_id long, row long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, secrets string, mentions array<{_MENTION_SQL}>")


def row_number_of():  # noqa: ANN201
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")


def lower_bound(mass: Column, n: Column) -> Column:
    """Wilson's lower bound of a share."""
    p, z = mass / n, Z * Z / n
    return (p + z / 2 - F.sqrt(z * p * (1 - p) + z * z / 4)) / (1 + z)


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """edges: pattern, value, kind (null: unknown), distinct.  Returns pattern, kind, score of the trusted patterns."""
    slots = stored(edges.select("pattern", "value").distinct(), "pii-slots")
    sizes = stored(slots.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pii-sizes")
    seeds = stored(edges.filter("kind IS NOT NULL").select("value", "kind").distinct().withColumn("confidence", F.lit(1.0)), "pii-seeds")
    known, before, scored = seeds, -1, None
    for turn in range(ROUNDS):
        held = stored(slots.join(known, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("mass"), F.count(F.lit(1)).alias("many")), "pii-mass")
        whole = held.groupBy("pattern").agg(F.sum("mass").alias("whole"), F.sum("many").alias("told")).join(sizes, "pattern")
        whole = whole.select("pattern", (F.col("whole") + UNKNOWN * F.greatest(F.col("n") - F.col("told"), F.lit(0))).alias("n"))
        score = lower_bound(F.col("mass"), F.col("n"))
        scored = held.filter(F.col("kind") != NONE).join(whole, "pattern").select("pattern", "kind", score.alias("score"))
        scored = stored(scored.filter(F.col("score") >= TRUSTED), "pii-scores")
        trusted = scored.count()
        if trusted <= before or turn == ROUNDS - 1:
            break
        before = trusted
        doubt = slots.join(scored, "pattern").groupBy("value", "kind").agg(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))).alias("doubt"))
        best = doubt.groupBy("value").agg(F.min(F.struct("doubt", "kind")).alias("b")).select("value", "b.kind", (1 - F.exp("b.doubt")).alias("confidence"))
        known = stored(seeds.unionByName(best.join(seeds.select("value"), "value", "left_anti")), "pii-known")
    return scored.groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("b")).select("pattern", "b.kind", "b.score")


def find(docs: DataFrame, hide: float = 0.0) -> DataFrame:
    """doc_id, row, n_<kind> (of base spans), base, spans (base and discovered ones), secrets, n_discovered (spans that are not
    base), a row for each document.  hide: see scan()."""
    scanned = stored(scan(docs, hide), "pii-scan")
    mentions = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.start", "m.end", "m.kind", "m.value", F.explode("m.patterns").alias("pattern"))
    edges = stored(mentions.select("pattern", "value", "kind").distinct(), "pii-edges")
    trusted = stored(trusted_patterns(edges), "pii-trusted")
    claimed = mentions.filter("kind IS NULL").drop("kind").join(trusted, "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("score", "kind")).alias("b"))
    claims = claimed.groupBy("row").agg(F.collect_list(F.struct("b.score", "start", "end", "b.kind")).alias("claims"))  # of one text
    wide = scanned.drop("mentions").join(claims, "row", "left").select("doc_id", "row", *(f"n_{k}" for k in KINDS), "base", "secrets", "claims")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [settled(*r) for r in zip(*(batch.column(i).to_pylist() for i in (6, 7, 8)), strict=True)]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *columns], names=[*batch.schema.names[:7], "spans", "secrets", "n_discovered"])

    return wide.mapInArrow(work, f"doc_id long, row long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string, secrets string, n_discovered long")


def unspelled(spans: str) -> list[tuple[int, int, str]]:
    return [(int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def settled(base: str, secrets: str, claims: list | None) -> tuple[str, str, int]:
    """(spans, secrets, number of new spans): of claims that overlap the highest score stands, then the longest, then the first."""
    new: list[tuple[int, int, str]] = []
    for c in sorted(claims or [], key=lambda c: (-c["score"], c["start"] - c["end"], c["start"])):
        at = bisect.bisect_left(new, (c["start"],))
        if (at == 0 or new[at - 1][1] <= c["start"]) and (at == len(new) or new[at][0] >= c["end"]):
            new.insert(at, (c["start"], c["end"], c["kind"]))
    own = [x for x in new if x[2] in KINDS]
    spans = spell(sorted([*unspelled(base), *own], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))) if own else base
    return spans, spell(sorted([*unspelled(secrets), *(x for x in new if x[2] in MORE)])), len(own)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each span of their texts, secrets too, replaced by its kind in brackets; n_chars, if there, follows."""
    own = docs.columns
    both = F.concat_ws(",", F.nullif("spans", F.lit("")), F.nullif("secrets", F.lit("")))
    spans = find(docs).select("row", both.alias("spans")).filter("spans <> ''").dropDuplicates(["row"])
    inner = {c: f"_{i}" for i, c in enumerate(own)}
    at = own.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t.as_py(), s.as_py()) for t, s in zip(batch.column(at), batch.column(len(own)), strict=True)]
            columns = [pa.array(texts, batch.column(at).type) if i == at else c for i, c in enumerate(batch.columns[: len(own)])]
            yield pa.RecordBatch.from_arrays(columns, names=list(inner.values()))

    spans = stored(spans, "pii-spans").withColumnRenamed("row", "_row")
    renamed = docs.select(row_number_of().alias("_row"), *[F.col(c).alias(n) for c, n in inner.items()])
    near, far = parted(renamed, F.xxhash64("_row"), bit_map(spans, F.xxhash64("_row"), "pii-map"))  # texts without spans aren't shuffled
    joined = near.join(spans, "_row", "left").select(*inner.values(), F.coalesce("spans", F.lit("")).alias("spans"))
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in inner.items())
    done = joined.mapInArrow(work, fields).unionByName(far.select(*inner.values()))
    out = {c: F.col(n) for c, n in inner.items()}
    if "n_chars" in own:
        out["n_chars"] = F.char_length(inner["text"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*[out[c].alias(c) for c in own])


def masked(text: str | None, spans: str) -> str | None:
    """Overlapping spans become one mark, of the first one's kind."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in sorted(unspelled(spans), key=lambda x: (x[0], (*KINDS, *MORE).index(x[2]))):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
