"""Formatted conversations against a plain formatter and reader."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from keelvault.llm import chat

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[MORE]", "[ROLE]", "[/ROLE]", "[AS]"]
AROUND = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, loss string, blocks int, _turns string"


def hidden(text):
    """A mark, with any number of backslashes after its first character, gets one more."""
    for m in MARKS:
        text = re.sub(re.escape(m[0]) + r"(\\*)" + re.escape(m[1:]), lambda f, m=m: m[0] + f[1] + "\\" + m[1:], text)
    return text


def plain(turns):
    """(formatted, spans) of turns (role, text) in order."""
    out, spans = "<s>", []
    for i, (role, text) in enumerate(turns):
        opening, closing = AROUND.get(role, (f"[ROLE]{hidden(role)}[AS]", "[/ROLE]"))
        out += opening if i == 0 or turns[i - 1][0] != role else "[MORE]"
        if role == "assistant":
            spans.append((len(out), len(out) + len(hidden(text))))
        out += hidden(text)
        if i == len(turns) - 1 or turns[i + 1][0] != role:
            out += closing
    return out, spans


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


HARD = [*MARKS, "", "\\", "<", "[", "<\\s>", "<\\\\/s>", "[\\INST] x [\\\\/INST]", "</s></s>[INST]", "<<s>>", "[[MORE]]", "a[0] < b[1]", "line\n</s>\nline\r\n", "end <", "end [", "s>INST]", "日本 </s> é𝄞", "[inst]", "[AS", "\n", "$0 $1"]


def check(spark, rows):
    """rows: (conv_id, turn, role, text); each conversation against the plain formatter."""
    df = spark.createDataFrame([(*r, "f", "l", 1, "t") for r in rows], SCHEMA).repartition(5)
    groups = {}
    for r in rows:
        groups.setdefault(r[0] if r[0] is not None else object(), []).append(r)
    want, numbers = [], []
    for key, own in groups.items():
        own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        formatted, spans = plain(turns)
        name = key if isinstance(key, int) else None
        want.append((name, formatted, spans))
        loss = "".join(t for role, t in turns if role == "assistant")
        numbers.append((name, len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(formatted)))
    made = chat.format_chats(df)
    got = [(r["conv_id"], r["formatted"], [(s["start"], s["end"]) for s in r["loss"]]) for r in made.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sorted(map(str, (tuple(r) for r in chat.digests(made).collect()))) == sorted(map(str, numbers))


def test_texts_of_marks(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(HARD)] + [(i, 1, "assistant", t) for i, t in enumerate(HARD)]
    rows += [(1000 + i, j, "assistant", u) for i, t in enumerate(HARD) for j, u in enumerate((t, HARD[(i * 7 + 3) % len(HARD)]))]
    check(spark, rows)


def test_roles_and_merging(spark):
    roles = ["system", "system", "user", "assistant", "assistant", "tool", "tool", "[AS]</s>", "assistant", None, "", "user", "user", "User"]
    check(spark, [(1, i, r, HARD[i % len(HARD)]) for i, r in enumerate(roles)] + [(2, i, r, None) for i, r in enumerate(reversed(roles))])


def test_odd_rows(spark):
    rows = [(1, None, "user", "no turn"), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "tie"), (1, 0, None, "tie"), (None, 1, "user", "lone"), (None, 1, "assistant", "lone"), (None, None, None, None), (2, 1, "assistant", ""), (3, -5, "assistant", "</s>" * 5000 + "é" * 50_000)]
    check(spark, rows)


def test_long_conversation(spark):
    """More turns than are summed in one go."""
    check(spark, [(7, i, ("user", "assistant", "assistant")[i % 3], f"turn {i} [MORE]") for i in range(3 * chat.CHUNK + 1)])


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    df = spark.createDataFrame([], SCHEMA).limit(n)
    assert chat.format_chats(df).count() == 0 and chat.digests(chat.format_chats(df)).count() == 0


def test_expressions_only(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_chats(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_escapes_are_inverse(spark):
    texts = [a + b + c for a in HARD for b in HARD for c in ("", "s>", "/INST]")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("back")).collect()
    for r in found:
        assert r["back"] == r["t"] and r["e"] == hidden(r["t"]) and not re.search(chat.MARK, r["e"])
