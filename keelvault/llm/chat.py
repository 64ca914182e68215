"""Chat formatting by relational expressions (operator 12).

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into a block by array
functions; blocks become one string by concatenation.  Everything, reading back included, is Spark expressions.

Template: ``<s>``, then each block between the marks of its role, its texts parted by ``[MORE]``:
``[SYS]..[/SYS]``, ``[INST]..[/INST]``, ``[OUT]..</s>`` for the assistant, ``[ROLE]name[AS]..[/ROLE]`` for any other role.
Inside of texts and names a mark gets a backslash after its first character (``<\\s>``), and one that has backslashes there
already gets one more, so that no mark is left in them, all other text stays as it is, and removing one backslash is the
exact inverse.  A mark holds ``<`` or ``[`` at its first place only, so none can begin in a text and end in a mark.

The loss mask is the list of the code-point spans [start, end) of the assistant's texts in the formatted string.

Distribution: one shuffle, by conversation.  All work on a conversation grows with its length (times its logarithm, to sort):
sums along it are made in chunks, so that no array is copied for each turn.  A conversation is one string of the result, so one
that doesn't fit a row of Spark (2 GB) can't be formatted and ends the job; all others aren't concerned.

Defined results: null texts and null roles are empty; turns are ordered by turn (null first), ties by role and text; repeated
rows are turns of their own; a row without a conv_id is a conversation of its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, MORE, NAMED = "<s>", "[MORE]", "[AS]"
#: Marks before and after the block of a role; any other role goes by the last entry and names itself.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
TRAINED = "assistant"
#: What follows the first character of a mark.
_ANGLE, _SQUARE = r"/?s>", r"(?:/?(?:SYS|INST|ROLE)|OUT|MORE|AS)\]"
MARK = rf"(?:<{_ANGLE}|\[{_SQUARE})"
TO_ESCAPE = rf"<(?=\\*{_ANGLE})|\[(?=\\*{_SQUARE})"
ESCAPED = rf"(?<=<)\\(?=\\*{_ANGLE})|(?<=\[)\\(?=\\*{_SQUARE})"
OPENING = r"\[(?:SYS|INST|OUT|ROLE)\]"
AROUND = r"(?s)^(?:\[ROLE\].*?\[AS\]|\[(?:SYS|INST|OUT)\])|(?:\[/(?:SYS|INST|ROLE)\]|</s>)\z"
#: Entries that are summed up in one go.
CHUNK = 512


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, TO_ESCAPE, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "")


def _by_role(role: Column, place: int) -> Column:
    other = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(NAMED)) if place == 0 else F.lit(OTHER[1])
    found = F.when(F.lit(False), other)
    for name, marks in MARKS.items():
        found = found.when(role == name, F.lit(marks[place]))
    return found.otherwise(other)


def with_sums(df: DataFrame, lengths: Column, name: str) -> DataFrame:
    """With the array ``name``: for each entry of ``lengths`` the sum of those before it."""

    def up_to(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))

    df = df.withColumn("_lengths", lengths)
    begins = F.sequence(F.lit(0), F.greatest(F.size("_lengths") - 1, F.lit(0)), F.lit(CHUNK))
    df = df.withColumn("_chunks", F.transform(begins, lambda at: up_to(F.slice("_lengths", at + 1, CHUNK))))
    df = df.withColumn("_offsets", up_to(F.transform("_chunks", lambda c: F.element_at(c, -1))))
    sums = F.flatten(F.transform("_chunks", lambda c, k: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x: x + F.get("_offsets", k))))
    return df.withColumn(name, sums).drop("_lengths", "_chunks", "_offsets")


def merged_turns(rows: DataFrame) -> DataFrame:
    """conv_id and blocks: array<struct<role, texts: array<string>>>, adjacent turns of one role in one block."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", turn.alias("_turn"))
    chats = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    chats = chats.unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.array("_turn").alias("_turns")))
    begins = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: (i == 0) | (F.get("_turns", i)["role"] != F.get("_turns", i - 1)["role"]))
    chats = chats.withColumn("_begins", begins)

    def block(begin: Column, k: Column) -> Column:
        own = F.slice("_turns", begin + 1, F.coalesce(F.get("_begins", k + 1), F.size("_turns")) - begin)
        return F.struct(F.get("_turns", begin)["role"].alias("role"), F.transform(own, lambda t: t["text"]).alias("texts"))

    return chats.select("conv_id", F.transform("_begins", block).alias("blocks"))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> a row a conversation: conv_id, formatted, loss (array<struct<start, end>>, code points)."""
    chats = merged_turns(rows)

    def pieces(block: Column) -> Column:
        role, texts = block["role"], block["texts"]

        def piece(text: Column, i: Column) -> Column:
            before = F.when(i == 0, _by_role(role, 0)).otherwise(F.lit(MORE))
            after = F.when(i == F.size(texts) - 1, _by_role(role, 1)).otherwise(F.lit(""))
            return F.struct(before.alias("before"), escaped(text).alias("body"), after.alias("after"), (role == TRAINED).alias("trained"))

        return F.transform(texts, piece)

    chats = chats.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("_pieces"))
    whole = F.array_join(F.transform("_pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "")
    chats = chats.withColumn("formatted", F.concat(F.lit(BEGIN), whole))
    sizes = F.transform("_pieces", lambda p: sum(F.char_length(p[c]) for c in ("before", "body", "after")).cast("long"))
    chats = with_sums(chats, sizes, "_before")

    def span(p: Column, i: Column) -> Column:
        start = F.get("_before", i) + len(BEGIN) + F.char_length(p["before"])
        return F.when(p["trained"], F.struct(start.alias("start"), (start + F.char_length(p["body"])).alias("end")))

    return chats.select("conv_id", "formatted", F.filter(F.transform("_pieces", span), lambda s: s.isNotNull()).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted conversation holds."""
    blocks = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), rf"(?={OPENING})", -1)

    def turns(block: Column) -> Column:
        role = unescaped(F.regexp_extract(block, r"(?s)^\[ROLE\](.*?)\[AS\]", 1))
        for name, (mark, _) in MARKS.items():
            role = F.when(block.startswith(mark), F.lit(name)).otherwise(role)
        texts = F.split(F.regexp_replace(block, AROUND, ""), r"\[MORE\]", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def with_loss_texts(chats: DataFrame, name: str) -> DataFrame:
    """With the array ``name``: the texts under the loss mask, unescaped, in their order.

    The string is cut before each mark; what follows a mark is found by its span, by sorting cuts and spans together.
    """
    chats = chats.withColumn("_cuts", F.split("formatted", rf"(?={MARK})", -1))
    chats = with_sums(chats, F.transform("_cuts", lambda c: F.char_length(c).cast("long")), "_at")

    def cut(c: Column, i: Column) -> Column:
        mark = F.regexp_extract(c, rf"^{MARK}", 0)
        body = F.substring(c, F.char_length(mark) + 1, F.char_length(c))
        return F.struct((F.get("_at", i) + F.char_length(mark)).alias("start"), F.lit(1).alias("kind"), (F.get("_at", i) + F.char_length(c)).alias("end"), body.alias("body"))

    spans = F.transform("loss", lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("kind"), s["end"].alias("end"), F.lit("").alias("body")))
    chats = chats.withColumn("_sorted", F.sort_array(F.concat(F.transform("_cuts", cut), spans)))

    def under(x: Column, i: Column) -> Column:
        before = F.get("_sorted", i - 1)
        return (x["kind"] == 1) & F.coalesce((before["kind"] == 0) & (before["start"] == x["start"]) & (before["end"] == x["end"]), F.lit(False))

    texts = F.transform(F.filter("_sorted", under), lambda x: unescaped(x["body"]))
    return chats.withColumn(name, texts).drop("_cuts", "_at", "_sorted")


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from format_chats' output: numbers and digests of the turns and of the text under the mask."""
    chats = with_loss_texts(chats.select("conv_id", "formatted", "loss"), "_texts").withColumn("_turns", read_turns(F.col("formatted")))
    spelled = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.select("conv_id", "formatted", F.size("_turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"), F.array_join("_texts", "").alias("_loss"))
    return chats.select("conv_id", "n_turns", "turns_sha256", F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
