"""Chat formatting by quotation linking.

Leading ``>`` marks give each line of a message its quote level. Neighbouring lines of one level are a passage. A passage,
lower-cased and with single spaces, is hashed as a whole, and so is each of its sentences of four words and more, so
wrapping, marks and partial quotes don't matter, while a short sentence alone links nothing. A hash's original is the
first message of the conversation that says it without quoting it. A message answers the latest original among its least
quoted passages; without one it answers nothing and begins a thread. Threads come in the order of their first messages,
each message before its answers, and answers in order of place: reply_order counts the conversation's messages so.

No conversation is gathered in a task. Messages are range-partitioned and numbered, links are pointers between numbers,
and both the way to the root and the walk through the threads - into a message, out of it behind its last answer - are
shortened by half in each round of joins on unique numbers. Conversations without links take no part in that.

Defined results: a null text counts as empty; messages are ordered by turn (nulls first), role and the hash of their text,
so repeated turns and rows keep places of their own; a null conv_id is a conversation like any other; a passage that
nobody said before, or that only later messages say first, links nothing; an empty table gives an empty result; other
columns are left out. Whole texts are parsed.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few, free, in_batches, numbered, ordered, slices, table

#: Words of a sentence that is hashed by itself, at least.
LEAST_WORDS = 4
_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_LEAD = re.compile(r"(?i)^\s*(?:on\b.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*$")
_STOP = re.compile(r"(?<=[.!?])\s+")


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, text) of each passage; level 0 is the message's own. Lines that announce a quote are left out."""
    lines = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        lines.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    out: list[tuple[int, list[str]]] = []
    for i, (level, line) in enumerate(lines):
        if _LEAD.match(line) and any(x[0] > level for x in lines[i + 1 : i + 3]):
            continue
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return [(level, "\n".join(x)) for level, x in out]


def hashes(passage: str) -> list[int]:
    """Hashes of a normalised passage and of its sentences."""
    whole = " ".join(passage.lower().split())
    said = {whole, *(s for s in _STOP.split(whole) if s.count(" ") >= LEAST_WORDS - 1)}
    return sorted(xxhash.xxh3_64_intdigest(s.encode()) - (1 << 63) for s in said if s)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, part, inside, text without quotes, said and quoted (level, hash)."""
    keep = ("conv_id", "turn", "role", "part", "inside")

    def run(batches):
        for batch in slices(batches, "text"):
            own, said, quoted = [], [], []
            for text in batch.column("text").to_pylist():
                parts = levels(text or "")
                kept = [p for level, p in parts if not level]
                own.append(re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n") if len(parts) > len(kept) else text or "")
                said.append(sorted({h for p in kept for h in hashes(p)}))
                quoted.append([{"level": level, "hash": h} for level, p in parts if level for h in hashes(p)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own, pa.string()), pa.array(said, pa.list_(pa.int64())), pa.array(quoted, pa.list_(pa.struct({"level": pa.int32(), "hash": pa.int64()})))], names=[*keep, "text", "said", "quoted"])

    kind = messages.schema["turn"].dataType.simpleString()
    return in_batches(messages.select(*keep, "text"), run, f"conv_id long, turn {kind}, role string, part long, inside long, text string, said array<long>, quoted array<struct<level:int,hash:bigint>>")


def answers(parts: DataFrame) -> DataFrame:
    """at, parent, n_linked of the messages (at, conv_id, said, quoted) that answer an earlier one."""
    quoted = cut(parts.where(F.size("quoted") > 0).select("at", "conv_id", F.explode("quoted").alias("q")).select("at", "conv_id", "q.level", "q.hash"), "quoted")
    wanted = cut(quoted.select(F.col("conv_id").alias("c"), F.col("hash").alias("h")).distinct(), "wanted")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h"))
    said = parts.select("at", "conv_id", F.explode("said").alias("hash")).join(few(wanted), same, "left_semi")
    first = cut(said.groupBy("conv_id", "hash").agg(F.min("at").alias("origin")).select(F.col("conv_id").alias("c"), F.col("hash").alias("h"), "origin"), "origins")
    linked = quoted.join(few(first), same & (F.col("origin") < F.col("at")))
    least = F.min(F.struct("level", (-F.col("origin")).alias("origin")))
    return cut(linked.groupBy("at").agg(least.alias("a"), F.count("*").cast("int").alias("n_linked")).select("at", (-F.col("a.origin")).alias("parent"), "n_linked"), "answers")


def roots(links: DataFrame) -> DataFrame:
    """at, root of each message with a parent: each round joins the way known so far to itself."""
    up = cut(links.select("at", F.col("parent").alias("root")), "up")
    while True:
        above = up.select(F.col("at").alias("a"), F.col("root").alias("r"))
        new = cut(up.join(above, F.col("root") == F.col("a"), "left").select("at", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "up")
        free(up)
        up = new
        if up.where("moved").isEmpty():
            return up.drop("moved")


def walked(nodes: DataFrame) -> DataFrame:
    """at, behind, depth of each of ``nodes`` (at, first, parent): messages from it on in the walk through its
    conversation (first: its first message), and those that it hangs below."""
    placed = numbered(cut(ordered(nodes, "first", F.col("parent").asc_nulls_first(), "at"), "siblings"), "k")
    placed = cut(placed, "siblings")
    ahead = placed.select((F.col("k") - 1).alias("k1"), F.col("first").alias("f1"), F.col("parent").alias("p1"), F.col("at").alias("sibling"))
    eldest = placed.where("parent is not null").groupBy("parent").agg(F.min("at").alias("child")).select(F.col("parent").alias("p2"), "child")
    beside = placed.join(ahead, (F.col("k") == F.col("k1")) & (F.col("first") == F.col("f1")) & F.col("parent").eqNullSafe(F.col("p1")), "left").join(eldest, F.col("at") == F.col("p2"), "left")
    # a message is entered at 2 * at and left at 2 * at + 1
    enter = F.struct((F.col("at") * 2).alias("a"), F.coalesce(F.col("child") * 2, F.col("at") * 2 + 1).alias("to"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d"))
    leave = F.struct((F.col("at") * 2 + 1).alias("a"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"))
    walk = cut(beside.select(F.explode(F.array(enter, leave)).alias("s")).select("s.*"), "walk")
    while not walk.where("to is not null").isEmpty():
        then = walk.select(F.col("a").alias("a2"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("d").alias("d2"))
        new = walk.join(then, F.col("to") == F.col("a2"), "left").select("a", F.col("to2").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"))
        new = cut(new, "walk")
        free(walk)
        walk = new
    return walk.where("a % 2 = 0").select((F.col("a") / 2).cast("long").alias("at"), F.col("n").alias("behind"), (-F.col("d")).cast("int").alias("depth"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, place, parent_turn, root_turn, depth, reply_order, n_quoted, n_linked, text of every message."""
    given = messages.select(F.col("conv_id").cast("long"), "turn", "role", "text", F.xxhash64("text").alias("tie"))
    parts = numbered(cut(parsed(ordered(given, "conv_id", "turn", "role", "tie")), "messages"), "at")
    held = cut(parts.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("held")).select(F.col("conv_id").alias("c"), "first", "held"), "held")
    parts = parts.join(few(held), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    linked = answers(parts)
    place = (F.col("at") - F.col("first") + 1).cast("int").alias("place")
    size = F.size("quoted").alias("n_quoted")
    if linked.isEmpty():
        none = F.lit(None).cast(messages.schema["turn"].dataType)
        return parts.select("conv_id", "turn", "role", place, none.alias("parent_turn"), F.col("turn").alias("root_turn"), F.lit(0).alias("depth"), place.alias("reply_order"), size, F.lit(0).alias("n_linked"), "text")
    narrow = cut(parts.select("at", "first", "held", "turn"), "narrow")
    with_links = cut(narrow.join(few(linked), "at", "left_semi").select("first").distinct(), "with-links")
    nodes = cut(narrow.join(few(with_links), "first", "left_semi").join(few(linked), "at", "left").join(roots(linked), "at", "left"), "nodes")
    turns = narrow.select(F.col("at").alias("t"), "turn")
    told = nodes.join(walked(nodes.select("at", "first", "parent")), "at")
    told = told.join(turns.withColumnRenamed("turn", "parent_turn"), F.col("parent") == F.col("t"), "left").drop("t").join(turns.withColumnRenamed("turn", "root_turn"), F.coalesce("root", "at") == F.col("t")).drop("t")
    told = cut(told.select(F.col("at").alias("a"), F.lit(True).alias("told"), "parent_turn", F.col("root_turn").alias("r"), F.col("depth").alias("d"), (F.col("held") - F.col("behind") + 1).cast("int").alias("o"), F.col("n_linked").alias("l")), "told")
    whole = parts.join(few(told), F.col("at") == F.col("a"), "left")
    root = F.when(F.col("told"), F.col("r")).otherwise(F.col("turn")).alias("root_turn")
    return whole.select("conv_id", "turn", "role", place, "parent_turn", root, F.coalesce("d", F.lit(0)).alias("depth"), F.coalesce(F.col("o"), place).alias("reply_order"), size, F.coalesce("l", F.lit(0)).alias("n_linked"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))
