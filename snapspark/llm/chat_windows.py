"""Chat formatting in budgeted windows.

Prefix sums of turn tokens give every turn its place in the conversation. A window holds the system turn, the latest turns
before it up to `history` tokens, and new turns; it masks what it repeats, so that each assistant text is a target in just
one window. What is left of `budget` for new turns is the conversation's room. A turn above half of the room is a window of
its own. The others are cut into stretches by their place: with m tokens in the longest of them, the turns that begin in a
stretch of room - m tokens never hold more than the room. Turns are never cut, and no window is above the budget but that of
one turn which is itself too long; such a window repeats as much history as still fits, or none.

Windows depend on prefix sums alone, so that a very long conversation is not one task's work: turns are dealt by range
of (conversation, turn), sums inside a range are joined with the totals of the ranges before it, and windows, bounded
by their budget, are put together one by one.

Template: `<s>[ROLE]`, a blank, the text, a blank, `[/ROLE]</s>`. Inside texts and roles `&`, `<`, `>`, `[` and `]` are
written as character references, so that control strings in a text can't be taken for the template's, and unescaping
gives the text back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUDGET = 512
HISTORY = 128
TURN_TOKENS = 4  # what the template itself counts for

#: Characters that the template uses, and how a text writes them; `&` comes first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"))
TURN = re.compile(r"<s>\[([^\[\]<>]*)\] ([^\[\]<>]*) \[/\1\]</s>")


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: str) -> str:
    for plain, written in reversed(ESCAPES):
        text = text.replace(written, plain)
    return text


def tokens(text: Column) -> Column:
    """Words and single signs: the default measure of a turn."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def placed_turns(turns: DataFrame, budget: int, history: int, count=tokens) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations.

    Turns: conv_id, turn, role, text, tokens, number (1, 2, ...), before (tokens of earlier turns), alone (too long to share a
    window), longs (turns of that kind before it). Conversations, one row each: conv_id, stretch (tokens a window spans),
    held (tokens of the system turn, if the first turn is one), system (its text).
    """
    text = F.coalesce(turns["text"].cast("string"), F.lit(""))
    role = F.coalesce(turns["role"].cast("string"), F.lit(""))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", (count(F.col("text")) + TURN_TOKENS).cast("long"))
    order = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    ranged = stored(ranged, "turns")
    # One row for each conversation and range.
    first = F.min_by(F.struct("role", "text", "tokens"), F.struct("part", "place"))
    firsts = ranged.groupBy("conv_id").agg(first.alias("first"))
    is_system = F.col("first.role") == "system"
    held = F.when(is_system, F.col("first.tokens")).otherwise(0)
    room = F.greatest(F.lit(1), budget - history - held)
    rooms = stored(firsts.select("conv_id", held.alias("held"), F.when(is_system, F.col("first.text")).alias("system"), room.alias("room")), "rooms")
    known = rooms.select(F.col("conv_id").alias("conv"), "room")
    marked = ranged.join(known, ranged["conv_id"].eqNullSafe(F.col("conv"))).drop("conv")
    marked = stored(marked.withColumn("alone", 2 * F.col("tokens") > F.col("room")).drop("room"), "turns")
    within = Window.partitionBy("part", "conv_id").orderBy("place")
    earlier_rows = within.rowsBetween(Window.unboundedPreceding, -1)
    longs = F.col("alone").cast("long")
    inside = marked.withColumn("number", F.row_number().over(within))
    inside = inside.withColumn("before", F.coalesce(F.sum("tokens").over(earlier_rows), F.lit(0))).withColumn("longs", F.coalesce(F.sum(longs).over(earlier_rows), F.lit(0)))
    # Earlier ranges' totals are the offsets.
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    most = F.max(F.when(~F.col("alone"), F.col("tokens")))
    totals = marked.groupBy(F.col("conv_id").alias("conv"), F.col("part").alias("range")).agg(
        F.count("*").alias("n"), F.sum("tokens").alias("sum"), F.sum(longs).alias("long"), most.alias("most")
    )
    totals = stored(totals, "turn-totals")
    before = {name: F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(name) for name, total in (("n_before", "n"), ("sum_before", "sum"), ("longs_before", "long"))}
    offsets = totals.select("conv", "range", *before.values())
    joined = inside.join(offsets, inside["conv_id"].eqNullSafe(offsets["conv"]) & (inside["part"] == offsets["range"]))
    placed = joined.select(
        "conv_id", "turn", "role", "text", "tokens", (F.col("number") + F.col("n_before")).alias("number"),
        (F.col("before") + F.col("sum_before")).alias("before"), "alone", (F.col("longs") + F.col("longs_before")).alias("longs"),
    )
    longest = totals.groupBy("conv").agg(F.coalesce(F.max("most"), F.lit(0)).alias("longest"))
    spans = rooms.join(longest, rooms["conv_id"].eqNullSafe(F.col("conv")))
    return placed, spans.select("conv_id", F.greatest(F.lit(1), F.col("room") - F.col("longest")).alias("stretch"), "held", "system")


def window_turns(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count=tokens) -> tuple[DataFrame, DataFrame]:
    """Turns with the windows they belong to, (conv_id, window, number, role, text, new), and windows (conv_id, window, system).

    A window's name orders the windows of a conversation. A turn is new in one window, and repeated in those that begin within
    `history` tokens behind its own begin; the system turn is not repeated as history.
    """
    placed, conversations = placed_turns(turns, budget, history, count)
    placed, conversations = stored(placed, "placed"), stored(conversations, "conversations")
    spans = conversations.select(F.col("conv_id").alias("conv"), "stretch", "held", F.col("system").isNotNull().alias("leads"))
    located = placed.join(spans, placed["conv_id"].eqNullSafe(F.col("conv"))).drop("conv")
    # A long turn has a name of its own, between the turns of its stretch before it and those behind it.
    number = F.expr("before div stretch")
    window = F.struct(number.alias("stretch"), F.col("longs").alias("longs"), F.col("alone").alias("alone"))
    located = located.withColumn("window", window)
    windows = located.groupBy("conv_id", "window").agg(
        F.min("before").alias("begin"), F.sum("tokens").alias("size"), F.max("held").alias("held"), F.min("number").alias("first")
    )
    # What a window may repeat; the system turn takes its place once more where the window does not have it.
    system = F.when(F.col("first") > 1, F.col("held")).otherwise(0)
    spare = F.least(F.lit(history), budget - system - F.col("size"))
    windows = windows.select(F.col("conv_id").alias("of"), "window", "begin", F.greatest(F.lit(0), spare).cast("long").alias("spare"))
    bucket = max(1, history)
    asked = windows.where("spare > 0").withColumn("bucket", F.expr(f"begin div {bucket}"))
    # Turns that end a window's begin at most `history` tokens behind theirs lie in its bucket or the one before.
    near = located.where(~(F.col("leads") & (F.col("number") == 1)) & (F.col("tokens") <= history)).drop("window")
    near = near.withColumn("bucket", F.explode(F.array(F.expr(f"before div {bucket}"), F.expr(f"before div {bucket} + 1"))))
    again = near.join(asked, near["conv_id"].eqNullSafe(asked["of"]) & (near["bucket"] == asked["bucket"]))
    distance = F.col("begin") - F.col("before")
    again = again.where((distance > 0) & (distance <= F.col("spare")))
    columns = ["conv_id", "window", "number", "role", "text"]
    every = located.select(*columns, F.lit(True).alias("new")).unionByName(again.select(*columns, F.lit(False).alias("new")))
    return every, conversations.select("conv_id", "system")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count=tokens) -> DataFrame:
    """One row per window: conv_id, window, text, segments.

    Segments are the turns in the text, in order: start and end of the turn's escaped text in code points of `text`, role,
    `new` (not repeated) and `loss` (a new assistant turn). The system turn leads every window; only in the first one, where
    it stands by itself, is it new. Null roles and texts are empty; ties of turn go by role and text; repeated rows are
    turns like others; rows with a null conv_id form one conversation. Other columns are not read. No turns, no windows.
    """
    rows, conversations = window_turns(turns, budget, history, count)
    piece = F.struct(
        "number", "new", "role", F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("] ")).alias("head"), escape(F.col("text")).alias("body"),
        F.concat(F.lit(" [/"), escape(F.col("role")), F.lit("]</s>")).alias("tail"),
    )
    grouped = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    leads = conversations.select(F.col("conv_id").alias("of"), "system")
    grouped = grouped.join(leads, grouped["conv_id"].eqNullSafe(F.col("of")), "left").drop("of")
    # The retained system turn, where the window does not have it already.
    system = F.struct(
        F.lit(1).cast("long").alias("number"), F.lit(False).alias("new"), F.lit("system").alias("role"),
        F.lit("<s>[system] ").alias("head"), escape(F.col("system")).alias("body"), F.lit(" [/system]</s>").alias("tail"),
    )
    kind = "array<struct<number:bigint,new:boolean,role:string,head:string,body:string,tail:string>>"
    lacks = F.col("system").isNotNull() & (F.element_at("turns", 1)["number"] > 1)
    full = grouped.withColumn("turns", F.concat(F.when(lacks, F.array(system)).otherwise(F.array()).cast(kind), F.col("turns").cast(kind)))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], t["tail"])), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,role:string,new:boolean,loss:boolean>>").alias("out"))
    segment = lambda a, t: F.struct(
        (a["at"] + F.length(t["head"])).alias("start"), (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"),
        t["role"].alias("role"), t["new"].alias("new"), (t["new"] & (t["role"] == "assistant")).alias("loss"),
    )
    segments = F.aggregate(
        "turns", start,
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"]) + F.length(t["tail"])).cast("long").alias("at"),
            F.concat(a["out"], F.array(segment(a, t)).cast("array<struct<start:bigint,end:bigint,role:string,new:boolean,loss:boolean>>")).alias("out"),
        ),
        lambda a: a["out"],
    )
    return full.select("conv_id", "window", text.alias("text"), segments.alias("segments"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of (conv_id, window) to one row of digests per conversation, one window in memory at a time."""
    done: list[tuple] = []
    held, started = None, False

    def result() -> tuple:
        conv, n, turns, chars, loss, formatted, windows = held
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows

    for batch in batches:
        for conv, text, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "segments"))):
            if not started or held[0] != conv:
                if started:
                    done.append(result())
                held, started = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], True
            held[5] += len(text)
            held[6] += 1
            found = list(TURN.finditer(text))
            if len(found) != len(segments) or "".join(m[0] for m in found) != text:
                raise ValueError(f"conversation {conv}: a window does not read back as its turns")
            for turn, segment in zip(found, segments):
                if segment["new"]:
                    held[1] += 1
                    held[2].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                if segment["loss"]:
                    target = unescape(text[segment["start"] : segment["end"]])
                    held[3] += len(target)
                    held[4].update(target.encode())
        if len(done) >= 1000:
            yield _rows(done)
            done = []
    if started:
        done.append(result())
    if done:
        yield _rows(done)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=[c.split()[0] for c in DIGEST.split(", ")])


def digests(windows: DataFrame) -> DataFrame:
    """What the windows say when read back, one row per conversation.

    A SHA-256 over a conversation runs over its text in order; the windows of one conversation therefore pass through one
    task, as a stream of which one window is held.
    """
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(_read_back, DIGEST)
