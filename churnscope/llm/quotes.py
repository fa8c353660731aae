"""Quotation linking of messages (operator 1), with DataFrame functions only.

A line's quote level is the number of ``>`` in front of it. Consecutive lines
of one level are a passage; its text, lower-cased and with white space
collapsed, is hashed. A message's own lines (level 0) are hashed in the same
way: all of them, each block of consecutive lines, and each line. A quoted
passage belongs to the last earlier message of its conversation that holds the
passage, or else one of its lines, as own text. That message is found by a
running last value over the hashed units in turn order, within blocks of turns
and over the blocks, not by pairing messages. A message replies to the message
its lowest-level passage belongs to (the latest, where several do); following
replies up gives its thread, and each conversation is ordered by thread and
turn, so a message comes after the one it answers, without quotes in its text.

Only messages with quotes, and the conversations they stand in, are taken
apart by line; all others pass through.

Defined results: a null text stays null and quotes nothing, an empty one stays
empty; a null conversation is one of its own, a null turn comes first and is
earlier than all others; messages of one turn cannot answer each other and are
ordered by role and text; identical rows get identical links and places of
their own; only quotes leave an empty text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.llm.common import read, shuffle_width, write_table

#: White space within a line, and the marks in front of a quoted one.
MARKS = r"^[ \t]*(>[ \t]*)+"
QUOTED = r"(^|\n)[ \t]*>"
#: Turns a block that is searched for passages, and copies a step; the place of a null turn.
BLOCK, NO_TURN = 1024, -(1 << 62)


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def lines(messages: DataFrame) -> DataFrame:
    """One row a line: conv, turn, mid, k, level, line (marks removed) and run, the number of its passage or block.

    A line without words is of its own kind, so it ends passages and blocks."""
    rows = messages.select("conv", "turn", "mid", F.posexplode(F.split("text", "\n", -1)).alias("k", "raw"))
    mark = F.regexp_extract("raw", MARKS, 0)
    rows = rows.select("conv", "turn", "mid", "k", F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.substr("raw", F.length(mark) + 1).alias("line"))
    rows = rows.withColumn("norm", normal(F.col("line"))).withColumn("kind", F.when(F.col("norm") == "", -1).otherwise(F.col("level")))
    order = Window.partitionBy("mid").orderBy("k")
    return rows.withColumn("run", F.sum(F.coalesce((F.col("kind") != F.lag("kind").over(order)).cast("int"), F.lit(0))).over(order))


def passages(rows: DataFrame) -> DataFrame:
    """One row a run of lines with words: conv, turn, mid, run, level and its lines' text in order."""
    parts = F.array_sort(F.collect_list(F.struct("k", "norm")))
    return rows.filter("kind >= 0").groupBy("conv", "turn", "mid", "run", "level").agg(parts.alias("parts")).select("conv", "turn", "mid", "run", "level", F.transform("parts", lambda p: p["norm"]).alias("norms"))


def hashed(text: Column) -> Column:
    return F.md5(text)


def links(runs: DataFrame) -> DataFrame:
    """mid, run, level and source (turn of the message the passage belongs to, null if none)."""
    own = runs.filter("level = 0")
    whole = own.groupBy("conv", "turn", "mid").agg(F.array_sort(F.collect_list(F.struct("run", "norms"))).alias("r")).select("conv", "turn", F.array_join(F.flatten(F.transform("r", lambda x: x["norms"])), " ").alias("unit"))
    units = whole.unionByName(own.select("conv", "turn", F.array_join("norms", " ").alias("unit"))).unionByName(own.select("conv", "turn", F.explode("norms").alias("unit")))
    units = units.select("conv", "turn", hashed(F.col("unit")).alias("h")).distinct()
    quoted = runs.filter("level > 0")
    asked = quoted.select("conv", "turn", "mid", "run", "level", F.lit(-1).alias("line"), hashed(F.array_join("norms", " ")).alias("h"))
    asked = asked.unionByName(quoted.select("conv", "turn", "mid", "run", "level", F.posexplode("norms").alias("line", "n")).select("conv", "turn", "mid", "run", "level", "line", hashed(F.col("n")).alias("h")))
    found = asked.join(sources(units, asked), asked["conv"].eqNullSafe(F.col("s_conv")) & (F.col("turn") == F.col("s_turn")) & (F.col("h") == F.col("s_h")))
    # the whole passage (line -1) before its lines, the first line that is found before later ones
    best = F.min(F.when(F.col("source").isNotNull(), F.struct("line", (-F.col("source")).alias("s"))))
    return found.groupBy("mid", "run", "level").agg((-best["s"]).alias("source"))


def sources(units: DataFrame, asked: DataFrame) -> DataFrame:
    """s_conv, s_turn, s_h and source: the last turn before s_turn that holds the passage as own text, null if none.

    One row a (conversation, passage, turn), whoever asks. Turns are searched within blocks, and a block hands the last turn
    that holds the passage to the blocks after it, so a line that every turn holds is no group of its own."""
    rows = units.select("conv", "h", "turn", F.col("turn").alias("own")).unionByName(asked.select("conv", "h", "turn", F.lit(None).cast("long").alias("own")))
    rows = rows.groupBy("conv", "h", "turn").agg(F.max("own").alias("own")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    before = Window.partitionBy("conv", "h", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "h", "block").agg(F.max("own").alias("last"))
    handed = F.max("last").over(Window.partitionBy("conv", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("conv").alias("b_conv"), F.col("h").alias("b_h"), F.col("block").alias("b_block"), handed.alias("handed"))
    rows = rows.withColumn("within", F.max("own").over(before))
    rows = rows.join(blocks, rows["conv"].eqNullSafe(F.col("b_conv")) & (F.col("h") == F.col("b_h")) & (F.col("block") == F.col("b_block")))
    return rows.select(F.col("conv").alias("s_conv"), F.col("turn").alias("s_turn"), F.col("h").alias("s_h"), F.coalesce("within", "handed").alias("source"))


def threads(replies: DataFrame) -> DataFrame:
    """conv, turn, root: the first turn of each answering turn's thread, by pointer doubling (stored after each step)."""
    up = write_table(replies.select("conv", "turn", F.col("reply").alias("root")), "threads")
    while True:
        nxt = up.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"))
        joined = up.join(nxt, up["conv"].eqNullSafe(nxt["c"]) & (up["root"] == nxt["t"]), "left")
        moved = write_table(joined.select("conv", "turn", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "threads")
        up = moved.select("conv", "turn", "root")
        if not moved.filter("moved").limit(1).count():
            return up


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, thread, turn, role, text, copies, ...) one row a copy, with place: its number in its conversation from 0.

    Rows are dealt by ranges of their whole order, so a conversation, thread or turn may span many tasks; numbers are summed
    within (range, conversation), and a conversation's ranges are summed, one row each."""
    order = ["conv", "thread", "turn", "role", "text"]
    width = shuffle_width(rows.sparkSession)
    ranged = write_table(rows.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id()), "quote-order")
    parts = ranged.groupBy("conv", "part").agg(F.sum("copies").alias("c"))
    before = F.sum("c").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("conv").alias("p_conv"), F.col("part").alias("p_part"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("copies").over(Window.partitionBy("conv", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranged.withColumn("within", within - F.col("copies"))
    out = out.join(parts, out["conv"].eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part")))
    # copies in two steps, so that no array of all copies of a row is built
    out = out.withColumn("at", F.explode(F.expr(f"sequence(0L, copies - 1, {BLOCK}L)")))
    out = out.withColumn("copy", F.explode(F.expr(f"sequence(at, least(at + {BLOCK - 1}, copies - 1))")))
    return out.withColumn("place", F.col("before") + F.col("within") + F.col("copy"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Per message (conv_id, turn, role, text): conv_id, turn, role, text without quotes, n_passages, n_linked,
    max_level, reply_to (turn), thread (first turn of its thread) and place (from 0 in the conversation)."""
    # equal rows are one row with a count until they get their places
    rows = messages.groupBy("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").agg(F.count("*").alias("copies"))
    ids = rows.select(F.col("conv_id").alias("conv"), F.coalesce("turn", F.lit(NO_TURN)).alias("turn"), F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text"))).alias("mid"), "role", "text", "copies", F.coalesce(F.col("text").rlike(QUOTED), F.lit(False)).alias("has"))
    ids = write_table(ids, "messages")
    around = ids.filter("has").select(F.col("conv").alias("_conv")).distinct()
    near = ids.join(around, F.col("conv").eqNullSafe(F.col("_conv")), "left_semi")
    parsed = write_table(lines(near.filter("text is not null")), "quote-lines")
    found = write_table(links(passages(parsed)), "quote-links")

    linked = F.col("source").isNotNull()
    answer = F.min(F.when(linked, F.struct("level", (-F.col("source")).alias("s"))))
    per = found.groupBy("mid").agg(F.count("*").alias("n_passages"), F.count("source").alias("n_linked"), F.max("level").alias("max_level"), (-answer["s"]).alias("reply"))
    kept = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("k", "line"))))
    bare = parsed.groupBy("mid").agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("bare"))
    answers = ids.filter("has").join(bare.join(per, "mid", "left"), "mid")
    answers = write_table(answers.select("conv", "turn", "role", F.col("bare").alias("text"), "copies", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_passages", "n_linked", "max_level")), "reply"), "answers")

    zero = F.lit(0).cast("long")
    plain = ids.filter("not has").select("conv", "turn", "role", "text", "copies", *(zero.alias(c) for c in ("n_passages", "n_linked", "max_level")), F.lit(None).cast("long").alias("reply"))
    # several messages of a turn: the turn answers the latest message one of them answers
    replies = answers.filter("reply is not null").groupBy("conv", "turn").agg(F.max("reply").alias("reply"))
    roots = threads(replies).select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), "root")
    out = plain.unionByName(answers).join(roots, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    out = placed(out.withColumn("thread", F.coalesce("root", "turn")).drop("_conv", "_turn", "root"))
    turn = lambda c: F.when(F.col(c) != NO_TURN, F.col(c))
    return out.select(F.col("conv").alias("conv_id"), turn("turn").alias("turn"), "role", "text", "n_passages", "n_linked", "max_level", turn("reply").alias("reply_to"), turn("thread").alias("thread"), "place")


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(read(spark, sf_dir, "conversations"))
