"""Line breaks inside quoted CSV fields, with files that still split.

Files are read as lines, in splits. Whether a line begins inside a quoted field
depends on everything before it in its file, but a line acts on that in one of
four ways only: for each of the two states (outside, inside) in which it may
begin, it ends in one of two. Such actions compose, and any run of lines has one
action too.

1. Each line gets its action from two patterns (a quote opens a field only
   where one begins, a doubled quote stays inside it).
2. Each split is read once, in order, by one task. After a line that ends in
   the same state whatever came before, the state is known, and records are put
   together where they are read. Lines before that, and the lines of a record
   that its split does not end, are kept as lines, and a row a split tells its
   action.
3. The splits' actions tell in which state each begins. A line kept from a
   split's beginning that is a record if the split begins outside is one if it
   does.
4. Only the other lines, pieces of records that cross splits, are joined by
   shuffles, by the same actions: running ones within blocks of lines, in
   parallel (the last line that fixes the state and the parity of the swaps
   since), and a row a block that passes the state on to the next block.

A quote that is never closed would make the rest of its file one field; such a
file is refused by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.session import write_table

#: Lines of a block, at most.
BLOCK_LINES = 1 << 16
# Possessive throughout, so a line is read once. A whole field is plain text or a quoted one; an open one is a quote
# with text and doubled quotes up to the end of the line.
_QUOTED = r'[^"]*+(?>""[^"]*+)*+'
_FIELDS = rf'(?>(?>[^",][^,]*+|"{_QUOTED}"[^,]*+|),)*+'
_OPEN = rf'"{_QUOTED}$'
#: The line, begun outside, ends inside a field; and the same for a line begun inside.
OPENS = rf"^{_FIELDS}{_OPEN}"
STAYS = rf'^{_QUOTED}(?>$|"[^,]*+,{_FIELDS}{_OPEN})'


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, line) of text files; ``at`` ascends within a split."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                      F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def has_breaks(lines: DataFrame) -> bool:
    """Whether any line, begun outside a field, ends inside one (where none does, no field spans lines)."""
    return not lines.filter(F.col("line").rlike(OPENS)).isEmpty()


def _fixed(opens: Column, stays: Column) -> Column:
    """A line whose end does not depend on its beginning."""
    return opens == stays


def _with_actions(lines: DataFrame) -> DataFrame:
    quoted = F.col("line").contains('"')  # a line without quotes leaves the state as it is
    return lines.withColumns({"opens": quoted & F.col("line").rlike(OPENS), "stays": ~quoted | F.col("line").rlike(STAYS)})


#: Rows of ``pieces``: a record; a line of a split's beginning that is a record if the split begins outside, or part
#: of one; a line of a record that the split does not end; the action of a split.
RECORD, ALONE, PART, TAIL, ACTION = range(5)
PIECES = "file string, split bigint, at bigint, record string, kind int, ends_out boolean, ends_in boolean"


def pieces(lines: DataFrame) -> DataFrame:
    """What the tasks can tell of their splits alone: rows of the kinds above, with no shuffle."""

    def run(batches):  # made here, so that it goes to the workers by value
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(place, at, record, kind, ends=(None, None)):
            n = len(record)
            columns = [pa.repeat(pa.scalar(place[0], pa.string()), n), pa.repeat(pa.scalar(place[1], pa.int64()), n), pa.array(at, pa.int64()), record,
                       pa.array(kind, pa.int32()), *(pa.repeat(pa.scalar(e, pa.bool_()), n) for e in ends)]
            return pa.RecordBatch.from_arrays(columns, names=["file", "split", "at", "record", "kind", "ends_out", "ends_in"])

        def ends_of(opens, stays, begin):
            """The state after each line, of lines of which the first begins in a state."""
            swaps = np.cumsum(opens & ~stays)
            last = np.maximum.accumulate(np.where(opens == stays, np.arange(len(opens)), -1))
            state, since = np.where(last >= 0, opens[last], begin), np.where(last >= 0, swaps[last], 0)
            return state ^ ((swaps - since) % 2 == 1)

        def joined(texts, starts):
            if len(starts) == len(texts):
                return texts
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(texts)), pa.int32()), texts)
            return pc.binary_join(lists, "\n")

        place, known, outside, inside, held = None, False, False, True, None

        def last_rows():
            if held is not None:
                yield rows(place, held[0], held[1], np.full(len(held[1]), TAIL))
            ends = (held is not None,) * 2 if known else (bool(outside), bool(inside))
            yield rows(place, [0], pa.array([None], pa.string()), [ACTION], ends)

        for batch in batches:
            file, split = batch.column("file"), np.asarray(batch.column("split"))
            change = np.flatnonzero((split[1:] != split[:-1]) | np.asarray(pc.not_equal(file[1:], file[:-1]), dtype=bool)) + 1
            for low, high in zip(np.append(0, change), np.append(change, len(split))):
                if low == high:
                    continue
                here = (file[int(low)].as_py(), int(split[low]))
                if here != place:
                    if place is not None:
                        yield from last_rows()
                    place, known, outside, inside, held = here, False, False, True, None
                part = batch.slice(int(low), int(high - low))
                at, texts = np.asarray(part.column("at")), part.column("line")
                opens, stays = (np.asarray(part.column(c), dtype=bool) for c in ("opens", "stays"))
                if not known:
                    if_out, if_in = ends_of(opens, stays, outside), ends_of(opens, stays, inside)
                    sure = np.flatnonzero((if_out == if_in) & ~if_out)
                    n = int(sure[0]) + 1 if len(sure) else len(at)
                    alone = ~np.append(outside, if_out[:n - 1]) & ~if_out[:n]
                    yield rows(place, at[:n], texts[:n], np.where(alone, ALONE, PART))
                    known, outside, inside = len(sure) > 0, if_out[n - 1], if_in[n - 1]
                    at, texts, opens, stays = at[n:], texts[n:], opens[n:], stays[n:]
                if held is not None:
                    at, opens, stays = (np.concatenate(x) for x in ((held[0], at), (held[2], opens), (held[3], stays)))
                    texts, held = pa.concat_arrays([held[1], texts]), None
                if not len(at):
                    continue
                ends = ends_of(opens, stays, False)
                n = len(at) - int(np.argmax(~ends[::-1])) if not ends.all() else 0
                if n:
                    starts = np.flatnonzero(~np.append(False, ends[:n - 1]))
                    yield rows(place, at[starts], joined(texts[:n], starts), np.full(len(starts), RECORD))
                if n < len(at):
                    held = (at[n:], texts[n:], opens[n:], stays[n:])
        if place is not None:
            yield from last_rows()

    return _with_actions(lines).select("file", "split", "at", "line", "opens", "stays").mapInArrow(run, PIECES)


def _begin_inside(actions: DataFrame) -> DataFrame:
    """(file, split) of the splits that begin inside a field; a row a split is read."""
    order = Window.partitionBy("file").orderBy("split")
    swap = (F.col("ends_out") & ~F.col("ends_in")).cast("int")
    a = actions.withColumn("swaps", F.sum(swap).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fixed = F.when(F.col("ends_out") == F.col("ends_in"), F.struct(F.col("ends_out").alias("end"), F.col("swaps").alias("since")))
    a = a.withColumn("fix", F.last(fixed, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    odd = (F.coalesce(F.lag("swaps").over(order), F.lit(0)) - F.coalesce(F.col("fix.since"), F.lit(0))) % 2 == 1
    return a.withColumn("begin", F.coalesce(F.col("fix.end"), F.lit(False)) != odd).filter("begin").select("file", "split")


def records(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(file, split, at, record) of the records; ``at`` and ``split`` are those of a record's first line.

    Places of lines, and splits, may differ from read to read, so ``lines`` are read once and their pieces stored."""
    found = write_table(pieces(lines), "csv-pieces")
    inside = F.broadcast(_begin_inside(found.filter(F.col("kind") == ACTION)))  # some of the splits
    alone, place = found.filter(F.col("kind") == ALONE), ["file", "split"]
    whole = found.filter(F.col("kind") == RECORD).unionByName(alone.join(inside, place, "left_anti"))
    rest = found.filter(F.col("kind").isin(PART, TAIL)).unionByName(alone.join(inside, place, "left_semi"))
    crossing = _joined(rest.select("file", "split", "at", F.col("record").alias("line")), block_lines)
    both = whole.select("file", "split", "at", "record").unionByName(crossing)
    return both.withColumn("record", F.regexp_replace("record", "\r$", ""))


def _joined(lines: DataFrame, block_lines: int) -> DataFrame:
    """(file, split, at, record) of lines of which those left out begin and end outside."""
    lines = _with_actions(lines).withColumn("block", F.floor(F.col("at") / block_lines))
    lines = write_table(lines, "csv-lines")

    # actions of whole blocks: the last fixed line's end (null where none is) and the swaps after it
    swap = F.col("opens") & ~F.col("stays")
    within = Window.partitionBy("file", "split", "block").orderBy("at")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = _fixed(F.col("opens"), F.col("stays"))
    slim = lines.select("file", "split", "block", "at", "opens", "stays").withColumn("swaps", F.sum(swap.cast("int")).over(upto))
    slim = slim.withColumn("fix", F.last(F.when(fixed, F.struct(F.col("opens").alias("end"), F.col("swaps").alias("since"))), ignorenulls=True).over(upto))
    slim = slim.withColumn("start_fix", F.lag("fix").over(within)).withColumn("start_swaps", F.coalesce(F.lag("swaps").over(within), F.lit(0)))

    def state(fix: Column, swaps: Column, begin: Column) -> Column:
        """Whether the state after an action is inside a field."""
        odd = (swaps - F.coalesce(fix["since"], F.lit(0))) % 2 == 1
        return F.coalesce(fix["end"], begin) != odd

    blocks = slim.groupBy("file", "split", "block").agg(F.max_by(F.struct("fix", "swaps"), "at").alias("last"), F.min("at").alias("first_at"))
    files = Window.partitionBy("file").orderBy("split", "first_at")  # a row a block
    so_far = files.rowsBetween(Window.unboundedPreceding, -1)
    all_swaps = F.coalesce(F.sum(F.col("last.swaps")).over(files.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    blocks = blocks.withColumn("sum", all_swaps)
    # swaps after a block's last fixed line, counted from the file's beginning
    fix = F.when(F.col("last.fix").isNotNull(), F.struct(F.col("last.fix.end").alias("end"), (F.col("sum") - F.col("last.swaps") + F.col("last.fix.since")).alias("since")))
    blocks = blocks.withColumn("fix_so_far", F.last(fix, ignorenulls=True).over(so_far)).withColumn("sum_before", F.coalesce(F.lag("sum").over(files), F.lit(0)))
    blocks = blocks.withColumn("begin", state(F.col("fix_so_far"), F.col("sum_before"), F.lit(False)))
    ends = blocks.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("split"), F.desc("first_at"))))
    ends = ends.filter("place = 1").filter(state(F.col("last.fix"), F.col("last.swaps"), F.col("begin")))
    broken = [r["file"] for r in ends.select("file").limit(10).collect()]
    if broken:
        raise ValueError(f"a quoted field is never closed in {', '.join(broken)}")

    begins = blocks.select(*(F.col(c).alias(f"b_{c}") for c in ("file", "split", "block", "begin")))
    told = slim.join(begins, (F.col("file") == F.col("b_file")) & (F.col("split") == F.col("b_split")) & (F.col("block") == F.col("b_block")))
    inside = state(F.col("start_fix"), F.col("start_swaps"), F.col("b_begin"))
    ending = F.when(inside, F.col("stays")).otherwise(F.col("opens"))
    told = told.select("file", "split", "block", "at", inside.alias("inside"), ending.alias("open"))
    held = lines.select(F.col("at").alias("l_at"), F.col("line"))
    told = told.filter(F.col("inside") | F.col("open"))

    # the lines of records that span several: each joins the last line before it that began outside
    firsts = told.filter(~F.col("inside")).groupBy("file", "split", "block").agg(F.max("at").alias("m"))
    marks = blocks.select("file", "split", "block", "first_at").join(firsts, ["file", "split", "block"], "left")
    earlier = F.last(F.when(F.col("m").isNotNull(), F.struct(F.col("split").alias("split"), F.col("m").alias("at"))), ignorenulls=True)
    marks = marks.withColumn("before", earlier.over(so_far)).select(*(F.col(c).alias(f"m_{c}") for c in ("file", "split", "block", "before")))
    owner = F.last(F.when(~F.col("inside"), F.struct("split", "at")), ignorenulls=True).over(upto)
    told = told.withColumn("own", owner).join(marks, (F.col("file") == F.col("m_file")) & (F.col("split") == F.col("m_split")) & (F.col("block") == F.col("m_block")))
    told = told.withColumn("own", F.coalesce("own", "m_before"))
    joined = told.select("file", "split", "at", "own").join(held, F.col("at") == F.col("l_at"))
    joined = joined.groupBy("file", F.col("own.split").alias("split"), F.col("own.at").alias("at")).agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.struct("split", "at").alias("k"), "line")))["line"], "\n").alias("record"))
    spanning = told.select(F.col("at").alias("t_at"))
    single = lines.join(spanning, F.col("at") == F.col("t_at"), "left_anti").select("file", "split", "at", F.col("line").alias("record"))
    return single.unionByName(joined)
