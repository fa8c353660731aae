"""Conversation structure repair over a suffix-shared automaton (operator 12).

A conversation is a word over a few letters, one a turn: the role's class and
the turn's first fault. Blank and duplicate turns, which have to go whatever
their role, are one letter. Words are shared from their ends: read backwards
and sorted, those that end alike lie next to each other, and each distinct
suffix is one node of the automaton, whatever conversations it belongs to. At
a node the least cost to go and the best audit suffix are computed once for
each state of the grammar ``(s?(ua)+)?``, from those of the node one turn
shorter. Edits are single letters that each lead to one state, so the least
letter among the cheapest gives the least audit.

Edits: Keep (0), Rerole to the role the grammar asks for (1), Delete (2),
Insert an empty turn (5); a truncated turn that stays adds 5.

Scale: turns are range-sorted, so a conversation of any length lies over many
tasks. Its word is cut into units of at most ``UNIT`` turns. The units of a
conversation that has several are chained from the back: the automaton gives
the cost from each state at a unit's start to each at its end, and one short
row a unit passes the costs to go to the unit before. Duplicates are the turns
that are not the first of their role and text, found by an aggregate and a
join by position, so a line that a third of all turns repeat is no hot key.
Only the last pass reads a conversation's turns in order, one at a time; a
digest over a whole conversation cannot be taken otherwise.

Defined results: a null role or text is one space; turns are taken by number,
nulls first, equal ones by a hash of role and text; repeated rows are
duplicates; null conversation ids are one conversation; a role is known by its
first letter, any other than s, u, a has to be changed; a conversation
without turns has no rows in ``repair`` and zeros in ``op12_repair``; empty
input gives an empty result; other columns are ignored. Texts pass as they
are, of any length. Duplicates are told by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.llm.common import WORD, read, shuffle_width, stored_steps, write_table

#: Turns of a unit are those whose positions agree but for so many bits.
UNIT_BITS = 9
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Stands for "no way"; costs to go stay far below it.
NEVER = 1 << 60

# Grammar states: nothing yet, after s, after u, after a.
STATES = range(4)
#: The role that u or a must have next, and where it leads.
NEXT_ROLE, NEXT_STATE = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Where a kept role leads, by its letter.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: Costs to go and audits at the end of a conversation: it may end empty or after an assistant.
END = (((0, 2 * INSERT, INSERT, 0)), ("", "II", "I", ""))


# ---------------------------------------------------------------- one node of the automaton


def node(letter: str, costs: tuple, audits: tuple) -> tuple[tuple, tuple]:
    """Costs to go and best audits in each state before a turn, from those after it.

    Letters: s, u, a, o (other) for a sound turn, upper case for a truncated one, x for one that has to go."""
    found = []
    role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    for q in STATES:
        ways = [(costs[q] + DELETE, "D", audits[q])]
        if role != "x":
            to = KEPT[role].get(q)
            if to is not None:
                ways.append((costs[to] + KEEP + extra, "K", audits[to]))
            to = NEXT_STATE[q]
            ways.append((costs[to] + REROLE + extra, "R", audits[to]))
        cost, edit, rest = min(ways)[:3]
        found.append((cost, edit + rest))
    best = list(found)
    for _ in range(3):  # as many inserts in a row as can ever pay
        best = [min(found[q], (best[NEXT_STATE[q]][0] + INSERT, "I" + best[NEXT_STATE[q]][1]), key=lambda w: (w[0], w[1][:1])) for q in STATES]
    return tuple(min(c, NEVER) for c, _ in best), tuple(a for _, a in best)


def best_audits(units: DataFrame) -> DataFrame:
    """``units`` (.., ends boolean, after array<long>, word) with ``costs`` and ``audits``, of each state at the start.

    ``after`` are the costs to go behind the unit; ``ends`` says that the conversation ends there. Units are sorted by
    what follows them and by their words from the back, ties spread by ``spread``, so a task computes a node once and
    keeps no more nodes than the longest word has letters."""
    columns = [f for f in units.schema.fields if f.name != "spread"]
    names = [f.name for f in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind, seen, path = None, "", []
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for ends, after, word in zip(*(batch.column(c).to_pylist() for c in ("ends", "after", "word"))):
                back = word[::-1]
                if behind != (ends, after):
                    behind, seen = (ends, after), ""
                    path = [END if ends else (tuple(after), ("",) * 4)]
                same = 0
                while same < min(len(seen), len(back)) and seen[same] == back[same]:
                    same += 1
                del path[same + 1 :]
                for letter in back[same:]:
                    path.append(node(letter, *path[-1]))
                seen = back
                out[0].append(path[-1][0])
                out[1].append(path[-1][1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.string()))], names=[*names, "costs", "audits"])

    order = ["ends", "after", F.reverse("word")]
    dealt = units.repartitionByRange(shuffle_width(units.sparkSession), *order, "spread").sortWithinPartitions(*order).select(names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
    return dealt.mapInArrow(run, f"{schema}, costs array<bigint>, audits array<string>")


# ---------------------------------------------------------------- turns, faults and units


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def ordered(turns: DataFrame) -> DataFrame:
    """Stored: the turns in order, with their position (``pos``, unique), hashes and faults but for duplicates."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("h", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64("text", F.lit(1), "role")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", F.asc_nulls_first("turn"), "h", "h2", "row"]  # the row number splits equal rows between tasks
    rows = rows.repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order)
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    return write_table(
        rows.select("conv_id", "turn", "role", "text", "h", "h2", F.monotonically_increasing_id().alias("pos"), (~F.col("text").rlike(WORD)).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated")),
        "repair-turns",
    )


def units(rows: DataFrame) -> DataFrame:
    """Stored: (conv_id, unit, pos, faults, word) of the units of ``ordered`` turns; ``pos`` is the first turn's position.

    ``faults`` has a letter a turn: b blank, d duplicate, or the letter of its role's class as in ``word``."""
    firsts = rows.groupBy("conv_id", "h", "h2").agg(F.min("pos").alias("first")).select("first")
    slim = rows.select("conv_id", "pos", "role", "blank", "truncated").join(firsts, F.col("pos") == F.col("first"), "left")
    role = F.when(initial(F.col("role")).isin("s", "u", "a"), initial(F.col("role"))).otherwise("o")
    letter = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("truncated"), F.upper(role)).otherwise(role)
    held = slim.select("conv_id", F.shiftright("pos", UNIT_BITS).alias("unit"), F.struct("pos", letter.alias("letter")).alias("turn"))
    held = held.groupBy("conv_id", "unit").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    word = F.array_join(F.col("turns.letter"), "")
    return write_table(held.select("conv_id", "unit", F.col("turns.pos")[0].alias("pos"), word.alias("faults"), F.translate(word, "bd", "xx").alias("word")), "repair-units")


def chained(cut: DataFrame) -> DataFrame:
    """Units (conv_id, pos, faults, word) with ``ends`` and ``after``, the costs to go behind each (least one zero).

    Only conversations of several units take part; from the last unit on, one row a unit and end state passes by."""
    by = Window.partitionBy("conv_id").orderBy("unit")
    cut = cut.withColumn("ends", F.lead("unit").over(by).isNull()).withColumn("begins", F.lag("unit").over(by).isNull())
    none = F.array(*(F.lit(0).cast("long") for _ in STATES))
    cut = write_table(cut.withColumn("after", none).withColumn("spread", F.col("pos")), "repair-linked")
    whole = cut.filter("ends and begins").drop("begins")
    several = cut.filter("not ends or not begins")

    # the cost from each state at a unit's start to each at its end; the last unit's own costs to go are one row
    only = F.array(*(F.array(*(F.lit(0 if p == q else NEVER).cast("long") for p in STATES)) for q in STATES))
    asked = several.withColumn("after", F.explode(F.when(F.col("ends"), F.array("after")).otherwise(only)))
    known = best_audits(asked.select("conv_id", "unit", "ends", "after", "word", "spread")).select("conv_id", "unit", "ends", "costs", F.array_position("after", 0).alias("to"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, costs, before, seen = None, None, None, None  # ``costs`` are those behind the unit at hand
        for batch in batches:
            out: list[list] = [[], [], []]
            for conv, unit, ends, own, to in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "unit", "ends", "costs", "to"))):
                if ends:
                    here, costs, before, seen = conv, None, own, unit
                    continue
                if seen != unit:
                    costs = [c - min(before) for c in before]
                    before, seen = [NEVER] * 4, unit
                    out[0].append(here)
                    out[1].append(unit)
                    out[2].append(costs)
                before = [min(b, o + costs[to - 1]) for b, o in zip(before, own)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column("conv_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], names=["_conv", "_unit", "_after"])

    kind = dict(cut.dtypes)["conv_id"]
    backwards = known.repartition(shuffle_width(cut.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.desc("unit"), "to")
    behind = write_table(backwards.mapInArrow(back, f"_conv {kind}, _unit bigint, _after array<bigint>"), "repair-chain")
    several = several.join(behind, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("unit") == F.col("_unit")), "left")
    several = several.withColumn("after", F.coalesce("_after", "after")).select(whole.columns)
    return whole.unionByName(several)


# ---------------------------------------------------------------- the repaired turns


def repair(turns: DataFrame) -> DataFrame:
    """The edits of each conversation of ``turns`` (conv_id, turn, role, text), one row an edit, in order.

    Columns: conv_id, place (from 0), turn, role (null where inserted), fault ('', blank, duplicate or truncated), edit
    (K, R, D or I), new_role and new_text (null where deleted). Rows lie by conversation and place in each partition."""
    with stored_steps(turns.sparkSession):
        rows = ordered(turns)
        found = write_table(best_audits(chained(units(rows)).select("conv_id", "pos", "faults", "ends", "after", "word", "spread")), "repair-audits")
    none = F.lit(None)
    marks = found.select("conv_id", "pos", F.lit(0).alias("kind"), "faults", "audits", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    texts = rows.select("conv_id", "pos", F.lit(1).alias("kind"), none.cast("string").alias("faults"), none.cast("array<string>").alias("audits"), "turn", "role", "text")
    together = marks.unionByName(texts).repartition(shuffle_width(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    kind = dict(rows.dtypes)["conv_id"]
    return together.mapInArrow(edits, f"conv_id {kind}, place bigint, turn bigint, role string, fault string, edit string, new_role string, new_text string")


FAULT = {"b": "blank", "d": "duplicate"}


def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of sorted units and turns: a unit's audit in the state reached so far, applied turn by turn."""
    conv, state, place, audit, faults, at, row = None, 0, 0, "", "", 0, 0
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]

        def put(*values):
            nonlocal place
            for column, value in zip(out, (conv, place, *values)):
                column.append(value)
            place += 1

        def insert():
            nonlocal state, at
            while audit[at : at + 1] == "I":
                put(None, None, "", "I", NEXT_ROLE[state], "")
                state, at = NEXT_STATE[state], at + 1

        ids, kinds, words, audits, numbers, roles, texts = (batch.column(c) for c in ("conv_id", "kind", "faults", "audits", "turn", "role", "text"))
        for i in range(batch.num_rows):
            if kinds[i].as_py() == 0:
                insert()  # those behind the last turn of the unit before
                if not at or ids[i].as_py() != conv:
                    conv, state, place = ids[i].as_py(), 0, 0
                audit, faults, at, row = audits[i].as_py()[state], words[i].as_py(), 0, 0
                continue
            insert()
            edit, letter, role = audit[at], faults[row], roles[i].as_py()
            at, row = at + 1, row + 1
            fault = FAULT.get(letter, "truncated" if letter.isupper() else "")
            if edit == "D":
                put(numbers[i].as_py(), role, fault, "D", None, None)
            elif edit == "K":
                put(numbers[i].as_py(), role, fault, "K", role, texts[i].as_py())
                state = KEPT[letter.lower()][state]
            else:
                put(numbers[i].as_py(), role, fault, "R", NEXT_ROLE[state], texts[i].as_py())
                state = NEXT_STATE[state]
            if at < len(audit) and row == len(faults):
                insert()
        types = (batch.column("conv_id").type, pa.int64(), pa.int64(), *[pa.string()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["conv_id", "place", "turn", "role", "fault", "edit", "new_role", "new_text"])


# ---------------------------------------------------------------- the registered query

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LEGAL = {"su", "ua", "au"}
COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


class Summary:
    """Figures of one conversation, taken edit by edit."""

    def __init__(self, conv):
        self.conv, self.n = conv, dict.fromkeys(COUNTS, 0)
        self.turns, self.low, self.high, self.role, self.audit, self.hash, self.any = 0, None, None, None, [], hashlib.sha256(), False

    def add(self, turn, role, fault, edit, new_role, new_text):
        self.audit.append(edit)
        self.n["cost"] += COST[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if edit != "I":
            if fault:
                self.n[fault] += 1
            self.n["illegal"] += self.role is not None and self.role[:1] + role[:1] not in LEGAL
            self.role = role
            if turn is not None and turn != self.high:  # turns ascend
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if edit != "D":
            self.hash.update((("\n" if self.any else "") + f"{new_role}:{new_text}").encode())
            self.any = True

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *(self.n[c] for c in COUNTS[1:]), "".join(self.audit), self.hash.hexdigest())


def summaries(edited: DataFrame) -> DataFrame:
    """One row a conversation from the rows of ``repair`` as they lie: counts, cost, audit and a hash of the repaired turns."""
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = None, pa.int64()

        def batch_of(done):
            types = (kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*(s.row() for s in done)), types)], names=names)

        for batch in batches:
            done, kind = [], batch.column("conv_id").type
            ids = batch.column("conv_id").to_pylist()
            places = batch.column("place").to_pylist()
            rest = [batch.column(c) for c in ("turn", "role", "fault", "edit", "new_role", "new_text")]
            for i, (conv, place) in enumerate(zip(ids, places)):
                if place == 0:
                    if held:
                        done.append(held)
                    held = Summary(conv)
                held.add(*(c[i].as_py() for c in rest))
            if done:
                yield batch_of(done)
        if held:
            yield batch_of([held])

    kind = dict(edited.dtypes)["conv_id"]
    return edited.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string")


def damage_code(conv_id: Column, turn: Column) -> Column:
    one = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    return F.crc32(F.concat(one[0], F.lit(":"), one[1])) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns that a fixed rule drops (code 0), empties, strips of sentence ends, repeats or gives to the user."""
    code = damage_code(F.col("conv_id"), F.col("turn"))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    left = summaries(repair(damaged(told)))
    gone = told.groupBy("conv_id").agg(F.max(damage_code(F.col("conv_id"), F.col("turn"))).alias("most")).filter("most = 0")
    empty = hashlib.sha256().hexdigest()
    return left.unionByName(gone.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit("").alias("audit"), F.lit(empty).alias("repaired_sha256")))
