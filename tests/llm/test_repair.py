"""Repairs against a search over all edit scripts and a plain run of the registered query's rules."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from churnscope.llm import repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain_search(rows):
    """Least (cost, audit) and repaired turns by Dijkstra over (turns read, state); rows are (role, text, fault)."""
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, q, out = heapq.heappop(queue)
        if i == len(rows) and q in (0, 3):
            return cost, audit, list(out)
        if (i, q) in done:
            continue
        done.add((i, q))
        to = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}[q]
        heapq.heappush(queue, (cost + 5, audit + "I", i, to[1], (*out, f"{to[0]}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            more = 5 if fault == "truncated" else 0
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, q, out))
            if fault not in ("blank", "duplicate"):
                heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, to[1], (*out, f"{to[0]}:{text}")))
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                if kept is not None:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, kept, (*out, f"{role}:{text}")))


def every_script(rows, most=2):
    """All audits with up to ``most`` inserts in a row, by exhaustion: least (cost, audit)."""
    best = None
    inserts = ["I" * k for k in range(most + 1)]
    for letters in itertools.product("DKR", repeat=len(rows)):
        for fill in itertools.product(inserts, repeat=len(rows) + 1):
            audit = "".join(f + x for f, x in zip(fill, (*letters, "")))
            cost, out, i = 0, [], 0
            for x in audit:
                if x == "I":
                    cost += 5
                    out.append("a" if out and out[-1] == "u" else "u")
                    continue
                role, text, fault = rows[i]
                i += 1
                if x == "D":
                    cost += 2
                    continue
                if fault in ("blank", "duplicate"):
                    break
                cost += (x == "R") + (5 if fault == "truncated" else 0)
                out.append(role[:1] if x == "K" else "a" if out and out[-1] == "u" else "u")
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(out)) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def faults(rows):
    """(role, text, fault) of (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        mark = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "truncated" if mark[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_query(conversations):
    out = {}
    for conv, turn, role, text in conversations:
        held = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        held += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    rows = []
    for conv, held in out.items():
        held = sorted(held, key=lambda r: (r[0] is not None, r[0] or 0))
        told = faults(held)
        cost, audit, repaired = plain_search(told)
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(told, told[1:]))
        n = [sum(f == kind for _, _, f in told) for kind in ("blank", "duplicate", "truncated")]
        rows.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(rows, key=str)


def some(r, conv, n, known=("system", "user", "assistant", "tool")):
    texts = ["Yes.", "No!", "", " \t", "cut off", "Why?", "a\n", "long " * 300 + "end."]
    return [(conv, t + (t > n // 2) * r.randrange(3), r.choice(known), r.choice(texts) + (str(r.randrange(9)) + "." if r.random() < 0.5 else "")) for t in range(n)]


def rows_of(df):
    return sorted([tuple(x) for x in df.select("conv_id", *repair.COUNTS, "audit", "repaired_sha256").collect()], key=str)


def distinct_turns(rows):
    return list({(c, t): (c, t, x, y) for c, t, x, y in rows}.values())


def test_search_agrees_with_every_script():
    r = random.Random(0)
    for _ in range(150):
        rows = [(r.choice(["system", "user", "assistant", "tool"]), "x", r.choice(["", "", "truncated", "blank"])) for _ in range(r.randrange(4))]
        assert plain_search(rows)[:2] == every_script(rows)


@pytest.mark.parametrize("bits", [1, 9])
def test_query_against_plain_search(spark, tmp_path, monkeypatch, bits):
    """Also with units of two turns, so that conversations are chained of many units."""
    monkeypatch.setattr(repair, "UNIT_BITS", bits)
    r = random.Random(bits)
    rows = [x for c in range(60) for x in some(r, c, r.randrange(9))] + some(r, 100, 90) + some(r, None, 12)
    rows = distinct_turns(rows) + [(200, 0, None, None), (201, None, "user", "Hi."), (202, 3, "assistant", None), (203, 7, None, "a.")]
    gone = next(c for c in range(300, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hi."))
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, pos string, unit int")
    df.repartition(3).write.parquet(str(tmp_path / "c" / "conversations.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "e" / "conversations.parquet"))
    got = rows_of(repair.op12_repair(spark, str(tmp_path / "c")))
    assert got == plain_query(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got
    assert repair.op12_repair(spark, str(tmp_path / "e")).count() == 0


def test_repeated_rows_and_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "user", "Hello!"), (2, 0, "assistant", "Sure."), (3, 5, "user", " ")]
    out = [tuple(x) for x in repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(x for x in out if x[0] == 1) == [(1, 0, 0, "user", "", "K", "user", "Hi."), (1, 1, 0, "user", "duplicate", "D", None, None), (1, 2, 1, "user", "", "R", "assistant", "Hello!")]
    assert [x[5] for x in out if x[0] == 2] == ["D"] and [x[4:6] for x in out if x[0] == 3] == [("blank", "D")]


def test_one_conversation_holds_a_third_of_all_turns(spark):
    """Units of a hot conversation lie over several tasks before its digest."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(6000)] + [(c, t, "user" if t % 2 == 0 else "assistant", "Same.") for c in range(2, 1002) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    placed = repair.ordered(df).selectExpr("conv_id", "shiftright(pos, 33) task").groupBy("task").count().collect()
    assert len(placed) >= 6 and max(x["count"] for x in placed) < 6000
    got = {x["conv_id"]: x for x in repair.summaries(repair.repair(df)).collect()}
    assert got[1]["audit"] == "K" * 6000 and got[1]["cost"] == 0 and got[2]["duplicate"] == 4 and len(got) == 1001
