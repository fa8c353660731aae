"""Quotation linking against a plain walk over every conversation, with a common line, long reply chains and copies."""
import random
import re
from collections import Counter, defaultdict

import pytest

from churnscope.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"
FIRST = -(1 << 62)  # a null turn comes before all others


def squeeze(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()


def taken_apart(text):
    """(level, line) of every line, and (level, normal lines) of every passage."""
    parts, runs, kind = [], [], None
    for raw in text.split("\n"):
        mark = re.match(r"[ \t]*(>[ \t]*)+", raw)
        level = mark[0].count(">") if mark else 0
        line = raw[mark.end():] if mark else raw
        parts.append((level, line))
        now = level if squeeze(line) else -1
        if now != kind and now >= 0:
            runs.append((level, []))
        if now >= 0:
            runs[-1][1].append(squeeze(line))
        kind = now
    return parts, runs


def plain(rows):
    """Counter of result rows, by comparing each passage with each earlier message."""
    convs, out = defaultdict(list), Counter()
    for conv, turn, role, text in rows:
        convs[conv].append((FIRST if turn is None else turn, role, text))
    for conv, messages in convs.items():
        own = []
        for turn, _, text in set(messages):
            blocks = [n for level, n in (taken_apart(text)[1] if text is not None else []) if level == 0]
            units = {" ".join(b) for b in blocks} | {n for b in blocks for n in b} | ({" ".join(n for b in blocks for n in b)} if blocks else set())
            own.append((turn, units))
        seen, reply = {}, {}
        for turn, role, text in set(messages):
            parts, runs = taken_apart(text) if text is not None else ([], [])
            if not any(level for level, _ in parts):
                seen[turn, role, text] = (text, 0, 0, 0, None)
                continue
            linked, quoted = [], [(level, n) for level, n in runs if level]
            for level, n in quoted:
                for unit in [" ".join(n), *n]:
                    holders = [t for t, units in own if t < turn and unit in units]
                    if holders:
                        linked.append((level, -max(holders)))
                        break
            to = -min(linked)[1] if linked else None
            seen[turn, role, text] = ("\n".join(line for level, line in parts if not level), len(quoted), len(linked), max((q[0] for q in quoted), default=0), to)
            if to is not None:
                reply[turn] = max(to, reply.get(turn, to))

        def root(turn):
            while turn in reply:
                turn = reply[turn]
            return turn

        key = lambda m: (root(m[0]), m[0], m[1] is not None, m[1] or "", seen[m][0] is not None, (seen[m][0] or "").encode())
        blank = lambda t: None if t == FIRST else t
        for place, m in enumerate(sorted(messages, key=key)):
            text, n, found, deepest, to = seen[m]
            out[conv, blank(m[0]), m[1], text, n, found, deepest, blank(to), blank(root(m[0])), place] += 1
    return out


def made_up():
    """Nested quotes, one line that most messages hold, a chain of replies, several messages a turn, copies and nulls."""
    rnd = random.Random(5)
    rows = []
    for conv, length in ((1, 60), (2, 9), (3, 1), (None, 12)):
        texts = []
        for turn in range(length):
            lines = [f"line {conv} {rnd.randrange(length)}", "Best   regards"] if rnd.random() < 0.8 else [f"only {turn}", "", "second block"]
            if texts and rnd.random() < 0.7:
                quoted = (texts[-1] if rnd.random() < 0.6 else rnd.choice(texts)).split("\n")
                lines = ["> " + q for q in quoted] + lines + ([">  BEST regards", "tail"] if rnd.random() < 0.3 else [])
            texts.append("\n".join(lines))
            rows.append((conv, turn, rnd.choice(["user", "assistant"]), texts[-1]))
    rows += [rows[5]] * 9 + [(1, 3, "user", "same turn\n> best regards"), (1, 3, None, "no role"), (1, None, "user", "Best regards"), (2, None, "user", None), (2, 4, "user", ""), (2, 5, "user", "> "), (4, 0, "user", "> > nobody")]
    return rows


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_links_and_places_as_plain(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(quotes, "BLOCK", block)
    rows = made_up()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = quotes.op1_quotes(spark, str(tmp_path)).collect()
    want = plain(rows)
    assert sum(k[5] for k in want.elements()) > 40 and len({k[8] for k in want}) < len({k[:2] for k in want})
    assert Counter(tuple(r) for r in got) == want


def test_one_chain_is_many_tasks(spark):
    """A conversation that is one chain of replies, and one turn of it that is a third of all rows, spread over ranges."""
    chain = [(1, t, "user", f"> word {t - 1}\nword {t}\nregards") for t in range(600)] + [(1, 7, "user", f"aside {k}") for k in range(300)]
    out = quotes.link_quotes(spark.createDataFrame(chain, SCHEMA)).cache()
    assert {r["thread"] for r in out.select("thread").distinct().collect()} == {0}
    assert sorted(r["place"] for r in out.collect()) == list(range(900))
    rows = spark.createDataFrame(chain, SCHEMA).selectExpr("conv_id AS conv", "0L AS thread", "turn", "role", "text", "1L AS copies")
    sizes = [r["count"] for r in quotes.placed(rows).groupBy("part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 300
    out.unpersist()
