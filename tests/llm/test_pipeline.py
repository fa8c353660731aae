"""The pipeline's stages against plain Python."""

from collections import Counter

import corpus_pipeline
from churnscope.llm import jaccard_join
from tests.llm.conftest import DOCS


def edited(n: int, at: range, name: str) -> str:
    """A text of ``n`` distinct words, those at the given places changed."""
    return " ".join(f"{name}x{k}" if k in at else f"{name}{k}" for k in range(n))


def test_near_duplicates_take_five_words_and_80_percent(spark):
    """320 words, 7 far edits: 281 of 351 shingles of five words (0.8006), 289 of 345 of four (0.838); 8 edits: 276 of 356 (0.775)."""
    texts = {1: edited(320, range(0), "a"), 2: edited(320, range(20, 300, 40), "a"), 3: edited(320, range(0), "b"), 4: edited(320, range(10, 300, 37), "b")}
    # a block of 60 words added to 260: 256 of 316 (0.8101), and 0.8107 of four words; 70 to 260: 256 of 326 (0.785)
    texts |= {5: edited(260, range(0), "c"), 6: edited(320, range(0), "c"), 7: edited(260, range(0), "d"), 8: edited(330, range(0), "d")}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], DOCS)
    assert len(range(20, 300, 40)) == 7 and len(range(10, 300, 37)) == 8
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3, 4, 5, 7, 8}
    assert all(r["doc_id"] == r["component_id"] for r in jaccard_join.link_classes(docs).collect())  # op4 keeps four words and 85 percent


def test_near_duplicates_with_repeated_and_null_ids(spark):
    one, two = edited(80, range(0), "e"), edited(80, range(0), "f")
    rows = [
        (1, one), (1, two), (1, two), (2, one), (2, edited(80, range(0), "g")),  # one id, unlike texts; 2's first text is a copy of 1's
        (None, edited(200, range(0), "h")), (None, edited(200, range(100, 101), "h")), (None, two), (9, edited(200, range(50, 51), "h")),
        (None, edited(90, range(0), "i")), (None, edited(90, range(40, 41), "i")), (None, edited(90, range(0), "i")),
        (5, ""), (5, ""), (6, None), (None, " \t"), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    unnamed = [k for k in got if k[0] is None and k[1] and k[1].startswith("i")]
    assert len(unnamed) == 1 and unnamed[0] in rows
    assert got == Counter([(1, one), (1, two), rows[4], rows[8], unnamed[0], *rows[12:]])


def dealt(plan) -> int:
    """Rows with texts that the exchanges of an executed plan have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return dealt(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return dealt(plan.plan())
    own = kind == "ShuffleExchangeExec" and "text#" in plan.output().mkString(" ")
    return own * (plan.metrics().apply("shuffleRecordsWritten").value() if own else 0) + sum(dealt(plan.children().apply(k)) for k in range(plan.children().size()))


def test_near_duplicates_deal_only_rows_that_may_go(spark):
    rows = [(i, edited(60, range(0), f"t{i}_")) for i in range(400)] + [(400 + i, edited(60, range(0), f"t{i}_")) for i in range(10)]
    rows += [(20, rows[20][1]), (None, rows[30][1])]  # a row twice, and a copy without an id
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        got = kept.collect()
        moved = dealt(kept._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set(limit, before)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows[:400])
    assert 12 <= moved <= 100  # ten copies, the row that is there twice, the copy without an id, and what the bits can't tell apart
