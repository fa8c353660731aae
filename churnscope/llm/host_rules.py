"""Host-level quality rules (operator 9).

Each document gets base figures in one pass and fails by itself when it is too
short or mostly repeats itself. Every rule of ``RULES`` is counted by host on
its own (partial sums before the shuffle, so a hot host is one row per task).
A host's rate for a rule is shrunk towards the rate of all hosts by a beta
prior whose mean and strength are fitted, rule by rule, to the hosts' own rates
by the method of moments: a host with few documents stays near the common
rate, a large one near its own. The prior also gives the rule's limit, so many
of its standard deviations above its mean, within ``LIMITS``. A host that
reaches the limit of any rule is rejected, and the verdict is joined back to
the documents. ``source`` is the host here.

No limit is below a half: clean documents of an ordinary host stay, and only
hosts most of whose documents fail one rule lose the others.

Defined results: a null or empty text has no words and fails; a null host is a
host of its own; an only host, or hosts with equal rates, get the strongest
prior (``MAX_STRENGTH``), which rejects it where its rate reaches the limit;
repeated rows count each time; empty input gives an
empty result; other columns are ignored by ``features`` and kept by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm.bpe import slices
from churnscope.llm.common import drop_clashing, packed, read, released, unpacked, write_table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Symbols for 100 characters of words, and words for a repeated line, from which a document fails by these rules.
MAX_SYMBOL_PERCENT, WORDS_A_LINE = 10, 10
#: What is counted by host; the first two also fail the document itself.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars",
    "lines": f"{WORDS_A_LINE} * n_dup_lines > n_words",
}
#: A rule's limit lies so many standard deviations of its prior above the prior's mean, within these bounds.
DEVIATIONS, LIMITS = 3.0, (0.5, 0.9)
#: The upper bound.
HOST_LIMIT = LIMITS[1]
#: Bounds of the prior's strength, in documents.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPACES = b" \t\n\x0b\x0c\r"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
IS_VISIBLE = ~np.isin(np.arange(256), list(SPACES)) & (np.arange(256) & 0xC0 != 0x80)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that are found twice or more (numbered words, so the comparison is exact)."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def figures(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    seen: set[bytes] = set()
    n_dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            n_dup += line in seen
            seen.add(line)
    return len(words), int(IS_VISIBLE[raw].sum()), int(IS_SYMBOL[raw].sum()), n_dup, repeated_words(words)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the base figures and ``base_failed``."""
    docs = drop_clashing(docs, [*FIGURES, "base_failed"])
    kept = docs.drop(text)
    rows = docs.select(packed(kept), F.col(f"`{text}`").cast("binary").alias("_text"))
    out = T.StructType([rows.schema["_in"], *(T.StructField(c, T.LongType()) for c in FIGURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [figures(t or b"") for texts in slices(batch.column("_text")) for t in texts]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("_in"), *(pa.array(x, pa.int64()) for x in zip(*found))], names=[f.name for f in out])

    measured = rows.mapInArrow(released(run, "host rules"), out).select(*unpacked(kept), *FIGURES)
    return measured.withColumn("base_failed", F.expr(RULES["short"]) | F.expr(RULES["repeats"]))


def host_rates(measured: DataFrame, host: str = "source", rules: dict[str, str] | None = None) -> DataFrame:
    """Per host and rule: documents, failures, the shrunk failure rate and the rule's limit.

    ``rules`` names SQL conditions over the columns of ``measured``; by default the one of ``base_failed``."""
    rules = rules or {"base_failed": "base_failed"}
    counted = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.array(*(F.struct(F.lit(r).alias("rule"), F.sum(F.expr(c).cast("long")).alias("failed")) for r, c in rules.items())).alias("by_rule"))
    hosts = counted.select("host", "n", F.inline("by_rule")).withColumn("rate", F.col("failed") / F.col("n"))
    # moments over hosts, each host once: mean, variance, and the mean of 1/n for the part of it that chance makes
    prior = hosts.groupBy("rule").agg(F.avg("rate").alias("m"), F.var_pop("rate").alias("v"), F.avg(1 / F.col("n")).alias("inv"))
    spread = F.col("m") * (1 - F.col("m"))
    between = F.col("v") - spread * F.col("inv")
    strength = F.when(between > 0, spread / between - 1).otherwise(F.lit(MAX_STRENGTH))
    prior = prior.withColumn("strength", F.least(F.greatest(strength, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)))
    limit = F.col("m") + DEVIATIONS * F.sqrt(spread / (F.col("strength") + 1))
    prior = prior.select("rule", "m", "strength", F.least(F.greatest(limit, F.lit(LIMITS[0])), F.lit(LIMITS[1])).alias("host_limit"))
    # the prior is one row a rule
    return hosts.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", ((F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("shrunk_rate"), "host_limit")


def rejected_hosts(measured: DataFrame, host: str = "source", rules: dict[str, str] | None = None) -> DataFrame:
    """Stored: the hosts, as ``host``, that reach the limit of a rule.

    What joins them knows their size before it starts: documents are not dealt by host for a few verdicts, or none."""
    rejected = host_rates(measured, host, rules).filter(F.col("shrunk_rate") >= F.col("host_limit")).select("host").distinct()
    return write_table(rejected, "rejected-hosts")


def judge(measured: DataFrame, host: str = "source", rules: dict[str, str] | None = None) -> DataFrame:
    """``measured`` with ``kept``: false for failed documents and for documents of rejected hosts.

    The verdicts hold rejected hosts only and are joined as Spark sees fit (a hot host is never dealt by its name
    where the few verdicts are broadcast by their measured size; AQE splits it otherwise)."""
    rejected = rejected_hosts(measured, host, rules).select(F.col("host").alias("_host"), F.lit(True).alias("_rejected"))
    rows = drop_clashing(measured, ["kept"])
    joined = rows.select(packed(rows), F.col(f"`{host}`").alias("_of"), "base_failed").join(rejected, F.col("_of").eqNullSafe(F.col("_host")), "left")
    return joined.select(*unpacked(rows), (~F.col("base_failed") & F.col("_rejected").isNull()).alias("kept"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = write_table(features(docs), "host-figures")  # read twice: by host, and for the verdicts
    return judge(measured, rules=RULES).select("doc_id", *FIGURES, "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT doc_id, i, unnest(words[i:i+2]) AS part, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS tri
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)),
tri AS (SELECT DISTINCT doc_id, i, tri FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, sum(c - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM lines GROUP BY doc_id, line) GROUP BY doc_id),
f AS (SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats,
    100 * n_symbols > 10 * word_chars AS symbols, 10 * n_dup_lines > n_words AS lines FROM f),
e AS (SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule, unnest([short, repeats, symbols, lines]) AS failed FROM b),
h AS (SELECT source, rule, count(*) AS n, sum(failed::INT) AS failed, sum(failed::INT) / count(*)::DOUBLE AS rate FROM e GROUP BY source, rule),
p AS (SELECT rule, avg(rate) AS m, var_pop(rate) AS v, avg(1.0 / n::DOUBLE) AS inv FROM h GROUP BY rule),
s AS (SELECT rule, m, least(greatest(CASE WHEN v - m * (1 - m) * inv > 0 THEN m * (1 - m) / (v - m * (1 - m) * inv) - 1 ELSE 1000.0 END, 2.0), 1000.0) AS k FROM p),
r AS (SELECT DISTINCT source, TRUE AS rejected FROM h JOIN s USING (rule)
  WHERE (failed + m * k) / (n + k) >= least(greatest(m + 3 * sqrt(m * (1 - m) / (k + 1)), 0.5), 0.9))
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short OR repeats) AS base_failed, (NOT short AND NOT repeats AND rejected IS NULL) AS kept
FROM b LEFT JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
