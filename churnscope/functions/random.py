"""Portable pseudo-random uniforms from integer hashing.

The same arithmetic runs in Spark and in the SQL oracle, so simulated draws
are reproducible across engines and independent of partitioning or task
retries (a rerun task draws the same numbers). A 32-bit key per customer comes
from md5 of (id, seed) once per customer; the draw for simulation ``s`` mixes
key + s * golden-ratio constant with the 32-bit murmur3 finaliser. Products
are split in 16-bit halves so every intermediate stays below 2^63.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed constants of the murmur3 32-bit finaliser and the golden-ratio step.
GOLDEN = 0x9E3779B9
FMIX_1 = 0x85EBCA6B
FMIX_2 = 0xC2B2AE35
M32 = 1 << 32


def key32(*cols) -> Column:
    """32-bit key from md5 of the '|'-joined values."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                 for c in cols]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def _mulmod32(x: Column, m: int) -> Column:
    hi = F.shiftright(x, 16)
    lo = x.bitwiseAND(F.lit(0xFFFF))
    return F.pmod(F.pmod(hi * F.lit(m), F.lit(1 << 16)) * F.lit(1 << 16) + lo * F.lit(m), F.lit(M32))


def fmix32(x: Column) -> Column:
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = _mulmod32(x, FMIX_1)
    x = x.bitwiseXOR(F.shiftright(x, 13))
    x = _mulmod32(x, FMIX_2)
    return x.bitwiseXOR(F.shiftright(x, 16))


def uniform(key: Column, stream: Column) -> Column:
    """Uniform in [0, 1) for (key, stream index), as one expression (for a
    few draws per row; see ``with_uniform`` for the hot loop)."""
    x = F.pmod(key + stream.cast("bigint") * F.lit(GOLDEN), F.lit(M32))
    return fmix32(x).cast("double") / F.lit(float(M32))


def with_uniform(df: DataFrame, key: str, stream: str, out: str) -> DataFrame:
    """Add ``out`` = uniform(key, stream) through chained projections.

    Each step references the previous value twice; separate projections keep
    Catalyst from inlining it (it does not collapse projections when that
    would duplicate a non-trivial expression), so every intermediate is
    computed once per row.
    """
    t = "_u"
    df = df.withColumn(t, F.pmod(F.col(key) + F.col(stream).cast("bigint") * F.lit(GOLDEN), F.lit(M32)))
    df = df.withColumn(t, F.col(t).bitwiseXOR(F.shiftright(F.col(t), 16)))
    df = df.withColumn(t, _mulmod32(F.col(t), FMIX_1))
    df = df.withColumn(t, F.col(t).bitwiseXOR(F.shiftright(F.col(t), 13)))
    df = df.withColumn(t, _mulmod32(F.col(t), FMIX_2))
    df = df.withColumn(t, F.col(t).bitwiseXOR(F.shiftright(F.col(t), 16)))
    return df.withColumn(out, F.col(t).cast("double") / F.lit(float(M32))).drop(t)


# SQL text of the same functions, for the DuckDB oracles.

def sql_key32(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


def _sql_mulmod32(x: str, m: int) -> str:
    return f"((((({x}) >> 16) * {m}) % 65536) * 65536 + ((({x}) & 65535) * {m})) % {M32}"


def sql_uniform(key: str, stream: str) -> str:
    x = f"(({key}) + CAST({stream} AS BIGINT) * {GOLDEN}) % {M32}"
    x = f"xor({x}, ({x}) >> 16)"
    x = _sql_mulmod32(x, FMIX_1)
    x = f"xor({x}, ({x}) >> 13)"
    x = _sql_mulmod32(x, FMIX_2)
    x = f"xor({x}, ({x}) >> 16)"
    return f"(CAST({x} AS DOUBLE) / {float(M32)})"
