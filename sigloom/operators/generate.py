"""Codes to try things with: uniform ones, and probes near them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lane(*parts: Column) -> Column:
    """64 bits of the md5 of the parts, as DuckDB and others can work them out as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 16), 16, -10).cast("long")


def below(n: int, *parts: Column) -> Column:
    """A number below n from 28 bits of the md5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 7), 16, 10).cast("long") % n).cast("int")


def uniform_codes(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(pid, hi, lo) of n codes, the same for the same seed."""
    lanes = [lane(F.col("id"), F.lit(seed), F.lit(k)).alias(c) for k, c in enumerate(("hi", "lo"))]
    return spark.range(n).select(F.col("id").alias("pid"), *lanes)


def _with_bits(hi: Column, lo: Column, n: Column, bits: list[Column]) -> tuple[Column, Column]:
    """Codes with the first n of the bits flipped."""
    none = F.lit(0).cast("long")
    for k, bit in enumerate(bits):
        mask = F.when(n > k, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)))).otherwise(none)
        hi = hi.bitwiseXOR(F.when(bit >= 64, mask).otherwise(none))
        lo = lo.bitwiseXOR(F.when(bit < 64, mask).otherwise(none))
    return hi, lo


def flipped(hi: Column, lo: Column, seed: Column, most: int) -> tuple[Column, Column]:
    """Codes with up to ``most`` random bits flipped; a bit drawn twice flips back."""
    return _with_bits(hi, lo, below(most + 1, seed, F.lit("n")), [below(128, seed, F.lit(k)) for k in range(most)])


def flipped_apart(hi: Column, lo: Column, seed: Column, n: int) -> tuple[Column, Column]:
    """Codes exactly ``n`` bits away: an odd step from a random bit meets no bit twice."""
    first, step = below(128, seed, F.lit("first")), below(64, seed, F.lit("step")) * 2 + 1
    return _with_bits(hi, lo, F.lit(n), [(first + step * k) % 128 for k in range(n)])


def probe_mix(codes: DataFrame, n_codes: int, n: int, most: int, seed: int = 1, planted: int = 30) -> DataFrame:
    """(qid, hi, lo) of n probes; ``planted`` in a hundred lie within ``most`` flips of a
    code, the others are uniform."""
    rows = codes.sparkSession.range(n).select(F.col("id").alias("qid"), below(n_codes, F.col("id"), F.lit(seed), F.lit("of")).cast("long").alias("pid"), (below(100, F.col("id"), F.lit(seed), F.lit("kind")) < planted).alias("near"))
    rows = rows.join(codes, "pid")
    hi, lo = flipped(F.col("hi"), F.col("lo"), F.col("qid"), most)
    other = [lane(F.col("qid"), F.lit(seed), F.lit(f"miss{k}")) for k in (0, 1)]
    return rows.select("qid", F.when(F.col("near"), hi).otherwise(other[0]).alias("hi"), F.when(F.col("near"), lo).otherwise(other[1]).alias("lo"))
