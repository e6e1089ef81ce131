"""Rare shared strings as evidence, weighted by inverse document frequency.

The weight of a string in df of n entries is ln((n + 1) / df) / ln(n + 1): 1 if one entry
has it. Scores add up by df first (count times weight), so that their last bits do not
hang on the order of rows at the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_LENGTH, MAX_FREQUENCY, MIN_SCORE = 4, 8, 1.0
#: Decimal digits, and the other characters that count as digits (superscripts and the
#: like are of category No; not all of that category are digits).
_DIGITS = "\\A[\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]+\\z"


def is_useful(s: Column) -> Column:
    return (F.length(s) >= MIN_LENGTH) & ~F.rlike(s, F.lit(_DIGITS))


def useful_strings(strings: Column) -> Column:
    return F.array_distinct(F.filter(strings, is_useful))


def _exploded(rows: DataFrame, key: str) -> DataFrame:
    """(key, string), once each, of strings long enough. Whether they are digits is only
    asked of rare ones, see ``AnchorIndex``."""
    return rows.select(key, F.explode(F.array_distinct("strings")).alias("string")).where(F.length("string") >= MIN_LENGTH)


def _idf(df: Column) -> Column:
    """The weight of a string that df of n entries have, n from the one row of a count."""
    return F.ln((F.col("n") + F.lit(1.0)) / df) / F.when(F.col("n") > 0, F.ln(F.col("n") + F.lit(1.0))).otherwise(1.0)


class AnchorIndex:
    """Postings (string, pid, df, idf) of entries (pid, strings)."""

    def __init__(self, entries: DataFrame, max_frequency: int = MAX_FREQUENCY):
        self.max_frequency = max_frequency
        self.total = entries.agg(F.count("*").alias("n"))
        # Of a string one place more than allowed is enough to know that it is too common:
        # the limit is applied before rows are shuffled, so frequent strings never meet.
        first = Window.partitionBy("string").orderBy("pid")
        few = _exploded(entries, "pid").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_frequency + 1)
        rare = few.withColumn("df", F.count("*").over(Window.partitionBy("string"))).where((F.col("df") <= max_frequency) & is_useful(F.col("string")))
        self._rare = rare.select("string", "pid", "df")
        self.postings = rare.join(F.broadcast(self.total)).withColumn("idf", _idf(F.col("df"))).select("string", "pid", "df", "idf")
        self.strings = self.postings.dropDuplicates(["string"]).drop("pid")

    def size(self) -> int:
        return self.strings.count()

    def query(self, probes: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
        """(qid, pid, score) of probes (qid, strings) that share enough."""
        # Dealt out by qid once, for the sums here and the best of each.
        shared = _exploded(probes, "qid").join(self._rare, "string").select("qid", "pid", "df").repartition("qid")
        by_df = shared.groupBy("qid", "pid").agg(*[F.count_if(F.col("df") == k).alias(f"_{k}") for k in range(1, self.max_frequency + 1)])
        score = F.lit(0.0)
        for k in range(1, self.max_frequency + 1):
            score = score + F.col(f"_{k}") * _idf(F.lit(k))
        return by_df.join(F.broadcast(self.total)).select("qid", "pid", score.alias("score")).where(F.round("score", 12) >= min_score)

    def best(self, probes: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
        """Of each qid the hit with the highest score, the least pid among equals."""
        ranked = self.query(probes, min_score).groupBy("qid").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), "pid", "score")).alias("b"))
        return ranked.select("qid", "b.pid", "b.score")
