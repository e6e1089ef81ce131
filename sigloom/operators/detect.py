"""Labels for unknown classes: exact code, code within a radius, shared rare strings, in
that order; and the libraries that a set of labels speaks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import names
from sigloom.operators import anchors, hamming
from sigloom.operators.storage import checkpointed

RADIUS, MIN_INSTRUCTIONS, MIN_CLASSES = 4, 20, 5


class Detector:
    """Entries (payload_id, hi, lo, strings), and optional metadata (payload_id, coord,
    ranges, fqcn). Strings may lie in a table of their own (payload_id, strings), which need
    not be joined to the codes then."""

    def __init__(self, entries: DataFrame, payloads: DataFrame | None = None, radius: int = RADIUS, strings: DataFrame | None = None):
        self.entries = entries.withColumnRenamed("payload_id", "pid")
        self.payloads, self.radius = payloads, radius
        texts = self.entries if strings is None else strings.withColumnRenamed("payload_id", "pid")
        self.index = anchors.AnchorIndex(texts.select("pid", "strings"))

    @classmethod
    def build(cls, entries: DataFrame, radius: int = RADIUS) -> Detector:
        return cls(entries, None, radius)

    @classmethod
    def from_pack(cls, spark: SparkSession, path: str, radius: int = RADIUS, expect_stamp: str | None = None) -> Detector:
        from sigloom.sources import pack

        entries, payloads, _ = pack.read_pack(spark, path, expect_stamp)
        return cls(entries, payloads, radius)

    def detect(self, app: DataFrame, strings: DataFrame | None = None) -> DataFrame:
        """(qid, payload_id, tier, distance, score) of app classes (qid, hi, lo, strings),
        or without strings, which lie in a table of their own (qid, strings) then; a class
        without a hit has nulls. Strings only speak where no code is near."""
        # Asked for twice below, so the join's slim result is written once.
        by_code = checkpointed(hamming.best_join(app.select("qid", "hi", "lo"), self.entries.select("pid", "hi", "lo"), self.radius))
        tier = F.when(F.col("distance") == 0, 1).otherwise(2)
        near = by_code.select("qid", F.col("pid").alias("payload_id"), tier.alias("tier"), F.col("distance").cast("int"), F.lit(1.0).alias("score"))
        # Slim hits are joined to codes, and not the strings that lead to them.
        best = self.index.best((app if strings is None else strings).select("qid", "strings")).join(near.select("qid"), "qid", "left_anti")
        shared = best.select("qid", F.col("pid").alias("payload_id"), F.lit(3).alias("tier"), F.lit(-1).alias("distance"), "score")
        return app.select("qid").join(near.unionByName(shared), "qid", "left")

    def resolve(self, detections: DataFrame) -> DataFrame:
        """Detections with coord, ranges and fqcn (null without metadata)."""
        if self.payloads is None:
            none = {"coord": F.lit(None).cast("string"), "ranges": F.lit(None).cast("array<string>"), "fqcn": F.lit(None).cast("string")}
            return detections.withColumns(none)
        return detections.join(self.payloads.select("payload_id", "coord", "ranges", "fqcn"), "payload_id", "left")

    def label(self, detections: DataFrame) -> DataFrame:
        """Detections with a label; null where nothing was found."""
        named = names.range_label(F.col("coord"), F.col("ranges"), F.col("payload_id"))
        return self.resolve(detections).withColumn("label", F.when(F.col("payload_id").isNotNull(), named))


def probes(app: DataFrame, least: int = MIN_INSTRUCTIONS) -> DataFrame:
    """App classes that can be looked up: with a code, and not trivial."""
    return app.where(F.col("hi").isNotNull() & (F.col("instructions") >= least))


def library_report(resolved: DataFrame, least: int = MIN_CLASSES) -> DataFrame:
    """(coord, classes, exact, near, by_string) of libraries with enough classes, most
    first, then by name."""
    tiers = [F.count_if(F.col("tier") == k).alias(n) for k, n in ((1, "exact"), (2, "near"), (3, "by_string"))]
    out = resolved.where("coord is not null").groupBy("coord").agg(F.count("*").alias("classes"), *tiers)
    return out.where(F.col("classes") >= least).orderBy(F.desc("classes"), "coord")
