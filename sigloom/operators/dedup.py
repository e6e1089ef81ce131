"""From observations of classes in versions to distinct entries with version ranges.

Observations: coord, version, hi, lo, fqcn, strings, instructions, seq. ``seq`` orders
observations as they were read; whatever is taken from a first observation goes by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import names
from sigloom.operators.storage import dense_ids

MIN_INSTRUCTIONS = 20


def current(obs: DataFrame, stamp: str) -> DataFrame:
    """Observations made with the signature algorithm of ``stamp``."""
    return obs.where(F.col("sig_stamp") == stamp)


def large_enough(obs: DataFrame, least: int = MIN_INSTRUCTIONS) -> DataFrame:
    return obs.where(F.col("instructions") >= least)


def counters(obs: DataFrame, least: int = MIN_INSTRUCTIONS) -> DataFrame:
    """One row: classes seen, below the floor, kept, distinct entries, observations an
    entry."""
    kept = F.col("instructions") >= least
    out = obs.agg(F.count("*").alias("classes_seen"), F.count_if(~kept).alias("below_min"), F.count_if(kept).alias("kept"))
    distinct = obs.where(kept).select("coord", "hi", "lo").distinct().agg(F.count("*").alias("entries"))
    # Both sides are one row.
    return out.join(F.broadcast(distinct)).withColumn("dedup_factor", F.coalesce(F.try_divide("kept", "entries"), F.lit(0.0)))


def dedup_by_signature(obs: DataFrame) -> DataFrame:
    """One row for each (coord, code): the first observation's fqcn, strings and
    instructions, all versions, and ``seq`` of the first."""
    first = F.min(F.struct("seq", "fqcn", "strings", "instructions")).alias("f")
    out = obs.groupBy("coord", "hi", "lo").agg(first, F.array_sort(F.collect_set("version")).alias("versions"))
    return out.select("coord", "hi", "lo", "f.fqcn", "f.strings", "f.instructions", "versions", "f.seq")


def version_order(obs: DataFrame) -> DataFrame:
    """(coord, version, pos) of all versions read, also of those with no class left; equal
    keys go by text."""
    order = Window.partitionBy("coord").orderBy(names.ver_key(F.col("version")), "version")
    return obs.select("coord", "version").distinct().withColumn("pos", F.row_number().over(order) - 1)


def compact_ranges(hits: DataFrame, order: DataFrame) -> DataFrame:
    """(entry, ranges) of hits (entry, coord, version): runs of consecutive positions as
    first..last, single ones bare, then versions that the order does not know, by text."""
    placed = hits.distinct().join(order, ["coord", "version"], "left")
    run = Window.partitionBy("entry").orderBy("pos")
    known = placed.where("pos is not null").withColumn("island", F.col("pos") - F.row_number().over(run))
    lo, hi = F.min_by("version", "pos"), F.max_by("version", "pos")
    islands = known.groupBy("entry", "island").agg(F.min("pos").alias("at"), F.when(F.min("pos") == F.max("pos"), lo).otherwise(F.concat(lo, F.lit(".."), hi)).alias("text"))
    strays = placed.where("pos is null").select("entry", F.lit(1).alias("stray"), F.lit(0).alias("at"), F.col("version").alias("text"))
    parts = islands.select("entry", F.lit(0).alias("stray"), "at", "text").unionByName(strays)
    ordered = F.array_sort(F.collect_list(F.struct("stray", "at", "text")))
    return parts.groupBy("entry").agg(F.transform(ordered, lambda x: x["text"]).alias("ranges"))


def assign_payload_ids(entries: DataFrame, order: DataFrame) -> DataFrame:
    """Entries with dense ``payload_id`` by first observation, and ``ranges``."""
    numbered = dense_ids(entries, ["seq", "coord", "hi", "lo"])
    hits = numbered.select(F.col("payload_id").alias("entry"), "coord", F.explode("versions").alias("version"))
    ranges = compact_ranges(hits, order)
    return numbered.join(ranges, F.col("payload_id") == F.col("entry"), "left").drop("entry", "seq")


def build(obs: DataFrame, stamp: str, least: int = MIN_INSTRUCTIONS) -> DataFrame:
    """The whole chain from stamped observations to numbered entries."""
    valid = current(obs, stamp)
    return assign_payload_ids(dedup_by_signature(large_enough(valid, least)), version_order(valid))
