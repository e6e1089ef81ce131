"""Which published versions to read, and which of them are still to be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import names


def latest_patches(versions: DataFrame, include_prerelease: bool = False) -> DataFrame:
    """Of (coord, version, pos) the highest version of each major.minor line, the first
    listed among equals."""
    key = names.ver_key(F.col("version"))
    rows = versions if include_prerelease else versions.where(~names.is_prerelease(F.col("version")))
    rows = rows.withColumns({"key": key, "major": F.get(key, F.lit(0)), "minor": F.coalesce(F.get(key, F.lit(1)), F.lit(0))})
    best = Window.partitionBy("coord", "major", "minor").orderBy(F.desc("key"), "pos")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("coord", "version", "key", "pos")


def sample_versions(versions: DataFrame, max_n: int = 8, include_prerelease: bool = False) -> DataFrame:
    """(coord, version, rank): the latest patches, oldest first; of more than ``max_n`` an
    even spread with both ends (half-way places to the even one)."""
    if max_n < 1:
        return latest_patches(versions, include_prerelease).where("false").select("coord", "version", F.lit(0).alias("rank"))
    order = Window.partitionBy("coord").orderBy("key", "major_minor")
    picked = latest_patches(versions, include_prerelease).withColumn("major_minor", F.slice("key", 1, 2))
    picked = picked.withColumns({"rank": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("coord"))})
    if max_n == 1:
        # With one place there is no spread: the oldest stands for the rest.
        return picked.where("rank = 0").select("coord", "version", "rank")
    places = F.transform(F.sequence(F.lit(0), F.lit(max_n - 1)), lambda i: F.rint(i * (F.col("n") - 1) / F.lit(max_n - 1.0)).cast("int"))
    return picked.where((F.col("n") <= max_n) | F.array_contains(places, F.col("rank"))).select("coord", "version", "rank")


def to_fetch(wanted: DataFrame, cached: DataFrame, stamp: str) -> DataFrame:
    """Wanted (coord, version[, digest]) without a usable cache row (coord, version,
    sig_stamp, digest): the stamp must be equal, and the digest where both are known."""
    valid = cached.where(F.col("sig_stamp") == stamp).select("coord", "version", F.col("digest").alias("_d"))
    same = (wanted.coord == valid.coord) & (wanted.version == valid.version)
    if "digest" in wanted.columns:
        same = same & (wanted.digest.isNull() | (wanted.digest == F.col("_d")))
    return wanted.join(valid, same, "left_anti")


def first_available(wanted: DataFrame, available: DataFrame, suffixes: tuple[str, ...] = ("", "-jvm", "-android"), packagings: tuple[str, ...] = ("aar", "jar")) -> DataFrame:
    """For each wanted (coord, version) the preferred of available (coord, version,
    packaging): the name as it is, then with the suffixes; of each, packagings in order.
    Nothing available: null, and an error text."""
    tries = [F.struct(F.lit(a * len(packagings) + b).alias("rank"), F.lit(s).alias("suffix"), F.lit(p).alias("packaging")) for a, s in enumerate(suffixes) for b, p in enumerate(packagings)]
    rows = wanted.withColumn("t", F.explode(F.array(*tries))).select(*wanted.columns, "t.*").withColumn("_c", F.concat("coord", "suffix"))
    there = available.select(F.col("coord").alias("_c"), "version", "packaging", F.lit(True).alias("_there"))
    best = rows.join(there, ["_c", "version", "packaging"], "left").groupBy("coord", "version").agg(F.min(F.when(F.col("_there"), F.struct("rank", "suffix", "packaging"))).alias("b"))
    return best.select("coord", "version", F.concat("coord", "b.suffix").alias("artifact"), "b.packaging", F.when(F.col("b").isNull(), "not found").otherwise("").alias("error"))


def scrape_plan(versions: DataFrame, cached: DataFrame, available: DataFrame, stamp: str, max_n: int = 8) -> DataFrame:
    """(coord, version, status, artifact, packaging, error) of the sampled versions: cached
    ones are reused, others fetched where something is available; what is not is an error
    of its row and of no other."""
    wanted = sample_versions(versions, max_n).select("coord", "version")
    missing = first_available(to_fetch(wanted, cached, stamp), available).withColumn("status", F.when(F.col("error") == "", "fetch").otherwise("failed"))
    reused = wanted.join(missing.select("coord", "version"), ["coord", "version"], "left_anti")
    none = F.lit(None).cast("string")
    reused = reused.select("coord", "version", none.alias("artifact"), none.alias("packaging"), F.lit("").alias("error"), F.lit("cached").alias("status"))
    return reused.unionByName(missing)


def fetch_counters(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error") == "").alias("ok"), F.count_if(F.col("error") != "").alias("failed"))
