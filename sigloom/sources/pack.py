"""Packs: entries, payload metadata and build facts as three Parquet tables in a folder.

The stamp of the signature algorithm goes with a pack; reading one under another stamp
is refused, since distances between codes of two algorithms mean nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.storage import StaleStoreError

FORMAT = 1


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def write_pack(path: str, entries: DataFrame, payloads: DataFrame | None, stamp: str, meta: dict | None = None) -> None:
    """entries: (payload_id, hi, lo, strings), ids 0 to n - 1; payloads: (payload_id, coord,
    ranges, fqcn)."""
    spark = entries.sparkSession
    low, high, distinct, n = entries.agg(F.min("payload_id"), F.max("payload_id"), F.count_distinct("payload_id"), F.count("*")).first()
    if n and (low != 0 or high != n - 1 or distinct != n):
        raise ValueError("payload ids must be 0 to n - 1, each once")
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    if payloads is not None:
        payloads.withColumn("sig_stamp", F.lit(stamp)).write.mode("overwrite").parquet(f"{path}/payloads")
    facts = {"built": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")} | (meta or {})
    schema = "format int, sig_stamp string, n_entries long, coords array<string>, versions long, classes_seen long, classes_below_min_instr long, min_instr long, built string"
    row = (FORMAT, stamp, n, *[facts.get(k) for k in ("coords", "versions", "classes_seen", "classes_below_min_instr", "min_instr", "built")])
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    """The one row of facts; empty without one."""
    if not exists(spark, f"{path}/meta"):
        return {}
    return spark.read.parquet(f"{path}/meta").first().asDict()


def read_pack(spark: SparkSession, path: str, expect_stamp: str | None = None) -> tuple[DataFrame, DataFrame | None, str]:
    """Entries, payloads (None if the pack has none) and the stamp."""
    meta = read_meta(spark, path)
    if not meta or meta["format"] != FORMAT:
        raise ValueError(f"{path} is not a pack of format {FORMAT}")
    if expect_stamp is not None and meta["sig_stamp"] != expect_stamp:
        raise StaleStoreError(f"{path} has stamp {meta['sig_stamp']}, not {expect_stamp}")
    entries = spark.read.parquet(f"{path}/entries")
    payloads = spark.read.parquet(f"{path}/payloads") if exists(spark, f"{path}/payloads") else None
    if payloads is not None:
        # Payloads of another build may be as many: their stamp must agree as well.
        stamp = F.col("sig_stamp") if "sig_stamp" in payloads.columns else F.lit(None)
        n, same = payloads.agg(F.count("*"), F.count_if(stamp == meta["sig_stamp"])).first()
        if n != meta["n_entries"] or same != n:
            raise ValueError(f"{path}: payloads are not those of the entries")
        payloads = payloads.drop("sig_stamp")
    return entries, payloads, meta["sig_stamp"]


def describe_pack(spark: SparkSession, path: str) -> dict:
    """Ten facts, from the meta table and the file listing alone; entries are not read."""
    meta = read_meta(spark, path)
    if not meta:
        raise FileNotFoundError(f"{path}: no pack metadata")
    fs, p = _fs(spark, path)
    built, source = meta.get("built"), "meta"
    if not built:
        changed = fs.getFileStatus(p).getModificationTime() / 1000
        built, source = dt.datetime.fromtimestamp(changed, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "mtime"
    return {
        "path": path,
        "sidecar": f"{path}/payloads",
        "n_entries": meta["n_entries"],
        "coords": None if meta["coords"] is None else len(meta["coords"]),
        "versions": meta["versions"],
        "classes_seen": meta["classes_seen"],
        "min_instr": meta["min_instr"],
        "built": built,
        "built_from": source,
        "size_bytes": fs.getContentSummary(p).getLength(),
    }
