"""Cutting lineage and numbering rows without one large partition."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` saved in the folder of spark.checkpoint.dir, which executors share. Only a
    local session may go without the setting."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


class StaleStoreError(ValueError):
    """A store was made by another signature algorithm."""


def write_facts(spark: SparkSession, path: str, facts: dict) -> None:
    """One JSON row of facts about a store."""
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_facts(spark: SparkSession, path: str, form: str, expect_stamp: str | None = None) -> dict:
    """The facts of a store; another format, or another stamp than expected, is refused."""
    facts = json.loads(spark.read.text(path).first()[0])
    if facts.get("format") != form:
        raise ValueError(f"{path} has format {facts.get('format')}, not {form}")
    if expect_stamp is not None and facts["sig_stamp"] != expect_stamp:
        raise StaleStoreError(f"{path} has stamp {facts['sig_stamp']}, not {expect_stamp}")
    return facts


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session may go without."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return found.rstrip("/")


def dense_ids(df: DataFrame, order: list[str | Column], name: str = "payload_id") -> DataFrame:
    """``df`` with ids from 0 without gaps in ``order``: a range-partitioned sort, and one
    offset for each of its partitions."""
    kept = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = dict(kept.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), part.cast("int"))
    return kept.withColumn(name, start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
