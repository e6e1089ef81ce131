"""The corpus pipeline: five stages, each written as Parquet and read again as the
next one's input. ``python -c`` use: ``run(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import decontaminate, language, mixing, sharding, simhash
from sigloom.llm.common import dropped, scratch, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Learned models and an edit distance over words decide here, which SQL cannot
#: express; tests/llm holds the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way goes when it is done, and its
    input when the next one's is there."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch() as kept:
            after = written(stage(spark, docs, sf_dir))
            kept.append(after)
        if k:
            dropped(docs)
        docs = after
    return docs
