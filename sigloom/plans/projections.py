"""Stand-ins for a corpus of classes, from the test tables, in Spark and in SQL.

DOC: each document is a class: code = SimHash of its distinct words of at least four
characters (bits of their md5 sums), coord = source, strings = those words. Even ids are
the library, odd ones the app. OBS: parts are classes, brands libraries, months of
shipping versions. EMB: signs of embeddings, where no two codes are near.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # Python's own takes half as long for a word as that of OpenSSL.
    from _md5 import md5
except ImportError:
    from hashlib import md5

WORD = 4
_held: dict[tuple[str, str, str], tuple[tuple[int, int], DataFrame]] = {}


def held(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` cached once a session: many queries share these slim tables. Made anew
    when the documents have changed; ``release`` frees them all."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = (fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength())
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _held and _held[key][0] != state:
        _held.pop(key)[1].unpersist()
    if key not in _held:
        _held[key] = state, make().persist()
        # At once: scans of one query, which start together, would each work it out.
        _held[key][1].count()
    return _held[key][1]


def release() -> None:
    while _held:
        _held.popitem()[1][1].unpersist()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, coord, n_words, hi, lo). Two counters of 32 bits share a long, so 64 sums
    count 128 bits; words are counted within a document before anything is grouped."""

    def make() -> DataFrame:
        counters = [f"{n}{k}" for n in ("a", "b") for k in range(32)]
        rows = documents(spark, sf_dir).select("doc_id", F.col("source").alias("coord"), F.make_valid_utf8("text").alias("text"))
        schema = T.StructType([*rows.schema.fields[:2], *[T.StructField(n, T.LongType()) for n in ("n_words", *counters)]])
        # Documents whose id and source repeat count as one, so sums and not bits are grouped.
        counted = rows.where("text is not null").mapInArrow(_counts(counters), schema).groupBy("doc_id", "coord").agg(*[F.sum(n).alias(n) for n in ("n_words", *counters)])

        def lane(n: str) -> Column:
            out = F.lit(0).cast("long")
            for k in range(32):
                for count, bit in ((F.col(f"{n}{k}").bitwiseAND(F.lit((1 << 32) - 1)), k), (F.shiftrightunsigned(f"{n}{k}", 32), k + 32)):
                    value = (1 << bit) - (1 << 64 if bit == 63 else 0)
                    out = out.bitwiseOR(F.when(count * 2 > F.col("n_words"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
            return out

        return counted.select("doc_id", "coord", "n_words", lane("a").alias("hi"), lane("b").alias("lo"))

    return held(spark, sf_dir, "codes", make)


def _counts(counters: list[str]):
    """From (doc_id, coord, text) to how many of a document's words set each bit."""
    known_words = 1 << 17

    class Digests(dict):
        """md5 sums of words; the first ones are kept, among which are those that recur."""

        def __missing__(self, word: str) -> bytes:
            out = md5(word.encode()).digest()
            if len(self) < known_words:
                self[word] = out
            return out

    def count(batches):
        digest = Digests().__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, sums = np.zeros(part.num_rows, np.int64), np.zeros((part.num_rows, 128), np.int64)
                for i, text in enumerate(part.column(2)):
                    words = [w for w in set(text.as_py().replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")) if len(w) >= WORD]
                    if words:
                        bits = np.unpackbits(np.frombuffer(b"".join(map(digest, words)), np.uint8).reshape(-1, 16), axis=1)
                        # A byte holds the sum of 255 rows.
                        for k in range(0, len(words), 255):
                            sums[i] += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
                        n[i] = len(words)
                some = np.flatnonzero(n)
                # Bits come highest first: columns 63 .. 0 are bits 0 .. 63 of hi.
                lanes = [sums[some, 64 * side : 64 * side + 64][:, ::-1] for side in (0, 1)]
                packed = [lane[:, k] | lane[:, k + 32] << 32 for lane in lanes for k in range(32)]
                kept = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *map(pa.array, (n[some], *packed))], ["doc_id", "coord", "n_words", *counters])

    return count


def doc_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, strings): all words, as often as they occur; the index of strings leaves
    out short ones and repeats."""
    return documents(spark, sf_dir).select("doc_id", F.split("text", "[ \t\r\n]+").alias("strings"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_codes(spark, sf_dir).where("doc_id % 2 = 0").withColumn("pid", F.col("doc_id"))


def app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_codes(spark, sf_dir).where("doc_id % 2 = 1").withColumn("qid", F.col("doc_id"))


_BITS = ",\n".join(f"sum((l{n} >> {b}) & 1) * 2 > count(*) AS b{32 * (3 - n) + b}" for n in range(4) for b in range(32))


def _lane(low: int) -> str:
    """A signed lane from bits low .. low + 63."""
    bits = " + ".join(f"(CASE WHEN b{low + k} THEN {1 << k} ELSE 0 END)" for k in range(63))
    return f"({bits} + (CASE WHEN b{low + 63} THEN {-(1 << 63)} ELSE 0 END))::BIGINT"


#: CTEs dw (doc_id, coord, strings) and doc (doc_id, coord, n_words, hi, lo), lib, app.
DOC_SQL = f"""WITH RECURSIVE dw AS (
  SELECT doc_id, source AS coord, list_distinct(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: length(w) >= {WORD})) AS strings FROM documents
), hashed AS (
  SELECT doc_id, coord, md5(w) AS h FROM (SELECT doc_id, coord, unnest(strings) AS w FROM dw)
), lanes AS (
  SELECT doc_id, coord, {", ".join(f"('0x' || substr(h, {1 + 8 * n}, 8))::BIGINT AS l{n}" for n in range(4))} FROM hashed
), bits AS (SELECT doc_id, coord, count(*) AS n_words,
{_BITS} FROM lanes GROUP BY doc_id, coord
), doc AS MATERIALIZED (SELECT doc_id, coord, n_words, {_lane(64)} AS hi, {_lane(0)} AS lo FROM bits
), lib AS (SELECT *, doc_id AS pid FROM doc WHERE doc_id % 2 = 0
), app AS (SELECT *, doc_id AS qid FROM doc WHERE doc_id % 2 = 1)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(coord, version, hi, lo, fqcn, strings, instructions, seq, sig_stamp)."""
    line, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    # Codes are those of parts, not of their many lines.
    h = F.md5(F.concat("p_name", "p_type").cast("binary"))
    lanes = [F.conv(F.substring(h, at, 16), 16, -10).cast("long") for at in (1, 17)]
    part = part.select("p_partkey", "p_brand", "p_name", lanes[0].alias("hi"), lanes[1].alias("lo"))
    rows = line.join(part, line.l_partkey == part.p_partkey)
    day = F.col("l_shipdate")
    return rows.select(
        F.col("p_brand").alias("coord"),
        (F.year(day) * 100 + F.month(day)).cast("string").alias("version"),
        "hi",
        "lo",
        F.col("p_name").alias("fqcn"),
        F.split("p_name", " ").alias("strings"),
        F.col("l_quantity").cast("int").alias("instructions"),
        (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber").cast("long")).alias("seq"),
        F.when(F.col("l_returnflag") == "A", "old").otherwise("now").alias("sig_stamp"),
    )


#: CTE obs, the same in SQL.
OBS_SQL = """WITH obs AS MATERIALIZED (
  SELECT coord, version, hi, lo, fqcn, instructions, seq, sig_stamp FROM (
    SELECT p_brand AS coord, (year(l_shipdate) * 100 + month(l_shipdate))::VARCHAR AS version,
      substr(md5(p_name || p_type), 1, 16) AS hi, substr(md5(p_name || p_type), 17, 16) AS lo,
      p_name AS fqcn, l_quantity::INT AS instructions, l_orderkey::BIGINT * 8 + l_linenumber AS seq,
      CASE WHEN l_returnflag = 'A' THEN 'old' ELSE 'now' END AS sig_stamp
    FROM lineitem JOIN part ON l_partkey = p_partkey)
)"""
