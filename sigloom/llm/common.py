"""What the training-data operators share: reading tables, tables written to the
shared folder, and numpy views of whole Arrow batches of texts.

Every Python operator here works on Arrow batches cut into blocks of a few
megabytes of text (a longer document is a block of its own), so that memory is
bounded by the block and not by the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once.
BLOCK_BYTES = 4 << 20
_M1, _M2, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a
    local session may go without; it gets one folder below its warehouse."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return found.rstrip("/")


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables ``written`` inside go at its end, but for those put into the list it gives."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        made = _open.pop()
        dropped(*[df for df in made if not any(df is k for k in kept)])
        if _open:
            _open[-1].extend(kept)


def written(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again: lineage ends
    here and survives lost executors. The files go with ``dropped`` or ``scratch``, or
    when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sigloom-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(path)
    # Nothing reads the shuffles before this point again. Spark deletes their files once the
    # driver's JVM has collected the plan, which else may be half an hour later.
    jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._sigloom_path = path
    if _open:
        _open[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._sigloom_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``row``, so that no helper column can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores after it as it takes to be new."""
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def stretch(text: Column, salt: Column, n: int) -> Column:
    """At most ``n`` characters of a text, from a place that a hash picks."""
    spare = F.greatest(F.length(text) - n, F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(salt), spare) + 1).cast("int"), F.lit(n))


#: Keys that one of so many rows at least has are hot.
HOT_SHARE = 1000


def with_leads(rows: DataFrame, leads: DataFrame, on: list[str], size: str, spread: list[str]) -> DataFrame:
    """Left join of ``rows`` to ``leads``, one row for each key ``on`` with its number of
    ``rows`` in ``size``. Hot keys are fewer than ``HOT_SHARE``, whatever the input, so
    their leads are broadcast; their rows are spread by a hash of the columns ``spread``
    over the tasks of the join that serves all other keys. Read twice: ``leads``."""
    leads = leads.withColumnRenamed(size, "_size")
    total = leads.agg(F.sum("_size")).first()[0] or 0
    told = F.struct(*[c for c in leads.columns if c not in (*on, "_size")])
    hot = leads.where(F.col("_size") * HOT_SHARE > total).select(*on, told.alias("_hot"))
    cold = leads.where(F.col("_size") * HOT_SHARE <= total).select(F.col(on[0]).alias("_key"), F.lit(False).alias("_is_hot"), *on[1:], told.alias("_cold"))
    out = rows.join(F.broadcast(hot), on, "left").withColumn("_is_hot", F.col("_hot").isNotNull())
    out = out.withColumn("_key", F.when(F.col("_is_hot"), F.xxhash64(*spread)).otherwise(F.col(on[0])))
    out = out.join(cold, ["_key", "_is_hot", *on[1:]], "left").withColumn("_hot", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, "_hot.*")


def fold(doc_id, n: int = 5):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the splitmix64 finaliser)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        at = byte_offsets(col)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def byte_offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def flat(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text begins (one more entry
    at the end). Null texts are empty."""
    if col.null_count:
        col = col.fill_null("")
    at = byte_offsets(col)
    buffer = col.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[at[0] : at[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return (lowered(data) if lower else data), at - at[0]


class Words:
    """The words of a block of texts: runs of other bytes than space and 0x09 to 0x0D.

    start, end: byte range of each word in ``data``; first: index of each text's
    first word, with one more entry at the end. ``packed`` (see ``pack``) holds the
    words with one space after each; word i is ``packed[at[i] : at[i + 1] - 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.inside = inside = ~((data == 0x20) | (data - np.uint8(9) < 5))
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[1:-1]
        before[edge[edge < len(data)]] = False
        after[edge[edge > 0] - 1] = False
        self.start = np.flatnonzero(inside > before)
        self.end = np.flatnonzero(inside > after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def pack(self) -> tuple[np.ndarray, np.ndarray]:
        size = self.end - self.start
        at = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size + 1, out=at[1:])
        packed = np.full(at[-1], 0x20, dtype=np.uint8)
        keep = np.ones(at[-1], dtype=bool)
        keep[at[1:] - 1] = False
        packed[keep] = self.data[self.inside]
        return packed, at

    def binary(self) -> pa.Array:
        """The words as an Arrow array."""
        at = np.zeros(len(self.start) + 1, dtype=np.int32)
        np.cumsum(self.end - self.start, out=at[1:])
        return pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(self.data[self.inside]))])


_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(packed: np.ndarray, at: np.ndarray, salt: int = 0, after: int = 1) -> np.ndarray:
    """A 64-bit hash of each word of ``packed`` (see Words.pack), the same wherever the
    word stands. ``after``: how many bytes between words."""
    return hashes_at(packed, at[:-1], np.diff(at) - after, salt)


def hashes_at(data: np.ndarray, start: np.ndarray, left: np.ndarray, salt: int = 0) -> np.ndarray:
    """The same hash of the words that begin at ``start`` and have ``left`` bytes."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    out = mixed(lanes[start] & _LANE[np.minimum(left, 8)] ^ mixed(left.astype(np.uint64) + np.uint64(salt << 32)))
    more = np.flatnonzero(left > 8)
    k = 8
    while len(more):
        rest = left[more] - k
        out[more] = mixed(out[more] * np.uint64(3) + (lanes[start[more] + k] & _LANE[np.minimum(rest, 8)]))
        k += 8
        more = more[rest > 8]
    return out


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive entries of ``h`` (len(h) - k + 1 of them)."""
    n, out, power, done = len(h) - k + 1, None, h, 0
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    width = 1
    while True:
        if k & width:
            part = power[done : done + n]
            out = part if out is None else mixed(out * np.uint64(3) + part)
            done += width
        width *= 2
        if width > k:
            return out
        power = mixed(power[: len(power) - width // 2] * np.uint64(5) + power[width // 2 :])


def run_minima(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each ``k`` consecutive entries."""
    n, width = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * width <= k:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[k - width : k - width + n])


def squeeze(raw: bytes | np.ndarray, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unsqueeze(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=size, asbytes=True), dtype=np.uint8) if size else np.zeros(0, np.uint8)
