"""Hilbert-curve sharding, native: DataFrame functions only.

Each metadata dimension is quantised: a value's cell is the share of rows with smaller
values, in ``2**bits`` steps, so cells hold near equal counts whatever the type, and texts
count whole, however long the beginning they share. The cells' place on a Hilbert curve is
the sort key. Shards are runs of that order, so a file's minimum and maximum are tight in
every dimension at once.

Scale: one count of the dimensions' distinct values, added up over a range-partitioned
sort, gives the cells' borders (a few dozen values reach the driver); then one
range-partitioned sort whose tie-breakers split any hot cell, and counts by partition. No
group is gathered anywhere. The sorted rows are written once to the shared folder, as
their numbers must hold when a task runs again.

Nulls: a null dimension sorts in the first cell and is not counted, a null text has size
16. NaN sorts last. Repeated rows and ties are ordered by id, checksum and size; equal
rows are interchangeable. An empty table gives an empty result. All columns of the input
are carried as they are; where it has a ``shard`` or ``slot`` of its own, the new one is
named with an underscore after it.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import free_name, table, whole, written

N_SHARDS = 40
#: Bits a dimension; with three dimensions 2**18 cells.
BITS = 6


@lru_cache
def curve(n: int) -> tuple[list[int], list[int]]:
    """For a Hilbert curve in ``n`` dimensions: by state * 2**n + corner, the corner's
    place in the visit and the next state. A state is (entry corner, direction)."""
    full, size = (1 << n) - 1, 1 << n

    def left(x: int, k: int) -> int:
        k %= n
        return (x << k | x >> (n - k)) & full

    def gray(x: int) -> int:
        return x ^ x >> 1

    rank_of = {gray(i): i for i in range(size)}

    def ones(x: int) -> int:
        k = 0
        while x >> k & 1:
            k += 1
        return k

    def entry(i: int) -> int:
        return gray(2 * ((i - 1) // 2)) if i else 0

    def turn(i: int) -> int:
        return 0 if i == 0 else ones(i - 1 if i % 2 == 0 else i) % n

    place, following = [], []
    for e in range(size):
        for d in range(n):
            for corner in range(size):
                i = rank_of[left(corner ^ e, n - (d + 1))]
                place.append(i)
                following.append((e ^ left(entry(i), d + 1)) * n + (d + turn(i) + 1) % n)
    return place, following


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of a cell, given one number below 2**bits a dimension."""
    n = len(cells)
    place, following = (F.array(*map(F.lit, x)) for x in curve(n))
    whole = F.array(*[c.cast("int") for c in cells])

    def step(acc: Column, bit: Column) -> Column:
        corner = sum((F.call_function("shiftright", whole[k], bit).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k in range(1, n)), F.call_function("shiftright", whole[0], bit).bitwiseAND(F.lit(1)))
        at = acc["s"] * F.lit(1 << n) + corner
        return F.struct((acc["h"] * F.lit(1 << n) + F.get(place, at)).cast("long").alias("h"), F.get(following, at).cast("int").alias("s"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s")), step)["h"]


def comparable(col: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A dimension as a number and as a text, one of them null; order is kept. All that is
    no number, truth or time is ordered as text."""
    none = F.lit(None)
    if isinstance(kind, T.DateType | T.TimestampType):
        col, kind = F.unix_micros(col.cast("timestamp")), T.LongType()
    if isinstance(kind, T.NumericType | T.BooleanType):
        return col.cast("double"), none.cast("string")
    return none.cast("double"), col.cast("string")


def borders(df: DataFrame, dims: list[str], bits: int = BITS) -> list[list[tuple[object, int]]]:
    """Of each dimension, columns (number, text) of ``df``: the least value of each cell
    that is not empty, and the cell."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"{d}.x").alias("x"), F.col(f"{d}.s").alias("s")) for k, d in enumerate(dims)])
    values = df.select(F.explode(each).alias("v")).select("v.*").where("x is not null or s is not null").groupBy("k", "x", "s").agg(F.count("*").alias("n"))
    values = written(values.orderBy("k", "x", "s").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # A few numbers for each partition of the sort.
    before: dict[int, int] = {}
    offsets, totals = {}, {}
    for p, k, n in sorted(map(tuple, values.groupBy(part.alias("p"), "k").agg(F.sum("n")).collect())):
        offsets[p, k] = before.get(k, 0)
        before[k] = totals[k] = offsets[p, k] + n
    if not totals:
        return [[] for _ in dims]
    parts = 1 + max(p for p, _ in offsets)
    start, total = (F.array(*[F.lit(x).cast("long") for x in side]) for side in ([offsets.get((p, k), 0) for p in range(parts) for k in range(len(dims))], [totals.get(k, 1) for k in range(len(dims))]))
    upto = Window.partitionBy("p", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("p", part).withColumn("below", F.get(start, (F.col("p") * len(dims) + F.col("k")).cast("int")) + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    cell = F.floor(F.col("below") * F.lit(1 << bits) / F.get(total, F.col("k"))).cast("int")
    least = placed.groupBy("k", cell.alias("cell")).agg(F.min(F.struct("x", "s")).alias("v")).collect()
    out = [[] for _ in dims]
    for k, cell, v in sorted(map(tuple, least), key=lambda r: r[:2]):
        out[k].append((v.x if v.s is None else v.s, cell))
    return out


def cell_of(value: Column, cuts: list[tuple[object, int]]) -> Column:
    """The cell of a comparable value, 0 for null."""
    if not cuts:
        return F.lit(0)
    number, text = value["x"], value["s"]
    mine = text if isinstance(cuts[0][0], str) else number
    last = F.size(F.filter(F.array(*[F.lit(c) for c, _ in cuts]), lambda c: c <= mine)) - 1
    return F.when(mine.isNull() | (last < 0), 0).otherwise(F.get(F.array(*[F.lit(k) for _, k in cuts]), last))


def ordered(df: DataFrame, dims: list[tuple[Column, T.DataType]], ties: list[Column], bits: int = BITS) -> DataFrame:
    """row (all columns of ``df``), and rank and total: its place from 0 in the order of
    the curve, then of ``ties``, and the number of rows. Written on the way."""
    names = [f"d{k}" for k in range(len(dims))]
    keyed = df.select(whole(df), *[F.struct(*[c.alias(n) for c, n in zip(comparable(col, kind), "xs", strict=True)]).alias(d) for d, (col, kind) in zip(names, dims, strict=True)], *[c.alias(f"t{k}") for k, c in enumerate(ties)])
    cuts = borders(keyed.select(*names), names, bits)
    index = hilbert_index([cell_of(F.col(d), c) for d, c in zip(names, cuts, strict=True)], bits)
    keyed = keyed.withColumn("index", index).orderBy("index", *[f"t{k}" for k in range(len(ties))])
    kept = written(keyed.select("row", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    # One number for each partition of the sort, whatever the input's size.
    counts = {r[0]: r[1] for r in kept.groupBy(part.alias("p")).count().collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), part.cast("int"))
    return kept.select("row", (start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"), F.lit(total).cast("long").alias("total"))


def hilbert_shards(df: DataFrame, dims: list[tuple[Column, T.DataType]], ties: list[Column], n_shards: int = N_SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: runs of the curve's order whose counts are at
    most one apart (fewer rows than shards: the last ones of a run stay empty)."""
    out = ordered(df, dims, ties, bits).withColumn("shard", F.expr(f"cast((rank * {n_shards}) div greatest(total, 1L) as int)"))
    slot = F.expr(f"rank - (shard * total + {n_shards - 1}) div {n_shards}")
    return out.select("row.*", F.col("shard").alias(free_name("shard", df.columns)), slot.alias(free_name("slot", df.columns)))


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 16."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + 16


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def document_shards(docs: DataFrame, size: Column, crc: Column, n_shards: int = N_SHARDS) -> DataFrame:
    """``docs`` by source, language and size."""
    dims = [(F.col(c), docs.schema[c].dataType) for c in ("source", "lang")]
    return hilbert_shards(docs, [*dims, (size, T.LongType())], [F.col("doc_id"), crc, size], n_shards)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = written(docs.select("doc_id", size_of(F.col("text")).alias("size"), checksum(F.col("text")).alias("text_crc32"), "source", "lang"))
    out = document_shards(slim, F.col("size"), F.col("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "lang")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the documents with their shard and slot."""
    return document_shards(docs, size_of(F.col("text")), checksum(F.col("text")))
