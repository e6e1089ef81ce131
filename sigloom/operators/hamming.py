"""Exact joins within a Hamming radius, and the approximate prefix-band store.

``hamming_join`` turns the theta join into an equi-join: with m bands and radius r, two
codes within r agree in some band up to floor(r / m) bits, and in most bands one bit less
need be looked for (see ``codes.thresholds``). Bands of the left codes are
exploded with all their flips, bands of the right ones as they are, the join is on
(band, key), and the distance is a residual condition of that join, so only true pairs
are shuffled on. Codes are made distinct on both sides first: copies of a code would
multiply candidates. The number of bands follows from both sides' counts; a few probes
(``BROADCAST_KEYS`` keys at most, counted) are broadcast, so that the library is streamed
past them and not shuffled. Otherwise the join is a merge join by a hint: Spark's estimate
of exploded keys leaves out how many they are, and would have the driver gather them all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import codes
from sigloom.operators.storage import checkpointed, read_facts, write_facts

#: Keys of probes that may be broadcast, about 40 bytes each.
BROADCAST_KEYS = 1 << 19
#: What shuffling a key costs, in candidates met (measured: 0.9 and 0.08 microseconds).
SHUFFLE_COST = 11.0
#: Codes of a block of the comparison of all pairs, 16 bytes each.
BLOCK = 1 << 15


def distance(left: str = "l_", right: str = "r_") -> Column:
    return codes.hamming(*[F.col(f"{side}{lane}") for side in (left, right) for lane in ("hi", "lo")])


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = left.select(F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo")).where("l_hi is not null and l_lo is not null").distinct()
    b = right.select(F.col("hi").alias("r_hi"), F.col("lo").alias("r_lo")).where("r_hi is not null and r_lo is not null").distinct()
    return a, b


def code_pairs(left: DataFrame, right: DataFrame, radius: int, m: int | None = None) -> DataFrame:
    """Distinct code pairs (l_hi, l_lo, r_hi, r_lo, distance) within the radius."""
    if radius < 0:
        raise ValueError("the radius is negative")
    a, b = _sides(left, right)
    if radius == 0:
        return a.join(b, (F.col("l_hi") == F.col("r_hi")) & (F.col("l_lo") == F.col("r_lo"))).withColumn("distance", F.lit(0))
    small = False
    if m is None:
        m, small = plan(radius, left.count(), right.count())
    a, b = probe_keys(a if small else _dealt(a), m, radius), band_keys(b, m)
    return met(a, b, radius, small)


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as a shuffle has: codes are so slim that a task or two
    would get them all, and explode them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns)


def plan(radius: int, n_left: int, n_right: int) -> tuple[int, bool]:
    """Bands, and whether the left side's keys are broadcast, with the least cost for
    uniform codes: keys that are shuffled or streamed, and candidates that are met."""

    def cost(m: int) -> tuple[float, float]:
        each = [(codes.len_flips(w, t), w) for (_, w), t in zip(codes.bands(m), codes.thresholds(radius, m), strict=True) if t >= 0]
        keys = sum(n for n, _ in each) * n_left
        met_ = sum(n * 2.0**-w for n, w in each) * n_left * n_right
        shuffled = SHUFFLE_COST * (keys + m * n_right) + met_
        streamed = SHUFFLE_COST * keys + m * n_right + met_ if keys <= BROADCAST_KEYS else math.inf
        return shuffled, streamed

    choices = [(c, m, bool(k)) for m in range(2, max(3, radius + 2)) for k, c in enumerate(cost(m))]
    return min(choices)[1:]


def probe_keys(rows: DataFrame, m: int, radius: int) -> DataFrame:
    """``rows`` (l_hi, l_lo) once for each band and flip, with band and key."""
    each = []
    for k, ((shift, width), most) in enumerate(zip(codes.bands(m), codes.thresholds(radius, m), strict=True)):
        if width > 64:
            raise ValueError("a band may have at most 64 bits")
        if most < 0:
            continue
        key = codes.field(F.col("l_hi"), F.col("l_lo"), shift, width)
        flipped = F.array(*[key.bitwiseXOR(F.lit(x - (1 << 64) if x >> 63 else x).cast("long")) for x in codes.flips(width, most)])
        each.append(F.transform(flipped, _tagged(k)))
    return rows.withColumn("at", F.explode(F.flatten(F.array(*each)))).select(*rows.columns, "at.band", "at.key")


def band_keys(rows: DataFrame, m: int) -> DataFrame:
    """``rows`` (r_hi, r_lo) once for each band, with band and key."""
    each = [F.struct(F.lit(k).alias("band"), codes.field(F.col("r_hi"), F.col("r_lo"), shift, width).alias("key")) for k, (shift, width) in enumerate(codes.bands(m))]
    return rows.withColumn("at", F.explode(F.array(*each))).select(*rows.columns, "at.band", "at.key")


def met(a: DataFrame, b: DataFrame, radius: int, small: bool = False) -> DataFrame:
    """Distinct code pairs of probe keys and band keys within the radius; ``small`` probe
    keys are broadcast, and nothing is otherwise."""
    a = F.broadcast(a) if small else a.hint("merge")
    hit = (a.band == b.band) & (a.key == b.key) & (distance() <= radius)
    return a.join(b, hit).select("l_hi", "l_lo", "r_hi", "r_lo").distinct().withColumn("distance", distance())


def _tagged(band: int):
    return lambda key: F.struct(F.lit(band).alias("band"), key.alias("key"))


def hamming_join(left: DataFrame, right: DataFrame, radius: int, m: int | None = None) -> DataFrame:
    """(qid, pid, distance) of all rows of ``left`` (qid, hi, lo) and ``right`` (pid, hi,
    lo) within the radius: a bag, one row for each pair of rows. Null codes match nothing."""
    return expanded(code_pairs(left, right, radius, m), left, right)


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(qid, pid, distance) of all rows that have the codes of the pairs."""
    l, r = (x.select(*cols) for x, cols in ((left, ["qid", "hi", "lo"]), (right, ["pid", "hi", "lo"])))
    out = pairs.join(l, (F.col("l_hi") == l.hi) & (F.col("l_lo") == l.lo)).drop("hi", "lo")
    return out.join(r, (F.col("r_hi") == r.hi) & (F.col("r_lo") == r.lo)).select("qid", "pid", "distance")


def brute_join(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """The same by comparing all pairs of distinct codes: the yardstick for tests. The
    pairs are quadratic by nature; they are dealt out as blocks against blocks, so a task
    holds two blocks whatever the input, and the tasks grow with the pairs."""
    a, b = _sides(left, right)
    x, y = (checkpointed(_packed(rows, block_count(n.count()))) for rows, n in ((a, left), (b, right)))
    cells = x.withColumnRenamed("block", "x").hint("shuffle_replicate_nl").crossJoin(y.withColumnRenamed("block", "y"))
    pairs = cells.mapInArrow(_compared(radius), "l_hi long, l_lo long, r_hi long, r_lo long, distance int")
    out = pairs.join(left.select("qid", F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo")), ["l_hi", "l_lo"])
    return out.join(right.select("pid", F.col("hi").alias("r_hi"), F.col("lo").alias("r_lo")), ["r_hi", "r_lo"]).select("qid", "pid", "distance")


def block_count(n: int) -> int:
    """Blocks for n codes: of at most about ``BLOCK``, smaller ones where those were too
    few to share out."""
    return max(-(-n // BLOCK), min(8, -(-n // 512)), 1)


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` of two lanes in n partitions, each one row: all hi, then all lo."""

    def pack(batches):
        got = [[np.asarray(c, dtype=np.int64) for c in b.columns] for b in batches if b.num_rows]
        if got:
            lanes = b"".join(np.concatenate([g[k] for g in got]).tobytes() for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([lanes], pa.binary())], ["block"])

    return rows.repartition(n, *rows.columns).mapInArrow(pack, "block binary")


def _compared(radius: int):
    """From blocks x and y to the pairs within the radius. Pairs whose hi lanes alone
    differ in more bits go first, tile by tile of what a core's cache holds."""
    tall, wide, most = 16, 4096, 1 << 16
    names = ["l_hi", "l_lo", "r_hi", "r_lo", "distance"]

    def compare(batches):
        kept, n = [], 0

        def batch():
            cols = [np.concatenate([k[c] for k in kept]) for c in range(5)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        for x, y in ((x, y) for b in batches for x, y in zip(b.column(0), b.column(1), strict=True)):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64).reshape(2, -1) for v in (x, y))
            for j in range(0, b.shape[1], wide):
                r_hi, r_lo = b[:, j : j + wide]
                differ, bits, near = (np.empty((tall, len(r_hi)), kind) for kind in (np.uint64, np.uint8, np.bool_))
                for i in range(0, a.shape[1], tall):
                    l_hi, l_lo = a[:, i : i + tall]
                    h = len(l_hi)
                    np.bitwise_xor(l_hi[:, None], r_hi, out=differ[:h])
                    np.bitwise_count(differ[:h], out=bits[:h])
                    np.less_equal(bits[:h], min(radius, 128), out=near[:h])
                    at = np.flatnonzero(near[:h])
                    if not len(at):
                        continue
                    p, q = np.divmod(at, len(r_hi))
                    d = bits[:h].ravel()[at].astype(np.int32) + np.bitwise_count(l_lo[p] ^ r_lo[q])
                    hit = d <= radius
                    if hit.any():
                        p, q = p[hit], q[hit]
                        kept.append([v.view(np.int64) for v in (l_hi[p], l_lo[p], r_hi[q], r_lo[q])] + [d[hit].astype(np.int32)])
                        n += len(p)
                        if n >= most:
                            yield batch()
                            kept, n = [], 0
        if kept:
            yield batch()

    return compare


def best_match(hits: DataFrame) -> DataFrame:
    """Of each qid the nearest hit, the least pid among equals (ids follow entry order)."""
    best = hits.groupBy("qid").agg(F.min(F.struct("distance", "pid")).alias("b"))
    return best.select("qid", F.col("b.pid").alias("pid"), F.col("b.distance").alias("distance"))


def best_join(left: DataFrame, right: DataFrame, radius: int, m: int | None = None) -> DataFrame:
    """``best_match`` of ``hamming_join`` without a row for each pair of copies: of the rows
    with one code the least pid goes for all."""
    pairs = code_pairs(left, right, radius, m)
    first = right.groupBy(F.col("hi").alias("r_hi"), F.col("lo").alias("r_lo")).agg(F.min("pid").alias("pid"))
    best = pairs.join(first, ["r_hi", "r_lo"]).groupBy("l_hi", "l_lo").agg(F.min(F.struct("distance", "pid")).alias("b"))
    rows = left.select("qid", F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo"))
    return best_match(rows.join(best, ["l_hi", "l_lo"]).select("qid", "b.pid", "b.distance"))


def by_distance(hits: DataFrame) -> DataFrame:
    """Hits of each probe, nearest first, then by pid."""
    return hits.orderBy("qid", "distance", "pid")


class MihIndex:
    """Band keys of a library's codes, kept as a table sorted by (band, key) for any number
    of joins; exact for every radius."""

    FORMAT = "sigloom-mih-1"

    def __init__(self, keys: DataFrame, entries: DataFrame, m: int, stamp: str | None = None):
        self.keys, self.entries, self.m, self.stamp = keys, entries, m, stamp

    @classmethod
    def build(cls, entries: DataFrame, m: int | None = None, stamp: str | None = None) -> MihIndex:
        """Of entries (pid, hi, lo); ``m`` follows from their number if not given."""
        m = m or codes.suggest_m(entries.count())
        known = entries.where("hi is not null and lo is not null")
        return cls(band_keys(known.select(F.col("hi").alias("r_hi"), F.col("lo").alias("r_lo")).distinct(), m), known.select("pid", "hi", "lo"), m, stamp)

    def write(self, path: str) -> None:
        self.keys.repartitionByRange("band", "key").sortWithinPartitions("band", "key").write.mode("overwrite").parquet(f"{path}/keys")
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        write_facts(self.entries.sparkSession, f"{path}/meta", {"format": self.FORMAT, "sig_stamp": self.stamp, "m": self.m})

    @classmethod
    def open(cls, spark: SparkSession, path: str, expect_stamp: str | None = None) -> MihIndex:
        facts = read_facts(spark, f"{path}/meta", cls.FORMAT, expect_stamp)
        return cls(spark.read.parquet(f"{path}/keys"), spark.read.parquet(f"{path}/entries"), facts["m"], facts["sig_stamp"])

    def query(self, probes: DataFrame, radius: int) -> DataFrame:
        """(qid, pid, distance) of probes (qid, hi, lo), see ``hamming_join``."""
        a, _ = _sides(probes, self.entries)
        return expanded(met(probe_keys(_dealt(a), self.m, radius), self.keys, radius), probes, self.entries)


class BandStore:
    """Entries (pid, hi, lo) under the prefixes of several bit permutations.

    Approximate: what it returns is within the radius, but a near code is only found
    where a permuted prefix agrees (up to ``probe`` flipped bits, at most two)."""

    FORMAT = "sigloom-bands-1"

    def __init__(self, entries: DataFrame, tables: int = 6, prefix_bits: int = 18, seed: int = 0xA9C1D, stamp: str | None = None, kept: DataFrame | None = None):
        self.entries, self.prefix_bits, self.seed, self.stamp = entries, prefix_bits, seed, stamp
        self.orders = codes.permutations(tables, seed)
        self.kept = kept

    @classmethod
    def open(cls, spark: SparkSession, path: str, expect_stamp: str | None = None) -> BandStore:
        """A written store; bands are read and not worked out again."""
        facts = read_facts(spark, f"{path}/meta", cls.FORMAT, expect_stamp)
        kept = spark.read.parquet(f"{path}/bands")
        if kept.count() != facts["n_entries"] * facts["tables"]:
            raise ValueError(f"{path} is not whole")
        entries = kept.where(F.col("table") == 0).select("pid", "hi", "lo")
        return cls(entries, facts["tables"], facts["prefix_bits"], facts["seed"], facts["sig_stamp"], kept)

    def bands(self) -> DataFrame:
        return self.kept if self.kept is not None else self.prefixes(self.entries.select("pid", "hi", "lo"))

    def prefixes(self, rows: DataFrame, hi: str = "hi", lo: str = "lo", probe: int = 0) -> DataFrame:
        """``rows`` with (table, prefix), one row for each prefix that is looked up."""
        masks = codes.flips(self.prefix_bits, min(probe, 2))
        each = []
        for k, order in enumerate(self.orders):
            prefix = codes.permuted_prefix(F.col(hi), F.col(lo), order, self.prefix_bits)
            each.append(F.struct(F.lit(k).alias("table"), prefix.alias("prefix")))
        out = rows.withColumn("_at", F.explode(F.array(*each)))
        flip = F.explode(F.array(*[F.lit(x).cast("long") for x in masks]))
        return out.select(*rows.columns, F.col("_at.table").alias("table"), F.col("_at.prefix").alias("_p")).withColumn("_f", flip).withColumn("prefix", F.col("_p").bitwiseXOR(F.col("_f"))).drop("_p", "_f")

    def directory(self) -> DataFrame:
        """(table, prefix, entries, offset): how many entries a prefix has, and how many
        come before it in its table."""
        counts = self.bands().groupBy("table", "prefix").agg(F.count("*").alias("entries"))
        before = Window.partitionBy("table").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("offset", F.coalesce(F.sum("entries").over(before), F.lit(0)))

    def write(self, path: str) -> None:
        """The band table, sorted for lookups by prefix, and what it was made with."""
        self.bands().repartitionByRange("table", "prefix").sortWithinPartitions("table", "prefix", "pid").write.mode("overwrite").parquet(f"{path}/bands")
        facts = {"format": self.FORMAT, "sig_stamp": self.stamp, "tables": len(self.orders), "prefix_bits": self.prefix_bits, "seed": self.seed, "n_entries": self.entries.count()}
        write_facts(self.entries.sparkSession, f"{path}/meta", facts)

    def query_best(self, probes: DataFrame, radius: int, probe: int = 0) -> DataFrame:
        """(qid, pid, distance): the least distance of each payload found."""
        l = self.prefixes(probes.select("qid", F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo")), "l_hi", "l_lo", probe)
        r = self.bands().withColumnsRenamed({"hi": "r_hi", "lo": "r_lo"})
        hit = (l.table == r.table) & (l.prefix == r.prefix) & (distance() <= radius)
        return l.join(r, hit).groupBy("qid", "pid").agg(F.min(distance()).alias("distance"))

    def query(self, probes: DataFrame, radius: int, probe: int = 0) -> DataFrame:
        return self.query_best(probes, radius, probe).select("qid", "pid")
