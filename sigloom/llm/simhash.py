"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has 64 bits. Fingerprints are reduced to distinct ones first, so exact
copies cost nothing below. The 64 bits are cut into six blocks; two fingerprints that
differ in at most four bits agree in two blocks at least, so each fingerprint goes to
one bucket for each pair of blocks (15 buckets of about 21 bits), and all links are
found inside buckets. In a bucket a trie is joined with itself: pairs of nodes are
walked together from the top bit, differing bits add up, and a pair is dropped as
soon as the sum passes the budget. Since classes are asked for and not pairs, a pair
of nodes that are already known to be one class is dropped as well: that keeps large
groups of near copies from costing the square of their size.

Scale: buckets beyond ``BUCKET_ROWS`` are cut into pieces and every two pieces meet in
a task of their own (distinct fingerprints only; the join that tells a bucket's pieces is
left to the skew join of adaptive execution); a bucket gives at most one link a member (a
forest); classes are joined by contraction, each round a table in the shared folder, which
goes when the next is there. Where rows meet their class, fingerprints of mass copies are
split (see common.with_leads). Nothing of size reaches the driver.

Nulls: a null text has no words and fingerprint zero, which links like any other. A
null doc_id takes part but is never a component's id (null if there is no other).
Repeated rows are copies. Rows of one id with different texts are documents of their own.
Empty tables give empty results; other columns are unused. The stage keeps, of each
component, the row with the least id, then the least hash of its text; rows without an id
come last, and of rows that are equal in both the one with the least hash of all columns
stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import Words, blocks, dropped, flat, partitions, table, whole, with_leads, written

WIDTH = 4
MAX_BITS = 4
SEED = 42
BLOCKS = 6
#: Rows of a bucket that one task walks; larger buckets are cut.
BUCKET_ROWS = 1 << 14


def fingerprints_of(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    words = Words(*flat(texts, lower=True))
    packed, at = words.pack()
    first = words.first
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    i = np.arange(len(words))
    here = (i + width <= first[doc + 1]) | ((i == first[doc]) & (count[doc] < width))
    i, doc = i[here], doc[here]
    raw, hashed = packed.tobytes(), xxhash.xxh64_intdigest
    start, end = at[i].tolist(), (at[np.minimum(i + width, first[doc + 1])] - 1).tolist()
    h = np.fromiter((hashed(raw[a:b], SEED) for a, b in zip(start, end, strict=True)), dtype=np.uint64, count=len(start))
    out = np.zeros(len(count), dtype=np.uint64)
    n = np.bincount(doc, minlength=len(count))
    if not len(h):
        return out
    some = np.flatnonzero(n)
    # Sums of 255 rows at most fit a byte: eight columns of eight packed counters.
    begin = np.concatenate(([0], np.cumsum(n[some])[:-1]))
    pieces = -(-n[some] // 255)
    of = np.repeat(np.arange(len(some)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(bits, begin[of] + 255 * nth, axis=0).view(np.uint8)
    total = np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * total > n[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fingerprints_of(b.column(2)).view(np.int64))], names=["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and fp (its 64 bits as a signed number) of each row."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string")).mapInArrow(_fingerprint, "doc_id long, th long, fp long")


class Forest:
    """Union-find over 0..n-1 for arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def trie_classes(group: np.ndarray, fp: np.ndarray, budget: int = MAX_BITS) -> np.ndarray:
    """For rows sorted by (group, fp), the first row of each row's class under links of
    at most ``budget`` differing bits inside a group."""
    n = len(fp)
    forest = Forest(n)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if n else np.zeros(1, int)
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    if not len(lo):
        return forest.root
    large = hi - lo > 256
    # Large buckets go by rising budgets: what is joined early need not be walked again.
    for part, budgets in ((~large, [budget]), (large, range(1, budget + 1))):
        a, b = lo[part], hi[part]
        for most in budgets if len(a) else []:
            stack = [(63, (a, b, a, b, np.zeros(len(a), dtype=np.int8)))]
            while stack:
                bit, pairs = stack.pop()
                pairs = _unjoined(pairs, forest.root)
                small = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= 36
                _verify([x[small] for x in pairs], fp, most, forest)
                pairs = [x[~small] for x in pairs]
                if not len(pairs[0]) or bit < 0:
                    continue
                pairs = _children(pairs, fp, bit, most)
                for at in range(0, len(pairs[0]), 1 << 18):
                    stack.append((bit - 1, [x[at : at + (1 << 18)] for x in pairs]))
    return forest.root


def _unjoined(pairs, root):
    """Without the pairs whose nodes are one class already."""
    steps = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
    alo, ahi, blo, bhi, _ = pairs
    done = (steps[ahi - 1] == steps[alo]) & (steps[bhi - 1] == steps[blo]) & (root[alo] == root[blo])
    return [x[~done] for x in pairs]


def _verify(pairs, fp, most, forest):
    """Links among the rows under pairs of small nodes."""
    alo, ahi, blo, bhi, _ = pairs
    wide = bhi - blo
    total = (ahi - alo) * wide
    for at in range(0, len(alo), 1 << 15):
        s = slice(at, at + (1 << 15))
        t = total[s]
        k = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        w = np.repeat(wide[s], t)
        i, j = np.repeat(alo[s], t) + k // w, np.repeat(blo[s], t) + k % w
        near = np.bitwise_count(fp[i] ^ fp[j]) <= most
        forest.link(i[near], j[near])


def _children(pairs, fp, bit, most):
    ones = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
    alo, ahi, blo, bhi, diff = pairs
    amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
    same = alo == blo  # a node with itself; the mirrored pair is left out
    same &= ahi == bhi
    out = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1), tuple(x[~same] for x in (amid, ahi, blo, bmid, diff + 1))]
    joined = [np.concatenate(x) for x in zip(*out, strict=True)]
    alo, ahi, blo, bhi, diff = joined
    keep = (ahi > alo) & (bhi > blo) & (diff <= most)
    keep &= ~((alo == blo) & (ahi - alo == 1) & (bhi == ahi))
    return [x[keep] for x in joined]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, a, b, fp), sorted by all but fp: one link from each row to the
    first row of its class."""

    def solve(cols):
        fp = cols[3].view(np.uint64)
        order = np.lexsort((fp, cols[2], cols[1], cols[0]))
        fp = fp[order]
        key = [c[order] for c in cols[:3]]
        new = np.zeros(len(fp), dtype=np.int64)
        if len(fp):
            new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        root = trie_classes(np.cumsum(new), fp)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[root[moved]].view(np.int64))], names=["u", "v"])

    held = None
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(4)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = np.all([c == c[-1] for c in cols[:3]], axis=0)
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield solve([c[:cut] for c in cols])
    if held is not None and len(held[0]):
        yield solve(held)


def block_masks(n: int = BLOCKS) -> list[int]:
    at = [64 * k // n for k in range(n + 1)]
    masks = [((1 << at[k + 1]) - 1) ^ ((1 << at[k]) - 1) for k in range(n)]
    return [masks[i] | masks[j] for i, j in combinations(range(n), 2)]


def trie_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints ``fp`` of one class."""
    n = partitions(fps.sparkSession)
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks()]
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(signed)]))
    rows = fps.select("fp", at.alias("at")).select(F.xxhash64("at.k", "at.bits").alias("bucket"), "fp")
    large = rows.groupBy("bucket").count().where(F.col("count") > BUCKET_ROWS).select("bucket", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("n"))
    cut = rows.join(large, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = cut.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    return met.repartition(n, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(_links, "u long, v long")


def classes(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v), by contraction: each node joins
    the least of its neighbours and itself, until no link between different nodes is
    left. Least is by a hash that changes with the round, so that a good share of the
    nodes goes each round, on chains too."""
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().select("node", F.col("node").alias("root"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        low, own = (F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to")) for c in ("v", "at"))
        up = edges.union(edges.select("v", "u")).groupBy(F.col("u").alias("at")).agg(F.min(low).alias("low"))
        up = written(up.select("at", F.least("low", own)["to"].alias("to")))
        old = labels, edges, up
        labels = written(labels.join(up, F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = edges.join(up, F.col("u") == F.col("at")).select(F.col("to").alias("u"), "v").join(up, F.col("v") == F.col("at")).select("u", F.col("to").alias("v"))
        edges = written(ends.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        dropped(*old[turn == 1 :])
    return labels


def clustered(fps: DataFrame) -> DataFrame:
    """fp, n_rows, component_id (the least id) and keep (no id, least id, th: the row that
    stands for the component) of each distinct fingerprint of the written rows ``fps``."""
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(best).alias("best"), F.count("*").alias("n_rows")))
    labels = classes(trie_links(reps.select("fp")))
    rooted = written(reps.join(labels, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.min("best").alias("keep"))
    return rooted.join(lowest, "root").select("fp", "n_rows", "component_id", "keep")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    fps = written(fingerprints(docs))
    named = written(clustered(fps).drop("keep"))
    return with_leads(fps, named, ["fp"], "n_rows", ["doc_id", "th"]).select("doc_id", "fp", "component_id")


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, see above."""
    keep = clustered(written(fingerprints(docs))).select("keep").distinct().select(F.col("keep.doc_id").alias("keep_id"), F.col("keep.th").alias("keep_th"))
    # Copies collapse before they travel; a map, which has no order or hash, counts as its entries.
    plain = [F.map_entries(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in docs.schema]
    rows = docs.select(whole(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.xxhash64(*plain).alias("h"))
    rows = rows.groupBy("id", "th").agg(F.min_by("row", "h").alias("row"))
    return rows.join(keep, F.expr("id <=> keep_id and th = keep_th"), "left_semi").select("row.*")
