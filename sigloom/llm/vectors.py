"""Approximate nearest neighbours by inner product: an inverted file of coarse
centroids, product-quantised residuals, asymmetric tables, exact reranking.

Fitting uses a bounded sample (the vectors with the least hash of their id, 32 a list,
``SAMPLE`` to ``MOST_SAMPLE`` of them); every usable vector is indexed. There are as many
lists as the square root of the rows, up to ``MOST_LISTS``. How many lists a query visits
is found on the sample, so that ``TARGET`` of its true neighbours lie in visited lists;
shuffled data without clusters need many lists, clustered data few.

A residual is coded in ``dim / 4`` bytes. For an inner product the table of a query
(its products with all codewords) serves every list, since <q, c + r> = <q, c> + <q, r>.
A list is scored for the queries that visit it and no others: the first ``SHORTLIST`` by
the tables are scored on the original vectors, which gives a floor for a query's k-th
score. A row's score differs from its table score by at most |q| times the norm of what
its code leaves out, so every row that could reach the floor is scored as well, however
many there are: of the lists a query visits no neighbour is lost. Scores are in double
precision, ties go to the smaller id. Of equal vectors in a pack the first k + 1 suffice.

Scale: lists are dealt into packs of about equal size, a large list over several of
them. A pack's rows go to one task, in memory, and the queries that visit its lists are
streamed past, so rows travel once and a query once a pack. Only packs that are asked by
more than ``CHUNK_QUERIES`` queries are copied, once for so many. At most k rows a query
and pack come back. Only counts by list reach the driver.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without an id. Repeated ids count once (the least
vector). Fewer than k candidates: all are returned. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import mixed, partitions, table, written

K = 20
QUERY_EVERY = 20
#: Least and most vectors that centroids and codebooks are fitted on.
SAMPLE, MOST_SAMPLE = 8192, 1 << 17
MOST_LISTS = 4096
TARGET = 0.97
#: Rows of a list whose exact scores set a query's floor; no limit on what is scored.
SHORTLIST = 80
#: Least number of packs, and most rows of one.
PACKS, PACK_ROWS = 24, 1 << 16
CHUNK_QUERIES = 1 << 18
#: Queries that are answered at once.
STEP = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of the rows of ``x``; empty ones are put on random rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[lo : lo + 4096] @ c.T, axis=1) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Index:
    """What the fit learns: centroids, codebooks (part, codeword, its dimensions) and
    the number of lists to visit."""

    def __init__(self, sample: np.ndarray, n_rows: int, k: int = K):
        x = np.unique(sample, axis=0).astype(np.float32)
        dim = x.shape[1]
        self.dim, self.lists = dim, int(np.clip(round(n_rows**0.5), 1, min(MOST_LISTS, max(1, len(x) // 16))))
        self.centroids = kmeans(x, self.lists)
        rest = x - self.centroids[nearest(x, self.centroids)]
        self.cuts = list(range(0, dim, 4)) + [dim]
        self.books = [kmeans(np.ascontiguousarray(rest[:, a:b]), 256, seed=a) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        # Lists to visit: where the true neighbours of some sample rows are.
        own = nearest(x, self.centroids)
        asked = np.random.default_rng(3).permutation(len(x))[:256]
        scores = x[asked] @ x.T
        scores[np.arange(len(asked)), asked] = -np.inf
        near = np.argsort(-scores, axis=1)[:, : max(1, min(k, len(x) - 1))]
        place = np.empty((len(asked), self.lists), dtype=int)
        np.put_along_axis(place, np.argsort(-(x[asked] @ self.centroids.T), axis=1), np.arange(self.lists)[None, :], axis=1)
        ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        self.visit = int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        parts = [nearest(np.ascontiguousarray(rest[:, a:b]), book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        return own, np.stack(parts, axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(parts)), np.uint8)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec of the rows that take part, each id once."""
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(finite).where(F.exists("vec", lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _encode(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, codes = index.encode(matrix(b.column(1), index.dim))
            code = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), code], names=["vec_id", "vec", "list", "code"])

    return run


def _visits(index: Index):
    """The lists that each query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column(1), index.dim)
            order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")[:, : index.visit].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(order), pa.list_(pa.int32()))], names=["id", "vec", "visits"])

    return run


def _sent(packs_of: list[list[int]], chunks: list[int]):
    """Each query once for each pack that holds a list it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = [np.array(p, dtype=np.int32) for p in packs_of]
        of = np.array(chunks, dtype=np.int64)
        for b in batches:
            ids = b.column(0).to_numpy()
            packs = [np.unique(np.concatenate([holds[x] for x in v])) for v in b.column(2).to_pylist()]
            row = np.repeat(np.arange(len(packs)), [len(p) for p in packs])
            pack = np.concatenate(packs)
            chunk = (mixed(ids.astype(np.uint64))[row] % of[pack].astype(np.uint64)).astype(np.int32)
            columns = [b.column(k).take(pa.array(row)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(pack), pa.array(chunk), *columns], names=["pack", "chunk", "id", "vec", "visits"])

    return run


def left_out(index: Index, vecs: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Norm of what the centroid and the code of each row leave out."""
    total = np.zeros(len(vecs))
    for part, (a, b, book) in enumerate(zip(index.cuts[:-1], index.cuts[1:], index.books, strict=True)):
        rest = vecs[:, a:b].astype(np.float64) - index.centroids[lists, a:b] - book[codes[:, part]]
        total += (rest * rest).sum(axis=1)
    return np.sqrt(total)


def exact(q: np.ndarray, vecs: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """<q[row], vecs[at]> in double precision."""
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[row[s : s + 8192]].astype(np.float64), vecs[at[s : s + 8192]].astype(np.float64)) for s in range(0, len(row), 8192)]])


def nth_of(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row, -inf where there are fewer."""
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(scores), -np.inf)


def contenders(k: int, q: np.ndarray, coarse: np.ndarray, seen: np.ndarray, vecs: np.ndarray, error: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row) of all ``seen`` pairs that can be among a query's k best, and what is
    known of the k-th scores then. ``coarse``: scores by the tables, which are used up."""
    dim, score = vecs.shape[1], coarse
    score[~seen] = -np.inf
    first = np.argpartition(score, len(vecs) - SHORTLIST, axis=1)[:, -SHORTLIST:] if len(vecs) > SHORTLIST else np.broadcast_to(np.arange(len(vecs)), score.shape)
    row = np.repeat(np.arange(len(q)), first.shape[1])
    found = exact(q, vecs, row, first.ravel()).reshape(first.shape)
    found[~np.take_along_axis(seen, first, axis=1)] = -np.inf
    floor = np.maximum(floor, nth_of(found, k))
    # Single precision is off by less than this, of a sum of dim products.
    norm, size = np.linalg.norm(q.astype(np.float64), axis=1), np.linalg.norm(vecs.astype(np.float64), axis=1)
    slack = 8 * dim * np.finfo(np.float32).eps * norm * (size + error).max()
    score += (norm[:, None] * error).astype(np.float32)
    able = seen & ~(score < (floor - slack)[:, None].astype(np.float32))
    some = np.flatnonzero(able.any(axis=0))
    score = q @ vecs[some].T
    able = able[:, some]
    score[~able] = -np.inf
    row, at = np.nonzero(able & ~(score < (np.maximum(floor, nth_of(score, k)) - 2 * slack)[:, None].astype(np.float32)))
    return row, some[at], floor


class Pack:
    """Rows of a pack, by list; of equal vectors the first k + 1."""

    def __init__(self, index: Index, k: int, rows: pa.Table):
        rows = rows.sort_by([("list", "ascending"), ("id", "ascending")])
        vecs = matrix(rows["vec"].combine_chunks(), index.dim)
        alike = np.unique(np.ascontiguousarray(vecs).view(np.dtype((np.void, 4 * index.dim))).ravel(), return_inverse=True)[1]
        order = np.argsort(alike, kind="stable")
        kept = np.sort(order[np.arange(len(order)) - np.searchsorted(alike[order], alike[order]) <= k])
        self.index, self.k = index, k
        self.ids, self.vecs = rows["id"].to_numpy()[kept], vecs[kept]
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(len(order), -1)[kept]
        lists = rows["list"].to_numpy()[kept]
        self.codes, self.error = codes, left_out(index, self.vecs, lists, codes)
        edges = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1], [True])))
        self.lists = list(zip(lists[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    def answer(self, asked: np.ndarray, q: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query_id, vec_id, score): the k best of each query in the lists it visits."""
        index, held = self.index, [(np.zeros(0, int), np.zeros(0, int))]
        seen = np.zeros((len(q), index.lists), dtype=bool)
        np.put_along_axis(seen, visits, True, axis=1)
        near = q @ index.centroids.T
        tables = [q[:, a:b] @ book.T for a, b, book in zip(index.cuts[:-1], index.cuts[1:], index.books, strict=True)]
        floor = np.full(len(q), -np.inf)
        for which, a, b in self.lists:
            mine = np.flatnonzero(seen[:, which])
            step = max(1, (1 << 22) // (b - a))
            for lo in range(0, len(mine), step):
                s = mine[lo : lo + step]
                coarse = np.repeat(near[s, which][:, None], b - a, axis=1)
                for part, table_ in enumerate(tables):
                    coarse += np.take(table_[s], self.codes[a:b, part], axis=1)
                row, at, floor[s] = contenders(self.k, q[s], coarse, self.ids[None, a:b] != asked[s, None], self.vecs[a:b], self.error[a:b], floor[s])
                held.append((s[row], at + a))
        row, at = (np.concatenate(x) for x in zip(*held, strict=True))
        score = exact(q, self.vecs, row, at)
        order = np.lexsort((self.ids[at], -score, row))
        row = row[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        order = order[best]
        return asked[row[best]], self.ids[at[order]], score[order]


def _search(index: Index, k: int):
    """Rows (pack, chunk, kind, id, vec, list, code, visits) by pack, chunk and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, pack = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part, (p, c, kind) = batch.slice(lo, hi - lo), key[lo].tolist()
                if (p, c) != now:
                    now, held, pack = (p, c), [], None
                if kind == 0:
                    held.append(part)
                    continue
                if pack is None and held:
                    pack, held = Pack(index, k, pa.Table.from_batches(held)), []
                for at in range(0, part.num_rows if pack else 0, STEP):
                    some = part.slice(at, STEP)
                    visits = some.column(7).flatten().to_numpy().reshape(some.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pack.answer(some.column(3).to_numpy(), matrix(some.column(4), index.dim), visits)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, query_every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by
    ``query_every`` the k nearest other vectors found."""
    spark = vectors.sparkSession
    rows = written(usable(vectors))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes
    rows = rows.where(F.size("vec") == dim)
    size = int(min(MOST_SAMPLE, max(SAMPLE, 32 * n**0.5)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec").limit(size).toArrow()
    index = Index(matrix(sample["vec"].combine_chunks(), dim), n, k)
    coded = written(rows.mapInArrow(_encode(index), "vec_id long, vec array<float>, list int, code binary"))
    asked = written(rows.where(F.col("vec_id") % query_every == 0).mapInArrow(_visits(index), "id long, vec array<float>, visits array<int>"))
    counts, asks = ({r[0]: r[1] for r in x.groupBy("list").count().collect()} for x in (coded, asked.select(F.explode("visits").alias("list"))))
    most = min(PACK_ROWS, -(-n // PACKS))
    # Lists follow each other; list i fills packs from first[i] to last[i].
    upto, packs_of = 0, []
    for i in range(index.lists):
        packs_of.append(list(range(upto // most, max(upto, upto + counts.get(i, 0) - 1) // most + 1)))
        upto += counts.get(i, 0)
    queries = [0] * (packs_of[-1][-1] + 1)
    for i, packs in enumerate(packs_of):
        for p in packs:
            queries[p] += asks.get(i, 0)
    chunks = [max(1, -(-x // CHUNK_QUERIES)) for x in queries]
    first, span, copies = (F.array(*[F.lit(x) for x in v]) for v in ([p[0] for p in packs_of], [len(p) for p in packs_of], chunks))
    dealt = coded.withColumn("pack", F.get(first, F.col("list")) + F.pmod(F.xxhash64("vec_id"), F.get(span, F.col("list"))).cast("int"))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(copies, F.col("pack")) - 1)))
    dealt = dealt.select("pack", "chunk", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "vec", "list", "code", F.lit(None).cast("array<int>").alias("visits"))
    sent = asked.mapInArrow(_sent(packs_of, chunks), "pack int, chunk int, id long, vec array<float>, visits array<int>")
    sent = sent.select("pack", "chunk", F.lit(1).alias("kind"), "id", "vec", F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("code"), "visits")
    met = dealt.union(sent).repartition(partitions(spark), "pack", "chunk").sortWithinPartitions("pack", "chunk", "kind")
    found = met.mapInArrow(_search(index, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
