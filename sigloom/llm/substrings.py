"""Removal of word windows that occur earlier, by super-k-mer partitioning.

A window's minimiser is the least hash among its three-word runs. Consecutive windows
of a document with one minimiser form a super-k-mer: their words travel once, as one
packed string, to the bucket of the minimiser. Equal windows have equal minimisers,
so each bucket counts its windows alone, by sorting; equal hashes are confirmed by
comparing the words' bytes.

Scale: every block of a few megabytes first settles its own windows, so of a window
that is frequent everywhere at most one occurrence a block travels. Strings go in
compressed blobs, one for each block and bucket; a task streams its buckets one at a
time, sorted by Spark. A bucket beyond ``BUCKET_BYTES`` (a hot minimiser, or too few
partitions) is passed on unread, in blobs: in the next round blobs are settled some at a
time, which leaves one occurrence of a window for each such lot, and what is left is dealt
by longer minimisers to many more buckets, in the end by the whole window. So a minimiser
that many windows share is split by more of their words, and a window that is everywhere
gets fewer with each round; no task ever holds more than a bucket. Documents meet their
removed ranges in one join.

Windows are judged on the input. A null text has no words; a document of fewer words
than a window keeps all. A null doc_id counts as smaller than any other (and as -2**63).
Rows with the same id and text are one document written twice: neither is earlier, so both
keep what they would keep alone; rows with the same id and different texts are told apart
by a hash of the text and compared by start. Empty tables give empty results; other
columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Words, blocks, flat, partitions, run_hashes, run_minima, squeeze, table, unsqueeze, word_hashes, written

WINDOW = 20
MINIMISER = 3
MAP_BYTES = 8 << 20
#: Bytes of packed strings that a task sorts at once.
BUCKET_BYTES = 24 << 20
BUCKETS_A_PARTITION = 8
#: With each round minimisers have so many words more, and there are so many times more buckets.
LONGER, SPREAD = 6, 16
NO_ID = -(1 << 63)


def removed_windows(packed: np.ndarray, at: np.ndarray, window: np.ndarray, ids: np.ndarray, starts: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Which windows occur earlier. ``window``: the first word of each, ``ids`` and
    ``starts``: its document and place there. ``packed``, ``at``: see Words.pack."""
    out = np.zeros(len(window), dtype=bool)
    if not len(window):
        return out
    h = run_hashes(word_hashes(packed, at, salt), k)[window]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    order = order[several]
    if not len(order):
        return out
    order = order[np.lexsort((starts[order], ids[order], h[order]))]
    g = h[order]
    head = np.concatenate(([True], g[1:] != g[:-1]))
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    # Runs of windows that follow their leaders word by word are compared as one string.
    by = np.argsort(order)
    i, j = order[by], lead[by]
    i, j = i[i != j], j[i != j]
    a, b = window[i], window[j]
    first = np.concatenate(([True], (np.diff(a) != 1) | (np.diff(b) != 1)))
    last = np.concatenate((first[1:], [True]))
    raw = packed.tobytes()
    for p, q, r, s in zip(at[a[first]].tolist(), at[a[last] + k].tolist(), at[b[first]].tolist(), at[b[last] + k].tolist(), strict=True):
        if raw[p:q] != raw[r:s]:  # two different windows share a hash: take another one
            return removed_windows(packed, at, window, ids, starts, k, salt + 1)
    out[i] = (ids[i] > ids[j]) | (starts[i] > starts[j])
    return out


def _runs(window: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive windows with equal ``same``."""
    if not len(window):
        return np.zeros(0, int), np.zeros(0, int)
    cut = np.diff(window) != 1
    for x in same:
        cut |= x[1:] != x[:-1]
    cut = np.flatnonzero(cut)
    return np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(window) - 1]))


def _blob(arrays: list[np.ndarray]) -> tuple[bytes, int]:
    raw = b"".join([np.array([len(x) for x in arrays], dtype=np.int64).tobytes(), *[x.tobytes() for x in arrays]])
    return squeeze(raw), len(raw)


def _unblob(blob: bytes, size: int, kinds: list[type]) -> list[np.ndarray]:
    raw = unsqueeze(blob, size)
    sizes, at, out = raw[: 8 * len(kinds)].view(np.int64), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out


#: Of the two kinds of blob. Ids are stored as differences.
_STRINGS = [np.int64, np.int32, np.int32, np.int32, np.uint8]
_RANGES = [np.int64, np.int32, np.int32, np.int32]
_SENT = "bucket int, kind int, size long, blob binary"
_SETTLED = "id long, key int, lo int, hi int, size long, blob binary"


class Windows:
    """Windows of packed words: the first word of each, which row of ``ids`` and ``keys``
    it is of, and its place in the document."""

    def __init__(self, packed, at, window, of, place, ids, keys):
        self.packed, self.at, self.ids, self.keys = packed, at, ids, keys
        self.window, self.of, self.place = window, of, place

    @classmethod
    def of_blobs(cls, blobs: list[tuple[int, bytes]], k: int) -> Windows:
        parts = [_unblob(blob, size, _STRINGS) for size, blob in blobs]
        ids, keys, start, count, text = (np.concatenate(x) for x in zip(*[(np.cumsum(p[0]), *p[1:]) for p in parts], strict=True))
        at = np.concatenate(([0], np.flatnonzero(text == 0x20) + 1))
        begin = np.cumsum(count + k - 1) - (count + k - 1)
        of = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return cls(text, at, begin[of] + nth, of, start[of] + nth, ids, keys)

    def settle(self, k: int) -> tuple[np.ndarray, ...]:
        """Takes out the windows that occur earlier: (id, key, first, last) of their runs."""
        gone = removed_windows(self.packed, self.at, self.window, self.ids[self.of], self.place, k)
        a, b = _runs(self.window[gone], self.of[gone])
        of, place = self.of[gone], self.place[gone]
        self.window, self.of, self.place = (x[~gone] for x in (self.window, self.of, self.place))
        return self.ids[of[a]], self.keys[of[a]], place[a].astype(np.int32), place[b].astype(np.int32)

    def strings(self, k: int, buckets: int, turn: int) -> Iterator[tuple[int, bytes, int]]:
        """Bucket and blob of the super-k-mers."""
        width = min(k, MINIMISER + LONGER * turn)
        least = run_minima(run_hashes(word_hashes(self.packed, self.at, turn), width), k - width + 1)[self.window]
        a, b = _runs(self.window, self.of, least)
        target = (least[a] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(target[order]) != 0, [True]))) if len(order) else [0]
        lo, hi = self.at[self.window[a]], self.at[self.window[b] + k]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            s = order[x:y]
            size = hi[s] - lo[s]
            text = self.packed[np.arange(size.sum()) + np.repeat(lo[s] - (np.cumsum(size) - size), size)]
            of = self.of[a[s]]
            yield int(target[s[0]]), *_blob([np.diff(self.ids[of], prepend=0), self.keys[of], self.place[a[s]].astype(np.int32), (b[s] - a[s] + 1).astype(np.int32), text])


def _sent(windows: Windows, k: int, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    ids, keys, lo, hi = windows.settle(k)
    out = [(bucket, 0, size, blob) for bucket, blob, size in windows.strings(k, buckets, turn)]
    if len(ids):
        blob, size = _blob([np.diff(ids, prepend=0), keys, lo, hi])
        out.append((int(ids[0]) % buckets, 1, size, blob))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "size", "blob"])


def _send(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=MAP_BYTES):
            ids, keys = block.column(0).to_numpy(), block.column(1).to_numpy()
            order = np.argsort(ids, kind="stable")
            texts = block.column(2)
            if (np.diff(ids) < 0).any():
                ids, keys, texts = ids[order], keys[order], texts.take(pa.array(order))
            words = Words(*flat(texts))
            packed, at = words.pack()
            doc = np.repeat(np.arange(len(ids)), np.diff(words.first))
            window = np.flatnonzero(np.arange(len(doc)) + k <= words.first[doc + 1])
            if len(window):
                doc = doc[window]
                yield from _sent(Windows(packed, at, window, doc, (window - words.first[doc]).astype(np.int32), ids, keys), k, buckets, 0)

    return run


def _resend(k: int, buckets: int, turn: int):
    """Blobs (size, blob) of buckets that were too large, two at least in a lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for size, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(held) > 1 and total + size > BUCKET_BYTES:
                    yield from _sent(Windows.of_blobs(held, k), k, buckets, turn)
                    held, total = [], 0
                held.append((size, blob))
                total += size
        if held:
            yield from _sent(Windows.of_blobs(held, k), k, buckets, turn)

    return run


def _settle(k: int):
    def ranges(ids, keys, lo, hi):
        none = [pa.nulls(len(ids), t) for t in (pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), *none], names=["id", "key", "lo", "hi", "size", "blob"])

    def passed(blobs):
        none = [pa.nulls(len(blobs), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([*none, pa.array([s for s, _ in blobs], pa.int64()), pa.array([b for _, b in blobs], pa.binary())], names=["id", "key", "lo", "hi", "size", "blob"])

    def bucket(blobs):
        # What one block sent it has settled itself.
        if len(blobs) > 1:
            yield ranges(*Windows.of_blobs(blobs, k).settle(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, total, large = None, [], 0, False
        for batch in batches:
            for target, kind, size, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind:
                    ids, keys, lo, hi = _unblob(blob, size, _RANGES)
                    yield ranges(np.cumsum(ids), keys, lo, hi)
                    continue
                if target != now:
                    yield from bucket(held)
                    now, held, total, large = target, [], 0, False
                held.append((size, blob))
                total += size
                large = large or (total > BUCKET_BYTES and len(held) > 1)
                if large:
                    yield passed(held)
                    held = []
        yield from bucket(held)

    return run


def _kept(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(*flat(block.column(1)))
            packed, at = words.pack()
            first = words.first
            change = np.zeros(len(words) + 1, dtype=np.int64)
            found = block.column(2)
            inner = found.flatten()
            if len(inner):
                doc = np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy())
                np.add.at(change, first[doc] + inner.field(0).to_numpy(), 1)
                np.add.at(change, first[doc] + inner.field(1).to_numpy() + k, -1)
            kept = np.cumsum(change[:-1]) == 0
            n, some = np.diff(first), np.concatenate(([0], np.cumsum(kept)))
            left = some[first[1:]] - some[first[:-1]]
            size = np.diff(at)
            text = packed[np.repeat(kept, size)]
            ends = np.concatenate(([0], np.cumsum(size * kept)))[first]
            raw = text.tobytes()
            texts = [raw[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n.astype(np.int64)), pa.array((n - left).astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def earlier_ranges(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(id, key, lo, hi): starts of the removed windows of a document, as ranges."""
    n = partitions(docs.sparkSession)
    out, turn, buckets = None, 0, n * BUCKETS_A_PARTITION
    sent = docs.select("id", "key", "text").mapInArrow(_send(k, buckets), _SENT)
    while True:
        done = written(sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(k), _SETTLED))
        ranges = done.where("blob is null").select("id", "key", "lo", "hi")
        out = ranges if out is None else out.unionByName(ranges)
        rest = done.where("blob is not null").select("size", "blob")
        if rest.isEmpty():
            return out
        turn, buckets = turn + 1, min(1 << 30, buckets * SPREAD)
        sent = rest.mapInArrow(_resend(k, buckets, turn), _SENT)


def remove_repeats(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by one space)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("key"), text.alias("text"))
    found = earlier_ranges(keyed, k).groupBy("id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    return keyed.join(found, ["id", "key"], "left").select("doc_id", "text", "found").mapInArrow(_kept(k), "doc_id long, n_words long, n_removed long, kept string")


def op2_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
