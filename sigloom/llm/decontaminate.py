"""Benchmark decontamination: passages of documents within an edit distance of an item.

Texts are sequences of words (lower-cased, without ASCII punctuation); the distance is
Levenshtein's over words, and an item of n words is found where a passage is within
``RATE`` * n edits. A random walk embeds a window (CGK): at step j it emits the word it
stands on and moves on or stays by a random bit of that word and j, so that windows few
edits apart emit mostly equal words at equal steps. Windows are as long as the item: the
walk takes two steps a word. Each repetition has a walk of its own and samples
``SAMPLED`` of all its steps; equal samples make a candidate, which is verified exactly by
a fitting alignment of the whole item.

Lengths fall into classes, and each class has as many repetitions as find ``RECALL`` of
simulated items with all the edits allowed. Items beyond ``PIECE`` words are cut into
pieces: of an item within the bound one piece at least is within its own. A window is
only walked if it holds as many word pairs of items (of any of them) as the edits must
leave over: an edit breaks two pairs, so that loses nothing. Items of fewer than ``SHORT``
words allow no edit and are matched as they are.

Scale: documents are read once for each block of items (``ITEM_BYTES`` of text at most, or
one item; nothing else is sent to the tasks); there is no shuffle. Candidates of an item that
overlap are verified as one stretch, so repeated words cost no more than the stretch.

A null or empty text, of a document or an item, matches nothing. Equal items, and items
without an id, are each reported. Repeated rows are judged alike. Empty tables give empty
results; other columns are not used, and the stage returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Words, blocks, flat, mixed, run_hashes, table, whole, word_hashes

RATE = 0.2
SAMPLED, RECALL, MOST_REPEATS = 3, 0.998, 128
ITEM_BYTES = 8 << 20
SHORT, PIECE = 5, 48
#: Bits of the maps of word pairs, and of the keys after each sample.
PAIR_BITS, KEY_BITS = 22, 16


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text begins (and one more).
    ASCII punctuation is dropped, and words of nothing else with it."""
    data, offsets = flat(texts, lower=True)
    keep = (data - np.uint8(97) < 26) | (data - np.uint8(48) < 10) | (data >= 128) | (data == 0x20) | (data - np.uint8(9) < 5)
    words = Words(data[keep], np.concatenate(([0], np.cumsum(np.add.reduceat(np.concatenate((keep, [False])), offsets[:-1], dtype=np.int64) * (np.diff(offsets) > 0)))))
    size = words.end - words.start
    return word_hashes(words.data[words.inside], np.concatenate(([0], np.cumsum(size))), after=0), words.first


def length_classes() -> list[tuple[int, int]]:
    """Least and most words of the windows of each class."""
    out, lo = [], SHORT
    while lo <= PIECE:
        hi = min(PIECE, max(lo, lo * 6 // 5))
        out.append((lo, hi))
        lo = hi + 1
    return out


def pieces_of(n: int) -> list[tuple[int, int]]:
    """Where an item of n words is cut, into near equal parts."""
    k = -(-n // PIECE)
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def allowed(n):
    return np.floor(RATE * n + 1e-9).astype(np.int64)


def drawn(lo: int, repeats: int) -> list[tuple[np.uint64, list[int]]]:
    """Seed and sampled steps of each repetition of a class."""
    rng = np.random.default_rng(lo)
    return [(np.uint64(rng.integers(1, 1 << 63)), sorted(rng.choice(2 * lo, SAMPLED, replace=False).tolist())) for _ in range(repeats)]


def walked(words: np.ndarray, start: np.ndarray, seed: np.uint64, steps: list[int], passes) -> tuple[np.ndarray, np.ndarray]:
    """Which walks from ``start`` emit all samples, and the hash of these. ``words`` has
    room after the last start; ``passes(n, at, key, p)`` says which may go on after n."""
    at, p, key = np.arange(len(start)), start, np.zeros(len(start), dtype=np.uint64)
    n = 0
    for j in range(steps[-1] + 1):
        if j % 64 == 0:
            bits = mixed(words ^ (seed + np.uint64(j // 64)))
        if j == steps[n]:
            key = mixed(key * np.uint64(3) + words[p])
            ok = passes(n, at, key, p)
            at, p, key, n = at[ok], p[ok], key[ok], n + 1
        p = p + ((bits[p] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    return at, key


@cache
def plan(lo: int, hi: int, trials: int = 500) -> list[tuple[np.uint64, list[int]]]:
    """As many repetitions as find ``RECALL`` of random windows with all edits allowed."""
    rng, room = np.random.default_rng(1), 2 * lo + 2
    a, b = [], []
    for _ in range(trials):
        n = int(rng.integers(lo, hi + 1))
        own = rng.integers(1, 1 << 62, n).tolist()
        other = list(own)
        for _ in range(int(allowed(n))):
            kind, at = rng.integers(3), int(rng.integers(len(other)))
            other[at : at + (kind != 1)] = [int(rng.integers(1, 1 << 62))] * int(kind != 2)
        a.append((own + [0] * room)[: n + room])
        b.append(other + rng.integers(1, 1 << 62, room).tolist())
    starts = [np.cumsum([0, *map(len, x[:-1])]) for x in (a, b)]
    words = [np.array([w for x in side for w in x] + [0] * room, dtype=np.uint64) for side in (a, b)]
    found, out = np.zeros(trials, dtype=bool), []
    for seed, steps in drawn(lo, MOST_REPEATS):
        out.append((seed, steps))
        keys = [walked(w, s, seed, steps, lambda n, at, key, p: np.ones(len(at), dtype=bool))[1] for w, s in zip(words, starts, strict=True)]
        found |= keys[0] == keys[1]
        if found.mean() >= RECALL:
            break
    return out


def _bitmap(keys: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, dtype=bool)
    out[keys >> np.uint64(64 - bits)] = True
    return np.packbits(out)


def _in(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    return np.unpackbits(bitmap).view(bool)[keys >> np.uint64(64 - bits)]


class Items:
    """A block of items: distinct sequences, whose items they are, and the keys of their
    pieces for each class and repetition."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        self.ids = ids
        self.words, self.first = sequences(texts)
        size = np.diff(self.first)
        seen: dict[bytes, int] = {}
        own = [seen.setdefault(self.words[a:b].tobytes(), len(seen)) for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)]
        _, self.rep = np.unique(np.array(own, dtype=np.int64), return_index=True)
        order = np.argsort(own, kind="stable")
        self.members = np.split(order, np.cumsum(np.bincount(own, minlength=len(seen)))[:-1]) if len(seen) else []
        cut = [(u, a, b) for u, i in enumerate(self.rep.tolist()) if size[i] >= SHORT for a, b in pieces_of(int(size[i]))]
        piece = np.array(cut, dtype=np.int64).reshape(-1, 3)
        length = piece[:, 2] - piece[:, 1]
        padded = np.concatenate((self.words, np.zeros(2 * PIECE + 2, np.uint64)))
        of = np.repeat(np.arange(len(size)), size)
        pair = np.flatnonzero(of[:-1] == of[1:])
        self.pairs = _bitmap(run_hashes(self.words, 2)[pair], PAIR_BITS)
        self.classes = []
        for lo, hi in length_classes():
            mine = piece[(length >= lo) & (length <= hi)]
            if not len(mine):
                continue
            begin = self.first[self.rep[mine[:, 0]]]
            start, end, tables = begin + mine[:, 1], begin + mine[:, 2], []
            for seed, steps in plan(lo, hi):
                stages: list[np.ndarray] = []

                def passes(n, at, key, p, end=end, stages=stages):
                    stages.append(_bitmap(key, KEY_BITS))
                    return p < end[at]

                at, key = walked(padded, start, seed, steps, passes)
                order = np.argsort(key, kind="stable")
                tables.append((seed, steps, stages, key[order], mine[at[order], 0], mine[at[order], 1]))
            n = np.arange(lo, hi + 1)
            self.classes.append((lo, int((n + allowed(n)).max()), int((n - 1 - 2 * allowed(n)).min()), tables))
        self.short = {}
        for n in range(1, SHORT):
            u = np.flatnonzero(size[self.rep] == n)
            if len(u):
                keys = run_hashes(self.words, n)[self.first[self.rep[u]]]
                order = np.argsort(keys, kind="stable")
                self.short[n] = (keys[order], u[order])

    def candidates(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows by their first word, the sequence's number, and the place in it that
        the window begins at."""

        def found(keys, sorted_keys, where, what, offset):
            lo, hi = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, side="right")
            n = hi - lo
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
            return np.repeat(where, n), what[at], offset[at]

        known = np.concatenate(([0], np.cumsum(_in(self.pairs, run_hashes(words, 2), PAIR_BITS), dtype=np.int32))) if len(words) > 1 else np.zeros(1, np.int32)
        for lo, most, least, tables in self.classes:
            if len(words) < 2:
                break
            # Pairs begin at the window's words but the last.
            held = known[np.minimum(np.arange(len(words)) + most - 1, len(words) - 1)] - known
            start = np.flatnonzero(held >= least)
            if not len(start):
                continue
            # Only words within reach of some walk are looked at.
            change = np.zeros(len(words) + 2 * lo + 3, dtype=np.int32)
            change[start] += 1
            change[start + 2 * lo + 2] -= 1
            reach = np.cumsum(change)[:-1] > 0
            near = np.concatenate((words, np.zeros(2 * lo + 2, np.uint64)))[reach]
            begin = (np.cumsum(reach) - 1)[start]
            for seed, steps, stages, keys, what, offset in tables:
                at, key = walked(near, begin, seed, steps, lambda n, at, key, p, stages=stages: _in(stages[n], key, KEY_BITS))
                yield found(key, keys, start[at], what, offset)
        for n, (keys, mine) in self.short.items():
            h = run_hashes(words, n)
            at = np.flatnonzero(np.isin(h, keys))
            yield found(h[at], keys, at, mine, np.zeros(len(mine), dtype=np.int64))

    def stretches(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, sequence, begin, end) of where a sequence may lie: candidates of one
        document and sequence that overlap are one."""
        held = [np.zeros((0, 4), dtype=np.int64)]
        size = np.diff(self.first)[self.rep]
        for where, what, offset in self.candidates(words):
            if len(where):
                doc = np.searchsorted(first, where, side="right") - 1
                most = allowed(size[what])
                a = np.maximum(where - offset - most, first[doc])
                b = np.minimum(where - offset + size[what] + most, first[doc + 1])
                held.append(np.unique(np.stack([doc, what, a, b], axis=1)[b > a], axis=0))
        all_ = np.unique(np.concatenate(held), axis=0)
        if not len(all_):
            return tuple(all_.T)
        doc, what, a, b = all_.T
        # Within a document and sequence begins are sorted, and so are ends.
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (what[1:] != what[:-1]) | (a[1:] > b[:-1])))
        head = np.flatnonzero(new)
        return doc[head], what[head], a[head], np.maximum.reduceat(b, head)


def fitting(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits that turn the item into a stretch of each passage (rows), and where the
    first such stretch ends."""
    places = np.arange(passages.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(passages), len(places)), dtype=np.int32)
    for i, x in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, :-1] + (passages != np.uint64(x)), row[:, 1:] + 1, out=new[:, 1:])
        # A word of the passage that the item lacks costs one more than the place before.
        row = np.minimum.accumulate(new - places, axis=1) + places
    return row.min(axis=1), row.argmin(axis=1)


def _match(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.__new__(Items)
        items.__dict__.update(held.value)
        for block in blocks(batches):
            words, first = sequences(block.column(1))
            doc, what, a, b = items.stretches(words, first)
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            order = np.lexsort((b - a, what))
            edge = np.flatnonzero(np.concatenate(([True], np.diff(what[order]) != 0, [True]))) if len(order) else [0]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                u = int(what[order[lo]])
                target = items.words[items.first[items.rep[u]] : items.first[items.rep[u] + 1]]
                most = int(allowed(len(target)))
                while lo < hi:
                    # Stretches of about one length together, a million places at most.
                    n = max(1, min(hi - lo, (1 << 20) // int((b - a)[order[min(lo + 255, hi - 1)]]), 256))
                    s, lo = order[lo : lo + n], lo + n
                    wide = int((b - a)[s].max())
                    at = a[s][:, None] + np.arange(wide)
                    passages = np.where(at < b[s][:, None], words[np.minimum(at, len(words) - 1)], np.uint64(0))
                    edits, end = fitting(target, passages)
                    for k in np.flatnonzero(edits <= most).tolist():
                        key, value = (int(doc[s[k]]), u), (int(edits[k]), int(a[s[k]] + end[k] - first[doc[s[k]]]), len(target))
                        found[key] = min(found.get(key, value), value)
            # Every item of a sequence is reported.
            rows = [(d, i, v) for (d, u), v in found.items() for i in items.members[u].tolist()]
            if rows:
                columns = [block.column(0).take(pa.array([d for d, _, _ in rows])), items.ids.take(pa.array([i for _, i, _ in rows]))]
                columns += [pa.array([v[c] for _, _, v in rows], pa.int64()) for c in range(3)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "edits", "end_word", "item_words"])

    return run


def matches(docs: DataFrame, items: DataFrame, block: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, edits, end_word (place after the passage's last word, counted in
    normalised words), item_words: one row for each row of ``docs`` and item found in it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("length(text) > 0")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Half full on average, as items fall to blocks by a hash.
    blocks_ = -(-2 * size // block) if size > block else int(size > 0)
    out = None
    for k in range(blocks_):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks_)) == k).orderBy("item_id", "text").toArrow()
        held = spark.sparkContext.broadcast(vars(Items(part["item_id"].combine_chunks(), part["text"].combine_chunks())))
        found = rows.mapInArrow(_match(held), "doc_id long, item_id long, edits long, end_word long, item_words long")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "doc_id long, item_id long, edits long, end_word long, item_words long") if out is None else out


def op6_cgk_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an item go. Rows are told apart by a hash of
    their id and text."""
    keyed = docs.select(whole(docs), F.xxhash64("doc_id", "text").alias("key"), "text")
    found = matches(keyed.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")
