"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A token's probability is P(class | context) P(token | class). Classes come from a word's
last three bytes; the end of a text is a class of its own. P(class | context) is a
softmax over hashed features of the context: the word before, the word two before (a
skip feature) and both together. Within a class a word is found digit by digit of its
hash: P(digit | class, digits before, context) is a softmax as well, over features of the
same contexts with the class and the digits before, around the words' shares of it. Words
that share class and all ``DEPTH`` digits, a leaf, have their smoothed shares of the leaf.

Training covers every training document. One pass counts each feature with each class
and digit (the observed half of the gradient, and a start for the weights of classes);
each further pass takes the model's expectations in sparse numpy blocks, and the weights
move along the gradient, observed minus expected, scaled by both. A training task takes
``GROUP`` scan partitions and returns one sum a feature table, whatever its rows; the sums
meet by slices of the tables, in rounds of ``FAN`` tasks. The model is eight megabytes,
whatever the input: at large inputs contexts share entries.

Token counts are exact and no vocabulary is ever in one place: each block of texts sends
its distinct words, compressed, to buckets of their hash; a bucket adds up the training
counts and answers with one count a word, in the order sent; the block's tokens, as
numbers, meet the answers in one join. What travels grows with the input.

A null text is empty: one token, its end. Repeated rows, and whole tables united with
themselves, are scored alike, one result a row; rows with one id and different texts
each by their own. A null doc_id counts as the empty text for the fold. Without training documents
all counts are zero. Empty tables give empty results; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Words, blocks, flat, fold, hashes_at, mixed, partitions, squeeze, table, unsqueeze, word_hashes, written

FOLDS, HELD_OUT = 5, 1
CLASSES = 32
TABLES, TABLE_BITS = 3, 12
#: Digits of a word within its class, how many each can be, and bits of their tables.
DEPTH, DIGITS, DIGIT_BITS = 2, 16, 14
LEAVES = DIGITS**DEPTH
UPDATES = 2
#: Pseudo-counts of a context at the start, the share of its evidence that one feature
#: takes, pseudo-counts of a step, and the step's length.
PRIOR, SHARE, DAMP, RATE = 300, 0.6, 50, 0.9
#: The last two for digits, which start at their node's shares.
DIGIT_DAMP, DIGIT_RATE = 50, 1.2
MAP_BYTES = 8 << 20
BUCKETS_A_PARTITION = 8
SLICES = 48
#: Scan partitions of a training task (fewer where cores would idle), and tasks whose sums
#: meet in one place.
GROUP, FAN = 8, 512
#: Bytes of text whose tokens are made at once, and tokens whose chances are made and added
#: up at once: small enough for a core's cache. Tokens whose chances are added up in single
#: precision before they go into double precision.
MODEL_BYTES, STEP, SPAN = 1 << 19, 1 << 12, 1 << 17
#: For each digit what it adds to the hashes of a context, by node.
SALTS = [mixed((np.arange(CLASSES * DIGITS**j) + (j + 1 << 32)).astype(np.uint64)) for j in range(DEPTH)]


def classes_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The class of each word of ``data``; never the last one, the end's."""
    # Eight bytes that end with a word's last, which is the lowest of them as a big-endian number.
    ends = np.ndarray(len(data) + 1, dtype=">u8", buffer=np.concatenate((np.zeros(8, dtype=np.uint8), data)), strides=(1,))
    code = ends[start + size].astype(np.uint64) & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], dtype=np.uint64)[np.minimum(size, 3)]
    return (mixed(code) >> np.uint64(40)).astype(np.int64) % (CLASSES - 1)


def leaves_of(classes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The leaf of each word from its class and hash."""
    return classes * LEAVES + ((mixed(hashes ^ np.uint64(0x77)) >> np.uint64(32)) % np.uint64(LEAVES)).astype(np.int64)


class Tokens:
    """Tokens of a block of texts, each text's words and its end: hashed features of
    their contexts, and their classes and leaves. Text d has tokens first[d]:first[d + 1];
    ``words`` are those that are no end, ``levels`` the nodes, digits and features of
    these for each digit."""

    def __init__(self, texts: pa.Array):
        words = Words(*flat(texts, lower=True))
        size = words.end - words.start
        hashes = hashes_at(words.data, words.start, size)
        n, count = len(words.first) - 1, np.diff(words.first)
        doc = np.repeat(np.arange(n), count + 1)
        self.first = words.first + np.arange(n + 1)
        self.words = np.arange(len(words)) + np.repeat(np.arange(n), count)
        before = np.full(len(words) + 2 * n, 0x1234567, dtype=np.uint64)
        at = np.arange(len(doc)) + doc
        before[at[self.words] + 2] = hashes
        one, two = before[at + 1], before[at]
        contexts = [one, two ^ np.uint64(0x5555), one * np.uint64(3) + two]
        self.features = [(mixed(x) >> np.uint64(64 - TABLE_BITS)).view(np.int64) for x in contexts]
        self.classes = np.full(len(doc), CLASSES - 1)
        self.classes[self.words] = classes_of(words.data, words.start, size)
        self.own = own = leaves_of(self.classes[self.words], hashes)
        contexts = [x[self.words] for x in contexts]
        self.levels, node = [], own // LEAVES
        for j, salts in enumerate(SALTS):
            salt, child = salts[node], own // DIGITS ** (DEPTH - j - 1)
            self.levels.append((node, child - node * DIGITS, [(mixed(x ^ salt) >> np.uint64(64 - DIGIT_BITS)).view(np.int64) for x in contexts]))
            node = child

    @property
    def leaves(self) -> np.ndarray:
        out = self.classes * LEAVES
        out[self.words] = self.own
        return out


def factors_of(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Exponentials of the weights, so that a context's unnormalised chances are products
    of rows; the bias goes with the first table. Weights are kept within 20 of zero,
    which single precision can multiply."""
    out = np.clip(weights, -20, 20)
    out[0] += np.clip(bias, -20, 0)
    return np.exp(out).astype(np.float32)


def multiplied(z: np.ndarray, factors: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised chances ``z`` times the features' rows of their tables, and the sums."""
    rows = np.empty_like(z)
    for f, at in zip(factors, features, strict=True):
        # No feature is out of range; "clip" spares numpy a copy.
        z *= np.take(f, at, axis=0, out=rows, mode="clip")
    return z, z @ np.ones(z.shape[1], dtype=np.float32)


def products(factors: np.ndarray, features: list[np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised chances of the classes for tokens lo:hi, and their sums."""
    return multiplied(np.take(factors[0], features[0][lo:hi], axis=0), factors[1:], [f[lo:hi] for f in features[1:]])


def digit_products(prior: np.ndarray, factors: np.ndarray, node: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised chances of the digits of tokens, by their nodes' prior and their
    features, and the sums."""
    return multiplied(np.take(prior, node, axis=0), factors, features)


def digit_chances(prior: np.ndarray, factors: np.ndarray, node: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Chances of the digits of tokens."""
    z, total = digit_products(prior, factors, node, features)
    z /= total[:, None]
    return z


class Sums:
    """Sums of tokens' chances by table and entry. Within ``SPAN`` tokens two outcomes go as
    one complex number of single precision, which halves both the additions and the memory
    that they hit at random."""

    def __init__(self, entries: int, outcomes: int):
        self.total = np.zeros((TABLES, entries, outcomes))
        self.near = np.zeros(self.total.shape, dtype=np.float32)
        self.tokens = 0

    def add(self, features: list[np.ndarray], chances: np.ndarray) -> None:
        pairs = chances.view(np.complex64)
        for table_, f in zip(self.near.view(np.complex64), features, strict=True):
            for d in range(pairs.shape[1]):
                np.add.at(table_[:, d], f, pairs[:, d])
        self.tokens += len(chances)
        if self.tokens >= SPAN:
            self.settled()

    def settled(self) -> np.ndarray:
        self.total += self.near
        self.near[:] = 0
        self.tokens = 0
        return self.total


def priors(mass: np.ndarray) -> list[np.ndarray]:
    """For each digit the shares of a node's children, from the mass of the leaves."""
    out = []
    for j in range(DEPTH):
        m = mass.reshape(CLASSES * DIGITS**j, DIGITS, -1).sum(axis=2)
        out.append((m / m.sum(axis=1, keepdims=True)).astype(np.float32))
    return out


#: Entries of the class tables, and of the tables of one digit.
CLASS_SIZE, DIGIT_SIZE = TABLES * (CLASSES << TABLE_BITS), TABLES * (DIGITS << DIGIT_BITS)


def _sent(sums: np.ndarray) -> pa.RecordBatch:
    """Slices of a task's sums, in single precision on the way."""
    group = (TaskContext.get().partitionId() if TaskContext.get() else 0) // FAN
    flat_ = np.array_split(sums.astype(np.float32), SLICES)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(np.full(SLICES, group, np.int32)), pa.array([squeeze(x.tobytes(), 1) for x in flat_], pa.binary())], names=["slice", "part", "sums"])


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of features with classes and with digits."""
    sums = [np.zeros(CLASSES << TABLE_BITS) for _ in range(TABLES)] + [np.zeros(DIGITS << DIGIT_BITS) for _ in range(DEPTH * TABLES)]
    held: list[list[np.ndarray]] = []

    def settle() -> None:
        for into, keys in zip(sums, zip(*held, strict=True), strict=False):
            into += np.bincount(np.concatenate(keys), minlength=len(into))
        held.clear()

    for b in blocks(batches, limit=MODEL_BYTES):
        t = Tokens(b.column(0))
        held.append([f * CLASSES + t.classes for f in t.features] + [f * DIGITS + digit for _, digit, features in t.levels for f in features])
        if sum(len(x[0]) for x in held) >= 4 * SPAN:
            settle()
    settle()
    yield _sent(np.concatenate(sums))


def _expect(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, factors, digit_factors = held.value
        sums = Sums(1 << TABLE_BITS, CLASSES)
        digits = [Sums(1 << DIGIT_BITS, DIGITS) for _ in range(DEPTH)]
        for b in blocks(batches, limit=MODEL_BYTES):
            t = Tokens(b.column(0))
            for lo in range(0, len(t.classes), STEP):
                z, total = products(factors, t.features, lo, lo + STEP)
                z /= total[:, None]
                sums.add([f[lo : lo + STEP] for f in t.features], z)
            for j, (node, _, features) in enumerate(t.levels):
                for lo in range(0, len(node), STEP):
                    part = [f[lo : lo + STEP] for f in features]
                    digits[j].add(part, digit_chances(prior[j], digit_factors[j], node[lo : lo + STEP], part))
        yield _sent(np.concatenate([x.settled().ravel() for x in (sums, *digits)]))

    return run


def _add(n: int):
    """The sum of each slice's rows (slice, part, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                size = 4 * len(np.array_split(np.empty(n, np.uint8), SLICES)[k])
                x = unsqueeze(blob.as_py(), size).view(np.float32)
                if k in total:
                    total[k] += x
                else:
                    total[k] = x.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([squeeze(x.astype(np.float32).tobytes(), 1) for x in total.values()], pa.binary())], names=["slice", "part", "sums"])

    return run


_SUMS = "slice int, part int, sums binary"


def summed(texts: DataFrame, task, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of what ``task`` finds in all texts, ``n`` numbers: of the classes as (table,
    entry, class), of the digits as (.., table, entry, digit)."""
    spark = texts.sparkSession
    parts = texts.rdd.getNumPartitions()
    tasks = max(1, min(parts, 2 * spark.sparkContext.defaultParallelism), -(-parts // GROUP))
    sums, slices = texts.coalesce(tasks).mapInArrow(task, _SUMS), min(SLICES, partitions(spark))
    if tasks > FAN:
        sums = sums.repartition(slices * -(-tasks // FAN), "slice", "part").mapInArrow(_add(n), _SUMS)
    out = np.zeros(n)
    cuts = np.array_split(np.arange(n), SLICES)
    for k, _, x in sums.repartition(slices, "slice").mapInArrow(_add(n), _SUMS).toLocalIterator():
        out[cuts[k]] = unsqueeze(bytes(x), 4 * len(cuts[k])).view(np.float32)
    return out[:CLASS_SIZE].reshape(TABLES, 1 << TABLE_BITS, CLASSES), out[CLASS_SIZE:].reshape(-1, TABLES, 1 << DIGIT_BITS, DIGITS)


def trained(texts: DataFrame, mass: np.ndarray, updates: int = UPDATES) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """The priors of the digits, the class model and the models of the digits (see
    factors_of: table, entry, outcome), from rows (text) and the mass of the leaves."""
    prior = priors(mass)
    observed, seen = summed(texts, _observe, CLASS_SIZE + DEPTH * DIGIT_SIZE)
    share = observed[0].sum(axis=0) + 0.5
    share /= share.sum()
    bias = np.log(share)
    rows = observed.sum(axis=2, keepdims=True)
    weights = np.log((observed + PRIOR * share) / ((rows + PRIOR) * share)) * SHARE
    inner = np.zeros_like(seen)

    def model():
        return prior, factors_of(weights, bias), [factors_of(x, np.zeros(DIGITS)) for x in inner]

    for _ in range(updates):
        held = texts.sparkSession.sparkContext.broadcast(model())
        expected, digits = summed(texts, _expect(held), CLASS_SIZE + DEPTH * DIGIT_SIZE)
        weights += RATE * (observed - expected) / ((observed + expected) / 2 + DAMP)
        inner += DIGIT_RATE * (seen - digits) / ((seen + digits) / 2 + DIGIT_DAMP)
        held.unpersist()
    return model()


# -- exact counts of words ----------------------------------------------------------

_ROW = "chunk long, kind int, bucket int, sizes array<long>, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "kind", "bucket", "sizes", "blob"])


def _send(buckets: int):
    """Of each block: its tokens as numbers (kind 0) and, for each bucket, its distinct
    words with their training counts (kind 1). Numbers follow the order of sending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=MAP_BYTES):
            ids, train, texts = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            data, offsets = flat(texts, lower=True)
            # The place of a block's first row is its own, whatever repeats in the table.
            chunk = b.column(3)[0].as_py()
            words = Words(data, offsets)
            coded = words.binary().dictionary_encode()
            number, distinct = coded.indices.to_numpy(), coded.dictionary
            count = np.diff(words.first)
            seen = np.bincount(number[np.repeat(train, count)], minlength=len(distinct)).astype(np.int32)
            at = byte_starts(distinct)
            packed = np.full(at[-1], 0x0A, dtype=np.uint8)
            keep = np.ones(at[-1], dtype=bool)
            keep[at[1:] - 1] = False
            packed[keep] = np.frombuffer(distinct.buffers()[2], dtype=np.uint8)[: keep.sum()] if len(distinct) else 0
            target = (word_hashes(packed, at) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(target, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            doc = np.repeat(np.arange(len(ids)), count)
            key = np.sort(doc << 32 | place[number])
            raw = [np.diff(ids, prepend=0).tobytes(), b.column(4).to_numpy().tobytes(), count.astype(np.int32).tobytes(), np.diff(key & 0xFFFFFFFF, prepend=0).astype(np.int32).tobytes()]
            out = [(chunk, 0, int(mixed(np.array([chunk], np.uint64))[0] % np.uint64(buckets)), [len(ids), len(key)], squeeze(b"".join(raw)))]
            edges = np.flatnonzero(np.concatenate(([True], np.diff(target[order]) != 0, [True]))) if len(order) else [0]
            size = np.diff(at)
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                s = order[x:y]
                text = packed[np.arange(size[s].sum()) + np.repeat(at[s] - (np.cumsum(size[s]) - size[s]), size[s])]
                out.append((chunk, 1, int(target[s[0]]), [len(s), len(text)], squeeze(seen[s].tobytes() + text.tobytes())))
            yield _rows(out)

    return run


def byte_starts(words: pa.Array) -> np.ndarray:
    """Where each word begins when one byte follows each."""
    at = np.frombuffer(words.buffers()[1], dtype=np.int32)[: len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    return at + np.arange(len(at))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0 passes; words of a bucket are answered with their counts (kind 1); tokens
    and distinct tokens by leaf of the whole task come last (kind 2)."""
    total = np.zeros((2, CLASSES * LEAVES), dtype=np.int64)

    def answer(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        raws = [unsqueeze(blob, 4 * n + size) for _, _, (n, size), blob in held]
        seen = np.concatenate([r[: 4 * n].view(np.int32) for r, (_, _, (n, _), _) in zip(raws, held, strict=True)])
        text = np.concatenate([r[4 * n :] for r, (_, _, (n, _), _) in zip(raws, held, strict=True)])
        ends = np.flatnonzero(text == 0x0A)
        starts = np.zeros(len(ends) + 1, dtype=np.int32)
        np.cumsum(np.diff(ends, prepend=-1) - 1, out=starts[1:])
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(text[text != 0x0A]))])
        number = words.dictionary_encode().indices.to_numpy()
        count = np.bincount(number, weights=seen).astype(np.int64)
        _, where = np.unique(number, return_index=True)
        at = np.concatenate(([0], ends + 1))
        kind = leaves_of(classes_of(text, at[:-1], np.diff(at) - 1), word_hashes(text, at))[where]
        total[0] += np.bincount(kind, weights=count, minlength=CLASSES * LEAVES).astype(np.int64)
        total[1] += np.bincount(kind, weights=count > 0, minlength=CLASSES * LEAVES).astype(np.int64)
        out, at = [], 0
        for chunk, bucket, (n, _), _ in held:
            out.append((chunk, 1, bucket, [n], squeeze(count[number[at : at + n]].tobytes())))
            at += n
        yield _rows(out)

    now, held = None, []
    for batch in batches:
        for chunk, kind, bucket, sizes, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind == 0:
                yield _rows([(chunk, 0, -1, sizes, blob)])
                continue
            if bucket != now:
                yield from answer(held)
                now, held = bucket, []
            held.append((chunk, bucket, sizes, blob))
    yield from answer(held)
    yield _rows([(0, 2, 0, total.ravel().tolist(), b"")])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all rows (sizes), none for no rows."""
    rows = [b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).sum(axis=0) for b in batches if b.num_rows]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([sum(rows)], pa.list_(pa.int64()))], names=["sizes"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text: its number of words, of known ones, and the sum of log10(c + 0.5)."""

    def solve(doc, answers):
        (n, tokens), blob = doc
        raw = unsqueeze(blob, 8 * n + 4 * n + 4 * n + 4 * tokens)
        ids, keys = np.cumsum(raw[: 8 * n].view(np.int64)), raw[8 * n : 12 * n].view(np.int32)
        count, number = raw[12 * n : 16 * n].view(np.int32), np.cumsum(raw[16 * n :].view(np.int32).astype(np.int64))
        c = np.concatenate([np.zeros(0, np.int64), *[unsqueeze(b, 8 * k).view(np.int64) for k, b in answers]])
        of = np.repeat(np.arange(n), count)
        known = np.bincount(of, weights=(c > 0)[number], minlength=n).astype(np.int64)
        logs = np.bincount(of, weights=np.log10(c + 0.5)[number], minlength=n)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, keys, count.astype(np.int64), known, logs)], names=["id", "key", "n_words", "known", "logs"])

    doc, answers = None, []
    for batch in batches:
        for _, kind, _, sizes, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind == 0:
                if doc:
                    yield solve(doc, answers)
                doc, answers = (sizes, blob), []
            else:
                answers.append((sizes[0], blob))
    if doc:
        yield solve(doc, answers)


def _score(held, spread: np.ndarray):
    """Of each text: the sum of log10 P(leaf | context) / (tokens of the leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, factors, digit_factors = held.value
        for b in blocks(batches, limit=MODEL_BYTES):
            t = Tokens(b.column(2))
            each = np.empty(len(t.classes))
            for lo in range(0, len(each), STEP):
                hi = min(lo + STEP, len(each))
                z, total = products(factors, t.features, lo, hi)
                each[lo:hi] = z[np.arange(hi - lo), t.classes[lo:hi]].astype(np.float64) / total
            for j, (node, digit, features) in enumerate(t.levels):
                for lo in range(0, len(node), STEP):
                    hi = min(lo + STEP, len(node))
                    z, total = digit_products(prior[j], digit_factors[j], node[lo:hi], [f[lo:hi] for f in features])
                    each[t.words[lo:hi]] *= z[np.arange(hi - lo), digit[lo:hi]].astype(np.float64) / total
            each = np.log10(each) - spread[t.leaves]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.add.reduceat(each, t.first[:-1]))], names=["id", "key", "context"])

    return run


NO_ID = -(1 << 63)


def scored(docs: DataFrame, train) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score. ``train``: a column that says which documents to learn from."""
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), train.alias("train"), text.alias("text"), key.alias("key"))
    sent = keyed.select("id", "train", "text", F.monotonically_increasing_id().alias("row"), "key").mapInArrow(_send(n * BUCKETS_A_PARTITION), _ROW)
    counted = written(sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, _ROW))
    total = np.zeros((2, CLASSES * LEAVES))
    # Eight rows, whatever the input.
    for (sizes,) in counted.where("kind = 2").select("sizes").repartition(8).mapInArrow(_totals, "sizes array<long>").collect():
        total += np.array(sizes).reshape(total.shape)
    ends = keyed.where("train").count()
    total[:, (CLASSES - 1) * LEAVES] = ends, min(ends, 1)
    tokens, distinct = total.sum(axis=1)
    mass = total[0] + 0.5 * (total[1] + 1)
    met = counted.where("kind < 2").repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(_meet, "id long, key int, n_words long, known long, logs double")
    held = spark.sparkContext.broadcast(trained(keyed.where("train").select("text"), mass))
    context = keyed.select("id", "key", "text").mapInArrow(_score(held, np.log10(mass)), "id long, key int, context double").dropDuplicates(["id", "key"])
    out = met.join(context, ["id", "key"])
    end = float(np.log10(ends + 0.5))
    base = F.col("logs") + end - (F.col("n_words") + 1) * float(np.log10(tokens + 0.5 * (distinct + 1)))
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("logs") + end + F.col("context")).alias("score"),
    ).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)


def op10_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
