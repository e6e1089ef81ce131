"""Language of each document by a linear-chain conditional random field over its words.

A word's emission is a sum of hashed weights: of its affixes and inner n-grams (two to
four bytes, word ends marked) and of the whole word (the lexicon). Transitions between
the labels of neighbouring words are learned as well, so a passage in another language
keeps its own label. Forward-backward gives each word's posterior; a document's label
is the one with most letters in expectation, its score that share of the letters.

Fitting uses at most about ``SAMPLE_DOCS`` distinct labelled texts a language (those with
the least hashes, so any size of corpus gives the same sample size), of a long text a
stretch of ``STRETCH`` characters, and the ``MOST_LABELS`` languages with most distinct
texts. Half of the texts stay whole, the other half are spliced: runs of their words in
random order, so that switches between languages are seen with their truth. Emissions
and transitions move along the same gradient, observed minus expected by forward-backward.
After one round a word that the model firmly places elsewhere takes that label.

Scale: one pass over the texts to count and one to pick the sample, then one to
predict; the model is a few megabytes whatever the input. Chains longer than ``PIECE``
words are cut into pieces that overlap by ``OVERLAP`` words on each side; a word's
posterior comes from the piece it is not at the rim of.

A null text, or one without a letter, is ``und`` with score 0; with no labelled text at
all every text is. Ties go to the label that sorts first. Repeated rows are judged
alike. Empty tables give empty results; other columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import Words, blocks, flat, fold, stretch, table, whole, word_hashes

FOLDS, HELD_OUT = 5, 0
SAMPLE_DOCS, STRETCH, MOST_LABELS = 250, 20_000, 64
#: Mean words of a run of spliced text.
RUN = 12
TABLE_BITS = 17
PIECE, OVERLAP = 512, 48
EPOCHS = 3
#: Documents of which no language holds this share are rejected by the pipeline.
LEAST_SHARE = 0.4

#: ASCII letters and all bytes of other characters; the rest of ASCII is dropped.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


class Spelled:
    """Letters of a block's words, lower-cased, and hashed features.

    at: where word i's bytes begin in ``code`` (one byte before and after it mark its
    ends); letters: how many bytes it has left; first: see Words."""

    def __init__(self, texts: pa.Array, bits: int = TABLE_BITS):
        data, offsets = flat(texts, lower=True)
        data = data.copy()
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        data[capital] += 0x20
        words = Words(data, offsets)
        packed, at = words.pack()
        keep = _LETTER[packed]
        keep[at[1:] - 1] = True
        some = np.concatenate(([0], np.cumsum(keep)))
        self.at, self.first = some[at], words.first
        packed = packed[keep]
        self.letters = np.diff(self.at) - 1
        self.features = []
        self.lexicon = (word_hashes(packed, self.at) >> np.uint64(64 - bits)).astype(np.int64) if len(words) else np.zeros(0, int)
        code = np.concatenate((np.full(3, 0x20, np.uint8), packed)).astype(np.uint32)
        back = np.arange(len(packed)) - np.repeat(self.at[:-1], np.diff(self.at))
        value = code[3:]
        for n in (2, 3, 4):
            value = value | code[4 - n : len(code) - n + 1] << np.uint32(8 * (n - 1))
            hashed = (value * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)
            # An n-gram may take the mark before the word in, but no more; the last table
            # entry is always zero.
            self.features.append(np.where((back + 2 >= n) & ((back > 0) | (n == 2)), hashed, (1 << bits)).astype(np.int64))

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """weights: (tables, entries + 1, labels)."""
        k = weights.shape[2]
        out = weights[3][self.lexicon] * (self.letters > 0)[:, None]
        step = 1 << 14
        for lo in range(0, len(self.letters), step):
            hi = min(lo + step, len(self.letters))
            a, b = self.at[lo], self.at[hi]
            s = np.zeros((b - a, k), dtype=np.float32)
            for t, f in enumerate(self.features):
                s += weights[t][f[a:b]]
            sums = np.add.reduceat(s, self.at[lo:hi] - a, axis=0)
            sums[self.letters[lo:hi] == 0] = 0
            out[lo:hi] += sums
        return out


def pieces(first: np.ndarray, size: int = PIECE, overlap: int = OVERLAP) -> tuple[np.ndarray, ...]:
    """Begin and end of each piece of the chains, and of the core it answers for."""
    n = np.diff(first)
    count = -(-n // size)
    chain = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
    core = first[chain] + nth * size
    core_end = np.minimum(core + size, first[chain + 1])
    return np.maximum(core - overlap, first[chain]), np.minimum(core_end + overlap, first[chain + 1]), core, core_end


def posteriors(emissions: np.ndarray, turn: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains begin:end. Posteriors laid out chain by chain, the
    words they belong to, and the expected number of each transition."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    off = np.cumsum(size) - size
    word = np.arange(size.sum()) - np.repeat(off - begin, size)
    e = emissions[word]
    e = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    k = e.shape[1]
    forward, backward = np.empty_like(e), np.empty_like(e)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else []
    state = np.full((len(size), k), 1 / k, dtype=np.float32)
    for t, n in enumerate(active):
        at = off[:n] + t
        state = (state[:n] @ turn if t else state[:n]) * e[at]
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    state = np.zeros((0, k), dtype=np.float32)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = off[:n] + t
        m = len(state)
        now = np.full((n, k), 1 / k, dtype=np.float32)
        if m:
            now[:m] = (state * e[at[:m] + 1]) @ turn.T
            now[:m] /= now[:m].sum(axis=1, keepdims=True)
        backward[at] = state = now
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    inner = np.ones(len(e), dtype=bool)
    inner[off + size - 1] = False
    inner = np.flatnonzero(inner)
    left, right = forward[inner], e[inner + 1] * backward[inner + 1]
    z = np.einsum("ij,jk,ik->i", left, turn, right)
    moves = turn * (left.T @ (right / z[:, None]))
    return both, word, moves


def spliced(doc: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """An order of words, given each word's text, and where chains begin in it (and one
    more): texts of even numbers as they are, then runs of the others, shuffled."""
    words = np.arange(len(doc))
    plain, rest = words[doc % 2 == 0], words[doc % 2 == 1]
    cut = (rng.random(len(rest)) < 1 / RUN) | np.concatenate(([True], np.diff(doc[rest]) != 0))[: len(rest)]
    runs = np.split(rest, np.flatnonzero(cut)[1:]) if len(rest) else []
    rng.shuffle(runs := list(runs))
    begins = np.flatnonzero(np.concatenate(([True], np.diff(doc[plain]) != 0))[: len(plain)])
    order = np.concatenate([plain, *runs])
    return order, np.concatenate((begins, [len(plain)], [len(order)] if len(rest) else [])).astype(np.int64)


class Model:
    """``turn`` holds exponentials of the transition weights."""

    def __init__(self, labels: list[str], bits: int = TABLE_BITS):
        self.labels = labels
        self.weights = np.zeros((4, (1 << bits) + 1, len(labels)), dtype=np.float32)
        self.turn = np.full((len(labels), len(labels)), 0.05 / max(1, len(labels) - 1), dtype=np.float32)
        np.fill_diagonal(self.turn, 0.95)

    def fit(self, texts: pa.Array, langs: list[str], epochs: int = EPOCHS) -> None:
        """Gradient steps with Adagrad on the conditional likelihood, by groups of texts."""
        k = len(self.labels)
        number = {x: i for i, x in enumerate(self.labels)}
        own = np.array([number[x] for x in langs])
        rng = np.random.default_rng(5)
        groups = np.array_split(rng.permutation(len(own)), max(1, len(own) // 40))
        squares, turn_squares, eye = np.full_like(self.weights, 1e-2), np.full((k, k), 1e-2), np.eye(k, dtype=np.float32)
        for epoch in range(epochs):
            for group in groups:
                s = Spelled(texts.take(pa.array(group)))
                if not len(s.letters):
                    continue
                text = np.repeat(np.arange(len(group)), np.diff(s.first))
                doc = own[group][text]
                order, chains = spliced(text, rng)
                begin, end, _, _ = pieces(chains, 64, 0)
                post, word, moves = posteriors(s.emissions(self.weights)[order], self.turn, begin, end)
                p = np.empty_like(post)
                p[order[word]] = post
                truth = eye[doc]
                if epoch:
                    best = p.argmax(axis=1)
                    firm = (p.max(axis=1) > 0.9) & (best != doc)
                    truth[firm] = eye[best[firm]]
                label = truth.argmax(axis=1)[order]
                inner = np.ones(len(label), dtype=bool)
                inner[end - 1] = False
                inner = np.flatnonzero(inner)
                seen = np.bincount(label[inner] * k + label[inner + 1], minlength=k * k).reshape(k, k)
                g = (seen - moves) / max(1, len(inner))
                turn_squares += g * g
                self.turn = np.clip(self.turn * np.exp(0.1 * g / np.sqrt(turn_squares)), 1e-6, 1e6).astype(np.float32)
                self.turn /= self.turn.max()
                step = truth - p
                step[s.letters == 0] = 0
                spread = np.repeat(step, np.diff(s.at), axis=0)
                for t in range(4):
                    at, g = (s.lexicon, step) if t == 3 else (s.features[t], spread)
                    sums = np.stack([np.bincount(at, weights=g[:, c], minlength=self.weights.shape[1]) for c in range(k)], axis=1).astype(np.float32)
                    sums[-1] = 0
                    squares[t] += sums * sums
                    self.weights[t] += 0.1 * sums / np.sqrt(squares[t])

    def shares(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text in each language, in expectation; whether it has any."""
        s = Spelled(texts)
        n = len(s.first) - 1
        out = np.zeros((n, len(self.labels)))
        if len(s.letters):
            begin, end, core, core_end = pieces(s.first)
            post, word, _ = posteriors(s.emissions(self.weights), self.turn, begin, end)
            order = np.argsort(begin - end, kind="stable")
            size = (end - begin)[order]
            inside = (word >= np.repeat(core[order], size)) & (word < np.repeat(core_end[order], size))
            doc = np.repeat(np.arange(n), np.diff(s.first))[word]
            w = s.letters[word] * inside
            for c in range(out.shape[1]):
                out[:, c] = np.bincount(doc, weights=w * post[:, c], minlength=n)
        return out, has_letter(texts)


def has_letter(texts: pa.Array) -> np.ndarray:
    data, offsets = flat(texts, lower=True)
    plain = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in texts[i].as_py())
    return out


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=2 << 20):
            share, some = model.shares(b.column(1)) if model.labels else (np.zeros((b.num_rows, 1)), np.zeros(b.num_rows, bool))
            total = share.sum(axis=1)
            share = np.where(total[:, None] > 0, share / np.maximum(total, 1e-9)[:, None], 1 / share.shape[1])
            best = share.argmax(axis=1)
            names = pa.array([model.labels[k] if ok else "und" for k, ok in zip(best.tolist(), some.tolist(), strict=True)], pa.string())
            score = np.where(some, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), names, pa.array(score)], names=["row", "lang_pred", "score"])

    return run


def fitted(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows (text, lang)."""
    rows = labelled.where("lang is not null and length(text) > 0")
    # Copies collapse in the sample, so the share is one of distinct texts.
    distinct = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    counts = {r[0]: r[1] for r in distinct.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS).collect()}
    model = Model(sorted(counts))
    if not counts:
        return model
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample_docs / n))])
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("lang", F.xxhash64("text").alias("h"), stretch(F.col("text"), F.col("text"), STRETCH).alias("text"))
    sample = picked.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("h", "lang").limit(2 * sample_docs * len(counts)).select("text", "lang").toArrow()
    model.fit(sample["text"].combine_chunks(), sample["lang"].to_pylist())
    return model


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """row (the whole row), lang_pred and score; lang, source and doc_id are only passed
    along."""
    rows = docs.select(whole(docs), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.turn))

    def run(batches):
        there = Model([])
        there.labels, there.weights, there.turn = held.value
        yield from _predict(there)(batches)

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op8_word_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    model = fitted(docs.where("not held_out").select("text", "lang"))
    return predicted(docs.drop("lang"), model).select("row.doc_id", "row.held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no language holds ``LEAST_SHARE``, go."""
    judged = predicted(docs, fitted(docs.select("text", "lang")))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("row.*")
