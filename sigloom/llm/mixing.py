"""Mixing to target weights by soft membership.

A classifier learned from the labelled table gives each document posteriors over the
domains (combinations of the labels). Rates r >= 0 are fitted so that expected domain
token totals, the sums of r * tokens * posterior, match targets that are given from
outside (shares of all tokens, or token totals): projected gradient steps on least
squares, each residual relative to what its domain has and weighted by that, plus
``ridge`` times the squared distance of the rates from 1, by tokens, so that one solution
is best and rates move no more than the targets ask. In this scaling the step is
1 / (1 + ridge): with p a document's posteriors and g the relative residuals, r becomes
max(0, (r + ridge - p . g) / (1 + ridge)). Rates start at 1, so all documents with equal
posteriors keep equal rates.

Targets need not be within reach: membership is soft, so a domain that is to have nothing
keeps what the posteriors of other domains' documents leave in it. What is reached is
returned beside each target (``Mix``), and whether the steps had settled.

The classifier is fitted on at most ``SAMPLE`` labelled rows (those with the least hashes
of their id), of a long text on a stretch of ``STRETCH`` characters from a hashed place;
it judges whole texts. Its features are the words, their first bytes, and the endings of words with
their punctuation, that tell the domains apart at ``Z`` standard deviations or more; a
softmax over their presence.

Scale: one pass over the texts; each step is one aggregate over the tokens and posteriors
kept of it, in numpy, that returns a number a domain. The rates are not stored between
steps: they follow from the few gradients so far.

A null text has no tokens and the posteriors of an empty text. Labels that are null, or
of documents that are not there, teach nothing; an id labelled twice counts by its least
label. Without labels there is one domain. Repeated rows get equal rates. Empty tables
give empty results; other columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import Words, blocks, flat, mixed, stretch, table, whole, word_hashes, written

SAMPLE = 4000
TABLE_BITS = 18
LEADS = (4, 5, 6, 7)
Z, FEATURES = 5.0, 4096
STEPS, CLOSE = 40, 1e-4
STRETCH = 20_000
#: Shares of all tokens that the mix should have, and how firmly rates stay at 1.
SHARES, RIDGE = {"toxic": 0.0, "low": 0.4, "high": 0.6}, 0.01
#: The pipeline takes toxic documents out and leaves the rest: copies would undo its
#: dedup stage. Its ridge keeps what toxic mass clean documents have from moving them.
STAGE_RIDGE = 0.2
#: Documents whose rate is nearer to none than to one copy go.
LEAST_RATE = 0.5


def presence(texts: pa.Array, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hashed feature of each word of the texts, for each kind of feature, and
    words by text. Kinds: the word's letters, their first four to seven bytes, and the
    word's last three bytes with punctuation."""
    words = Words(*flat(texts, lower=True))
    packed, at = words.pack()
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    letters = (packed - np.uint8(97) < 26) | (packed >= 128)
    letters[at[1:] - 1] = True
    some = np.concatenate(([0], np.cumsum(letters)))[at]
    bare = packed[letters]
    left = np.diff(some) - 1
    kinds = [word_hashes(bare, some)]
    padded = np.concatenate((bare, np.zeros(8, dtype=np.uint8)))
    lead = np.ndarray(len(bare) + 1, dtype="<u8", buffer=padded, strides=(1,))[some[:-1]]
    for k in LEADS:
        kinds.append(mixed(lead & np.uint64((1 << 8 * k) - 1) ^ np.uint64(k << 60)) * (left > k))
    last = np.zeros(len(doc), dtype=np.uint64)
    for k in range(1, 4):
        place = at[1:] - 1 - k
        last = last << np.uint64(8) | np.where(place >= at[:-1], packed[np.maximum(place, 0)], 0).astype(np.uint64)
    kinds.append(mixed(last ^ np.uint64(0xAB << 40)))
    shift = np.uint64(64 - bits)
    return np.tile(doc, len(kinds)), np.concatenate([(x >> shift).astype(np.int64) for x in kinds]), np.diff(words.first)


class Classifier:
    """Posteriors over ``domains``: softmax of bias and of the weights of present features."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.number = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
        self.weights = np.zeros((0, max(1, len(domains))))
        self.bias = np.zeros(max(1, len(domains)))

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, chosen feature), and words by text."""
        doc, feature, n = presence(texts)
        chosen = self.number[feature]
        both = np.unique(doc[chosen >= 0] * np.int64(FEATURES) + chosen[chosen >= 0])
        return both // FEATURES, both % FEATURES, n

    def fit(self, texts: pa.Array, domain: np.ndarray, rounds: int = 80) -> None:
        found = []
        for lo in range(0, len(texts), 64):
            doc, feature, _ = presence(texts.slice(lo, 64))
            found.append(np.unique((doc + lo) << TABLE_BITS | feature))
        both = np.concatenate(found)
        doc, feature = (both >> TABLE_BITS).astype(np.int32), (both & ((1 << TABLE_BITS) - 1)).astype(np.int32)
        del found, both
        size, k = 1 << TABLE_BITS, len(self.domains)
        n = np.bincount(domain, minlength=k)
        seen = np.stack([np.bincount(feature[domain[doc] == c], minlength=size) for c in range(k)])
        total, score = seen.sum(axis=0), np.zeros(size)
        p = (total + 0.5) / (len(domain) + 1)
        for c in range(k):
            inside, outside = max(1, n[c]), max(1, len(domain) - n[c])
            z = (seen[c] / inside - (total - seen[c]) / outside) / np.sqrt(p * (1 - p) * (1 / inside + 1 / outside))
            score = np.maximum(score, np.abs(z))
        best = np.argsort(-score, kind="stable")[:FEATURES]
        best = best[score[best] >= Z]
        self.number[best] = np.arange(len(best))
        own = self.number[feature]
        doc, own = doc[own >= 0], own[own >= 0]
        truth = np.eye(k)[domain]
        self.bias = np.log((n + 0.5) / (len(domain) + 0.5 * k))
        self.weights = np.zeros((len(best), k))
        squares, square = np.full_like(self.weights, 1e-3), np.full(k, 1e-3)
        for _ in range(rounds):
            g = (truth - self.posteriors(doc, own, len(domain))) / len(domain)
            step = np.stack([np.bincount(own, weights=g[doc, c], minlength=len(best)) for c in range(k)], axis=1) - 1e-4 * self.weights
            squares += step * step
            square += g.sum(axis=0) ** 2
            self.weights += 0.5 * step / np.sqrt(squares)
            self.bias += 0.5 * g.sum(axis=0) / np.sqrt(square)

    def posteriors(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        z = np.stack([np.bincount(doc, weights=self.weights[feature, c], minlength=n) for c in range(len(self.bias))], axis=1) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier from documents (doc_id, text) and labels (doc_id, quality, toxic)."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("id is not null and domain is not null")
    total = known.count()
    part = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < 1_000_003 * min(1.0, sample / max(1, total)))
    part = part.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id")).limit(sample)
    # At most ``sample`` rows of two columns: bounded, so it may be broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(part), F.col("doc_id") == F.col("id")).select("id", "domain", stretch(F.col("text"), F.col("id"), STRETCH).alias("text"))
    rows = rows.groupBy("id", "domain").agg(F.min("text").alias("text")).where("text is not null").orderBy("id").toArrow()
    names = sorted(set(rows["domain"].to_pylist()))
    out = Classifier(names or ["all"])
    if len(names) > 1:
        out.fit(rows["text"].cast(pa.string()).combine_chunks(), np.array([names.index(d) for d in rows["domain"].to_pylist()]))
    return out


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """row (the whole row), n_tokens, and p (posteriors in the order of the domains)."""
    rows = docs.select(whole(docs), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((model.domains, model.number, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = Classifier([])
        there.domains, there.number, there.weights, there.bias = held.value
        for b in blocks(batches, limit=2 << 20):
            doc, feature, n = there.pairs(b.column(1))
            p = there.posteriors(doc, feature, len(n))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(list(p), pa.list_(pa.float64()))], names=["row", "n_tokens", "p"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]))


@dataclass
class Mix:
    """What a fit was asked for and what it reached, by domain."""

    domains: list[str]
    there: np.ndarray
    target: np.ndarray
    reached: np.ndarray
    settled: bool
    gradients: list[np.ndarray]
    ridge: float

    def rates(self, p: np.ndarray) -> np.ndarray:
        """The rates that follow from the gradients."""
        out = np.ones(len(p))
        for g in self.gradients:
            out = np.maximum(0.0, (out + self.ridge - p @ g) / (1.0 + self.ridge))
        return out

    def rate(self, p: Column) -> Column:
        mix = Mix(self.domains, self.there, self.target, self.reached, self.settled, list(self.gradients), self.ridge)

        @F.arrow_udf("double")
        def of(p: pa.Array) -> pa.Array:
            return pa.array(mix.rates(posteriors_of(p, len(mix.domains))))

        return of(p)


def posteriors_of(p: pa.Array, k: int) -> np.ndarray:
    return p.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def share_targets(shares: dict[str, float]) -> Callable[[list[str], np.ndarray], np.ndarray]:
    """Token totals of the shares, scaled to add up to all tokens over the domains there
    are; a domain that is not named keeps what it has."""

    def aim(domains: list[str], there: np.ndarray) -> np.ndarray:
        named = np.array([d in shares for d in domains])
        wanted = np.array([shares.get(d, 0.0) for d in domains])
        return np.where(named, wanted / max(wanted.sum(), 1e-9) * there[named].sum(), there)

    return aim


def without(domain: str) -> Callable[[list[str], np.ndarray], np.ndarray]:
    """Nothing of one domain, the others as they are."""
    return lambda domains, there: np.where([d == domain for d in domains], 0.0, there)


def fit_rates(soft: DataFrame, domains: list[str], aim: Callable[[list[str], np.ndarray], np.ndarray], ridge: float = RIDGE) -> Mix:
    """Projected gradient steps for a table (n_tokens, p) and the targets that ``aim``
    makes of the domains and their totals."""
    k = len(domains)

    def totals(mix: Mix) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k)
            for b in batches:
                p = posteriors_of(b.column(1), k)
                out += (b.column(0).to_numpy() * mix.rates(p)) @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(out)], names=["domain", "total"])

        found = soft.select("n_tokens", "p").mapInArrow(run, "domain int, total double").groupBy("domain").agg(F.sum("total")).collect()
        return np.array([dict(map(tuple, found)).get(c, 0.0) for c in range(k)])

    none = np.zeros(k)
    there = totals(Mix(domains, none, none, none, False, [], ridge))
    mix = Mix(domains, there, np.asarray(aim(domains, there), dtype=float), there, False, [], ridge)
    while True:
        # A domain with no tokens at all cannot be matched and is left alone.
        g = np.where(there > 0, (mix.reached - mix.target) / np.maximum(there, 1e-9), 0.0)
        mix.settled = bool(np.abs(g - (mix.gradients[-1] if mix.gradients else 0.0)).max() < CLOSE)
        if mix.settled or len(mix.gradients) == STEPS:
            return mix
        mix.gradients.append(g)
        mix.reached = totals(mix)


def rated(docs: DataFrame, labels: DataFrame, aim: Callable[[list[str], np.ndarray], np.ndarray], ridge: float = RIDGE) -> tuple[DataFrame, Mix]:
    """row, n_tokens, domain (the likeliest), p, rate of each row, and how the mix fits."""
    model = fitted(docs, labels)
    soft = written(with_posteriors(docs, model))
    mix = fit_rates(soft, model.domains, aim, ridge)
    domain = F.get(F.array(*[F.lit(d) for d in model.domains]), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return soft.select("row", "n_tokens", domain.alias("domain"), "p", mix.rate(F.col("p")).alias("rate")), mix


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, mix = rated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), share_targets(SHARES))
    by_domain = [F.create_map(*[F.lit(v) for d, x in zip(mix.domains, side.tolist(), strict=True) for v in (d, x)])[F.col("domain")] for side in (mix.target, mix.reached)]
    return out.select("row.doc_id", "n_tokens", "domain", "p", "rate", by_domain[0].alias("domain_target"), by_domain[1].alias("domain_reached"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix without toxic documents: those whose rate is below ``LEAST_RATE`` go."""
    out, _ = rated(docs, table(spark, sf_dir, "labels"), without("toxic"), STAGE_RIDGE)
    return out.where(F.col("rate") >= LEAST_RATE).select("row.*")
