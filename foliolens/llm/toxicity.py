r"""Toxicity scores by a factorization machine over hashed terms.

A text's features are the hashed buckets of its distinct words (A-Z lower-cased runs of
letters, digits and ``_``), each with value 1.  The score is
``sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>)``: weights of single terms, and inner
products of short vectors for pairs of terms, so that a pair such as an insult and the
mention of a group can count for more than its parts.

Only terms are learned that tell the label beyond chance, alone or in a pair: a pair counts if the
labels of its rows differ from what the odds of its two terms, added up, lead to expect.  Others would
only be learned by heart; they weigh nothing.

It is fitted on a bounded sample of the labelled rows, about ``SAMPLE_ROWS`` of each class,
chosen by hash; scoring covers whole texts of all rows.  Labels, ids, language and source
are never inputs of a score.

Defined cases: a null or empty text has no terms and gets the score of the bias alone;
unlabelled rows, null labels and labels without a document teach nothing; a document
labelled more than once counts as toxic if any label says so; without rows of both classes the score is
the share of toxic rows (0.0 if none); repeated rows each get their score; other columns
pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from foliolens.llm.common import whole_rows

BUCKETS = 1 << 18
FACTORS = 4
THRESHOLD = 0.3
# Labelled rows of each class to learn from: the sample's bound.
SAMPLE_ROWS = 6000
# A term is learned from if its log-likelihood ratio is at least this, or if it is in this share of the texts,
# or in a pair, found in the next share of the texts, that tells what its parts do not.
MIN_SURPRISE = 16.0
COMMON_SHARE = 0.05
PAIR_SHARE = 0.005
_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")


class Terms:
    """Words to buckets; remembers recent words."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def of(self, text: str | None) -> np.ndarray:
        known, found = self.known, []
        if len(known) > 500_000:
            known.clear()
        for word in set(_WORD.findall((text or "").encode().lower())):
            bucket = known.get(word)
            if bucket is None:
                bucket = known[word] = xxhash.xxh3_64_intdigest(word) % self.buckets
            found.append(bucket)
        return np.unique(np.array(found, dtype=np.int32))


def hashed_terms(text: Column, buckets: int = BUCKETS) -> Column:
    """The sorted buckets as packed 32-bit numbers."""

    @F.arrow_udf("binary")
    def terms(texts: pa.Array) -> pa.Array:
        own = Terms(buckets)
        return pa.array([own.of(value.as_py()).tobytes() for value in texts], pa.binary())

    return terms(text)


class Model:
    """A fitted machine; ``terms`` are its buckets in order, all others weigh nothing."""

    def __init__(self, bias: float, terms: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.terms, self.weights, self.factors = bias, terms, weights, factors

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
        place = np.searchsorted(self.terms, flat)
        held = (place < len(self.terms)) & (self.terms[np.minimum(place, len(self.terms) - 1)] == flat) \
            if len(self.terms) else np.zeros(len(flat), bool)
        owner = np.repeat(np.arange(len(rows)), counts)[held]
        place = place[held]
        linear = np.bincount(owner, self.weights[place], len(rows))
        pairs = np.zeros(len(rows))
        for k in range(self.factors.shape[1]):
            own = self.factors[place, k]
            pairs += np.bincount(owner, own, len(rows)) ** 2 - np.bincount(owner, own * own, len(rows))
        return self.bias + linear + pairs / 2

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def surprise(toxic: np.ndarray, total: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Log-likelihood ratio of ``toxic`` of ``total`` rows against an expected share."""

    def part(seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(wanted, 1e-9)), 0.0)

    return 2 * (part(toxic, total * share) + part(total - toxic, total * (1 - share)))


def telling_pairs(inverse: np.ndarray, owner: np.ndarray, labels: np.ndarray, total: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which terms stand in a pair whose labels are not those that its two terms, taken alone, lead to expect.

    Of every two terms in at least ``PAIR_SHARE`` of the rows; the bound rises with their number, as among many pairs
    some stand out by chance.  Pairs are counted one term at a time, so memory is that of one term's rows.
    """
    least = max(PAIR_SHARE * len(labels), 1.0)
    candidates = np.flatnonzero(total >= least)
    told = np.zeros(len(total), bool)
    if len(candidates) < 2:
        return told
    number = np.full(len(total), -1)
    number[candidates] = np.arange(len(candidates))
    place, row = number[inverse], owner
    place, row = place[place >= 0], row[place >= 0]
    starts = np.searchsorted(row, np.arange(len(labels) + 1))
    by_term = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[by_term], np.arange(len(candidates) + 1))
    # Odds of a single term; the halves keep them finite.
    odds = np.log((toxic + 0.5) / (total - toxic + 0.5))[candidates]
    base = np.log(labels.mean() / (1 - labels.mean()))
    bound = MIN_SURPRISE + 2 * np.log(len(candidates) * (len(candidates) - 1) / 2)
    for one in range(len(candidates) - 1):
        holders = row[by_term[ends[one]:ends[one + 1]]]

        def together(rows: np.ndarray) -> np.ndarray:
            if not len(rows):
                return np.zeros(len(candidates))
            return np.bincount(np.concatenate([place[starts[r]:starts[r + 1]] for r in rows]), minlength=len(candidates))

        bad = together(holders[labels[holders] == 1]).astype(np.float64)
        both = bad + together(holders[labels[holders] == 0])
        expected = 1 / (1 + np.exp(-np.clip(odds[one] + odds - base, -30, 30)))
        telling = (both >= least) & (surprise(bad, both, expected) >= bound)
        telling[:one + 1] = False
        if telling.any():
            told[candidates[one]] = True
            told[candidates[telling]] = True
    return told


def telling_terms(inverse: np.ndarray, owner: np.ndarray, labels: np.ndarray, terms: int) -> np.ndarray:
    """Which terms are learned from: those whose rows' labels differ from the rest beyond chance, common
    ones, and those of telling pairs.  Others would only be learned by heart."""
    total = np.bincount(inverse, minlength=terms).astype(np.float64)
    toxic = np.bincount(inverse, labels[owner], terms)
    alone = (surprise(toxic, total, labels.mean()) >= MIN_SURPRISE) | (total >= COMMON_SHARE * len(labels))
    return alone | telling_pairs(inverse, owner, labels, total, toxic)


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float, factors: int = FACTORS,
        epochs: int = 40, rate: float = 0.05, decay: float = 1e-3, batch: int = 256, seed: int = 7) -> Model:
    """Logistic loss by AdaGrad over small batches; rows are reweighted to the true ``share`` of class 1.

    Every fifth row is kept back, and the epoch with the least loss on these is the model.
    """
    labels = np.asarray(labels, dtype=np.float64)
    sampled = labels.mean() if len(labels) else 0.0
    if not 0 < sampled < 1:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(float(np.log(share / (1 - share))), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, factors)))
    owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    terms, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    keep = telling_terms(inverse, owner, labels, len(terms))
    terms = terms[keep]
    rows = [np.intersect1d(row, terms, assume_unique=True) for row in rows]
    places = [np.searchsorted(terms, row) for row in rows]
    importance = np.where(labels == 1, share / sampled, (1 - share) / (1 - sampled))
    apart = np.arange(len(rows)) % 5 == 4
    learned, checked = np.flatnonzero(~apart), np.flatnonzero(apart)
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), random.normal(0, 0.01, (len(terms), factors))
    bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(len(terms), 1e-2), np.full(v.shape, 1e-2), 1e-2
    best, least = None, np.inf

    def loss(model: Model) -> float:
        score = np.clip(model.scores([rows[i] for i in checked]), 1e-9, 1 - 1e-9)
        wanted = labels[checked]
        return float(-(importance[checked] * (wanted * np.log(score) + (1 - wanted) * np.log(1 - score))).sum())

    for _ in range(epochs):
        order = random.permutation(learned)
        for first in range(0, len(order), batch):
            chosen = order[first:first + batch]
            own = np.repeat(np.arange(len(chosen)), [len(places[i]) for i in chosen])
            term = np.concatenate([places[i] for i in chosen])
            factor = v[term]
            sums = np.stack([np.bincount(own, factor[:, k], len(chosen)) for k in range(factors)], 1)
            squares = np.bincount(own, (factor * factor).sum(1), len(chosen))
            margin = bias + np.bincount(own, w[term], len(chosen)) + ((sums * sums).sum(1) - squares) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) * importance[chosen]
            touched, local = np.unique(term, return_inverse=True)
            pull = error[own]
            slope_w = np.bincount(local, pull, len(touched)) + decay * w[touched]
            slope_v = np.stack([
                np.bincount(local, pull * (sums[own, k] - factor[:, k]), len(touched)) for k in range(factors)
            ], 1) + decay * v[touched]
            seen_w[touched] += slope_w ** 2
            seen_v[touched] += slope_v ** 2
            seen_b += error.sum() ** 2
            w[touched] -= 4 * rate * slope_w / np.sqrt(seen_w[touched])
            v[touched] -= rate * slope_v / np.sqrt(seen_v[touched])
            bias -= rate * error.sum() / np.sqrt(seen_b)
        now = Model(float(bias), terms, w.copy(), v.copy())
        if (own_loss := loss(now)) < least:
            best, least = now, own_loss
    return best


def training_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(text, toxic)`` of about ``rows`` labelled documents of each class, all if there are fewer.

    A row is taken when the hash of its id is below the share of its class that is wanted,
    so nothing is sorted and the sample does not hang on the order of rows.
    """
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for toxic, count in counts.items():
        share = F.when(F.col("toxic") == toxic, rows / count).otherwise(share)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    # About 2 * rows ids at most, whatever the size of the tables.
    chosen = F.broadcast(known.filter(unit < share).select(F.col("doc_id").alias("_doc_id"), "toxic"))
    # One text per id, so that repeated rows do not lengthen the sample.
    return documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_doc_id")).groupBy("_doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")
    ).select("text", "toxic")


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fitted on the driver, from the hashed terms of about ``2 * rows`` texts at most."""
    usable = labels.filter("toxic in (0, 1)")
    share = usable.agg(F.avg("toxic")).first()[0] or 0.0
    sample = training_sample(documents, usable, rows).select(hashed_terms(F.col("text")).alias("terms"), "toxic")
    # Sorted, so that the model does not hang on the order in which rows arrive.
    found = sorted((int(row["toxic"]), bytes(row["terms"])) for row in sample.toLocalIterator())
    return fit(
        [np.frombuffer(terms, np.int32) for _, terms in found], np.array([toxic for toxic, _ in found]), float(share)
    )


def score(documents: DataFrame, model: Model) -> Column:
    """The score of ``text`` under the model, for rows of this session."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = Terms()
        for texts in batches:
            yield pa.array(held.value.scores([terms.of(text.as_py()) for text in texts]), pa.float64())

    return scores(F.col("text"))


def scored(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every input row as ``row`` with its ``score``; ``labels`` are the rows to learn from."""
    model = train(documents, labels, rows)
    return whole_rows(documents, text=F.col("text")).select("row", score(documents, model).alias("score"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    return scored(documents, labels).filter(F.col("score") < threshold).select("row.*")
