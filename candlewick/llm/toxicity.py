"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other texts of the sample are
unlabelled (some are toxic too).  With the class prior ``p`` the risk of a
classifier g is  p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]) ; where the
bracket turns negative the step goes against it, which keeps the
classifier from fitting the positives it happens to know.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import saved, texts
from candlewick.llm.textkit import Words, ids, lower, mix, slices

GRAM = 6  # bytes of the pieces of words that are features beside the words


@dataclass(frozen=True)
class Settings:
    bits: int = 22            # features are hashed to 2 ** bits slots
    positives: int = 3000     # bound of the labelled sample: toxic documents
    unlabelled: int = 9000    # bound of the unlabelled sample: any documents
    slots: int = 20_000       # slots that get a weight: those whose share differs most
    contrast: float = 4.0     # and by at least so many standard errors
    epochs: int = 300
    rate: float = 0.05
    decay: float = 1e-4
    beta: float = 0.0         # how far the bracket may fall below 0
    gamma: float = 1.0        # size of the step against it
    seed: int = 7


def slots_of(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of the features of each text, with repeats: its words,
    A-Z in lower case, and the pieces of ``GRAM`` bytes inside words."""
    data = lower(data)
    words = Words(data, off)
    owner, slot = [words.doc], [words.hashes() >> np.uint64(64 - bits)]
    n = len(data) - GRAM + 1
    if n > 0:
        blank = np.concatenate([[0], np.cumsum(words.blank)])
        value = np.zeros(n, np.uint64)
        for i in range(GRAM):
            value = value * np.uint64(257) + data[i:i + n].astype(np.uint64)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
        fits = np.flatnonzero((blank[GRAM:] == blank[:n]) & (np.arange(n) + GRAM <= off[doc + 1]))
        owner.append(doc[fits])
        slot.append(mix(value[fits] + np.uint64(1)) >> np.uint64(64 - bits))
    return np.concatenate(owner), np.concatenate(slot).astype(np.int64)


def distinct(owner: np.ndarray, slot: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((owner << bits) | slot)
    return key >> bits, key & ((1 << bits) - 1)


def _shares(bits: int):
    """How many positive and other texts of a batch have each slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positive = np.array(batch.column(2).to_pylist(), bool)
            for lo, hi, data, off in slices(batch.column(1)):
                owner, slot = distinct(*slots_of(data, off, bits), bits)
                value, place = np.unique(slot, return_inverse=True)
                p = np.bincount(place, positive[lo:hi][owner], minlength=len(value)).astype(np.int64)
                n = np.bincount(place, minlength=len(value))
                yield pa.record_batch([pa.array(value.astype(np.int32)), pa.array(p), pa.array(n - p)], names=["slot", "p", "u"])
    return run


def _chosen(bits: int, weighted: np.ndarray):
    """The numbers of the weighted slots that each text has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                owner, slot = slots_of(data, off, bits)
                place = np.minimum(np.searchsorted(weighted, slot), len(weighted) - 1)
                has = weighted[place] == slot
                owner, place = distinct(owner[has], place[has], bits)
                bounds = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.record_batch([batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds), pa.array(place.astype(np.int32)))],
                                      names=["positive", "slots"])
    return run


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + sum of the weights of the slots a text has)."""

    weights: np.ndarray  # of all 2 ** bits slots
    bias: float
    bits: int

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        owner, slot = slots_of(data, off, self.bits)
        has = self.weights[slot] != 0
        owner, slot = distinct(owner[has], slot[has], self.bits)
        return _sigmoid(self.bias + np.bincount(owner, self.weights[slot], minlength=len(off) - 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(owner: np.ndarray, slot: np.ndarray, positive: np.ndarray, size: int, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole (bounded) sample, logistic loss."""
    n = len(positive)
    share, other = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    w = np.zeros(size + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, s.epochs + 1):
        g = w[-1] + np.bincount(owner, w[slot], minlength=n)
        up = _sigmoid(g)
        soft = np.logaddexp(0, g)
        bracket = float((other * soft).sum() - prior * (share * soft).sum())
        rest = (other - prior * share) * up                           # slope of E_U[l(-g)] - p E_P[l(-g)]
        push = prior * share * (up - 1) + rest if bracket >= -s.beta else -s.gamma * rest
        step = np.concatenate([np.bincount(slot, push[owner], minlength=size) + s.decay * w[:-1], [push.sum()]])
        m = 0.9 * m + 0.1 * step
        v = 0.999 * v + 0.001 * step ** 2
        w -= s.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    # the mean score of the unlabelled is the prior
    g = np.bincount(owner, w[slot], minlength=n)[~positive]
    lo, hi = -40.0, 40.0
    for _ in range(60):
        bias = (lo + hi) / 2
        lo, hi = (bias, hi) if _sigmoid(bias + g).mean() < prior else (lo, bias)
    return w[:-1], bias


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """A model from the rows of ``labels`` (doc_id, toxic) and the texts of ``docs``.

    Both samples are bounded (``s.positives``, ``s.unlabelled``): the documents of
    least hash of the id, so they do not change from run to run.  The prior is
    the share of toxic rows among all labelled ones.  None without positives.
    """
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce("toxic", F.lit(0)) == 1).alias("positive"))
    count = known.agg(F.count("*").alias("n"), F.count_if("positive").alias("toxic")).first()
    if not count["toxic"]:
        return None
    order = F.xxhash64(F.lit(s.seed), "doc_id")
    toxic = known.filter("positive").select("doc_id").orderBy(order, "doc_id").limit(s.positives).withColumn("positive", F.lit(True))
    some = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(order, "doc_id").limit(s.unlabelled).withColumn("positive", F.lit(False))
    # at most positives + unlabelled rows of an id and a flag
    sample = saved(texts(docs).join(F.broadcast(toxic.union(some)), "doc_id").dropDuplicates(["doc_id", "positive"]))
    total = sample.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    if not total["p"] or not total["u"]:
        return None
    a, b = F.col("p") / total["p"], F.col("u") / total["u"]
    both = (F.col("p") + F.col("u")) / (total["p"] + total["u"])
    error = F.sqrt(both * (1 - both) * (1 / total["p"] + 1 / total["u"]) + 1e-12)
    told = (sample.mapInArrow(_shares(s.bits), "slot int, p bigint, u bigint").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
            .filter("p + u > 2").select("slot", F.abs((a - b) / error).alias("z")).filter(F.col("z") > s.contrast)
            .orderBy(F.desc("z"), "slot").limit(s.slots).select("slot"))
    weighted = np.sort(told.toArrow().column("slot").to_numpy().astype(np.int64))
    weights = np.zeros(1 << s.bits, np.float32)
    prior = min(0.95, max(0.001, count["toxic"] / count["n"]))
    if not len(weighted):
        return Model(weights, float(np.log(prior / (1 - prior))), s.bits)
    rows = sample.mapInArrow(_chosen(s.bits, weighted), "positive boolean, slots array<int>").toArrow()
    positive = rows.column("positive").to_numpy().astype(bool)
    lists = rows.column("slots").combine_chunks()
    bounds = lists.offsets.to_numpy()
    found, bias = fit(np.repeat(np.arange(len(positive)), np.diff(bounds)), lists.values.to_numpy()[bounds[0]:bounds[-1]], positive, len(weighted), prior, s)
    weights[weighted] = found
    return Model(weights, bias, s.bits)


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = ids(batch)
            for lo, hi, data, off in slices(batch.column(1)):
                score = np.zeros(hi - lo) if model is None else model.scores(data, off)
                yield pa.record_batch([pa.array(doc[lo:hi]), pa.array(score.astype(np.float64))], names=["doc_id", "score"])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold)
    of every document, from the whole text and nothing else.

    ``labels`` holds the rows to learn from.  Needs ``doc_id`` (integer) and
    ``text``; a null text is empty and scored as such, rows without doc_id are left
    out, other columns are ignored, repeated rows give equal rows again, an empty
    table gives an empty result.  Without any toxic label every score is 0.  A
    repeated label row counts once; toxic if any of a document's rows says so; a
    null label is no confirmation.
    """
    model = train(docs, labels, s)
    return texts(docs).mapInArrow(_score(model), "doc_id bigint, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
