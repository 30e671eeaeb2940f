"""Phrases whose words stand together more often than they would by themselves.

First pass: occurrences of word sequences are dealt to hash partitions, each with a
Misra-Gries summary.  Summaries of parts of the corpus are merged; a merged summary
has more counters than its partition's mass divided by the threshold, so a sequence
that reaches the threshold is never lost.  Second pass: what survived is counted
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.store import bit_filter, found, saved
from candlewick.llm.textkit import Words, lower, mix, signed, slices, windows

_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?\n\x0b\x0c\r")] = True
FLUSH = 2 << 20  # occurrences that a task gathers before it sends summaries
SLICE = 1 << 20  # bytes of text that are worked on at once
HELD = 1 << 20  # different sequences that a task holds before it sends their counts
SLACK = 8  # counters of a summary as a multiple of mass / threshold


class _Grams:
    """Word sequences of up to ``longest`` words that no stop character parts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, longest: int):
        self.data = lower(data)
        stop = _STOP[self.data]
        self.words = words = Words(np.where(stop, np.uint8(32), self.data), off)
        piece = np.cumsum(stop)[words.start] if len(words) else np.zeros(0, np.int64)
        n = len(words)
        parts = [np.flatnonzero((words.doc[:n - k + 1] == words.doc[k - 1:]) & (piece[:n - k + 1] == piece[k - 1:])) for k in range(1, min(n, longest) + 1)]
        self.at = np.concatenate([np.zeros(0, np.int64), *parts])
        self.size = np.repeat(np.arange(1, len(parts) + 1, dtype=np.int8), [len(x) for x in parts])

    def keys(self, tags: np.ndarray) -> np.ndarray:
        """A hash of each sequence and of its text's tag."""
        hashes, out, done = self.words.hashes(), np.empty(len(self.at), np.uint64), 0
        for k in range(1, int(self.size.max(initial=0)) + 1):
            at = self.at[done:done + int((self.size == k).sum())]
            out[done:done + len(at)] = mix(windows(hashes, k)[at] ^ tags[self.words.doc[at]] ^ np.uint64(k))
            done += len(at)
        return out

    def phrases(self, which: np.ndarray) -> pa.Array:
        """The words of some sequences, joined by one space, as a binary column."""
        w = self.words
        lengths = w.end - w.start
        start = np.cumsum(lengths + 1) - lengths - 1  # of each word where all stand one space apart
        joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
        joined[_spans(start, lengths)] = self.data[_spans(w.start, lengths)]
        at, last = self.at[which], self.at[which] + self.size[which] - 1
        long = start[last] + lengths[last] - start[at]
        bounds = np.concatenate([[0], np.cumsum(long)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(bounds), pa.py_buffer(joined[_spans(start[at], long)])])


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of several stretches, one after another."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def _tags(langs: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x) for x in langs], np.uint64)


def _masses(longest: int):
    """Words and sequences per language, a row per language and slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, off in slices(batch.column(0), SLICE):
                grams = _Grams(data, off, longest)
                words = grams.words.counts()
                total = np.bincount(grams.words.doc[grams.at], minlength=hi - lo)
                names, which = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                yield pa.record_batch([pa.array(names.tolist()), pa.array(np.bincount(which, words).astype(np.int64)), pa.array(np.bincount(which, total).astype(np.int64))],
                                      names=["lang", "n", "mass"])
    return run


def merge(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary of at most ``capacity`` counters from counters of several
    (a key may come more than once), and what was taken from every count for it."""
    keys, which = np.unique(keys, return_inverse=True)
    counts = np.bincount(which, counts, len(keys)).astype(np.int64)
    if len(keys) <= capacity:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    keep = counts > cut
    return keys[keep], counts[keep] - cut, cut


def _partials(longest: int, parts: int):
    """Summaries of what a task has gathered, one per hash partition, with their mass."""
    def rows(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, key, count = part[order], key[order], count[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        bounds = pa.array(np.concatenate([edge, [len(part)]]).astype(np.int32))
        return pa.record_batch([pa.array(part[edge]), pa.array(np.add.reduceat(count, edge)), pa.ListArray.from_arrays(bounds, signed(key)),
                                pa.ListArray.from_arrays(bounds, pa.array(count.astype(np.int32)))], names=["part", "mass", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            tags = _tags(batch.column(1).to_pylist())
            for lo, hi, data, off in slices(batch.column(0), SLICE):
                key = _Grams(data, off, longest).keys(tags[lo:hi])
                if len(key):
                    held.append(key)
                    size += len(key)
                if size >= FLUSH:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)
    return run


def _survivors(threshold: int):
    """Keys of one hash partition that may reach the threshold."""
    def run(table: pa.Table) -> pa.Table:
        capacity = SLACK * sum(table.column("mass").to_pylist()) // threshold + 1
        table = table.combine_chunks()
        lists, counts = table.column("keys").combine_chunks(), table.column("counts").combine_chunks()
        all_keys, all_counts = lists.flatten().to_numpy(), counts.flatten().to_numpy()
        keys, total, lost = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        step = max(capacity, 1 << 16)
        for lo in range(0, len(all_keys), step):
            keys, total, cut = merge(np.concatenate([keys, all_keys[lo:lo + step]]), np.concatenate([total, all_counts[lo:lo + step]]), capacity)
            lost += cut
        return pa.table({"key": keys[total + lost >= threshold]})
    return run


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in their order, a place of each and how often each is there."""
    order = np.argsort(keys)
    keys = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edge], order[edge], np.diff(edge, append=len(keys))


def added(held: dict, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Add the counts of sorted, different keys to those held, which stay sorted: what
    is held is neither sorted nor hashed again.  Returns which keys were not held."""
    place = np.searchsorted(held["key"], key)
    new = place == len(held["key"])
    new[~new] = held["key"][place[~new]] != key[~new]
    held["count"][place[~new]] += count[~new]
    held["key"] = np.insert(held["key"], place[new], key[new])
    held["count"] = np.insert(held["count"], place[new], count[new])
    return new


def _counted(longest: int, words: np.ndarray):
    """Exact occurrences of the sequences in the filter, with their words."""
    def rows(held: dict) -> pa.RecordBatch:
        place = np.searchsorted(held["key"], np.concatenate(held["named"]))
        return pa.record_batch([pa.concat_arrays(held["lang"]), pa.concat_arrays(held["phrase"]), pa.array(np.concatenate(held["size"]).astype(np.int32)), pa.array(held["count"][place])],
                               names=["lang", "phrase", "size", "f"])

    def fresh() -> dict:
        return {"key": np.zeros(0, np.uint64), "count": np.zeros(0, np.int64), "named": [], "lang": [], "phrase": [], "size": []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = fresh()
        for batch in batches:
            langs = batch.column(1)
            tags = _tags(langs.to_pylist())
            for lo, hi, data, off in slices(batch.column(0), SLICE):
                grams = _Grams(data, off, longest)
                key = grams.keys(tags[lo:hi])
                use = np.flatnonzero(found(words, key))
                if not len(use):
                    continue
                key, where, count = _distinct(key[use])
                new = added(held, key, count)
                which = use[where[new]]
                held["lang"].append(langs.take(pa.array(lo + grams.words.doc[grams.at[which]])))
                held["phrase"].append(grams.phrases(which))
                held["size"].append(grams.size[which])
                held["named"].append(key[new])
                if len(held["key"]) >= HELD:
                    yield rows(held)
                    held = fresh()
        if held["named"]:
            yield rows(held)
    return run


def frequent_sequences(docs: DataFrame, longest: int = 3, threshold: int = 10, part_mass: int = 1 << 20, filter_bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """(lang, n: its words) and (lang, phrase, size, f) of all sequences of 1 to
    ``longest`` words that occur ``threshold`` times or more in a language.

    The number of hash partitions grows with the corpus, so that each has a mass of
    about ``part_mass`` and its summary ``SLACK * part_mass / threshold`` counters at
    most, whatever the corpus; the slack leaves few sequences that only may be frequent.  A hot sequence is one counter per task.  ``filter_bits``
    sizes the filter by which the second pass leaves out what did not survive; it
    saves shuffling and decides nothing.
    """
    docs = docs.select(F.col("text").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    sizes = saved(docs.mapInArrow(_masses(longest), "lang string, n bigint, mass bigint").groupBy("lang").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")))
    mass = sizes.agg(F.sum("mass")).first()[0] or 0
    parts = -(-mass // part_mass) or 1
    partial = docs.mapInArrow(_partials(longest, parts), "part bigint, mass bigint, keys array<bigint>, counts array<int>")
    survivors = partial.groupBy("part").applyInArrow(_survivors(threshold), "key bigint")
    words = bit_filter(survivors, "key", filter_bits)
    counted = docs.mapInArrow(_counted(longest, words), "lang string, phrase binary, size int, f bigint")
    counted = counted.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "size").agg(F.sum("f").alias("f")).filter(F.col("f") >= threshold)
    return sizes.select("lang", "n"), saved(counted)


def collocations(docs: DataFrame, longest: int = 3, threshold: int = 10, percent: int = 50, top: int = 2000, **options) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of each language.

    A-Z become lower case; texts fall into pieces at ``. , ; : ! ?`` and line ends,
    pieces into words at blanks and tabs.  Phrases are 2 to ``longest`` words with at
    least ``threshold`` occurrences (``a``) within pieces.  Cut in two of ``l`` and
    ``r`` occurrences a phrase scores ``floor(1000000 * a * a / (l * r))``, exactly; its
    lowest cut counts, the one of the shorter first part on ties.  A phrase inside a
    longer one that has ``percent`` % of its occurrences is dropped.  Ranks: highest score, most
    occurrences, smallest phrase (bytes).

    Needs ``text`` and ``lang``; null texts are empty, a null language is ``und``,
    repeated rows count each, other columns are ignored, an empty table gives an
    empty result, and a language without such phrases has no rows.
    """
    sizes, counted = frequent_sequences(docs, longest, threshold, **options)
    phrases = counted.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(i, k):
        return F.array_join(F.slice("w", i, k), " ")

    # longer phrases tell the phrases in them how often they occur
    inside = [F.when((F.col("size") > k) & (F.col("size") >= i + k - 1), part(i, k)) for k in range(2, longest) for i in range(1, longest - k + 2)]
    if inside:
        within = phrases.select("lang", "a", F.explode(F.array(*inside)).alias("phrase")).filter(F.col("phrase").isNotNull()).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        phrases = phrases.join(within, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most"), F.lit(0)) < percent * F.col("a")).drop("most")

    cuts = phrases.select("lang", "phrase", "a", "size", F.explode(F.array(*[F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), part(1, k).alias("first"), F.array_join(F.slice("w", k + 1, longest), " ").alias("rest"))) for k in range(1, longest)])).alias("cut"))
    cuts = cuts.filter("cut is not null").select("lang", "phrase", "a", "cut.k", "cut.first", "cut.rest")
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = "cast(1000000 as decimal(7,0)) * (cast(a as decimal(14,0)) * cast(a as decimal(14,0))) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))"
    best = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of 64 shares of a language, then of those: no task sorts a whole language
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = best.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
