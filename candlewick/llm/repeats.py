"""Repeated windows across documents, by prefix-partitioned suffix trees.

Suffixes are sampled: of the short word n-grams inside a window of ``length``
words the one with the least hash (the *anchor*) is taken, so equal windows have
equal anchors at equal places.  Suffixes that begin at anchors are split into
groups by their prefix - the anchor's words, or as many as the whole window where
an anchor is too frequent for one task.  Each group's suffixes, with the words before the
anchor, are sorted; neighbours that agree for ``length`` words are below one deep
internal node of the suffix tree, which is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import bit_filter, found, saved, texts
from candlewick.llm.textkit import Words, flat, ids, signed, slices, windows, within

PREFIX = 5  # words of an anchor


def anchors(words: Words, length: int, k: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, anchor start, anchor hash) for every window of ``length`` words."""
    at = within(words, length)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    grams = windows(words.hashes(), k)
    span = length - k + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    place = at + np.argmin(view[at], axis=1)  # the leftmost of equal ones
    return at, place, grams[place]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = ids(batch)
            for lo, _, data, off in slices(batch.column(1)):
                words = Words(data, off)
                _, place, value = anchors(words, length)
                if not len(place):
                    continue
                new = np.concatenate([[True], place[1:] != place[:-1]])
                yield pa.record_batch([signed(value[new]), pa.array(doc[lo + words.doc[place[new]]])], names=["anchor", "doc_id"])
    return run


def _suffix_rows(length: int, repeated: np.ndarray, frequent: np.ndarray):
    """Runs of windows around a repeated anchor: their words once, from the first
    window's start to the last one's end.  ``n``: windows; ``at``: number of the
    run's first word in the text; ``times``: so many equal runs follow each
    other, ``n`` words apart; ``whole``: the anchor is a frequent one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = ids(batch)
            for lo, _, data, off in slices(batch.column(1)):
                words = Words(data, off)
                at, place, value = anchors(words, length)
                if not len(at):
                    continue
                keep = found(repeated, value)
                at, place, value = at[keep], place[keep], value[keep]
                if not len(at):
                    continue
                often = found(frequent, value)
                new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
                s = np.flatnonzero(new)
                e = np.concatenate([s[1:], [len(at)]]) - 1
                raw = data.tobytes()
                first, last = at[s], at[e] + length
                lists = [b" ".join(raw[a:b].split()) for a, b in zip(words.start[first].tolist(), words.end[last - 1].tolist())]
                owner = words.doc[first]
                # a few words over and over: equal runs that follow each other are one row
                n = e - s + 1
                again = np.zeros(len(s), bool)
                again[1:] = (n[1:] == n[:-1]) & (first[1:] == first[:-1] + n[:-1]) & (owner[1:] == owner[:-1]) & (value[s[1:]] == value[s[:-1]])
                again[again] = [lists[i] == lists[i - 1] for i in np.flatnonzero(again)]
                head = np.flatnonzero(~again)
                times = np.diff(np.concatenate([head, [len(s)]]))
                s, n, first, owner, lists = s[head], n[head], first[head], owner[head], [lists[i] for i in head.tolist()]
                yield pa.record_batch([
                    signed(value[s]), pa.array(doc[lo + owner]), pa.array((first - words.first[owner]).astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(times.astype(np.int32)),
                    pa.array(often[s]), pa.array(lists, pa.binary())],
                    names=["key", "doc_id", "at", "n", "times", "whole", "words"])
    return run


ROWS = "key bigint, doc_id bigint, at int, n smallint, times int, whole boolean, words binary"


def _repeats(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Windows of whole groups that begin in a smaller document too."""
    column = rows.column("words").combine_chunks()
    words = Words(*flat(column))
    n = rows.column("n").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    suffix = words.hashes()[(words.first[owner] + step)[:, None] + np.arange(length)]
    key, doc = rows.column("key").to_numpy()[owner], rows.column("doc_id").to_numpy()[owner]
    # leaves of the group's tree in order, and how far neighbours agree
    order = np.lexsort((doc, *suffix.T[::-1], key))
    suffix, key, doc = suffix[order], key[order], doc[order]
    agree = np.cumprod(suffix[1:] == suffix[:-1], axis=1).sum(axis=1)
    node = np.concatenate([[True], (agree < length) | (key[1:] != key[:-1])])
    least = doc[np.flatnonzero(node)][np.cumsum(node) - 1]
    late = doc > least
    at = (rows.column("at").to_numpy()[owner] + step)[order]
    times = rows.column("times").to_numpy()[owner][order]
    apart = n[owner][order]
    return pa.record_batch([pa.array(doc[late]), pa.array(at[late].astype(np.int32)), pa.array(times[late]), pa.array(apart[late].astype(np.int32))], names=["doc_id", "at", "times", "n"])


def _trees(length: int):
    """Over rows sorted by key: each group is whole before it is looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut == 0 and held and held[-1].column(0)[-1].as_py() == key[-1]:
                held.append(batch)
                continue
            held.append(batch.slice(0, cut))
            whole = pa.Table.from_batches(held)
            if whole.num_rows:
                yield _repeats(whole, length)
            held = [batch.slice(cut)]
        if held:
            yield _repeats(pa.Table.from_batches(held), length)
    return run


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = ids(batch)
            places = batch.column(2)
            for lo, hi, data, off in slices(batch.column(1)):
                words = Words(data, off)
                raw = data.tobytes()
                n, gone, digest, texts_ = words.counts(), [], [], []
                for i in range(hi - lo):
                    first, end = words.first[i], words.first[i + 1]
                    starts = places[lo + i].as_py()
                    parts = raw[off[i]:off[i + 1]].split()
                    if starts:
                        cover = np.zeros(end - first + 1, np.int64)
                        s = np.unique(np.array(starts))
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + length, -1)
                        left = np.cumsum(cover[:-1]) == 0
                        parts = [parts[j] for j in np.flatnonzero(left)]
                    gone.append(int(n[i]) - len(parts))
                    kept = b" ".join(parts)
                    digest.append(hashlib.sha256(kept).hexdigest())
                    texts_.append(kept)
                yield pa.record_batch([pa.array(doc[lo:hi]), pa.array(n), pa.array(gone, pa.int64()), pa.array(digest), pa.array(texts_, pa.binary())],
                                      names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return run


def repeated_starts(docs: DataFrame, length: int = 13, filter_bits: int = 27, group_rows: int = 20_000) -> DataFrame:
    """(doc_id, starts: numbers of the words at which a window begins that also
    begins in a document of smaller id).

    ``filter_bits`` sizes filters of anchors found in two or more documents and of
    those with over ``group_rows`` occurrences; what a full filter lets through is
    decided by the words themselves, so it costs work only.  Of frequent anchors equal runs are
    combined before the shuffle and then split by whole windows, so that no task
    needs all of a passage's copies.
    """
    docs = texts(docs)
    counted = saved(docs.mapInArrow(_anchor_rows(length), "anchor bigint, doc_id bigint").groupBy("anchor").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("anchor", "n"))
    repeated = bit_filter(counted, "anchor", filter_bits)
    frequent = bit_filter(counted.filter(F.col("n") > group_rows), "anchor", filter_bits - 4)
    rows = docs.mapInArrow(_suffix_rows(length, repeated, frequent), ROWS)
    below = (rows.filter("not whole").select("key", "doc_id", "at", "n", "times", "words").repartition("key").sortWithinPartitions("key")
             .mapInArrow(_trees(length), "doc_id bigint, at int, times int, n int"))
    # equal runs of a frequent anchor become one before its windows are looked at
    whole = rows.filter("whole").select("doc_id", "at", "times", F.col("n").cast("int").alias("n"), F.col("words").cast("string").alias("run"))
    runs = whole.groupBy("run").agg(F.min("doc_id").alias("least"))
    size = F.size(F.split("run", " ")) - length
    each = runs.select("run", "least", F.explode(F.sequence(F.lit(0), size)).alias("j")).withColumn(
        "window", F.expr(f"sha2(array_join(slice(split(run, ' '), j + 1, {length}), ' '), 256)"))
    nodes = each.groupBy("window").agg(F.min("least").alias("least"))
    owners = each.select("run", "j", "window").join(nodes, "window").groupBy("run").agg(F.collect_list(F.struct("j", "least")).alias("owners"))
    whole = whole.join(owners, "run").select("doc_id", F.expr(
        "flatten(transform(filter(owners, x -> x.least < doc_id), x -> sequence(at + x.j, at + x.j + (times - 1) * n, n)))").alias("starts"))
    below = below.select("doc_id", F.expr("sequence(at, at + (times - 1) * n, n)").alias("starts"))
    return below.union(whole.filter(F.size("starts") > 0)).groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def without_repeats(docs: DataFrame, length: int = 13, **options) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept`` (the words
    left, joined by a space) of every document: each word covered by a window of
    ``length`` words that also begins in a document of smaller id goes.

    Needs ``doc_id`` (integer; it names a text) and ``text``; a null text has no
    words, rows without doc_id are left out, other columns are ignored, repeated
    rows give equal rows again (a document never repeats itself), an empty table
    gives an empty result.  Windows are judged on the input.
    """
    starts = repeated_starts(docs, length, **options)
    joined = texts(docs).join(starts, "doc_id", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_kept(length), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary").withColumn("kept", F.col("kept").cast("string"))
