"""Periodic runs of words, by a dictionary of basic factors.

Per power-of-two length every stretch of that many words (a basic factor) has a
name; equal stretches of a text have equal names, and the names of one length are
pairs of names of the length before.  Occurrences of a name that follow each other
at one distance form an arithmetic progression, and its difference is a proposed
period; neighbouring progressions of one difference are one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import texts
from candlewick.llm.textkit import Words, ids, mix, slices


def _named(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(positions of factors that occur twice or more, name of each, successor occurrence
    of each but the last of a name as two arrays: position, distance).  ``pos`` ascends."""
    order = np.argsort(key, kind="stable")
    by_key, at = key[order], pos[order]
    same = by_key[1:] == by_key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] = same
    twice[:-1] |= same
    new = np.ones(len(key), bool)
    new[1:] = ~same
    name = np.cumsum(new) - 1
    return at[twice], name[twice], at[:-1][same], (at[1:] - at[:-1])[same]


def runs(key: np.ndarray, doc: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs with at least ``least`` words and ``exponent``
    periods, by start and period.

    ``key`` names the words (equal words of a text have equal keys), ``doc`` their
    texts in ascending order.  A run of period p holds, for the factor length L with
    L/2 < p <= L, factors whose successor occurrence is p away, as it has at least
    p + L words and a nearer one would give it a smaller period: no run is missed for
    an exponent of 3 or more, and each is found at one length only.  Its factors
    stand at neighbouring positions up to its end less p + L, so the positions give
    both ends, extended as far as the period holds.
    """
    if exponent < 3:
        raise ValueError("periods are found for exponents of 3 or more")
    n, length = len(key), 1
    starts, ends, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    name = np.full(n, -1, np.int64)
    pos, key = np.arange(n), key ^ mix(doc.astype(np.uint64) + np.uint64(1))
    while len(pos):
        alive, names, at, step = _named(key, pos)
        near = (step <= length) & (2 * step > length)
        at, step = at[near], step[near]
        order = np.argsort(at, kind="stable")
        at, step = at[order], step[order]
        if len(at):
            edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (step[1:] != step[:-1])]))
            last = np.concatenate([edge[1:], [len(at)]]) - 1
            s, e, p = at[edge], at[last] + length + step[edge], step[edge]
            take = e - s >= np.maximum(least, exponent * p)
            starts.append(s[take])
            ends.append(e[take])
            periods.append(p[take])
        # the next length: two factors of this length in a row, both of which occur again
        name[:] = -1
        name[alive] = names
        pos = np.sort(alive)
        pos = pos[pos + length < n]
        pos = pos[(name[pos + length] >= 0) & (doc[pos + length] == doc[pos])]
        key = name[pos] * (len(names) + 1) + name[pos + length]
        length *= 2
    starts, ends, periods = (np.concatenate(x) for x in (starts, ends, periods))
    order = np.lexsort((periods, starts))
    return starts[order], ends[order], periods[order]


def _found(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = ids(batch)
            for lo, hi, data, off in slices(batch.column(1)):
                words = Words(data, off)
                s, e, p = runs(words.hashes(), words.doc, least, exponent)
                owner = words.doc[s]
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, s + p, 1)
                np.add.at(cover, e, -1)
                kept = np.cumsum(cover[:-1]) == 0
                raw, first = data.tobytes(), words.first
                whole = np.add.reduceat(np.concatenate([~kept, [False]]).astype(np.int64), first[:-1]) == 0 if hi > lo else kept
                whole |= first[1:] == first[:-1]
                out = []
                for i in range(hi - lo):
                    parts = raw[off[i]:off[i + 1]].split()
                    out.append(b" ".join(parts if whole[i] else [parts[j] for j in np.flatnonzero(kept[first[i]:first[i + 1]])]))
                spans = pa.StructArray.from_arrays([pa.array(s - first[owner]), pa.array(e - s), pa.array(p)], ["start", "length", "period"])
                bounds = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.record_batch([pa.array(doc[lo:hi]), pa.array(words.counts()), pa.ListArray.from_arrays(pa.array(bounds), spans), pa.array(out, pa.binary())],
                                      names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (array of start, length, period, by start and
    period) and ``collapsed``, the text without repeats.

    A run is a stretch of consecutive words of smallest period q (words q apart are
    identical) of at least ``least`` words and ``exponent`` periods that cannot be
    extended to either side.  ``collapsed`` are the words that no run holds after its
    first q words, joined by one space.

    Needs ``doc_id`` (integer) and ``text``; a null text is empty, an empty text has no
    runs and collapses to "".  Rows without doc_id are left out, repeated rows give
    equal rows, other columns are ignored, an empty table gives an empty result.
    Every text is worked on whole and by itself: nothing is shuffled, and memory is
    about 100 bytes a word of the longest text.
    """
    kind = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    return texts(docs).mapInArrow(_found(least, exponent), kind).withColumn("collapsed", F.col("collapsed").cast("string"))
