"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages.  Passages and benchmark items are
TF-IDF vectors over the items' terms (long items in parts); a randomised SVD, whose products over
the passages of all documents are summed in Spark, gives the latent space.  Every passage of every
document is compared with every item there by cosine; what is near enough is
checked word by word: longest common subsequence with the item, and whether the
item's answer (its last part) is there too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import saved, texts, without
from candlewick.llm.textkit import Words, flat, ids, slices

# letters and digits of any script make words here: punctuation separates, A-Z is lowered
_AS_WORD = np.array([c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)

_FIRST = 16    # bits of a term's hash by which it is looked up
_STRIPES = 16  # of a matrix, each added up by itself
_SLICE = 1 << 18  # bytes of text at once: numbers per byte and per word stay small beside the counts
_GROUPS = 24   # of items' parts, looked at together first
_DENSE = 4096  # terms of which pairs are counted in a matrix; more are multiplied passage by passage


@dataclass(frozen=True)
class Settings:
    half: int = 16             # a passage is two halves of so many words; passages overlap by one
    rank: int = 256            # dimensions of the latent space
    block: int = 224           # items searched for at once,
    block_words: int = 16_384  # and words they have together; a longer item is a block by itself
    sample: int = 0            # of no effect: the latent space is fitted to the passages of all documents
    common: float = 0.1        # terms in more than this share of documents (and in over 20) are common: the word check leaves them out
    cosine: float = 0.25       # least cosine of a candidate
    share: float = 0.6         # least share of the item's words in common order, with the answer
    answer: float = 0.5        # least share of the answer's words
    sure: float = 0.85         # share that needs no answer
    seed: int = 11


def _words(data: np.ndarray, off: np.ndarray) -> Words:
    return Words(_AS_WORD[data], off)


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: ``vocabulary`` (sorted hashes of its terms), and each
    item's terms as numbers, in order."""

    ids: list[int]
    terms: list[np.ndarray]
    vocabulary: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Items:
        column = pa.concat_arrays(rows.column("text").chunks) if rows.num_rows else pa.array([], pa.binary())
        words = _words(*flat(column))
        hashes = words.hashes()
        vocabulary, number = np.unique(hashes, return_inverse=True)
        return Items(rows.column("item_id").to_pylist(), [number[a:b] for a, b in zip(words.first[:-1], words.first[1:])], vocabulary)

    @cached_property
    def _begin(self) -> tuple[np.ndarray, int]:
        """For the first bits of a hash, the number of the first term that has them or higher ones; the most terms of the same."""
        edges = np.searchsorted(self.vocabulary, np.arange(1 << _FIRST, dtype=np.uint64) << np.uint64(64 - _FIRST))
        return edges, int(np.diff(edges, append=len(self.vocabulary)).max())

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for terms no item has."""
        begin, most = self._begin
        at = np.minimum(begin[(hashes >> np.uint64(64 - _FIRST)).astype(np.int64)], len(self.vocabulary) - 1)
        off = np.flatnonzero(self.vocabulary[at] < hashes)  # of several that share their first bits, a later one
        for _ in range(most - 1):
            at[off] = np.minimum(at[off] + 1, len(self.vocabulary) - 1)
            off = off[self.vocabulary[at[off]] < hashes[off]]
        return np.where(self.vocabulary[at] == hashes, at, -1)


def _parts(items: Items, most: int) -> list[tuple[int, np.ndarray]]:
    """(item, terms) of the equal parts, of at most so many words, in which items are searched for:
    a passage holds too little of a long item to be near all of it."""
    return [(i, part) for i, t in enumerate(items.terms) for part in np.array_split(t, max(1, -(-len(t) // most)))]


def _document_counts(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(items.vocabulary)
        total = np.zeros(size, np.int64)
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1), _SLICE):
                words = _words(data, off)
                term = items.number(words.hashes())
                known = term >= 0
                total += np.bincount(np.unique(words.doc[known] * size + term[known]) % size, minlength=size)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])
    return run


@dataclass(frozen=True)
class Space:
    """Latent space of a block: ``basis`` is terms x dimensions, weighted by idf."""

    items: Items
    idf: np.ndarray
    common: np.ndarray    # terms in so many documents that the word check leaves them out where others remain
    rare: float           # weight of terms no item has
    basis: np.ndarray
    points: np.ndarray    # of the items' parts, divided by their TF-IDF norms
    part_of: np.ndarray   # the item of each


def _halves(words: Words, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word's half passage, and the word each half begins at."""
    inside = np.arange(len(words)) - words.first[words.doc]
    new = inside % half == 0
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _passages(words: Words, hashes: np.ndarray, items: Items, idf: np.ndarray, rare: float, rows: np.ndarray, half: int):
    """Sums of ``rows`` (a vector per term) over passages: (first word, vectors, TF-IDF norms)."""
    part, begin = _halves(words, half)
    if not len(begin):
        return begin, np.zeros((0, rows.shape[1]), np.float32), np.zeros(0)
    term = items.number(hashes)
    weight = np.where(term >= 0, idf[term], rare)
    square = np.bincount(part, weight ** 2, minlength=len(begin))
    told = np.flatnonzero(term >= 0)
    sums = np.zeros((len(begin), rows.shape[1]), np.float32)
    if len(told):
        starts = np.flatnonzero(np.concatenate([[True], part[told][1:] != part[told][:-1]]))
        sums[part[told][starts]] = np.add.reduceat(rows[term[told]], starts, axis=0)
    joined = np.zeros(len(begin), bool)  # with the next half of the same text
    joined[:-1] = words.doc[begin][1:] == words.doc[begin][:-1]
    follow = np.flatnonzero(joined) + 1
    vectors, norm = sums.copy(), square.copy()
    vectors[follow - 1] += sums[follow]
    norm[follow - 1] += square[follow]
    return begin, vectors, np.sqrt(norm)


def _product(items: Items, idf: np.ndarray, rare: float, right: np.ndarray, half: int, gram: bool):
    """Over passages A of a task: A'(A right), or (A right)'(A right) if ``gram``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, k = right.shape
        total, count = np.zeros((k, k) if gram else (size, k)), 0
        rows = (right * idf[:, None]).astype(np.float32)
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1), 1 << 18):
                words = _words(data, off)
                hashes = words.hashes()
                begin, low, _ = _passages(words, hashes, items, idf, rare, rows, half)
                count += len(begin)
                if gram:
                    total += low.T @ low
                    continue
                part, _ = _halves(words, half)
                term = items.number(hashes)
                known = np.flatnonzero(term >= 0)
                # a word is in the passage of its own half and in the one that begins a half before
                back = np.maximum(part[known] - 1, 0)
                has = (part[known] > 0) & (words.doc[begin[back]] == words.doc[known])
                reach = low[part[known]] + np.where(has[:, None], low[back], 0)
                order = np.argsort(term[known], kind="stable")
                t = term[known][order]
                if len(t):
                    s = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                    total[t[s]] += np.add.reduceat(reach[order], s, axis=0) * idf[t[s]][:, None]
        for i, rows in enumerate(np.array_split(total.astype(np.float64), _STRIPES)):
            yield _summand(i, rows, count)
    return run


def _rows(size: int) -> np.ndarray:
    """Where the rows of a symmetric matrix begin, of which only the part from the diagonal on is kept,
    row after row, less the row's number: the number (a, b), a <= b, is at ``_rows(size)[a] + b``."""
    row = np.arange(size, dtype=np.int64)
    return row * size - row * (row + 1) // 2


def _pairs(term: np.ndarray, place: np.ndarray, before: np.ndarray, counts: np.ndarray, row: np.ndarray) -> int:
    """Add to ``counts`` (terms x terms, from the diagonal on, see :func:`_rows`) the passages in which two
    words stand together; returns the most it may have added to one number.

    ``place`` numbers the half passage of each word, with a gap between texts, ``before``
    tells which words' halves follow one of the same text: those are in two passages.  A
    passage is two halves, so words of one half share all its passages, those of neighbours one."""
    most = 0
    begin = row[term].astype(np.int32)
    term, place, many = term.astype(np.int32), place.astype(np.int32), np.where(before, 2, 1).astype(counts.dtype)
    for apart in range(1, len(term)):
        gap = place[apart:] - place[:-apart]
        near = gap <= 1
        if not near.any():
            break
        # of the two ways to put a pair's terms, the one with the lower first is the smaller
        at = np.minimum(begin[:-apart] + term[apart:], begin[apart:] + term[:-apart])[near]
        np.add.at(counts, at, np.where(gap == 0, many[:-apart], many.dtype.type(1))[near])
        most += 2 * len(at)
    return most


def _whole(x: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers from 0 on in as few bytes each as hold them all, and how many those are."""
    kind = next(k for k in (np.uint16, np.int32, np.int64) if x.max(initial=0) <= np.iinfo(k).max)
    return x.astype(kind).tobytes(), np.dtype(kind).itemsize


def _numbers(raw: pa.Scalar, each: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), {2: np.uint16, 4: np.int32, 8: np.int64}[each])


_COUNTED = "stripe int, sum binary, each int, n bigint"


def _stripe(i: int, x: np.ndarray, n: int) -> pa.RecordBatch:
    raw, each = _whole(x)
    return pa.record_batch([pa.array([i], pa.int32()), pa.array([raw], pa.binary()), pa.array([each], pa.int32()), pa.array([n], pa.int64())], names=["stripe", "sum", "each", "n"])


def _together(items: Items, half: int, stripes: int):
    """Over passages of a task: the numbers of times two terms stand together, N = A'A for passages A
    of plain counts, in stripes of rows; and, as stripe -1, the documents that have each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(items.vocabulary)
        row = _rows(size)
        # N is symmetric: half of it is kept.  The diagonal has pairs of words of one term, and their own passages apart
        counts, own, docs = np.zeros(size * (size + 1) // 2, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
        n = held = 0

        def out():
            every = np.arange(size)
            for i, here in enumerate(np.array_split(every, stripes)):
                both = counts[row[np.minimum.outer(here, every)] + np.maximum.outer(here, every)]
                both[np.arange(len(here)), here] = 2 * both[np.arange(len(here)), here] + own[here]  # of which ``held`` is the bound
                yield _stripe(i, both, n if i == 0 else 0)
            yield _stripe(-1, docs, 0)

        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1), _SLICE):
                words = _words(data, off)
                part, begin = _halves(words, half)
                if not len(begin):
                    continue
                term = items.number(words.hashes())
                known = np.flatnonzero(term >= 0)
                doc, t = words.doc[known], term[known]
                docs += np.bincount(np.unique(doc * size + t) % size, minlength=size)
                follows = np.zeros(len(begin), bool)
                follows[1:] = words.doc[begin][1:] == words.doc[begin][:-1]
                before = follows[part[known]]
                own += np.bincount(t, 1 + before, minlength=size).astype(np.int64)
                n += len(begin)
                held += _pairs(t, part[known] + doc, before, counts, row) + 2 * len(known)
                if held > 1 << 29:  # before a number can leave 32 bits
                    yield from out()
                    counts[:], own[:], docs[:], n, held = 0, 0, 0, 0, 0
        yield from out()
    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the stripes of whole numbers of a partition."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        for i, raw, each, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            one = _numbers(raw, each)
            if i not in sums:
                sums[i] = np.zeros(len(one), np.int64)
            sums[i] += one
            counts[i] = counts.get(i, 0) + n
    for i, x in sums.items():
        yield _stripe(i, x, counts[i])


def _counted(docs: DataFrame, items: Items, s: Settings) -> tuple[DataFrame, int]:
    """Rows of N (:func:`_together`) of all documents in stripes, and the documents that have each term; the
    number of stripes.  There are more of them than tasks that count, so that what one task adds up stays as small
    on more cores."""
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    stripes = 4 * max(_STRIPES, tasks)
    counts = docs.coalesce(tasks).mapInArrow(_together(items, s.half, stripes), _COUNTED)
    return saved(counts.repartition(stripes, "stripe").mapInArrow(_add_counts, _COUNTED)), stripes


def _summand(i: int, x: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["stripe", "sum", "n"])


def _times(idf: np.ndarray, right: np.ndarray, gram: bool, stripes: int):
    """As :func:`_product`, from the stripes of N: with D the idf on a diagonal, A'A = D N D."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, k = right.shape
        rows = right * idf[:, None]
        edges = np.cumsum([0, *[len(x) for x in np.array_split(idf, stripes)]])
        total, count = np.zeros((k, k)), 0
        for batch in batches:
            for i, raw, each, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                here = slice(edges[i], edges[i + 1])
                part = _numbers(raw, each).reshape(-1, size).astype(np.float64) @ rows
                if gram:
                    total += rows[here].T @ part
                    count += n
                else:
                    yield _summand(i, part * idf[here, None], n)
        if gram:
            for i, x in enumerate(np.array_split(total, _STRIPES)):
                yield _summand(i, x, count)
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the stripes of a partition, one matrix of each at a time."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        for i, raw, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            one = np.frombuffer(raw.as_buffer(), np.float64)
            sums[i] = sums[i] + one if i in sums else one
            counts[i] = counts.get(i, 0) + n
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["stripe", "sum", "n"])


def _summed(docs: DataFrame, run, shape: tuple[int, int]) -> tuple[np.ndarray, int]:
    """The sum of what the tasks return, added up in stripes of rows; one matrix reaches the driver.
    Two tasks a core at most, so that there are few matrices to add, whatever ``docs`` holds."""
    schema = "stripe int, sum binary, n bigint"
    tasks = docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
    stripes = {row["stripe"]: row for row in tasks.repartition(_STRIPES, "stripe").mapInArrow(_add, schema).collect()}
    if not stripes:
        return np.zeros(shape), 0
    return np.concatenate([np.frombuffer(stripes[i]["sum"], np.float64) for i in sorted(stripes)]).reshape(shape), stripes[0]["n"]


@dataclass(frozen=True)
class _Weights:
    """TF-IDF of the items' parts, as entries (part, term, value) in order of part."""

    part: np.ndarray
    term: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    @staticmethod
    def of(parts: list[np.ndarray], idf: np.ndarray) -> _Weights:
        size = len(idf)
        flat = np.concatenate([t + i * size for i, t in enumerate(parts)])
        key, count = np.unique(flat, return_counts=True)
        term = key % size
        return _Weights(key // size, term, count * idf[term], (len(parts), size))

    def norms(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.part, self.value ** 2, minlength=self.shape[0]))

    def scaled(self, by: np.ndarray) -> _Weights:
        return _Weights(self.part, self.term, self.value * by[self.part], self.shape)

    def times(self, right: np.ndarray) -> np.ndarray:
        return self._sums(self.part, self.value[:, None] * right[self.term], self.shape[0])

    def transposed_times(self, right: np.ndarray) -> np.ndarray:
        order = np.argsort(self.term, kind="stable")
        return self._sums(self.term[order], self.value[order, None] * right[self.part[order]], self.shape[1])

    @staticmethod
    def _sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, rows.shape[1]))
        if len(at):
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            out[at[starts]] = np.add.reduceat(rows, starts, axis=0)
        return out


def _term_documents(docs: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each term is."""
    df = np.zeros(len(items.vocabulary))
    for row in docs.mapInArrow(_document_counts(items), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[row["term"]] = row["n"]
    return df


def fit(docs: DataFrame, items: Items, s: Settings) -> Space:
    """The latent space of a block of items.

    Document frequencies are of all documents; no term's weight is 0.  The SVD is of the passages
    of all documents and of all items.  Its random matrix has ``rank + 16``
    columns.  Where the items have few terms (``_DENSE``, as blocks of many items do), the documents are read
    once: tasks count which terms stand together, and the products follow from the counts.
    Else they are read three times, and what a task returns has terms x columns numbers,
    whatever it reads; the terms are bounded with the words of a block.
    """
    total = docs.count()
    counted = _counted(docs, items, s) if len(items.vocabulary) <= _DENSE else None
    if counted is None:
        df = _term_documents(docs, items)
    else:
        counted, stripes = counted
        row = counted.filter("stripe = -1").first()
        df = _numbers(pa.scalar(bytes(row["sum"]), pa.binary()), row["each"]).astype(float)
        counted = counted.filter("stripe >= 0")
    idf = np.log((total + 1) / (df + 1)) + 0.1
    common = df > max(20, s.common * total)
    rare = float(np.log(10))  # as of a term in a tenth of the documents: foreign words around an item shall not drown it
    size, k = len(items.vocabulary), min(len(items.vocabulary), s.rank + 16)

    def product(right: np.ndarray, gram: bool) -> tuple[np.ndarray, int]:
        shape = (right.shape[1] if gram else size, right.shape[1])
        if counted is None:
            return _summed(docs, _product(items, idf, rare, right, s.half, gram), shape)
        return _summed(counted, _times(idf, right, gram, stripes), shape)

    parts = _parts(items, 4 * s.half)
    a = _Weights.of([t for _, t in parts], idf)
    norm = a.norms()
    omega = np.random.default_rng(s.seed).standard_normal((size, k))
    z, n = product(omega, False)
    # items' parts enter with equal norms and as much weight together as the passages
    unit = a.scaled(np.median(norm) * max(1.0, n / max(1, len(parts))) ** 0.5 / np.where(norm > 0, norm, 1))
    q, _ = np.linalg.qr(z + unit.transposed_times(unit.times(omega)))
    g, _ = product(q, True)
    low = unit.times(q)
    value, vector = np.linalg.eigh(g + low.T @ low)
    v = q @ vector[:, np.argsort(-value)[:s.rank]]
    points = a.times(v) / np.where(norm > 0, norm, 1)[:, None]
    return Space(items, idf, common, rare, (v * idf[:, None]).astype(np.float32), points.astype(np.float32), np.array([i for i, _ in parts]))


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of the item."""
    masks: dict[int, int] = {}
    for i, t in enumerate(item):
        masks[t] = masks.get(t, 0) | 1 << i
    row = full = (1 << len(item)) - 1
    for t in text:
        hit = row & masks.get(t, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def checked(item: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The item's words that are looked for: those not common, or all where fewer than five are not."""
    told = item[~common[item]]
    return told if len(told) >= 5 else item


def shares(item: np.ndarray, common: np.ndarray, text: np.ndarray, least: float = 0.0) -> tuple[float, float]:
    """Share of the item's words found in order, and of its answer's (the last third).
    Common terms are left out on both sides where at least five others remain.
    Shares under ``least`` may be given as 0, as so few of the item's words being there at all tell."""
    told = checked(item, common)
    if len(told) < len(item):
        item, text = told, text[(text >= 0) & ~common[text]]
    item, there = item.tolist(), set(text.tolist())
    if sum(w in there for w in item) < least * len(item) - 1e-9:
        return 0.0, 0.0
    text, tail = text.tolist(), item[-max(1, len(item) // 3):]
    share = common_subsequence(item, text) / len(item)
    return share, common_subsequence(tail, text) / len(tail) if share >= least else 0.0


class _Wanted:
    """What the word check looks for of each item: ``terms``, and ``least``, how many words
    of these a text must have at least, whatever their order, to be found."""

    def __init__(self, space: Space, s: Settings):
        told = [checked(t, space.common) for t in space.items.terms]
        self.terms = [np.unique(t) for t in told]
        self.least = [max(1, int(np.ceil(min(s.share, s.sure) * len(t) - 1e-9))) for t in told]
        # items half or more of whose words are common, as a very widespread item's are: they weigh
        # little, so whatever stands around one may hide it from the cosine
        self.dim = {i for i, t in enumerate(space.items.terms) if 0 < len(t) <= 2 * np.count_nonzero(space.common[t])}


class _At:
    """The words of some texts at which each item's wanted terms are."""

    def __init__(self, wanted: _Wanted, term: np.ndarray, size: int):
        known = np.flatnonzero(term >= 0)
        self.terms, self.word = wanted.terms, known[np.argsort(term[known], kind="stable")]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term[known], minlength=size))])

    def __getitem__(self, item: int) -> np.ndarray:
        return np.sort(np.concatenate([self.word[self.begin[t]:self.begin[t + 1]] for t in self.terms[item]]))


def _between(at: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the words ``at`` lie in each stretch."""
    return np.searchsorted(at, end) - np.searchsorted(at, first)


def _places(told: dict[tuple[int, int], float], begin: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, s: Settings) -> Iterator[tuple[int, int, int, float]]:
    """(item, first word, end word, cosine) of what is compared word by word: what lies within the item's
    length of a passage.  Many passages of a long item's copy are near it, so those that begin in one
    stretch of half its length have one place."""
    places: dict[tuple[int, int, int], tuple[int, int, float]] = {}
    for (p, i), c in told.items():
        at = int(begin[p])
        key = (i, int(low[p]), (at - int(low[p])) // max(s.half, int(size[i]) // 2) if size[i] > 4 * s.half else at)
        first, end = max(int(low[p]), at - int(size[i])), min(int(high[p]), at + 2 * s.half + int(size[i]))
        f, e, m = places.get(key, (first, end, c))
        places[key] = (min(f, first), max(e, end), max(m, c))
    for (i, _, _), (first, end, c) in places.items():
        yield i, first, end, c


def _sums(part: np.ndarray, term: np.ndarray, wanted: np.ndarray, joined: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` (a vector per term) over the ``wanted`` passages, in their order;
    ``joined``: which halves the next one of the same text follows."""
    need = np.zeros(len(joined), bool)
    need[wanted] = True
    need[wanted[joined[wanted]] + 1] = True
    place = np.cumsum(need) - 1
    halves = np.zeros((np.count_nonzero(need), rows.shape[1]), np.float32)
    told = np.flatnonzero((term >= 0) & need[part])
    if len(told):
        at = place[part[told]]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        halves[at[starts]] = np.add.reduceat(rows[term[told]], starts, axis=0)
    out = halves[place[wanted]]
    both = joined[wanted]
    out[both] += halves[place[wanted[both]] + 1]
    return out


def _search(space: Space, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Wanted(space, s)
        # what one occurrence of a term adds to the product with each part of an item, and the
        # most it adds to that with any part of a group of parts
        adds = space.basis @ space.points.T
        groups = np.array_split(np.arange(adds.shape[1]), min(_GROUPS, adds.shape[1]))
        most = np.stack([adds[:, g].max(axis=1) for g in groups], axis=1) if len(groups) else np.zeros((len(adds), 1), np.float32)
        size = np.array([len(t) for t in space.items.terms])
        for batch in batches:
            doc = ids(batch)
            for lo, hi, data, off in slices(batch.column(1), 1 << 19):
                words = _words(data, off)
                hashes = words.hashes()
                part, begin = _halves(words, s.half)
                if not len(begin):
                    continue
                term = space.items.number(hashes)
                joined = np.zeros(len(begin), bool)  # with the next half of the same text
                joined[:-1] = words.doc[begin][1:] == words.doc[begin][:-1]
                square = np.bincount(part, np.where(term >= 0, space.idf[term], space.rare) ** 2, minlength=len(begin))
                ahead = np.flatnonzero(joined)
                norm = square.copy()
                norm[ahead] += square[ahead + 1]
                norm = np.sqrt(norm)
                # a passage whose terms together cannot come near any part needs no more (the rest is rounding)
                upper = _sums(part, term, np.arange(len(begin)), joined, most).max(axis=1)
                maybe = np.flatnonzero((upper + 1e-3 * (1 + np.abs(upper)) >= s.cosine * norm) & (norm > 0))
                near = _sums(part, term, maybe, joined, adds) / norm[maybe][:, None]
                at, item = np.nonzero(near >= s.cosine)
                low, high = words.first[words.doc[begin]], words.first[words.doc[begin] + 1]
                passage, item, near = maybe[at], space.part_of[item], near[at, item]
                order = np.argsort(item, kind="stable")
                edges = np.searchsorted(item[order], np.arange(len(size) + 1))
                where = _At(wanted, term, len(adds))
                told: dict[tuple[int, int], float] = {}
                long: dict[int, np.ndarray] = {}
                for i, least in enumerate(wanted.least):
                    some = order[edges[i]:edges[i + 1]]
                    if not len(some) and i not in wanted.dim:
                        continue
                    has, length = where[i], int(size[i])
                    # what is compared word by word has too few of the item's words where these are so few in reach
                    reach = lambda p: _between(has, np.maximum(low[p], begin[p] - length), np.minimum(high[p], begin[p] + 2 * s.half + length))  # noqa: B023, E731
                    if length > 4 * s.half:  # its places reach further
                        long[i] = has
                    else:
                        some = some[reach(passage[some]) >= least]
                    for p, c in zip(passage[some].tolist(), near[some].tolist()):
                        told[p, i] = max(told.get((p, i), c), c)
                    if i in wanted.dim and (has[least - 1:] - has[:max(0, len(has) - least + 1)] < 2 * (s.half + length)).any():
                        enough = np.flatnonzero(reach(np.arange(len(begin))) >= least)
                        more = _sums(part, term, enough, joined, adds[:, space.part_of == i])
                        for p, c in zip(enough.tolist(), more.max(axis=1, initial=-np.inf).tolist()):
                            told.setdefault((p, i), c / max(float(norm[p]), 1e-12))
                found: dict[tuple[int, int], tuple[float, float, float]] = {}
                for i, first, end, c in _places(told, begin, low, high, size, s):
                    d = words.doc[first]
                    if i in long and _between(long[i], first, end) < wanted.least[i]:
                        continue
                    share, answer = shares(space.items.terms[i], space.common, term[first:end], s.share)
                    if share >= s.sure or (share >= s.share and answer >= s.answer):
                        key = (int(d), i)
                        found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (share, answer, c))
                if found:
                    yield pa.record_batch([
                        pa.array([int(doc[lo + d]) for d, _ in found], pa.int64()), pa.array([space.items.ids[i] for _, i in found], pa.int64()),
                        *[pa.array([v[j] for v in found.values()], pa.float64()) for j in (2, 0, 1)]],
                        names=["doc_id", "item_id", "cosine", "share", "answer_share"])
    return run


def _blocks(lengths: list[tuple[int, int]], s: Settings) -> list[list[int]]:
    """Item ids of each block, from (item id, words) in order: at most ``block`` items and
    ``block_words`` words, but for an item longer than that."""
    out: list[list[int]] = []
    words = 0
    for item, n in lengths:
        if not out or len(out[-1]) >= s.block or words + n > s.block_words:
            out.append([])
            words = 0
        out[-1].append(item)
        words += n
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer_share) of every document that holds
    a benchmark item or a paraphrase of one; clean documents have no row.

    Items are searched for in blocks of at most ``s.block``; every document is read
    per block and no pairs leave a task but confirmed ones.  The latent space is fitted to the
    passages of all documents, and every one is looked up in it.  Needs ``doc_id`` and
    ``item_id`` (integers) and ``text`` in both; rows without an id are left out, null
    and empty texts hold nothing and are found nowhere, other columns are ignored,
    repeated rows count once, empty tables give an empty result.  Items most of whose
    words are in very many documents, as those of a widespread item are, are searched for
    in every passage without the latent space.  Of several places
    in a document the one with the largest share is given.
    """
    docs = texts(docs)
    items = (benchmark.filter(F.col("item_id").isNotNull() & (F.length(F.trim("text")) > 0))
             .select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct())
    # a word and its separator as four bytes; one row per item of the benchmark
    lengths = [(r["item_id"], r["n"]) for r in items.groupBy("item_id").agg(F.sum(F.length("text")).alias("n")).orderBy("item_id").toLocalIterator()]
    blocks = _blocks([(i, -(-n // 4)) for i, n in lengths], s)
    schema = "doc_id bigint, item_id bigint, cosine double, share double, answer_share double"
    out = docs.sparkSession.createDataFrame([], schema)
    if not blocks:
        return out
    for block in blocks:
        some = Items.of(items.filter(F.col("item_id").between(block[0], block[-1])).orderBy("item_id", "text").toArrow())
        if len(some.vocabulary):
            out = out.union(docs.mapInArrow(_search(fit(docs, some, s), s), schema))
    best = F.max_by(F.struct("cosine", "share", "answer_share"), F.struct("share", "answer_share", "cosine"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.cosine", "b.share", "b.answer_share")


def without_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents without those that hold an item; columns are unchanged, rows without doc_id stay."""
    return without(docs, leaks(docs, benchmark, s))
