"""Language-model scores: a subword lattice over an existing vocabulary.

Every word can be cut into vocabulary pieces in many ways; its probability is the
sum over all of them, each the product of its pieces' unigram probabilities.  As
no piece crosses white space, a text's probability is the product over its words,
and each distinct word's lattice is evaluated once (forward recursion in log
space, many words at a time).  The vocabulary is the given tokenizer's; the
unigram weights are the relative frequencies of its pieces in the distinct words of
the training texts (what the lattice is for is words not seen before).
A word of the training texts is one more piece, which only stands for itself; all
other cuts share the chance of a token that is new (as many as were seen once).
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import saved, texts

VOCABULARY = os.environ.get("PIECE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
BLOCK = 16 << 20  # bytes of text that share one dictionary
HELD = 400_000    # distinct words a task counts before it passes them on
MARK = b"\xe2\x96\x81"
_LN10 = math.log(10)


def pieces(path: str = VOCABULARY) -> list[bytes | None]:
    """The bytes each piece stands for, a word's start as one space; None for control pieces
    and pieces no word contains."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i).encode()
        if model.is_byte(i):
            name = bytes([int(name[3:5], 16)])
        else:
            name = name.replace(MARK, b" ")
        out.append(None if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or b" " in name[1:] else name)
    return out


class Lattice:
    """log10 probabilities of words, given log10 weights of pieces by their bytes."""

    TABLE = 18  # bits of a lookup table
    START = 0xD1342543DE82EF95

    def __init__(self, weights: dict[bytes, float]):
        self.longest = max((len(p) for p in weights), default=1)
        names = list(weights)
        self.value = np.array([weights[p] * _LN10 for p in names])
        self.hash = np.array([self._hash_of(p) for p in names], np.uint64)
        left, self.tables, shift = np.arange(len(names)), [], 64 - self.TABLE
        while len(left) and shift >= 0:
            table = np.full(1 << self.TABLE, -1, np.int32)
            slot = (self.hash[left] >> np.uint64(shift)).astype(np.int64) & ((1 << self.TABLE) - 1)
            table[slot] = left
            self.tables.append((shift, table))
            left = left[table[slot] != left]
            shift -= 9
        if len(left):
            raise ValueError("pieces with equal hashes")

    @staticmethod
    def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        h = (h ^ byte) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    @classmethod
    def _hash_of(cls, piece: bytes) -> np.uint64:
        h = np.array([cls.START], np.uint64)
        for b in reversed(piece):
            h = cls._step(h, np.uint64(b))
        return h[0]

    def _look(self, h: np.ndarray) -> np.ndarray:
        """ln weight of the piece with each hash, -inf if there is none."""
        out = np.full(len(h), -np.inf)
        for shift, table in self.tables:
            at = table[(h >> np.uint64(shift)).astype(np.int64) & ((1 << self.TABLE) - 1)]
            hit = np.flatnonzero((at >= 0) & (self.hash[at] == h))
            out[hit] = self.value[at[hit]]
        return out

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of the summed probability of all segmentations of each word."""
        out = np.zeros(len(words))
        sizes = np.array([len(w) + 1 for w in words])
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            width = int(sizes[order[at]])
            top = max(width, min(8, width * 2), width + width // 4)
            end = min(int(np.searchsorted(sizes[order], top, "right")), at + max(1, (1 << 21) // top))
            some = order[at:end]
            out[some] = self._forward([b" " + words[i] for i in some.tolist()]) / _LN10
            at = end
        return out

    def _forward(self, words: list[bytes]) -> np.ndarray:
        n, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes.max())
        chars = np.zeros((width, n), np.uint64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(n), sizes)
        chars[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = flat
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0.0
        for i in range(1, width + 1):
            options, h = [], np.full(n, self.START, np.uint64)
            for length in range(1, min(self.longest, i) + 1):
                h = self._step(h, chars[i - length])  # pieces are hashed from their end
                options.append(alpha[i - length] + self._look(h))
            best = np.max(options, axis=0)
            safe = np.where(np.isfinite(best), best, 0.0)
            with np.errstate(divide="ignore"):
                alpha[i] = safe + np.log(np.sum(np.exp(np.array(options) - safe), axis=0))
        return alpha[sizes, np.arange(n)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, occurrences in training texts) of a task, 0 for words of other texts only."""
    seen: Counter[bytes] = Counter()

    def out():
        return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        held = batch.column(2).to_pylist()
        for text, apart in zip(batch.column(1), held):
            words = (text.as_py() or b"").lower().split()
            if apart:
                for w in set(words):
                    seen[w] += 0
            else:
                seen.update(words)
            if len(seen) > HELD:
                yield out()
                seen.clear()
    yield out()


def _cut(path: str):
    """(piece id, occurrences) over distinct training words, cut by the tokenizer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            cut = model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
            flat = np.fromiter((i for x in cut for i in x), np.int64)
            total += np.bincount(flat, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "c"])
    return run


def _weigh(weights: dict[bytes, float], tokens: int, new: float):
    """log10 probability of each word over all its cuts, itself as one piece among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights)
        for batch in batches:
            cuts = lattice.log10(batch.column(0).to_pylist()) * _LN10 + math.log(new)
            with np.errstate(divide="ignore"):
                whole = np.log((1 - new) * batch.column(1).to_numpy() / max(1, tokens))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.logaddexp(cuts, whole) / _LN10, pa.float64())], names=["word", "c", "log10p"])
    return run


def _vocabulary_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each block in the partition."""
    seen: dict[int, set[bytes]] = {}

    def out(block):
        words = list(seen.pop(block))
        return pa.record_batch([pa.array([block] * len(words), pa.int64()), pa.array(words, pa.binary())], names=["block", "word"])

    for batch in batches:
        for text, block in zip(batch.column(1), batch.column(3).to_pylist()):
            words = seen.setdefault(block, set())
            words.update((text.as_py() or b"").lower().split())
            if len(words) > HELD:
                yield out(block)
    for block in list(seen):
        yield out(block)


def _scored(known: int, tokens: int, distinct: int, ends: int, end_log10: float):
    """Scores of a block's documents by the dictionary of its words."""
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        names = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        c, p = words.column("c").to_numpy().astype(np.int64), words.column("log10p").to_numpy()
        base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
        end = math.log10((ends + 0.5) / (tokens + 0.5 * (distinct + 1)))
        rows = []
        for text in docs.column("text"):
            found = np.fromiter(map(names.__getitem__, (text.as_py() or b"").lower().split()), np.int64)
            rows.append((len(found) + 1, int((c[found] > 0).sum()) + (ends > 0), float(base[found].sum()) + end, float(p[found].sum()) + end_log10))
        n, k, b, s = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(k, pa.int64()),
                         "train_tokens": pa.array([known] * len(n), pa.int64()), "base_score": pa.array(b, pa.float64()), "score": pa.array(s, pa.float64())})
    return run


def lattice_scores(docs: DataFrame, held_out: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` of every document.

    A text is its words (A-Z in lower case) and one end.  ``base_score`` is the
    smoothed word unigram's log10 probability, ``score`` the marginal of the
    lattice (pieces' frequencies in training words plus one half; whole words).  Where
    ``held_out`` is true a text is scored and not learned from.

    Needs ``doc_id`` (integer) and ``text``; a null text is empty and has its end
    only, rows without doc_id are left out, other columns are ignored, repeated
    rows are counted and scored as rows, an empty table gives an empty result.

    Words are counted over all texts in Spark.  Documents are dealt into blocks of
    about ``BLOCK`` bytes; a block asks for its distinct words once, so no row per
    token is shuffled and no table of all words is sent to anyone.
    """
    docs = texts(docs, held_out.alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("ends")).first()
    counted = saved(docs.mapInArrow(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")))
    total = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    ends = size["ends"]
    tokens, distinct = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    cut = counted.filter("c > 0").mapInArrow(_cut(vocabulary), "piece int, c bigint").groupBy("piece").agg(F.sum("c").alias("c")).collect()  # a row per piece at most
    times = {r["piece"]: r["c"] for r in cut}
    names = pieces(vocabulary)
    weight: dict[bytes, float] = {}
    for i, name in enumerate(names):
        if name is not None:
            weight[name] = weight.get(name, 0) + times.get(i, 0) + 0.5
    mass = sum(weight.values()) + ends + 0.5
    log10 = {name: math.log10(w / mass) for name, w in weight.items()}
    new = (total["once"] + 1) / (tokens + 1)  # share of tokens that were never seen before
    weighed = counted.mapInArrow(_weigh(log10, tokens, new), "word binary, c bigint, log10p double")
    blocks = max(1, -(-(size["bytes"] or 0) // BLOCK))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition(blocks, "block")
    asked = dealt.mapInArrow(_vocabulary_of_block, "block bigint, word binary").join(weighed, "word")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    end_log10 = math.log10((1 - new) * ends / max(1, tokens) + new * (ends + 0.5) / mass)
    return dealt.groupBy("block").cogroup(asked.select("block", "word", "c", "log10p").distinct().groupBy("block")).applyInArrow(
        _scored(tokens, tokens, distinct, ends, end_log10), schema)
