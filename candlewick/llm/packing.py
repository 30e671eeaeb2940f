"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import saved, texts

VOCABULARY = os.environ.get("BYTE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32  # tokens a sequence costs besides its length
SHARD = 20_000


def token_counts(path: str):
    """(doc_id, tokens) of texts; one more token separates documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        words = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        encoding = tiktoken.Encoding("bytes", pat_str=words, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary((t.as_py() or b"").decode("utf-8", "replace"))) + 1 for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])
    return run


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """(bin of each size, length of each bin).  No size is over the longest length.

    Sizes are placed from the largest on (ties: in the order given).  A size goes
    to the open bin it leaves least room in (ties: the oldest).  If none has room a
    bin is opened, of the length that costs least per token it may come to hold:
    (length + overhead) / min(length, this size and all smaller ones still to
    place); ties: the longer.  At the end each bin gets the shortest length that
    holds its contents.
    """
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left, of = sum(sizes), [0] * len(sizes)
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    used: list[int] = []
    for i in order:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            space, b = room.pop(at)
        else:
            b = len(used)
            used.append(0)
            space = min((c for c in lengths if c >= size), key=lambda c: ((c + overhead) / min(c, left), -c))
        of[i] = b
        used[b] += size
        left -= size
        if space > size:
            insort(room, (space - size, b))
    return of, [lengths[bisect_left(lengths, u)] for u in used]


def _pack_shard(lengths: Sequence[int], overhead: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "start", "row"])
        of, length = pack(shard.size_.tolist(), lengths, overhead)
        return shard.assign(bin=of, capacity=[length[b] for b in of])[["shard", "bin", "capacity", "doc_id", "start", "size_"]]
    return run


def packed(docs: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, vocabulary: str = VOCABULARY,
           tokens: Column | None = None, shard_rows: int = SHARD) -> DataFrame:
    """One row per sequence: ``bin_id``, ``capacity``, ``used``, ``n_pieces``,
    ``doc_ids`` and ``pieces`` (doc_id, start, size: tokens of the document), pieces in
    the order of doc_id and start.

    A document has its byte-level tokens and one separator (``tokens`` gives
    another count); one longer than the longest of ``lengths`` is cut into pieces
    of that length and a rest.  Every token of every document is in one sequence.
    Pieces are dealt by a hash into shards of about ``shard_rows``, each packed by
    itself in one task, so no group grows with the table.

    Needs ``doc_id`` (integer) and ``text``; a null text is empty and has the
    separator only, rows without doc_id are left out, other columns are ignored,
    repeated rows are packed as often as they occur, an empty table gives an empty
    result.
    """
    if tokens is None:
        counted = texts(docs).mapInArrow(token_counts(vocabulary), "doc_id bigint, tokens bigint")
    else:
        counted = texts(docs, tokens.cast("long").alias("tokens")).select("doc_id", "tokens")
    longest = max(lengths)
    pieces = saved(counted.select("doc_id", "tokens", F.explode(F.expr(f"sequence(0L, greatest(tokens - 1, 0L), {longest}L)")).alias("start"))
                   .select("doc_id", "start", F.least(F.lit(longest).cast("long"), F.col("tokens") - F.col("start")).alias("size_")))
    shards = max(1, -(-pieces.count() // shard_rows))
    # equal rows get numbers, so that copies of a document are told apart and dealt out
    dealt = pieces.groupBy("doc_id", "start", "size_").agg(F.count("*").alias("times")).select(
        "doc_id", "start", "size_", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("row"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(shards)))
    placed = dealt.groupBy("shard").applyInPandas(_pack_shard(tuple(lengths), overhead), "shard bigint, bin bigint, capacity bigint, doc_id bigint, start bigint, size_ bigint")
    rows = placed.groupBy("shard", "bin", "capacity").agg(
        F.sum("size_").alias("used"), F.count("*").alias("n_pieces"),
        F.array_sort(F.collect_list(F.struct("doc_id", "start", F.col("size_").alias("size")))).alias("pieces"))
    return rows.select(F.concat_ws("-", "shard", "bin").alias("bin_id"), "capacity", "used", "n_pieces",
                       F.array_distinct("pieces.doc_id").alias("doc_ids"), "pieces")
