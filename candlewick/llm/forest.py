"""Near duplicates by an LSH forest of MinHash signatures.

Every tree keeps the sets in the order of a signature of its own.  Sets that begin
alike stand together; how much of the signature they must share is decided region
by region: a region with too many members is cut at a greater depth, unless they stay
together there too, that is, unless they are near copies indeed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.components import components
from candlewick.llm.crowds import between_components, by_leader, confirmed, shingles_of
from candlewick.llm.store import saved, texts, without
from candlewick.llm.textkit import ids, mix, shingle_sets, signed, slices

DEPTHS = (3, 5, 8)  # values of a signature that a region's members share
NEIGHBOURS = 1  # next ones in the order of a crowded region; every tree has another order
SKETCH = 128  # bits; sets that link differ in 13 of them, give or take 3.4


def signatures(owner: np.ndarray, value: np.ndarray, n: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts that have shingles, their ``n`` minimum hashes, one row each)."""
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 32, n, np.uint32)
    times = rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
    word = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(begin)), np.uint32)
    for j in range(n):
        if len(begin):
            out[j] = np.minimum.reduceat((word ^ flip[j]) * times[j], begin)
    return owner[begin], out.T


def _describe(k: int, trees: int):
    depth = DEPTHS[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = ids(batch)
            for lo, hi, data, off in slices(batch.column(1)):
                owner, value = shingle_sets(data, off, k)
                rows, least = signatures(owner, value, max(trees * depth, SKETCH))
                node = np.zeros(hi - lo, np.uint64)
                keys = np.zeros((hi - lo, trees * len(DEPTHS)), np.uint64)
                bits = np.zeros((hi - lo, SKETCH // 64), np.uint64)
                if len(rows):
                    begin = np.searchsorted(owner, rows)
                    node[rows] = mix(np.add.reduceat(mix(value), begin) + np.uint64(1)) | np.uint64(1)
                    for t in range(trees):
                        key = np.full(len(rows), t + 1, np.uint64)
                        for d in range(depth):
                            key = mix(key ^ mix(least[:, t * depth + d].astype(np.uint64) + np.uint64(d << 32)))
                            if d + 1 in DEPTHS:
                                keys[rows, t * len(DEPTHS) + DEPTHS.index(d + 1)] = key
                    for j in range(SKETCH):
                        bits[rows, j // 64] |= (mix(least[:, j].astype(np.uint64)) & np.uint64(1)) << np.uint64(j % 64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * keys.shape[1]), signed(keys.reshape(-1)))
                yield pa.record_batch([pa.array(doc[lo:hi]), pa.array(np.bincount(owner, minlength=hi - lo)), signed(node), lists, signed(bits[:, 0]), signed(bits[:, 1])],
                                      names=["doc_id", "n_shingles", "node", "keys", "s0", "s1"])
    return run


def _alike(a, b, percent: int):
    """Sizes allow a link, and the sketches do not rule it out (7 standard deviations)."""
    unlike = F.bit_count(a["s0"].bitwiseXOR(b["s0"])) + F.bit_count(a["s1"].bitwiseXOR(b["s1"]))
    share = (100 - percent) / 200
    most = int(SKETCH * share + 7 * (SKETCH * share * (1 - share)) ** 0.5)
    return (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) & (unlike <= most)


def _next_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours in the order of a region; the end of a batch goes with the next."""
    held = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        region, id_ = columns
        fresh = 0 if held is None else len(held[0])
        out = [np.zeros((0, 2), np.int64)]
        for step in range(1, NEIGHBOURS + 1):
            at = np.arange(max(0, fresh - step), len(region) - step)
            at = at[region[at] == region[at + step]]
            out.append(np.stack([id_[at], id_[at + step]], 1))
        pairs = np.sort(np.concatenate(out), 1)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        held = [c[-NEIGHBOURS:] for c in columns]


def regions(nodes: DataFrame, trees: int, crowd: int) -> DataFrame:
    """(region, k0 .. k2, id, n, s0, s1, crowded) of every set and tree where it has company.

    A region is a beginning of a tree's signatures.  Of at most ``crowd`` members it
    stays as it is; of more it is cut at the next depth, unless half of them have
    one beginning there too, or there is no next.  The keys k0 .. k2 name
    the beginnings of all depths."""
    levels = range(len(DEPTHS))
    key = F.explode(F.array(*[F.struct(*[F.col("keys")[t * len(DEPTHS) + i].alias(f"k{i}") for i in levels]) for t in range(trees)]))
    left = nodes.select("id", "n", "s0", "s1", key.alias("k")).select("id", "n", "s0", "s1", "k.*")
    out = None
    for i in levels:
        last = i == len(DEPTHS) - 1
        members = left.groupBy(f"k{i}", *([] if last else [f"k{i + 1}"])).agg(F.count("*").alias("c"))
        sizes = members.groupBy(f"k{i}").agg(F.sum("c").alias("size"), F.max("c").alias("child")).filter("size > 1")
        known = saved(left.join(sizes, f"k{i}"))
        stays = F.lit(True) if last else (F.col("size") <= crowd) | (2 * F.col("child") >= F.col("size"))
        part = known.filter(stays).select(F.col(f"k{i}").alias("region"), *[f"k{j}" for j in levels], "id", "n", "s0", "s1", (F.col("size") > crowd).alias("crowded"))
        out = part if out is None else out.union(part)
        left = known.filter(~stays).drop("size", "child")
    return out


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80, trees: int = 24, crowd: int = 32) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every document.

    Two documents link when ``100 * |A and B| >= percent * |A or B|`` over their
    distinct ``k``-word shingles, compared in whole; components are named by the
    smallest doc_id, which is the one that is kept.

    Needs ``doc_id`` (integer; it names a text) and ``text`` (null: empty); a
    document without words is linked with nothing, rows without doc_id are left out,
    other columns are ignored, repeated rows give equal rows again, an empty table
    gives an empty result.  Equal sets are one node.

    Candidates are the members of a region of a tree.  In a crowded region each meets
    its next neighbours in the order (those of longest common prefix), and then
    ``between_components`` finds all links that join components of the region, without
    making its pairs.  A link is lost only if the two share no region: at depth 3
    and 24 trees 3 in 100 million links of similarity 0.8, at depth 5 7 in 100,000,
    at depth 8 1 in 100; those depths are used only where over ``crowd`` sets that are not
    near copies begin alike.
    """
    docs = texts(docs)
    described = saved(docs.mapInArrow(_describe(k, trees), "doc_id bigint, n_shingles bigint, node bigint, keys array<bigint>, s0 bigint, s1 bigint"))
    filled = described.filter("node <> 0")
    nodes = saved(filled.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("keys", "s0", "s1")]))
    placed = saved(regions(nodes, trees, crowd))
    some, many = placed.filter("not crowded"), placed.filter("crowded")
    a, b = some.alias("a"), some.alias("b")
    side = [{c: F.col(f"{x}.{c}") for c in ("n", "s0", "s1")} for x in "ab"]
    pairs = a.join(b, (F.col("a.region") == F.col("b.region")) & (F.col("a.id") < F.col("b.id")) & _alike(*side, percent)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    order = ["region", *[f"k{j}" for j in range(len(DEPTHS))], "id"]
    ordered = many.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("region", "id")
    pairs = saved(pairs.union(ordered.mapInArrow(_next_ones, "a bigint, b bigint")).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(many.select("id")).distinct()
    sets = shingles_of(docs, asked, k)
    links = confirmed(pairs, sets, percent)
    label = components(links)

    named = many.select("region", "id").join(label, "id", "left").select("region", "id", F.coalesce("component", "id").alias("component"))
    crowds = saved(by_leader(named, "region"))
    more = saved(between_components(crowds, sets, percent))
    if not more.isEmpty():
        label = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    linked = filled.select("doc_id", "n_shingles", "node").join(nodes.select("node", "id").join(label, "id", "left").select("node", F.coalesce("component", "id").alias("component_id")), "node")
    out = linked.select("doc_id", "n_shingles", "component_id").union(described.filter("node = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that are not kept; columns are unchanged, and rows
    without doc_id stay."""
    return without(docs, near_duplicates(docs, **options).filter("not kept"))
