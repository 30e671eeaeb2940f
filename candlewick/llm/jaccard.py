"""Jaccard join of n-gram sets by vertical partitioning.

The global order of n-grams (by hash) is cut into fragments.  Two sets that
link differ in at most a ninth of their summed sizes (for 0.8), so with more
fragments than that at least one fragment holds the same n-grams in both: equal
fragments name the candidate pairs.  For each candidate pair the overlap is then
counted fragment by fragment and summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.components import components
from candlewick.llm.crowds import between_components, by_leader, shingles_of
from candlewick.llm.store import bit_filter, dealt, found, repeated, saved, texts, without
from candlewick.llm.textkit import ids, mix, shingle_sets, signed, slices

FRAGMENTS = 4  # of the overlap count
LEADERS = 2  # members of a candidate group that are compared with all others first
CROWD = 32  # members of a group whose pairs are compared one by one


def class_bounds(largest: int) -> np.ndarray:
    """Least sizes of the size classes, each about a quarter wider than the last, up to the one after ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, edges[-1] * 5 // 4))
    return np.array(edges)


def fragment_keys(owner: np.ndarray, value: np.ndarray, n_docs: int, percent: int) -> tuple[np.ndarray, ...]:
    """(text number, key, class, fragments filled in that class, how many of them may
    differ from a partner's): one key per fragment that is not empty.

    A set is cut for its own size class and for the classes below that may hold
    partners; the class gives the number of fragments, so both of a pair are cut
    alike.  Fragments empty in both agree too but name nobody; a set with so many
    empty ones that no equal fragment need remain also gives the least of its
    hashes as keys (prefix filter), which such a pair must share; their class is -1.
    """
    n = np.bincount(owner, minlength=n_docs)
    none = np.zeros(0, np.int64)
    out_doc, out_key, out_class, out_filled, out_differ = [none], [none.astype(np.uint64)], [none], [none], [none]
    begin = np.concatenate([[0], np.cumsum(n)])
    bounds = class_bounds(int(n.max(initial=1)))
    low_class = np.searchsorted(bounds, np.maximum(1, -(-n * percent // 100)), "right") - 1
    own_class = np.searchsorted(bounds, np.maximum(1, n), "right") - 1
    top = int((own_class - low_class).max(initial=0))
    for step in range(top + 1):
        use = (own_class - step >= low_class) & (n > 0)
        if not use.any():
            continue
        klass = np.maximum(own_class - step, 0)
        # of a pair the smaller has at most ``most``, the larger most * 100 / percent; a link
        # leaves at most (100 - percent) / (100 + percent) of their sum outside the overlap
        differ = (bounds[klass + 1] - 1) * (100 - percent) // percent
        pieces = differ + 3 + differ // 16
        take = use[owner]
        o, v = owner[take], value[take]
        piece = ((v >> np.uint64(32)) * pieces[o].astype(np.uint64)) >> np.uint64(32)
        start = np.ones(len(o), bool)
        start[1:] = (o[1:] != o[:-1]) | (piece[1:] != piece[:-1])
        s = np.flatnonzero(start)
        total = np.add.reduceat(mix(v), s) if len(s) else np.zeros(0, np.uint64)
        key = mix(total ^ mix(piece[s] + (klass[o[s]].astype(np.uint64) << np.uint64(40)) + np.uint64(7)))
        filled = np.bincount(o[s], minlength=n_docs)
        out_doc.append(o[s])
        out_key.append(key)
        out_class.append(klass[o[s]])
        out_filled.append(filled[o[s]])
        out_differ.append(differ[o[s]])
        sparse = np.flatnonzero(use & (filled <= differ))
        for d in sparse:
            head = value[begin[d]:begin[d] + n[d] - (-(-n[d] * percent // 100)) + 1]
            out_doc.append(np.full(len(head), d))
            out_key.append(mix(head ^ np.uint64(0x5851F42D4C957F2D)))
            out_class.append(np.full(len(head), -1))
            out_filled.append(np.zeros(len(head), np.int64))
            out_differ.append(np.zeros(len(head), np.int64))
    return tuple(np.concatenate(x) for x in (out_doc, out_key, out_class, out_filled, out_differ))


def _digest(owner: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """A hash of each set, 0 for the empty one."""
    s = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    out = np.zeros(n_docs, np.uint64)
    if len(s):
        out[owner[s]] = mix(np.add.reduceat(mix(value), s) + np.uint64(1)) | np.uint64(1)
    return out


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = ids(batch)
            for lo, hi, data, off in slices(batch.column(1)):
                owner, value = shingle_sets(data, off, k)
                yield pa.record_batch([pa.array(doc[lo:hi]), pa.array(np.bincount(owner, minlength=hi - lo)), signed(_digest(owner, value, hi - lo))],
                                      names=["doc_id", "n_shingles", "node"])
    return run


def _keys(k: int, percent: int, nodes: np.ndarray, words: np.ndarray | None):
    """Keys of the documents the filter ``nodes`` has, to be counted; with a filter of keys only
    those in it, whose they are, and how many fragments nobody else has (``alone``).
    A document with more of those in a class than may differ has no partner there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_ = ids(batch)
            for lo, hi, data, off in slices(batch.column(1)):
                owner, value = shingle_sets(data, off, k)
                take = _has(nodes, ids_[lo:hi])[owner]
                owner, value = owner[take], value[take]
                doc, key, klass, filled, differ = fragment_keys(owner, value, hi - lo, percent)
                if words is None:
                    yield dealt(key)
                    continue
                use = found(words, key)
                part = doc * 1000 + klass + 1  # there are a few hundred classes at most
                alone = filled - np.bincount(part[use], minlength=(hi - lo) * 1000)[part]
                use &= (klass < 0) | (alone <= differ)
                alone = np.where(klass < 0, 0, alone)[use]
                doc, n = doc[use], np.bincount(owner, minlength=hi - lo)
                own = np.searchsorted(class_bounds(int(n.max(initial=1))), np.maximum(1, n), "right") - 1
                yield pa.record_batch([signed(key[use]), pa.array(ids_[lo + doc]), *[pa.array(x.astype(np.int32)) for x in (n[doc], own[doc], klass[use], filled[use], alone)]],
                                      names=["key", "id", "n", "own", "class", "filled", "alone"])
    return run


def _members(k: int, nodes: np.ndarray, shared: np.ndarray | None):
    """Shingles of the documents the filter ``nodes`` has, to be counted; with a filter of shared
    shingles how many of each document's are in no other (``lonely``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_ = ids(batch)
            for lo, hi, data, off in slices(batch.column(1)):
                wanted = _has(nodes, ids_[lo:hi])
                if not wanted.any():
                    continue
                owner, value = shingle_sets(data, off, k)
                take = wanted[owner]
                if shared is None:
                    yield dealt(value[take])
                    continue
                lonely = np.bincount(owner[take], ~found(shared, value[take]), minlength=hi - lo)
                yield pa.record_batch([pa.array(ids_[lo:hi][wanted]), pa.array(lonely[wanted].astype(np.int32))], names=["id", "lonely"])
    return run


def _has(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return found(words, mix(doc.view(np.uint64)))


def _id_filter(df: DataFrame) -> np.ndarray:
    """A filter of the bigint column ``id``."""
    return bit_filter(df.select("id").mapInArrow(_mixed, "id bigint"), "id", 24)


def _segments(k: int, words: np.ndarray):
    """Sets of the documents the filter has, cut into fragments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = ids(batch)
            for lo, hi, data, off in slices(batch.column(1)):
                wanted = np.flatnonzero(_has(words, doc[lo:hi]))
                if not len(wanted):
                    continue
                owner, value = shingle_sets(data, off, k)
                keep = np.isin(owner, wanted)
                owner, value = owner[keep], value[keep]
                piece = (value >> np.uint64(64 - (FRAGMENTS - 1).bit_length())).astype(np.int32)
                s = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])])) if len(owner) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([s, [len(value)]]).astype(np.int32)), signed(value))
                yield pa.record_batch([pa.array(doc[lo:hi][owner[s]]), pa.array(piece[s]), lists], names=["id", "fragment", "grams"])
    return run


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, filter_bits: int = 27) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every document.

    Two documents link when ``100 * |A and B| >= percent * |A or B|`` over their
    distinct ``k``-word shingles; components are those of all such links, named by
    the smallest doc_id.  A document without words is linked with nothing.

    Needs ``doc_id`` (integer; it names a text) and ``text`` (null: empty); rows
    without doc_id are left out, other columns are ignored, repeated rows give
    equal rows again, an empty table gives an empty result.  Equal sets are one node, so groups of
    copies cost one.  In a candidate group (equal fragment) every member is first
    compared with ``LEADERS`` chosen ones; only pairs that are then still in
    different components are compared one by one, in groups of over ``CROWD`` members
    those that ``between_components`` names.  Large groups of near copies
    do not make all their pairs, and no link is lost.  ``filter_bits`` sizes a
    filter of keys seen twice, which saves shuffling and decides nothing.
    """
    docs = texts(docs)
    described = saved(docs.mapInArrow(_describe(k), "doc_id bigint, n_shingles bigint, node bigint"))
    nodes = saved(described.filter("node <> 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n")))
    one = _id_filter(nodes)  # a copy that it lets through is compared like any other document
    seen = repeated(docs.mapInArrow(_keys(k, percent, one, None), "part int, keys binary"))
    words = bit_filter(seen, "key", filter_bits)
    groups = saved(docs.mapInArrow(_keys(k, percent, one, words), "key bigint, id bigint, n int, own int, class int, filled int, alone int").distinct())
    rest_ = _id_filter(groups)
    twice = repeated(docs.mapInArrow(_members(k, rest_, None), "part int, keys binary"))
    lonely = docs.mapInArrow(_members(k, rest_, bit_filter(twice, "key", filter_bits)), "id bigint, lonely int").groupBy("id").agg(F.min("lonely").alias("lonely"))
    # a link leaves room for (100 - percent) of 100 shingles that only one side has: who has more in no other document has no partner
    groups = saved(groups.drop("alone").join(lonely, "id").filter(F.col("lonely") * 100 <= F.col("n") * (100 - percent)))
    agreed = saved(groups.groupBy("id", "class").agg(F.collect_list("key").alias("keys"), F.max("filled").alias("filled")))

    # leaders of a group: the one with fewest shingles of its own (what near copies
    # were made from is nearest to all), and the least by other orders
    orders = [F.xxhash64(F.lit(i), "id") if i else F.col("lonely") * F.lit(1 << 44) + F.col("id").bitwiseAND(F.lit((1 << 44) - 1)) for i in range(LEADERS)]
    heads = groups.groupBy("key").agg(F.count("*").alias("size"), *[F.min_by("id", o).alias(f"h{i}") for i, o in enumerate(orders)],
                                      *[F.min_by("n", o).alias(f"n{i}") for i, o in enumerate(orders)], *[F.min_by("own", o).alias(f"o{i}") for i, o in enumerate(orders)], *[F.min_by("lonely", o).alias(f"l{i}") for i, o in enumerate(orders)]).filter("size > 1")
    heads = heads.select("key", F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"h{i}").alias("id"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("own"), F.col(f"l{i}").alias("lonely")) for i in range(LEADERS)]))).alias("h"))
    heads = heads.select("key", F.col("h.id").alias("id2"), F.col("h.n").alias("n2"), F.col("h.own").alias("own2"), F.col("h.lonely").alias("lonely2"))
    first = saved(_ordered(groups.join(heads, "key"), percent))
    links = _verified(docs, saved(_possible(first, agreed, percent)), k, percent)
    label = components(links)
    grouped = saved(groups.join(label, "id", "left").select("key", "id", "n", "own", "class", "lonely", F.coalesce("component", "id").alias("component")))
    open_keys = grouped.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("key", "size")
    rest = grouped.join(open_keys.filter(F.col("size") <= CROWD).select("key"), "key")
    others = _ordered(rest.join(rest.selectExpr("key", "id as id2", "n as n2", "own as own2", "lonely as lonely2", "component as component2"), "key").filter("component < component2"), percent)
    others = saved(_possible(others.join(first, ["a", "b"], "left_anti"), agreed, percent))
    crowds = saved(by_leader(grouped.join(open_keys.filter(F.col("size") > CROWD).select("key"), "key"), "key"))
    more = _verified(docs, others, k, percent).select("a", "b")
    if not crowds.isEmpty():
        more = more.union(between_components(crowds, shingles_of(docs, crowds, k), percent))
    more = saved(more)
    if not more.isEmpty():
        label = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))
    named = label.select("id", "component")
    linked = described.filter("node <> 0").join(nodes.select("node", "id").join(named, "id", "left").select("node", F.coalesce("component", "id").alias("component_id")), "node")
    return (linked.select("doc_id", "n_shingles", "component_id")
            .union(described.filter("node = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a < b) with sizes and classes, where the sizes allow a link, neither
    has more shingles that nobody shares than the link leaves room for, and the key
    is one by which they are compared."""
    common = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent) - 1e-9)
    near = (F.col("id") != F.col("id2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.col("lonely") + common <= F.col("n")) & (F.col("lonely2") + common <= F.col("n2"))
    by = (F.col("class") == -1) | (F.col("class") == F.least("own", "own2"))
    swap = F.col("id") > F.col("id2")
    return pairs.filter(near & by).select(
        F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), F.least("own", "own2").alias("class"),
        F.when(swap, F.col("n2")).otherwise(F.col("n")).alias("na"), F.when(swap, F.col("n")).otherwise(F.col("n2")).alias("nb")).distinct()


def _possible(pairs: DataFrame, agreed: DataFrame, percent: int) -> DataFrame:
    """Pairs that agree in so many fragments that the others need not hold too many differences (at least one each)."""
    def side(name: str) -> DataFrame:
        return agreed.select(F.col("id").alias(name), "class", F.col("keys").alias(f"keys_{name}"), F.col("filled").alias(f"filled_{name}"))

    joined = pairs.join(side("a"), ["a", "class"], "left").join(side("b"), ["b", "class"], "left")
    same = F.coalesce(F.size(F.array_intersect("keys_a", "keys_b")), F.lit(0))
    differ = F.floor((F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent))
    return joined.filter(same + differ >= F.greatest(F.coalesce("filled_a", F.lit(0)), F.coalesce("filled_b", F.lit(0)))).select("a", "b", "na", "nb")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link: overlaps counted per fragment, then summed."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    segments = docs.mapInArrow(_segments(k, _id_filter(asked)), "id bigint, fragment int, grams array<bigint>")
    parts = pairs.select("*", F.explode(F.array(*[F.lit(i) for i in range(FRAGMENTS)])).alias("fragment"))
    parts = parts.join(segments.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("left")), ["a", "fragment"])
    parts = parts.join(segments.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("right")), ["b", "fragment"])
    # a repeated row of a document brings its fragments again: max takes them once
    parts = parts.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("left", "right")).alias("part")).groupBy("a", "b", "na", "nb", "fragment").agg(F.max("part").alias("part"))
    return parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both")).filter(
        100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([signed(mix(ids(batch, "id").view(np.uint64)))], names=["id"])


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those of a component that has a smaller doc_id: one of
    each stays (repeated rows of it too, and rows without doc_id).  Columns are unchanged."""
    return without(docs, jaccard_components(docs, **options).filter("doc_id > component_id"))
