"""Links in crowds: groups of sets too large for comparing all of their pairs.

The difference of two sets is that of their differences to a third one, the leader:
x ^ y = (x ^ L) ^ (y ^ L).  Near copies of one text differ little from it, and
changes made to one copy are seldom made to another, so an index over changes names
few pairs where an index over the sets would name all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import bit_filter, found, saved
from candlewick.llm.textkit import ids, mix, shingle_sets, signed, slices


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([signed(mix(ids(batch, "id").view(np.uint64)))], names=["id"])


def _sets(k: int, wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = ids(batch)
            for lo, hi, data, off in slices(batch.column(1)):
                some = np.flatnonzero(found(wanted, mix(doc[lo:hi].view(np.uint64))))
                if not len(some):
                    continue
                owner, value = shingle_sets(data, off, k)
                begin, end = np.searchsorted(owner, some), np.searchsorted(owner, some, "right")
                value = np.concatenate([value[b:e] for b, e in zip(begin, end, strict=True)])
                bounds = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
                yield pa.record_batch([pa.array(doc[lo:hi][some]), pa.ListArray.from_arrays(pa.array(bounds), signed(value))], names=["id", "grams"])
    return run


def shingles_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, grams) of the documents named by the column ``id`` of ``wanted``, once each,
    saved.  Others may be among them: the filter of ids has a fixed size."""
    words = bit_filter(wanted.select("id").mapInArrow(_mixed, "id bigint"), "id", 24)
    return saved(docs.mapInArrow(_sets(k, words), "id bigint, grams array<bigint>").groupBy("id").agg(F.first("grams").alias("grams")))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link."""
    both = (pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("grams").alias("left")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("right")), "b"))
    both = both.select("a", "b", (F.size("left") + F.size("right")).alias("sum"), F.size(F.array_intersect("left", "right")).alias("overlap"))
    return both.filter(100 * F.col("overlap") >= percent * (F.col("sum") - F.col("overlap"))).select("a", "b")


def by_leader(members: DataFrame, group: str) -> DataFrame:
    """Crowds of the groups that have members (``group``, id, component) of more than one
    component.  A group is led by the smallest id of its largest component, whether
    that is a member or not, so groups of one cluster are one crowd."""
    sizes = members.groupBy(group, "component").agg(F.count("*").alias("c"))
    leaders = sizes.groupBy(group).agg(F.max_by("component", F.struct("c", "component")).alias("crowd"), F.count("*").alias("sides")).filter("sides > 1").select(group, "crowd")
    crowds = members.join(leaders, group).select("crowd", "id", "component")
    return crowds.union(leaders.select("crowd", F.col("crowd").alias("id"), F.col("crowd").alias("component"))).distinct()


def between_components(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of links that join the components of a crowd: all that matter, and no pair
    within a component.

    ``crowds``: distinct (crowd, id, component), where ``crowd`` is the id of one of them,
    its leader; ``sets``: (id, grams) of all of them.  Two sets link when they differ
    in at most d = (sum of sizes) * (100 - percent) / (100 + percent) elements.

    Members that link to the leader are found by their differences D to it.  Any
    other pair x, y must share o = (|D(x)| + |D(y)| - d) / 2 elements of D or more.
    With D in one order, what cannot be shared between components first and then the
    rarest, they share one among the first |D| - o + 1 of each.  x being no partner
    of the leader makes o so large that this is half of D(y) or less, the rare half:
    changes that only y has, as a rule.  These prefixes are indexed, what meets is
    compared in whole, and nothing else can link.
    """
    spare = F.lit((100 - percent) / (100 + percent))
    lead = crowds.filter("id = crowd").join(sets, "id").select("crowd", F.col("component").alias("lead"), F.col("grams").alias("centre"))
    members = crowds.join(sets, "id").join(lead, "crowd")
    members = members.select("crowd", "id", "component", "lead", F.size("grams").alias("n"), F.size("centre").alias("m"),
                             F.concat(F.array_except("grams", "centre"), F.array_except("centre", "grams")).alias("diff"))
    members = members.withColumn("p", F.size("diff"))
    links = F.col("p") * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)
    members = saved(members.withColumn("far", ~links & (F.col("component") != F.col("lead"))).withColumn("side", F.when(F.col("far"), F.col("component")).otherwise(F.col("lead"))))
    star = members.filter(links & (F.col("component") != F.col("lead"))).select(F.least("crowd", "id").alias("a"), F.greatest("crowd", "id").alias("b"))
    open_crowds = members.filter("far").select("crowd").distinct()
    if open_crowds.isEmpty():
        return star.distinct()

    parts = members.join(open_crowds, "crowd", "left_semi").select("crowd", "id", "side", "far", F.explode("diff").alias("gram"))
    useful = parts.groupBy("crowd", "gram").agg(F.count("*").alias("times"), F.min("side").alias("lo"), F.max("side").alias("hi"), F.max("far").alias("any")).filter("lo < hi and any").select("crowd", "gram", "times")
    shared = parts.join(useful, ["crowd", "gram"]).groupBy("crowd", "id").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("shared"))
    listed = members.drop("diff", "component", "lead").join(shared, ["crowd", "id"])
    alone = F.col("p") - F.size("shared")
    index = F.floor((F.col("p") + (F.col("n") - F.col("m")) * spare) / 2 + 1 + 1e-9)
    probe = F.when(F.col("far"), F.floor((F.col("p") + (F.col("n") + F.col("m")) * spare) / 2 + 1 + 1e-9)).otherwise(F.lit(0))
    listed = listed.withColumn("index", index).withColumn("take", F.least(F.greatest(index, probe) - alone, F.size("shared")).cast("int")).filter("take > 0")
    rows = listed.select("crowd", "id", "n", "p", "side", "far", "index", alone.alias("alone"), F.posexplode(F.slice("shared", 1, F.col("take"))).alias("at", "x"))
    rows = saved(rows.select("crowd", F.col("x.gram").alias("gram"), "id", "n", "p", "side", "far", "index", (F.col("alone") + F.col("at") + 1).alias("at")))
    left, right = rows.filter("far").alias("x"), rows.filter("at <= index").alias("y")
    d = (F.col("x.n") + F.col("y.n")) * spare + 1e-9
    near = ((F.col("x.side") != F.col("y.side")) & (~F.col("y.far") | (F.col("x.at") <= F.col("x.index")) & (F.col("x.id") < F.col("y.id")))
            & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
            & (2 * (F.col("x.at") - 1) <= F.col("x.p") - F.col("y.p") + d) & (2 * (F.col("y.at") - 1) <= F.col("y.p") - F.col("x.p") + d))
    pairs = left.join(right, (F.col("x.crowd") == F.col("y.crowd")) & (F.col("x.gram") == F.col("y.gram")) & near)
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return star.union(confirmed(pairs, sets, percent)).distinct()
