"""Near duplicates by the forest, and links within crowds, against brute force."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlewick.llm import crowds, forest
from candlewick.llm.textkit import flat, mix, shingle_sets


def near_copies(rng, bases, copies, edits, cut=0):
    """{id: text}: copies of some texts with up to ``edits`` words changed and up to ``cut`` cut off."""
    texts, d = {}, 0
    for b, size in enumerate(bases):
        base = [f"b{b}x{i}" for i in range(size)]
        for i in range(copies):
            words = list(base)
            n = int(rng.integers(0, edits(size) + 1))
            for p in rng.choice(size, min(n, size), replace=False) if n else []:
                words[p] = f"e{b}x{int(rng.integers(1 << 40))}" if rng.uniform() < 0.9 else f"b{b}x{int(rng.integers(size))}"
            texts[d] = " ".join(words[:size - int(rng.integers(0, cut + 1))])
            d += 1
    return texts


def components(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in forest.near_duplicates(df, **options).collect()}


def test_forest(docs, texts, by_id):
    rows = by_id(forest.near_duplicates(docs))
    for d, want in brute.components(texts, 2).items():
        assert (rows[d]["n_shingles"], rows[d]["component_id"]) == want and rows[d]["kept"] == (d == want[1]), d
    kept = [r["doc_id"] for r in forest.one_of_each(docs).select("doc_id").collect()]
    assert set(kept) == {None} | {d for d, r in rows.items() if r["kept"]}


@pytest.mark.parametrize("options", [{}, {"crowd": 2}])
def test_links_at_the_limit(spark, options):
    """Groups whose members link to some and not to others; with ``crowd`` 2 nearly every region is crowded."""
    texts = near_copies(np.random.default_rng(1), (3, 5, 9, 14, 30, 60, 200), 36, lambda n: max(1, n // 8), 1)
    assert components(spark, texts, **options) == brute.components(texts, 2)


def test_a_large_crowd(spark):
    """Several hundred copies that link and many that just do not, some of which link to one another."""
    rng = np.random.default_rng(2)
    texts = near_copies(rng, (150,), 500, lambda n: 12)
    base, d = texts[0].split(), len(texts)
    for _ in range(60):
        words = list(base)
        for p in rng.choice(150, 17, replace=False):
            words[p] = f"u{int(rng.integers(1 << 40))}"
        texts[d] = " ".join(words)
        for p in rng.choice(150, 3, replace=False) if d % 3 else []:
            words[p] = f"v{int(rng.integers(1 << 40))}"
        texts[d + 1] = " ".join(words)
        d += 2
    texts |= {d + i: " ".join(base[i:110 + i]) for i in range(40)}  # cut off at either end
    want = brute.components(texts, 2)
    assert len({c for _, c in want.values()}) > 10
    assert components(spark, texts) == want


def test_links_between_components_of_a_crowd(spark):
    """Every link that joins two components is reported or follows from those reported, whoever leads."""
    rng = np.random.default_rng(4)
    for trial in range(3):
        texts = near_copies(rng, (40,), 60, lambda n: 6, 4) | {100 + i: " ".join(f"z{j}" for j in range(i % 4, 30 + i % 3)) for i in range(12)}
        sets = {}
        for d, t in texts.items():
            data, off = flat(pa.array([t.encode()]))
            sets[d] = set(shingle_sets(data, off, 2)[1].view(np.int64).tolist())
        some = {d: int(rng.choice([d, d, min(texts)])) for d in texts} if trial else {d: d for d in texts}
        leader = int(rng.choice(list(texts)))
        crowd = spark.createDataFrame([(leader, d, some[d]) for d in texts], "crowd long, id long, component long")
        grams = spark.createDataFrame([(d, sorted(s)) for d, s in sets.items()], "id long, grams array<long>")
        found = {(r["a"], r["b"]) for r in crowds.between_components(crowd, grams, 80).collect()}

        def linked(a, b):
            return 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])

        def closure(pairs):
            parent = dict(some) | {c: c for c in some.values()}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x
            for a, b in sorted(pairs):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
            return {d: root(d) for d in texts}

        assert all(linked(a, b) for a, b in found)
        assert closure(found) == closure({(a, b) for a in texts for b in texts if a < b and linked(a, b)})


def test_recall_of_a_shallow_and_a_deep_forest(spark):
    """All regions crowded and cut at the greatest depth that is there: recall of links stays over 0.9."""
    rng = np.random.default_rng(6)
    texts = {}
    for i in range(150):
        words = [f"t{i}x{j}" for j in range(60)]
        texts[2 * i] = " ".join(words)
        for p in rng.choice(60, 3, replace=False):
            words[p] = f"e{int(rng.integers(1 << 40))}"
        texts[2 * i + 1] = " ".join(words)
    want = brute.components(texts, 2)
    for options in ({"trees": 24}, {"trees": 24, "crowd": 0}, {"trees": 6}):
        got = components(spark, texts, **options)
        assert sum(got[d] == want[d] for d in texts) >= 0.9 * len(texts)


def test_minimum_hashes_estimate_similarity():
    owner = np.repeat([0, 1], 400)
    value = np.concatenate([np.arange(400), np.arange(100, 500)]).astype(np.uint64)
    value = mix(value + np.uint64(1))
    order = np.lexsort((value, owner))
    _, least = forest.signatures(owner[order], value[order], 4000)
    assert abs((least[0] == least[1]).mean() - 0.6) < 0.03


def test_edges_and_empty(spark, empty):
    assert forest.near_duplicates(empty).collect() == []
    rows = [(1, None, 9), (2, "", 9), (3, " \t", 9), (4, "one", 9), (5, "One", 9), (6, "one two", 9), (7, "two one", 9), (None, "one", 9), (8, "w " * 100_000, 9), (9, "w " * 3, 9)]
    df = spark.createDataFrame(rows + rows[3:5], "doc_id long, text string, id long").withColumns({"node": F.lit("x"), "keys": F.lit(1), "component": F.lit(2)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in forest.near_duplicates(df).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), 7: (1, 7, True), 8: (1, 8, True), 9: (1, 8, False)}
    assert forest.near_duplicates(df).count() == 11
