"""What near-duplicate queries send and write: rows, pairs and files."""

import tracemalloc

import numpy as np
import pyarrow as pa

from candlewick.llm import forest, jaccard, latent
from candlewick.llm.components import components
from candlewick.llm.store import PARTS, dealt, repeated
from candlewick.llm.textkit import Words, flat, mix, shingle_sets


def test_hashes_are_counted_in_parts(spark):
    """Hashes there twice or more, over rows and tasks, against a plain count."""
    rng = np.random.default_rng(5)
    some = [mix(rng.integers(0, 3_000, n).astype(np.uint64)) for n in (0, 1, 2, 700, 1_500, 1_500)]
    some.append(np.full(5_000, 2**64 - 1, np.uint64))
    values, times = np.unique(np.concatenate(some), return_counts=True)
    data = spark.createDataFrame([(x.tobytes(),) for x in some], "x binary").repartition(3)

    def run(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield dealt(np.frombuffer(x, np.uint64))

    found = [r["key"] for r in repeated(data.mapInArrow(run, "part int, keys binary")).collect()]
    assert sorted(found) == sorted(values[times > 1].view(np.int64).tolist())


def test_keys_to_count_go_in_few_rows():
    """A slice sends a row per part, however many keys its documents have."""
    texts = pa.array([" ".join(f"w{d}x{i}" for i in range(400)).encode() for d in range(300)])
    batch = pa.record_batch([pa.array(range(300)), texts], names=["doc_id", "text"])
    every = np.full(1 << 10, 2**64 - 1, np.uint64)
    rows = list(jaccard._keys(5, 80, every, None)([batch]))
    assert sum(len(b) for b in rows) <= 2**PARTS and sum(len(x) // 8 for b in rows for x in b.column(1).to_pylist()) > 10 * 2**PARTS


def test_pairs_of_a_crowd_grow_with_its_members():
    """A member of a crowded region meets one neighbour in a tree, over the ends of batches too."""
    region, member = np.repeat([3, 8], [500, 40]), np.arange(540)
    batches = [pa.record_batch([pa.array(region[i:i + 90]), pa.array(member[i:i + 90])], names=["region", "id"]) for i in range(0, 540, 90)]
    pairs = [(r["a"], r["b"]) for batch in forest._next_ones(iter(batches)) for r in batch.to_pylist()]
    assert sorted(pairs) == [(i, i + 1) for i in range(539) if i != 499]


def test_components_of_few_links_take_few_tasks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (7, 7)], "a long, b long")
        found = components(links)
        assert found.rdd.getNumPartitions() == 1
        assert dict(found.collect()) == {i: 0 for i in range(41)} | {90: 90, 100: 90}
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_shingles_of_short_and_empty_texts():
    """Distinct, sorted by hash within each text; texts of fewer words are one shingle."""
    data, off = flat(pa.array([None, b"", b"a", b" A b ", b"a b c d e", b"x " * 40, b"\t\n", b"p q r s t u v w x y z", b"b"]))
    owner, value = shingle_sets(data, off, 5)
    assert np.bincount(owner, minlength=9).tolist() == [0, 0, 1, 1, 1, 1, 0, 7, 1]
    assert all((np.diff(value[owner == d]) > 0).all() for d in range(9)) and (np.diff(owner) >= 0).all()


def _vocabulary(n):
    return latent.Items.of(pa.table({"item_id": pa.array([1]), "text": pa.array([" ".join(f"v{i}" for i in range(n)).encode()])}))


def _texts(texts):
    return pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], names=["doc_id", "text"])


def test_counts_of_terms_together_take_half_a_matrix():
    """A task that counts has half the symmetric matrix and small stripes; what it sends are all passages' counts."""
    size, rng = 3000, np.random.default_rng(2)
    items = _vocabulary(size)
    texts = [" ".join(f"v{int(x)}" for x in size * rng.random(200) ** 3) for _ in range(3000)] + ["v1 " * 70_000]
    batch = _texts(texts)
    list(latent._together(items, 16, 64)([_texts(["v1 v2"])]))
    tracemalloc.start()
    sums = {}
    for out in latent._together(items, 16, 64)([batch]):
        row = out.to_pylist()[0]
        sums[row["stripe"]] = latent._numbers(out.column(1)[0], row["each"]).astype(np.int64)
        assert len(row["sum"]) <= 4 * size * -(-size // 64)
        if len(sums) == 1:
            peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * size * size
    got = np.concatenate([sums[i] for i in range(64)]).reshape(size, size)
    number = items.number(Words(*flat(pa.array([f"v{i}".encode() for i in range(size)]))).hashes())
    want, docs = np.zeros((size, size), np.int64), np.zeros(size, np.int64)
    for text in texts:
        term = number[[int(w[1:]) for w in text.split()]]
        docs[np.unique(term)] += 1
        if len(term) > 1000:
            times = sum(min(32, len(term) - at) ** 2 for at in range(0, len(term), 16))
            want[term[0], term[0]] += times
            continue
        for at in range(0, len(term), 16):
            some, many = np.unique(term[at:at + 32], return_counts=True)
            want[np.ix_(some, some)] += np.outer(many, many)
    assert got.max() > np.iinfo(np.uint16).max and np.array_equal(got, want) and np.array_equal(sums[-1], docs)


def test_terms_are_found_by_the_first_bits_of_their_hashes():
    some = np.array([0, 1, 2, 5, 1 << 48, (1 << 48) + 7, (1 << 48) + 8, 3 << 62, 2**64 - 2, 2**64 - 1], np.uint64)
    for vocabulary in (some, some[:1], some[3:5], some[-1:]):
        asked = np.unique(np.concatenate([some, some + np.uint64(1), some - np.uint64(1), mix(np.arange(1000, dtype=np.uint64))]))
        want = [list(vocabulary).index(x) if x in vocabulary else -1 for x in asked]
        assert latent.Items([1], [np.arange(len(vocabulary))], vocabulary).number(asked).tolist() == want


def test_only_places_with_enough_of_an_items_words_are_compared(spark, monkeypatch):
    """Near passages that lack an item's words are not compared word by word; items without words are found nowhere."""
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(f"v{int(x)}" for x in 400 * rng.random(n) ** 2)
    texts = [word(int(rng.integers(20, 70))) for _ in range(38)] + ["...", word(300)]
    rows = pa.table({"item_id": pa.array(range(40)), "text": pa.array([t.encode() for t in texts], pa.binary())})
    docs = [word(80) for _ in range(400)] + [f"{word(30)} {texts[i]} {word(30)}" for i in range(40)]
    frame = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(docs)], "doc_id bigint, text binary")
    space = latent.fit(frame, latent.Items.of(rows), latent.Settings())
    seen, shares = [], latent.shares

    def spy(item, common, text, least=0.0):
        told = latent.checked(item, common)
        seen.append(np.isin(text, told).sum() / len(told))
        return shares(item, common, text, least)

    monkeypatch.setattr(latent, "shares", spy)
    found = {(r["doc_id"], r["item_id"]) for b in latent._search(space, latent.Settings())([_texts(docs)]) for r in b.to_pylist()}
    assert {(400 + i, i) for i in range(40) if i != 38} <= found and not any(i == 38 for _, i in found)
    assert len(seen) >= 39 and min(seen) >= 0.6 - 1e-9
