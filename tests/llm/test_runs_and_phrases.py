"""Periodic runs and collocations against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import LOWER, WORD

from candlewick.llm import phrases, queries, runs


def plain_runs(words, least=6, exponent=4):
    """(start, length, smallest period) of every run, by comparing all words q apart."""
    n, found, names = len(words), {}, {}
    x = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    for q in range(1, n // exponent + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], x[:n - q] == x[q:], [0]])))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)  # periods ascend: the smallest stays
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_documents(docs, texts, by_id):
    rows = by_id(runs.periodic_runs(docs))
    for d, t in texts.items():
        words = WORD.findall(t or "")
        want = plain_runs(words)
        assert [tuple(r) for r in rows[d]["runs"]] == want, d
        assert rows[d]["collapsed"] == collapsed(words, want) and rows[d]["n_words"] == len(words), d


def test_runs_of_random_words():
    """Few different words make runs of all kinds: nested, overlapping, touching, whole texts."""
    rng = np.random.default_rng(3)
    texts, doc, key = [], [], []
    for d in range(400):
        n = int(rng.integers(0, 90))
        words = rng.integers(0, int(rng.integers(1, 4)), n)
        if n and d % 2:
            p, a = int(rng.integers(1, 12)), int(rng.integers(0, n))
            words[a:] = words[a + (np.arange(n - a) % min(p, n - a))]
        texts.append(words.tolist())
        doc += [d] * n
        key += words.tolist()
    for least, exponent in ((6, 4), (1, 3), (20, 5)):
        s, e, p = runs.runs(np.array(key, np.uint64), np.array(doc, np.int64), least, exponent)
        first = np.searchsorted(doc, range(400))
        got = defaultdict(list)
        for i in range(len(s)):
            got[doc[s[i]]].append((int(s[i] - first[doc[s[i]]]), int(e[i] - s[i]), int(p[i])))
        assert all(got[d] == plain_runs(t, least, exponent) for d, t in enumerate(texts))
    with pytest.raises(ValueError):
        runs.runs(np.zeros(4, np.uint64), np.zeros(4, np.int64), 1, 2)


def test_repeated_tails(docs):
    """The query's tails, against the words written out."""
    for r in queries.repeated_tails(docs.filter("doc_id is not null").selectExpr("*", "text as before")).join(docs.selectExpr("doc_id", "text as before"), "doc_id").collect():
        words, h = WORD.findall(r["before"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 or not n:
            assert r["text"] == r["before"]
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r["text"].split(" ") == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


# ------------------------------------------------------------ collocations

def plain_collocations(rows, longest, threshold, top):
    """Rows of (text, lang) -> {lang: [(phrase, a, l, r, n, score)]}."""
    import re

    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    f = {k: c for k, c in f.items() if c >= threshold}
    most, out = Counter(), defaultdict(list)
    for (lang, w), a in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                most[lang, w[i:i + k]] = max(most[lang, w[i:i + k]], a)
    for (lang, w), a in f.items():
        if len(w) < 2 or 100 * most[lang, w] >= 50 * a:
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((" ".join(w), a, l, r, n[lang], score))
    return {lang: sorted(x, key=lambda p: (-p[5], -p[1], p[0].encode()))[:top] for lang, x in out.items()}


def ranked(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["lang"], r["rank"])):
        assert r["rank"] == len(out[r["lang"]]) + 1
        out[r["lang"]].append(tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")))
    return dict(out)


@pytest.mark.parametrize("options", [{}, {"part_mass": 3000, "filter_bits": 12, "top": 9}, {"longest": 4, "threshold": 4}])
def test_collocations(spark, docs, options):
    some = docs.filter("doc_id is null or doc_id < 60 or doc_id > 10000")
    rows = [(r["text"], r["lang"]) for r in some.collect()]
    want = plain_collocations(rows, options.get("longest", 3), options.get("threshold", 10), options.get("top", 2000))
    assert ranked(phrases.collocations(some, **options)) == want and sum(map(len, want.values())) > 15


def test_collocations_of_edges(spark):
    """Blanks, pieces, ties, an odd language, letters beyond ASCII, many copies of one row."""
    rows = [("Ab  cd\tAB cd, ab cd. É é\x0bab É é", "xx")] * 12 + [("ab cd é é!", None)] * 10 + [(None, "xx"), ("", None), (" . ,", "yy"), ("a b c d a b c d", "")] + [("p q r", "zz")] * 10 + [("q r s", "zz")] * 10
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'x' as phrase", "1 as n", "2 as size")
    assert ranked(phrases.collocations(df)) == plain_collocations(rows, 3, 10, 2000)


def test_empty_tables(empty):
    assert runs.periodic_runs(empty).collect() == [] and phrases.collocations(empty).collect() == []


def test_merged_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(5)
    for trial in range(20):
        threshold = int(rng.integers(2, 12))
        items = np.minimum(rng.zipf(1.3, 5000), 3000).astype(np.int64)
        capacity = len(items) // threshold + 1
        keys, counts, lost = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for part in np.array_split(rng.permutation(items), 13):
            k, c = np.unique(part, return_counts=True)
            keys, counts, cut = phrases.merge(np.concatenate([keys, k]), np.concatenate([counts, c]), capacity)
            lost += cut
            assert len(keys) <= capacity
        assert lost < threshold
        true, held = Counter(items.tolist()), dict(zip(keys.tolist(), counts.tolist(), strict=True))
        assert all(k in held and f - lost <= held[k] <= f for k, f in true.items() if f >= threshold)


def test_survivors_of_a_partition():
    import pyarrow as pa

    table = pa.table({"part": [0, 0], "mass": [14, 13], "keys": [[1, 2, 3], [1, 4]], "counts": pa.array([[9, 3, 2], [1, 12]], pa.list_(pa.int32()))})
    assert set(phrases._survivors(10)(table).column("key").to_pylist()) >= {1, 4}


def counted_rows(table, langs, words):
    """Rows of the second pass over texts."""
    import pyarrow as pa

    return list(phrases._counted(3, words)([pa.record_batch([pa.array(table, pa.binary()), pa.array(langs)], names=["text", "lang"])]))


@pytest.mark.parametrize("held", [50, 1 << 20])
def test_second_pass_counts_over_many_slices(monkeypatch, held):
    """Sequences met again in later slices are counted with those held; all are let through by a full filter."""
    monkeypatch.setattr(phrases, "SLICE", 200)
    monkeypatch.setattr(phrases, "HELD", held)
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 12, int(rng.integers(0, 60)))) + rng.choice(["", ". a b", "\nw1"]) for _ in range(90)]
    langs = [str(x) for x in rng.choice(["en", "fr"], len(texts))]
    out = counted_rows([t.encode() for t in texts], langs, np.full(4, ~np.uint64(0)))
    got, want = Counter(), Counter()
    for b in out:
        one = [(r["lang"], tuple(r["phrase"].decode().split(" ")), r["size"]) for r in b.to_pylist()]
        assert len(set(one)) == len(one)
        got.update(dict(zip(one, b.column("f").to_pylist(), strict=True)))
    for t, lang in zip(texts, langs, strict=True):
        for piece in t.replace("\n", ".").split("."):
            w = piece.split()
            want.update((lang, tuple(w[i:i + k]), k) for k in range(1, 4) for i in range(len(w) - k + 1))
    assert got == want and (len(out) > 3) == (held == 50)


def test_second_pass_does_not_redo_what_it_holds(monkeypatch):
    """It sorts and hashes each sequence of a slice once, whatever the task holds."""
    taken = []
    for name in ("unique", "union1d", "isin", "argsort", "sort"):
        def counting(first, *more, f=getattr(np, name), **options):
            taken.append(sum(len(x) for x in (first, *more) if isinstance(x, np.ndarray)))
            return f(first, *more, **options)
        monkeypatch.setattr(np, name, counting)
    monkeypatch.setattr(phrases, "SLICE", 2000)
    rng = np.random.default_rng(12)
    texts = [b" ".join(b"%x" % x for x in rng.integers(0, 4000, 100)) for _ in range(200)]
    out = counted_rows(texts, ["en"] * len(texts), np.full(4, ~np.uint64(0)))
    total = sum(sum(b.column("f").to_pylist()) for b in out)
    assert total == 200 * (100 + 99 + 98) and sum(taken) <= 1.5 * total
