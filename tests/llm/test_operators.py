"""Operators against brute force, over a small table with edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from brute import SMALL
from pyspark.sql import functions as F

from candlewick.llm import jaccard, latent, lattice, packing, pages, personal, quality, repeats, secrets, toxicity


def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def held(doc_id, of, fold):
    return zlib.crc32(str(doc_id).encode()) % of == fold


# ------------------------------------------------------------ secrets

def test_secrets(docs, texts, by_id):
    rows = by_id(secrets.secret_spans(docs))
    for d, t in texts.items():
        want = brute.secrets(t)
        assert rows[d]["base_sha256"] == brute.sha(want.pop("base")), d
        assert {k: rows[d][k] for k in want} == want, d
    assert rows[10_013]["n_assign"] == 1 and rows[10_013]["n_access"] == 1


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert secrets.trigram_query("[0-9a-f]{16,}") == []
    (clause,) = secrets.trigram_query("(password|passwd|ab)x?")[:1] or [None]
    assert clause is None or all(clause)
    (clause,) = secrets.trigram_query("(?:secret|token)\\s*=")
    assert sorted(sorted(o) for o in clause) == [["cre", "ecr", "ret", "sec"], ["ken", "oke", "tok"]]


def test_redaction(docs):
    out = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns
    assert out[10_013]["text"].startswith("é [secret]\" [secret] ")
    assert out[10_013]["n_chars"] == len(out[10_013]["text"])
    assert out[10_001]["text"] is None and out[None]["text"] == "no id" and out[10_004]["text"] == "one"


def test_long_passwords_in_urls(spark):
    urls = [f"amqp://{'u' * n}:{'P-' * n}@host" for n in (2, 32, 33, 64, 65, 5000)]
    df = spark.createDataFrame([*enumerate(f"at {u}/x" for u in urls), (10, "http://" + "z" * 200_000), (11, ("http://z:" + "z" * 90 + " ") * 1000)], "doc_id bigint, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(df).collect()}
    assert spans == {i: f"login_url:3:{3 + len(u) - 4}" for i, u in enumerate(urls)} | {10: "", 11: ""}
    assert all(r["text"] == "at [secret]host/x" for r in secrets.redact(df.withColumn("n_chars", F.length("text").cast("long")).filter("doc_id < 10")).collect())


# ------------------------------------------------------------ quality

def test_quality(docs, texts, by_id):
    rows = by_id(quality.quality_rules(docs))
    for d, t in texts.items():
        want = brute.quality(t)
        assert {k: rows[d][k] for k in want} == want, d
        assert not (rows[d]["kept"] and rows[d]["base_failed"])


def test_boilerplate_lines(spark):
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(i, f"Shared  LINE of a host {'and more ' * 10}\n{words} {i}" if i < 40 else f"{words} x{i}", "h", None) for i in range(60)]
    rows += [(100 + i, "copy of a text\n" + " ".join(f"c{j}" for j in range(30)), "h", None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, line string")
    out = {r["doc_id"]: r for r in quality.quality_rules(df, max_share=0.1).collect()}
    assert all(out[i]["n_boilerplate_words"] == (25 if i < 40 else 0) for i in range(60))
    assert all(out[i]["n_boilerplate_words"] == 0 and out[i]["kept"] for i in range(100, 150))  # exact copies are one text
    strict = {r["doc_id"]: r for r in quality.quality_rules(df, max_share=0.1, min_left=0.7).collect()}
    assert not any(strict[i]["kept"] for i in range(40)) and all(strict[i]["kept"] for i in range(40, 60))


# ------------------------------------------------------------ repeats

@pytest.mark.parametrize("options", [{}, {"group_rows": 1, "filter_bits": 12}])
def test_repeats(docs, texts, by_id, options):
    rows = by_id(repeats.without_repeats(docs, **options))
    for d, want in brute.windows_removed(texts).items():
        assert (rows[d]["n_words"], rows[d]["n_removed"], rows[d]["kept_sha256"]) == want, d


# ------------------------------------------------------------ Jaccard join

def test_jaccard(docs, texts, by_id):
    rows = by_id(jaccard.jaccard_components(docs))
    for d, want in brute.components(texts).items():
        assert (rows[d]["n_shingles"], rows[d]["component_id"]) == want, d
    kept = [r["doc_id"] for r in jaccard.one_of_each(docs).select("doc_id").collect()]
    assert set(kept) == {None} | {d for d, r in rows.items() if r["component_id"] == d}


def test_jaccard_near_copies_at_the_limit(spark):
    """Groups whose members link to some and not to others, around the threshold."""
    rng = np.random.default_rng(1)
    texts, d = {}, 0
    for size in (5, 6, 9, 14, 30, 60, 200):
        base = [f"b{size}x{i}" for i in range(size)]
        for edits in range(0, 12):
            for _ in range(3):
                words = list(base)
                for p in rng.choice(size, min(edits, size), replace=False) if edits else []:
                    words[p] = f"e{rng.integers(1 << 40)}"
                texts[d] = " ".join(words[:len(words) - int(rng.integers(0, 2)) * (size > 9)])
                d += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, filter_bits=12).collect()}
    assert rows == brute.components(texts)


def test_jaccard_crowd_just_under_the_limit(spark, monkeypatch):
    """130 near copies just under the limit beside many that link."""
    rng = np.random.default_rng(7)
    base, texts = [f"b{i}" for i in range(120)], {}
    for d in range(430):
        words = list(base)
        # an edit takes up to five shingles: up to two of them link to the base, five or six just fail
        for p in rng.choice(np.arange(5, 115, 6), int(rng.integers(0, 3)) if d < 300 else int(rng.integers(3, 5)), replace=False):
            words[p] = f"e{rng.integers(40) if d % 7 else rng.integers(1 << 40)}"
        texts[d] = " ".join(words)
    want = brute.components(texts)
    assert 20 < len({c for _, c in want.values()}) < 300
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for crowd in (32, 2):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()} == want


# ------------------------------------------------------------ language model

def test_lattice(docs, texts, by_id):
    once = docs.dropDuplicates(["doc_id"])
    rows = by_id(lattice.lattice_scores(once, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1))
    n, want = brute.word_model(texts, {d: held(d, 5, 1) for d in texts})
    for d, (tokens, known, base) in want.items():
        r = rows[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, held(d, 5, 1)), d
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_forward_recursion():
    weights = {" a": -1.0, " ab": -2.0, "b": -1.5, "c": -1.0, "bc": -2.2, " ": -3.0, "a": -1.1, "ü": -0.7}
    model = lattice.Lattice({k.encode(): v for k, v in weights.items()})
    for word in ["a", "abc", "cab", "bcbcbcabc", "aü", "abc" * 40, "x"]:
        text = " " + word
        sums = [1.0] + [0.0] * len(text)
        for i in range(1, len(text) + 1):
            sums[i] = sum(sums[i - k] * 10 ** weights[text[i - k:i]] for k in range(1, i + 1) if text[i - k:i] in weights)
        want = math.log10(sums[-1]) if sums[-1] > 0 else -math.inf
        got = model.log10([word.encode()])[0]
        assert got == want or math.isclose(got, want, rel_tol=1e-9)


# ------------------------------------------------------------ personal data

def test_personal(docs, texts, by_id):
    rows = by_id(personal.personal_spans(docs))
    for d, t in texts.items():
        want = brute.personal(t)
        base = want.pop("base")
        assert rows[d]["base_sha256"] == brute.sha(base), (d, base)
        assert {k: rows[d][k] for k in want} == want, d
        assert set(filter(None, base.split(","))) <= set(rows[d]["spans"].split(",")), d


def test_field_generalises():
    field = personal.train(personal.examples())
    rows = personal.examples(200, seed=99)
    joined = [" ".join(w).encode() for w, _ in rows]
    words = personal.Words(np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in joined])]))
    emit = field.emissions(personal.word_features(words))
    got, want = personal.viterbi(field, emit, words.first), np.array([y for _, ys in rows for y in ys])
    assert (got == want).mean() > 0.98 and (got == want)[want > 0].mean() > 0.9


def test_best_path_against_all_paths():
    field = personal.train(personal.examples())
    joined = [" ".join(w).encode() for w, _ in personal.examples(200, seed=99)]
    words = personal.Words(np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in joined])]))
    emit = field.emissions(personal.word_features(words))
    seen = 0
    for i in range(0, 40, 4):
        for n in (1, 2, 3, 4):
            row = emit[words.first[i] + 2:words.first[i] + 2 + n] if words.first[i + 1] - words.first[i] >= n + 2 else emit[words.first[i]:words.first[i + 1]][:n]
            n = len(row)
            paths = np.array(list(np.ndindex(*[personal.STATES] * n)))
            score = sum(row[j, paths[:, j]] for j in range(n)) + field.move[0, paths[:, 0]] + field.move[paths[:, -1], 0]
            score = score + sum(field.move[paths[:, j], paths[:, j + 1]] for j in range(n - 1))
            got = personal.viterbi(field, row, np.array([0, n]))
            assert tuple(got) == tuple(paths[np.argmax(score)])
            seen += 1
    assert seen == 40


def test_numbers_with_very_many_zeros():
    long = "a " + "0" * 5000 + "1.1.1.1 b " + "9" * 5000 + ".1.1.1"
    assert personal.base_spans(long) == [(1, 2, 5009)]


# ------------------------------------------------------------ toxicity

def test_toxicity(spark, docs, by_id):
    known = labels(spark)
    train = known.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    rows = by_id(toxicity.toxicity_scores(docs, train))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    toxic = {r["doc_id"]: r["toxic"] for r in known.collect() if r["doc_id"] in rows}
    yes, no = ([rows[d]["score"] for d, t in toxic.items() if t == x] for x in (1, 0))
    assert np.mean([a > b for a in yes for b in no]) > 0.8
    none = toxicity.toxicity_scores(docs, known.filter("false")).agg(F.max("score")).first()[0]
    assert none == 0


# ------------------------------------------------------------ decontamination

def test_leaks(spark, docs, texts):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = {(r["doc_id"], r["item_id"]) for r in latent.leaks(docs, bench).collect()}
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if t and " ".join(x.split()) in " ".join(t.split())}
    assert whole <= rows and len(rows - whole) <= 0.1 * len(whole) + 2
    planted = spark.createDataFrame([(1, None), (2, ""), (3, _paraphrase(items[0])), (4, "nothing of the kind " * 20)], "doc_id bigint, text string")
    odd = bench.union(spark.createDataFrame([(900, None), (901, " "), (None, "x y z")], bench.schema))
    assert {(r["doc_id"], r["item_id"]) for r in latent.leaks(planted, odd).collect()} == {(3, 0)}


def test_widespread_items_are_found(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 3000, n))
    hot, few, shared = " ".join(f"h{i}" for i in range(24)), "in of on at to by as an or so if we it he be is", " ".join(f"h{i}" for i in range(17)) + " e1 e2 e3 e4 e5 e6 e7"
    bench = spark.createDataFrame([(1, hot), (2, few), (3, shared), *((10 + i, word(30)) for i in range(30))], "item_id bigint, text string")
    # a third of the rows copies of one text that holds an item; rare words of other items stand around the planted ones
    rows = [(i, f"{word(20)} {hot} {word(20)}" if i % 2 else f"copy one two {hot} three four") for i in range(200)]
    rows += [(200 + i, f"{word(25)} {' '.join(rng.permutation(few.split()))} {word(90)}") for i in range(400)]
    rows += [(900, f"{word(40)} {few} {word(40)}"), (901, f"{word(40)} {shared} {word(40)}")]
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert {(i, 1) for i in range(200)} | {(900, 2), (901, 3)} <= got
    assert {d for d, i in got if i == 1} <= {*range(200), 901} and {d for d, i in got if i == 3} == {901}


def test_long_items_are_found(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 4000, n))
    bench = spark.createDataFrame([(1, word(3000)), (2, word(900)), *((10 + i, word(30)) for i in range(30))], "item_id bigint, text string")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    rows = [(i, word(200)) for i in range(60)] + [(100, f"{word(50)} {items[1]} {word(50)}"), (101, items[2]), (102, _paraphrase(items[2])), (103, items[1][:len(items[1]) // 3])]
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {(100, 1), (101, 2), (102, 2)}


def test_all_passages_fit_the_space(spark, monkeypatch):
    """Sums over the passages of every document, whatever their number and the tasks'."""
    docs = spark.createDataFrame([(i, f"a b d e c{i % 7}") for i in range(2500)] + [(9000, None)], "doc_id bigint, text string").repartition(7)
    bench = spark.createDataFrame([(1, "a b d e c1")], "item_id bigint, text string")
    seen, summed = [], latent._summed

    def spy(docs, run, shape):
        seen.append(summed(docs, run, shape))
        return seen[-1]

    monkeypatch.setattr(latent, "_summed", spy)
    assert {r["doc_id"] for r in latent.leaks(docs, bench).collect()} == {i for i in range(2500) if i % 7 == 1}
    assert [n for _, n in seen] == [2500, 2500] and all(np.isfinite(x).all() and x.any() for x, _ in seen)


def _exact(docs, items, least=0.85):
    """(document, item) where the whole item is a subsequence to so large a share of some stretch twice its length."""
    out = set()
    for d, text in docs.items():
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
        for i, item in items.items():
            told = re.findall(r"[a-z0-9\x80-\U0010ffff]+", item.lower())
            numbers = {w: n for n, w in enumerate(dict.fromkeys(told))}
            seen = [numbers.get(w, -1) for w in words]
            if sum(x >= 0 for x in seen) < least * len(told):
                continue
            step, size = max(1, len(told) // 2), 2 * len(told)
            if any(latent.common_subsequence([numbers[w] for w in told], seen[at:at + size]) >= least * len(told) for at in range(0, max(1, len(seen)), step)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("n", [1500, 6000])
def test_space_of_a_sample_finds_what_an_exact_search_does(spark, n):
    rng = np.random.default_rng(n)
    word = lambda k: " ".join(f"v{int(x)}" for x in 5000 * rng.random(k) ** 2)
    items = {i: word(int(rng.integers(15, 60))) for i in range(40)}
    docs = {d: word(60) for d in range(n)}
    for d in range(0, n, 50):
        item = items[d // 50 % 40].split()
        kept = [w if rng.random() > 0.1 else "x" + w for w in item]
        docs[d] = f"{word(40)} {' '.join(kept)} {word(40)}"
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaks(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(6), bench, latent.Settings(sample=200, block=25)).collect()}
    want = _exact(docs, items)
    assert len(want) >= n // 100 and len(want & got) >= 0.9 * len(want)
    assert {d for d, _ in got} <= set(range(0, n, 50)) | {d for d, _ in want}


def test_blocks_and_their_weights():
    s = latent.Settings(block=3, block_words=100)
    assert latent._blocks([(1, 60), (2, 60), (3, 10), (4, 10), (5, 10), (6, 500), (7, 1)], s) == [[1], [2, 3, 4], [5], [6], [7]]
    long = latent._blocks([(i, 3000) for i in range(200)], latent.Settings())
    assert sum(map(len, long)) == 200 and max(len(b) for b in long) * 3000 <= latent.Settings().block_words
    rng = np.random.default_rng(1)
    parts, idf, x = [rng.integers(0, 9, n) for n in (5, 1, 30)], rng.random(9), rng.random((9, 4))
    dense = np.zeros((3, 9))
    for i, t in enumerate(parts):
        np.add.at(dense[i], t, idf[t])
    a = latent._Weights.of(parts, idf)
    np.testing.assert_allclose(a.norms(), np.linalg.norm(dense, axis=1))
    np.testing.assert_allclose(a.times(x), dense @ x)
    np.testing.assert_allclose(a.transposed_times(dense @ x), dense.T @ (dense @ x))


def _paraphrase(text):
    words = text.split()
    return "before it " + " ".join(w if i % 6 else "other" for i, w in enumerate(words)) + " after it"


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 20).tolist()
        table = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert latent.common_subsequence(a, b) == table[-1, -1]


# ------------------------------------------------------------ packing

def test_packing(docs):
    rows = packing.packed(docs, shard_rows=100).collect()
    pieces = defaultdict(list)
    for r in rows:
        assert sum(p["size"] for p in r["pieces"]) == r["used"] <= r["capacity"]
        assert r["capacity"] == min(c for c in packing.LENGTHS if c >= r["used"])
        for p in r["pieces"]:
            pieces[p["doc_id"]].append((p["start"], p["size"]))
    tokens = {r["doc_id"]: r["tokens"] for r in packing.texts(docs).mapInArrow(packing.token_counts(packing.VOCABULARY), "doc_id bigint, tokens bigint").collect()}
    copies = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    assert set(pieces) == set(tokens) == set(copies) - {None}
    for d, found in pieces.items():
        times = Counter(found)
        assert set(times.values()) == {copies[d]} and sum(size for _, size in times) == tokens[d]
        assert sorted(times)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(times), sorted(times)[1:]))
    assert tokens[10_001] == tokens[10_002] == 1


def test_best_fit():
    of, lengths = packing.pack([5, 3, 3, 2, 8, 1], (4, 8), 0)
    assert lengths[of[4]] == 8 and of.count(of[4]) == 1 and of[0] == of[1]
    assert packing.pack([], (4, 8), 0) == ([], [])
    sizes = np.random.default_rng(2).integers(1, 900, 3000).tolist()
    of, lengths = packing.pack(sizes, (256, 512, 1024), 16)
    used = np.bincount(of, sizes)
    assert (used <= lengths).all() and used.sum() / sum(lengths) > 0.99


# ------------------------------------------------------------ pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="content"><h1>Title &amp; more</h1><p>First   para <b>bold</b>.<p>Second&nbsp;one<br>goes on</p><div class="ad">Buy</div>
<form><p>Name</p></form><ul><li>point one</li><li>point two</li></ul></div><aside><p>Related long text that is long enough to win by length alone, were it not aside.</p></aside>
<div id="comments"><p>I disagree with all of it, at length, and at more length still, to no end whatsoever.</p></div><footer>&copy;</footer></body></html>"""


def test_pages(spark, empty):
    rows = [(1, "http://a.example/x", PAGE, "1"), (2, "http://www.a.example/y", PAGE.replace("First", "Other"), None), (3, None, None, None), (4, "http://b.example", "", None),
            (5, "x", "plain text only", None), (1, "http://a.example/x", PAGE, "1"), (6, "http://a.example/z", "<div class=content>unclosed <p>a &lt; b", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = {r["page_id"]: r for r in pages.main_text(df).collect()}
    want = "Title & more\nFirst para bold.\nSecond one goes on\npoint one\npoint two"
    assert out[1]["text"] == want and out[1]["n_chars"] == len(want)
    assert out[2]["text"] == want.replace("First", "Other")
    assert out[3]["text"] == out[4]["text"] == "" and out[3]["n_chars"] == 0
    assert out[5]["text"] == "plain text only" and out[6]["text"] == "unclosed\na < b"
    assert pages.main_text(df).count() == len(rows)


def test_figures_and_headers_of_an_article_stay():
    page = """<body><header><p>Site</p></header><article><header><h1>Title</h1></header><p>Text of it.</p><figure><img src=x><video><p>no</p></video><table><tr><td>1</td><td>2</td></tr></table>
    <figcaption>Caption</figcaption></figure><figure><pre>code()</pre></figure><footer>Written by A.</footer></article><footer>Site again</footer></body>"""
    assert pages.extract(page, []) == "Title\nText of it.\n1\n2\nCaption\ncode()\nWritten by A."


def test_all_classes_are_in_the_path():
    page = "<body><div class='a b c d story'><p>the text</p></div><div class='a b c d teaser'><p>not it</p></div></body>"
    assert pages.extract(page, ["/body/div.a.b.c.d.story"]) == "the text"
    assert len({c.path for c in pages.read(page).containers if "div" in c.path}) == 2


@pytest.mark.parametrize("page, want", [
    ("<article class='post'><p>The article.</p></article><article class='comment'><p>Reader says a very long thing about it all.</p></article>", "The article."),
    ("<div class='content has-sidebar'><p>The article itself.</p></div><div class='box'><p>Box.</p></div>", "The article itself."),
    ("<div id='main' class='no-sidebar post'><p>The article.</p></div>", "The article."),
    ("<div class='post comments-open'><p>The article.</p><ul class='comments'><li>Reader</li></ul><div class='comment-list'><p>Reader</p></div></div>", "The article."),
    ("<div><p it's>The article</p><p>isn't over.</p></div>", "The article\nisn't over."),
    ("<div><p title=\"a > b\" class = 'x'>One</p><p data-role='menu'>two</p></div>", "One\ntwo"),
    ("<article><p>Text.</p><div class='ad-box'><div class='inner'><p>Buy now, buy now, buy now, buy now.</p></div></div><p>More.</p></article>", "Text.\nMore."),
    ("<div class='ad'><p>Buy now.</p></div>", ""),
    ("<body class='sidebar-left'><div><p>The text.</p></div></body>", "The text.")])
def test_class_words(page, want):
    assert pages.extract(page, []) == want


def test_an_aside_of_most_pages_is_their_article(spark):
    """What classes call an aside, but holds the running text of a host's pages, wins the host's vote."""
    page = "<body><div class='widget'><p>{}</p></div><div><p>by me</p></div></body>"
    rows = [(i, "http://h.example/", page.format("running text here " * 9)) for i in range(4)] + [(9, "http://k.example/", page.format("promo " * 90))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for broadcast_bytes in (1 << 20, 0):
        out = {r["page_id"]: r["text"] for r in pages.main_text(df, broadcast_bytes=broadcast_bytes, salts=3).collect()}
        assert out[0] == ("running text here " * 9).strip() and out[9] == "by me" and len(out) == 5


def test_paths_of_the_host_decide(spark):
    """A page whose own best container is another is read along its host's path."""
    page = "<body><div class='story12'><p>{}</p></div><div class='box'><p>{}</p></div></body>"
    rows = [(i, "http://h.example/", page.format("story text here " * 9, "box")) for i in range(9)] + [(9, "http://h.example/", page.format("short story", "long box text " * 20))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r["page_id"]: r["text"] for r in pages.main_text(df, least_share=0.2).collect()}
    assert out[9] == "short story"


# ------------------------------------------------------------ empty tables

def test_empty(spark, empty):
    page = spark.createDataFrame([], "page_id bigint, url string, html string")
    bench = spark.createDataFrame([(1, "some item of text")], "item_id bigint, text string")
    none = bench.filter("false")
    for df in (secrets.secret_spans(empty), quality.quality_rules(empty), repeats.without_repeats(empty), jaccard.jaccard_components(empty), lattice.lattice_scores(empty, F.lit(False)),
               personal.personal_spans(empty), toxicity.toxicity_scores(empty, labels(spark)), latent.leaks(empty, bench), latent.leaks(empty, none), packing.packed(empty), pages.main_text(page)):
        assert df.collect() == []


@pytest.mark.parametrize("dense", [4096, 0])
def test_space_is_fitted_to_every_document(spark, monkeypatch, dense):
    """Products and document frequencies are those of all documents, whatever ``sample`` says and on both paths."""
    monkeypatch.setattr(latent, "_DENSE", dense)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 90, int(n))) for n in rng.integers(0, 120, 700)]
    docs = spark.createDataFrame([*enumerate(texts), (9000, None)], "doc_id bigint, text string").repartition(5)
    items = [" ".join(f"v{x}" for x in rng.integers(0, 60, 20)) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    vocabulary = {w: i for i, w in enumerate(sorted({w for x in items for w in x.split()}))}
    passages, df = [], np.zeros(len(vocabulary))
    for text in texts:
        words = text.split()
        for w in set(words) & set(vocabulary):
            df[vocabulary[w]] += 1
        for at in range(0, len(words), 16):
            passages.append(np.bincount([vocabulary[w] for w in words[at:at + 32] if w in vocabulary], minlength=len(vocabulary)))
    a = np.array(passages) * (np.log((len(texts) + 2) / (df + 1)) + 0.1)
    seen, summed = [], latent._summed

    def spy(docs, run, shape):
        seen.append(summed(docs, run, shape))
        return seen[-1]

    monkeypatch.setattr(latent, "_summed", spy)
    latent.leaks(docs, bench, latent.Settings(sample=10)).collect()
    (z, n), (g, m) = seen
    assert n == m == len(passages)
    # terms are in another order: singular values of the passages tell, as the random matrix is square
    assert np.isclose(np.trace(g), (a ** 2).sum(), rtol=1e-4)
    assert np.allclose(np.linalg.eigvalsh(g), np.linalg.eigvalsh(a.T @ a), rtol=1e-3, atol=1e-3 * (a ** 2).sum() / len(vocabulary))
