"""News, memory and history queries."""

from pyspark.sql import functions as F

from candlewick.functions.series import BARS as S, ratio
from candlewick.operators import reports as R, text as K
from candlewick.plans.oracle_views import ref, snap as sq, with_views
from candlewick.plans.registry import query
from candlewick.plans.shaping import KEYS, snap

# word pieces that occur in the invented prose
LEXICON = K.Lexicon(["ent", "elle", "the", "ung"], ["que", "ich", "ion", "ara"], ["ent", "th"], ["ou", "er"])


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _hits(words):
    return f"list_filter({_list(words)}, lambda w: contains(t, w))"


def _weighted(words):
    return f"coalesce(list_sum(list_transform({_hits(words)}, lambda w: 1 + 0.5 * len(list_filter({_list(LEXICON.intensifiers)}, lambda i: contains(t, i || w))))), 0)"


def _moved(words):
    return " + ".join(f"CASE WHEN contains(t, '{n}') THEN 0.5 * len(list_filter({_list(words)}, lambda w: contains(substr(t, instr(t, '{n}')), w))) ELSE 0 END" for n in LEXICON.negators)


_SCORED = dict(x="SELECT doc_id, lang, lower(text) AS t FROM documents",
               c=f"SELECT doc_id, lang, {_weighted(LEXICON.positive)} - ({_moved(LEXICON.positive)}) + ({_moved(LEXICON.negative)}) AS p, {_weighted(LEXICON.negative)} + ({_moved(LEXICON.positive)}) - ({_moved(LEXICON.negative)}) AS n FROM x",
               s="SELECT *, CASE WHEN p + n = 0 THEN 0 ELSE greatest(-1, least(1, (p - n) / (p + n))) END AS score FROM c",
               lab="SELECT *, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM s")
_W = "WITH " + ", ".join(f"{n} AS ({q})" for n, q in _SCORED.items())


@query("lexicon_sentiment", "K1", f"{_W} SELECT doc_id, {sq('score')} AS score, label FROM lab")
def lexicon_sentiment(t):
    return K.with_sentiment(t.documents, "text", LEXICON).select("doc_id", snap("score").alias("score"), "label")


@query("sentiment_summary", "K2 D18", f"""{_W} SELECT lang, count(*) AS total, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'neutral') AS neutral,
  {sq('avg(score)')} AS avg_score, {sq("count(*) FILTER (label = 'positive') / count(*)")} AS positive_ratio, {sq("count(*) FILTER (label = 'negative') / count(*)")} AS negative_ratio FROM lab GROUP BY 1""")
def sentiment_summary(t):
    out = K.sentiment_summary(K.with_sentiment(t.documents, "text", LEXICON), ["lang"])
    return out.select("lang", "total", "positive", "negative", "neutral", *[snap(c).alias(c) for c in ("avg_score", "positive_ratio", "negative_ratio")])


@query("news_dedup", "K3", """SELECT page_id, u AS url FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY page_id) AS n FROM (SELECT page_id, url AS u FROM pages)) WHERE n = 1 OR u IS NULL""")
def news_dedup(t):
    """The first page of each URL; pages without one all stay."""
    return K.dedup_by_url(t.pages.select("page_id", "url"), "url", ["page_id"])


@query("latest_news", "K3", "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def latest_news(t):
    return K.latest_news(t.documents.select("doc_id", "source", "n_chars"), "n_chars", 20, "doc_id")


@query("news_sources", "K4", """SELECT item, array_to_string(list_sort(list_distinct(list(s))), ',') AS sources FROM (SELECT doc_id AS item, 'documents' AS s FROM documents UNION ALL SELECT page_id, 'pages' FROM pages UNION ALL SELECT doc_id, 'labels' FROM labels) GROUP BY 1""")
def news_sources(t):
    out = K.merge_sources({"documents": t.documents.select(F.col("doc_id").alias("item")), "pages": t.pages.select(F.col("page_id").alias("item")),
                           "labels": t.labels.select(F.col("doc_id").alias("item"))}, "item")
    return out.select("item", F.array_join("sources", ",").alias("sources"))


@query("tokens", "K5", """SELECT doc_id, len(regexp_extract_all(text, '([一-鿿]+)', 1)) AS chinese, len(regexp_extract_all(text, '([0-9]+)', 1)) AS numbers FROM documents""")
def tokens(t):
    return t.documents.select("doc_id", F.size(K.tokens("text")).cast("long").alias("chinese"), F.size(K.tokens("text", "[0-9]+")).cast("long").alias("numbers"))


_VEC = dict(v="SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings",
            q="SELECT label, list(m ORDER BY p) AS c FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM v) GROUP BY ALL) GROUP BY 1")


@query("nearest_in_label", "K6", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _VEC.items()) + f""" SELECT vec_id, label, place, {sq('d')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id)::INT AS place FROM (
  SELECT vec_id, label, list_distance(e, c) AS d FROM v JOIN q USING (label))) WHERE place <= 5""")
def nearest_in_label(t):
    """The five documents nearest to the mean vector of their label."""
    queries = K.mean_vectors(t.embeddings, "label")
    return K.search_batch(t.embeddings, queries, "label", 5).select("vec_id", "label", "place", snap("distance").alias("distance"))


@query("nearest_to_vector", "K6", f"SELECT vec_id, {sq('d')} AS distance FROM (SELECT vec_id, list_distance(list_transform(embedding, lambda x: x::DOUBLE), list_transform(range(64), lambda i: (i % 5 - 2) / 20.0)) AS d FROM embeddings WHERE label <> 0) ORDER BY d, vec_id LIMIT 10")
def nearest_to_vector(t):
    probe = [(i % 5 - 2) / 20.0 for i in range(64)]
    return K.search(t.embeddings, probe, 10, F.col("label") != 0).select("vec_id", snap("distance").alias("distance"))


@query("metadata_filter", "K7", "SELECT label, count(*) AS n FROM embeddings WHERE label > 1 GROUP BY 1")
def metadata_filter(t):
    meta = t.embeddings.select("vec_id", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("meta"))
    return meta.filter(F.col("meta")["label"].cast("int") > 1).groupBy(F.col("meta")["label"].cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("price_summary", "K8", with_views("bars_w", f"""SELECT ts_code, close AS last_price, prev AS previous, {sq('close - prev')} AS change, {sq('(close - prev) * 100 / prev')} AS change_pct FROM (
  SELECT *, {ref('close')} AS prev, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS n FROM bars_w) WHERE n = 1"""))
def price_summary(t):
    df = t.bars_w().select(*KEYS, "close", S.ref("close").alias("previous"))
    last = df.groupBy("ts_code").agg(F.max_by(F.struct("close", "previous"), "trade_date").alias("x")).select("ts_code", "x.*")
    change = F.col("close") - F.col("previous")
    return last.select("ts_code", F.col("close").alias("last_price"), "previous", snap(change).alias("change"), snap(ratio(change * 100, "previous")).alias("change_pct"))


@query("analysis_history_page", "K9 H2", """SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY event_id DESC LIMIT 10 OFFSET 30""")
def analysis_history_page(t):
    rows = t.events.filter((F.col("event_type") == "purchase") & F.col("ts").between(F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-25 00:00:00"))))
    rows = rows.withColumn("k", F.from_json("props", "k int")["k"])
    return R.page(rows.select("event_id", "user_id", "k"), ["event_id"], 30, 10, descending=True)


@query("history_page_with_total", "K9 H2", """SELECT event_id, user_id, count(*) OVER () AS total FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 10 OFFSET 30""")
def history_page_with_total(t):
    rows = t.events.filter("event_type = 'purchase'").select("event_id", "user_id")
    return R.page_with_total(rows, ["event_id"], 30, 10, descending=True)
