"""News and memory documents: sentiment, deduplication, search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.functions.series import col, ratio
from candlewick.session import small

# The lexicon of the sentiment score.
POSITIVE = ["上涨", "涨停", "突破", "增长", "超预期", "利好", "买入", "增持", "推荐", "大涨",
            "盈利", "利润", "业绩", "上升", "回升", "反弹", "创新高", "强势", "看好",
            "低估", "价值", "机会", "布局", "加仓", "抄底", "多头", "牛市", "景气", "复苏"]
NEGATIVE = ["下跌", "跌停", "亏损", "风险", "暴雷", "利空", "卖出", "减持", "警告", "大跌",
            "赔钱", "业绩下滑", "下降", "回落", "调整", "创新低", "弱势", "看空",
            "高估", "泡沫", "出逃", "减仓", "割肉", "空头", "熊市", "衰退", "危机"]
INTENSIFIERS = ["大幅", "明显", "显著", "持续", "强劲", "严重"]
NEGATORS = ["不", "无", "非", "未", "没有", "不是"]


@dataclass(frozen=True)
class Lexicon:
    positive: list[str] = field(default_factory=lambda: POSITIVE)
    negative: list[str] = field(default_factory=lambda: NEGATIVE)
    intensifiers: list[str] = field(default_factory=lambda: INTENSIFIERS)
    negators: list[str] = field(default_factory=lambda: NEGATORS)


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in dict.fromkeys(words)])


def _found(text: Column, words: Column) -> Column:
    return F.filter(words, lambda w: F.contains(text, w))


def _weight(text: Column, found: Column, intensifiers: Column) -> Column:
    """1 per word, half more for each intensifier standing right before it."""
    return F.aggregate(found, F.lit(0.0), lambda acc, w: acc + 1.0 + F.size(
        F.filter(intensifiers, lambda i: F.contains(text, F.concat(i, w)))) * 0.5)


def with_sentiment(df: DataFrame, text: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Add score in [-1, 1] and label.

    Each negator present moves half a point per word behind its first place from
    the word's side to the other.  Every stage is a column of its own, so the
    lower-case text and the word lists are built once per row.
    """
    more, turn = _literals(lexicon.intensifiers), _literals(lexicon.negators)
    t = F.col("_text")
    df = df.withColumn("_text", F.lower(F.coalesce(col(text), F.lit(""))))
    df = df.withColumns({"_pos": _found(t, _literals(lexicon.positive)), "_neg": _found(t, _literals(lexicon.negative)),
                         "_rests": F.transform(_found(t, turn), lambda n: F.substr(t, F.instr(t, n)))})

    def turned(found: str) -> Column:
        return F.aggregate("_rests", F.lit(0.0), lambda acc, rest: acc + F.size(
            F.filter(found, lambda w: F.contains(rest, w))) * 0.5)

    df = df.withColumns({"_to_neg": turned("_pos"), "_to_pos": turned("_neg"),
                         "_p": _weight(t, F.col("_pos"), more), "_n": _weight(t, F.col("_neg"), more)})
    p = F.col("_p") - F.col("_to_neg") + F.col("_to_pos")
    n = F.col("_n") + F.col("_to_neg") - F.col("_to_pos")
    df = df.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(p - n, p + n, 0))))
    s = F.col("score")
    df = df.withColumn("label", F.when(s > 0.1, "positive").when(s < -0.1, "negative").otherwise("neutral"))
    return df.drop("_text", "_pos", "_neg", "_rests", "_to_neg", "_to_pos", "_p", "_n")


def sentiment_summary(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    def n(name):
        return F.sum((F.col("label") == name).cast("int"))
    total = F.count(F.lit(1))
    return scored.groupBy(*(keys or [])).agg(
        total.alias("total"), *[n(x).alias(x) for x in ("positive", "negative", "neutral")], F.avg("score").alias("avg_score"),
        (n("positive") / total).alias("positive_ratio"), (n("negative") / total).alias("negative_ratio"))


def dedup_by_url(news: DataFrame, url: str, order: list[str]) -> DataFrame:
    """The first row per URL in ``order``; rows without a URL all stay.

    An aggregate rather than a window: a URL copied any number of times is reduced
    on the map side.
    """
    fields = [c for c in news.columns if c not in order and c != url]
    has = F.col(url).isNotNull() & (F.col(url) != "")
    first = (news.filter(has).groupBy(url).agg(F.min_by(F.struct(*order, *fields), F.struct(*order)).alias("n"))
             .select(F.col(url), "n.*"))
    return first.select(*news.columns).unionByName(news.filter(~has))


def latest_news(news: DataFrame, time: str, limit: int, tie: str) -> DataFrame:
    return news.orderBy(F.col(time).desc(), tie).limit(limit)


def merge_sources(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Items of all sources by key with the list of sources that have it.  The
    list is bounded by the number of sources."""
    tagged = None
    for name, df in sources.items():
        part = df.select(key).withColumn("source", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def tokens(text, pattern: str = "[一-鿿]+") -> Column:
    """Runs of Chinese characters."""
    return F.regexp_extract_all(col(text), F.lit(f"({pattern})"), F.lit(1))


# -- memory -------------------------------------------------------------------------


def distance(a, b) -> Column:
    """Euclidean distance of two vectors."""
    squares = F.zip_with(F.col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def search(memory: DataFrame, query: list[float], k: int = 5, where: Column | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest documents to one query vector, filter first.  Each task keeps
    its own k best."""
    df = memory if where is None else memory.filter(where)
    near = distance(vector, F.array(*[F.lit(float(x)) for x in query]))
    return df.withColumn("distance", near).orderBy("distance", key).limit(k)


def search_batch(memory: DataFrame, queries: DataFrame, on: str, k: int, vector: str = "embedding", query_vector: str = "query", key: str = "vec_id") -> DataFrame:
    """The k nearest documents for each query among those that share its metadata
    value ``on``.  Queries meet documents by that value, and the constant k prunes
    before the exchange."""
    rows = memory.join(small(queries), on).withColumn("distance", distance(vector, query_vector))
    w = Window.partitionBy(on).orderBy("distance", key)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def mean_vectors(memory: DataFrame, by: str, vector: str = "embedding", out: str = "query") -> DataFrame:
    """Mean vector per value of ``by``: averages per place, then put in order."""
    parts = memory.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x"))
    means = parts.groupBy(by, "p").agg(F.avg("x").alias("x"))
    # one small list per value: as long as a vector
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias(out))
