"""Secret scan: a trigram index narrows the texts each rule has to read.

A rule's regular expression is turned into a Boolean query over trigrams (what
every match must contain).  An inverted index holds, for blocks of documents,
the ids of those that contain each trigram any rule asks for; postings are
intersected and united as the query says, and only the documents left are
searched by the rule.  A rule without mandatory trigrams reads every text.
Everything that touches the tables is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _p

LITERALS = 48  # an expression with more alternatives than this is treated as unknown


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` (in the syntax Java and Python share); a
    match counts if ``group`` of it has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Maximal runs of a class are what ``+`` matches, so the least length of access
# and hex is written into the pattern: other runs need not be reported first.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("host_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login_url", r"[a-z]{2,12}://[^\s:/@]+:[^\s:/@]{3,}@"),
)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What a text (in lower case) must contain to match: all of the clauses; of
    a clause any one set of trigrams.  No clause: the rule has no mandatory trigram.
    """
    clauses: list[list[frozenset[str]]] = []

    def grams(s: str) -> frozenset[str]:
        return frozenset(s[i:i + 3] for i in range(len(s) - 2))

    def flush(strings: set[str]) -> None:
        sets = {grams(s) for s in strings}
        if frozenset() in sets:
            return
        least = [s for s in sets if not any(o < s for o in sets)]
        clauses.append(sorted(least, key=sorted))

    def joined(a: set[str], b: set[str]) -> set[str] | None:
        return {x + y for x, y in product(a, b)} if len(a) * len(b) <= LITERALS else None

    def strings_of(items) -> set[str] | None:
        """All strings the items match, or None if too many or unknown."""
        out = {""}
        for item in items:
            one = strings_of_item(item)
            out = joined(out, one) if one is not None else None
            if out is None:
                return None
        return out

    def strings_of_item(item) -> set[str] | None:
        op, arg = item
        if op is _c.LITERAL:
            return {chr(arg).lower()}
        if op is _c.IN:
            if any(o is not _c.LITERAL for o, _ in arg) or len(arg) > 6:
                return None
            return {chr(a).lower() for _, a in arg}
        if op is _c.SUBPATTERN:
            return strings_of(arg[-1])
        if op is _c.BRANCH:
            parts = [strings_of(x) for x in arg[1]]
            return None if any(x is None for x in parts) else set().union(*parts)
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] is not _c.MAXREPEAT and arg[1] <= 4:
            one, out = strings_of(arg[2]), set()
            for n in range(arg[0], arg[1] + 1):
                times = {""}
                for _ in range(n):
                    times = joined(times, one) if one is not None and times is not None else None
                if times is None:
                    return None
                out |= times
            return out
        return {""} if op is _c.AT else None

    def sequence(items) -> None:
        run = {""}
        for item in items:
            one = strings_of_item(item)
            longer = joined(run, one) if one is not None else None
            if longer is not None:
                run = longer
                continue
            flush(run)
            run = {""} if one is None else one
            if one is None:
                op, arg = item
                if op is _c.SUBPATTERN:
                    sequence(arg[-1])
                elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
                    sequence(arg[2])
        flush(run)

    sequence(list(_p.parse(pattern)))
    return clauses


def candidates(docs: DataFrame, rules: tuple[Rule, ...], block_bits: int = 12) -> DataFrame:
    """(doc_id, rules: numbers of the rules to verify) from the trigram index.

    A posting list covers a block of ``2 ** block_bits`` consecutive ids, so no
    list and no group grows with the table.  Rules without clauses are not in it.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    vocabulary = sorted({g for q in queries for clause in q for option in clause for g in option})
    small = F.lower("text")
    has = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(vocabulary)]))
    entries = docs.select("doc_id", small.alias("low")).select("doc_id", F.explode(has).alias("gram"))
    number = {g: i for i, g in enumerate(vocabulary)}
    index = entries.groupBy(F.shiftright("doc_id", block_bits).alias("block")).agg(
        *[F.collect_set(F.when(F.col("gram") == i, F.col("doc_id"))).alias(f"p{i}") for i in range(len(vocabulary))])

    def lists(query) -> Column:
        def both(a: Column, b: Column) -> Column:
            return F.array_intersect(a, b)
        options = [[reduce(both, [F.col(f"p{number[g]}") for g in sorted(option)]) for option in clause] for clause in query]
        return reduce(both, [reduce(F.array_union, c) for c in options])

    def named(k: int, documents: Column) -> Column:
        return F.transform(documents, lambda d: F.struct(d.alias("doc_id"), F.lit(k).alias("rule")))

    found = [named(k, lists(q)) for k, q in enumerate(queries) if q]
    return (index.select(F.explode(F.concat(*found)).alias("x")).select("x.*")
            .groupBy("doc_id").agg(F.collect_set("rule").alias("rules")))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE)) -> DataFrame:
    """Secrets of every document: ``doc_id``, ``n_<kind>`` for the first ``base``
    rules, ``base_sha256`` and ``spans`` (``kind:start:end`` by start, then rule;
    code points, end exclusive; base rules' digest, all rules' list), ``found``
    (array of kind number, start, end).

    Needs ``doc_id`` (integer; it names a text) and ``text``; a null text is empty
    and has no spans, rows without doc_id are left out.  Other columns are ignored.
    A repeated row gives an equal row again.  An empty table gives an empty result.
    """
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scan = [k for k, r in enumerate(rules) if not trigram_query(r.pattern)]
    if len(scan) < len(rules):
        read = docs.join(candidates(docs, rules), "doc_id", "left")
    else:
        read = docs.withColumn("rules", F.lit(None).cast("array<int>"))
    # between n matches lie n + 1 pieces: their lengths give the positions
    hits = F.array_compact(F.array(*[
        F.when((F.lit(True) if k in scan else F.array_contains("rules", k)) & F.col("text").rlike(r.pattern), F.struct(
            F.lit(k).alias("kind"),
            F.transform(F.split("text", r.pattern, -1), F.char_length).alias("gap"),
            F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("match")))
        for k, r in enumerate(rules)]))
    rows = (read.select("doc_id", F.explode(hits).alias("h"))
            .select("doc_id", "h.kind", F.posexplode(F.arrays_zip(F.slice("h.gap", F.lit(1), F.size("h.match")).alias("gap"), F.col("h.match").alias("match"))).alias("i", "m"))
            .select("doc_id", "kind", "i", F.col("m.gap").alias("gap"), F.col("m.match").alias("match"))
            .distinct())  # repeated rows of a document
    along = Window.partitionBy("doc_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("match")).over(along))
    counts = reduce(lambda c, k: c.when(F.col("kind") == k, F.char_length(F.regexp_extract("match", rules[k].pattern, rules[k].group)) >= rules[k].least),
                    [k for k, r in enumerate(rules) if r.least], F.when(F.lit(False), F.lit(False))).otherwise(True)
    spans = rows.filter(counts).select("doc_id", "kind", (F.col("end") - F.char_length("match")).alias("start"), "end")
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def text_of(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    per_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"),
                                          *[F.count_if(F.col("kind") == k).alias(f"n_{rules[k].kind}") for k in range(base)])
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return (docs.select("doc_id").join(per_doc, "doc_id", "left").withColumn("found", found)
            .select("doc_id", *[F.coalesce(f"n_{rules[k].kind}", F.lit(0)).cast("long").alias(f"n_{rules[k].kind}") for k in range(base)],
                    F.sha2(text_of(F.filter("found", lambda s: s["kind"] < base)), 256).alias("base_sha256"),
                    text_of(F.col("found")).alias("spans"), "found"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[secret]") -> DataFrame:
    """The documents with every secret replaced by ``mark`` and ``n_chars`` set
    anew where the text changed; all rows and columns stay, null texts stay null."""
    spans = (secret_spans(docs, rules).filter(F.size("found") > 0).dropDuplicates(["doc_id"])
             .select(F.col("doc_id").alias("id"), F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("found")))
    # overlapping spans become one: keep a start that no earlier span covers
    spans = spans.select("id", F.expr("""aggregate(found, cast(array() as array<struct<start:bigint,end:bigint>>), (out, s) ->
        if(size(out) > 0 and s.start < element_at(out, -1).end,
           concat(slice(out, 1, size(out) - 1), array(struct(element_at(out, -1).start as start, greatest(element_at(out, -1).end, s.end) as end))),
           concat(out, array(s))))""").alias("spans"))
    joined = docs.join(spans, docs["doc_id"] == spans["id"], "left")
    text, cuts = docs["text"], spans["spans"]

    def kept(i: Column) -> Column:
        """The text between the i-th span and the next."""
        begin = F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"])
        end = F.when(i == F.size(cuts), F.char_length(text)).otherwise(F.get(cuts, i)["start"])
        return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))

    new = F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts)), kept), mark)

    def column(name: str) -> Column:
        old = docs[f"`{name}`"]
        if name == "text":
            return F.when(cuts.isNull(), old).otherwise(new).alias(name)
        if name == "n_chars":
            return F.when(cuts.isNull(), old).otherwise(F.char_length(new)).cast(docs.schema[name].dataType).alias(name)
        return old

    return joined.select(*[column(c) for c in docs.columns])
