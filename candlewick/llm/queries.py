"""The registered queries of this package: name -> (program, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import sql
from candlewick.llm.forest import near_duplicates
from candlewick.llm.jaccard import jaccard_components
from candlewick.llm.latent import leaks
from candlewick.llm.lattice import lattice_scores
from candlewick.llm.packing import packed
from candlewick.llm.pages import main_text
from candlewick.llm.personal import personal_spans
from candlewick.llm.phrases import collocations
from candlewick.llm.quality import quality_rules
from candlewick.llm.repeats import without_repeats
from candlewick.llm.runs import periodic_runs
from candlewick.llm.secrets import secret_spans
from candlewick.llm.store import table
from candlewick.llm.toxicity import toxicity_scores

Program = Callable[[SparkSession, str], DataFrame]


def fold(of: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % of


def op1_nonnegative_pu_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels of fold 2 of 4 are never read."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scores = toxicity_scores(docs, labels.filter(fold(4) != 2))
    return scores.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


def op2_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_subword_lattice_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of every document; fold 1 of 5 is scored only."""
    return lattice_scores(table(spark, folder, "documents"), fold(5) == 1)


def op4_word_shape_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return personal_spans(table(spark, folder, "documents"))


def op5_variable_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 512 to 8192 tokens."""
    return packed(table(spark, folder, "documents"))


def op6_suffix_tree_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left of every document after removing 13-word windows of earlier ones."""
    return without_repeats(table(spark, folder, "documents")).drop("kept")


def op7_trigram_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secret_spans(table(spark, folder, "documents")).drop("found")


def op8_fragment_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose 5-word shingles agree to 80 %."""
    return jaccard_components(table(spark, folder, "documents"))


def op9_consensus_path_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, folder, "pages"))


def op10_cross_document_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    return quality_rules(table(spark, folder, "documents"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; of the documents whose id has a crc32 divisible by 10, the
    words from one on are repeats of the first few of them."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", F.floor(crc / 10).alias("g"), (crc % 10 == 0).alias("repeat"))
    docs = docs.withColumn("w", F.when(F.col("repeat"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    docs = docs.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("slice(flatten(array_repeat(slice(w, cast(a + 1 as int), cast(p as int)), cast((n - a + p - 1) div p as int))), 1, cast(n - a as int))")
    repeated = F.array_join(F.concat(F.expr("slice(w, 1, cast(a as int))"), tail), " ")
    return docs.select("doc_id", F.when(F.col("repeat") & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_run_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, after a tenth of them have had their tails repeated."""
    found = periodic_runs(repeated_tails(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), F.concat(x["period"].cast("string"), F.lit("\n")))), "")
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_phrase_collocation_mining(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 phrases of each language whose words are bound together most."""
    return collocations(table(spark, folder, "documents"))


def op13_lsh_forest_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose 2-word shingles agree to 80 %, and the one of each that is kept."""
    return near_duplicates(table(spark, folder, "documents"))


QUERIES: dict[str, Program] = {f.__name__: f for f in (
    op1_nonnegative_pu_toxicity,
    op2_latent_decontamination,
    op3_subword_lattice_likelihood,
    op4_word_shape_crf,
    op5_variable_best_fit_packing,
    op6_suffix_tree_substring_dedup,
    op7_trigram_secret_scan,
    op8_fragment_jaccard_join,
    op9_consensus_path_extraction,
    op10_cross_document_line_quality,
    op11_periodic_run_detection,
    op12_phrase_collocation_mining,
    op13_lsh_forest_near_dedup,
)}
SQL: dict[str, str] = {
    "op6_suffix_tree_substring_dedup": sql.REPEATS,
    "op7_trigram_secret_scan": sql.SECRETS,
    "op8_fragment_jaccard_join": sql.JACCARD,
    "op10_cross_document_line_quality": sql.QUALITY,
    "op11_periodic_run_detection": sql.RUNS,
    "op12_phrase_collocation_mining": sql.COLLOCATIONS,
    "op13_lsh_forest_near_dedup": sql.FOREST,
}
