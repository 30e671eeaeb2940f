"""Each stage of the pipeline against a plain version of what it decides."""

import brute
import pytest
from brute import SMALL

import corpus_pipeline as P
from candlewick.llm import packing
from candlewick.llm.toxicity import toxicity_scores


def rows_of(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def kept(spark, docs, tmp_path_factory):
    """What every stage but the last returned, by name."""
    out, now, folder = {"documents": docs}, docs, tmp_path_factory.mktemp("stages")
    for name, stage in P.STAGES[:-1]:
        stage(spark, now, SMALL).write.parquet(f"{folder}/{name}")
        now = out[name] = spark.read.parquet(f"{folder}/{name}")
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_toxic_documents_go(spark, docs, kept):
    from candlewick.llm.queries import fold

    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter(fold(4) != 2)
    toxic = {r["doc_id"] for r in toxicity_scores(docs, labels).filter("predicted = 1").collect()}
    assert set(rows_of(kept["toxicity"])) == set(rows_of(docs)) - toxic
    assert kept["toxicity"].filter("doc_id = 10008").count() in (0, 2)  # a repeated row stays repeated


def test_one_of_each_group_stays(kept):
    before = rows_of(kept["toxicity"])
    want = {d for d, (_, c) in brute.components({d: r["text"] for d, r in before.items() if d is not None}).items() if c == d}
    assert set(rows_of(kept["near_duplicates"])) - {None} == want


def test_leaks_go_and_clean_documents_stay(spark, kept):
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = rows_of(kept["near_duplicates"]), rows_of(kept["decontamination"])
    held = {d for d, r in before.items() if any(x in " ".join((r["text"] or "").split()) for x in items)}
    gone = set(before) - set(after)
    assert held <= gone and len(gone - held) <= 2


def test_secrets_are_masked(kept):
    before, after = rows_of(kept["decontamination"]), rows_of(kept["secrets"])
    assert set(before) == set(after)
    for d, r in after.items():
        found = brute.secrets(r["text"])
        if d is not None:
            assert not (found["n_assign"] or found["n_access"] or found["n_hex"]), d
            if "[secret]" not in (r["text"] or ""):
                assert r == before[d]


def test_all_text_is_packed(spark, kept):
    packed = P.packing(spark, kept["secrets"], SMALL).collect()
    tokens = packing.texts(kept["secrets"]).mapInArrow(packing.token_counts(packing.VOCABULARY), "doc_id bigint, tokens bigint").groupBy().sum("tokens").first()[0]
    assert sum(r["used"] for r in packed) == tokens
    assert {d for r in packed for d in r["doc_ids"]} == set(rows_of(kept["secrets"])) - {None}


def test_run_equals_the_stages(spark):
    out = P.run(spark, SMALL)
    now = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in P.STAGES:
        now = stage(spark, now, SMALL)
    assert sorted(out.select("bin_id", "used", "doc_ids").collect()) == sorted(now.select("bin_id", "used", "doc_ids").collect())
