import json

import corpus_pipeline
from motifloom.llm.langid import identify_language, learn_languages
from motifloom.llm.quality import learn_ranker, score_quality
from pyspark.sql import functions as F
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_substring_dedup import brute as passages

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_duplicates", "repeated_passages", "packing"]

    first = stages["language_id"](spark, docs, SF)
    assert first.columns == docs.columns
    rejected = identify_language(docs, learn_languages(docs, F.lit(True))).filter("lang_rejected").count()
    assert first.count() == docs.count() - rejected and rejected < 0.05 * docs.count()

    second = stages["quality_classifier"](spark, first, SF)
    low = score_quality(first, learn_ranker(first, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))).filter("quality_pred = 0").count()
    assert second.columns == docs.columns and second.count() == first.count() - low

    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    third = stages["near_duplicates"](spark, second, SF)
    kept = {i for _, i, _, c in components(rows) if i == c or (i == 0 and c == -1)}
    assert third.columns == docs.columns and {r["doc_id"] for r in third.collect()} == kept

    rows = [(r["doc_id"], r["text"]) for r in third.collect()]
    fourth = stages["repeated_passages"](spark, third, SF)
    expected = {i: text for (i, _), (_, _, text) in passages(rows, 20).items()}
    assert fourth.columns == docs.columns and {r["doc_id"]: r["text"] for r in fourth.collect()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in fourth.collect())

    packed = stages["packing"](spark, fourth, SF).collect()
    assert {r["doc_id"] for r in packed} == kept
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and json.dumps(sorted(fill.values()))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_rows_and_empty_tables(spark, texts):
    rows = [(i, t, None if n % 3 else "en", "s", None, 1) for n, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= (0 if name in ("language_id", "quality_classifier") else 10)
        assert name == "packing" or tuple(out.columns) == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), SF).count() == 0
