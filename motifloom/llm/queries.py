"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm._shared import stored
from motifloom.llm.ann import nearest
from motifloom.llm.byte_bpe import encode_documents
from motifloom.llm.jaccard_join import jaccard_components
from motifloom.llm.kneser_ney import score_documents, train
from motifloom.llm.langid import identify_language, learn_languages
from motifloom.llm.packing import pack_documents
from motifloom.llm.quality import learn_ranker, score_quality
from motifloom.llm.simhash import fingerprint_documents
from motifloom.llm.substring_dedup import substring_dedup
from motifloom.llm.warc import assemble, read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _in_fold(modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_in_fold(7, 2), F.lit(False))
    model = train(docs.filter(~held_out))
    return score_documents(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_in_fold(5, 0), F.lit(False))
    ranker = learn_ranker(docs, _table(spark, sf_dir, "labels"), ~held_out, cut=0.3)
    out = score_quality(docs, ranker)
    return out.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_in_fold(5, 0), F.lit(False))
    languages = learn_languages(docs, ~held_out)
    out = identify_language(docs.select("doc_id", "text"), languages)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(_table(spark, sf_dir, "pages"), min_payload_bytes=0)
    captures = assemble(read_warc(spark, manifest, with_payload=False), apart="file")  # equal rows are numbered by file
    about = F.from_json(F.col("metadata.body").cast("string"), "page_id long, url string, payload_bytes long")
    rows = captures.select(
        about["page_id"].alias("page_id"), F.coalesce("response.payload_bytes", about["payload_bytes"]).alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("target"),
    )
    rows = stored(rows, "captures")
    responses = rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.max("page_id").alias("refers_to"))
    met = rows.join(responses, "target", "left")
    return met.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash": op3_simhash,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_nearest": op7_nearest,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS s, w FROM d WHERE len(w) >= 20),
keyed AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM win),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM keyed) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM later),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
""",
    "op9_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS x FROM p),
v AS (SELECT page_id, n, x, list_transform(generate_series(1, 40), lambda i: instr('0123456789abcdef', x[i:i]) - 1) AS d FROM h),
b AS (SELECT page_id, n, x, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((((d[(5 * i) // 4 + 1] * 16 + coalesce(d[(5 * i) // 4 + 2], 0)) >> (3 - (5 * i) % 4)) & 31) AS INTEGER), 1)), '') AS g, max(page_id) OVER (PARTITION BY x) AS last FROM v)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM b
""",
    "op10_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
""",
}
