"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    decontamination,
    exact_dedup,
    language_id,
    license_scan,
    main_text,
    manifest,
    near_dedup,
    packing,
    resampling,
    sql,
    substring_dedup,
    token_files,
    url_filter,
    warc,
)
from millrace.llm.tokens import vocabulary_path
from millrace.plans.registry import table
from millrace.scratch import fresh_dir

SEQUENCE_IDS = 1024
SEQUENCE_END = 2
FILE_END = 0
REPEAT_BYTES = 100
REVISIT_BYTES = 0
NEAR_WORDS = 2
URL_RULES = [
    url_filter.Rule.of("allow", "org/"),
    url_filter.Rule.of("block", "example.org/es/"),
    url_filter.Rule.of("block", "example.org/en/1"),
    url_filter.Rule.of("allow", "com/fr/"),
    url_filter.Rule.of("block", "com/de/"),
]
NEAR_PERCENT = 80


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"), REPEAT_BYTES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.report(decontamination.find(docs, table(spark, sf_dir, "benchmark")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary_path(), SEQUENCE_IDS, SEQUENCE_END)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(spark, f"{sf_dir}/documents.parquet").select(exact_dedup.DECISION)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = near_dedup.groups(docs, NEAR_WORDS, NEAR_PERCENT)
    return found


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs)
    return found.select(
        "row.doc_id",
        language_id.held_out(F.col("row.doc_id")).alias("held_out"),
        F.col("out.lang").alias("lang_pred"),
        "out.score",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc-files")
    warc.write(table(spark, sf_dir, "pages"), path, REVISIT_BYTES)
    return warc.read(spark, path)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.report(main_text.extract(table(spark, sf_dir, "pages")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary_path(), FILE_END)
    return token_files.digests(spark, path)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.report(*license_scan.scan(docs))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return resampling.report(resampling.draw(docs, target))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest.Manifest.build(docs, manifest.lowered_every_third()).audit()


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_decontamination, op3_best_fit_packing, op4_exact_dedup, op5_url_filter, op6_minhash_near_dedup, op7_language_id, op8_warc, op9_main_text, op10_token_files, op11_license_scan, op12_importance_resampling, op13_merkle_manifest)
}

ORACLES = {
    "op2_decontamination": r"""
        WITH words AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n
            FROM (SELECT doc_id, regexp_extract_all(translate(text,
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
        items AS (
            SELECT item_id, regexp_extract_all(translate(text,
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size,
                   list_aggregate(w[i : i + least(len(w), 10) - 1], 'string_agg', ' ') AS span
            FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i)
            WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT size FROM windows),
        spans AS (
            SELECT doc_id, pos, size,
                   string_agg(word, ' ') OVER (PARTITION BY doc_id, size ORDER BY pos
                       ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten,
                   list(word) OVER (PARTITION BY doc_id, size ORDER BY pos
                       ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS upto, n
            FROM words, sizes),
        hits AS (
            SELECT s.doc_id, s.pos, s.size, item_id
            FROM spans s JOIN windows v ON v.size = s.size AND s.pos + s.size - 1 <= s.n
                 AND v.span = CASE WHEN s.size = 10 THEN s.ten
                     ELSE list_aggregate(s.upto[1 : s.size], 'string_agg', ' ') END),
        hit_words AS (
            SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM hits),
        hit_items AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits)
        SELECT d.doc_id,
               coalesce((SELECT any_value(n) FROM words w WHERE w.doc_id = d.doc_id), 0) AS n_words,
               coalesce(h.n, 0) AS n_hit,
               coalesce(i.n, 0) AS n_items,
               sha256(coalesce(i.names, '')) AS items_sha256,
               coalesce(h.n, 0) > 0 AS contaminated
        FROM documents d
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM hit_words GROUP BY 1) h USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
                   FROM hit_items GROUP BY 1) i USING (doc_id)""",
    "op6_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(text,
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s
            FROM words, unnest(range(1, len(w))) AS u(i)
            UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * c >= 80 * (x.n + y.n - c)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
            SELECT doc_id, doc_id AS c FROM documents
            UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id),
        least AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id,
               d.doc_id = component_id AS kept
        FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op4_exact_dedup": r"""
        WITH folded AS (
            SELECT doc_id,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
            FROM documents)
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM folded""",
    "op8_warc": sql.warc(REVISIT_BYTES),
    "op11_license_scan": sql.license_scans(),
    "op12_importance_resampling": sql.importance_resampling(),
    "op13_merkle_manifest": sql.merkle_manifest(),
}
