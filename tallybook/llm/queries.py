"""Thin queries: each applies one operator to whole tables and derives its digest columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import (
    decontaminate,
    divergence,
    jaccard_join,
    line_dedup,
    lm_scores,
    quality_classifier,
    quality_rules,
    secrets,
    token_counts,
    token_output,
    toxicity,
    unigram,
    whitening,
)
from tallybook.llm.labels import held_out, training_labels
from tallybook.llm.storage import shared_folder
from tallybook.llm.vocabulary import token_pattern, tokenizer_path

ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "log_ratio",
    )


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("word_spans", F.lit(0), lambda n, s: n + s["last"] - s["first"]).cast("long")
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL["op1_benchmark_decontamination"] = r"""
WITH lowered AS (
    SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark WHERE item_id IS NOT NULL
), cut AS (
    SELECT kind, id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), item_windows AS (
    SELECT DISTINCT id AS item_id, least(10, len(w)) AS size,
        array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS phrase
    FROM (SELECT id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k
          FROM cut WHERE kind = 'b' AND len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows
), doc_windows AS (
    SELECT id, size, k, array_to_string(w[k : k + size - 1], ' ') AS phrase
    FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS k
          FROM cut, sizes WHERE kind = 'd' AND len(w) >= size)
), hits AS (
    SELECT d.id, d.k, d.size, i.item_id
    FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.phrase = i.phrase
), words AS (
    SELECT id, count(DISTINCT p) AS n_hit
    FROM (SELECT id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY id
), named AS (
    SELECT id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY id
)
SELECT c.id AS doc_id, CAST(len(c.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN words USING (id) LEFT JOIN named USING (id) WHERE c.kind = 'd'
"""


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed("base_spans"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write(
        _table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), special_as_text=False
    )
    return token_output.read(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = unigram.encoded(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        "n_tokens",
        "n_byte_tokens",
        F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("same_text"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.counted(
        _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"),
        tokenizer_path("byte_bpe_50k.tiktoken"),
        token_pattern(),
        ("lang", "source", "text"),
    )
    return counted.select(
        "doc_id",
        "n_tokens",
        "n_crossing",
        F.get("field_tokens", 0).alias("lang_tokens"),
        F.get("field_tokens", 1).alias("source_tokens"),
        F.get("field_tokens", 2).alias("text_tokens"),
        F.size("section_tokens").cast("long").alias("n_sections"),
        F.array_join("section_tokens", ",").alias("section_tokens"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    settings = toxicity.Settings()
    labels = training_labels(_table(spark, sf_dir, "labels"), "toxic", 5, 0, settings.max_rows)
    # The sample has at most about max_rows rows of two numbers.
    model = toxicity.fit(docs.join(F.broadcast(labels), "doc_id"), settings)
    return toxicity.scored(docs, model, settings).select(
        "doc_id",
        held_out(5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(
            F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","
        ).alias("offending"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = training_labels(_table(spark, sf_dir, "labels"), "quality", 4, 2)
    scored = quality_classifier.classified(_table(spark, sf_dir, "documents"), labels)
    return scored.select(
        "doc_id",
        held_out(4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores.scored(_table(spark, sf_dir, "documents"), held_out(7, 2))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE_SQL["op13_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, place, line, s.key IS NOT NULL AND k.doc_id <> s.last AS gone
    FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_source_divergence_audit"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), grouped AS (SELECT DISTINCT lang, source FROM docs
), occurrences AS (SELECT row, lang, source, unnest(terms) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS lang_n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), lang_size AS (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang
), group_n AS (
    SELECT lang, source, term, count(*) AS n FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL
), size AS (
    SELECT g.lang, g.source, v, coalesce(sum(n), 0) AS n
    FROM grouped g JOIN (SELECT lang, v FROM lang_size) USING (lang) LEFT JOIN group_n USING (lang, source) GROUP BY ALL
), p AS (
    SELECT k.lang, s.source, k.term, lang_n, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * s.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (lang_n + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
    FROM kept k JOIN size s USING (lang) JOIN lang_size l USING (lang)
        LEFT JOIN group_n c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value
    FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (
            SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
        ) d ON d.lang = a.lang AND d.source = a.source AND d.other = b.source
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT * FROM (
        SELECT lang, source, 'term', term, p - q,
            row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
        FROM p WHERE n > 0 AND p > q) WHERE rank <= 50
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


ORACLE_SQL["op10_ngram_jaccard_join"] = r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[k : k + least(4, len(w)) - 1], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS k FROM cut WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 85 * (x.n + y.n - common)
), reached AS (
    SELECT doc_id, doc_id AS other FROM cut
    UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM cut c LEFT JOIN sizes USING (doc_id)
    JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""
