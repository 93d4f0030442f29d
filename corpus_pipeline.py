"""Preparation of a training corpus in stages over the documents table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import decontaminate, jaccard_join, quality_rules, secrets, unigram
from tallybook.llm.storage import shared_folder
from tallybook.llm.vocabulary import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies of the stage: n-grams of so many words, and Jaccard similarity in per cent.
NEAR = jaccard_join.Settings(words=4, percent=85)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents they reject go."""
    return quality_rules.judged(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: of each group of linked texts the row of the smallest id stays.

    Rows are told apart by id and text, so texts that share an id are judged each
    by its own set; of rows that have both in common one stays. Rows without an id
    can't be named by a group and stay.
    """
    docs = docs.select(*COLUMNS).withColumn("row", F.xxhash64("doc_id", "text"))
    linked = jaccard_join.linked(docs.select(F.col("row").alias("doc_id"), "text"), NEAR)
    named = docs.filter("doc_id IS NOT NULL")
    members = linked.select(F.col("doc_id").alias("row"), "component_id").join(named.select("row", "doc_id"), "row")
    firsts = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    kept = named.join(firsts.select("row"), "row", "left_semi").dropDuplicates(["row"])
    return kept.select(*COLUMNS).union(docs.filter("doc_id IS NULL").select(*COLUMNS))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: passages of the benchmark are cut out of the texts."""
    found = decontaminate.contaminated(
        docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return _measured(decontaminate.removed(found))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: what is found is replaced by a mark."""
    return _measured(secrets.redacted(secrets.scanned(docs.select(*COLUMNS))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: the ids of the texts, and whether they decode to them."""
    coded = unigram.encoded(docs.select(*COLUMNS), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        "ids",
        "n_tokens",
        "n_byte_tokens",
        F.col("decoded").eqNullSafe(F.col("text")).alias("same_text"),
    )


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", cut_benchmark),
    ("secret scans", hide_secrets),
    ("SentencePiece encoding and decoding", encode),
]

#: The language-model ratios, the secret battery and the segmentation have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
