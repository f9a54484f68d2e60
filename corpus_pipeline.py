"""The corpus pipeline: five stages over ``documents``, each one operator of ``envspark.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in
the cluster's shared folder and reads it again as the next stage's input.  A row is known by its id
(null-safe, a null id being one more id) and the hash of its text, so that rows of one id with unlike
texts stand or fall each for itself; rows equal in both are one.  Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import store
from envspark.llm.mixing import mix
from envspark.llm.neardup import near_duplicates
from envspark.llm.phrases import remove_repeats
from envspark.llm.queries import PIECE_FILE, labelled_domains, tokenizer
from envspark.llm.spm import encode_documents
from envspark.llm.toxicity import score_toxicity
from envspark.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Percent of similarity from which documents are near duplicates here.
SIMILAR = 80


def identified(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and the hash of the text (null counts as empty)."""
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def same_row(rows: DataFrame, id_: str, hash_: str) -> tuple[DataFrame, Column]:
    """``rows`` (doc_id, text_hash) renamed, and the condition that matches them with documents."""
    named = rows.withColumnRenamed("doc_id", id_).withColumnRenamed("text_hash", hash_)
    return named, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("text_hash") == F.col(hash_))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    scored = score_toxicity(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))
    rejected, same = same_row(scored.where("rejected").select("doc_id", "text_hash").distinct(), "bad", "bad_hash")
    return identified(docs).join(rejected, same, "left_anti").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (a null id is the
    smallest, rows of one id go by the hash of their text)."""
    docs = identified(docs)
    row = F.xxhash64("doc_id", "text_hash")
    found = near_duplicates(docs.select(row.alias("doc_id"), "text"), SIMILAR).select(F.col("doc_id").alias("row"), "component_id").distinct()
    rows = docs.select(row.alias("row"), "doc_id", "text_hash").join(found, "row")
    first = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    kept, same = same_row(first, "good", "good_hash")
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document before them holds; texts that lose nothing stay
    as they are, the others are their remaining words."""
    docs = docs.select(*COLUMNS)
    shorter = remove_repeats(docs).where("n_removed > 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "kept").dropDuplicates(["id", "hash"])
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("hash"))
    joined = docs.join(shorter, same, "left").withColumn("text", F.coalesce("kept", "text"))
    return joined.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its fitted rate says (at least once: targets are set so that no
    domain has to be thinned out)."""
    mixed = mix(docs.select(*COLUMNS), labelled_domains(spark, sf_dir))
    copies, same = same_row(mixed.groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies")), "id", "hash")
    joined = identified(docs).join(copies, same)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row."""
    return encode_documents(docs, tokenizer(PIECE_FILE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Models and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
