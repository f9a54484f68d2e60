"""The registered queries of this package: each operator over its whole table, with production
parameters.  They derive the columns of the result from what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Tokenizer files are parameters; these are their names in the package that holds public ones.
BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
WORD_FILE = "word_bpe_49k.json"


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_quality_rules(spark, sf_dir):
    from .quality import judge

    judged = judge(read_table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality")


def labelled_domains(spark, sf_dir):
    """labels with the language of the document as the domain."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    return read_table(spark, sf_dir, "labels", ["doc_id"]).join(docs, "doc_id")


@register
def op2_mixing(spark, sf_dir):
    from .mixing import WEIGHTS, mix

    mixed = mix(read_table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir))
    return mixed.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(WEIGHTS)], "rate", "copies")


@register
def op3_toxicity(spark, sf_dir):
    from .toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("text_hash")


@register
def op5_sharding(spark, sf_dir):
    from .shards import shard_documents

    placed = shard_documents(read_table(spark, sf_dir, "documents"), 24, scratch_path(spark, "slot-map"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


@register
def op7_sentencepiece(spark, sf_dir):
    from .spm import encode_and_check

    return encode_and_check(read_table(spark, sf_dir, "documents"), tokenizer(PIECE_FILE))


@register
def op9_token_counts(spark, sf_dir):
    from .tokens import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer(BPE_FILE))


@register
def op10_minhash(spark, sf_dir):
    from .neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), 85)


@register
def op4_substring_dedup(spark, sf_dir):
    from .phrases import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register
def op8_fingerprints(spark, sf_dir):
    from .digest import compare_neighbours

    return compare_neighbours(read_table(spark, sf_dir, "documents"))


@register
def op6_lm_scoring(spark, sf_dir):
    from .neural_lm import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"))


@register
def op11_word_bpe(spark, sf_dir):
    from .wordbpe import encode_and_decode

    return encode_and_decode(read_table(spark, sf_dir, "documents"), tokenizer(WORD_FILE))


@register
def op12_fill_in_middle(spark, sf_dir):
    from .infill import fill_in_middle, restored

    made = fill_in_middle(read_table(spark, sf_dir, "documents"), seed=7)
    text = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256")
    )


@register
def op13_merkle_manifest(spark, sf_dir):
    from .merkle import fold, hexed, manifest, proof_text

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest(read_table(spark, sf_dir, "documents"), tampered=tampered)
    folded = made.withColumn("folded_root", fold(F.coalesce("forged", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", *[hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == hexed(F.col("root"))).alias("verified"),
    )
