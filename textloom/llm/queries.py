"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, cross_entropy, jaccard_join, packing, pii, quality, spotsigs, token_files, toxicity
from textloom.llm.common import table
from textloom.llm.exact_dedup import exact_dedup


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity_ssk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op4_zstd_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy.difference(table(spark, sf_dir, "documents"), good)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.best_fit(table(spark, sf_dir, "documents"), model_path=vocabulary("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents"))


def spotsigs_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.near_classes(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bradley_terry": op1_bradley_terry,
        "op2_toxicity_ssk": op2_toxicity_ssk,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_zstd_frames": op4_zstd_frames,
        "op5_pii_deobfuscation": op5_pii_deobfuscation,
        "op6_cross_entropy": op6_cross_entropy,
        "op7_best_fit": op7_best_fit,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_spotsigs": op9_spotsigs,
        "op10_byte_bpe": op10_byte_bpe,
        "spotsigs_near_copies": spotsigs_near_copies,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL}
