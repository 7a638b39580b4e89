"""A corpus pipeline of five stages over ``documents``; each stage is written as Parquet and reread by the next.

All stages take any rows: null, empty and very long texts, null or repeated ids, repeated rows, an empty table, and
further columns, which all but the last hand on. What becomes of such rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from textloom.llm.common import staged, table
from textloom.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rows that score as toxic by a model of ``labels``; rows without evidence stay, as all do without labels."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each different text, that with the smallest id; null and empty texts are one text."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; the smallest doc_id of each group stays. Texts without words link with nothing."""
    return jaccard_join.keep_first(docs, n=5, num=8, den=10)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the texts; n_chars follows. Null texts stay null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, in bins of permitted lengths; a null or empty text is its end id alone."""
    return packing.best_fit(docs, model_path=vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact),
    ("best_fit_packing", pack),
]

#: The stages hold a trained model and a graph's components, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``: bin_id, capacity, bin_tokens, position, doc_id, piece, start, n_tokens, ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
