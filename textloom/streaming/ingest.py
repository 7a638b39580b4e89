"""Structured Streaming ingestion into a stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import clean
from textloom.operators import index
from textloom.operators.documents import allow_languages
from textloom.sources import store

LOG = "batch long, records long, added long, skipped long"
CHECKPOINT = "dataset string, config string, split string, last_row long, counts map<string,long>"


def ingest(
    stream: DataFrame, path: str, *, id_col: str, text_col: str = "text", languages: list[str] | None = None, language_col: str = "lang", prepare: Callable[[DataFrame], DataFrame] | None = None,
    progress: Callable[[dict[str, int]], None] | None = None,
):
    """A writer of the stream into the index at path; start it with a trigger of choice.

    Each micro-batch is cleaned, filtered, prepared (chunked, say) and appended without the ids that the index has,
    so a batch that runs again after a loss adds nothing twice; a row in the log under path tells what it brought, and
    progress, if given, is called with the same numbers.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        docs = rows.withColumn(text_col, clean(F.col(text_col)))
        docs = allow_languages(docs, languages, language_col) if languages else docs
        docs = (prepare(docs) if prepare else docs).persist()
        try:
            added = index.append_new(path, docs, id_col=id_col, text_col=text_col)
            seen = docs.count()
            spark.createDataFrame([(number, seen, added, seen - added)], LOG).write.mode("append").parquet(f"{path}/log")
            if progress:
                progress({"batch": number, "records": seen, "added": added, "skipped": seen - added})
        finally:
            docs.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint")


def progress_of(spark: SparkSession, path: str) -> DataFrame:
    """The log of an index's ingestion; a batch that ran more than once counts as it ran last."""
    log = spark.read.schema(LOG).parquet(f"{path}/log")
    return log.groupBy("batch").agg(F.max_by(F.struct("records", "added", "skipped"), "records").alias("r")).select("batch", "r.*")


def save_checkpoint(spark: SparkSession, path: str, *, dataset: str, config: str, split: str, last_row: int, **counts: int) -> None:
    """Record how far a batch ingestion of numbered records came, in one commit."""
    row = spark.createDataFrame([(dataset, config, split, last_row, {k: int(v) for k, v in counts.items()})], CHECKPOINT)
    store.commit(spark, path, [store.put(path, {"checkpoint": row})])


def load_checkpoint(spark: SparkSession, path: str, *, dataset: str, config: str, split: str) -> Row | None:
    """The last record of save_checkpoint, or None where there is none or it is another dataset's."""
    live = store.segments(spark, path)
    row = store.get(spark, path, "checkpoint", live).first() if live else None
    return row if row and (row["dataset"], row["config"], row["split"]) == (dataset, config, split) else None


def reset_checkpoint(spark: SparkSession, path: str) -> None:
    store.drop(spark, path)


def ingest_available(spark: SparkSession, source: str, schema: T.StructType, path: str, *, id_col: str, text_col: str = "text", files_per_batch: int = 64, **options) -> index.Index:
    """Ingest the files of source that earlier calls for this path haven't, and return the index.

    A source that is one file, not a folder, is one batch.
    """
    single = source.rstrip("/").endswith(".parquet") and spark.read.schema(schema).parquet(source).select(F.col("_metadata.file_path")).first()
    folder, name = source, "*.parquet"
    if single and single[0].rstrip("/").endswith("/" + source.rstrip("/").rsplit("/", 1)[1]):
        folder, name = source.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)
    ingest(stream, path, id_col=id_col, text_col=text_col, **options).trigger(availableNow=True).start().awaitTermination()
    return index.load(spark, path)
