"""From raw question records to normalised documents: explode, clean, identify, filter, deduplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import clean, text_key

#: Raw records; every field may be absent or null.
_TEXTS = T.ArrayType(T.StringType())
RAW_RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("query_id", "source_lang", "target_lang", "language", "query", "Eng_Query", "Answer", "Eng_Answer", "query_type")]
    + [
        T.StructField("passages", T.StructType([T.StructField("is_selected", T.ArrayType(T.IntegerType())), T.StructField("English_passages", _TEXTS), T.StructField("Translated_passages", _TEXTS)])),
        T.StructField("meta", T.StringType()),
    ]
)


def json_list(parts: list[Column]) -> Column:
    """A JSON array of strings, numbers and nulls with ', ' between its items, not escaped beyond what JSON asks."""
    item = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.concat_ws(", ", *map(item, parts)), F.lit("]"))


def document_id(prefix: str, *parts: Column) -> Column:
    """prefix and 20 hex digits of the SHA-1 of the parts (strings, numbers or null) as a JSON list."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(json_list(list(parts))), 1, 20))


def normalize_records(records: DataFrame, *, dataset_name: str, dataset_config: str = "default", split: str = "validation", prefix: str = "doc-") -> DataFrame:
    """One document for each passage position of each record that has text, the translation before the English.

    Columns: document_id, text, language, dataset_name, query_id, source, metadata. Positions whose two texts are blank
    give no document. Where records have a row_index (readers.with_row_index), source carries it.
    """
    for f in RAW_RECORD.fields:
        if f.name not in records.columns:
            records = records.withColumn(f.name, F.lit(None).cast(f.dataType))
    numbered = [F.col("row_index")] if "row_index" in records.columns else []
    none = F.array().cast("array<string>")
    lists = F.arrays_zip(
        F.coalesce("passages.Translated_passages", none).alias("translated"),
        F.coalesce("passages.English_passages", none).alias("english"),
    )
    rows = records.select("*", F.posexplode(lists).alias("passage_index", "_p"))
    rows = rows.withColumns({"_t": clean(F.col("_p.translated")), "_e": clean(F.col("_p.english"))})
    rows = rows.withColumn("text", F.coalesce("_t", "_e")).filter("text IS NOT NULL")
    qid = F.col("query_id").cast("string")
    chosen = F.try_element_at(F.coalesce(F.col("passages.is_selected"), F.array().cast("array<int>")), F.col("passage_index") + 1)
    return rows.select(
        document_id(prefix, F.lit(dataset_name), F.lit(dataset_config), F.lit(split), qid, F.col("passage_index"), F.col("text")).alias("document_id"),
        "text",
        F.coalesce(clean(F.col("target_lang")), clean(F.col("language"))).alias("language"),
        F.lit(dataset_name).alias("dataset_name"),
        qid.alias("query_id"),
        F.struct(
            F.lit(dataset_config).alias("dataset_config"), F.lit(split).alias("split"), "passage_index",
            F.when(F.col("_t").isNotNull(), "translated").otherwise("english_fallback").alias("text_source"),
            "source_lang", "target_lang", chosen.alias("is_selected"), F.col("_e").alias("english_text"), F.col("_t").alias("translated_text"), *numbered,
        ).alias("source"),
        F.struct(
            clean(F.col("query")).alias("query"), clean(F.col("Eng_Query")).alias("english_query"), clean(F.col("Answer")).alias("answer"),
            clean(F.col("Eng_Answer")).alias("english_answer"), "query_type", F.col("meta").alias("translation_meta"),
        ).alias("metadata"),
    )


def allow_languages(docs: DataFrame, languages: list[str] | None, column: str = "language") -> DataFrame:
    """Documents of the languages, and those without one; all where no list is given."""
    return docs if not languages else docs.filter(F.col(column).isNull() | F.col(column).isin(*languages))


def deduplicate(docs: DataFrame, *order: str, language: str = "language", text: str = "text") -> DataFrame:
    """The first document, by order, of each language and case-insensitive text; a null language is one of its own.

    Keys are digests, so the aggregate's shuffle moves no texts, and a key that many rows share costs a row for each
    task. Rows move once, by order, for the semi-join that keeps the first ones.
    """
    key = F.sha2(F.coalesce(text_key(F.col(text)), F.lit("\0")), 256)
    first = docs.groupBy(F.col(language).alias("_l"), key.alias("_k")).agg(F.min(F.struct(*order)).alias("_first")).select("_first").distinct()
    return docs.join(first, F.struct(*order) == F.col("_first"), "left_semi")


def load_documents(records: DataFrame, *, dataset_name: str, dataset_config: str = "default", split: str = "validation", languages: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, stats): normalised, of the languages, the first of each language and text by record and place.

    stats is one row: records_read, malformed_records, documents_created, empty_passages_removed,
    duplicate_documents_removed. Malformed are records whose reader left them in a ``_corrupt_record`` column. records
    need an order: their row_index, or else their query_id.
    """
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in records.columns else F.lit(False)
    whole = records.filter(~bad)
    if "row_index" not in whole.columns:
        whole = whole.withColumn("row_index", F.xxhash64("query_id"))
    found = allow_languages(normalize_records(whole, dataset_name=dataset_name, dataset_config=dataset_config, split=split), languages)
    kept = deduplicate(found, "source.row_index", "source.passage_index", "document_id")
    size = lambda c: F.coalesce(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0))
    passages = F.greatest(size(F.col("passages.Translated_passages")), size(F.col("passages.English_passages"))) if "passages" in records.columns else F.lit(0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    read = records.agg(F.count(F.lit(1)).alias("records_read"), zero(F.sum(bad.cast("long"))).alias("malformed_records"), zero(F.sum(F.when(~bad, passages))).alias("_passages"))
    made, left = found.agg(F.count(F.lit(1)).alias("_made")), kept.agg(F.count(F.lit(1)).alias("documents_created"))
    every = normalize_records(whole, dataset_name=dataset_name, dataset_config=dataset_config, split=split).agg(F.count(F.lit(1)).alias("_full"))
    # four rows of one row each
    stats = read.crossJoin(made).crossJoin(left).crossJoin(every).select(
        "records_read", "malformed_records", "documents_created", (F.col("_passages") - F.col("_full")).alias("empty_passages_removed"), (F.col("_made") - F.col("documents_created")).alias("duplicate_documents_removed")
    )
    return kept, stats


def selected(docs: DataFrame) -> DataFrame:
    """Documents or chunks whose source marks them as the answer's: is_selected is 1, as a number, text or boolean."""
    return docs.filter(F.lower(F.col("source.is_selected").cast("string")).isin("1", "true"))


def ingest_counts(docs: DataFrame, order: str, language: str = "language", text: str = "text") -> DataFrame:
    """One row: records, empties, duplicates, kept."""
    key = F.sha2(text_key(clean(F.col(text))), 256)
    return (
        docs.groupBy(F.col(language).alias("l"), key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
            F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("empties"),
            F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
            F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.lit(1))), F.lit(0)).alias("kept"),
        )
    )
