"""The inverted index as plain tables: chunks, postings, term_stats, corpus_stats."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import tokens
from textloom.sources import store
from textloom.sources.readers import json_index


@dataclass
class Index:
    """chunks: chunk_id, doc_length, and the chunk's own columns; postings: term, chunk_id, tf, doc_length;
    term_stats: term, df; corpus_stats: one row of n_chunks, total_length."""

    chunks: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame


def tokenized(chunks: DataFrame, id_col: str, text_col: str, tokenizer=tokens) -> DataFrame:
    filled = chunks.filter(F.col(id_col).isNotNull() & (F.trim(F.col(text_col)) != ""))
    return filled.withColumn("chunk_id", F.col(id_col)).withColumn("_tokens", tokenizer(F.col(text_col))).withColumn("doc_length", F.size("_tokens"))


def build(chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", tokenizer=tokens) -> Index:
    """Index of the chunks with an id and text. The length of a chunk travels with its postings, so scoring needs no
    join for it; terms are counted within a chunk before the only shuffle of postings, by term."""
    tok = tokenized(chunks, id_col, text_col, tokenizer)
    # outer explode: an inner one would compute the tokens again for a filter on their number
    tf = tok.select("chunk_id", "doc_length", F.explode_outer("_tokens").alias("term")).filter("term IS NOT NULL").groupBy("chunk_id", "doc_length", "term").agg(F.count(F.lit(1)).alias("tf"))
    postings = tf.select("term", "chunk_id", "tf", "doc_length")
    return derived(tok.drop("_tokens"), postings)


def derived(chunks: DataFrame, postings: DataFrame) -> Index:
    stats = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("total_length"))
    return Index(chunks, postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats)


def _segment(part: Index, path: str) -> str:
    """Write an index as a segment. Postings lie by term and chunk, so a frequent term spreads over files and a query's terms prune row groups."""
    spark = part.chunks.sparkSession
    name = store.put(path, {"postings": part.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"), "chunks": part.chunks})
    stored = derived(*(store.get(spark, path, t, [name]) for t in ("chunks", "postings")))
    for label, df in (("term_stats", stored.term_stats), ("corpus_stats", stored.corpus_stats)):
        df.write.parquet(f"{path}/segments/{name}/{label}")
    return name


def write(index: Index, path: str) -> None:
    """Make index the store's whole content, in one commit."""
    spark = index.chunks.sparkSession
    store.commit(spark, path, [_segment(index, path)])


def exists(spark: SparkSession, path: str) -> bool:
    return store.segments(spark, path) is not None


def load(spark: SparkSession, path: str) -> Index:
    """The stored index. Statistics are sums over its segments', so adding a segment never counts old postings again."""
    live = store.segments(spark, path)
    chunks, postings, terms, totals = (store.get(spark, path, t, live) for t in ("chunks", "postings", "term_stats", "corpus_stats"))
    if len(live) > 1:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"))
        totals = totals.agg(F.sum("n_chunks").alias("n_chunks"), F.sum("total_length").alias("total_length"))
    return Index(chunks, postings, terms, totals)


def append_new(path: str, chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", tokenizer=tokens, segments: int = 32) -> int:
    """Add the chunks whose id the stored index lacks; a repeated id within chunks goes in once. Returns how many.

    What is new becomes a segment with its own statistics and counts from its commit on, so a loss half-way changes
    nothing and running it again adds nothing twice. Of the old index only ids are read. Beyond the given number of
    segments all are written together as one.
    """
    spark = chunks.sparkSession
    at = store.last(spark, path)
    new = chunks.dropDuplicates([id_col])
    if at >= 0:
        have = store.get(spark, path, "chunks").select(F.col("chunk_id").alias("_have"))
        new = new.join(have, F.col(id_col) == F.col("_have"), "left_anti")
    draft = f"{path}/segments/_new-{uuid.uuid4().hex}"
    new.write.parquet(draft)
    name = _segment(build(spark.read.schema(new.schema).parquet(draft), id_col=id_col, text_col=text_col, tokenizer=tokenizer), path)
    store.remove(spark, draft)
    count = store.get(spark, path, "corpus_stats", [name]).first()["n_chunks"]
    if count or at < 0:
        live = [*(store.segments(spark, path) or []), name]
        store.commit(spark, path, live, at)
        if len(live) > segments:
            compact(spark, path)
    return count


def compact(spark: SparkSession, path: str) -> None:
    """Write all segments together as one."""
    write(load(spark, path), path)


def save_json(index: Index, path: str, *, k1: float = 1.5, b: float = 0.75, chunks_per_file: int = 10_000) -> None:
    """Export as JSON: each file is {"version": 1, "config", "chunks": [...]} with about chunks_per_file of the chunks."""
    files = F.greatest(F.lit(1), F.ceil(F.col("n_chunks") / chunks_per_file))
    held = index.chunks.drop("doc_length").crossJoin(F.broadcast(index.corpus_stats.select(files.alias("_files"))))  # one row
    names = [c for c in held.columns if c != "_files"]
    config = F.struct(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.struct(F.lit(True).alias("lowercase"), F.lit("NFC").alias("unicode_normalization"), F.lit(1).alias("min_token_length")).alias("tokenizer"))
    rows = held.groupBy(F.pmod(F.xxhash64("chunk_id"), F.col("_files")).alias("_file")).agg(F.collect_list(F.struct(*names)).alias("chunks"))
    rows.select(F.lit(1).alias("version"), config.alias("config"), "chunks").write.option("maxRecordsPerFile", 1).json(path)


def migrate_json(spark: SparkSession, source: str, path: str) -> dict[str, int]:
    """Rebuild a JSON export as a stored index in place of what path holds; {"source": chunks read, "stored": chunks stored}.

    Chunks without an id or text are not stored, which the numbers show.
    """
    chunks = json_index(spark, source)
    write(build(chunks.dropDuplicates(["chunk_id"])), path)
    return {"source": chunks.count(), "stored": load(spark, path).corpus_stats.first()["n_chunks"]}


def upserted(index: Index, chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", tokenizer=tokens) -> Index:
    """The index with chunks in place of those of the same ids."""
    part = build(chunks.dropDuplicates([id_col]), id_col=id_col, text_col=text_col, tokenizer=tokenizer)
    keep = lambda df: df.join(part.chunks.select("chunk_id"), "chunk_id", "left_anti")
    return derived(keep(index.chunks).unionByName(part.chunks, allowMissingColumns=True), keep(index.postings).unionByName(part.postings))


def merged(*indexes: Index) -> Index:
    """Union of indexes; of a chunk_id in several the first index's chunk stays."""
    chunks, postings = indexes[0].chunks, indexes[0].postings
    for other in indexes[1:]:
        # ids alone are compared; where few are in both, postings needn't move to lose theirs
        twice = store.staged(other.chunks.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_semi").distinct(), "twice")
        chunks, postings = (
            chunks.unionByName(other.chunks.join(twice, "chunk_id", "left_anti"), allowMissingColumns=True),
            postings.unionByName(other.postings.join(twice, "chunk_id", "left_anti")),
        )
    return derived(chunks, postings)


def contained(ids: DataFrame, index: Index, id_col: str = "chunk_id") -> DataFrame:
    """The rows of ids that the index has."""
    return ids.join(index.chunks.select(F.col("chunk_id").alias("_c")), F.col(id_col) == F.col("_c"), "left_semi")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))
