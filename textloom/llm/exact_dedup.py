"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so: after a sentence end whose last letter is one of a
fixed class, at least ``min_chunk`` and at most ``max_chunk`` characters after the last cut. A chunk is known by
a 64-bit hash. The hashes are verified against the chunks' bytes: each distinct chunk is moved once, after
map-side combining, and a hash that stands for two chunks is a collision. A document is then its *recipe*, the
ordered list of its chunks' identifiers; whole texts are never moved or compared again. A document with a
collided hash carries the bytes of those chunks beside its recipe, so equal keys always mean equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import one_of_each, staged

#: A chunk ends after one of these letters, a sentence end and a space.
CUT = r"(?<=[a-hà-ï][.!?।。] )"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunked(norm: Column, min_chunk: int = 256, max_chunk: int = 4096) -> Column:
    """The chunks of a text in order; joined, they are the text again."""
    pattern = rf"(?s).{{{min_chunk},{max_chunk}}}?(?:{CUT}|\z)|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def _identifier(chunk: Column, hash_bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if hash_bits >= 64 else F.pmod(h, F.lit(1 << hash_bits))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chunk: int = 256, max_chunk: int = 4096, hash_bits: int = 64
) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after each run of ASCII white space has become one space; null is the empty
    text. Of equal texts the smallest doc_id stays. Rows that repeat a doc_id with an equal text are one document
    repeated: each counts in group_size and shares the flag. A null doc_id never stays before a set one; a group
    of null ids only keeps its rows. An empty table gives an empty result. Other columns of docs are ignored.
    hash_bits under 64 is for tests of the collision path.
    """
    norm = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    parts = norm.select("_id", "_norm", chunked(F.col("_norm"), min_chunk, max_chunk).alias("_chunks"))
    recipes = staged(
        parts.select(
            "_id",
            F.sha2(F.col("_norm"), 256).alias("_sha"),
            F.transform("_chunks", lambda c: _identifier(c, hash_bits)).alias("_recipe"),
        ),
        "recipes",
    )
    pieces = parts.select(F.explode("_chunks").alias("_chunk")).select(_identifier(F.col("_chunk"), hash_bits).alias("_h"), "_chunk")
    collided = staged(pieces.distinct().groupBy("_h").count().filter("count > 1").select("_h"), "collided")
    if collided.isEmpty():
        keyed = recipes.withColumn("_bytes", F.lit(None).cast("array<string>"))
    else:
        hit = recipes.select("_sha", F.explode("_recipe").alias("_h")).join(collided, "_h", "left_semi").groupBy("_sha").agg(F.collect_set("_h").alias("_hs"))
        whole = parts.select(F.sha2(F.col("_norm"), 256).alias("_sha"), "_chunks").join(hit, "_sha")
        exact = whole.select(
            "_sha", F.filter("_chunks", lambda c: F.array_contains(F.col("_hs"), _identifier(c, hash_bits))).alias("_bytes")
        ).dropDuplicates(["_sha"])
        keyed = recipes.join(exact, "_sha", "left")
    groups = keyed.groupBy("_recipe", "_bytes").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    a, b = keyed.alias("a"), groups.alias("b")
    same = F.col("a._recipe").eqNullSafe(F.col("b._recipe"))
    if not collided.isEmpty():
        same = same & F.col("a._bytes").eqNullSafe(F.col("b._bytes"))
    return a.join(b, same).select(
        F.col("a._id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("a._id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("a._sha").alias("text_sha256"),
        F.size("a._recipe").alias("n_chunks"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each different text: the first that has the smallest id.

    Texts are equal as in ``exact_dedup``; null, empty texts and very long ones are texts like others. A row without an
    id stays only where no row with its text has one. Of rows that repeat an id with one text any one stays; rows that
    repeat an id with different texts are different rows. An empty table gives an empty result.
    """
    name = lambda key, sha: F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), sha)
    kept = exact_dedup(docs, id_col, text_col).filter("kept").groupBy(name("doc_id", F.col("text_sha256")).alias("key")).count()
    return one_of_each(docs, name(id_col, F.sha2(normalised(F.col(text_col)), 256)), kept)
