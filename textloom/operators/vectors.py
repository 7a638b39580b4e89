"""A stored table of vectors with their chunks: points keyed by chunk, replaced when put again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import store

#: Fixed value: the namespace of names that are URLs, as RFC 4122 has it.
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def point_id(chunk_id: Column) -> Column:
    """The name-based UUID (version 5) of a chunk_id."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(chunk_id.cast("string"), "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex((F.conv(part(17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def payload(chunks: DataFrame) -> Column:
    """What a point carries: the chunk, the provenance out of its source, and its document's metadata."""
    have = set(chunks.columns)
    source = {f.name for f in chunks.schema["source"].dataType.fields} if "source" in have else set()
    own = lambda k: F.col(k) if k in have else F.lit(None).cast("string")
    inner = lambda k: F.col(f"source.{k}") if k in source else F.lit(None).cast("string")
    parent = F.coalesce("parent_chunk_id", "document_id") if "parent_chunk_id" in have else own("document_id")
    return F.struct(
        own("chunk_id").alias("chunk_id"), own("document_id").alias("document_id"), parent.alias("parent_chunk_id"), own("query_id").alias("query_id"),
        own("language").alias("language"), own("chunk_strategy").alias("chunk_strategy"), own("chunk_index").alias("chunk_index"),
        *[inner(k).alias(k) for k in ("passage_index", "source_lang", "target_lang", "text_source", "dataset_name", "split")],
        own("text").alias("text"), own("source").alias("source"), own("metadata").alias("document_metadata"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    return store.segments(spark, path) is not None


def ensure(spark: SparkSession, path: str, dim: int, *, recreate: bool = False) -> None:
    """A vector table of dim at path: made where there is none, emptied where recreate."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    if recreate or not exists(spark, path):
        live = [store.put(path, {"spec": spark.createDataFrame([(dim,)], "dim int")})]
        store.commit(spark, path, live)


def _split(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    live = store.segments(spark, path)
    if not live:
        raise FileNotFoundError(f"no vector table at {path}")
    return live[0], live[1:]


def upsert(path: str, points: DataFrame) -> int:
    """Put points (chunk_id, embedding, payload) into the table; one with a chunk_id that is there takes its place.

    Returns how many were put. Vectors of another length are refused, and so are chunk_ids that repeat in points. Only
    segments that hold one of the chunk_ids are written anew; the change is one commit.
    """
    spark = points.sparkSession
    at = store.last(spark, path)
    spec, live = _split(spark, path)
    dim = store.get(spark, path, "spec", [spec]).first()["dim"]
    new = store.put(path, {"points": points.select(point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", F.col("embedding").cast("array<float>").alias("embedding"), "payload")})
    put = store.get(spark, path, "points", [new])
    n, ids, fit = put.agg(F.count(F.lit(1)), F.countDistinct("chunk_id"), F.count_if(F.size("embedding") == dim)).first()
    if ids != n or fit != n:
        raise ValueError(f"points need one chunk_id and {dim} values each")
    kept = []
    for s in live:
        old = store.get(spark, path, "points", [s])
        hit = old.join(put.select("chunk_id"), "chunk_id", "left_semi")
        kept.append(s if hit.isEmpty() else store.put(path, {"points": old.join(put.select("chunk_id"), "chunk_id", "left_anti")}))
    store.commit(spark, path, [spec, *kept, new], at)
    return n


def load(spark: SparkSession, path: str) -> DataFrame:
    """point_id, chunk_id, embedding, payload of all points."""
    _, live = _split(spark, path)
    if not live:
        return spark.createDataFrame([], "point_id string, chunk_id string, embedding array<float>, payload string")
    return store.get(spark, path, "points", live)
