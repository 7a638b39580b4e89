"""Hash embeddings, pluggable models, and a stored table as embedding cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import text_key
from textloom.sources import store


_WORDS: dict[tuple[str, int], tuple[int, int]] = {}


def _places(words: list[str], dim: int) -> list[tuple[int, int]]:
    """Place and sign of each word, hashed once for each worker."""
    if len(_WORDS) > 1 << 18:
        _WORDS.clear()
    out = []
    for w in words:
        found = _WORDS.get((w, dim))
        if found is None:
            h = hashlib.sha256(w.encode()).digest()
            found = _WORDS[w, dim] = int.from_bytes(h[:4], "big") % dim, 1 if h[4] % 2 else -1
        out.append(found)
    return out


def hash_vector(text: Column, dim: int = 384, input_type: str | None = "passage", normalize: bool = True) -> Column:
    """Signed counts of a text's words, folded and composed, at hashed places; of length 1 unless all 0. Zero for null.

    Each row is made where it lies, in Arrow batches: an aggregate over words would shuffle every word of the corpus.
    """

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> np.ndarray:
            out = np.zeros(dim)
            if met := _places(t.split(), dim):
                place, sign = zip(*met, strict=True)
                out = np.bincount(place, sign, dim)
            norm = np.sqrt((out * out).sum()) if normalize else 0.0
            return out / norm if norm else out

        return texts.map(one)

    t = text if input_type is None else F.concat(F.lit(f"{input_type}: "), text)
    return F.when(text.isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(run(F.coalesce(text_key(t), F.lit(""))))


def hash_terms(texts: DataFrame, id_col: str, text_col: str, dim: int, prefix: str | None) -> DataFrame:
    """id, idx, value: signed counts of a text's words at hashed places, only those that are not 0."""
    held = texts.select(F.col(id_col).alias("id"), F.posexplode(hash_vector(F.col(text_col), dim, prefix, normalize=False)).alias("idx", "value"))
    return held.filter("value <> 0")


def hash_embedding(texts: DataFrame, id_col: str, text_col: str, *, dim: int = 384, input_type: str | None = "passage", normalize: bool = True) -> DataFrame:
    """id, embedding (array of double) of each text."""
    return texts.select(F.col(id_col).alias("id"), hash_vector(F.col(text_col), dim, input_type, normalize).alias("embedding"))


def model_embedding(text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = "passage: ", *, dim: int | None = None, batch: int = 32) -> Column:
    """A model's vectors. load makes the model once for each task; it is called with batch texts at a time.

    A model that gives another number of vectors than texts, or vectors not of dim, is refused.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            texts, out = [prefix + (t or "") for t in s], []
            for at in range(0, len(texts), batch):
                got = [list(map(float, v)) for v in model(texts[at : at + batch])]
                if len(got) != len(texts[at : at + batch]) or dim is not None and any(len(v) != dim for v in got):
                    raise ValueError("the model's vectors don't match its texts")
                out += got
            yield pd.Series(out, dtype=object)

    return run(text)


def cache_key(model: str, input_type: str, normalize: bool, text: Column) -> Column:
    digest = F.sha2(text, 256)
    return F.sha2(F.concat(F.lit(f'["{model}", "{input_type}", {str(normalize).lower()}, "'), digest, F.lit('"]')), 256)


def embed_cached(texts: DataFrame, text_col: str, cache: DataFrame, embed: Callable[[Column], Column], key: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(texts with embedding, new cache rows): each text absent from cache (key, embedding) is embedded once."""
    keyed = texts.withColumn("_key", key(F.col(text_col)))
    new = keyed.select("_key", F.col(text_col).alias("_text")).dropDuplicates(["_key"]).join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    new = new.select(F.col("_key").alias("key"), embed(F.col("_text")).alias("embedding"))
    known = cache.select("key", "embedding").unionByName(new).withColumnRenamed("key", "_key")
    return keyed.join(known, "_key", "left").drop("_key"), new


def save_cache(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Add rows (key, embedding) to a stored cache; what it has of a key already stays."""
    have = load_cache(spark, path)
    fresh = new.dropDuplicates(["key"]) if have is None else new.dropDuplicates(["key"]).join(have, "key", "left_anti")
    store.commit(spark, path, [*(store.segments(spark, path) or []), store.put(path, {"cache": fresh.select("key", "embedding")})])


def load_cache(spark: SparkSession, path: str) -> DataFrame | None:
    return store.get(spark, path, "cache") if store.segments(spark, path) else None


def cache_report(texts: DataFrame, text_col: str, cache: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """requests, distinct texts, hits and misses that embed_cached would have, and the share of hits."""
    asked = texts.select(key(F.col(text_col)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = asked.join(cache.select("key", F.lit(1).alias("_hit")).dropDuplicates(["key"]), "key", "left")
    hits = F.coalesce(F.sum(F.when(F.col("_hit").isNotNull(), F.col("n")).otherwise(F.col("n") - 1)), F.lit(0))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return met.agg(n.alias("requests"), F.count(F.lit(1)).alias("texts"), hits.alias("hits"), (n - hits).alias("misses"), F.round(hits / F.greatest(n, F.lit(1)), 6).alias("hit_rate"))
