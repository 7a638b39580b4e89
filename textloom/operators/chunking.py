"""Chunkers: documents to overlapping pieces of words, sentences or related sentences."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import clean, sentences, text_key, words
from textloom.sources.store import staged


@dataclass(frozen=True)
class ChunkConfig:
    max_size: int = 256
    overlap: int = 32
    min_size: int = 1
    threshold: float = 0.70
    strategy: str = "metadata"

    def __post_init__(self):
        if self.max_size < 1 or not 0 <= self.overlap < self.max_size or not 0 < self.min_size <= self.max_size or not -1 <= self.threshold <= 1:
            raise ValueError(f"invalid chunk sizes: {self}")
        if self.strategy not in ("fixed", "sentence", "metadata", "semantic"):
            raise ValueError(f"unknown strategy {self.strategy!r}")


def fixed_pieces(w: Column, c: ChunkConfig) -> Column:
    """Windows of max_size words, each max_size - overlap after the last; a short last window is moved back or dropped.

    w is a column of words, not an expression for them: it is read for each window.
    """
    n, step = F.size(w), c.max_size - c.overlap
    count = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - c.overlap) / F.lit(float(step))).cast("int")))
    starts = F.when(count == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step))
    if c.min_size > 1:
        last = (count - 1) * step
        back = n - c.max_size
        short = (count > 1) & (n - last < c.min_size)
        starts = F.when(short & (back != last - step), F.concat(F.slice(starts, 1, count - 1), F.array(back))).when(short, F.slice(starts, 1, count - 1)).otherwise(starts)
    return F.transform(starts, lambda a: F.array_join(F.slice(w, a + 1, c.max_size), " "))


def _size(s: Column) -> Column:
    return F.size(F.split(s, " "))


def _windows(s: Column, most: int) -> Column:
    """A sentence, or its windows of most words where it has more; one long word gives windows of most letters."""
    w = F.split(s, " ")
    by_letter = F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / most).cast("int") - 1), lambda i: F.substring(s, i * most + 1, F.lit(most)))
    by_word = F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / most).cast("int") - 1), lambda i: F.array_join(F.slice(w, i * most + 1, most), " "))
    return F.when(F.size(w) <= most, F.array(s)).when(F.size(w) == 1, by_letter).otherwise(by_word)


def _packed(sizes: Column, c: ChunkConfig, breaks: Column | None = None) -> Column:
    """Where chunks lie among sentences of the given sizes (a column of its own): an array of (a, b), b exclusive.

    A chunk takes sentences up to max_size words; the next begins with the whole last sentences that fit in overlap.
    breaks tells sentences that begin a chunk in any case. Only places move through the fold, never text, and what a
    chunk carries over is looked for in as many sentences as overlap has words.
    """

    def carried(a: Column, i: Column) -> Column:
        """How many sentences before i, back to a, fit in overlap, and their words."""
        tail = F.slice(sizes, F.greatest(a, i - c.overlap) + 1, F.least(i - a, F.lit(c.overlap)))
        start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("m"), F.lit(False).alias("stop"))

        def back(acc: Column, z: Column) -> Column:
            stop = acc["stop"] | (acc["m"] + z > c.overlap)
            return F.struct((acc["k"] + F.when(stop, 0).otherwise(1)).alias("k"), (acc["m"] + F.when(stop, 0).otherwise(z)).alias("m"), stop.alias("stop"))

        return F.aggregate(F.reverse(tail), start, back)

    def step(acc: Column, i: Column) -> Column:
        z = F.element_at(sizes, i + 1)
        full = (i > acc["a"]) & (acc["n"] + z > c.max_size)
        if breaks is not None:
            full = full | ((i > acc["a"]) & F.element_at(breaks, i + 1))
        kept = carried(acc["a"], i) if c.overlap else F.struct(F.lit(0).alias("k"), F.lit(0).alias("m"))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), i.alias("b"))))).otherwise(acc["done"]).alias("done"),
            F.when(full, i - kept["k"]).otherwise(acc["a"]).alias("a"),
            (F.when(full, kept["m"]).otherwise(acc["n"]) + z).alias("n"),
        )

    spans = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(spans.alias("done"), F.lit(0).alias("a"), F.lit(0).alias("n"))
    last = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), F.size(sizes).alias("b"))))
    return F.when(F.size(sizes) == 0, spans).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), start, step, last))


def sentence_pieces(docs: DataFrame, text: Column, c: ChunkConfig) -> DataFrame:
    """docs with _pieces: sentences packed up to max_size words, with whole last sentences repeated within overlap."""
    got = docs.withColumn("_s", F.flatten(F.transform(sentences(text), lambda s: _windows(s, c.max_size))))
    got = got.withColumn("_z", F.transform("_s", _size)).withColumn("_spans", _packed(F.col("_z"), c))
    return got.withColumn("_pieces", F.transform("_spans", lambda x: F.array_join(F.slice("_s", x["a"] + 1, x["b"] - x["a"]), " "))).drop("_s", "_z", "_spans")


_HASHED: dict[tuple[str, int], tuple[int, float]] = {}


def hashed_vector(text: str, dim: int = 32) -> list[float]:
    """Signed counts of a text's words at hashed places."""
    return hashed_vectors([text], dim)[0].tolist()


def hashed_vectors(texts: list[str], dim: int = 32) -> np.ndarray:
    """A row for each text; a word is hashed once for each worker."""
    words = [t.casefold().split() for t in texts]
    if len(_HASHED) > 1 << 18:
        _HASHED.clear()
    for w in set().union(*words):
        if (w, dim) not in _HASHED:
            h = hashlib.sha256(w.encode()).digest()
            _HASHED[w, dim] = int.from_bytes(h[:4], "big") % dim, 1.0 if h[4] % 2 else -1.0
    out = np.zeros((len(texts), dim))
    met = [(i, *_HASHED[w, dim]) for i, ws in enumerate(words) for w in ws]
    if met:
        row, place, sign = zip(*met, strict=True)
        np.add.at(out, (np.array(row), np.array(place)), np.array(sign))
    return out


def cosine(a: list[float], b: list[float]) -> float:
    if len(a) != len(b):
        raise ValueError("vectors differ in length")
    return float(_neighbours(np.array([a, b], float))[0])


def _neighbours(v: np.ndarray) -> np.ndarray:
    """Cosine of each row with the next; 0 where either is zero."""
    norm = np.sqrt((v * v).sum(1))
    both = norm[:-1] * norm[1:]
    return np.where(both > 0, (v[:-1] * v[1:]).sum(1) / np.where(both > 0, both, 1), 0.0)


def semantic_pieces(docs: DataFrame, text: Column, c: ChunkConfig, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """docs with _pieces: neighbouring sentences stay together while their vectors are alike and don't drop by 0.15 from the last pair."""
    vectors = embed or hashed_vectors

    @F.pandas_udf("array<boolean>")
    def breaks(col: pd.Series) -> pd.Series:
        def one(ss) -> list[bool]:
            ss = list(ss)
            v = np.asarray(vectors(ss), float) if ss else np.zeros((0, 1))
            if len(v) != len(ss):
                raise ValueError("a vector is needed for each sentence")
            sims = _neighbours(v) if len(v) > 1 else np.zeros(0)
            cut = sims < c.threshold
            cut[1:] |= sims[1:] < sims[:-1] - 0.15
            return [False] * bool(ss) + cut.tolist()

        return col.map(one)

    got = docs.withColumn("_w", sentences(text)).withColumn("_b", breaks(F.col("_w")))
    cut = F.transform(F.arrays_zip("_w", "_b"), lambda x: F.transform(_windows(x["_w"], c.max_size), lambda p, i: F.struct(p.alias("s"), (x["_b"] & (i == 0)).alias("b"))))
    got = got.withColumn("_x", F.flatten(cut)).withColumn("_s", F.transform("_x", lambda x: x["s"])).withColumn("_b", F.transform("_x", lambda x: x["b"]))
    flat = ChunkConfig(c.max_size, 0, c.min_size, c.threshold, c.strategy)
    got = got.withColumn("_z", F.transform("_s", _size)).withColumn("_spans", _packed(F.col("_z"), flat, F.col("_b")))
    return got.withColumn("_pieces", F.transform("_spans", lambda x: F.array_join(F.slice("_s", x["a"] + 1, x["b"] - x["a"]), " "))).drop("_w", "_b", "_x", "_s", "_z", "_spans")


def chunk_id(document_id: Column, strategy: Column | str, index: Column, text: Column) -> Column:
    """Document, strategy, place and 20 hex digits of the SHA-1 of all four as a compact JSON list."""
    s = F.lit(strategy) if isinstance(strategy, str) else strategy
    inner = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    listed = F.concat(F.lit("["), F.concat_ws(",", inner(document_id), inner(s), index.cast("string"), inner(text)), F.lit("]"))
    return F.concat(document_id, F.lit("--"), s, F.format_string("-%04d-", index.cast("int")), F.substring(F.sha1(listed), 1, 20))


#: What a chunk's source says besides its document's own entries, where these don't have it.
PROVENANCE = ("language", "query_id", "document_id", "dataset_name", "split", "passage_index", "text_source", "source_lang", "target_lang")


def _with(struct: Column, kind: T.StructType, entries: dict[str, Column], keep: bool) -> Column:
    """A struct with entries; of a name that it has the old value stays if keep."""
    own = [struct[f.name].alias(f.name) for f in kind.fields if keep or f.name not in entries]
    return F.struct(*own, *[v.alias(k) for k, v in entries.items() if not (keep and k in kind.names)])


def provenance(chunks: DataFrame) -> DataFrame:
    """Chunks whose source struct has all of PROVENANCE: an entry that is there stays, others come from the chunk's columns."""
    kind = chunks.schema["source"].dataType
    value = lambda k: F.col(k) if k in chunks.columns else F.lit(None).cast("string")
    return chunks.withColumn("source", _with(F.col("source"), kind, {k: value(k) for k in PROVENANCE}, keep=True))


def chunk_documents(docs: DataFrame, config: ChunkConfig | None = None, *, embed: Callable | None = None, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """docs exploded to chunks: chunk_id, document_id, text, chunk_index, chunk_strategy, and docs' other columns.

    A text repeated within a document (but for case) is given once, and indexes close up over the gap. Documents with a
    source struct (normalised records) also give parent_chunk_id, and their source and metadata tell of the chunk; the
    metadata strategy completes the source by PROVENANCE.
    """
    c = config or ChunkConfig()
    if c.strategy == "fixed":
        got = docs.withColumn("_w", words(F.col(text_col))).withColumn("_pieces", fixed_pieces(F.col("_w"), c)).drop("_w")
    elif c.strategy == "semantic":
        got = semantic_pieces(docs, F.col(text_col), c, embed)
    else:
        got = sentence_pieces(docs, F.col(text_col), c)
    got = got.withColumn("_pieces", F.filter(F.transform("_pieces", clean), lambda p: p.isNotNull()))
    # places of the first of each key, from one pass over the keys
    got = got.withColumn("_keys", F.transform("_pieces", lambda p: text_key(p))).withColumn("_distinct", F.array_distinct("_keys"))
    first = F.transform("_distinct", lambda k: F.element_at("_pieces", F.array_position(F.col("_keys"), k).cast("int")))
    got = got.withColumn("_first", F.when(F.size("_distinct") == F.size("_pieces"), F.col("_pieces")).otherwise(first))
    rest = [x for x in docs.columns if x not in (id_col, text_col)]
    # outer: from an inner explode Spark infers a filter on the array's size and computes the chunks again for it
    flat = got.select(F.col(id_col).cast("string").alias("document_id"), *rest, F.posexplode_outer("_first").alias("chunk_index", "text")).filter("chunk_index IS NOT NULL")
    out = flat.select(
        chunk_id(F.col("document_id"), c.strategy, F.col("chunk_index"), F.col("text")).alias("chunk_id"),
        "document_id", "text", "chunk_index", F.lit(c.strategy).alias("chunk_strategy"), *rest,
    )
    if "source" not in rest or not isinstance(docs.schema["source"].dataType, T.StructType):
        return out
    kind = docs.schema["source"].dataType
    parent = F.coalesce(F.col("source.parent_chunk_id"), F.col("document_id")) if "parent_chunk_id" in kind.names else F.col("document_id")
    out = out.withColumn("parent_chunk_id", parent)
    about = {k: F.col(k) for k in ("document_id", "parent_chunk_id", "dataset_name", "query_id", "chunk_index", "chunk_strategy") if k in out.columns}
    out = out.withColumn("source", _with(F.col("source"), kind, about, keep=False))
    if "metadata" in rest and isinstance(docs.schema["metadata"].dataType, T.StructType):
        origin = {"original_document_id": F.col("document_id"), "parent_chunk_id": F.col("parent_chunk_id")}
        out = out.withColumn("metadata", _with(F.col("metadata"), docs.schema["metadata"].dataType, origin, keep=True))
    return provenance(out) if c.strategy == "metadata" else out


def validate_chunks(chunks: DataFrame, strategy: str | None = None) -> DataFrame:
    """rule and n: how many chunks (of documents for ``contiguous``, of ids for ``unique``) break each rule, 0 included.

    A chunk has text, chunk_id and document_id; indexes of a document run from 0 without gaps or repeats; the strategy
    is the one expected; the id follows from document, strategy, index and text; ids are unique; a source struct names
    the document.
    """
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    made = chunk_id(F.col("document_id"), F.col("chunk_strategy"), F.col("chunk_index"), F.col("text"))
    linked = ~F.col("source.document_id").eqNullSafe(F.col("document_id")) if "source" in chunks.columns else F.lit(False)
    rows = {
        "text": clean(F.col("text")).isNull(),
        "chunk_id": empty(F.col("chunk_id").cast("string")),
        "document_id": empty(F.col("document_id")),
        "strategy": ~F.col("chunk_strategy").eqNullSafe(F.lit(strategy)) if strategy else F.lit(False),
        "deterministic": ~F.col("chunk_id").eqNullSafe(made),
        "source": linked,
    }
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    # chunks are made once, and places and ids are kept of them
    held = staged(chunks.select(*[c.alias(f"_{k}") for k, c in rows.items()], "document_id", "chunk_index", "chunk_id"), "validated")
    by_row = held.agg(*[count(F.col(f"_{k}")).alias(k) for k in rows])
    runs = held.groupBy("document_id").agg(F.min("chunk_index").alias("a"), F.max("chunk_index").alias("z"), F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_index").alias("d"))
    by_document = runs.agg(count((F.col("a") != 0) | (F.col("z") != F.col("n") - 1) | (F.col("d") != F.col("n"))).alias("contiguous"))
    by_id = held.groupBy("chunk_id").count().agg(count(F.col("count") > 1).alias("unique"))
    names = [*rows, "contiguous", "unique"]
    one = by_row.crossJoin(by_document).crossJoin(by_id)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in names])).alias("x")).select("x.*")


def chunk_profile(chunks: DataFrame) -> DataFrame:
    """Chunks, documents, and least, mean and most words of a chunk, by strategy."""
    n = F.col("n")
    return chunks.select("chunk_strategy", "document_id", F.size(words(F.col("text"))).alias("n")).groupBy("chunk_strategy").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("document_id").alias("documents"), F.min(n).alias("min_words"), F.round(F.avg(n), 4).alias("avg_words"), F.max(n).alias("max_words")
    )
