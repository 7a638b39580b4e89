"""Chunkers against plain loops over random texts; validation and provenance of chunks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import chunking as C
from textloom.operators import documents


def sentences(text):
    parts = re.split(r"(?<=[.!?])\s+|(?<=[。！？।॥])\s*", text)
    return [s for s in (" ".join(p.split()) for p in parts) if s]


def windows(s, most):
    w = s.split(" ")
    if len(w) <= most:
        return [s]
    return [" ".join(w[i : i + most]) for i in range(0, len(w), most)]



def unique(pieces):
    seen, out = set(), []
    for p in pieces:
        if p.casefold() not in seen:
            seen.add(p.casefold())
            out.append(p)
    return out


def packed(text, most, overlap, breaks=None):
    parts, marks = [], []
    whole = sentences(text)
    cut = breaks(whole) if breaks else [False] * len(whole)
    for s, b in zip(whole, cut, strict=True):
        for k, p in enumerate(windows(s, most)):
            parts.append(p)
            marks.append(b and k == 0)
    out, cur = [], []
    size = lambda ps: sum(len(p.split(" ")) for p in ps)
    for p, b in zip(parts, marks, strict=True):
        if cur and (b or size(cur) + len(p.split(" ")) > most):
            out.append(" ".join(cur))
            keep = []
            if not breaks:
                for q in reversed(cur):
                    if size(keep) + len(q.split(" ")) > overlap:
                        break
                    keep.insert(0, q)
            cur = keep
        cur.append(p)
    return unique([*out, " ".join(cur)] if cur else out)


def texts():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "bb", "Ccc", "dd.", "e!", "ff?", "gg।", "hh。", "i.j"])
    out = ["".join(word() + rng.choice([" ", " ", "  ", "\n"]) for _ in range(rng.choice([0, 1, 5, 40, 120]))) for _ in range(60)]
    return [*out, "", None, "same one. same one. Same one.", "w " * 500, "one. " * 300]


@pytest.mark.parametrize(("most", "overlap"), [(1, 0), (4, 0), (8, 3), (16, 15), (256, 32)])
def test_sentence_chunks(spark, most, overlap):
    rows = [(str(i), t) for i, t in enumerate(texts())]
    got = C.chunk_documents(spark.createDataFrame(rows, "document_id string, text string"), C.ChunkConfig(max_size=most, overlap=overlap, strategy="sentence"))
    have = {}
    for r in got.orderBy("document_id", "chunk_index").collect():
        have.setdefault(r["document_id"], []).append(r["text"])
    assert have == {i: p for i, t in rows if (p := packed(t or "", most, overlap))}
    assert {r["rule"]: r["n"] for r in C.validate_chunks(got, "sentence").collect() if r["n"]} == {}


def test_long_words_give_letter_windows(spark):
    c = C.ChunkConfig(max_size=3, overlap=0, strategy="sentence")
    got = C.chunk_documents(spark.createDataFrame([("1", "abcdefgh.")], "document_id string, text string"), c).collect()
    assert [r["text"] for r in got] == ["abcdefgh."]  # one word: within the size


def test_semantic_chunks(spark):
    rows = [(str(i), t) for i, t in enumerate(texts())]
    c = C.ChunkConfig(max_size=12, overlap=0, threshold=0.2, strategy="semantic")

    def breaks(ss):
        v = [np.array(C.hashed_vector(s)) for s in ss]
        sims = [C.cosine(a, b) for a, b in zip(v, v[1:], strict=False)]
        return [False] * bool(ss) + [x < 0.2 or (k > 0 and x < sims[k - 1] - 0.15) for k, x in enumerate(sims)]

    have = {}
    for r in C.chunk_documents(spark.createDataFrame(rows, "document_id string, text string"), c).orderBy("document_id", "chunk_index").collect():
        have.setdefault(r["document_id"], []).append(r["text"])
    assert have == {i: p for i, t in rows if (p := packed(t or "", 12, 0, breaks))}


def test_broken_chunks_are_told(spark):
    docs = spark.createDataFrame([("d1", "one two. three four. five"), ("d2", "six seven")], "document_id string, text string")
    good = C.chunk_documents(docs, C.ChunkConfig(max_size=2, overlap=0, strategy="sentence"))
    told = lambda df, s="sentence": {r["rule"]: r["n"] for r in C.validate_chunks(df, s).collect() if r["n"]}
    assert told(good) == {} and told(good, "fixed") == {"strategy": good.count()}
    assert told(good.filter("chunk_index <> 0")) == {"contiguous": 1}
    assert told(good.unionByName(good.filter("document_id = 'd2'"))) == {"contiguous": 1, "unique": 1}
    assert told(good.withColumn("text", F.when(F.col("document_id") == "d2", " ").otherwise(F.col("text")))) == {"text": 1, "deterministic": 1}
    assert told(good.withColumn("source", F.struct(F.lit("d1").alias("document_id")))) == {"source": 1}


def test_provenance(spark):
    raw = spark.createDataFrame([("q1", "hin_Deva", (["1"], ["one. two", "three"], [None, "drei"]))], "query_id string, target_lang string, passages struct<is_selected:array<string>,English_passages:array<string>,Translated_passages:array<string>>")
    raw = raw.withColumn("passages", F.col("passages").withField("is_selected", F.col("passages.is_selected").cast("array<int>")))
    docs = documents.normalize_records(raw, dataset_name="set")
    r = C.chunk_documents(docs).orderBy("source.passage_index").collect()
    assert [x["text"] for x in r] == ["one. two", "drei"] and all(x["parent_chunk_id"] == x["document_id"] == x["source"]["document_id"] == x["metadata"]["original_document_id"] for x in r)
    assert r[0]["source"]["language"] == "hin_Deva" and r[0]["source"]["text_source"] == "english_fallback" and r[1]["source"]["chunk_strategy"] == "metadata"
    held = docs.withColumn("source", F.col("source").withField("language", F.lit("kept")).withField("parent_chunk_id", F.lit("p")))
    x = C.chunk_documents(held).first()
    assert x["source"]["language"] == "kept" and x["parent_chunk_id"] == "p" == x["metadata"]["parent_chunk_id"]
    assert {r["query_id"] for r in documents.selected(docs).collect()} == {"q1"} and documents.selected(docs).count() == 1


def test_load_statistics(spark):
    schema = "query_id string, target_lang string, passages struct<is_selected:array<int>,English_passages:array<string>,Translated_passages:array<string>>, _corrupt_record string"
    rows = [("1", "en", ([], ["a", "A", " "], []), None), ("2", "en", ([], ["a"], None), None), ("3", "de", ([], ["a"], None), None), (None, None, None, "{broken")]
    docs, stats = documents.load_documents(spark.createDataFrame(rows, schema), dataset_name="set")
    assert stats.first().asDict() == {"records_read": 4, "malformed_records": 1, "documents_created": 2, "empty_passages_removed": 1, "duplicate_documents_removed": 2}
    assert {r["language"] for r in docs.collect()} == {"en", "de"}


def test_composition_and_folding(spark):
    df = spark.createDataFrame([("été STRASSE", "été straße")], "a string, b string")
    from textloom.functions import text as X

    r = df.select(X.text_key(F.col("a")) == X.text_key(F.col("b")), X.clean(F.col("a")), X.tokens(F.col("a")), X.tokens(F.lit("ﬁx ①"), form="NFKC"), X.tokens(F.lit("Ab c"), 2, lowercase=False)).first()
    assert r[0] and r[1] == "été STRASSE" and r[2] == ["été", "strasse"] and r[3] == ["fix", "1"] and r[4] == ["Ab"]
