import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import exact_dedup as D

SCHEMA = "doc_id long, text string, keep_id string"


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def texts():
    rng = random.Random(1)
    long = [" ".join(f"w{rng.randrange(999)}" + rng.choice(["", "", "."]) for _ in range(900)) for _ in range(4)]
    out = [None, "", " ", "\t\n", "a b", "a  b", "a b", "a b ", "x" * 20000, "x" * 20001, *long, *long, long[0].replace(" ", "\n"), long[0] + "!", "\U0001f600" * 5000]
    return [(i, t, "clash") for i, t in enumerate(out)]


@pytest.mark.parametrize("bits", [64, 3])
def test_against_brute_force(spark, bits):
    rows = texts()
    got = D.exact_dedup(spark.createDataFrame(rows, SCHEMA), hash_bits=bits).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == brute(rows)


def test_chunks_join_to_the_text(spark):
    df = spark.createDataFrame(texts(), SCHEMA).select(D.normalised(F.col("text")).alias("n"))
    assert all("".join(r["c"]) == r["n"] for r in df.select("n", D.chunked(F.col("n")).alias("c")).collect())


def test_empty_null_ids_and_repeats(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.exact_dedup(empty).count() == 0 and D.drop_copies(empty).count() == 0
    df = spark.createDataFrame([(None, "a", ""), (5, "a", ""), (5, "a", ""), (None, "b", "")], SCHEMA)
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in D.exact_dedup(df).collect())
    assert got == [("5", "5", 3, True), ("5", "5", 3, True), ("None", "5", 3, False), ("None", "None", 1, True)]


def test_native(spark):
    plan = D.exact_dedup(spark.createDataFrame(texts(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
