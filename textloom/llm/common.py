"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_SHIPPED: dict[str, str] = {}
_HELD: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent and the master is local (tests) a temporary folder stands in for it; on a cluster
    that is an error, as executors share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from the table, not from df's lineage."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(kind: str, key: object, make: Callable[[], object]) -> object:
    """make's object, kept for the tasks that a worker process runs next. One at a time: another kind or key lets go of
    it, so that workers that serve one stage after another don't gather all their caches; what it took goes back to the
    system."""
    if _HELD.get("of") != (kind, key):
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        _HELD.update(of=(kind, key), value=make())
    return _HELD["value"]


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="textloom-src-"), "textloom_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED["app"] = sc.applicationId


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_text(docs: DataFrame, columns: str, make: Callable[[], Callable[[list[str]], list]], id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """doc_id and columns (a DDL list) for each row of docs.

    make gives a task its function from texts to a list or array for each column. Null texts reach it as empty ones. It gets at most
    rows texts at a time. Ids never leave Arrow, so a null id beside them changes none.
    """
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL(columns)])
    own = [f.type for f in to_arrow_schema(schema)]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = of([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(got, own[1:], strict=True))], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def one_of_each(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of docs whose key is in kept (key, n: how many rows of docs have it); of rows that share a key, one.

    A key's rows meet in one task only after each task has merged its own, so any number of them may share a key.
    """
    kept, k, n, row = staged(kept, "kept"), *(unused(docs, x) for x in ("_key", "_n", "_row"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.withColumn(k, key).join(kept.toDF(k, n), k)
    once = found.filter(F.col(n) == 1).select(own)
    if kept.filter(F.col(kept.columns[1]) > 1).isEmpty():
        return once
    many = found.filter(F.col(n) > 1).groupBy(k).agg(F.first(F.struct(own)).alias(row))
    return once.unionByName(many.select([F.col(row).getField(c).alias(c) for c in docs.columns]))
