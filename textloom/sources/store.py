"""Tables of segments with one commit: what a write has put down counts only once its commit is there.

A store is a folder with ``segments/<id>/<table>`` (Parquet) and ``commits/<n>.json``, which lists the live segments.
A commit is created under the next number and never replaced, so a writer that lost a race fails, a loss half-way leaves
the last commit as it was, and readers see whole segments only.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below spark.checkpoint.dir; below a temporary folder where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once and read back: what uses it doesn't make it again, and Spark knows its size."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def segments(spark: SparkSession, path: str) -> list[str] | None:
    """The live segments, oldest first, or None where the store has no commit."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    fs, file = _fs(spark, f"{path}/commits/{numbers[-1]:012d}.json")
    stream = fs.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["segments"]
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, live: list[str], after: int | None = None) -> None:
    """Make live the store's segments. after is the number of the commit that live was made from, the last by default."""
    numbers = _numbers(spark, path)
    number = (numbers[-1] if numbers else -1) + 1 if after is None else after + 1
    fs, file = _fs(spark, f"{path}/commits/{number:012d}.json")
    stream = fs.create(file, False)  # fails where another writer has made this commit
    stream.write(bytearray(json.dumps({"segments": live}).encode()))
    stream.close()


def last(spark: SparkSession, path: str) -> int:
    """The number of the last commit, -1 before the first."""
    return next(iter(_numbers(spark, path)[::-1]), -1)


def put(path: str, tables: dict[str, DataFrame]) -> str:
    """Write tables as a new segment, not yet live; returns its name."""
    name = uuid.uuid4().hex
    for label, df in tables.items():
        df.write.parquet(f"{path}/segments/{name}/{label}")
    return name


def get(spark: SparkSession, path: str, label: str, of: list[str] | None = None) -> DataFrame:
    """One table of the segments given, or of all live ones."""
    live = segments(spark, path) if of is None else of
    if not live:
        raise FileNotFoundError(f"no store at {path}")
    return spark.read.option("mergeSchema", str(len(live) > 1).lower()).parquet(*[f"{path}/segments/{s}/{label}" for s in live])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads."""
    fs, folder = _fs(spark, path)
    fs.delete(folder, True)


def drop(spark: SparkSession, path: str) -> None:
    """Remove the store and all it holds."""
    for name in ("commits", "segments"):
        remove(spark, f"{path}/{name}")


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove segments that no commit keeps live (left by lost writers or replaced); returns how many. No writer may be at work."""
    fs, folder = _fs(spark, f"{path}/segments")
    dead = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in (segments(spark, path) or [])] if fs.exists(folder) else []
    for p in dead:
        fs.delete(p, True)
    return len(dead)
