"""Sources: Parquet folders with a declared schema, JSON query sets, indexes and dictionaries, bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.documents import RAW_RECORD
from textloom.sources import store

#: The most rows of a bounded sample.
SAMPLE_LIMIT = 100


@dataclass(frozen=True)
class LoaderConfig:
    """What to load. A sample of up to SAMPLE_LIMIT rows is taken by order; anything else is a scan of all files."""

    dataset_name: str
    dataset_config: str = "default"
    split: str = "validation"
    sample_size: int | None = 10
    backend: str = "sample"

    def __post_init__(self):
        for name in ("dataset_name", "dataset_config", "split"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} can't be empty")
        if self.sample_size is not None and self.sample_size < 0:
            raise ValueError("sample_size must be 0 or more, or None")
        if self.backend not in ("sample", "files"):
            raise ValueError("backend must be 'sample' or 'files'")

    def resolved(self, sample_size: int | None = None, backend: str | None = None) -> LoaderConfig:
        """With a sample size, and the backend given or the one that can hold it."""
        fits = sample_size is not None and sample_size <= SAMPLE_LIMIT
        return replace(self, sample_size=sample_size, backend=(backend or ("sample" if fits else "files")).strip().lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where its scan has fewer: for work that is heavy on each row.

    A scan of a large table has more splits than that and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the Parquet files below a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length")


def discover(listing: DataFrame, root: str, split: str, config: str = "default") -> DataFrame:
    """The files (path) of a listing below root that belong to a split, in order of their names below root (file).

    Known layouts: split/*, data/split*, data/config/split* and config/split*.
    """
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    named = listing.withColumn("file", F.substring_index("path", f"{base}/", -1)).filter(F.endswith("file", F.lit(".parquet")))
    hit = [F.startswith("file", F.lit(p)) for p in (f"{split}/", f"data/{split}", f"data/{config}/{split}", f"{config}/{split}")]
    return named.filter(hit[0] | hit[1] | hit[2] | hit[3]).dropDuplicates(["file"]).orderBy("file")


def configurations(listing: DataFrame, root: str, split: str) -> DataFrame:
    """The configurations (config) that a listing has files of a split for."""
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    inner = F.regexp_extract(F.substring_index("path", f"{base}/", -1), rf"^(?:data/)?([^/]+)/{split}[^/]*\.parquet$", 1)
    plain = F.regexp_extract(F.substring_index("path", f"{base}/", -1), rf"^(?:{split}/|data/{split})[^/]*\.parquet$", 0)
    found = F.when((inner != "") & (inner != "data"), inner).when(plain != "", "default")
    return listing.select(found.alias("config")).filter("config IS NOT NULL").distinct().orderBy("config")


def raw_records(spark: SparkSession, path: str, *, skip_corrupt: bool = True) -> DataFrame:
    """Raw records of a folder of Parquet files with the file each came from and its row there; absent fields are null."""
    reader = spark.read.schema(RAW_RECORD).option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return reader.parquet(path).withColumns({"source_file": F.col("_metadata.file_path"), "file_row": F.col("_metadata.row_index")})


def with_row_index(records: DataFrame) -> DataFrame:
    """raw_records with row_index: a record's number over all files, these in order of their names.

    Files' sizes are counted first; a running sum over one row for each file gives where each begins.
    """
    per_file = records.groupBy("source_file").agg((F.max("file_row") + 1).alias("_rows")).collect()  # one row for each file
    begins, at = [], 0
    for r in sorted(per_file):
        begins.append((r[0], at))
        at += r[1]
    starts = records.sparkSession.createDataFrame(begins, "source_file string, _begin long")
    return records.join(F.broadcast(starts), "source_file").withColumn("row_index", F.col("_begin") + F.col("file_row")).drop("_begin")


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """file, rows and failed for each Parquet file below path: failed are those that raw_records skips as unreadable.

    Rows are counted in one scan; only files that gave none are opened again, one by one, to tell empty from broken.
    """
    listed = files(spark, path).select(F.col("path").alias("file"))
    rows = raw_records(spark, path).groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    found = listed.join(rows, "file", "left")
    broken = []
    for (name,) in found.filter("rows IS NULL").select("file").collect():
        try:
            spark.read.parquet(name).schema  # noqa: B018
        except Exception:  # noqa: BLE001 — whatever keeps the file from being read
            broken.append((name,))
    failed = spark.createDataFrame(broken, "file string").withColumn("failed", F.lit(True))
    return found.join(F.broadcast(failed), "file", "left").select("file", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("failed", F.lit(False)).alias("failed"))


def raw_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of JSON lines; a line that is none is kept in _corrupt_record."""
    return spark.read.schema(T.StructType([*RAW_RECORD.fields, T.StructField("_corrupt_record", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def first_rows(records: DataFrame, n: int, *order: str) -> DataFrame:
    """A sample of at most SAMPLE_LIMIT rows, the first by order."""
    if not 0 <= n <= SAMPLE_LIMIT:
        raise ValueError(f"a sample holds up to {SAMPLE_LIMIT} rows; scan the files for more")
    return records.orderBy(*order).limit(n)


def load(spark: SparkSession, path: str, config: LoaderConfig) -> DataFrame:
    """Numbered raw records of a folder as config asks: a bounded sample of the first, or all."""
    records = with_row_index(raw_records(spark, path))
    if config.backend == "sample":
        if config.sample_size is None:
            raise ValueError(f"a sample holds up to {SAMPLE_LIMIT} rows; use backend 'files' for all")
        return first_rows(records, config.sample_size, "row_index")
    return records if config.sample_size is None else records.filter(F.col("row_index") < config.sample_size)


def after_row(records: DataFrame, last: int) -> DataFrame:
    """Numbered records beyond the last one that was processed."""
    return records.filter(F.col("row_index") > last)


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {query, language, category, expected_route}."""
    return spark.read.schema("query string, language string, category string, expected_route string").option("multiLine", "true").json(path)


def json_index(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON index files, each {"version": 1, "chunks": [...]}; another version is refused."""
    got = spark.read.option("multiLine", "true").json(path)
    if got.filter("version IS NULL OR version <> 1").limit(1).count():
        raise ValueError("unsupported index version")
    return got.select(F.explode("chunks").alias("c")).select("c.*")


def term_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Expansion terms (ord, term, expansions) from a JSON object of lists, in the file's order."""
    held = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return held.select(F.posexplode(F.map_entries("m")).alias("ord", "e")).select("ord", F.col("e.key").alias("term"), F.col("e.value").alias("expansions"))


def phrase_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Translations (source, target, phrase, translation) from JSON lines."""
    return spark.read.schema("source string, target string, phrase string, translation string").json(path)


def fields(records: DataFrame) -> list[str]:
    return sorted(records.columns)


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of a stored index or vector table."""
    return store.get(spark, path, name)
