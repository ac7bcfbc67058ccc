"""Reading and writing attempts: JSON lines, bundles of tables, upserts and manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strokewise.operators.state import fresh, upserted

EVENT = T.StructType([T.StructField(n, t) for n, t in (("seq", T.LongType()), ("kind", T.StringType()), ("t", T.LongType()), ("x", T.DoubleType()), ("y", T.DoubleType()))])
ATTEMPT = T.StructType([T.StructField("attempt_id", T.StringType()), T.StructField("session", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("events", T.ArrayType(EVENT)), T.StructField("_corrupt_record", T.StringType())])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = ATTEMPT) -> DataFrame:
    """Attempts from JSON lines; a line that doesn't fit keeps its text in _corrupt_record."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def bundle(attempts: DataFrame) -> dict[str, DataFrame]:
    """The three tables of stored attempts: attempts, their events, and a summary of each."""
    events = attempts.select("attempt_id", F.explode("events").alias("e")).select("attempt_id", "e.*")
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    summary = events.groupBy("attempt_id").agg(F.count("*").alias("n_events"), count("pointerdown"), count("pointerup"), count("pointercancel"))
    return {"attempts": attempts.drop("events", "_corrupt_record"), "events": events, "summaries": summary}


def write_bundle(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch overwrites its own part of the three tables, so a batch that is run again leaves nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        first = batch.dropDuplicates(["attempt_id"])
        for name, rows in bundle(first).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return write


def append_new(spark: SparkSession, rows: DataFrame, path: str, ident: str, order: list[str]) -> None:
    """Appends the rows whose id isn't stored yet."""
    stored = spark.read.parquet(path) if _exists(spark, path) else rows.limit(0)
    fresh(rows, stored, ident, order).write.mode("append").parquet(path)


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: list[str], version: str) -> str:
    """Writes the table with the rows merged in as its next generation, beside the present one, and returns where."""
    old, at = newest(spark, path)
    merged = upserted(old, rows, key, version) if old is not None else upserted(rows.limit(0), rows, key, version)
    out = f"{path}/generation={at + 1:06d}"
    merged.write.mode("overwrite").parquet(out)
    return out


def newest(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The newest generation of a table and its number; (None, 0) without any."""
    names = _children(spark, path)
    done = sorted(n for n in names if n.startswith("generation=") and _exists(spark, f"{path}/{n}/_SUCCESS"))
    return (spark.read.parquet(f"{path}/{done[-1]}"), int(done[-1].split("=")[1])) if done else (None, 0)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def unsealed(files: DataFrame, sealed: DataFrame) -> DataFrame:
    """The files whose content isn't among the sealed ones."""
    return files.join(sealed.select("sha256").distinct(), "sha256", "left_anti")


def _fs(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def _children(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
