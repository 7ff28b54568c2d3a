"""Reading and writing tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where a local master has none set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def append(df: DataFrame, path: str) -> None:
    """Bronze: rows are only ever added; new columns are merged on read."""
    df.write.mode("append").parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A table whose later files may have more columns than its first."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows, and those of old whose key new doesn't have."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old's rows, and one row of new for each key that old doesn't have."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def export_index(df: DataFrame, path: str, allowed: list[str], forbidden: tuple[str, ...] = ("text", "body", "employer", "contacts")) -> None:
    """The static search index: one JSON file with allowed columns only."""
    if leaked := set(allowed) & set(forbidden):
        raise ValueError(f"columns that must not be exported: {sorted(leaked)}")
    df.select(*allowed).coalesce(1).write.mode("overwrite").json(path)


def write_report(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)


def assert_fresh(df: DataFrame, ts: str, now, hours: int = 24) -> None:
    """Raise unless the newest row is `hours` old at most."""
    age = df.agg((F.lit(now).cast("timestamp") - F.max(ts)).cast("interval day to second").alias("age")).first()["age"]
    if age is None or age.total_seconds() > hours * 3600:
        raise RuntimeError(f"newest entry is {age} old")


def assert_seek(df: DataFrame, ts: str, since, days: int = 7) -> None:
    """Raise unless the first row lies within `days` of the requested start."""
    first = df.agg(F.min(ts).alias("t")).first()["t"]
    if first is None or abs((first - since).total_seconds()) > days * 86400:
        raise RuntimeError(f"the feed starts at {first}, not near {since}")
