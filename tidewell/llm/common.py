"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract here: space and \x09-\x0D, the set that bytes.split() uses.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local master has none set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame) -> DataFrame:
    """Like cut(), for wide rows: a compressed Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of results that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What a Python worker keeps from task to task, by operator: functions that drop it.
WARM: dict[str, Callable[[], None]] = {}


def cool() -> None:
    """Drop what earlier tasks of other operators left in this Python worker."""
    for drop in WARM.values():
        drop()


def give_back() -> None:
    """Return freed memory of this Python worker to the system: idle workers keep theirs otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def redeal(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by a hash of a key that is unique here.

    A join on that key then shuffles both sides itself, so that adaptive execution may split
    a hot key of the other side; an aggregate's own partitioning would forbid this.
    """
    return df.repartition(F.xxhash64(F.col(key), F.lit(17)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 4; rows with 2 are held out of all learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def bounded_sample(rows: DataFrame, by: str, per_value: int, key: str = "doc_id") -> DataFrame:
    """About per_value rows for each value of `by` (never more than 1.25 times that plus 50), by a hash of `key`.

    Counting reads only the two small columns. The values of `by` are few: the counts come to the driver.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    span = 1 << 30
    edge = F.create_map(*[F.lit(x) for v, n in counts.items() for x in (v, min(span, int(span * per_value / n) + 1))])
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(span)) < edge[F.col(by)])
