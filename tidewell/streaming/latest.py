"""Latest state of each key from a stream of revisions, by event time and not by arrival."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.relational import latest_state
from tidewell.sources.tables import scratch


def revisions(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A folder or file of Parquet revisions as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def latest_stream(stream: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The stream's state: one struct of maxima for each key, late and repeated revisions included."""
    return latest_state(stream, key, by)


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: str, by: list[str]):
    """Keep a Parquet table of latest revisions: each batch is reduced, merged with the table and put in its place."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merged = batch
        if number:  # a version that is gone is lost state: reading it raises
            merged = spark.read.parquet(f"{path}/v{number - 1}").unionByName(batch)
        latest_state(merged, key, by).write.mode("overwrite").parquet(f"{path}/v{number}")
        if number > 1:  # the version before stays, for a batch that is run again
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def working_dir(spark: SparkSession) -> str:
    return f"{scratch(spark)}/stream-{uuid.uuid4().hex}"


def replay_latest(spark: SparkSession, path: str, key: str = "user_id", by: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Run the revisions at path through a stream to its end, and return the state."""
    own = working_dir(spark)
    # one streaming aggregation; the sink gets the complete state at each trigger and the last one is read
    state = latest_stream(revisions(spark, path), key, list(by))
    done: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{own}/state{number}")
        done.append(f"{own}/state{number}")

    state.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{own}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not done:  # nothing ever came
        return latest_state(spark.read.parquet(path), key, list(by))
    return spark.read.parquet(done[-1])


def without_repeats(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Drop revisions that arrive again within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
