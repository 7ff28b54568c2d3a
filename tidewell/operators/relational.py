"""ETL operators: latest state, staleness, fan-out, joins with completeness checks, set agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingResult(RuntimeError):
    """A key that was asked for has no result."""


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order (make it total: add a tie-break)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def latest_state(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Like latest() with all of `by` descending, as one aggregation: partial maxima before the shuffle, so a hot key costs no sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_n(rows: DataFrame, key: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)


def unfinished(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done.select(*keys), keys, "left_anti")


def stale_or_missing(items: DataFrame, done: DataFrame, key: str, version: str, now) -> DataFrame:
    """Items without a result, or with one of another version (null counts as another)."""
    current = done.where(F.col(version).eqNullSafe(F.lit(now))).select(key)
    return items.join(current, key, "left_anti")


def complete(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with found's columns; raises if a key has no row there."""
    lost = wanted.join(found.select(*keys), keys, "left_anti").limit(5).collect()
    if lost:
        raise MissingResult(f"no result for {[tuple(r[k] for k in keys) for r in lost]}")
    return wanted.join(found, keys)


def clusters(items: DataFrame, key: str, signature: Column) -> DataFrame:
    """(signature, rep, n): one row for each group of items with equal signatures; the smallest key stands for it."""
    return items.groupBy(signature.alias("signature")).agg(F.min(key).alias("rep"), F.count("*").alias("n"))


def fan_out(items: DataFrame, key: str, signature: Column, results: DataFrame) -> DataFrame:
    """Each item with the result of its group's representative; raises if one has none. results has column rep."""
    named = items.select(key, signature.alias("signature")).persist()  # made once: for the check below and for both sides of the join
    reps = named.groupBy("signature").agg(F.min(key).alias("rep"))
    complete(reps.select("rep"), results.select("rep").distinct(), ["rep"])
    return named.join(reps, "signature").select(key, "rep").join(results, "rep")


def agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both key sets, of their intersection and differences, and the Jaccard index."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    n = lambda c: F.count(F.when(c, 1))
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.agg(n(l).alias("n_left"), n(r).alias("n_right"), n(l & r).alias("n_both"), n(l & ~r).alias("n_left_only"), n(~l & r).alias("n_right_only")).withColumn("jaccard", F.try_divide(F.col("n_both").cast("double"), (F.col("n_both") + F.col("n_left_only") + F.col("n_right_only")).cast("double")))


def silver(raw: DataFrame, schema: str) -> DataFrame:
    """Payload JSON as typed columns; a payload that doesn't parse gives nulls, an empty string becomes null."""
    parsed = raw.withColumn("_p", F.from_json("payload", schema))
    names = parsed.select("_p.*").columns
    return parsed.select(*[c for c in raw.columns if c != "payload"], *[(F.nullif(F.col(f"_p.{n}"), F.lit("")) if dict(parsed.select("_p.*").dtypes)[n] == "string" else F.col(f"_p.{n}")).alias(n) for n in names])


def value_shares(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, share): the distribution of a value inside each group."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
