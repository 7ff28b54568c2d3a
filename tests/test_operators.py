import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import quality as Q
from tidewell.operators import relational as R
from tidewell.operators import retrieval as T
from tidewell.sources import tables
from tidewell.sources.feed import FeedSource


def test_unstated_changes_nothing(spark):
    rows = spark.createDataFrame([(0.1 + 0.2, "certified", "unstated", "no", None), (0.1 + 0.2, "certified", "unstated", "no", "none")], "score double, level string, working string, lang string, speaker string")
    severity = T.language_severity(F.col("level"), F.col("working"), F.col("lang"), F.col("speaker"))
    out = [r[0] for r in rows.select(T.penalise(F.col("score"), severity, F.col("speaker").isNotNull(), 1.0)).collect()]
    assert out == [0.1 + 0.2, 0.0]


def test_prefix_ladder(spark):
    rows = spark.createDataFrame([("2223", "2223"), ("2223", "2224"), ("2223", "2299"), ("2223", "2999"), ("2223", "9999"), ("22", "2223"), (None, "2223")], "a string, b string")
    assert [r[0] for r in rows.select(T.prefix_proximity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.7, 0.4, 0.15, 0.0, 0.4, None]


def test_idf_of_a_term_in_all_documents(spark):
    import math

    assert spark.range(1).select(T.idf(F.lit(3), 3)).first()[0] == pytest.approx(math.log(1 + 0.5 / 3.5))


def test_missing_results_raise(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(R.MissingResult):
        R.complete(a, b, ["k"])


def test_upsert_and_insert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, tables.insert_missing(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    with pytest.raises(ValueError):
        tables.export_index(old, "/tmp/none", ["text"])


def test_accessible_fails_loudly(spark):
    rows = spark.createDataFrame([(None, "en")], "level string, lang string")
    with pytest.raises(Exception, match="missing"):
        rows.select(Q.accessible(F.col("level"), F.lit(None).cast("string"), F.col("lang"))).collect()


def test_census_calls_the_model_once_a_cluster(spark):
    items = spark.createDataFrame([(1, "Vi krever flytende norsk."), (2, "vi krever  flytende norsk"), (3, "English is fine here.")], "id long, text string")
    calls = spark.sparkContext.accumulator(0)

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        calls.add(len(batch))
        norsk = batch.text.str.contains("norsk")
        return pd.DataFrame({"signature": batch.signature, "level": norsk.map({True: "fluent", False: "unstated"}), "span": batch.text.where(norsk, "")})

    cache = spark.createDataFrame([], "signature string, level string, span string")
    out = {r["id"]: (r["level"], r["demoted"]) for r in Q.census(items, "id", "text", cache, model).collect()}
    assert out == {1: ("fluent", False), 2: ("fluent", False), 3: ("unstated", False)}
    assert calls.value == 2


def test_feed_follows_its_cursor(spark, tmp_path):
    page = lambda k, n: {"items": [{"id": f"{k}{i}", "url": "u", "_feed_entry": {"uuid": f"{k}{i}", "status": "ACTIVE", "sistEndret": "2024-01-01"}} for i in range(2)], "next_url": n}
    (tmp_path / "page0.json").write_text(json.dumps(page("a", "page1.json")))
    (tmp_path / "page1.json").write_text(json.dumps(page("b", None)))
    spark.dataSource.register(FeedSource)
    rows = spark.read.format("cursor_feed").option("path", str(tmp_path)).load()
    assert sorted(r["uuid"] for r in rows.collect()) == ["a0", "a1", "b0", "b1"]


def test_sealed_queries_raise(spark):
    from tidewell.operators.evaluation import SealedQuery, assert_unsealed

    with pytest.raises(SealedQuery):
        assert_unsealed(spark.createDataFrame([("q", "sealed")], "id string, split string"))


def test_silver_turns_bad_payloads_to_null(spark):
    raw = spark.createDataFrame([(1, '{"a": "x", "n": 3}'), (2, "{bad"), (3, '{"a": ""}')], "id int, payload string")
    assert [tuple(r) for r in R.silver(raw, "a string, n int").orderBy("id").collect()] == [(1, "x", 3), (2, None, None), (3, None, None)]
