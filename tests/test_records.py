"""Records, calls and streams on small cases."""

import json

import pandas as pd
import pytest

from tidewell.operators import evaluation as V
from tidewell.operators import records as K
from tidewell.operators import relational as R
from tidewell.operators import retrieval as T
from tidewell.sources import tables
from tidewell.streaming import latest


def test_details_are_looked_up_once_with_retries(spark, tmp_path):
    def get(key):
        if key == "gone":
            return 404, None
        if key == "stub":
            return 200, {"uuid": key}
        return 200, {"ad_content": {"title": key}}

    keys = spark.createDataFrame([("a",), ("stub",), ("gone",), ("a",)], "uuid string")
    out = {r["uuid"]: (r["outcome"], r["payload"]) for r in K.fetch_details(keys, "uuid", get, rate=1e6).collect()}
    assert out == {"a": ("active", json.dumps({"ad_content": {"title": "a"}})), "stub": ("inactive_stub", json.dumps({"uuid": "stub"})), "gone": ("http_error", None)}


def test_retry_waits_longer_each_time():
    answers, waits = iter([(500, None), (429, None), (200, {"x": 1})]), []
    assert K.with_retry(lambda: next(answers), sleep=waits.append) == (200, {"x": 1}) and waits == [2.0, 4.0]

    def broken():
        raise OSError("no route")

    waits.clear()
    assert K.with_retry(broken, sleep=waits.append)[0] == 0 and waits == [2.0, 4.0, 8.0, 16.0]
    assert K.outcome(0, None) == "error" and K.with_retry(lambda: (404, None), sleep=waits.append)[0] == 404


def test_calls_are_spread():
    now = [0.0]
    limit = K.Bucket(5.0, now=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(11):
        limit.acquire()
    assert now[0] == pytest.approx(2.0)


def test_narrower_ends_on_cycles():
    tree, asked = {"a": ["b", "c"], "b": ["a"], "c": ["d"], "d": []}, []
    assert K.narrower(["a"], lambda u: asked.append(u) or tree[u]) == {"a", "b", "c", "d"} and sorted(asked) == ["a", "b", "c", "d"]


def test_polling_ends_or_raises():
    states = iter(["in_progress", "canceling", "ended"])
    assert K.poll(lambda: next(states)) == "ended"
    with pytest.raises(K.BatchFailed, match="unknown"):
        K.poll(lambda: "lost")
    with pytest.raises(K.BatchFailed, match="not ended"):
        K.poll(lambda: "in_progress", most=3)


def test_labels_with_spans(spark):
    text = "We need someone. You must speak norsk very well here.\nNorsk autorisasjon som lege."
    rows = [
        (3, "a", True, "fluent", None, "You must speak norsk very well here.", "Norsk  autorisasjon som lege", "no"),
        (1, "a", True, "fluent", None, "speak norsk very well", None, "no"),  # refused, so the next of a isn't a duplicate
        (4, "a", True, "fluent", None, None, None, "no"),
        (None, "b", True, "desirable", "", None, "Bachelor", "en"),
        (5, "b", True, "unstated", "english", None, None, "no"),
        (6, "c", True, "fluent", None, None, None, "no"),
        (7, "b", False, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "n int, uuid string, confirmed boolean, level string, working string, span string, auth string, doc_lang string")
    accepted, refused = K.ingest_labels(frame, spark.createDataFrame([("a", text), ("b", text)], "uuid string, text string"))
    assert sorted((r["n"], r["uuid"], r["derived_accessible"]) for r in accepted.collect()) == [(1000, "a", False), (1001, "b", True)]
    assert {(r["n"], r["reason"]) for r in refused.collect()} == {(1, "span:starts_mid_sentence"), (4, "duplicate_uuid"), (None, "duplicate_uuid"), (6, "no_ad_text"), (7, "unconfirmed")}


def test_mapping_names_real_columns(spark):
    frame = spark.createDataFrame([(1, "x")], "extent int, engagementtype string")
    assert K.missing_columns(["ads.extent", None, "ads.nothing", "other.x"], {"ads": frame}) == ["ads.nothing", "other.x"]


def test_bad_pair_id_raises(spark):
    frame = spark.createDataFrame([("p:1", 3)], "p string, i int")
    with pytest.raises(Exception, match="not a pair id"):
        frame.select(K.pair_id(frame.p, frame.i)).collect()


def test_scrubbed_facets_keep_spans(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([([("call 22 33 44 55", "required")], "mail a.b@c.no now")], "skills array<struct<phrase: string, level: string>>, auth string")
    skills, auth = K.scrub_facets(F.col("skills"), F.col("auth"))
    row = frame.select(skills.alias("s"), auth.alias("a")).first()
    assert row["s"][0]["phrase"] == "call [telefon fjernet]" and row["a"] == "mail [e-post fjernet] now"


def test_a_lost_representative_raises(spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, t string")
    with pytest.raises(R.MissingResult):
        R.fan_out(items, "id", F.col("t"), spark.createDataFrame([(1, "r")], "rep long, v string")).collect()


def test_judgments_belong_to_queries(spark):
    ranks = spark.createDataFrame([("a", 1, 10, 1), ("a", 2, 10, 1)], "arm string, query_id long, doc_id long, rank int")
    judged = spark.createDataFrame([(1, 10, 3, True), (2, 11, 3, False)], "query_id long, doc_id long, grade int, violates boolean")
    out = {r["query_id"]: r for r in V.metrics(ranks, judged).collect()}
    assert (out[1]["ndcg"], out[1]["cvr"]) == (1.0, 1.0) and (out[2]["ndcg"], out[2]["cvr"], out[2]["judged"]) == (0.0, 0.0, 0.0)


def test_stored_index_is_the_direct_score(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, "the red")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red fox"), (8, "nothing")], "query_id long, text string")
    path = T.build_index(docs, str(tmp_path / "index"), buckets=4)
    key = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert key(T.search_index(spark, path, asked, buckets=4)) == key(T.bm25(docs, asked)) != []


def test_stream_upserts_keep_the_latest(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "uuid string, modified long, status string"

    def arrive(rows):
        tables.append(spark.createDataFrame(rows, schema), source)
        stream = latest.revisions(spark, source)
        latest.upsert_latest(stream, target, mark, "uuid", ["modified"]).trigger(availableNow=True).start().awaitTermination()

    arrive([("a", 1, "old"), ("b", 5, "new")])
    arrive([("a", 3, "new"), ("b", 4, "late")])
    arrive([("c", 1, "new")])
    versions = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    state = {r["uuid"]: r["status"] for r in spark.read.parquet(f"{target}/{versions[-1]}").collect()}
    assert state == {"a": "new", "b": "new", "c": "new"} and len(versions) == 2


def test_tables(spark, tmp_path):
    from datetime import datetime

    frame = spark.createDataFrame([(1, datetime(2026, 1, 2)), (2, datetime(2026, 1, 3))], "id long, ts timestamp")
    tables.assert_fresh(frame, "ts", datetime(2026, 1, 3, 20))
    with pytest.raises(RuntimeError, match="old"):
        tables.assert_fresh(frame, "ts", datetime(2026, 1, 9))
    tables.assert_seek(frame, "ts", datetime(2026, 1, 1))
    with pytest.raises(RuntimeError, match="starts at"):
        tables.assert_seek(frame, "ts", datetime(2025, 1, 1))
    tables.append(frame, str(tmp_path / "t"))
    tables.append(frame.selectExpr("id", "ts", "1 as more"), str(tmp_path / "t"))
    assert tables.read_merged(spark, str(tmp_path / "t")).columns == ["id", "ts", "more"]
    tables.write_report(spark, {"model": "m", "n": 3}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["n"] == 3
    with pytest.raises(ValueError, match="must not be exported"):
        tables.export_index(frame, str(tmp_path / "x"), ["id", "text"])
    (tmp_path / "golden.json").write_text(json.dumps([{"uuid": "a", "expected": {"level": "fluent"}}, {"uuid": "b", "expected": {"level": "unstated"}}], indent=1))
    assert {r["uuid"] for r in spark.read.json(str(tmp_path / "golden.json"), multiLine=True).collect()} == {"a", "b"}


def test_sealed_queries_raise(spark):
    with pytest.raises(V.SealedQuery):
        V.assert_unsealed(spark.createDataFrame([("a", "sealed")], "q string, split string"))


def test_extraction_is_injected(spark):
    from tidewell.operators.quality import extract

    frame = spark.createDataFrame([(1, "x"), (2, "yy")], "id long, text string")
    out = extract(frame, "id long, n long", lambda b: pd.DataFrame({"id": b["id"], "n": b["text"].str.len()}))
    assert {(r["id"], r["n"]) for r in out.collect()} == {(1, 1), (2, 2)}


TEXT = "About us.\nYou must speak norsk very well here. We like people.\nGood English is a plus."
SPAN = {"span": "You must speak norsk very well here.", "section_language": "en"}


def good(**given):
    from tidewell.operators import facets as C

    return C.defaults(evidence_spans=[SPAN], evidence_basis="explicit_statement", evidence_strength="explicit_and_unambiguous", norwegian_requirement_level="fluent", **given)


@pytest.mark.parametrize(
    "given, reasons, changed",
    [
        ({}, [], {}),
        ({"application_language": ["both"]}, ["shape:application_language:expected_string_got_list", "enum:application_language=['both']", "demoted:invalid_shape", "demoted:invalid_enum_value"], {"application_language": "unstated"}),
        ({"application_language": "both"}, ["enum:application_language='both'", "demoted:invalid_enum_value"], {"application_language": "unstated"}),
        ({"min_years_experience": 400}, ["shape:min_years_experience:out_of_range_400", "demoted:invalid_shape"], {"min_years_experience": None}),
        ({"min_years_experience": True}, ["shape:min_years_experience:expected_['integer', 'null']_got_bool", "demoted:invalid_shape"], {"min_years_experience": None}),
        ({"skills": [{"phrase": "x", "level": "required"}] * 9}, ["shape:skills:maxItems_8_got_9", "demoted:invalid_shape"], {"skills": [{"phrase": "x", "level": "required"}] * 8}),
        ({"skills": ["x", {"phrase": "y", "level": "preferred"}]}, ["shape:skills[0]:expected_object_got_str", "demoted:invalid_shape"], {"skills": [{"phrase": "y", "level": "preferred"}]}),
        ({"skills": [{"phrase": "x", "level": "vital"}]}, ["enum:skills.level='vital'", "demoted:invalid_enum_value"], {}),
        ({"implicit_evidence": ["nothing"]}, ["enum:implicit_evidence='nothing'", "demoted:invalid_enum_value"], {}),
        ({"seniority": "senior", "min_years_experience": 0}, ["senior_with_zero_years"], {}),
        ({"truncated": True, "evidence_basis": "no_mention"}, ["no_mention_with_span", "verdict_without_evidence", "flag:no_mention_on_truncated_ad"], {}),
        ({"evidence_spans": ["bare"]}, ["shape:evidence_spans[0]:expected_object_got_str", "demoted:verdict_lost_its_evidence", "demoted:invalid_shape"], {"evidence_spans": [], "norwegian_requirement_level": "unstated", "evidence_basis": "no_mention", "evidence_strength": "none"}),
        ({"evidence_spans": [{"span": "Good English is"}, SPAN]}, ["span:ends_mid_sentence"], {"evidence_spans": [SPAN]}),
        ({"evidence_spans": [{"span": "We like people."}]}, ["span:no_language_token", "demoted:verdict_lost_its_evidence"], {"evidence_spans": [], "norwegian_requirement_level": "unstated", "evidence_basis": "no_mention", "evidence_strength": "none"}),
    ],
)
def test_whole_records(given, reasons, changed):
    from tidewell.operators import facets as C

    record = good() | given
    kept, found = C.judge(record, TEXT)
    assert found == reasons and kept == record | changed
    assert record == good() | given  # never changed in place


def test_silent_records_are_coherent_and_mended_ones_are_whole():
    from tidewell.operators import facets as C

    assert C.judge(C.defaults(), TEXT) == (C.defaults(), [])
    missing = C.judge({}, TEXT)[1]
    assert missing[-1] == "demoted:invalid_enum_value" and "enum:seniority=None" in missing
    for junk in (3, "x", None, [[1]], {"a": 1}, 1.5):
        kept, _ = C.judge({name: junk for name in C.RECORD}, TEXT)
        assert not [f for f in C.shape_faults(kept)] and not [f for f in C.word_faults(kept) if f.how]


def test_records_as_json(spark):
    from pyspark.sql import functions as F
    from tidewell.operators import facets as C

    rows = [(json.dumps(good()), TEXT), ("not json", TEXT), (None, TEXT), ("[1]", None), (json.dumps(good()), None)]
    out = [r["j"] for r in spark.createDataFrame(rows, "raw string, text string").select(C.judged(F.col("raw"), F.col("text")).alias("j")).collect()]
    assert [r["demoted"] for r in out] == [False, None, None, None, True]
