"""Every catalogue query against its SQL, and what has no SQL against plain loops."""

import json
import random

import pytest

from compare import connect, rows
from tidewell.functions import text as X
from tidewell.operators import quality as Q
from tidewell.operators.evaluation import pair_greedily, phrase_agreement, rank_agreement, resample
from tidewell.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    ours = QUERIES[name](spark, sf).toPandas()
    theirs = connect(sf).execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def column(sf, table, *names):
    return connect(sf).execute(f"SELECT {', '.join(names)} FROM {table}").fetchall()


def test_normalised_and_scrubbed_texts(spark, sf):
    texts = dict(column(sf, "documents", "doc_id", "text"))
    got = {r["doc_id"]: r["text"] for r in QUERIES["normalise_text"](spark, sf).collect()}
    assert got == {k: X.fold(t) for k, t in texts.items()}
    got = {r["doc_id"]: r["text"] for r in QUERIES["pii_scrub"](spark, sf).collect()}
    assert got == {k: X.scrub_item(t, []) if t else t for k, t in texts.items()}
    scrubbed = QUERIES["facet_scrub"](spark, sf).toPandas().set_index("doc_id")
    assert scrubbed.phrase.to_dict() == got and scrubbed.span.to_dict() == texts


def test_pages_as_blocks(spark, sf):
    pages = dict(column(sf, "pages", "page_id", "html"))
    want = {k: X.html_blocks_of(h) for k, h in pages.items()}
    got = QUERIES["html_blocks"](spark, sf).collect()
    assert sorted((r["page_id"], r["index"], r["tag"], r["text"], r["n_chars"]) for r in got) == sorted((k, b["index"], b["tag"], b["text"], b["n_chars"]) for k, bs in want.items() for b in bs)
    got = {r["page_id"]: r["text"] for r in QUERIES["html_text"](spark, sf).collect()}
    assert got == {k: "\n".join(b["text"] for b in bs) for k, bs in want.items()}


def test_spans_are_judged_one_by_one(spark, sf):
    texts = dict(column(sf, "documents", "doc_id", "text"))
    got = sorted((r["doc_id"], r["span"], r["ok"], r["reason"]) for r in QUERIES["span_check"](spark, sf).collect())
    assert got == sorted((k, s, *Q.span_verdict(s, t)) for k, t in texts.items() for s in (t[:40], t[19:79]))


def test_batches_are_greedy(spark, sf):
    shards = {}
    for k, t in sorted(column(sf, "documents", "doc_id", "text")):
        shards.setdefault(k // 1000, []).append((k, len(t.encode())))
    want = {}
    for rows_ in shards.values():
        batch = held = 0
        for k, size in rows_:
            if held and held + size > 100_000:
                batch, held = batch + 1, 0
            want[k] = batch
            held += size
    assert {r["doc_id"]: r["batch"] for r in QUERIES["byte_batches"](spark, sf).collect()} == want


def test_facet_records_keep_their_rules(spark, sf):
    from tidewell.operators import facets as C

    texts = dict(column(sf, "documents", "doc_id", "text"))
    out = QUERIES["facet_records"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        record = json.loads(r["record"])
        assert not C.shape_faults(record) and not [f for f in C.word_faults(record) if f.how]
        assert r["demoted"] == any(x.startswith("demoted:") for x in r["reasons"])
        assert (r["doc_id"] % 70 > 60) == any("out_of_range" in x for x in r["reasons"])


def test_phrases_are_paired_as_by_loop(spark, sf):
    from tidewell.operators.evaluation import pair_greedily
    import re

    want = []
    for item, text in column(sf, "benchmark", "item_id", "text"):
        one = sorted(re.split(r"(?<=[.!?])\s+", text))
        other = sorted(re.sub("[.]+$", "", p) if len(p) % 3 == 0 else p[4:] if len(p) % 3 == 1 else p for p in one)
        pairs = pair_greedily(one, other)
        want += [(item, one[i], other[j], kind) for i, j, kind in pairs]
        want += [(item, g, None, "missed") for i, g in enumerate(one) if i not in {x[0] for x in pairs}]
        want += [(item, None, p, "extra") for j, p in enumerate(other) if j not in {x[1] for x in pairs}]
    got = [(r["item"], r["golden"], r["predicted"], r["agreement"]) for r in QUERIES["skill_pairing"](spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_query_without_sql_has_a_test_here():
    tested = {"normalise_text", "pii_scrub", "facet_scrub", "html_blocks", "html_text", "span_check", "byte_batches", "facet_records", "skill_pairing", "bootstrap_ci"}
    assert set(QUERIES) - set(ORACLES) == tested


def test_intervals_of_the_arms(spark, sf):
    out = QUERIES["bootstrap_ci"](spark, sf).toPandas()
    assert len(out) and QUERIES["bootstrap_ci"](spark, sf).toPandas().equals(out)


def test_bootstrap_is_the_seeded_loop():
    d = [0.1, -0.2, 0.3, 0.05]
    rng = random.Random(0)
    means = sorted(sum(d[rng.randrange(4)] for _ in d) / 4 for _ in range(200))
    assert resample(d, 200) == pytest.approx((4, sum(d) / 4, means[5], means[195], means[5] > 0 or means[195] < 0))
    assert resample([1.0]) == (1, None, None, None, None)


def test_pairing_is_one_to_one():
    assert phrase_agreement("Good Norwegian.", "good norwegian") == "trailing_punct_only"
    assert phrase_agreement("fluent spoken norwegian", "must have fluent spoken norwegian skills") == "containment"
    assert phrase_agreement("short", "a short one") == "disjoint"
    pairs = pair_greedily(["abc", "abc"], ["abc"])
    assert pairs == [(0, 0, "strict")]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_seeker_and_code_counts(spark, sf):
    con = connect(sf)
    pairs = con.execute("SELECT (SELECT count(*) FROM documents) * (SELECT count(*) FROM benchmark)").fetchone()[0]
    assert QUERIES["language_severity"](spark, sf).count() == pairs
    out = QUERIES["prefix_proximity"](spark, sf).toPandas()
    assert set(out.wanted) == set(out.code) and len(out) == out.code.nunique() ** 2


def test_rank_correlation_counts_every_document(spark, sf):
    out = QUERIES["rank_correlation"](spark, sf).toPandas()
    assert out.n.sum() == connect(sf).execute("SELECT count(*) FROM documents").fetchone()[0]
    rng = random.Random(1)
    rows = [(g, rng.randrange(40), i * 37 - 900) for g, many in (("a", 300), ("b", 60)) for i in range(many)]
    rng.shuffle(rows)
    found = {r["g"]: r for r in rank_agreement(spark.createDataFrame(rows, "g string, x long, y long"), "g", "x", "y", width=16).collect()}
    for g in ("a", "b"):
        own = [(x, y) for k, x, y in rows if k == g]
        sign = lambda v: (v > 0) - (v < 0)
        s = sum(sign((p[0] - q[0]) * (p[1] - q[1])) for i, p in enumerate(own) for q in own[:i])
        pairs = len(own) * (len(own) - 1) / 2
        ties = sum(p[0] == q[0] for i, p in enumerate(own) for q in own[:i])
        assert found[g]["n"] == len(own) and found[g]["kendall"] == pytest.approx(s / ((pairs - ties) * pairs) ** 0.5)
