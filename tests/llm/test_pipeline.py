"""The pipeline on small tables, stage by stage, against brute force."""

import collections
import random

import corpus_pipeline
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(40)]
    texts[3] += " " + passage
    texts[7] = passage + " " + texts[7]
    texts += [texts[0], texts[0], texts[1] + "", "12 345 !!", "", None, "short one", "x " * 9000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, "a row without an id", "en", None, None), (4, texts[4], "en", "s", 1)]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        docs = docs.persist()
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= ids
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_stages_against_brute_force(spark, sf):
    stage = dict(corpus_pipeline.STAGES)
    rows = corpus()
    docs = spark.createDataFrame(rows, DOC)
    plain = lambda df: collections.Counter(tuple(r) for r in df.collect())

    kept = stage["language id"](spark, docs, sf).persist()
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert plain(kept) == collections.Counter(rows)

    kept = stage["simhash near-dedup"](spark, kept, sf).persist()
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(r[1], r[0])  # random texts of this length are no near copies of each other
    rows = [r for r in rows if r[0] == first[r[1]]]
    assert plain(kept) == collections.Counter(rows)

    cut = stage["suffix-array dedup"](spark, kept, sf).persist()
    seen = collections.Counter(r[1][k : k + 200] for r in rows for k in range(len(r[1]) - 199))
    want = []
    for r in rows:
        gone = {p for k in range(len(r[1]) - 199) if seen[r[1][k : k + 200]] > 1 for p in range(k, k + 200)}
        text = "".join(c for p, c in enumerate(r[1]) if p not in gone)
        want.append((r[0], text, r[2], r[3], len(text)) if r[4] is not None else (*r[:1], text, *r[2:4], len(text)))
    assert plain(cut) == collections.Counter(want) and any(len(w[1]) < len(r[1]) for w, r in zip(want, rows))

    mixed = stage["mixing"](spark, cut, sf).persist()
    assert set(plain(mixed)) == set(want) and all(n >= 1 for n in plain(mixed).values())
    packed = stage["packing"](spark, mixed, sf)
    assert packed.where("start = 0").count() == mixed.count()


@pytest.mark.parametrize("extra", ["", ", kept string, copies int, fp long, spans int, h long"])
def test_empty_tables_and_clashing_columns(spark, sf, extra):
    docs = spark.createDataFrame([], DOC + extra)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0 and len(docs.columns) == 5 + extra.count(","), name
    if extra:
        docs = spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in corpus()], DOC + extra)
        for name, stage in corpus_pipeline.STAGES[:4]:
            columns = docs.columns
            docs = stage(spark, docs, sf)
            assert docs.columns == columns and {tuple(r) for r in docs.select(*columns[5:]).collect()} == {("k", 1, 2, 3, 4)}, name


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
