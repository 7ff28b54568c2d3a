"""The corpus operators against brute force, and on nulls, empty tables, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import chat_format, embedding_dedup, language_id, lm_scoring, mixing, packing, quality_rules, simhash_dedup, suffix_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept string, score string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocab = {l: ["".join(rng.choice(abc) for _ in range(rng.randint(2, 8))) for _ in range(300)] for l, abc in (("en", "abcdetlhion"), ("fr", "éèaçuqlest"))}
    passage = " ".join(rng.choice(vocab["en"]) for _ in range(70)) + "."
    texts = []
    for i in range(n):
        l = "en" if i % 3 else "fr"
        lines = [" ".join(rng.choice(vocab[l]) for _ in range(rng.randint(3, 40))).capitalize() + "." for _ in range(rng.randint(1, 5))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 9 == 0 and texts:
            lines, l = [texts[-1][0], ""][: 1 + i % 2], texts[-1][1]
        texts.append(("\n".join(lines), l))
    texts += [("", "en"), (None, None), ("   \n\t", "en"), ("12 34 !!", "en"), ("x " * 9000, "en"), texts[1], texts[1]]
    rows = [(i, t, l, "s", len(t or ""), 7, "k", "z") for i, (t, l) in enumerate(texts)]
    return rows + [rows[2], (None, "an id is missing here", "en", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- 1 ---


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(6, 16))
    for i in range(120):
        v = base[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.14, 2.0])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3 // 2))
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], None), (202, [0.0] * 16, 0), (203, None, 0), (204, [float("nan")] * 16, 0), (205, [None] * 16, 0), (206, [float("inf")] + [1.0] * 15, 0), (207, [], 0), (208, rows[0][1][:8], 0)]
    return rows


@pytest.mark.parametrize("tile, kind", [(2048, "float"), (4, "float"), (2048, "double")])
def test_embeddings(spark, tile, kind, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 1 if tile == 4 else 64)
    rows = vectors()
    if kind == "double":  # 1 and 1 + 1e-12 differ as doubles only
        rows += [(300, [1.0] * 16, 0), (301, [1.0 + 1e-12] * 16, 0), (302, [1.0] * 15 + [-1e300], 0)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, bucket int, cid string")
    out = embedding_dedup.near_duplicates(frame, tables=60, tile=tile).toPandas().set_index("vec_id")
    good = [(i, np.array(v, float) / max(map(abs, v)), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = [(a, b) for k, (a, x, l) in enumerate(good) for b, y, m in good[:k] if l == m and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98]
    count = collections.Counter(i for pair in links for i in pair)
    assert len(out) == len(rows) and links
    assert out.n_links.to_dict() == {r[0]: count[r[0]] for r in rows}
    assert out.component_id.to_dict() == roots([r[0] for r in rows], links)
    assert (out.kept == (out.index == out.component_id)).all()


def test_repeated_and_missing_vector_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 1), (5, b, 1), (7, b, 1), (None, a, 1), (9, a, 1), (9, a, 1)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 1, 5, True), (7, 1, 5, False), (None, 0, None, True), (9, 2, 5, False), (9, 2, 5, False)], key=str)


@pytest.mark.parametrize("size", [64, 768])
def test_embedding_recall_at_the_querys_parameters(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(600, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9801 * x + math.sqrt(1 - 0.9801**2) * side  # hardly above the limit
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id")
    found = out.component_id.sort_index().to_numpy()[600:] == np.arange(600)
    assert found.mean() >= 0.998 and out.n_links.sum() == 2 * found.sum()


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- 2 ---


def test_ppm_code_lengths():
    texts = [b"abracadabra", b"banana", "é à".encode()]
    trees = language_id.Trees({"a": texts, "b": [b"zzz"]}, 3)
    count = [collections.Counter() for _ in range(4)]
    for t in texts:
        d = bytes(3) + t
        for i in range(3, len(d)):
            for k in range(4):
                count[k][d[i - k : i + 1]] += 1
    after = [collections.defaultdict(list) for _ in range(4)]
    for k in range(4):
        for g, n in count[k].items():
            after[k][g[:-1]].append(n)

    def bits(x):
        d, total = bytes(3) + x, 0.0
        for i in range(3, len(d)):
            for k in range(3, -1, -1):
                g = d[i - k : i + 1]
                own = after[k].get(g[:-1])
                if not own:
                    continue
                if count[k][g]:
                    total += math.log2((sum(own) + len(own)) / count[k][g])
                    break
                total += math.log2((sum(own) + len(own)) / len(own))
            else:
                total += 8
        return total

    for x in (b"banana bread", b"", b"abracadabra", "xéà".encode()):
        assert trees.bits([b"q", x])[1][0] == pytest.approx(bits(x), rel=1e-5, abs=1e-5)


def test_language_id(docs, none):
    out = language_id.identify(docs).toPandas()
    assert len(out) == docs.count()
    given = {r[0]: r for r in corpus()}
    for r in out.dropna(subset=["doc_id"]).itertuples():
        text = given[int(r.doc_id)][1]
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r.score <= 1
    words = out[out.doc_id < 60]
    assert np.mean([given[int(i)][2] == p for i, p in zip(words.doc_id, words.lang_pred)]) > 0.95
    assert language_id.identify(none).count() == 0
    assert language_id.keep_identified(docs).count() == (out.lang_pred != "und").sum()


# --- 3 ---


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    out = packing.pack(docs, TOKENIZER, 256, 8).toPandas()
    for (_, g) in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.values == np.r_[0, np.cumsum(g.length.values)[:-1]]).all() and g.length.sum() <= 256
        used = g.length.sum()
        assert (g.padding == (0 if used & (used - 1) == 0 else 256 - used)).all()
    left = collections.Counter((r.doc_id if r.doc_id == r.doc_id else None, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.itertuples())
    for r in corpus():
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 256):
            left[(r[0], s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes()), len(ids))] -= 1
    assert not any(left.values())
    assert out.sequence_id.nunique() <= out.length.sum() / 256 * 1.15 + 1
    assert packing.pack(none, TOKENIZER).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(0)
    demand = np.bincount(rng.integers(1, 40, 3000), minlength=65)[1:]
    plan = packing.solve(demand, 64)
    assert (sum(t * c for t, c in plan) == demand).all()
    assert all((c * np.arange(1, 65)).sum() <= 64 for _, c in plan)
    assert sum(t for t, _ in plan) <= 1.01 * (demand * np.arange(1, 65)).sum() / 64 + 2
    assert packing.solve(np.zeros(64, int), 64) == []
    with pytest.warns(UserWarning, match="still improving"):
        plan = packing.solve(demand, 64, rounds=2)
    assert (sum(t * c for t, c in plan) == demand).all()


# --- 4 ---


def test_quality(docs, none, spark):
    extra = [("a b c d e f a b c d e\na b c d e\na b c d e ###",), ("Home | About | Contact\nThis is a proper line of text with words.",), ("a b\x1cc d",)]
    rows = [r[:2] for r in corpus()] + [(1000 + i, t[0]) for i, t in enumerate(extra)]
    out = quality_rules.digest(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    want = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    got = [tuple(None if x != x else x for x in r[:7]) for r in out.itertuples(index=False)]
    assert sorted(got, key=repr) == sorted(want, key=repr) or collections.Counter(got) == collections.Counter(want)
    assert not out[out.base_failed].kept.any()
    lines = quality_rules.clean(spark.createDataFrame([(1, "Home | About | Contact\nIt is a proper line.\nno end\nAll rights reserved.\n$$$ !!! ###.", "clash")], "doc_id long, text string, n_words string"))
    assert lines.first()["kept_text"] == "It is a proper line."
    clash = quality_rules.clean(spark.createDataFrame([(1, "It is a line.", 7, "p", None)], "doc_id long, text string, _pos int, _text string, _row string")).first()
    assert (clash["_pos"], clash["_text"], clash["_row"], clash["text"]) == (7, "p", None, "It is a line.")
    assert quality_rules.clean(none).count() == 0


# --- 5 ---


def test_simhash(docs, none):
    out = simhash_dedup.near_duplicates(docs, tile=8).toPandas()

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w)] if 0 < len(w) < 4 else [" ".join(w[k : k + 4]) for k in range(len(w) - 3)]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r[0], fp(r[1])) for r in corpus()]
    keys = range(len(rows))
    comp = roots(keys, [(a, b) for a in keys for b in range(a) if (rows[a][1] ^ rows[b][1]).bit_count() <= 4])
    first = collections.defaultdict(lambda: math.inf)
    for k in keys:
        if rows[k][0] is not None:
            first[comp[k]] = min(first[comp[k]], rows[k][0])
    want = [(i, f"{f:016x}", first[comp[k]] if first[comp[k]] < math.inf else None) for k, (i, f) in enumerate(rows)]
    got = [tuple(None if x != x else x for x in r) for r in out.itertuples(index=False)]
    assert collections.Counter(got) == collections.Counter(want)
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == len({w[2] for w in want})


def test_tiles_compare_exactly():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
    ones = np.bitwise_count(x)
    edges = []
    for p in np.unique(ones):
        for q in range(p, p + 5):
            if (ones == q).any():
                edges += list(zip(*simhash_dedup.tile_links(x[ones == p], None if p == q else x[ones == q], 4)))
    brute = [(a, b) for k, a in enumerate(x.tolist()) for b in x[:k].tolist() if (a ^ b).bit_count() <= 4]
    assert roots(x.tolist(), [(int(a), int(b)) for a, b in edges]) == roots(x.tolist(), brute)


# --- 6 ---


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there.\nWhat is  Spark?"), (1, 1, "assistant", "> what is spark?\n\nAn engine."), (1, 2, "user", "On Monday, A wrote:\n> > What is Spark?\n> An engine.\nThanks"), (1, 3, "user", None), (1, 4, "user", ">  hello there.\nnew"), (None, 1, "user", "> An engine."), (2, 0, None, "> An engine.\nx"), (2, None, "a", "b"), (1, 3, "user", None)]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, content string")
    got = [(r["conv_id"], r["turn"], r["thread_turn"], r["parent_turn"], r["n_quoted"], r["n_linked"], r["content"]) for r in chat_format.conversations(frame).collect()]
    assert collections.Counter(got) == collections.Counter(
        [(1, 0, 0, None, 0, 0, "Hello there.\nWhat is  Spark?"), (1, 1, 0, 0, 1, 1, "An engine."), (1, 2, 0, 1, 2, 2, "Thanks"), (1, 3, 3, None, 0, 0, ""), (1, 3, 3, None, 0, 0, ""), (1, 4, 0, 0, 1, 1, "new"), (None, 1, 1, None, 0, 0, ""), (2, 0, 0, None, 1, 0, "x"), (2, None, None, None, 0, 0, "b")]
    )
    assert chat_format.conversations(frame.limit(0)).count() == 0


def test_wrapped_quotes_and_candidates(spark):
    rows = [
        (1, 0, "The first part is long\nand goes on here.\n\nA second part."),
        (1, 1, "> The first part\n> is long and goes on here.\nYes."),  # wrapped anew: a paragraph
        (1, 2, "> The first part is\n> long and goes on here.\n>\n> A second part.\nok"),  # the whole
        (1, 3, "> Yes.\n> nobody said this\nok"),  # a line of a passage
        (1, 4, "ok"),
        (1, 5, "> ok\n> > Yes.\nfine"),  # said by 2, 3 and 4: the last counts
        (2, 0, "> ok\nelsewhere"),
        (2, 1, "> elsewhere\n> elsewhere\n>> deep\nagain"),
    ]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows] * 2, "conv_id long, turn long, role string, text string")
    out = chat_format.conversations(frame).toPandas()
    assert len(out) == 2 * len(rows)
    got = {(r.conv_id, r.turn): (None if r.parent_turn != r.parent_turn else int(r.parent_turn), int(r.thread_turn), r.n_quoted, r.n_linked) for r in out.itertuples()}
    assert got == {(1, 0): (None, 0, 0, 0), (1, 1): (0, 0, 2, 2), (1, 2): (0, 0, 3, 3), (1, 3): (1, 0, 2, 1), (1, 4): (None, 4, 0, 0), (1, 5): (4, 4, 2, 2), (2, 0): (None, 0, 1, 0), (2, 1): (0, 0, 3, 2)}


def test_long_threads(spark):
    rows = [(1, t, "user", (f"> word number {t - 1}\n" if t else "") + f"word number {t}") for t in range(150)]
    out = chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {(r["thread_turn"], r["n"]) for r in out.groupBy("thread_turn").agg(F.count("*").alias("n")).collect()} == {(0, 150)}


# --- 7 ---


@pytest.mark.parametrize("common", [4096, 40])
def test_pseudo_likelihood(docs, none, monkeypatch, common):
    monkeypatch.setattr(lm_scoring, "COMMON", common)
    counts = lm_scoring.word_counts(docs)
    met = {bytes(r["word"]): r["n"] for r in counts.collect()}
    assert met == dict(collections.Counter(w for r in corpus() for w in (r[1] or "").encode().lower().split()))
    words = lm_scoring.vocabulary(counts)
    encoded = lm_scoring.encode(docs, words).persist()
    beside = np.zeros((words.size, lm_scoring.GROUPS))
    for r in corpus():
        ids = [words[w] for w in (r[1] or "").encode().lower().split()]
        for k, own in enumerate(ids):
            for offset in lm_scoring.CONTEXT:
                if 0 <= k + offset < len(ids):
                    beside[own, words.group[ids[k + offset]]] += 1
    assert (lm_scoring.beside(encoded, words) == beside).all()
    words.classify(beside)
    assert sum(met.values()) == words.class_mass.sum() == words.count.sum()
    net = lm_scoring.learn(encoded, words)
    assert net.windows == sum(met.values())
    out = lm_scoring.score(docs).toPandas()
    rare = set(met) - set(list(words)[: words.common])
    for text in (corpus()[3][1], corpus()[4][1]):
        ids = [words[w] for w in text.encode().lower().split()]
        total = 0.0
        for k, (own, w) in enumerate(zip(ids, text.encode().lower().split(), strict=True)):
            h = np.zeros(lm_scoring.HIDDEN)
            for o, offset in enumerate(lm_scoring.CONTEXT):
                h += net.table[o][ids[k + offset] if 0 <= k + offset < len(ids) else words.size]
            z = np.tanh(h) @ net.out + net.bias
            mass = sum(n for v, n in met.items() if words.cls[words[v]] == words.cls[own])
            total += z[words.cls[own]] - np.log(np.exp(z).sum()) + np.log(met[w] / mass)
        got = out[out.doc_id == next(r[0] for r in corpus() if r[1] == text)].iloc[0]
        assert got.n_tokens == len(ids) and got.log_prob == pytest.approx(total, rel=1e-4)
    assert (len(rare) > 0) == (common == 40)
    assert len(out) == docs.count() and (out.log_prob <= 0).all() and out[out.n_tokens == 0].mean_log_prob.isna().all()
    again = lm_scoring.score(docs.repartition(7)).toPandas()
    order = lambda x: x.sort_values(["doc_id", "log_prob"]).log_prob.to_numpy()
    assert np.allclose(order(out), order(again), rtol=1e-6)
    assert lm_scoring.score(none).count() == 0


def test_lm_step_is_the_gradient():
    words = lm_scoring.Vocabulary([(b"%d" % k, 9 - k) for k in range(8)], {3: 5})
    net, old = lm_scoring.Network(words, 1), lm_scoring.Network(words, 1)
    ids, spots = lm_scoring.lay_out([np.array([0, 3, 5, 1, 11, 3], np.uint16), np.array([7], np.uint16)], words.size)
    net.train(ids, spots, batch=64, rate=0.01)

    def loss(model):
        p = model.hidden(ids, spots).astype(float) @ model.out + model.bias
        return -(p[np.arange(len(spots)), words.cls[ids[spots]]] - np.log(np.exp(p).sum(axis=1))).mean()

    rng = np.random.default_rng(0)
    slopes = {}
    for name in ("table", "out", "bias"):
        own = getattr(old, name)
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in own.shape)
            kept = own[at]
            own[at] = kept + 1e-2
            up = loss(old)
            own[at] = kept - 1e-2
            slopes[name, at] = (up - loss(old)) / 2e-2
            own[at] = kept
    for (name, at), g in slopes.items():
        step = getattr(net, name)[at] - getattr(old, name)[at]
        acc = {"table": net.seen_table, "out": net.seen_out, "bias": net.seen_bias}[name][at[:2]]
        assert step == pytest.approx(-0.01 * g / math.sqrt(acc), rel=0.05, abs=2e-5)


def test_words_and_rows_of_many_texts_at_once():
    rng = random.Random(2)
    odd = [b"", b" ", b"  a B ", None, b"\x1c\x1d\x85 x\x85Y \xa0z", bytes(range(256)), "\u00c9 \u00c0B c".encode(), b"A\x0bB\x0cC\rD\tE\nF", b"z" * 99, b"\x00 \x00a"]
    odd += [bytes(rng.choice(b" \n\tabAB\xc3\xa9") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    plain = [" ".join("%x" % min(rng.getrandbits(24), rng.getrandbits(24) ** 2 % 3000) for _ in range(200)).encode() for _ in range(1500)]
    want = [(x or b"").lower().split() for x in odd + plain]
    words = lm_scoring.Vocabulary([(w, n) for w, n in collections.Counter(w for x in want for w in x).most_common(2000)], {})
    column = pa.array(odd + plain, pa.binary())

    def many(texts, most):
        for piece in lm_scoring.pieces(texts, most):
            found, n = lm_scoring.split(piece)
            yield found, n, *words.rows(found)

    for first, most in ((0, 50), (3, 10**6)):
        got, rows, shared = [], [], []
        for found, n, r, o in many(column.slice(first), most):
            ends = np.cumsum(n)
            got += [found.slice(e - k, k).to_pylist() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            rows += r.tolist()
            shared += o.tolist()
        assert got == want[first:]
        assert rows == [words[w] for x in want[first:] for w in x]
        assert shared == [r >= words.common for r in rows]
    # looking words up one at a time took too long
    fresh = lambda: lm_scoring.Vocabulary([(w, 1) for w in list(words)[: words.common]], {})
    old, new = [], []
    for _ in range(5):
        own = fresh()
        start = time.process_time()
        for x in plain:
            text = x.lower().split()
            np.fromiter(map(own.__getitem__, text), np.uint16, len(text))
        old.append(time.process_time() - start)
        start = time.process_time()
        for _ in many(pa.array(plain, pa.binary()), 10**6):
            pass
        new.append(time.process_time() - start)
    assert min(new) < 0.8 * min(old)


def test_lm_prefers_the_given_order(spark):
    rng = random.Random(0)
    say = lambda: " ".join(w for _ in range(40) for w in (rng.choice("abc"), rng.choice("xyz") * 2, rng.choice("mno") * 3))
    rows = [(i, say()) for i in range(300)]
    mixed = [(1000 + i, " ".join(rng.sample(t.split(), 120))) for i, t in rows[:20]]
    out = lm_scoring.score(spark.createDataFrame(rows + mixed, "doc_id long, text string")).toPandas().set_index("doc_id").mean_log_prob
    assert out[out.index < 20].mean() > out[out.index >= 1000].mean() + 0.5


# --- 8 ---


def test_mixing(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, int(i % 6 == 0)) for i in range(60)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.rates(docs, labels).toPandas()
    assert len(out) == out.doc_id.fillna(-1).nunique() == len({r[0] for r in corpus()})
    p = out[[f"p_{d}" for d in mixing.DOMAINS]].values
    assert np.allclose(p.sum(axis=1), 1) and (out.rate >= 0).all() and (abs(out.copies - out.rate) < 1).all()
    got = (p * (out.n_tokens * out.rate).values[:, None]).sum(axis=0) / out.n_tokens.sum()
    assert np.allclose(got, [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=0.02)
    assert mixing.mix(docs, labels, lowest=1.0).select("doc_id").distinct().count() == len({r[0] for r in corpus()})
    assert mixing.rates(none, labels).count() == 0
    assert mixing.rates(docs, labels.limit(0)).count() == len(out)


def test_mixing_keeps_columns_of_any_name(spark, docs):
    labels = docs.select("doc_id", F.lit(0).alias("toxic"), F.pmod("doc_id", F.lit(2)).cast("int").alias("quality"))
    wide = docs.select("*", *[F.lit(n).alias(n) for n in ("id", "copies", "row", "col", "_id", "_copies", "_k")])
    out = mixing.mix(wide, labels, lowest=1.0)
    assert out.columns == wide.columns
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in wide.collect()}


@pytest.mark.parametrize("found", [(0.57, 0.3, 0.13), (0.47, 0.14, 0.39)])
def test_mixing_reaches_targets_above_a_floor(spark, found):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([x * 3 for x in found], 400)
    p = p**2 / (p**2).sum(axis=1, keepdims=True)
    rows = [(i, int(rng.integers(20, 900)), *map(float, x)) for i, x in enumerate(p)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_good double, p_rough double, p_toxic double")
    out = members.withColumn("rate", mixing.fit(members, mixing.TARGETS, lowest=1.0)).toPandas()
    totals = (out[[f"p_{d}" for d in mixing.DOMAINS]].values * (out.n_tokens * out.rate).values[:, None]).sum(axis=0)
    assert (out.rate >= 1).all()
    assert np.allclose(totals / totals.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=2e-3)
    alike = members.select("doc_id", "n_tokens", *[(F.lit(1.0) / 3).alias(f"p_{d}") for d in mixing.DOMAINS])
    with pytest.warns(UserWarning, match="not reached"):
        rate = mixing.fit(alike, mixing.TARGETS, lowest=1.0)
    assert {r["r"] for r in alike.select(rate.alias("r")).collect()} == {1.0}


def test_mixing_posteriors_and_rates_are_recomputed(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(vocab[20 * (i % 3) :]) for _ in range(rng.randint(0, 30)))) for i in range(90)]
    marks = [(i, int(i % 3 == 0), int(i % 3 == 2)) for i in range(0, 90, 2)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in vocab], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    names = {i: "toxic" if t else "good" if q else "rough" for i, q, t in marks}
    count = {d: collections.Counter(bucket[w] for i, t in rows if names.get(i) == d for w in set(t.split())) for d in mixing.DOMAINS}
    prior = {d: sum(n == d for n in names.values()) + 1 for d in mixing.DOMAINS}
    out = mixing.rates(docs, labels).toPandas().set_index("doc_id")
    for i, t in rows:
        known = [b for b in {w: bucket[w] for w in set(t.split())}.values() if any(count[d][b] for d in mixing.DOMAINS)]
        raw = []
        for d in mixing.DOMAINS:
            total = sum(count[d].values()) + 0.5 * mixing.BUCKETS
            mean = sum(math.log((count[d][b] + 0.5) / total) for b in known) / len(known) if known else 0.0
            raw.append(mixing.STRENGTH * mean + math.log(prior[d] / sum(prior.values())))
        want = np.exp(np.array(raw) - max(raw))
        assert np.allclose(out.loc[i, [f"p_{d}" for d in mixing.DOMAINS]].to_numpy(float), want / want.sum(), atol=1e-9)
    p, n = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), out.n_tokens.to_numpy(float)
    slope = np.linalg.lstsq(np.column_stack([p, np.ones(len(p))]), out.rate.to_numpy(), rcond=None)[0]
    free = out.rate.to_numpy() > 0
    assert free.mean() > 0.5 and np.isfinite(slope).all()
    assert np.allclose((p * (n * out.rate.to_numpy())[:, None]).sum(axis=0) / n.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=2e-3)
    frac = out.rate - np.floor(out.rate)
    assert ((out.copies == np.floor(out.rate)) | (out.copies == np.floor(out.rate) + 1)).all() and (out.copies[frac == 0] == out.rate[frac == 0]).all()


# --- 9 ---


@pytest.mark.parametrize("options", [{}, {"chunk": 3000, "hot": 1}, {"chunk": 3000, "hot": 0}, {"chunk": 700, "witnesses": 2}])
def test_repeats(docs, none, options):
    rows = [(r[0], (r[1] or "").encode()) for r in corpus()]
    seen = collections.Counter(b[k : k + 200] for _, b in rows for k in range(len(b) - 199))
    want = []
    for i, b in rows:
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                mark[k : k + 200] = True
        kept = bytes(c for c, m in zip(b, mark) if not m)
        want.append((i, len(b), int(mark.sum()), int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    out = suffix_dedup.digest(docs, **options).toPandas()
    got = [tuple(None if x != x else x for x in r) for r in out.itertuples(index=False)]
    assert collections.Counter(got) == collections.Counter(want) and sum(w[2] for w in want)
    if not options:
        assert suffix_dedup.digest(none).count() == 0
        assert suffix_dedup.without_repeats(docs).columns == docs.columns
        assert suffix_dedup.without_repeats(none).count() == 0


@pytest.mark.parametrize("options", [{}, {"chunk": 3000, "hot": 1}, {"chunk": 700, "witnesses": 2}])
def test_repeats_in_parts_of_buckets(docs, options, monkeypatch):
    want = suffix_dedup.digest(docs, **options).collect()
    monkeypatch.setattr(suffix_dedup, "layout_of", lambda total: (3, 40))
    got = suffix_dedup.digest(docs, **options).collect()
    assert collections.Counter(got) == collections.Counter(want) and sum(r["n_removed"] for r in got)


def test_chunks_send_few_rows_to_buckets_of_a_large_corpus():
    data = np.random.default_rng(0).integers(97, 123, suffix_dedup.CHUNK).astype(np.uint8).tobytes()
    own = suffix_dedup.Chunk(data, np.array([len(data)]), 200, 40)
    own.codes = np.full(len(own.many), suffix_dedup.COMPARE, np.uint8)
    for total in (10**9, 10**10):  # of text; the larger one is about 6 GB of Parquet
        n, fan = suffix_dedup.layout_of(total)
        assert n * fan >= total * 2 // 3 // suffix_dedup.PART_BYTES and fan <= 256
        sent = suffix_dedup.Layout(own, n, fan)
        assert len(sent.lo) > 5000 and len(sent.full) <= 256


def test_cuts_leave_whole_characters(spark):
    passage = "".join(chr(0x4E00 + k * 7 % 5000) for k in range(80))  # 240 bytes, cut anywhere within a character
    rows = [(1, "é\ufffd" + passage + "ö end \ufffd", "a", 5), (2, "x" + chr(0x4F00) + passage[1:] + "\ufffd", "b", 6), (3, None, "c", 7), (4, "", "d", 8)]
    out = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string, spans int"))
    got = {r["doc_id"]: (r["text"], r["kept"], r["spans"]) for r in out.collect()}
    assert got == {1: ("é\ufffd" + "ö end \ufffd", "a", 5), 2: ("x\ufffd", "b", 6), 3: (None, "c", 7), 4: ("", "d", 8)}


def test_suffix_order_and_repeats():
    rng = np.random.default_rng(0)
    for turn in range(60):
        s = rng.integers(1, 4, int(rng.integers(1, 90)))
        order = suffix_dedup.suffix_order(s, 200)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        strings = [bytes(rng.integers(97, 99, int(rng.integers(8, 50))).astype(np.uint8)) for _ in range(5)]
        windows = [x[i : i + 8] for x in strings for i in range(len(x) - 7)]
        count = collections.Counter(windows)
        assert suffix_dedup.repeated(strings, 8).tolist() == [count[w] > 1 for w in windows]


# --- 10 ---


def test_toxicity(spark):
    rng = random.Random(0)
    plain = ["".join(rng.choice("abcdeou") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(2000):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["idiotic", "idiots", "scum"])
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), 3.0))
        labels.append((i, int(bad), "x"))
    rows += [(9000, None, None, 0.0), (9001, "", "en", 0.0), (None, "scum", "en", 0.0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    out = toxicity.classify(docs, marks).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and ((out.score >= 0.3).astype(int) == out.predicted).all()
    known = out.dropna(subset=["doc_id"]).merge(pd.DataFrame(labels, columns=["doc_id", "toxic", "t"]), on="doc_id")
    held = known[known.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95
    assert toxicity.classify(docs.limit(0), marks).count() == 0
    assert (toxicity.classify(docs, marks.limit(0)).toPandas().score == 0).all()


def test_toxicity_network_is_recomputed():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["tree", "lakeside", "road", "Scum", "idiotic", "x"]) for _ in range(rng.randint(0, 9))).encode() for _ in range(80)]
    rows = [(i, t, int(b"Scum" in t or b"idiotic" in t), "en") for i, t in enumerate(texts)]
    model = toxicity.Model(rows)
    net = model.net
    p, _ = model.raw(texts)
    for text, got in zip(texts, p, strict=True):
        words = text.decode().lower().split() or [None]
        own = []
        for w in words:
            rows_ = [] if w is None else [zlib.crc32(w.encode()) % toxicity.BUCKETS] + [zlib.crc32(b"%d " % k + w[:k].encode()) % toxicity.BUCKETS for k in toxicity.PREFIXES if len(w) > k]
            own.append(net.emb[rows_].astype(float).sum(axis=0) if rows_ else np.zeros(toxicity.SIZE))
        n = len(own)
        own += [np.zeros(toxicity.SIZE)] * 4
        block, top = 0, []
        for width in toxicity.WIDTHS:
            cols = [net.w[:, (block + k) * toxicity.FILTERS : (block + k + 1) * toxicity.FILTERS] for k in range(width)]
            top.append(np.max([sum(own[i + k] @ cols[k] for k in range(width)) for i in range(n)], axis=0))
            block += width
        z = np.maximum(np.concatenate(top) + net.b, 0) @ net.v + net.c[0]
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
    hist = np.zeros((1, 2, 2 * toxicity.FAR * toxicity.FINE), int)
    for bin_, label, n in ((100, 0, 50), (200, 1, 30), (180, 0, 3), (150, 1, 2)):
        hist[0, label, bin_] = n
    model.calibrate(hist, 1.0)
    edge = lambda b: 1 / (1 + math.exp(toxicity.FAR - b / toxicity.FINE))
    # of the cuts below 200, 180 (30 hits, 3 false), 150 and 100, the first has F1 60 / 62, and 150 has 64 / 67
    assert model.threshold[0] == pytest.approx((edge(200) + edge(181)) / 2)


def test_toxicity_calibrates_on_all_labels(spark, monkeypatch):
    rng = random.Random(0)
    rows = [(i, " ".join([rng.choice(["tree", "lake", "road"]) for _ in range(9)] + ["scum"] * (i % 2)), "en", i % 2) for i in range(1200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    met = []
    monkeypatch.setattr(toxicity.Model, "calibrate", lambda self, hist, negatives: met.append(hist.sum()))
    toxicity.learn(frame.drop("toxic"), frame.select("doc_id", "toxic"), per_class=60)
    assert met[0] > 0.75 * 1200 - 2 * (60 * 1.25 + 50) - 60
