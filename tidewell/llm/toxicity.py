"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of a hashed row for the word and one for each of its first letters'
prefixes (PREFIXES), so that inflected forms share what is learned of their stem.

Filters of several widths slide over the word embeddings, each keeps its largest response over the
whole text, and a logistic unit weighs them. Thresholds are calibrated for each language on all labelled
rows that the fit didn't use, from histograms of their scores; the language is guessed from the words, never read. Scores are then bent so
that each language's threshold lies at the same score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bounded_sample, cut, held_out
from tidewell.llm.language_id import portions

#: Labelled documents fitted on, for each class, about; this bounds what the driver gets.
PER_CLASS = 1500
BUCKETS = 1 << 15
WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 16
#: The score at which every language's threshold is put.
CUT = 0.3
#: Lengths of the prefixes that have rows of their own.
PREFIXES = (4, 5, 6)
#: Bins of a score's logit for each unit, and the largest logit told apart.
FINE, FAR = 64, 20
#: Labelled rows of each class that a language needs for a threshold of its own.
ENOUGH = 20
#: Distinct words that a task remembers before it starts afresh.
MEMO = 200_000
_GAP = max(WIDTHS)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Words(dict):
    """Numbers of the words met so far, and each one's buckets; number 0 stands for gaps."""

    def __init__(self):
        super().__init__()
        self.buckets: list[list[int]] = [[BUCKETS] * (1 + len(PREFIXES))]

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        own = [zlib.crc32(word) % BUCKETS]
        own += [zlib.crc32(b"%d " % k + text[:k].encode("utf-8", "replace")) % BUCKETS if len(text) > k else BUCKETS for k in PREFIXES]
        self.buckets.append(own)
        found = self[word] = len(self.buckets) - 1
        return found


def read(texts: list[bytes | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers with a gap after each text, where each text's words begin, and end; without words, one gap)."""
    ids: list[int] = []
    begin, end = [], []
    gap = [0] * _GAP
    for text in texts:
        begin.append(len(ids))
        ids += [words[w] for w in (text or b"").translate(_FOLD).split()]
        end.append(max(len(ids), begin[-1] + 1))
        ids += gap
    return np.array(ids, np.int64), np.array(begin, np.int64), np.array(end, np.int64)


class Net:
    """The network; embeddings' last row stands for gaps and stays zero."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        blocks = sum(WIDTHS)
        self.emb = rng.normal(0, 0.05, (BUCKETS + 1, SIZE)).astype(np.float32)
        self.emb[-1] = 0
        self.w = rng.normal(0, 0.3, (SIZE, blocks * FILTERS)).astype(np.float32)
        self.b = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.v = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def responses(self, parts: np.ndarray) -> list[np.ndarray]:
        """Filter responses at each position, by width, from the projected words."""
        out, block = [], 0
        for width in WIDTHS:
            total = np.array(parts[:, block * FILTERS : (block + 1) * FILTERS])
            for k in range(1, width):
                total[:-k] += parts[k:, (block + k) * FILTERS : (block + k + 1) * FILTERS]
            out.append(total)
            block += width
        return out

    def table(self) -> np.ndarray:
        """Each bucket's projection: all that scoring needs of embeddings and filters."""
        return self.emb @ self.w

    def logits(self, parts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        bounds = np.stack([begin, end], axis=1).ravel()
        top = np.concatenate([np.maximum.reduceat(x, bounds, axis=0)[::2] for x in self.responses(parts)], axis=1)
        return np.maximum(top + self.b, 0).astype(np.float64) @ self.v.astype(np.float64) + float(self.c[0])

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 350, batch: int = 32, rate: float = 0.05, seed: int = 0) -> None:
        """Adagrad on the logistic loss, in whole passes of `steps` batches at least; only the largest responses have gradients."""
        rng = np.random.default_rng(seed)
        known = Words()
        every = [read([t], known)[0] for t in texts]
        buckets = np.array(known.buckets, np.int64)
        size = [max(1, len(x) - _GAP) for x in every]
        params = [self.emb, self.w, self.b, self.v, self.c]
        seen = [np.full(p.shape, 1e-8, np.float32) for p in params]
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        for _ in range(max(5, -(-steps * batch // len(texts)))):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                ids = np.concatenate([every[r] for r in rows])
                begin = np.cumsum([0, *(len(every[r]) for r in rows[:-1])])
                n = np.array([size[r] for r in rows])
                own, of = np.unique(ids, return_inverse=True)
                words = self.emb[buckets[own]].sum(axis=1)
                found = self.responses((words @ self.w)[of])
                best = [np.stack([s + x[s : s + k].argmax(axis=0) for s, k in zip(begin, n, strict=True)]) for x in found]
                top = np.concatenate([np.take_along_axis(x, p, axis=0) for x, p in zip(found, best, strict=True)], axis=1) + self.b
                live = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-(live @ self.v + self.c[0])))
                err = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                back = err[:, None] * self.v * (top > 0)
                gw, ge, where = np.zeros_like(self.w), [], []
                block = 0
                for k, width in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for o in range(width):
                        cols = slice(block * FILTERS, (block + 1) * FILTERS)
                        spot = best[k] + o
                        gw[:, cols] = np.einsum("df,dfe->ef", g, words[of[spot]])
                        ge.append(np.repeat((g[:, :, None] * self.w[:, cols].T[None]).reshape(-1, SIZE), buckets.shape[1], axis=0))
                        where.append(buckets[ids[spot]].ravel())
                        block += 1
                where_all = np.concatenate(where)
                kinds, place = np.unique(where_all, return_inverse=True)
                g_emb = np.zeros((len(kinds), SIZE), np.float32)
                np.add.at(g_emb, place, np.concatenate(ge))
                g_emb[kinds == BUCKETS] = 0
                seen[0][kinds] += g_emb**2
                self.emb[kinds] -= rate * g_emb / np.sqrt(seen[0][kinds])
                for i, g in ((1, gw), (2, back.sum(axis=0)), (3, live.T @ err), (4, err.sum(keepdims=True))):
                    seen[i] += g**2
                    params[i] -= rate * g / np.sqrt(seen[i])


class Model:
    """A fitted network with its language guess and thresholds."""

    def __init__(self, rows: list[tuple[int, bytes, int, str | None]], seed: int = 0):
        """rows: (key, text, label, language or None)."""
        self.languages = sorted({r[3] or "" for r in rows}) or [""]
        counts = np.full((BUCKETS + 1, len(self.languages)), 0.01)
        known = Words()
        for _, text, _, language in rows:
            ids = read([text], known)[0]
            own = [known.buckets[i][0] for i in np.unique(ids)]
            np.add.at(counts[:, self.languages.index(language or "")], own, 1)
        counts[-1] = 1
        self.tongue = (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32)
        self.tongue[-1] = 0
        kept = np.array([zlib.crc32(b"calibrate %d" % r[0]) % 4 == 0 for r in rows], bool)
        label = np.array([r[2] for r in rows], np.float32)
        texts = [r[1] for r in rows]
        self.net = Net(seed)
        self.both = len(rows) > 0 and 0 < label.mean() < 1
        #: Keys of the rows that the network was fitted on.
        self.fitted: list[int] = []
        if self.both:
            use = np.flatnonzero(~kept) if 0 < label[~kept].sum() < (~kept).sum() else np.arange(len(rows))
            self.net.fit([texts[i] for i in use], label[use], seed=seed)
            self.fitted = sorted({rows[i][0] for i in use})
        self.net_table = self.net.table()
        self.threshold = np.full(len(self.languages), 0.5)

    def calibrate(self, hist: np.ndarray, negatives: float) -> None:
        """hist[language, label, bin]: rows by guessed language; a language with less than ENOUGH rows of a class gets the threshold of all."""
        general = best_threshold(hist.sum(axis=0), negatives)
        for k, own in enumerate(hist):
            self.threshold[k] = best_threshold(own, negatives) if (own.sum(axis=1) >= ENOUGH).all() else general

    def raw(self, texts: list[bytes | None], memo: "Memo | None" = None) -> tuple[np.ndarray, np.ndarray]:
        """(probability before calibration, index of the guessed language)."""
        memo = memo or Memo(self)
        ids, begin, end = read(texts, memo.fresh())
        parts, tongue = memo.rows()
        p = 1 / (1 + np.exp(-np.clip(self.net.logits(parts[ids], begin, end), -500, 500)))
        bounds = np.stack([begin, end], axis=1).ravel()
        return p, np.add.reduceat(tongue[ids], bounds, axis=0)[::2].argmax(axis=1)

    def score(self, texts: list[bytes | None], memo: "Memo | None" = None) -> np.ndarray:
        if not self.both:
            return np.zeros(len(texts))
        p, tongue = self.raw(texts, memo)
        t = np.clip(self.threshold[tongue], 1e-6, 1 - 1e-6)
        return np.where(p < t, p / t * CUT, CUT + (p - t) / (1 - t) * (1 - CUT))


class Memo:
    """Projections and language weights of the words met so far, each computed once."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        self.parts = np.zeros((0, model.net_table.shape[1]), np.float32)
        self.tongue = np.zeros((0, model.tongue.shape[1]), np.float32)

    def fresh(self) -> Words:
        if len(self.words) > MEMO:
            self.__init__(self.model)
        return self.words

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        if len(new := self.words.buckets[len(self.parts) :]):
            buckets = np.array(new, np.int64)
            self.parts = np.concatenate([self.parts, self.model.net_table[buckets].sum(axis=1)])
            self.tongue = np.concatenate([self.tongue, self.model.tongue[buckets[:, 0]]])
        return self.parts, self.tongue


def bin_of(p: Column) -> Column:
    """Number of a score's bin, by its logit."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return F.greatest(F.lit(0), F.least(F.lit(2 * FAR * FINE - 1), F.floor((F.log(p / (1 - p)) + FAR) * FINE))).cast("int")


def best_threshold(hist: np.ndarray, negatives: float) -> float:
    """The cut with the best F1 of hist[label, bin] when each row of label 0 counts `negatives` times; halfway to the next lower bin met."""
    met = np.flatnonzero(hist.sum(axis=0))[::-1]
    if not len(met):
        return 0.5
    hit, false = np.cumsum(hist[1, met]), np.cumsum(hist[0, met] * negatives)
    k = int(np.argmax(2 * hit / np.maximum(hit + false + hist[1].sum(), 1e-9)))
    edge = lambda b: 1 / (1 + np.exp(FAR - b / FINE))
    return float((edge(met[k]) + (edge(met[k + 1] + 1) if k + 1 < len(met) else 0.0)) / 2)


def raw_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p, tongue): each row's probability before calibration and the index of its guessed language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the bucket count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        memo = Memo(own)
        for batch in batches:
            found = [own.raw(texts, memo) for texts in portions(batch.column(1))]
            if found:
                p, tongue = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(tongue.astype(np.int32))], ["doc_id", "p", "tongue"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, p double, tongue int")


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled documents that aren't held out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, known: DataFrame, per_class: int = PER_CLASS, seed: int = 0) -> Model:
    """A model from a bounded sample of the labelled rows, not yet calibrated."""
    sample = F.broadcast(bounded_sample(known, "toxic", per_class))  # per_class bounds it
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    held = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"), lang.alias("lang"))
    rows = [(r["doc_id"], bytes(r["text"]), r["toxic"], r["lang"]) for r in held.join(sample, "doc_id").collect()]
    rows.sort(key=lambda r: (r[0], r[1], r[3] or ""))
    return Model(rows, seed)


def calibrated(model: Model, raw: DataFrame, known: DataFrame) -> Model:
    """The model with thresholds from raw_scores() of all labelled rows that it wasn't fitted on.

    Only ids, scores and labels are joined; the histogram's size is fixed by bins and languages.
    """
    if not model.both:
        return model
    spark = raw.sparkSession
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    used = F.broadcast(spark.createDataFrame([(k,) for k in model.fitted], "doc_id long"))  # a part of the sample
    model.fitted = []
    rest = raw.where("doc_id is not null").join(used, "doc_id", "left_anti").join(known, "doc_id")
    hist = np.zeros((len(model.languages), 2, 2 * FAR * FINE), np.int64)
    for r in rest.groupBy("tongue", "toxic", bin_of(F.col("p")).alias("bin")).agg(F.count("*").alias("n")).collect():
        hist[r["tongue"], r["toxic"], r["bin"]] = r["n"]
    seen = hist.sum(axis=(0, 2))
    model.calibrate(hist, (total.get(0, 0) / max(seen[0], 1)) / max(total.get(1, 0) / max(seen[1], 1), 1e-9))
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 0) -> Model:
    """A model from a bounded sample of the labelled rows that aren't held out, with thresholds from all the others."""
    known = known_labels(labels)
    model = fit(docs, known, per_class, seed)
    return calibrated(model, raw_scores(docs, model), known)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of docs.

    Null and empty texts are scored as a text without words. Without labelled rows of both
    classes to learn from every score is 0. Repeated rows get equal scores; a null doc_id is
    scored, and isn't learned from. Other columns are ignored; an empty table gives an empty result.
    """
    known = known_labels(labels)
    model = fit(docs, known, per_class)
    raw = cut(raw_scores(docs, model))  # texts are scored once; what follows needs no text
    model = calibrated(model, raw, known)
    t = F.element_at(F.array(*[F.lit(float(x)) for x in np.clip(model.threshold, 1e-6, 1 - 1e-6)]), F.col("tongue") + 1)
    p = F.col("p")
    score = F.when(p < t, p / t * CUT).otherwise(CUT + (p - t) / (1 - t) * (1 - CUT)) if model.both else F.lit(0.0)
    return raw.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
