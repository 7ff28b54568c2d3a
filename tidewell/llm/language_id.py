"""Language identification by prediction by partial matching (PPM).

One byte context tree for each language, all held together: for each order, sorted n-grams with a
count for each language, and contexts with their totals and numbers of different successors. A
byte costs what method C gives it: escapes from each context that never saw it, then its share
in the first that did, at last eight bits. With frozen statistics this depends on the byte and the
bytes before it up to the longest order, so costs are tabled once by n-gram, and a whole text's
code length is a sum of table entries. N-grams that no tree has seen go down the trees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bounded_sample, cool, held_out

#: Longest context, in bytes; a key of one more byte fits in 63 bits up to 6.
ORDER = 4
#: Documents learned from, for each language, about; this bounds the model.
PER_LANGUAGE = 250
_SLICE = 1 << 20
_LATIN = re.compile(rb"[A-Za-z]")


def _grams(data: np.ndarray, first: int, last: int, size: int) -> np.ndarray:
    """The integer keys of the `size` bytes that end at first..last-1."""
    key = np.zeros(last - first, np.int64)
    for back in range(size - 1, -1, -1):
        key <<= 8
        key |= data[first - back : last - back]
    return key


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in the sorted keys; len(keys) where absent."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = len(keys) - 1 if len(keys) else 0
    return np.where(keys[at] == wanted, at, len(keys)) if len(keys) else at


class Trees:
    """The frozen context trees of all languages."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.order, self.languages = order, sorted(texts)
        if not texts:
            return
        found = []
        for language in self.languages:
            data, inside = join(texts[language], order)
            own = []
            for k in range(order + 1):
                keys = _grams(data, order, len(data), k + 1)[inside[order:]]
                own.append(np.unique(keys, return_counts=True))
            found.append(own)
        self.nodes = []
        for k in range(order + 1):
            keys = np.unique(np.concatenate([own[k][0] for own in found]))
            counts = np.zeros((len(keys) + 1, len(self.languages)))
            for n, own in enumerate(found):
                counts[np.searchsorted(keys, own[k][0]), n] = own[k][1]
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total = np.zeros((len(contexts) + 1, len(self.languages)))
            kinds = np.zeros_like(total)
            np.add.at(total, of, counts[:-1])
            np.add.at(kinds, of, (counts[:-1] > 0).astype(float))
            self.nodes.append((keys, counts, contexts, total, kinds))
        self._table()

    def walk(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each (order + 1)-gram's last byte after the others, for each language."""
        cost = np.zeros((len(grams), len(self.languages)))
        open_ = np.ones(cost.shape, bool)
        for k in range(self.order, -1, -1):
            keys, counts, contexts, total, kinds = self.nodes[k]
            own = grams & ((1 << 8 * (k + 1)) - 1)
            at, above = _find(keys, own), _find(contexts, own >> 8)
            n, q, c = total[above], kinds[above], counts[at]
            seen = open_ & (n > 0)
            hit = seen & (c > 0)
            miss = seen & (c == 0)
            cost[hit] += np.log2((n + q)[hit] / c[hit])
            cost[miss] += np.log2((n + q)[miss] / q[miss])
            open_ &= ~hit
        cost[open_] += 8
        return cost

    def _table(self) -> None:
        """An open-addressed hash table of the longest n-grams' costs."""
        keys = self.nodes[self.order][0]
        self.cost = self.walk(keys).astype(np.float32)
        self.shift = 64 - max(10, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << (64 - self.shift), -1, np.int64)
        self.entry = np.zeros(len(self.slots), np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.slots[at[won]], self.entry[at[won]] = keys[left[won]], left[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def costs(self, grams: np.ndarray) -> np.ndarray:
        at = self._slot(grams)
        held = self.slots[at]
        out = self.cost[self.entry[at]] if len(self.cost) else np.zeros((len(grams), len(self.languages)), np.float32)
        wrong = np.flatnonzero(held != grams)
        at, held = at[wrong], held[wrong]
        missing = []
        while len(wrong):
            absent = held < 0
            missing.append(wrong[absent])
            wrong, at = wrong[~absent], (at[~absent] + 1) & (len(self.slots) - 1)
            held = self.slots[at]
            right = held == grams[wrong]
            out[wrong[right]] = self.cost[self.entry[at[right]]]
            wrong, at, held = wrong[~right], at[~right], held[~right]
        if missing and len(rest := np.concatenate(missing)):
            kinds, back = np.unique(grams[rest], return_inverse=True)
            out[rest] = self.walk(kinds)[back]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each whole text, for each language."""
        data, _ = join(texts, self.order)
        size = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(size + self.order) - size
        total = np.zeros((len(texts), len(self.languages)))
        for first in range(self.order, len(data), _SLICE):
            last = min(len(data), first + _SLICE)
            run = np.zeros((last - first + 1, len(self.languages)))
            np.cumsum(self.costs(_grams(data, first, last, self.order + 1)), axis=0, dtype=np.float64, out=run[1:])
            a, b = np.clip(start, first, last) - first, np.clip(start + size, first, last) - first
            total += run[b] - run[a]
        return total

    def judge(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, its posterior, its bits a byte) of each text."""
        given = [t or b"" for t in texts]
        if not self.languages:
            return ["und"] * len(given), np.zeros(len(given)), np.zeros(len(given))
        bits = self.bits(given)
        best = bits.argmin(axis=1) if len(given) else np.zeros(0, np.int64)
        least = bits.min(axis=1) if len(given) else np.zeros(0)
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        lettered = np.array([has_letter(t) for t in given], bool)
        rate = least / np.maximum([len(t) for t in given], 1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)], np.where(lettered, share, 0.0), rate


def join(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with `order` zero bytes before each, and which bytes are theirs."""
    gap = bytes(order)
    data = np.frombuffer(b"".join(x for t in texts for x in (gap, t)), np.uint8)
    inside = np.ones(len(data), bool)
    at = 0
    for t in texts:
        inside[at : at + order] = False
        at += order + len(t)
    return data, inside


def has_letter(text: bytes) -> bool:
    return bool(_LATIN.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER) -> Trees:
    """Trees from a bounded sample of the labelled rows that aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    texts: dict[str, list[bytes]] = {}
    for row in bounded_sample(known, "lang", per_language).select("lang", F.col("text").cast("binary").alias("text")).collect():
        texts.setdefault(row["lang"], []).append(bytes(row["text"]))
    return Trees(texts, order)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte): one row for each row of docs.

    score is the posterior of lang_pred under equal priors. Null texts and texts without a letter
    are `und` with score 0; so is everything if no row has a label to learn from. Ties go to the
    first language in order of names. Repeated rows are judged alike; a null doc_id is kept, and
    isn't learned from. Other columns are ignored; an empty table gives an empty result.
    """
    return judged(docs.select("doc_id", "text"), learn(docs, per_language, order)).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def judged(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs (doc_id, text) as (doc_id, lang_pred, score, bits_per_byte)."""
    model = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample that it comes from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        own = model.value
        for batch in batches:
            names: list[str] = []
            shares, rates = [], []
            for texts in portions(batch.column(1)):
                name, share, rate = own.judge(texts)
                names += name
                shares.append(share)
                rates.append(rate)
            if names:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(np.concatenate(shares)), pa.array(np.concatenate(rates))], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def portions(column: pa.Array, most: int = _SLICE) -> Iterator[list[bytes | None]]:
    """The column's values in lists of about `most` bytes."""
    own: list[bytes | None] = []
    size = 0
    for x in column:
        own.append(text := x.as_py())
        size += len(text or b"")
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose language is found; others (no text, or no letter in it) go."""
    trees = learn(docs, **options)
    model = docs.sparkSession.sparkContext.broadcast(trees)
    text = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        own = model.value
        for batch in batches:
            names: list[str] = []
            for texts in portions(batch.column(text).cast(pa.binary())):
                names += own.judge(texts)[0]
            yield batch.filter(pa.array([n != "und" for n in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
