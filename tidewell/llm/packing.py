"""Packing token sequences by cutting-stock column generation.

Each document's ids are cut at the capacity; the whole pieces fill sequences of their own and the
rest go into length classes (a fixed number, so all that the solver sees is bounded whatever the
corpus). A linear program chooses how often each cutting pattern is used; an exact knapsack by
dynamic programming prices new patterns until none improves it. Rounded-down patterns take pieces
by their rank in the class; what rounding leaves over is packed best-fit-decreasing on the
histogram. Ranks come from per-partition counters and their running sums, so a class that holds a
third of all pieces is never gathered in one task.
"""

from __future__ import annotations

import gc
import re
import warnings
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WARM, cut, give_back

CAPACITY = 4096
#: Width of a length class, in tokens.
STEP = 16
#: Distinct words whose ids a task remembers; beyond, it forgets all but the first half.
MEMO = 800_000
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+([.,;:!?*#$%&|]*)")


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes; remembers each word's ids.

    Only for tokenizers that split at white space and drop it and end words with `</w>`, as
    word_bpe_49k does: a text's ids are then those of its words (bytes between ASCII white space) put together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = token.endswith("</w>")

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of words, encoded in two calls.

        Latin letters with a run of marks behind, if any, are one or two of the tokenizer's own
        words, whose last ids it marks: such words are put together and told apart by the marks.
        """
        plain, other = [], []
        counts = []
        for word in words:
            if found := _PLAIN.fullmatch(text := word.decode("utf-8", "replace")):
                plain.append((word, text))
                counts.append(2 if found[1] else 1)
            else:
                other.append((word, text))
        if plain:
            found = self.tokenizer.encode_batch_fast([" ".join(text for _, text in plain)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            last = np.flatnonzero(self.last[ids])[np.cumsum(counts) - 1] + 1
            self._keep([w for w, _ in plain], ids, np.append(0, last))
        if other:
            found = self.tokenizer.encode([text for _, text in other], is_pretokenized=True, add_special_tokens=False)
            edges = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(other) + 1))
            self._keep([w for w, _ in other], np.array(found.ids, "<u4"), edges)

    def _keep(self, words: list[bytes], ids: np.ndarray, edges: np.ndarray) -> None:
        data = ids.tobytes()
        for word, a, b in zip(words, (4 * edges).tolist(), (4 * edges[1:]).tolist(), strict=False):
            self.memo[word] = data[a:b]

    def text(self, text: bytes | None) -> bytes:
        words = (text or b"").split()
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            pass
        if len(memo) > MEMO:  # what came first is common, as a rule
            memo = self.memo = dict(islice(memo.items(), MEMO // 2))
        self.learn(list({w for w in words if w not in memo}))
        return b"".join([memo[w] for w in words])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker: what a task has learned serves the next ones."""
    return WordIds(path)


def _forget() -> None:
    if word_ids.cache_info().currsize:
        word_ids.cache_clear()
        gc.collect()
        give_back()


WARM["packing"] = _forget


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, step: int = STEP, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, cls, nth): the cut pieces of each row of docs.

    cls is the piece's length class (0: fills a sequence alone), nth counts the pieces of that class in partition part.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        part = TaskContext.get().partitionId()
        count: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.text(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    cls = 0 if length == capacity else -(-length // step)
                    nth = count.get(cls, 0)
                    count[cls] = nth + 1
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, part, cls, nth))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()], strict=True)], PIECE)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, cls int, nth long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "cls", "nth"]


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes 1..len(values) within the capacity, by dynamic programming: (value, count of each size)."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    sizes = np.arange(1, len(values) + 1)
    for c in range(1, capacity + 1):
        k = min(c, len(values))
        gain = values[:k] + best[c - sizes[:k]]
        j = int(np.argmax(gain))
        best[c], took[c] = (gain[j], j + 1) if gain[j] > best[c - 1] else (best[c - 1], 0)
    count, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if took[c]:
            count[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), count


def solve(demand: np.ndarray, capacity: int, rounds: int = 3000, tolerance: float = 5e-4) -> list[tuple[int, np.ndarray]]:
    """Patterns that cover a histogram exactly: [(times, count of each size)].

    demand[k] pieces have size k + 1. Column generation: the revised simplex method keeps a basis
    of one pattern for each size in demand, and the knapsack prices the next one, until no pattern is
    worth over 1 + tolerance (the plan is then within that factor of the optimum, before rounding).
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    m = len(sizes)
    need = demand[sizes - 1].astype(float)
    # the first basis: each size alone, as often as it fits
    patterns = np.zeros((m, m))
    np.fill_diagonal(patterns, capacity // sizes)
    inverse = np.diag(1.0 / (capacity // sizes))
    amount = inverse @ need
    for turn in range(rounds):
        duals = inverse.sum(axis=0)  # each pattern costs one sequence
        values = np.zeros(capacity)
        values[sizes - 1] = np.maximum(duals, 0)
        value, count = knapsack(values, capacity)
        if value <= 1 + tolerance:
            break
        column = count[sizes - 1].astype(float)
        change = inverse @ column
        rows = np.flatnonzero(change > 1e-9)
        if not len(rows):
            break
        out = rows[np.argmin(amount[rows] / change[rows])]
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
        patterns[:, out] = column
        if turn % 200 == 199:  # rounding errors add up
            inverse = np.linalg.inv(patterns)
        amount = np.maximum(inverse @ need, 0)
    else:
        warnings.warn(f"packing: patterns were still improving after {rounds} rounds", stacklevel=2)
    left = demand.astype(np.int64).copy()
    plan: list[tuple[int, np.ndarray]] = []
    for k in np.argsort(-amount, kind="stable"):
        count = np.zeros(len(demand), np.int64)
        count[sizes - 1] = patterns[:, k].astype(np.int64)
        held = count > 0
        times = int(min(np.floor(amount[k] + 1e-6), (left[held] // count[held]).min()))
        if times > 0:
            plan.append((times, count))
            left -= times * count
    while left.any():  # best fit, decreasing, on the histogram of what rounding left
        count, room = np.zeros(len(demand), np.int64), capacity
        while room > 0 and len(fits := np.flatnonzero(left[:room])):
            size = int(fits[-1]) + 1
            n = int(min(left[size - 1], room // size))
            count[size - 1] += n
            left[size - 1] -= n
            room -= n * size
        times = 1 + int((left[count > 0] // count[count > 0]).min())
        left -= (times - 1) * count
        plan.append((times, count))
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, step: int = STEP, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding): one row for each piece.

    Null text counts as empty: its only id is end_id. A document longer than the capacity is cut
    at its multiples. Repeated rows are packed as often as they occur; a null doc_id stays null.
    padding is what its sequence is filled up with: to the capacity, or nothing if the sequence's
    length is a power of two. An empty table gives an empty result; other columns are ignored.
    """
    if capacity % step:
        raise ValueError("step must divide the capacity")
    cuts = cut(pieces(docs, tokenizer, capacity, step, end_id))
    counted = cut(cuts.groupBy("part", "cls").agg(F.count("*").alias("n")))
    n_classes = capacity // step
    demand = np.zeros(n_classes, np.int64)
    alone = 0
    for r in counted.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # one row for each class: bounded by capacity / step
        if r["cls"] == 0:
            alone = r["n"]
        else:
            demand[r["cls"] - 1] = r["n"]
    starts = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    plan = solve(demand, n_classes)
    # for each class: the first rank each pattern takes, the first of its sequences, and how many it takes for each
    base, takes = alone, {}
    for times, count in plan:
        for k in np.flatnonzero(count):
            first, seq, per, slot = takes.setdefault(int(k) + 1, ([0], [], [], []))
            seq.append(base)
            per.append(int(count[k]))
            slot.append(int(count[k + 1 :].sum()))
            first.append(first[-1] + times * int(count[k]))
        base += times
    takes = {k: tuple(np.array(x, np.int64) for x in v) for k, v in takes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cls", "rank"))
            sequence, slot = rank.copy(), np.zeros_like(rank)
            for k in np.unique(cls[cls > 0]):
                here = cls == k
                first, seq, per, ahead = takes[int(k)]
                p = np.searchsorted(first, rank[here], "right") - 1
                inside = rank[here] - first[p]
                sequence[here] = seq[p] + inside // per[p]
                slot[here] = ahead[p] + inside % per[p]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in PIECE[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(slot)], [*PIECE[:5], "sequence_id", "slot"])

    ranked = cuts.join(starts, ["part", "cls"]).select(*PIECE[:5], "cls", (F.col("nth") + F.col("before")).cast("long").alias("rank"))
    placed = ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    used = F.sum("length").over(Window.partitionBy("sequence_id"))
    padding = F.when(used.bitwiseAND(used - 1) == 0, F.lit(0)).otherwise(F.lit(capacity) - used).cast("long")
    return placed.select(*PIECE[:5], "sequence_id", offset.alias("offset"), padding.alias("padding"))
