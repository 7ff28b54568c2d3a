"""Masked pseudo-likelihood: a bidirectional window network predicts each token from both sides.

Word counts come from the whole corpus. The commonest words have rows of their own, all others share
rows by their endings; rows are put into classes by the words they stand beside. A token's
probability is that of its class given the two words on either side (the network, trained in numpy)
times its word's own count over the counts of the class. A document's score is the sum of its tokens'
log-probabilities.

Texts are read twice, for counts and to be written as numbers of rows. Every window is trained on
once. Documents are dealt into shards by a hash of themselves, so that results depend on the
corpus alone; shards are trained in rounds, each from the mean of the last round's copies, which is
formed in two levels by block of parameters. What is gathered grows with the corpus, what reaches
the driver doesn't. Counts of words without a row of their own never leave the executors: they meet
the documents in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, redeal, release, stash

COMMON, ENDINGS, CLASSES, HIDDEN = 4096, 256, 128, 24
#: Bytes of a word's end that choose its shared row.
ENDING = 3
#: Offsets of the context words.
CONTEXT = (-2, -1, 1, 2)
#: Groups of neighbours that classes are made from: the commonest words one each, all others by ending.
GROUPS, ALONE = 64, 48
#: Rounds of training, and tokens in a shard, about. Beyond MOST_SHARDS shards grow instead.
ROUNDS, SHARD, MOST_SHARDS = 4, 2_000_000, 16_384
#: The largest weight of the last layer: exponents stay in range without a look for the largest.
STEEP = 3.0
_BLOCKS = 16
#: Bytes of text whose words are told apart at a time.
_PIECE = 8_000_000
_PORTION = 200_000


def pieces(column: pa.Array, most: int = _PIECE) -> Iterator[pa.Array]:
    """The texts of a binary column in slices of about `most` bytes; a longer text has a slice of its own."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1] if len(column) else ()
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
        yield column.slice(first, last - first)
        first = last


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lower-cased words of all texts, how many each has), by the rules of bytes.lower() and bytes.split(). No text may be null."""
    # Arrow's functions for ASCII go by bytes, but take strings only
    strings = pa.Array.from_buffers(pa.string(), len(texts), [None, *texts.buffers()[1:]], offset=texts.offset)
    found = pc.ascii_split_whitespace(pc.ascii_lower(strings))
    words = found.flatten().cast(pa.binary())
    kept = pc.greater(pc.binary_length(words), 0)  # where a text begins or ends with a space stands an empty word
    ends = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    return words.filter(kept), np.diff(ends[found.offsets.to_numpy() - found.offsets[0].as_py()])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n): how often each lower-cased (A-Z) word occurs in all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            found = pc.value_counts(split(pa.concat_arrays(held))[0])
            held.clear()
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

        for batch in batches:
            for texts in pieces(batch.column(0)):
                if held and sum(x.nbytes for x in held) + texts.nbytes > _PIECE:
                    yield out()
                held.append(texts)
        if held:
            yield out()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Row of each word. Rows of common words come first, then those of endings; the row after the last stands for no word."""

    def __init__(self, common: list[tuple[bytes, int]], endings: dict[int, int]):
        """common: (word, count), most frequent first. endings: row among the shared ones -> tokens of all other words."""
        super().__init__((w, k) for k, (w, _) in enumerate(common))
        self.common = len(common)
        self.size = self.common + ENDINGS
        self.count = np.zeros(self.size)
        self.count[: self.common] = [n for _, n in common]
        for k, n in endings.items():
            self.count[self.common + k] = n
        ends = np.array([ALONE + _ending(w) % (GROUPS - ALONE) for w, _ in common] + [ALONE + k % (GROUPS - ALONE) for k in range(ENDINGS)], np.int64)
        own = min(ALONE, self.common)
        ends[:own] = np.arange(own)
        self.group = ends
        self._common: pa.Array | None = None
        self.classify(np.zeros((self.size, GROUPS)))

    def classify(self, beside: np.ndarray, rounds: int = 12, seed: int = 0) -> None:
        """Put rows into CLASSES by k-means over the square roots of what they stand beside, weighted by their counts."""
        overall = beside.sum(axis=0) + 1.0
        spread = np.sqrt((beside + 20 * overall / overall.sum()) / (beside.sum(axis=1, keepdims=True) + 20))
        rng = np.random.default_rng(seed)
        weight = self.count + 1e-9
        centre = spread[rng.choice(self.size, 1, p=weight / weight.sum())]
        far = ((spread - centre) ** 2).sum(axis=1)
        while len(centre) < CLASSES:
            odds = far * weight
            new = spread[rng.choice(self.size, 1, p=odds / odds.sum()) if odds.sum() > 0 else [len(centre) % self.size]]
            centre = np.concatenate([centre, new])
            far = np.minimum(far, ((spread - new) ** 2).sum(axis=1))
        for _ in range(rounds):
            self.cls = ((centre**2).sum(axis=1)[None, :] - 2 * spread @ centre.T).argmin(axis=1)
            mass = np.bincount(self.cls, weight, CLASSES)
            total = np.zeros_like(centre)
            np.add.at(total, self.cls, spread * weight[:, None])
            centre[mass > 0] = total[mass > 0] / mass[mass > 0, None]
        self.class_mass = np.bincount(self.cls, self.count, CLASSES)
        #: A word's log share of its class; a word of a shared row adds the logarithm of its own count.
        self.share = -np.log(np.maximum(self.class_mass, 1.0))[self.cls]
        self.share[: self.common] += np.log(self.count[: self.common])

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.common + 300_000:
            for w in list(self)[self.common :]:
                del self[w]
        found = self[word] = self.common + _ending(word)
        return found

    def rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word, unsigned 16-bit; whether it is a shared one), for a binary array without nulls."""
        if self._common is None:
            self._common = pa.array(list(self)[: self.common], pa.binary())
        rows = pc.fill_null(pc.index_in(words, self._common), -1).to_numpy(zero_copy_only=False)
        shared = rows < 0
        out = rows.astype(np.uint16)
        out[shared] = self.common + _endings(words.filter(pa.array(shared)))
        return out, shared

    def __reduce__(self):
        return _vocabulary, (list(self)[: self.common], self.__dict__ | {"_common": None})


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % ENDINGS


#: What zlib.crc32 does with each byte.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> 1) ^ np.where(_CRC & 1, np.uint32(0xEDB88320), np.uint32(0))


def _endings(words: pa.Array) -> np.ndarray:
    """_ending() of each word of a binary array without nulls."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last, length = ends[1:], np.diff(ends)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in range(ENDING, 0, -1):
        step = _CRC.take((crc ^ data.take(np.maximum(last - back, 0))) & 0xFF) ^ (crc >> 8)
        crc = np.where(length >= back, step, crc)
    return ((crc ^ 0xFFFFFFFF) % ENDINGS).astype(np.int64)


def _vocabulary(words: list[bytes], state: dict) -> Vocabulary:
    out = Vocabulary.__new__(Vocabulary)
    dict.__init__(out, ((w, k) for k, w in enumerate(words)))
    out.__dict__.update(state)
    return out


class Network:
    """class of the middle word <- tanh(sum of one vector for each context word). Trained by Adagrad, with one step size a row."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        #: How many windows the parameters were trained on.
        self.windows = 0
        self.table = rng.normal(0, 0.1, (len(CONTEXT), vocabulary.size + 1, HIDDEN)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32)
        self.bias = np.log(np.maximum(vocabulary.class_mass, 0.5) / max(1.0, vocabulary.class_mass.sum())).astype(np.float32)
        self.seen_table = np.full((len(CONTEXT), vocabulary.size + 1), 1e-6, np.float32)
        self.seen_out, self.seen_bias = np.full(self.out.shape, 1e-6, np.float32), np.full(CLASSES, 1e-6, np.float32)

    _PARTS = ("table", "out", "bias", "seen_table", "seen_out", "seen_bias")

    def params(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self._PARTS])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name in self._PARTS:
            own = getattr(self, name)
            setattr(self, name, flat[at : at + own.size].astype(np.float32).reshape(own.shape))
            at += own.size

    def hidden(self, ids: np.ndarray, spots: np.ndarray) -> np.ndarray:
        total = self.table.reshape(-1, HIDDEN).take(self._met(ids, spots), axis=0).sum(axis=0)
        return np.tanh(total, out=total)

    def _met(self, ids: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Rows of the context words of each spot, a line for each offset, as places in the tables of all offsets end to end."""
        wide = self.table.shape[1]
        kind = np.min_scalar_type(len(CONTEXT) * wide)  # 16 bits are sorted by their digits
        return ids.take(spots + np.array(CONTEXT)[:, None]).astype(kind) + np.arange(0, len(CONTEXT) * wide, wide, dtype=kind)[:, None]

    def train(self, ids: np.ndarray, spots: np.ndarray, batch: int = 2048, rate: float = 0.1) -> None:
        """One pass over spots on the class's log-loss.

        The bias is the row of a hidden unit that is always 1, and odds are divided by their sums where
        they have become narrow.
        """
        cls = self.vocabulary.cls
        every = np.arange(batch)
        table, seen = self.table.reshape(-1, HIDDEN), self.seen_table.reshape(-1)
        out, seen_out = np.concatenate([self.out, self.bias[None]]), np.concatenate([self.seen_out, self.seen_bias[None]])
        odds, ones = np.empty((batch, CLASSES), np.float32), np.ones(CLASSES, np.float32)
        units = np.ones((batch, HIDDEN + 1), np.float32)
        for k in range(0, len(spots), batch):
            at = spots[k : k + batch]
            n = len(at)
            met = self._met(ids, at)
            h = table.take(met, axis=0).sum(axis=0)
            np.tanh(h, out=h)
            own = units[:n]
            own[:, :-1] = h
            p = np.matmul(own, out, out=odds[:n])
            np.exp(p, out=p)
            total = p @ ones
            p[every[:n], cls.take(ids.take(at))] -= total
            part = (1 / n / total)[:, None]
            g = (own * part).T @ p
            back = p @ out[:-1].T
            back *= part
            back *= 1 - h * h
            seen_out += g * g
            out -= rate * g / np.sqrt(seen_out)
            np.clip(out[:-1], -STEEP, STEEP, out=out[:-1])
            np.minimum(out[-1], 0, out=out[-1])
            met = met.ravel()
            order = met.argsort(kind="stable")
            rows = met.take(order)
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            rows = rows.take(first)
            pairs = back.view(np.complex64).take(order % n, axis=0)  # two columns are summed at a time: HIDDEN is even
            g = np.add.reduceat(pairs, first, axis=0).view(np.float32)
            acc = seen.take(rows) + np.einsum("ij,ij->i", g, g) / HIDDEN
            seen[rows] = acc
            g *= (rate / np.sqrt(acc))[:, None]
            table[rows] = table.take(rows, axis=0) - g
        self.out, self.bias = out[:-1].copy(), out[-1].copy()
        self.seen_out, self.seen_bias = seen_out[:-1].copy(), seen_out[-1].copy()

    def log_probs(self, ids: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """The log-probability of each token given both sides, but for the logarithm of a rare word's count."""
        p = self.hidden(ids, spots) @ self.out
        p += self.bias
        own = ids.take(spots)
        top = p[np.arange(len(spots)), self.vocabulary.cls.take(own)].astype(np.float64)
        np.exp(p, out=p)
        return top - np.log((p @ np.ones(CLASSES, np.float32)).astype(np.float64)) + self.vocabulary.share.take(own)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """The summed log-probability of each document, given as rows of its words."""
        ids, spots = lay_out(docs, self.vocabulary.size)
        each = np.concatenate([[0.0], *(self.log_probs(ids, spots[k : k + 2048]) for k in range(0, len(spots), 2048))])
        sums, n = np.cumsum(each), np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n]


def lay_out(docs: list[np.ndarray], none: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of all documents with gaps before, between and after them, places of the tokens)."""
    gap = np.full(max(CONTEXT), none, np.uint16)
    ids = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    return ids, np.flatnonzero(ids != none)


def portions(column: pa.Array, most: int = _PORTION) -> Iterator[list[np.ndarray]]:
    """The column's documents in lists of about `most` tokens."""
    own: list[np.ndarray] = []
    size = 0
    for x in column:
        own.append(np.frombuffer(x.as_py(), np.uint16))
        size += len(own[-1])
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The rows of counts (word, n), all still in one class."""
    # a histogram of counts (some hundred rows) gives a threshold: else each partition sends its own top
    step = F.floor(F.log2("n") * 8).cast("int")
    above, least_step = 0, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("kinds")).orderBy(F.desc("step")).collect():
        above, least_step = above + r["kinds"], r["step"]
        if above >= COMMON:
            break
    common = [(bytes(r["word"]), r["n"]) for r in counts.where(step >= least_step).orderBy(F.desc("n"), "word").limit(COMMON).collect()]
    if not common:
        return Vocabulary([], {})
    shared = rare(counts, common[-1]).groupBy((F.crc32(F.substring("word", -ENDING, ENDING)) % ENDINGS).alias("k")).agg(F.sum("n").alias("n")).collect()
    return Vocabulary(common, {r["k"]: r["n"] for r in shared})


def rare(counts: DataFrame, last: tuple[bytes, int]) -> DataFrame:
    """Words without a row of their own; last: the last common word and its count."""
    return counts.where((F.col("n") < last[1]) | ((F.col("n") == last[1]) & (F.col("word") > F.lit(last[0]))))


def encode(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, h, n_tokens, ids, rare): documents as rows of their words (unsigned 16-bit), a hash of each, and its words without a row of their own, with spaces between."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # its size is fixed by the constants above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            first = 0
            for texts in pieces(batch.column(2)):
                found, n = split(texts)
                rows, others = own.rows(found)
                ends = np.concatenate([[0], np.cumsum(n)])
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(rows)])
                ends = np.concatenate([[0], np.cumsum(others)])[ends]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found.filter(pa.array(others)))
                part = batch.slice(first, len(n))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), ids, pc.binary_join(lists, b" ")], ["doc_id", "h", "n_tokens", "ids", "rare"])
                first += len(n)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, h long, n_tokens long, ids binary, rare binary")


def beside(encoded: DataFrame, words: Vocabulary) -> np.ndarray:
    """How often each row stands beside each group of neighbours, at the offsets of the context."""
    shared = encoded.sparkSession.sparkContext.broadcast((words.group, words.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = shared.value
        wide = np.append(group, GROUPS).astype(np.int64)
        total = np.zeros((size + 1) * (GROUPS + 1), np.int64)
        for batch in batches:
            for docs in portions(batch.column(0)):
                ids, _ = lay_out(docs, size)
                near = wide[ids]
                cell = ids.astype(np.int64) * (GROUPS + 1)
                for k in range(1, max(CONTEXT) + 1):
                    total += np.bincount(cell[:-k] + near[k:], minlength=len(total)) + np.bincount(cell[k:] + near[:-k], minlength=len(total))
        total = total.reshape(size + 1, GROUPS + 1)[:size, :GROUPS].ravel()
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], ["k", "n"])

    out = np.zeros(words.size * GROUPS)
    counted = encoded.select("ids").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # rows x groups at most
    out[counted["k"].to_numpy(np.int64)] = counted["n"]
    return out.reshape(words.size, GROUPS)


def learn(encoded: DataFrame, words: Vocabulary, seed: int = 0) -> Network:
    """The network after ROUNDS rounds: each round's shards start from the mean of the last round's, weighted by windows."""
    net = Network(words, seed)
    tokens = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    if not tokens:
        return net
    n = ROUNDS * min(MOST_SHARDS, -(-tokens // (ROUNDS * SHARD)))
    shards = cut(encoded.where("n_tokens > 0").select("h", "ids").repartition(n, "h").sortWithinPartitions("h", "ids").select("ids"))
    lanes = max(1, round((n / ROUNDS) ** 0.5))
    schema = "block int, lane int, shard int, n long, means binary"

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        n = table["n"].to_numpy().astype(np.float64)
        mean = sum(w * np.frombuffer(x.as_py(), np.float32) for w, x in zip(n / n.sum(), table["means"], strict=True))
        return pa.table({"block": table["block"][:1], "lane": table["lane"][:1], "shard": table["shard"][:1], "n": pa.array([int(n.sum())], pa.int64()), "means": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    for turn in range(ROUNDS):
        start = encoded.sparkSession.sparkContext.broadcast(net)  # its size is fixed by the constants above

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            own, windows = None, 0
            for batch in batches:
                for docs in portions(batch.column(0)):
                    if own is None:
                        own = Network(start.value.vocabulary, seed)
                        own.load(start.value.params())
                    ids, spots = lay_out(docs, own.vocabulary.size)
                    own.train(ids, np.random.default_rng([seed, turn, windows]).permutation(spots))
                    windows += len(spots)
            if windows:
                shard = TaskContext.get().partitionId()
                blobs = [x.tobytes() for x in np.array_split(own.params(), _BLOCKS)]
                same = lambda v, t: pa.array([v] * _BLOCKS, t)
                yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), same(shard // ROUNDS % lanes, pa.int32()), same(shard, pa.int32()), same(windows, pa.int64()), pa.array(blobs, pa.binary())], ["block", "lane", "shard", "n", "means"])

        own = shards.where(F.spark_partition_id() % ROUNDS == turn).mapInArrow(run, schema)
        blocks = own.groupBy("block", "lane").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).collect()
        if blocks:
            blocks.sort(key=lambda r: r["block"])
            net.load(np.concatenate([np.frombuffer(r["means"], np.float32) for r in blocks]))
            net.windows += blocks[0]["n"]
        start.unpersist()
        release(encoded.sparkSession)
    return net


def score(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob): one row for each row of docs.

    Null texts count as empty: no tokens, log_prob 0, mean_log_prob null. Repeated rows count as often as they
    occur in the statistics and get equal scores; a null doc_id is kept. Other columns are
    ignored; an empty table gives an empty result. How docs is partitioned doesn't matter.
    """
    docs = docs.select("doc_id", "text")
    counts = stash(word_counts(docs))
    words = vocabulary(counts)
    encoded = stash(encode(docs, words).withColumn("place", F.monotonically_increasing_id()))
    words.classify(beside(encoded, words))
    net = learn(encoded, words, seed)
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            found = [own.score(rows) for rows in portions(batch.column(3))]
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(found))], ["place", "doc_id", "n_tokens", "log_prob"])

    scored = encoded.select("place", "doc_id", "n_tokens", "ids").mapInArrow(run, "place long, doc_id long, n_tokens long, log_prob double")
    if words.common == COMMON:
        last = list(words)[COMMON - 1]
        # a word met once adds nothing: its logarithm is 0
        often = rare(counts, (last, int(words.count[COMMON - 1]))).where("n > 1").select(F.xxhash64("word").alias("key"), F.log("n").alias("log_n"))
        others = F.explode(F.split(F.col("rare").cast("string"), " "))
        met = encoded.where("length(rare) > 0").select("place", others.alias("word")).select("place", F.xxhash64("word").alias("key"))
        added = met.join(redeal(often, "key"), "key").groupBy("place").agg(F.sum("log_n").alias("added"))
        scored = scored.join(redeal(added, "place"), "place", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("added", F.lit(0.0)))
    return scored.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
