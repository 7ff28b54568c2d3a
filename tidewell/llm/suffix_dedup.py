"""Repeated passages: difference-cover suffix sorting over the parts of a corpus that can repeat.

A suffix array of every byte would shuffle each of them many times. What follows sorts only what
sorting must decide:

1. Texts are packed into chunks. Each window of `size` bytes is named by its smallest k-byte
   hash (its anchor); equal windows have equal anchors, wherever they stand. Consecutive windows
   of one anchor form a block. Chunks send the names of their distinct blocks to buckets, a few
   bytes for some eighty positions, and get back whether the anchor is alone: then none of its windows
   repeats elsewhere. This is a filter only; it decides nothing that repeats.
2. Blocks whose anchor isn't alone travel, once a chunk, with their bytes to buckets by anchor. A
   bucket sorts their suffixes with the difference-cover algorithm: sampled triples are sorted and
   named, names are sorted recursively, the remaining suffixes are merged in, and adjacent
   suffixes are compared over `size` bytes. The recursion stops where its order covers `size` bytes.
   Where only copies of one block have an anchor, comparing whole blocks does.
   Of a block that is the same in very many chunks, some chunks are witnesses and send it; the others
   take part by its name, so that no bucket grows with a passage's frequency. Blocks of an anchor with
   very many different blocks go as single windows, dealt by their own hash, for the same reason.
3. Chunks mark the windows that repeat and cut their union out. What a chunk holds twice it compares itself.

Names are 96 bits of XXH3 of a block's bytes; they only stand for bytes beyond the witnesses. Where a chunk takes two of its own pieces for equal, it compares their bytes,
and a collision of names is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import cool, cut, give_back, release, stash

SIZE = 200
ANCHOR = 40
CHUNK = 1 << 19
#: Names that a bucket gets, and bytes that are sorted at once, about.
BUCKET_NAMES = 1_000_000
PART_BYTES = 1 << 18
#: Buckets of bytes: at least so many; each has up to FAN parts, which are sorted one by one. Chunks send a row to
#: each bucket, not to each part: rows of chunk and part would grow with the square of the input.
BUCKETS = 96
FAN = 128
#: Different blocks of one anchor above which they are dealt as windows.
HOT = 2000
#: Chunks that send a block's bytes, of those that have the same block.
WITNESSES = 64
KEPT_POWERS = CHUNK + (1 << 16)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_NAME = np.dtype([("b1", "<u8"), ("b2", "<u4"), ("rest", "<u4")])
_POS = np.uint64(0xFFFFFFFF)
COVERED, COMPARE, MANY, SOLO = 1, 2, 4, 8


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers of base; those of a usual chunk's length are kept."""
    return _kept_powers(base) if n <= KEPT_POWERS else _make_powers(base, n)


def _make_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


@lru_cache(2)
def _kept_powers(base: int) -> np.ndarray:
    return _make_powers(base, KEPT_POWERS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """Polynomial hashes, modulo 2^64 over random byte values, of any pieces of one buffer."""

    VALUES = np.random.default_rng(100).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = self.VALUES[data]
        values *= _powers(_ODD, len(data))[: len(data)]
        np.cumsum(values, out=self.sums[1:])
        self.back = _powers(_INVERSE, len(data) + 1)[: len(data) + 1]

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.back[first])

    def every(self, size: int) -> np.ndarray:
        """The hashes of all pieces of one size, by their start."""
        out = self.sums[size:] - self.sums[:-size]
        out *= self.back[: len(out)]
        return mix(out)


class Chunk:
    """One chunk's texts with their blocks; computed alike whenever it is read."""

    def __init__(self, data: bytes, sizes: np.ndarray, size: int, anchor: int):
        self.data = np.frombuffer(data, np.uint8)
        self.size, self.anchor = size, anchor
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.sizes = sizes
        self.hasher = Hasher(self.data)
        self._blocks()

    def _blocks(self) -> None:
        """lo, hi: each block's first and last window; at: its anchor."""
        n, width = len(self.data), self.size - self.anchor + 1
        self.lo = self.hi = self.at = np.zeros(0, np.int64)
        self.unique = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        self.of = self.first = np.zeros(0, np.int64)
        self.many = np.zeros(0, bool)
        if n < self.size:
            return
        short = self.hasher.every(self.anchor)
        least = short & ~_POS
        least |= np.arange(len(least), dtype=np.uint64)
        wide = 1
        while 2 * wide <= width:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        windows = n - self.size + 1
        least = np.minimum(least[:windows], least[width - wide : width - wide + windows])
        head = np.ones(windows, bool)
        np.not_equal(least[1:], least[:-1], out=head[1:])
        edges = np.concatenate([self.starts, np.maximum(self.ends - self.size + 1, self.starts)])
        head[edges[edges < windows]] = True
        lo = np.flatnonzero(head)
        hi = np.append(lo[1:], windows) - 1
        fits = hi <= self.ends[np.searchsorted(self.ends, lo, side="right")] - self.size
        if not fits.any():
            return
        self.lo, self.hi = lo[fits], hi[fits]
        self.at = (least[self.lo] & _POS).astype(np.int64)
        b1, b2 = self._names()
        a = mix(short[self.at])  # anchors are minima: mixed again, they spread over all buckets
        order = np.lexsort((b2, b1, a))
        a, b1, b2 = a[order], b1[order], b2[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
        heads = np.flatnonzero(fresh)
        self.of = np.empty(len(a), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        self.unique = (a[heads], b1[heads], b2[heads])
        self.first = order[heads]  # one block of each kind
        self.many = np.diff(np.append(heads, len(a))) > 1

    def _names(self) -> tuple[np.ndarray, np.ndarray]:
        """Each block's name, in two parts; it follows from the bytes alone, as the anchor's place does."""
        text, of = self.data.tobytes(), xxhash.xxh3_128_digest
        names = np.frombuffer(b"".join([of(text[a:b]) for a, b in zip(self.lo.tolist(), (self.hi + self.size).tolist(), strict=True)]), _NAME)
        return names["b1"].copy(), names["b2"].copy()

    def buckets(self, n: int) -> np.ndarray:
        """The bucket of each distinct block, by anchor; ascending, as anchors are."""
        return (self.unique[0] >> np.uint64(32)).astype(np.int64) * n >> 32

    @cached_property
    def hot_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, name) of one window of each kind among blocks marked MANY."""
        blocks = self.first[(self.codes & (COMPARE | MANY)) == (COMPARE | MANY)]
        starts = _ranges(self.lo[blocks], self.hi[blocks])
        names, first, of = np.unique(self.hasher.of(starts, starts + self.size), return_index=True, return_inverse=True)
        self.same(starts, starts[first][of], np.full(len(starts), self.size))
        return starts[first], names

    def same(self, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> None:
        """Compare pieces that names take for equal, byte by byte."""
        apart = np.flatnonzero(one != two)
        text = self.data.tobytes()
        for a, b, n in zip(one[apart].tolist(), two[apart].tolist(), sizes[apart].tolist(), strict=True):
            if text[a : a + n] != text[b : b + n]:
                raise RuntimeError("two different pieces have one name; change the seeds of Hasher")

    def twice(self) -> np.ndarray:
        """Which blocks the chunk holds more than once, checked by their bytes."""
        blocks = np.flatnonzero(self.many[self.of])
        head = self.first[self.of[blocks]]
        self.same(self.lo[blocks], self.lo[head], self.hi[blocks] + self.size - self.lo[blocks])
        return blocks

    def sent(self) -> np.ndarray:
        """Distinct blocks that go to a bucket as they are."""
        return np.flatnonzero((self.codes & (COMPARE | MANY)) == COMPARE)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the closed ranges, one range after another."""
    n = hi - lo + 1
    if not len(n):
        return np.zeros(0, np.int64)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


# --- the difference-cover sort of one bucket ---------------------------------------------------


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys that order like (a, b)."""
    top_a, top_b = int(a.max(initial=0)) + 1, int(b.max(initial=0)) + 1
    if top_a * top_b >= 1 << 62:
        a = np.unique(a, return_inverse=True)[1]
    return a.astype(np.int64) * top_b + b


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s (integers > 0, or 0 for an end mark) in the order of their first `depth` symbols at least.

    The cover of {0, 1, 2} is {1, 2}: positions of these residues are the sample.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    s = np.append(s.astype(np.int64) + 1, [0, 0, 0, 0])  # zeros end the text, and the sample's first half with a triple of its own
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)
    sample = np.concatenate([one, two])
    triples = _pair(_pair(s[sample], s[sample + 1]), s[sample + 2])
    kinds, names = np.unique(triples, return_inverse=True)
    if len(kinds) < len(sample) and depth > 3:
        ranked = suffix_order(names, depth // 3 + 1)
        place = np.empty(len(sample), np.int64)
        place[ranked] = np.arange(1, len(sample) + 1)
    else:
        ranked = np.argsort(names, kind="stable")
        place = names.astype(np.int64) + 1
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = place
    sampled = sample[ranked]
    sampled = sampled[sampled < n]
    half = sampled % 3
    first, second = sampled[half == 1], sampled[half == 2]
    zero = np.concatenate([[n - 1] if n % 3 == 1 else [], first - 1]).astype(np.int64)  # by what follows their first symbol
    heads = s[zero]
    if heads.max() < 1 << 16:
        heads = heads.astype(np.uint16)  # sorted by digits
    zero = zero[np.argsort(heads, kind="stable")]
    keys = _pair(np.concatenate([s[zero], s[first]]), np.concatenate([rank[zero + 1], rank[first + 1]]))
    before = np.searchsorted(np.maximum.accumulate(keys[len(zero) :]), keys[: len(zero)]) if len(first) else np.zeros(len(zero), np.int64)
    if len(second):
        both = np.concatenate([zero, second])
        keys = _pair(_pair(s[both], s[both + 1]), rank[both + 2])
        before = before + np.searchsorted(np.maximum.accumulate(keys[len(zero) :]), keys[: len(zero)])
    before = np.maximum.accumulate(before)  # beyond `depth` the two orders may differ
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    spots = np.arange(len(zero)) + before
    out[spots] = zero
    taken[spots] = True
    out[~taken] = sampled
    return out


def repeated(strings: list[bytes], size: int) -> np.ndarray:
    """For each window of each string, in order: does it occur at another place in these strings?"""
    lengths = np.array([len(x) for x in strings], np.int64)
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = data.astype(np.int64) + 1
    symbols[starts + lengths] = 0
    windows = _ranges(starts, starts + lengths - size)
    order = suffix_order(symbols, size)
    is_window = np.zeros(len(data), bool)
    is_window[windows] = True
    order = order[is_window[order]]
    width = min(8, size)
    words = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    low = np.uint64((1 << 8 * width) - 1)
    same = np.arange(1, len(order))
    for k in dict.fromkeys([0, size - 8, size // 2, *range(8, size - 8, 8)] if size >= 16 else [0]):
        same = same[(words[order[same - 1] + k] ^ words[order[same] + k]) & low == 0]
        if not len(same):
            break
    hit = np.zeros(len(data), bool)
    hit[order[same]] = True
    hit[order[same - 1]] = True
    return hit[windows]


# --- the distributed steps ---------------------------------------------------------------------


def _pack(docs: DataFrame, chunk: int) -> DataFrame:
    """(chunk, rest, sizes, data): rows of docs put together; rest holds their other columns."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rest", T.ArrayType(T.StructType(others))), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        part, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            text = batch.column(len(names))
            sizes = np.array([len(x.as_py() or b"") for x in text], np.int64)
            row = 0
            while row < len(sizes):
                last = row + max(1, int(np.searchsorted(np.cumsum(sizes[row:]), chunk)))
                data = b"".join([x.as_py() or b"" for x in text[row:last]])
                rest = pa.StructArray.from_arrays([c[row:last] for c in batch.columns[: len(names)]], names)
                offsets = pa.array([0, len(rest)], pa.int32())
                packed = pa.compress(data, "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | turn]), pa.ListArray.from_arrays(offsets, rest), pa.array([sizes[row:last]], pa.list_(pa.int64())), pa.array([packed], pa.binary())], ["chunk", "rest", "sizes", "data"])
                row, turn = last, turn + 1

    return docs.select(*names, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, first: int = 0) -> Iterator[tuple]:
    """The rows' values from column `first` on, one row at a time."""
    for row in range(batch.num_rows):
        yield tuple(c[row].as_py() for c in batch.columns[first:])
    give_back()


def _open(sizes, data, size: int, anchor: int) -> Chunk:
    sizes = np.array(sizes, np.int64)
    return Chunk(pa.decompress(data, int(sizes.sum()), "zstd", asbytes=True) if sizes.sum() else b"", sizes, size, anchor)


_NAMES = np.dtype([("a", "<u8"), ("b1", "<u8"), ("b2", "<u4"), ("many", "u1")])


def _send_names(chunks: DataFrame, n: int, size: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        for batch in batches:
            for chunk, sizes, data in _rows(batch):
                own = _open(sizes, data, size, anchor)
                rows = np.empty(len(own.many), _NAMES)
                rows["a"], rows["b1"], rows["b2"], rows["many"] = *own.unique, own.many
                bucket = own.buckets(n)
                edges = np.searchsorted(bucket, np.arange(n + 1))
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), chunk)), pa.array([rows[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary())], ["bucket", "chunk", "names"])

    return chunks.select("chunk", "sizes", "data").mapInArrow(run, "bucket long, chunk long, names binary")


def judge_names(rows: np.ndarray, hot: int, witnesses: int = WITNESSES) -> np.ndarray:
    """A code for each (distinct in its chunk) block name of one bucket; rows come in the order of chunks.

    COMPARE: send the bytes. MANY as well: as single windows. SOLO as well: no other block has the anchor, so that only
    whole blocks have to be compared. COVERED: enough other chunks send the same block.
    """
    codes = np.zeros(len(rows), np.uint8)
    if not len(rows):
        return codes
    order = np.lexsort((rows["b2"], rows["b1"], rows["a"]))
    s = rows[order]
    anchor = np.ones(len(s), bool)
    anchor[1:] = s["a"][1:] != s["a"][:-1]
    kind = anchor.copy()
    kind[1:] |= (s["b1"][1:] != s["b1"][:-1]) | (s["b2"][1:] != s["b2"][:-1])
    of_kind, heads = np.cumsum(kind) - 1, np.flatnonzero(kind)
    rank = np.arange(len(s)) - heads[of_kind]
    of_anchor = (np.cumsum(anchor) - 1)[heads]
    kinds = np.bincount(of_anchor)[of_anchor]
    met = (np.bincount(of_kind) > 1) | (kinds > 1)
    many = met & (kinds > hot)
    code = (np.where(met, COMPARE, 0) | np.where(many, MANY, 0) | np.where(met & ~many & (kinds == 1), SOLO, 0))[of_kind]
    code[(rank >= max(2, witnesses)) & ~many[of_kind]] = COVERED
    codes[order] = code
    return codes


def _exchange(sent: DataFrame, value: str, answer) -> DataFrame:
    """One task a bucket: answer(list of its values) gives bytes for each row, which go back as (chunk, bucket, reply)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            order = np.argsort(table["chunk"].to_numpy(), kind="stable")
            table = table.take(pa.array(order)).combine_chunks()
            replies = answer([x.as_py() for x in table[value]])
            give_back()
            yield pa.RecordBatch.from_arrays([table["chunk"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(replies, pa.binary())], ["chunk", "bucket", "reply"])

    return sent.groupBy("bucket").applyInArrow(lambda t: pa.Table.from_batches(list(run(iter(t.to_batches()))), _REPLY), "chunk long, bucket long, reply binary")


_REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("reply", pa.binary())])


def _answer_names(values: list[bytes], hot: int, witnesses: int) -> list[bytes]:
    rows = [np.frombuffer(v, _NAMES) for v in values]
    codes = judge_names(np.concatenate(rows), hot, witnesses)
    return [c.tobytes() for c in np.split(codes, np.cumsum([len(r) for r in rows])[:-1])]


def _answer_blocks(values: list[bytes], size: int) -> list[bytes]:
    known: dict[bytes, int] = {}
    which: list[int] = []
    sort: list[int] = []
    counts = []
    for v in values:
        n, total = np.frombuffer(v[:16], np.int64)
        lengths = np.frombuffer(v[16 : 16 + 4 * n], np.uint32).astype(np.int64)
        parts = np.where(lengths >> 31 > 0, -1, np.frombuffer(v[16 + 4 * n : 16 + 5 * n], np.uint8).astype(np.int64))
        lengths &= (1 << 31) - 1
        data = pa.decompress(v[16 + 5 * n :], int(total), "zstd", asbytes=True)
        for e, k, part in zip(np.cumsum(lengths).tolist(), lengths.tolist(), parts.tolist(), strict=True):
            which.append(found := known.setdefault(data[e - k : e], len(known)))
            if found == len(sort):
                sort.append(part)
        counts.append(int((lengths - size + 1).sum()))
    # what several chunks sent alike is sorted once; all of its windows repeat
    strings = list(known)
    windows = np.array([len(x) - size + 1 for x in strings], np.int64)
    first = np.cumsum(windows) - windows
    hit = np.zeros(int(windows.sum()), bool)
    part = np.array(sort, np.int64)
    for p in np.unique(part[part >= 0]):
        chosen = np.flatnonzero(part == p)
        hit[_ranges(first[chosen], first[chosen] + windows[chosen] - 1)] = repeated([strings[i] for i in chosen.tolist()], size)
    again = np.bincount(which, minlength=len(strings)) > 1
    hit |= np.repeat(again, windows)
    own = np.array(which, np.int64)
    flags = hit[_ranges(first[own], first[own] + windows[own] - 1)]
    return [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(counts)[:-1])]


def _blob(pieces: list[bytes], solo: np.ndarray, part: np.ndarray) -> bytes:
    """The pieces with their lengths, whose highest bit marks those that need no sorting, and their parts of the bucket."""
    data = b"".join(pieces)
    lengths = np.array([len(p) for p in pieces], np.uint32) | (solo.astype(np.uint32) << np.uint32(31))
    return np.array([len(pieces), len(data)], np.int64).tobytes() + lengths.tobytes() + part.astype(np.uint8).tobytes() + pa.compress(data, "zstd", asbytes=True)


def _with_replies(chunks: DataFrame, *replies: DataFrame) -> DataFrame:
    """chunks with r0, r1, ...: each chunk's replies, by bucket."""
    for k, r in enumerate(replies):
        own = r.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias(f"r{k}"))
        chunks = chunks.join(own, "chunk", "left")
    return chunks


def _take_codes(own: Chunk, replies) -> None:
    found = b"".join(r["reply"] for r in replies or [])
    own.codes = np.frombuffer(found, np.uint8)
    if len(own.codes) != len(own.many):
        raise RuntimeError("a chunk's names and replies differ")


class Layout:
    """What a chunk sends in step 2, in the order of sending: by bucket and its part, blocks before single windows."""

    def __init__(self, own: Chunk, n: int, fan: int):
        sent = own.sent()
        hot, names = own.hot_windows
        blocks = own.first[sent]
        part = np.concatenate([own.buckets(n * fan)[sent], (names >> np.uint64(32)).astype(np.int64) * (n * fan) >> 32])
        order = np.argsort(part, kind="stable")
        self.bucket, self.part = part[order] // fan, part[order] % fan
        self.lo, self.hi = np.concatenate([own.lo[blocks], hot])[order], np.concatenate([own.hi[blocks], hot])[order]
        self.solo = np.concatenate([(own.codes[sent] & SOLO) > 0, np.zeros(len(hot), bool)])[order]
        self.single = np.concatenate([np.full(len(sent), -1), np.arange(len(hot))])[order]
        self.edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=n))
        self.full = self.bucket[self.edges[:-1]]

    def flags(self, replies) -> np.ndarray:
        """The buckets' answers, one for each window sent."""
        if [r["bucket"] for r in replies or []] != self.full.tolist():
            raise RuntimeError("a chunk's blocks and replies differ")
        if not len(self.full):
            return np.zeros(0, bool)
        counts = np.add.reduceat(self.hi - self.lo + 1, self.edges[:-1])
        octets = -(-counts // 8)
        first = 8 * (np.cumsum(octets) - octets)
        bits = np.unpackbits(np.frombuffer(b"".join(r["reply"] for r in replies), np.uint8))
        return bits[_ranges(first, first + counts - 1)] > 0


def _send_blocks(joined: DataFrame, n: int, fan: int, size: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        for batch in batches:
            for chunk, sizes, data, replies in _rows(batch):
                own = _open(sizes, data, size, anchor)
                _take_codes(own, replies)
                text, sent = own.data.tobytes(), Layout(own, n, fan)
                pieces = [text[a:b] for a, b in zip(sent.lo.tolist(), (sent.hi + size).tolist(), strict=True)]
                blobs = [_blob(pieces[a:b], sent.solo[a:b], sent.part[a:b]) for a, b in pairwise(sent.edges.tolist())]
                if blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(sent.full), pa.array(np.full(len(blobs), chunk)), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blocks"])

    return joined.select("chunk", "sizes", "data", "r0").mapInArrow(run, "bucket long, chunk long, blocks binary")


def _marked(own: Chunk, replies, n: int, fan: int, size: int) -> np.ndarray:
    """Which bytes of the chunk repeated windows cover."""
    step = np.zeros(len(own.data) + 1, np.int32)

    def cover(lo: np.ndarray, hi: np.ndarray) -> None:
        """Each of lo, and each of hi, is given once."""
        step[lo] += 1
        step[hi + size] -= 1

    whole = (own.codes & COVERED)[own.of] > 0
    cover(own.lo[whole], own.hi[whole])
    twice = own.twice()
    cover(own.lo[twice], own.hi[twice])
    sent = Layout(own, n, fan)
    flags = sent.flags(replies)
    hit = _ranges(sent.lo, sent.hi)[flags]
    cover(hit, hit)
    # windows dealt singly stand for all windows of their name
    hot, names = own.hot_windows
    if len(hot):
        windows = sent.hi - sent.lo + 1
        place = np.cumsum(windows) - windows
        single = np.flatnonzero(sent.single >= 0)
        flagged = np.zeros(len(hot), bool)
        flagged[sent.single[single]] = flags[place[single]]
        blocks = np.flatnonzero((own.codes[own.of] & (COMPARE | MANY)) == (COMPARE | MANY))
        starts = _ranges(own.lo[blocks], own.hi[blocks])
        own_names = own.hasher.of(starts, starts + size)
        spot = np.searchsorted(names, own_names)
        times = np.bincount(spot, minlength=len(names))
        hit = starts[(flagged | (times > 1))[spot]]
        cover(hit, hit)
    return np.cumsum(step[:-1]) > 0


def layout_of(total: int) -> tuple[int, int]:
    """(buckets, parts of each) for a corpus of `total` bytes."""
    parts = max(BUCKETS, -(-total * 2 // 3 // PART_BYTES))
    fan = min(FAN, parts // BUCKETS)
    return -(-parts // fan), fan


def strip_repeats(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, chunk: int = CHUNK, hot: int = HOT, witnesses: int = WITNESSES, characters: bool = False) -> DataFrame:
    """docs with `kept` (binary, in place of text), n_bytes, n_removed, spans (array of start, end: the removed runs).

    Each byte covered by a `size`-byte string that also starts anywhere else, in this or another
    row, is removed; matches never cross rows, and overlapping occurrences count. Null texts
    count as empty: nothing to remove. Repeated rows remove each other if they are long enough. Other
    columns pass through untouched; those named like the new ones are replaced. An empty table
    gives an empty result. With `characters`, `kept` also lacks what cuts leave of broken characters.
    """
    new = ["kept", "n_bytes", "n_removed", "spans"]
    docs = docs.drop(*[c for c in docs.columns if c in new])
    spark = docs.sparkSession
    chunks = stash(_pack(docs, chunk))
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    n_names = max(64, -(-total * 2 // (size - anchor) // BUCKET_NAMES))
    codes = cut(_exchange(_send_names(chunks, n_names, size, anchor), "names", lambda v: _answer_names(v, hot, witnesses)))
    release(spark)
    n_blocks, fan = layout_of(total)
    hits = cut(_exchange(_send_blocks(_with_replies(chunks, codes), n_blocks, fan, size, anchor), "blocks", lambda v: _answer_blocks(v, size)))
    release(spark)
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*others, T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        for batch in batches:
            rests = batch.column(0)
            for row, (sizes, data, r0, r1) in enumerate(_rows(batch, 1)):
                own = _open(sizes, data, size, anchor)
                _take_codes(own, r0)
                mark = _marked(own, r1, n_blocks, fan, size)
                kept, removed, spans = [], [], []
                for a, b in zip(own.starts, own.ends, strict=True):
                    m = mark[a:b]
                    if not m.any():
                        kept.append(own.data[a:b].tobytes())
                        removed.append(0)
                        spans.append([])
                        continue
                    removed.append(int(m.sum()))
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]])))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                    text, edges = own.data[a:b].tobytes(), [0, *turn.tolist(), len(m)]
                    pieces = [text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]
                    kept.append(b"".join(p.decode("utf-8", "ignore").encode() if characters else p for p in pieces))
                rest = rests[row].values
                parts = [pa.array(kept, pa.binary()), pa.array(own.sizes), pa.array(removed, pa.int64()), pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays([*(rest.field(k) for k in range(len(others))), *parts], [*(f.name for f in others), *new])

    return _with_replies(chunks, codes, hits).select("rest", "sizes", "data", "r0", "r1").mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row for each row of docs."""
    cleaned = strip_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated bytes cut out of text (what a cut leaves of a character goes too) and n_chars brought up to date.

    Every row stays, with null texts null and its other columns as they are. Repeated rows, if long enough, remove
    each other's text; empty texts stay empty, and an empty table gives an empty result.
    """
    given = next(f"given{k}" for k in range(len(docs.columns) + 1) if f"given{k}" not in docs.columns)
    clash = [c for c in docs.columns if c in ("kept", "n_bytes", "n_removed", "spans")]
    held = docs.select(*[c for c in docs.columns if c not in clash], F.struct(F.col("text").isNotNull().alias("given"), *[F.col(c) for c in clash]).alias(given))
    cleaned = strip_repeats(held, characters=True, **options)
    text = F.when(F.col(given)["given"], F.col("kept").cast("string"))
    own = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}) | {c: F.col(given)[c] for c in clash}
    return cleaned.select(*[own[c].alias(c) if c in own else F.col(c) for c in docs.columns])
