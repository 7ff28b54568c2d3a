"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile against tile.

A fingerprint has a bit set where over half of the document's shingle hashes have it. Distinct
fingerprints are dealt into tiles of one population count each; two tiles are compared by
exclusive-or and bit counts, unless their population counts differ beyond the radius. Within a
tile pair, rows are sorted by the count of the upper half, which bounds the columns to compare.
Each tile pair gives back a spanning forest of its links, not the links, so that a group of many
copies stays linear. Exact copies share a fingerprint and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cool, cut, redeal
from tidewell.llm.graph import Forest, components

#: Fingerprints in a tile, about; a row of the tile table is eight times as many bytes.
TILE = 16_384
_STRIP = 16


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint as an unsigned integer. Text without words: 0. Fewer words than a shingle: the whole sequence is one."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(p, seed) for p in parts]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two arrays of uint64 fingerprints (right None: within left), each of one population count."""
    same = right is None
    upper = lambda x: np.bitwise_count(x >> np.uint64(32)).astype(np.int64)
    left = left[np.argsort(upper(left), kind="stable")]
    right = left if same else right[np.argsort(upper(right), kind="stable")]
    if not len(left) or not len(right):
        return left[:0], left[:0]
    apart = int(np.bitwise_count(right[0])) - int(np.bitwise_count(left[0]))
    ups, across = upper(left), upper(right)
    forest = Forest(len(left) + (0 if same else len(right)))
    base = 0 if same else len(left)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0
    mixed = np.empty((_STRIP, len(right)), np.uint64)
    bits = np.empty((_STRIP, len(right)), np.uint8)
    for k in range(0, len(left), _STRIP):
        rows = left[k : k + _STRIP]
        # a change x of the upper count leaves apart - x for the lower one: |x| + |apart - x| <= radius
        first = np.searchsorted(across, ups[k] + -((radius - apart) // 2), "left")
        last = np.searchsorted(across, ups[k + len(rows) - 1] + (radius + apart) // 2, "right")
        if same:
            first = max(first, k)
        if first >= last:
            continue
        x, c = mixed[: len(rows), : last - first], bits[: len(rows), : last - first]
        np.bitwise_xor(rows[:, None], right[None, first:last], out=x)
        np.bitwise_count(x, out=c)
        i, j = np.nonzero(c <= radius)
        if same:
            later = j + first > i + k
            i, j = i[later], j[later]
        if len(i):
            held.append((i + k, j + first + base))
            n_held += len(i)
            if n_held > 500_000:
                forest.add(*map(np.concatenate, zip(*held, strict=True)))
                held, n_held = [], 0
    if held:
        forest.add(*map(np.concatenate, zip(*held, strict=True)))
    nodes, roots = forest.edges()
    every = left if same else np.concatenate([left, right])
    return every[nodes], every[roots]


def links(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints that chains of links connect. distinct: column fp, without repeats."""
    counted = distinct.select("fp", F.bit_count("fp").cast("int").alias("ones"))
    sizes = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    n_tiles = F.array(*[F.lit(-(-sizes.get(k, 0) // tile)) for k in range(65)])
    of = lambda k: F.element_at(n_tiles, (F.col(k) + 1).cast("int"))
    key = lambda k, sub: F.shiftleft(F.col(k).cast("long"), 40) + F.col(sub).cast("long")
    tiles = (
        counted.withColumn("sub", F.pmod(F.xxhash64("fp"), of("ones")))
        .groupBy("ones", "sub")
        .agg(F.collect_list("fp").alias("fps"))
        .select("ones", "sub", "fps", key("ones", "sub").alias("tile"))
    )
    tiles = cut(tiles)
    pairs = (
        tiles.withColumn("ones2", F.explode(F.sequence("ones", F.least(F.col("ones") + radius, F.lit(64)))))
        .where(of("ones2") > 0)
        .withColumn("sub2", F.explode(F.sequence(F.lit(0).cast("long"), of("ones2").cast("long") - 1)))
        .where("ones2 > ones or sub2 >= sub")
        .select(F.col("tile").alias("mine"), F.col("fps").alias("left"), key("ones2", "sub2").alias("tile"))
    )
    met = pairs.join(tiles.select("tile", F.col("fps").alias("right")), "tile").select("mine", "tile", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        for batch in batches:
            for mine, other, left, right in zip(*batch.columns, strict=True):
                a = left.values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = None if mine == other else right.values.to_numpy(zero_copy_only=False).view(np.uint64)
                a, b = tile_links(a, b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    Documents link when their fingerprints differ in `radius` bits at most; component_id is the
    smallest doc_id that links reach. Null or empty text has fingerprint zero and links like any
    other. Repeated rows are returned as often as they occur; a null doc_id takes part in links but
    never names a component unless all of its members are null. Other columns are ignored; an
    empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, shingle, seed))
    seen = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(links(seen.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    rooted = seen.join(redeal(roots, "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(redeal(first, "root"), "root").select("fp", "component_id")
    return prints.join(redeal(named, "fp"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the first of their component; of rows that repeat a doc_id, all with that id."""
    names = near_duplicates(docs.select("doc_id", "text"), **options)
    first = names.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(redeal(first, "doc_id"), docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")
