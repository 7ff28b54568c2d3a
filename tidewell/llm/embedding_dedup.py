"""Near-duplicate embeddings: Euclidean p-stable hashing, then exact cosines.

Unit vectors are projected on Gaussian directions, shifted and cut into steps of one width; a
table's bucket is the tuple of its steps. Buckets first meet as ids with sketches, sixteen more
Gaussian projections of a byte each: only vectors whose sketches come close to another's in their
bucket are sent on whole. Pairs of these are compared by exact cosine in double precision, tile
against tile. A pair that several tables put together counts in the first of them only. Tiles give
back counts and a spanning forest, never pairs, so a group of thousands of copies costs arithmetic
but no rows. Equal vectors are compared once, with their multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, redeal
from tidewell.llm.graph import Forest, components

#: Tables, projections in each, and the step's width. At cosine 0.98 (distance 0.2) a projection
#: agrees with probability 0.920, a table with 0.400, some table with 0.9999.
TABLES, PROJECTIONS, WIDTH = 18, 11, 2.0
#: Vectors in a tile, at most about.
TILE = 2048
#: Projections in a sketch, steps of a unit, and the quantile at 1 - 1e-5 of chi-square with so many degrees
#: of freedom: of vectors at squared distance d, the sketches are within d times that, and rounding's share.
SKETCH, FINE, FAR = 16, 32, 53.0
#: One bucket row in so many is counted to find large buckets; those met SOME times or more are split.
SAMPLE, SOME = 64, 12
#: Large buckets whose list may be broadcast.
LISTED = 100_000


def bucket_keys(vectors: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = 0) -> np.ndarray:
    """The bucket of each unit vector in each table, as 64-bit hashes of the steps."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    directions = rng.normal(size=(vectors.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    steps = np.floor((vectors @ directions + shift) / width).astype(np.int64).reshape(len(vectors), tables, projections)
    odd = rng.integers(0, 1 << 63, projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = ((steps.astype(np.uint64) + np.uint64(1 << 20)) * odd).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    return (mixed * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def tile_links(a: tuple, b: tuple | None, turn: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links found first in table `turn`, forest a, forest b) for two tiles (ids, copies, vectors, keys); b None: within a."""
    ids, copies, x, keys = a
    same = b is None
    ids2, copies2, y, keys2 = a if same else b
    norms, norms2 = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    n, n2 = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest = Forest(len(x) + (0 if same else len(y)))
    base = 0 if same else len(x)
    strip = max(1, (1 << 20) // max(1, len(y)))
    for k in range(0, len(x), strip):
        found = (x[k : k + strip] @ y.T) / (norms[k : k + strip, None] * norms2[None, :]) >= cosine
        i, j = np.nonzero(found)
        i += k
        if same:
            later = j > i
            i, j = i[later], j[later]
        if not len(i):
            continue
        forest.add(i, j + base)
        first = np.ones(len(i), bool)
        for t in range(turn):
            first &= keys[i, t] != keys2[j, t]
        i, j = i[first], j[first]
        n += np.bincount(i, copies2[j], len(x)).astype(np.int64)
        n2 += np.bincount(j, copies[i], len(y)).astype(np.int64)
    nodes, roots = forest.edges()
    if same:
        return ids, n + n2, ids[nodes], ids[roots]
    every = np.concatenate([ids, ids2])
    return every, np.concatenate([n, n2]), every[nodes], every[roots]


def sketches(unit: np.ndarray, seed: int = 1) -> np.ndarray:
    """Sixteen bytes for each unit vector, as two longs: rounded Gaussian projections."""
    directions = np.random.default_rng([seed, unit.shape[1]]).normal(size=(unit.shape[1], SKETCH))
    return np.clip(np.rint(unit @ directions * FINE), -127, 127).astype(np.int8).view(np.int64)


def close(a: np.ndarray, b: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each sketch of a, and of b, whether one of the other side may be within the cosine; same: both are one, and no sketch counts for itself."""
    x, y = (np.ascontiguousarray(s).view(np.int8).astype(np.float32) / FINE for s in (a, b))
    most = 2 * (1 - cosine) * FAR + 2 * SKETCH / (FINE * FINE)
    one, two = np.zeros(len(x), bool), np.zeros(len(y), bool)
    squares = (y * y).sum(axis=1)
    strip = max(1, (1 << 20) // max(1, len(y)))
    for k in range(0, len(x), strip):
        rows = x[k : k + strip]
        near = (rows * rows).sum(axis=1)[:, None] + squares - 2 * rows @ y.T <= most
        if same:
            near[np.arange(len(rows)), np.arange(k, k + len(rows))] = False
        one[k : k + strip] = near.any(axis=1)
        two |= near.any(axis=0)
    return one, two


def _member(blob: list[bytes], kind: type, tables: int, projections: int, width: float) -> tuple:
    """(ids, copies, vectors, keys) of a tile's packed members."""
    rows = np.frombuffer(b"".join(blob), np.uint8).reshape(len(blob), -1)
    head, x = rows[:, :16].copy().view(np.int64), rows[:, 16:].copy().view(kind).astype(np.float64)
    return head[:, 0], head[:, 1], x, bucket_keys(_unit(x), tables, projections, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of a list column, by length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """(left, right): members of each tile (right null), and of each two tiles of one bucket. tiles: bucket, subs, sub, members."""
    pairs = tiles.withColumn("sub2", F.explode(F.sequence(F.col("sub"), F.col("subs") - 1)))
    kind = tiles.schema["members"].dataType
    alone = pairs.where("sub = sub2").select(F.col("members").alias("left"), F.lit(None).cast(kind).alias("right"), "bucket", "subs", "sub", "sub2")
    other = tiles.select("bucket", F.col("sub").alias("sub2"), F.col("members").alias("right"))
    met = pairs.where("sub2 > sub").join(other, ["bucket", "sub2"]).select(F.col("members").alias("left"), "right", "bucket", "subs", "sub", "sub2")
    return alone.unionByName(met)


def usable(column):
    """True for vectors that can link: no null, non-finite or missing components, not all zero."""
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(column, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors (vec_id, embedding, label).

    Vectors of equal, non-null label and equal length link at `cosine` or more. Links below it are
    never reported; a link is missed with probability (1 - p) ** tables, p being a table's chance
    (see TABLES). n_links counts the other rows linked directly, equal vectors included;
    component_id is the smallest vec_id that links reach. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows whose vec_id or label is null, link with nothing: they
    are their own component. Rows that repeat a vec_id are separate vectors. Vectors of doubles stay
    doubles. Other columns are ignored; an empty table gives an empty result.
    """
    double = vectors.schema["embedding"].dataType.elementType.typeName() not in ("float", "byte", "short")
    kind = np.float64 if double else np.float32
    data = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"), F.col("label").cast("string").alias("label"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    data = data.withColumn("ok", ok).withColumns({f"k{n}": F.when(ok, F.xxhash64("label", "embedding", F.lit(n))) for n in (1, 2)})
    classes = data.where("ok").groupBy("k1", "k2", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, x in _lists(batch.column(2)):
                unit = _unit(x.astype(np.float64))
                keys = (bucket_keys(unit, tables, projections, width) ^ salt[rows][:, None]) & np.int64(-64)
                sketch = sketches(unit)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t] | np.int64(t)), pa.array(cid[rows]), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())], ["bucket", "cid", "s1", "s2"])

    salt = F.xxhash64("label", F.size("embedding"))
    rows = classes.select("cid", salt.alias("salt"), "embedding").mapInArrow(hashed, "bucket long, cid long, s1 long, s2 long")
    # an estimate is enough here: it says how finely a bucket is dealt, never whether
    some = rows.where(F.pmod(F.xxhash64("bucket", "cid"), F.lit(SAMPLE)) == 0).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= min(SOME, tile))
    large = cut(some.select("bucket", F.ceil(F.col("n") * SAMPLE / tile).cast("long").alias("subs")))
    large = F.broadcast(large) if large.count() <= LISTED else large
    dealt = rows.join(large, "bucket", "left").withColumn("subs", F.coalesce("subs", F.lit(1).cast("long"))).withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("subs")))
    tiles = dealt.groupBy("bucket", "subs", "sub").agg(F.collect_list(F.struct("cid", "s1", "s2")).alias("members")).where("subs > 1 or size(members) > 1")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for left, right, bucket, subs, sub, sub2 in zip(*batch.columns, strict=True):
                sides = [np.column_stack([c.to_numpy() for c in x.values.flatten()]) for x in (left, right) if x.is_valid]
                hits = close(sides[0][:, 1:], sides[-1][:, 1:], cosine, same=len(sides) == 1)
                for own, hit, s in zip(sides, hits, (sub, sub2), strict=False):
                    ids = own[hit, 0]
                    out.append(np.column_stack([ids, np.full((len(ids), 3), [bucket.as_py(), subs.as_py(), s.as_py()], np.int64)]))
            if out:
                found = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k].copy()) for k in range(4)], ["cid", "bucket", "subs", "sub"])

    live = _tile_pairs(cut(tiles)).mapInArrow(sift, "cid long, bucket long, subs long, sub long").distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = np.column_stack([batch.column(k).to_numpy() for k in (3, 4)]).astype(np.int64)
            blobs = [b""] * len(head)
            for rows, x in _lists(batch.column(5)):
                for r, v in zip(rows, np.ascontiguousarray(x, kind), strict=True):
                    blobs[r] = head[r].tobytes() + v.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], ["bucket", "subs", "sub", "member"])

    whole = live.join(redeal(classes.select("cid", "copies", "embedding"), "cid"), "cid").select("bucket", "subs", "sub", "cid", "copies", "embedding")
    whole = whole.mapInArrow(packed, "bucket long, subs long, sub long, member binary")
    exact = cut(whole.groupBy("bucket", "subs", "sub").agg(F.collect_list("member").alias("members")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, one, two, number = [], [], [], []
            for left, right, bucket in zip(*batch.columns, strict=True):
                a = _member(left.as_py(), kind, tables, projections, width)
                b = _member(right.as_py(), kind, tables, projections, width) if right.is_valid else None
                ids, n, x, y = tile_links(a, b, bucket.as_py() & 63, cosine)
                hit = n > 0
                one += [ids[hit], x]
                two += [np.zeros(hit.sum(), np.int64), y]
                number += [n[hit], np.zeros(len(x), np.int64)]
                kinds += [np.zeros(hit.sum(), np.int32), np.ones(len(x), np.int32)]
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (kinds, one, two, number)], ["kind", "a", "b", "n"])

    pairs = _tile_pairs(exact).select("left", "right", "bucket")
    found = cut(pairs.mapInArrow(compare, "kind int, a long, b long, n long"))
    linked = found.where("kind = 0").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cid")
    roots = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "cid")
    named = (
        classes.select("k1", "k2", "cid", "rep", "copies")
        .join(redeal(linked, "cid"), "cid", "left")
        .join(redeal(roots, "cid"), "cid", "left")
        .select("k1", "k2", "rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    )
    first = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(redeal(first, "root"), "root").select("k1", "k2", "n_links", "component_id")
    good = data.where("ok").select("vec_id", "k1", "k2").join(redeal(named, "k1"), ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    bad = data.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
