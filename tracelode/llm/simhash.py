"""SimHash near-duplicates: 64-bit fingerprints, exact pairs at a small Hamming distance by vantage-point trees.

1. A fingerprint a document, in tasks of their own; equal fingerprints are one vertex from then on (a group of
   copies is pre-aggregated, whatever its size).
2. Fingerprints are partitioned by Hamming distance in shards of about ``TARGET``.  On the whole 64 bits the distances of
   unrelated fingerprints all lie near 32, so a ball's boundary of width ``radius`` holds about three quarters of all
   points, and each level of a tree would send most queries both ways.  The top level therefore measures the distance
   on some of the bits, which is never larger: of radius + j disjoint blocks of bits, two fingerprints within radius agree
   on j.  For each choice of j blocks, a shard is the ball of radius 0 around its value there; a fingerprint belongs to one shard
   a choice, and every pair meets in a shard.  j and the width of the blocks follow from the number of fingerprints
   (``masks``): none for a few thousand (one tree over all), one block of a few bits, and more beyond billions.
3. In a shard, a vantage-point tree halves the points by their distance to a vantage point until ``LEAF`` are left; queries go
   down each side that the triangle bound leaves open, so those at a boundary visit both.  The tree is the only source of pairs.
4. A shard gives a spanning forest of its links, not all pairs; components follow from the forests.

A shard of over ``SHARD`` fingerprints is dealt in groups, and each two groups form a task of their own, so no
task holds more than two groups.  Joins deal keys of many rows in parts (``join_split``).  Nothing about all documents reaches
the driver but the number of their fingerprints.

Defined cases: a text without words (null, empty, blank) has fingerprint zero; fewer words than a shingle are
one shingle; repeated rows share a component; a null doc_id takes part and can't name a component (where no
document of a component has an id, component_id is null); texts of any length are hashed whole; of other columns than doc_id
and text none is read, whatever it is called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.joins import join_split
from .common import fresh_name, map_batches, partitions, staged, texts

#: Fingerprints of a shard on the average; those that one task compares with one another: a larger shard is split in groups of
#: about half of it; and the most shards that are split at that size (their list is broadcast; beyond it the size grows).
TARGET, SHARD, SPLIT = 1_024, 8_192, 200_000
#: Points of a vantage-point tree's leaf, and points among which a vantage point is chosen.
LEAF, TRIED = 32, 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    set_bits = np.zeros(64, np.int64)
    h = np.array(hashes, "<u8")
    for at in range(0, len(h), 1 << 14):  # bounds the unpacked bits of a very long text
        part = h[at : at + (1 << 14)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp for every document."""
    return map_batches(texts(docs), lambda c: {"doc_id": c["doc_id"], "fp": [fingerprint(t, shingle, seed) for t in c["text"]]}, "doc_id long, fp long")


def masks(radius: int, n: int, target: int = TARGET, bits: int = 64) -> list[int]:
    """The bits of each choice of j out of radius + j blocks, as signed masks, so that n fingerprints make shards of about target."""
    needed = max(0, math.ceil(math.log2(max(1, n) / target)))
    j = next(j for j in range(bits) if bits // max(1, radius + j) * j >= needed or j == 4)
    width = min(bits // max(1, radius + j), -(-needed // max(1, j)))
    blocks = [((1 << width) - 1) << bits * k // (radius + j) for k in range(radius + j)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(chosen) for chosen in combinations(blocks, j))]


class Forest:
    """Union-find over the points 0..n-1 of one shard; ``root`` stays fully compressed."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def vantage_point(points: np.ndarray) -> np.uint64:
    """Of a few points, the one whose distances to some others spread the most."""
    step = max(1, len(points) // 64)
    tried = points[:: max(1, len(points) // TRIED)][:TRIED]
    return tried[np.argmax(np.bitwise_count(tried[:, None] ^ points[None, ::step]).astype(np.float64).var(axis=1))]


def near(points: np.ndarray, queries: np.ndarray, radius: int, stats: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all (point, query) pairs within radius, by a vantage-point tree over the points.

    stats gets the number of levels, of pairs compared in leaves, and of queries that went both ways and one way."""
    stats = {} if stats is None else stats
    for k in ("levels", "compared", "both", "pruned"):
        stats.setdefault(k, 0)
    todo = [(np.arange(len(points)), np.arange(len(queries)), 0)]
    while todo:
        p, q, level = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            vantage = vantage_point(points[p])
            dp = np.bitwise_count(points[p] ^ vantage).astype(np.int64)
            dq = np.bitwise_count(queries[q] ^ vantage).astype(np.int64)
            mu = int(np.median(dp))
            mu -= mu == dp.max()
            inside = dp <= mu
            if inside.any():
                # |d(q, v) - d(p, v)| <= d(q, p): a query is near no point of a side that its distance is further off from
                left, right = dq <= mu + radius, dq > mu - radius
                stats["levels"] = max(stats["levels"], level + 1)
                stats["both"] += int((left & right).sum())
                stats["pruned"] += int((left ^ right).sum())
                todo += [(p[inside], q[left], level + 1), (p[~inside], q[right], level + 1)]
                continue
            # all points at one distance: no split by this vantage point; compare in slices instead
        stats["compared"] += len(p) * len(q)
        for at in range(0, len(p), LEAF):
            part = p[at : at + LEAF]
            for to in range(0, len(q), 8192):
                i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ queries[q[to : to + 8192]][None, :]) <= radius)
                if len(i):
                    yield part[i], q[to : to + 8192][j]


def forest_of(points: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, smaller root) of a shard's components.  With two groups, only pairs across them are looked for."""
    f = Forest(len(points))
    first = np.flatnonzero(group == group[0])
    second = np.flatnonzero(group != group[0])
    if not len(second):
        second = first
    for i, j in near(points[first], points[second], radius):
        f.link(first[i], second[j])
    moved = np.flatnonzero(f.root != np.arange(len(points)))
    return points[moved], points[f.root[moved]]


def links(fps: DataFrame, radius: int = 4, shard: int = SHARD, target: int = TARGET) -> DataFrame:
    """fps: distinct column fp.  Edges a, b whose components are those of all pairs within radius."""
    spark = fps.sparkSession
    n = fps.count()
    all_masks = masks(radius, n, target)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in all_masks])).alias("block", "value"))
    # of shards above this size there are at most SPLIT
    shard = max(shard, -(-n * len(all_masks) // SPLIT))
    large = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > shard).select("block", "value", F.ceil(F.col("n") / F.lit(shard / 2)).cast("int").alias("split"))
    # a shard alone is one group; otherwise each two of its groups meet
    sized = keyed.join(F.broadcast(large), ["block", "value"], "left").withColumn("groups", F.coalesce("split", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int"))
    other: Column = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    dealt = sized.select("fp", "block", "value", "own", other.alias("other")).select("fp", "block", "value", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "own")
    keys = ["block", "value", "g", "h"]
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def solve(cols: list[np.ndarray], last: bool) -> tuple[list, list[np.ndarray]]:
            """Solve the shards that are complete; return the unfinished one."""
            n = len(cols[0])
            edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[1:5]], axis=0)) + 1
            bounds = [0, *edge.tolist(), n]
            out = []
            for s, e in zip(bounds, bounds[1:] if last else bounds[1:-1], strict=False):
                if e - s > 1:
                    a, b = forest_of(cols[0][s:e], cols[5][s:e], radius)
                    if len(a):
                        out.append((a, b))
            return out, [c[0 if last else bounds[-2] :] for c in cols]

        def pack(found: list) -> pa.RecordBatch:
            a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=arrow)

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if len(cols[0]):
                found, rest = solve(cols, False)
                yield pack(found)
        if rest is not None and len(rest[0]):
            yield pack(solve(rest, True)[0])

    # a group pair with itself needs each point once, with another one the points of both
    return dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "fp").select("fp", *keys, "own").mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, shard: int = SHARD) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach, its own included) of every document."""
    marked = staged(fingerprints(docs, shingle, seed), "fingerprints")
    vertices = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "vertices")
    linked = staged(vertices.join(components(links(vertices.select("fp"), radius, shard)).withColumnRenamed("vertex", "fp"), "fp").select("fp", "component", "least"), "linked")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    of_linked = join_split(linked.select("fp", "component"), named, "component", "size", linked.count()).select("fp", "component_id")
    of_fp = staged(vertices.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "components")
    return join_split(marked, of_fp, "fp", "n", marked.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """docs without those whose component has a document with a smaller id; rows without an id stay, of equal rows all."""
    key = fresh_name(docs.columns, "gone")
    gone = near_duplicates(docs, radius, shingle, seed).where("doc_id > component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")
