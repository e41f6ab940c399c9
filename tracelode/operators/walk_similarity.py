"""Similarity of graphs by the labels that walks join, and expected hitting times from samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import new_path, staged


#: A graph of more vertices and edges is measured by joins; one of these has a matrix of under 300 kB.
WHOLE = 190


def label_walks(v: list[str], e: list[tuple[int, int]], labels: list[str]) -> np.ndarray:
    """For each two labels, whether a walk of up to as many steps as there are vertices leads from one to the other."""
    n = len(v)
    step = np.zeros((n, n))
    for s, t in e:
        step[s, t] = 1
    reach, power = np.zeros((n, n)), np.eye(n)
    for _ in range(n):
        power = (power @ step > 0).astype(float)
        reach = np.maximum(reach, power)
    at = np.array([[float(x == l) for x in v] for l in labels])
    return at @ reach @ at.T


def walk_distance(a: tuple, b: tuple) -> float:
    """Root of the mean squared difference of two graphs' label walks; graphs are (labels, edges)."""
    labels = sorted({*a[0], *b[0]})
    d = label_walks(*a, labels) - label_walks(*b, labels)
    return float(np.sqrt((d * d).sum() / max(1, len(labels)) ** 2))


def walk_distances(pairs: DataFrame) -> DataFrame:
    """a, b, distance of pairs of patterns.  pairs: a, b (ids), and left and right, structs of v (labels) and e (array of struct<s, t>)."""

    def run(batches):
        for p in batches:
            d = [walk_distance((list(x["v"]), [(k["s"], k["t"]) for k in x["e"]]), (list(y["v"]), [(k["s"], k["t"]) for k in y["e"]])) for x, y in zip(p["left"], p["right"], strict=True)]
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "distance": d})

    return pairs.mapInPandas(run, "a long, b long, distance double")


def reach(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """graph_id, x, y, d: vertices y that a walk from x leads to, and the steps of the shortest one, from 1 to half the graph's number of vertices.

    edges: graph_id, src, dst; sizes: graph_id, n.  Breadth first from all vertices at once; each round joins what the one before it found with the edges
    and is written.
    """
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "reach")
    e = staged(edges.select("graph_id", "src", "dst").na.drop().distinct().join(sizes, "graph_id").where("n >= 2"), "edges")
    new, d = e.select("graph_id", F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(1).alias("d")), 1
    schema, paths = new.schema, []
    while True:
        paths.append(f"{path}/{d}")
        new.write.parquet(paths[-1])
        new, seen = (spark.read.schema(schema).parquet(*p) for p in (paths[-1:], paths))
        if new.isEmpty():
            return seen
        d += 1
        steps = e.where(F.col("n") >= 2 * d).select("graph_id", F.col("src").alias("y"), F.col("dst").alias("z"))
        onward = new.join(steps, ["graph_id", "y"]).select("graph_id", "x", F.col("z").alias("y")).distinct()
        new = onward.join(seen, ["graph_id", "x", "y"], "left_anti").select("graph_id", "x", "y", F.lit(d).alias("d"))


def walk_matrix(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, l1, l2, w: how many pairs of a graph's vertices and edges with these labels a walk joins; a walk alternates between them and takes at
    least one step from one to the next, at most as many as the graph has vertices.  Pairs of labels that nothing joins have no row.

    vertices: graph_id, vid, label; edges: graph_id, src, dst, label.  Labels of vertices and edges are of one kind; repeated edges count each.
    Edges of one label at one vertex are counted before pairs are formed.
    """
    vertices, edges = vertices.select("graph_id", "vid", "label"), edges.select("graph_id", "src", "dst", "label")
    sizes = staged(vertices.groupBy("graph_id").agg(F.count("*").cast("int").alias("n")), "sizes")
    own = vertices.select("graph_id", F.col("vid").alias("at"), "label", F.lit(1).cast("long").alias("k"), F.lit(0).alias("half"))

    def ends(side: str) -> DataFrame:
        at = edges.groupBy("graph_id", F.col(side).alias("at"), "label").agg(F.count("*").alias("k")).withColumn("half", F.lit(1))
        return own.unionByName(at)

    # no step at all joins an edge to its own end; from a vertex to itself it is no walk
    still = vertices.select("graph_id", F.col("vid").alias("x"), F.col("vid").alias("y"), F.lit(0).alias("d"))
    pairs = reach(edges, sizes).unionByName(still).join(sizes, "graph_id")
    begins = ends("dst").select("graph_id", F.col("at").alias("x"), F.col("label").alias("l1"), F.col("k").alias("k1"), F.col("half").alias("h1"))
    finishes = ends("src").select("graph_id", F.col("at").alias("y"), F.col("label").alias("l2"), F.col("k").alias("k2"), F.col("half").alias("h2"))
    halves = F.col("h1") + F.col("h2")
    counted = F.when(halves == 0, F.col("d") > 0).otherwise((F.col("x") != F.col("y")) | (F.col("d") == 0))
    # a vertex's labels are gathered before its pairs are joined with the other end's
    first = pairs.join(begins, ["graph_id", "x"])
    both = first.join(finishes, ["graph_id", "y"]).where(counted & (2 * F.col("d") + halves <= F.col("n")))
    return both.groupBy("graph_id", "l1", "l2").agg(F.sum(F.col("k1") * F.col("k2")).alias("w"))


def matrix_distances(pairs: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, distance of pairs (a, b) of graphs: the root of the Frobenius norm of the squared differences of their walk matrices, over the square of the number of
    labels that either has; two graphs without labels have distance 0.  Graphs of at most WHOLE vertices and edges have their matrices made where their rows meet, and a
    pair of these its distance where the matrices do; a pair with a larger one goes by joins."""
    asked = staged(pairs.select("a", "b").distinct(), "pairs")
    v, e = vertices.select("graph_id", F.col("vid").cast("string").alias("s"), F.lit(None).cast("string").alias("t"), "label"), edges.select("graph_id", F.col("src").cast("string").alias("s"), F.col("dst").cast("string").alias("t"), "label")
    rows = staged(v.withColumn("is_edge", F.lit(False)).unionByName(e.withColumn("is_edge", F.lit(True))), "graphs")
    large = staged(rows.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("graph_id"), "large")
    if large.isEmpty():
        return _distances_whole(asked, rows)
    by_joins = asked.join(large.withColumnRenamed("graph_id", "a"), "a", "left_semi").unionByName(asked.join(large.withColumnRenamed("graph_id", "b"), "b", "left_semi").select("a", "b")).distinct()
    by_joins = staged(by_joins, "large_pairs")
    theirs = staged(by_joins.select(F.col("a").alias("graph_id")).unionByName(by_joins.select(F.col("b").alias("graph_id"))).distinct(), "theirs")
    some = lambda df: df.join(theirs, "graph_id", "left_semi")
    return _distances_whole(asked.join(by_joins, ["a", "b"], "left_anti"), rows.join(large, "graph_id", "left_anti")).unionByName(_distances_by_joins(by_joins, some(vertices), some(edges)))


def whole_matrix(vertices: list[tuple], edges: list[tuple]) -> tuple[list, np.ndarray]:
    """labels and the walk matrix between them of one graph: vertices (id, label), edges (source, target, label)."""
    n = len(vertices)
    at: dict = {}
    for v, _ in vertices:
        if v is not None:
            at.setdefault(v, len(at))
    labels = list(dict.fromkeys([l for _, l in vertices] + [l for *_, l in edges]))
    number = {l: k for k, l in enumerate(labels)}
    m = len(at)
    step, own, begins, ends = np.zeros((m, m), bool), np.zeros((m, len(labels))), np.zeros((m, len(labels))), np.zeros((m, len(labels)))
    still = np.zeros((m, m))
    for v, l in vertices:
        if v is not None:
            own[at[v], number[l]] += 1
            still[at[v], at[v]] += 1
    for s, t, l in edges:
        if s in at and t in at:
            step[at[s], at[t]] = True
        if t in at:
            begins[at[t], number[l]] += 1
        if s in at:
            ends[at[s], number[l]] += 1
    # steps of the shortest walk of at least one step, up to half the number of vertices
    reached, near, d = step.copy(), step.copy(), 1
    steps = np.where(step, 1, 0)
    while near.any() and 2 * (d + 1) <= n:
        d += 1
        near = (near.astype(np.float32) @ step.astype(np.float32) > 0) & ~reached
        reached |= near
        steps[near] = d
    apart = ~np.eye(m, dtype=bool)
    w = np.zeros((len(labels), len(labels)))
    for h1, one in ((0, own), (1, begins)):
        for h2, two in ((0, own), (1, ends)):
            fits = reached & (2 * steps + h1 + h2 <= n) & (n >= 2)
            # no step at all joins an edge to its own end; from a vertex to itself it is no walk
            joined = fits if h1 + h2 == 0 else (fits & apart) + still * (h1 + h2 <= n)
            w += one.T @ joined @ two
    return labels, w


def _distances_whole(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Distances of pairs of graphs each of whose rows meet in one row: a matrix is one call, and a pair's matrices meet in another."""
    listed = rows.groupBy("graph_id").agg(F.collect_list(F.struct("s", "t", "label", "is_edge")).alias("g"))

    def measure(batches):
        for b in batches:
            found = []
            for g in b["g"]:
                labels, w = whole_matrix([(x["s"], x["label"]) for x in g if not x["is_edge"]], [(x["s"], x["t"], x["label"]) for x in g if x["is_edge"]])
                found.append((labels, w.ravel().tolist()))
            yield pd.DataFrame({"graph_id": b["graph_id"], "labels": [x for x, _ in found], "w": [x for _, x in found]})

    kind = rows.schema["graph_id"].dataType.simpleString()
    known = staged(listed.mapInPandas(measure, f"graph_id {kind}, labels array<{rows.schema['label'].dataType.simpleString()}>, w array<double>"), "matrices")
    side = lambda c: known.select(F.col("graph_id").alias(c), F.struct("labels", "w").alias(f"of_{c}"))

    def apart(batches):
        for b in batches:
            found = []
            for x, y in zip(b["of_a"], b["of_b"], strict=True):
                sides = [([] if g is None else list(g["labels"]), np.zeros(0) if g is None else np.asarray(g["w"], float)) for g in (x, y)]
                labels = {l: k for k, l in enumerate(dict.fromkeys([*sides[0][0], *sides[1][0]]))}
                d = np.zeros((len(labels), len(labels)))
                for sign, (names, w) in zip((1, -1), sides, strict=True):
                    at = [labels[l] for l in names]
                    d[np.ix_(at, at)] += sign * w.reshape(len(at), len(at))
                n = sum(l is not None for l in labels)
                found.append(float(np.sqrt(np.sqrt((d**4).sum()) / (n * n))) if n else 0.0)
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "distance": found})

    pairs = asked.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "of_a", "of_b")
    return pairs.mapInPandas(apart, f"a {kind}, b {kind}, distance double")


def _distances_by_joins(asked: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The same of graphs of any size, as rows."""
    w = staged(walk_matrix(vertices, edges), "walks")
    labels = vertices.select("graph_id", "label").unionByName(edges.select("graph_id", "label")).distinct()

    def of_both(df: DataFrame) -> DataFrame:
        sides = [asked.join(df.withColumnRenamed("graph_id", side), side).withColumn("sign", F.lit(sign)) for side, sign in (("a", 1), ("b", -1))]
        return sides[0].unionByName(sides[1])

    apart = of_both(w).groupBy("a", "b", "l1", "l2").agg(F.sum(F.col("w") * F.col("sign")).cast("double").alias("d"))
    norm = apart.groupBy("a", "b").agg(F.sum(F.pow("d", F.lit(4))).alias("s"))
    known = of_both(labels).groupBy("a", "b").agg(F.count_distinct("label").alias("n"))
    joined = asked.join(norm, ["a", "b"], "left").join(known, ["a", "b"], "left")
    return joined.select("a", "b", F.coalesce(F.sqrt(F.sqrt("s") / (F.col("n") * F.col("n"))), F.lit(0.0)).alias("distance"))


def expected_time(samples: DataFrame) -> DataFrame:
    """state, expected: from sampled first-hit times, the largest one less the gaps between sorted times weighted by the share of
    strictly smaller times.  samples: state, time."""
    w = Window.partitionBy("state").orderBy("time")
    counts = samples.groupBy("state", "time").agg(F.count("*").alias("k"))
    below = F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("k").over(Window.partitionBy("state"))
    gaps = counts.withColumns({"below": below / total, "gap": F.col("time") - F.coalesce(F.lag("time").over(w), F.lit(0))})
    return gaps.groupBy("state").agg((F.max("time") - F.sum(F.col("gap") * F.col("below"))).alias("expected"))
