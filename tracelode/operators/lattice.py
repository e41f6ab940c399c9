"""Discriminative patterns where labels repeat in a graph: level-wise mining over embeddings, keyed by canonical form.

``mining`` knows patterns by their labels, which needs labels that are unique in a graph.  Here a pattern is a value (labels of its
vertices, edges between their places) in canonical form, and an embedding is a row: pattern, graph, and the graph's vertex in each place.  A level
is grown by joining each vertex of an embedding with the graph's edges at that vertex, so a hub is dealt by its edges and a large graph by its vertices.
Each way to extend a pattern is put in canonical form once a batch, and takes its embeddings along by a permutation of places.
All embeddings of a pattern are kept, those by its symmetries included, since image support counts them.

Support, of failing graphs: ``independent`` takes embeddings in order of graph and vertices, each that shares no vertex with any before it, taken
or not; ``image`` is the least number of different vertices in a place, at most the number of embeddings; ``graphs`` counts graphs.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import canonical_order
from ..functions.scores import ieee_div, score, upper_bound
from ..staging import staged
from .embeddings import first_at_all
from .ranking import order_key
from .support import graph_totals, priors

# A pattern is JSON: {"v": labels, "e": [[from, to, label], ...]}, in canonical form.
_GROWN = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("n_edges", T.IntegerType())])


@F.pandas_udf(_GROWN)
def _extended(pattern: pd.Series, s: pd.Series, t: pd.Series, label: pd.Series, fresh: pd.Series) -> pd.DataFrame:
    """The pattern with an edge from place s to place t; fresh is the label of the new vertex, whose place is the first free one.  Null if it has the edge."""
    known: dict[tuple, tuple] = {}
    out = []
    for key in zip(pattern, s, t, label, fresh, strict=True):
        if key not in known:
            old = json.loads(key[0])
            v, e = list(old["v"]), [tuple(x) for x in old["e"]]
            edge = (int(key[1]), int(key[2]), key[3])
            if key[4] is not None:
                v.append(key[4])
            if edge in e:
                known[key] = (None, None, None)
            else:
                (v, e), order = canonical_order(v, [*e, edge])
                known[key] = (json.dumps({"v": v, "e": e}, ensure_ascii=False), order, len(e))
        out.append(known[key])
    return pd.DataFrame(out, columns=["pattern", "places", "n_edges"])


def _first(edges: DataFrame) -> DataFrame:
    """Embeddings of patterns of one vertex: what the first edges extend."""
    alone = F.to_json(F.struct(F.array("src_label").alias("v"), F.array().cast("array<array<string>>").alias("e")))
    return edges.select("outcome", "graph_id", alone.alias("pattern"), F.array("src").alias("m")).distinct()


def extend(embeddings: DataFrame, edges: DataFrame) -> DataFrame:
    """outcome, graph_id, pattern, m, n_edges: the embeddings of patterns with one more edge that touches them.

    embeddings: outcome, graph_id, pattern, m; edges: outcome, graph_id, src, dst, label, src_label, dst_label.
    """
    on = ["outcome", "graph_id"]
    at = embeddings.select(*on, "pattern", "m", F.explode("m").alias("vid"))
    out = at.join(edges.withColumnRenamed("src", "vid").select(*on, "vid", F.col("dst").alias("other"), "label", F.col("dst_label").alias("other_label"), F.lit(True).alias("goes")), [*on, "vid"])
    back = at.join(edges.withColumnRenamed("dst", "vid").select(*on, "vid", F.col("src").alias("other"), "label", F.col("src_label").alias("other_label"), F.lit(False).alias("goes")), [*on, "vid"])
    place = lambda c: F.array_position("m", F.col(c)).cast("int") - 1
    ways = out.unionByName(back).withColumns({"here": place("vid"), "there": place("other")})
    new = F.col("there") < 0
    there = F.when(new, F.size("m")).otherwise(F.col("there"))
    ways = ways.select(
        *on, "pattern", F.when(new, F.concat("m", F.array("other"))).otherwise(F.col("m")).alias("m"), F.when(F.col("goes"), F.col("here")).otherwise(there).alias("s"), F.when(F.col("goes"), there).otherwise(F.col("here")).alias("t"), "label", F.when(new, F.col("other_label")).alias("fresh")
    )
    # an edge between two vertices of the embedding is met from both ends
    grown = ways.distinct().withColumn("x", _extended("pattern", "s", "t", "label", "fresh")).where("x.pattern is not null")
    m = F.transform("x.places", lambda p: F.get(F.col("m"), p))
    return grown.select(*on, F.col("x.pattern").alias("pattern"), m.alias("m"), F.col("x.n_edges").alias("n_edges")).distinct()


def support(embeddings: DataFrame, kind: str = "independent") -> DataFrame:
    """pattern, support in failing graphs."""
    fail = embeddings.where("outcome = 'fail'")
    if kind == "graphs":
        return fail.groupBy("pattern").agg(F.count_distinct("graph_id").alias("support"))
    if kind == "image":
        per = fail.select("pattern", "graph_id", F.posexplode("m").alias("k", "vid")).groupBy("pattern", "k").agg(F.count_distinct("graph_id", "vid").alias("n"))
        return per.groupBy("pattern").agg(F.min("n").alias("support"))
    if kind != "independent":
        raise ValueError(f"no such support: {kind}")
    return first_at_all(fail, ["pattern", "graph_id"]).groupBy("pattern").agg(F.sum("n").alias("support"))


def labelled(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with src_label and dst_label, each once.  vertices: outcome, graph_id, vid, label; edges: outcome, graph_id, src, dst[, label]."""
    on = ["outcome", "graph_id"]
    if "label" not in edges.columns:
        edges = edges.withColumn("label", F.lit(""))
    name = lambda c: vertices.select(*on, F.col("vid").alias(c), F.col("label").alias(f"{c}_label"))
    return edges.select(*on, "src", "dst", F.coalesce("label", F.lit("")).alias("label")).distinct().join(name("src"), [*on, "src"]).join(name("dst"), [*on, "dst"])


def part_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """part (JSON of a label, or of an edge's labels: from, own, to), n: how often passing graphs have it."""
    v = vertices.where("outcome = 'ok'").select(F.to_json(F.array("label")).alias("part"))
    e = edges.where("outcome = 'ok'").select(F.to_json(F.array("src_label", "label", "dst_label")).alias("part"))
    return v.unionByName(e).groupBy("part").agg(F.count("*").alias("n"))


def with_score(supports: DataFrame, parts: DataFrame, totals: DataFrame, name: str, max_edges: int, min_support: int) -> DataFrame:
    """supports (pattern, support) with v (labels), e (edges: from, to, label), score, and bound, the most that a pattern grown from it may score.

    The passing frequency is the mean, over a pattern's vertices and edges, of their counts in passing graphs over the number of all graphs.
    """
    shape = F.from_json("pattern", "struct<v: array<string>, e: array<array<string>>>")
    p = supports.withColumn("shape", shape)
    end = lambda k: F.get(F.col("shape.v"), k.cast("int"))
    held = F.concat(F.transform("shape.v", lambda x: F.to_json(F.array(x))), F.transform("shape.e", lambda x: F.to_json(F.array(end(x[0]), x[2], end(x[1])))))
    okay = p.select("pattern", F.explode(held).alias("part")).join(parts, "part", "left").groupBy("pattern").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("parts_ok"))
    total = (F.col("fail_total") + F.col("ok_total")).cast("double")
    f, share, (pf, po) = ieee_div(F.col("support").cast("double"), total), ieee_div(F.col("parts_ok"), total), priors()
    o, least_o = share / (F.size("shape.v") + F.size("shape.e")), share / (2 * max_edges + 1)
    joined = p.join(okay, "pattern").join(F.broadcast(totals))  # totals are one row
    edge = lambda x: F.struct(x[0].cast("int").alias("s"), x[1].cast("int").alias("t"), x[2].alias("label"))
    bound = upper_bound(name, pf, po, f, o, ieee_div(F.lit(float(min_support)), total), least_o)
    return joined.select("pattern", F.col("shape.v").alias("v"), F.transform("shape.e", edge).alias("e"), "support", score(name)(f, o, pf, po).alias("score"), bound.alias("bound"))


def mine(vertices: DataFrame, edges: DataFrame, name: str = "relative_f1", max_edges: int = 3, min_support: int = 2, kind: str = "independent", k: int | None = None) -> DataFrame:
    """pattern (JSON of the canonical form), v, e, support, score, bound of the patterns of 1 to max_edges edges that have the least support in
    failing graphs.  With k, the k best ones (ties by pattern), and what can't reach the k-th score isn't extended.

    vertices: outcome, graph_id, vid, label; edges: outcome, graph_id, src, dst[, label].  A pattern is extended while its own support is
    enough; ``independent`` support may grow with a pattern, so patterns behind a rarer one aren't looked for, as in the reference.
    """
    if max_edges < 1 or min_support < 1:
        raise ValueError("max_edges and min_support start at 1")
    vertices = staged(vertices.select("outcome", "graph_id", "vid", "label"), "vertices")
    edges = staged(labelled(vertices, edges), "edges")
    totals, parts = graph_totals(vertices), staged(part_counts(vertices, edges), "parts")
    failing = edges.where("outcome = 'fail'")
    level, found = _first(failing), None
    for size in range(1, max_edges + 1):
        level = staged(extend(level, failing), "embeddings")
        enough = support(level, kind).where(F.col("support") >= min_support)
        patterns = staged(with_score(enough, parts, totals, name, max_edges, min_support), "patterns")
        found = patterns if found is None else found.unionByName(patterns)
        if size == max_edges:
            break
        alive = patterns
        if k is not None:
            found = staged(found.orderBy(order_key(F.col("score")), "pattern").limit(k), "best")
            worst = found.agg(F.count("*").alias("n"), F.min("score").alias("worst")).first()
            if worst["n"] == k:
                alive = patterns.where(F.col("bound") >= worst["worst"])
        level = level.join(alive.select("pattern"), "pattern", "left_semi").drop("n_edges")
    return found if k is None else found.orderBy(order_key(F.col("score")), "pattern").limit(k)
