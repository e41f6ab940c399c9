"""Support counts of labels and edges over graph profiles, and scoring by them.

vertices: outcome ('fail' or 'ok'), graph_id, label.  edges: outcome, graph_id, src, dst, traversed.  A label of a
runtime profile occurs once a graph, so supports are counts of distinct graphs; counting distinct graphs also holds
where labels repeat.

Scale: every count is a partial aggregation before its shuffle; a hot label is pre-aggregated by the map side.  The
graph totals are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import ieee_div, score


def graph_totals(graphs: DataFrame) -> DataFrame:
    """One row: fail_total, ok_total.  graphs has outcome and graph_id, one row or more a graph."""
    g = graphs.select("outcome", "graph_id").distinct()
    return g.agg(F.count_if(F.col("outcome") == "fail").alias("fail_total"), F.count_if(F.col("outcome") == "ok").alias("ok_total"))


def _counts(df: DataFrame, *keys: str) -> DataFrame:
    once = df.groupBy(*keys, "outcome", "graph_id").agg(F.lit(1).alias("one"))
    return once.groupBy(*keys).agg(F.count_if(F.col("outcome") == "fail").alias("fail_graphs"), F.count_if(F.col("outcome") == "ok").alias("ok_graphs"))


def label_support(vertices: DataFrame, graphs: DataFrame | None = None, failing_only: bool = True) -> DataFrame:
    """label, fail_graphs, ok_graphs, fail_total, ok_total.  Labels of passing runs alone are never ranked, so go by default."""
    found = _counts(vertices, "label")
    totals = graph_totals(vertices if graphs is None else graphs)
    return (found.where("fail_graphs > 0") if failing_only else found).join(F.broadcast(totals))


def edge_support(edges: DataFrame, graphs: DataFrame | None = None, failing_only: bool = True) -> DataFrame:
    """src, dst, fail_graphs, ok_graphs, fail_total, ok_total."""
    found = _counts(edges, "src", "dst")
    return (found.where("fail_graphs > 0") if failing_only else found).join(F.broadcast(graph_totals(edges if graphs is None else graphs)))


def priors(true_prior: bool = False) -> tuple[Column, Column]:
    """Of failing and passing: both are the share of passing runs unless true priors are asked for."""
    total = (F.col("fail_total") + F.col("ok_total")).cast("double")
    po = ieee_div(F.col("ok_total").cast("double"), total)
    return (ieee_div(F.col("fail_total").cast("double"), total) if true_prior else po), po


def with_score(support: DataFrame, name: str, true_prior: bool = False) -> DataFrame:
    """support with a column score."""
    total = (F.col("fail_total") + F.col("ok_total")).cast("double")
    f, o = (ieee_div(F.col(c).cast("double"), total) for c in ("fail_graphs", "ok_graphs"))
    return support.withColumn("score", score(name)(f, o, *priors(true_prior)))


def edge_pattern_support(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Support of the one-edge patterns with f and o as scores take them: f from the failing graphs with the edge, o from
    the sum of the passing supports of the edge and its two labels over three."""
    e = edge_support(edges, vertices)
    v = _counts(vertices, "label").select("label", F.col("ok_graphs").alias("n"))
    total = (F.col("fail_total") + F.col("ok_total")).cast("double")
    joined = e.join(v.withColumnsRenamed({"label": "src", "n": "src_ok"}), "src", "left").join(v.withColumnsRenamed({"label": "dst", "n": "dst_ok"}), "dst", "left")
    okay = F.col("ok_graphs") + F.coalesce("src_ok", F.lit(0)) + F.coalesce("dst_ok", F.lit(0))
    return joined.select("src", "dst", "fail_graphs", "ok_graphs", "fail_total", "ok_total", ieee_div(F.col("fail_graphs").cast("double"), total).alias("f"), (ieee_div(okay.cast("double"), total) / 3).alias("o"))


def degrees(edges: DataFrame) -> DataFrame:
    """label, in_degree, out_degree, degree over distinct edges; a loop counts in both."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("label"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("label"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("label").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def label_frequency(vertices: DataFrame) -> DataFrame:
    """outcome, label, n: vertices of a label, and for edges likewise by src and dst."""
    return vertices.groupBy("outcome", "label").agg(F.count("*").alias("n"))


def edge_frequency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("outcome", "src", "dst").agg(F.count("*").alias("n"), F.sum("traversed").alias("traversed"))


def merge_profiles(flows: DataFrame) -> DataFrame:
    """Profiles of the goroutines or parts of a run merged: exec_id, src, dst, traversed, positions, last_position.

    flows: exec_id, part, src, dst, traversed, position.  Counts add up, position sets unite, of the rest the last part wins.
    """
    return flows.groupBy("exec_id", "src", "dst").agg(
        F.sum("traversed").alias("traversed"), F.array_sort(F.collect_set("position")).alias("positions"), F.max_by("position", "part").alias("last_position")
    )
