"""Walks from the best labels, localisation end to end, swap optima, matching in every bin, and pattern keys."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.functions.patterns import key
from tracelode.functions.scores import SCORES
from tracelode.operators import clustering, localisation, markov, mining, objects, ranking, support
from tracelode.operators.joins import join_split
from tracelode.plans import traces
from tracelode.streaming import flows

DATA = "/root/testdata/sf0.001"


def graphs(spark):
    return traces.edges(spark, DATA), traces.vertices(spark, DATA)


def scored(vertices, name):
    return support.with_score(support.label_support(vertices), name).select("label", "score")


def test_walks_from_labels_end_at_better_patterns_that_hold_the_label(spark):
    # every graph has all labels; the edges a -> b -> c are in failing ones alone
    sides = {"fail": [("a", "b"), ("b", "c"), ("c", "d")], "ok": [("b", "a"), ("c", "b"), ("c", "d")]}
    edges = spark.createDataFrame([(o, f"{o}{k}", s, t) for o, es in sides.items() for k in range(4) for s, t in es], "outcome string, graph_id string, src string, dst string")
    vertices = edges.select("outcome", "graph_id", F.explode(F.array("src", "dst")).alias("label")).distinct()
    ranked = scored(vertices, "precision")
    own = dict(ranked.collect())
    found = mining.label_walks(edges, vertices, ranked, name="precision", max_edges=2, seed=5).collect()
    again = mining.label_walks(edges, vertices, ranked, name="precision", max_edges=2, seed=5).collect()
    assert found and sorted(map(str, found)) == sorted(map(str, again)) and len({tuple(r["pattern"]) for r in found}) == len(found)
    assert all(r["label"] in r["labels"] and r["score"] > own[r["label"]] for r in found)
    # no walk can end before it has both telling edges
    assert {tuple(r["pattern"]) for r in found} == {("a -> b", "b -> c")}


def test_top_labels_go_on_until_the_score_has_dropped_often_enough(spark):
    ranked = spark.createDataFrame([(f"l{k:03d}", s) for k, s in enumerate([9.0] * 30 + [8.0] * 20 + [7.0] * 5 + [6.0] * 300)], "label string, score double")
    assert mining.top_labels(ranked).count() == 51
    assert mining.top_labels(ranked, min_groups=0).count() == 22
    assert mining.top_labels(ranked, share=0.5).count() == 177 and mining.top_labels(ranked.limit(3)).count() == 3


def test_labels_seen_by_an_earlier_kept_label_are_skipped(spark):
    rows = [("a", 1, ["a", "b"]), ("b", 2, ["b", "c"]), ("c", 3, ["c", "d"]), ("d", 4, ["d"]), ("e", 5, ["e", "a"])]
    gone = mining._skipped(spark.createDataFrame(rows, "label string, place long, labels array<string>"))
    # a hides b; b being skipped hides nothing, so c stays and hides d
    assert {r["label"] for r in gone.collect()} == {"b", "d"}


def test_a_function_is_a_score(spark):
    edges, vertices = graphs(spark)
    named = mining.mine(edges, vertices, "precision", max_edges=1, k=5).select("pattern", "score").collect()
    assert mining.mine(edges, vertices, SCORES["precision"], max_edges=1, k=5).select("pattern", "score").collect() == named
    flat = mining.mine(edges, vertices, lambda f, o, pf, po: f * 0 + 1, max_edges=1, k=5).collect()
    assert len(flat) == 5 and all(r["score"] == 1 for r in flat)


def test_localisation_dedups_clusters_and_ranks(spark):
    patterns = spark.createDataFrame([(["a -> b"], ["a", "b"], 0.9), (["a -> b"], ["a", "b"], 0.9), (["a -> b", "b -> a"], ["a", "b"], 0.7), (["c -> d"], ["c", "d"], 0.5)], "pattern array<string>, labels array<string>, score double")
    labels = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 1.0), ("d", 0.25)], "label string, score double")
    found = localisation.localize(patterns, labels, 0.05)
    assert found.members.count() == 3 and found.clusters.count() == 2
    scores = {r["label"]: r["score"] for r in found.locations.collect()}
    assert scores["a"] == pytest.approx(0.8 * (2 / 3) ** 0.5) and scores["b"] == pytest.approx(scores["a"] / 2) and scores["c"] == pytest.approx(0.5 * 0.5**0.5)
    with pytest.raises(ValueError):
        localisation.compare({"one": patterns}, labels.select("label"))


def test_chain_of_patterns_with_jumps_sums_to_one(spark):
    patterns = spark.createDataFrame([("p", 0.9), ("q", 0.5)], "pattern string, score double")
    held = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b"), ("q", "c")], "pattern string, label string")
    jumps = spark.createDataFrame([("a", "c"), ("a", "z"), ("b", "a")], "src string, dst string")
    rows = markov.pattern_chain(patterns, held, jumps).collect()
    total = {}
    for r in rows:
        total[r["src"]] = total.get(r["src"], 0) + r["p"]
    assert all(p == pytest.approx(1) for p in total.values()) and {(r["src"], r["dst"]): r["p"] for r in rows}["a", "c"] == 0.5


def test_places_are_those_of_one_sort(spark):
    r = np.random.default_rng(3)
    rows = [(k, float(s)) for k, s in enumerate(r.integers(0, 5, 500))] + [(500, float("nan")), (501, None)]
    got = {x["id"]: x["place"] for x in ranking.with_place(spark.createDataFrame(rows, "id long, score double"), "id").collect()}
    order = sorted(rows, key=lambda x: (-x[1] if x[1] is not None and x[1] == x[1] else float("inf"), x[0]))
    assert got == {k: n for n, (k, _) in enumerate(order, 1)}


@pytest.mark.parametrize("candidates", [7, 256])
def test_no_point_would_make_a_better_medoid(spark, candidates):
    r = np.random.default_rng(1)
    centres = r.normal(0, 10, (4, 3))
    v = np.concatenate([centres[k] + r.normal(0, 1, (n, 3)) for k, n in enumerate((60, 5, 30, 12))])
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    rows = clustering.k_medoids(points, 4, candidates).collect()
    assert len(rows) == len(v)
    clusters = {}
    for x in rows:
        clusters.setdefault(x["medoid"], []).append(x)
    for members in clusters.values():
        ids = [x["id"] for x in members]
        cost = sum(x["distance"] for x in members)
        assert min(np.abs(v[ids] - v[c]).sum() for c in ids) >= cost * (1 - 1e-9)
        assert any(x["distance"] == 0 for x in members)


def matched_by_brute_force(rows, width):
    for fn in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == fn]
        bins = sorted({r[2] for r in mine})
        y = {}
        for r in mine:
            for b in bins:
                d, _, out = min((abs(r[3] - o[3]), o[1], o[4]) for o in mine if o[2] == b)
                if width is None or d < width:
                    y[r[1], b] = out
        for p, q in itertools.permutations(bins, 2):
            both = [y[r[1], p] - y[r[1], q] for r in mine if (r[1], p) in y and (r[1], q) in y]
            if both:
                yield fn, p, q, sum(both) / len(both)


@pytest.mark.parametrize("width", [None, 2.0])
def test_effects_match_every_individual_in_every_bin(spark, width):
    r = np.random.default_rng(2)
    rows = [(f"f{r.integers(0, 2)}", k, int(r.choice([0, 0, 0, 0, 1, 2])), float(r.integers(0, 40)), float(r.integers(0, 2))) for k in range(200)]
    df = spark.createDataFrame(rows, "func_name string, id long, bin int, covariate double, outcome double")
    got = {(x["func_name"], x["bin"], x["other_bin"]): x["effect"] for x in objects.pair_effects(df, width).collect()}
    expected = {(f, p, q): e for f, p, q, e in matched_by_brute_force(rows, width)}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(e) for k, e in expected.items())
    assert all(got[f, p, q] == pytest.approx(-got[f, q, p]) for f, p, q in got)


@pytest.mark.parametrize("v, e", [
    (["a"] * 10, [(k, (k + 1) % 10, "") for k in range(10)]),
    (["a"] * 9, [(i, j, "") for i in range(9) for j in range(9) if i != j]),
    (["a"] * 8, [(i, i ^ b, "") for i in range(8) for b in (1, 2, 4)]),
])
def test_keys_of_alike_vertices_are_whole(v, e):
    r = random.Random(4)
    found = set()
    for _ in range(6):
        to = list(range(len(v)))
        r.shuffle(to)
        found.add(key(v, r.sample([(to[s], to[t], x) for s, t, x in e], len(e))))
    assert len(found) == 1
    two_triangles, hexagon = [(0, 1, ""), (1, 2, ""), (2, 0, ""), (3, 4, ""), (4, 5, ""), (5, 3, "")], [(k, (k + 1) % 6, "") for k in range(6)]
    assert key(["a"] * 6, two_triangles) != key(["a"] * 6, hexagon)


def test_split_join_keeps_every_row(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id", F.lit(1).alias("part"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = join_split(rows, keyed, "k", "n", 5000)
    assert got.count() == 5000 and got.where("least != k").count() == 0 and got.select("id").distinct().count() == 5000


def test_values_and_failures_of_a_stream(spark, tmp_path):
    rows = [(1, 1, "input", "f", "1", ""), (1, 2, "output", "f", "2", ""), (1, 3, "fail", "f", None, "f.go:3"), (1, 4, "input", "f", "3", ""), (1, 5, "fail", "f", None, "f.go:3"), (2, 1, "input", "g", "9", "")]
    schema = "exec_id long, seq long, kind string, func_name string, value string, position string"
    for n in range(2):
        spark.createDataFrame(rows[n * 3 : n * 3 + 3], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    profiles = flows.method_profiles(stream).writeStream.outputMode("complete").format("memory").queryName("profiles").trigger(availableNow=True).start()
    failed = flows.failures(stream.withColumns({"fn_name": F.col("func_name"), "bbid": F.lit(0)})).writeStream.outputMode("append").format("memory").queryName("failed").trigger(availableNow=True).start()
    profiles.awaitTermination()
    failed.awaitTermination()
    assert {tuple(map(str, r)) for r in spark.table("profiles").collect()} == {("1", "f", "['1', '3']", "['2']"), ("2", "g", "['9']", "[]")}
    assert [tuple(r) for r in spark.table("failed").collect()] == [(1, "f.go:3", "f", 0)]


def test_medoids_take_no_distances_between_points(spark):
    """Costs come from bins of coordinates: few rounds and few exact costs, whatever the size of a cluster, and copies and ties end too."""
    r = np.random.default_rng(5)
    v = np.concatenate([r.normal(0, 1, (3000, 4)), np.repeat(r.integers(0, 3, (40, 4)), 10, 0)])
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<float>")
    v = np.array([x["v"] for x in points.orderBy("id").collect()])
    asked = []
    real = clustering._promising

    def counted(*args):
        found = real(*args)
        asked.append(found.count())
        return found

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(clustering, "_promising", counted)
        rows = clustering.k_medoids(points, 3, 64).collect()
    assert len(rows) == len(v) and max(asked) < 300
    for m in range(3):
        ids = [x["id"] for x in rows if x["medoid"] == m]
        cost = sum(x["distance"] for x in rows if x["medoid"] == m)
        assert min(np.abs(v[ids] - v[c]).sum() for c in ids) >= cost * (1 - 1e-9)
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], "id long, v array<double>")
    assert {(x["medoid"], x["distance"]) for x in clustering.k_medoids(same, 2).collect()} == {(0, 0.0)}
    with pytest.raises(Exception, match="one length"):
        clustering.k_medoids(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0, 4.0])], "id long, v array<double>"), 2).collect()
