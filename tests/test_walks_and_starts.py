"""Label walks against matrix powers, and embeddings from every start."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tracelode.operators import embeddings as emb
from tracelode.operators import walk_similarity as ws


def matrix(labels, vertices, edges):
    """Labels times all powers, up to the number of vertices, of the graph whose nodes are vertices and edges."""
    n, m = len(vertices), len(edges)
    names = [*vertices, *(l for *_, l in edges)]
    step = np.zeros((n + m, n + m))
    for k, (s, t, _) in enumerate(edges):
        step[s, n + k] = step[n + k, t] = 1
    power, found = np.eye(n + m), np.zeros((n + m, n + m))
    for _ in range(n):
        power = np.minimum(power @ step, 1)
        found = np.maximum(found, power)
    at = np.array([[float(x == l) for x in names] for l in labels]).reshape(len(labels), n + m)
    return at @ found @ at.T


def test_walk_matrices_match_powers(spark):
    r = random.Random(2)
    graphs = {}
    for g in range(8):
        n = r.randrange(1, 7)
        edges = [(s, t, r.choice(["", "x", "a"])) for s in range(n) for t in range(n) if r.random() < 0.3]
        graphs[g] = ([r.choice("ab") for _ in range(n)], edges + edges[:1])
    graphs[8] = (["a"], [])
    v = spark.createDataFrame([(g, k, l) for g, (vs, _) in graphs.items() for k, l in enumerate(vs)], "graph_id long, vid int, label string")
    e = spark.createDataFrame([(g, *x) for g, (_, es) in graphs.items() for x in es], "graph_id long, src int, dst int, label string")
    got = {(x["graph_id"], x["l1"], x["l2"]): x["w"] for x in ws.walk_matrix(v, e).collect()}
    labels = ["", "a", "b", "x"]
    expected = {(g, labels[i], labels[j]): w for g, x in graphs.items() for (i, j), w in np.ndenumerate(matrix(labels, *x)) if w}
    assert got == expected and len(expected) > 20
    pairs = spark.createDataFrame([*itertools.combinations(range(9), 2), (1, 1), (1, 1)], "a long, b long")
    for x in ws.matrix_distances(pairs, v, e).collect():
        a, b = graphs[x["a"]], graphs[x["b"]]
        mine = sorted({l for vs, es in (a, b) for l in [*vs, *(y for *_, y in es)]})
        d = matrix(mine, *a) - matrix(mine, *b)
        assert x["distance"] == pytest.approx(np.sqrt(np.linalg.norm(d * d) / len(mine) ** 2))
        assert x["a"] != x["b"] or x["distance"] == 0


def test_starts_give_the_same_embeddings(spark):
    r = random.Random(4)
    vs = [("ok", g, k, r.choice("aaaab")) for g in range(5) for k in range(7)]
    es = [("ok", g, s, t, "") for g in range(5) for s in range(7) for t in range(7) if r.random() < 0.3]
    v = spark.createDataFrame(vs, "outcome string, graph_id int, vid int, label string")
    e = spark.createDataFrame(es, "outcome string, graph_id int, src int, dst int, label string")
    pattern = (["a", "a", "b"], [(0, 1, ""), (1, 2, ""), (0, 2, "")])
    plain = sorted((x["graph_id"], tuple(x["m"])) for x in emb.embeddings(pattern, v, e).collect())
    sizes = {}
    for start in emb.STARTS:
        assert sorted((x["graph_id"], tuple(x["m"])) for x in emb.embeddings(pattern, v, e, start).collect()) == plain
        steps = sorted(emb.join_sizes(pattern, v, e, start).collect())
        assert [x["step"] for x in steps] == [1, 2, 3] and steps[-1]["rows"] == len(plain)
        sizes[start] = sum(x["rows"] for x in steps)
    assert plain and sizes["least_frequent"] <= sizes["most_frequent"]
    with pytest.raises(ValueError):
        emb.embeddings(pattern, v, e, "last")


def test_start_vertices():
    pattern = (["a", "b", "c"], [(0, 1, ""), (1, 2, "")])
    known = ({"a": 5, "b": 9, "c": 2}, {("a", "b", ""): (4, 3), ("b", "c", ""): (2, 2)})
    found = {m: emb.start_vertex(pattern, known, m) for m in emb.STARTS if m != "random"}
    assert found == {"least_frequent": 2, "most_frequent": 1, "least_connected": 0, "most_connected": 1, "fewest_extensions": 2, "most_extensions": 1, "lowest_cardinality": 2, "highest_cardinality": 1}
    assert emb.start_vertex(pattern, known, "random", 1) == emb.start_vertex(pattern, known, "random", 1)


def test_large_graphs_are_measured_by_joins_and_others_whole(spark, monkeypatch):
    r = random.Random(4)
    sizes = (1, 3, 6, 9, 12)
    v = spark.createDataFrame([(str(g), k, r.choice("abc")) for g, n in enumerate(sizes) for k in range(n)] + [("1", None, "a")], "graph_id string, vid int, label string")
    e = spark.createDataFrame([(str(g), s, t, r.choice(["", "a"])) for g, n in enumerate(sizes) for s in range(n) for t in range(n) if r.random() < 0.25] + [("1", 0, None, ""), ("2", 5, 77, "z")], "graph_id string, src int, dst int, label string")
    pairs = spark.createDataFrame([(str(a), str(b)) for a, b in itertools.product(range(6), repeat=2)], "a string, b string")
    joined = []
    real = ws.reach
    monkeypatch.setattr(ws, "reach", lambda *args: joined.append(1) or real(*args))
    found = []
    for whole in (1000, 20, 0):
        monkeypatch.setattr(ws, "WHOLE", whole)
        found.append({(x["a"], x["b"]): x["distance"] for x in ws.matrix_distances(pairs, v, e).collect()})
    assert len(found[0]) == 36 and found[1] == pytest.approx(found[0]) and found[2] == pytest.approx(found[0]) and len(joined) == 2


def test_modes_with_one_order_share_a_search(spark, monkeypatch):
    v = spark.createDataFrame([("ok", 1, k, l) for k, l in enumerate("abcab")], "outcome string, graph_id int, vid int, label string")
    e = spark.createDataFrame([("ok", 1, k, k + 1, "") for k in range(4)], "outcome string, graph_id int, src int, dst int, label string")
    searched = []
    real = emb._partial
    monkeypatch.setattr(emb, "_partial", lambda pattern, order, typed: searched.append(order) or real(pattern, order, typed))
    found = {x["mode"]: (x["vertex"], x["embeddings"]) for x in emb.starts((["a", "b", "c"], [(0, 1, ""), (1, 2, "")]), v, e, emb.STARTS[1:]).collect()}
    assert set(found) == set(emb.STARTS[1:]) and {n for _, n in found.values()} == {1} and len(searched) <= 2
