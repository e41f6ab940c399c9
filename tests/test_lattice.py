"""Mining where labels repeat, against enumeration of all connected edge sets and all their embeddings."""

from __future__ import annotations

import json
import random
from itertools import combinations, permutations

import pytest

from tracelode.functions.patterns import canonical, canonical_order
from tracelode.operators import lattice


def random_graphs(r, n):
    graphs = []
    for g in range(n):
        size = r.randrange(2, 6)
        labels = [r.choice("aab") for _ in range(size)]
        edges = {(r.randrange(size), r.randrange(size), r.choice(["", "x"]) if r.random() < 0.3 else "") for _ in range(r.randrange(1, 6))}
        graphs.append(("fail" if g % 3 else "ok", g, labels, sorted(edges)))
    return graphs


def connected(edges):
    left, seen = list(edges[1:]), set(edges[0][:2])
    while left:
        near = next((e for e in left if e[0] in seen or e[1] in seen), None)
        if near is None:
            return False
        left.remove(near)
        seen |= set(near[:2])
    return True


def embeddings(graphs, max_edges):
    """{pattern: {(graph, m)}} of failing graphs, symmetries included."""
    out = {}
    for outcome, g, labels, edges in graphs:
        if outcome != "fail":
            continue
        for k in range(1, max_edges + 1):
            for part in combinations(edges, k):
                if not connected(part):
                    continue
                vids = sorted({x for e in part for x in e[:2]})
                place = {v: i for i, v in enumerate(vids)}
                v, e = canonical([labels[x] for x in vids], [(place[s], place[t], l) for s, t, l in part])
                key = json.dumps({"v": v, "e": [list(x) for x in e]})
                for m in permutations(vids):
                    if [labels[x] for x in m] == v and {(m[s], m[t], l) for s, t, l in e} == set(part):
                        out.setdefault(key, set()).add((g, m))
    return out


def supports(found, kind):
    out = {}
    for p, rows in found.items():
        if kind == "graphs":
            out[p] = len({g for g, _ in rows})
        elif kind == "image":
            out[p] = min(len({(g, m[k]) for g, m in rows}) for k in range(len(next(iter(rows))[1])))
        else:
            n, seen = 0, set()
            for g, m in sorted(rows):
                n += not any((g, x) in seen for x in m)
                seen |= {(g, x) for x in m}
            out[p] = n
    return out


@pytest.fixture(scope="module")
def tables(spark):
    graphs = random_graphs(random.Random(6), 24)
    vertices = spark.createDataFrame([(o, g, k, x) for o, g, labels, _ in graphs for k, x in enumerate(labels)], "outcome string, graph_id int, vid int, label string")
    edges = spark.createDataFrame([(o, g, *e) for o, g, _, edges in graphs for e in edges], "outcome string, graph_id int, src int, dst int, label string")
    return graphs, vertices, edges


def same_key(p):
    return json.dumps(json.loads(p))


@pytest.mark.parametrize("kind", ["independent", "image", "graphs"])
def test_patterns_with_repeated_labels_match_enumeration(spark, tables, kind):
    graphs, vertices, edges = tables
    expected = supports(embeddings(graphs, 3), kind)
    got = {same_key(r["pattern"]): r["support"] for r in lattice.mine(vertices, edges, "precision", 3, 1, kind).collect()}
    assert got == expected and len(got) > 40
    assert any(n != expected[p] for p, n in supports(embeddings(graphs, 3), "graphs").items()) or kind == "graphs"


def test_scores_and_the_best_few(spark, tables):
    graphs, vertices, edges = tables
    expected = supports(embeddings(graphs, 2), "independent")
    ok = [(labels, es) for o, _, labels, es in graphs if o == "ok"]
    total = len(graphs)
    scores = {}
    for p, n in expected.items():
        v, e = json.loads(p)["v"], json.loads(p)["e"]
        parts = sum(labels.count(x) for labels, _ in ok for x in v) + sum((labels[s], l, labels[t]) == (v[a], x, v[b]) for labels, es in ok for s, t, l in es for a, b, x in e)
        f, o = n / total, parts / total / (len(v) + len(e))
        scores[p] = f / (f + o)
    got = {same_key(r["pattern"]): r["score"] for r in lattice.mine(vertices, edges, "precision", 2, 1).collect()}
    assert got.keys() == scores.keys() and all(abs(got[p] - s) < 1e-12 for p, s in scores.items())
    best = [r["score"] for r in lattice.mine(vertices, edges, "precision", 2, 1, k=5).collect()]
    assert best == sorted(got.values(), reverse=True)[:5]


def test_canonical_order_says_where_vertices_went():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(1, 6)
        v, e = [r.choice("ab") for _ in range(n)], sorted({(r.randrange(n), r.randrange(n), r.choice("xy")) for _ in range(r.randrange(1, 7))})
        (cv, ce), order = canonical_order(v, e)
        place = {k: p for p, k in enumerate(order)}
        assert cv == [v[k] for k in order] and ce == sorted((place[s], place[t], x) for s, t, x in e)


def test_odd_graphs(spark):
    shape = "outcome string, graph_id string, vid string, label string", "outcome string, graph_id string, src string, dst string"
    vertices = spark.createDataFrame([("fail", "g", "p", 'quote " and \\ é'), ("fail", "g", "q", 'quote " and \\ é'), ("ok", "h", "p", "z")], shape[0])
    edges = spark.createDataFrame([("fail", "g", "p", "q"), ("fail", "g", "q", "p"), ("fail", "g", "p", "p"), ("fail", "g", "p", "q")], shape[1])
    got = lattice.mine(vertices, edges, max_edges=3, min_support=1, kind="image").collect()
    assert sorted((len(r["v"]), len(r["e"]), r["support"]) for r in got) == [(1, 1, 1), (2, 1, 2), (2, 2, 1), (2, 2, 1), (2, 2, 2), (2, 3, 1)]
    assert lattice.mine(vertices.limit(0), edges.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lattice.mine(vertices, edges, kind="none")
