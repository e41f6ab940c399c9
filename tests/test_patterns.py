"""Patterns against every connected set of edges of small random graphs; what the miner forms and writes on the way."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tracelode.operators import mining
from tracelode.plans import queries, traces


def _connected(edges) -> bool:
    reached, rest = set(edges[0]), list(edges[1:])
    while near := [e for e in rest if reached & set(e)]:
        reached |= {x for e in near for x in e}
        rest = [e for e in rest if e not in near]
    return not rest


@pytest.fixture(scope="module")
def graphs(spark):
    """Edges and vertices of twelve graphs, loops and both directions among them, and the supports of their connected sets."""
    rnd, support = random.Random(7), {n: Counter() for n in range(1, 5)}
    by_graph = {("fail" if g % 3 else "ok", g // 2): {(rnd.choice("abcde"), rnd.choice("abcde")) for _ in range(9)} for g in range(12)}
    edges = [(outcome, g, *e) for (outcome, g), mine in by_graph.items() for e in mine]
    for (outcome, _), mine in by_graph.items():
        for n in support:
            for some in combinations(sorted(mine), n):
                if _connected(some):
                    support[n][tuple(sorted(f"{a} -> {b}" for a, b in some)), outcome] += 1
    e = spark.createDataFrame(edges, "outcome string, graph_id long, src string, dst string").withColumn("traversed", F.lit(1)).localCheckpoint()
    v = e.select("outcome", "graph_id", F.explode(F.array("src", "dst")).alias("label")).distinct().localCheckpoint()
    return e, v, support


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_frequent_patterns_are_all_connected_sets(graphs, n):
    e, _, support = graphs
    found = mining.frequent(e, n, 2).collect()
    assert len({tuple(r["pattern"]) for r in found}) == len(found)
    expected = {p: (k, support[n][p, "ok"]) for (p, o), k in support[n].items() if o == "fail" and k >= 2}
    assert {tuple(r["pattern"]): (r["fail_graphs"], r["ok_graphs"]) for r in found} == expected


def test_each_embedding_arises_once(graphs):
    """Before, a pattern's embeddings arose from each of its parts and were made distinct in a shuffle."""
    e, _, support = graphs
    g = mining.Graphs(e)
    two = g.one_edge(1).localCheckpoint()
    level = g.level(None, 1, two, two.count(), 1)
    for n in (2, 3):
        met = g.met(level, 1, full=True).where("outcome = 'fail'")
        # what is frequent decides which edges there are: those of some failing graph
        assert met.count() == sum(k for (_, o), k in support[n].items() if o == "fail")
        level = g.met(level, 1, full=True)


def test_grown_from_some_patterns_only(graphs):
    """Patterns that grow from several alive ones come once, with their whole support."""
    e, _, support = graphs
    g = mining.Graphs(e)
    one = g.one_edge(2).localCheckpoint()
    some = one.where(F.col("labels")[0] == "a").localCheckpoint()
    names = {r["pattern"][0] for r in some.collect()}
    assert 1 < len(names) < one.count()
    found = g.grown(g.level(None, 1, some, some.count(), 2), some, 2).collect()
    expected = {p: (k, support[2][p, "ok"]) for (p, o), k in support[2].items() if o == "fail" and k >= 2 and names & set(p)}
    assert len(found) == len(expected) and {tuple(r["pattern"]): (r["fail_graphs"], r["ok_graphs"]) for r in found} == expected


def test_best_and_improving_patterns_of_three_edges(graphs):
    e, v, _ = graphs
    rows = {tuple(r["pattern"]): r["score"] for r in mining.mine(e, v, "precision", 3, 2).collect()}
    best = sorted(rows, key=lambda p: (-rows[p], "; ".join(p)))[:7]
    assert [tuple(r["pattern"]) for r in mining.mine(e, v, "precision", 3, 2, k=7).collect()] == best
    kept = {p for p in rows if len(p) == 1}
    for n in (2, 3):
        kept |= {p for p in rows if len(p) == n and any(q in kept and rows[q] < rows[p] for q in combinations(p, n - 1))}
    assert {tuple(r["pattern"]) for r in mining.mine(e, v, "precision", 3, 2, improving=True).collect()} == kept


def _written(monkeypatch) -> Counter:
    names, write = Counter(), mining.staged
    monkeypatch.setattr(mining, "staged", lambda df, name: (names.update([name]), write(df, name))[1])
    return names


def test_compared_miners_share_their_graphs(spark, monkeypatch):
    names = _written(monkeypatch)
    queries.compare_miners(spark, "/root/testdata/sf0.001")
    assert names["edges"] == 1 and names["vertices"] == 1 and names["embeddings"] == 0


def test_improving_patterns_write_no_embeddings(graphs, monkeypatch):
    e, v, _ = graphs
    names = _written(monkeypatch)
    mining.mine(e, v, "precision", 2, improving=True)
    assert names["embeddings"] == 0


def test_embeddings_are_numbers_dealt_by_their_rows(spark, graphs):
    """Before, arrays were made and searched at every pair, and the shuffle partitions said how many tasks a few rows went to, each with its own count of every pattern."""
    e, _, _ = graphs
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "100")
        g = mining.Graphs(e)
        met = g.met(g.first(2), 2, full=True)
        assert g.edges(2).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert not any(kind.startswith("array") for _, kind in met.dtypes) and mining._size(met) == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_passes_of_a_halving_leap_share_their_graphs(graphs, monkeypatch):
    e, v, _ = graphs
    names = _written(monkeypatch)
    mining.halving_leap(e, v, "contrast", 2, 2, k=2)
    assert names["edges"] == 1 and names["rows"] == 1 and names["embeddings"] == 0


def test_miners_read_events_once(spark, monkeypatch):
    """Labels are found from the edges that are written; before, events were shuffled by trace and sorted a second time for them."""
    read, table = Counter(), traces.table
    monkeypatch.setattr(traces, "table", lambda spark, d, name: (read.update([name]), table(spark, d, name))[1])
    queries.halving_leap_patterns(spark, "/root/testdata/sf0.001")
    assert read == {"events": 1}


def test_labels_found_from_edges(spark):
    e, v = (found(spark, "/root/testdata/sf0.001") for found in (traces.edges, traces.vertices))
    g = mining.Graphs(e, traces.labels)
    expected = {tuple(r) for r in mining._part_counts(e, v).collect()}
    assert {tuple(r) for r in g.parts.collect()} == expected and g.parts.count() == len(expected)
    assert g.totals.collect() == mining.graph_totals(v).collect()


def test_two_edges_of_one_name_count_a_graph_once(spark):
    rows = [("ok", 1, "a -> b", "c"), ("ok", 1, "a", "b -> c"), ("ok", 2, "a", "b -> c"), ("fail", 3, "a", "b -> c")]
    g = mining.Graphs(spark.createDataFrame(rows, "outcome string, graph_id long, src string, dst string"), traces.labels)
    assert {tuple(r) for r in g.parts.collect()} == {("a -> b -> c", 2), ("c", 1), ("b -> c", 2)}


def test_traces_shuffle_events_once(spark):
    """The outcome of a trace is found where its events meet; before, it was a second pass that was joined."""
    for found in (traces.edges, traces.vertices):
        plan = found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(graph_id") == 1 and "Join" not in plan
