"""Leaps against the plain search and against their definition; places and groups of ties by ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import mining, ranking


@pytest.fixture(scope="module")
def profiles(spark):
    """Graphs in which A -> B -> C always come together, so that each part leaps to the whole."""
    r = random.Random(2)
    edges = []
    for g in range(40):
        outcome = "fail" if g % 2 else "ok"
        mine = {("A", "B"), ("B", "C")} if outcome == "fail" or g % 3 else set()
        mine |= {(a, b) for a, b in (("C", "D"), ("A", "D"), ("D", "E"), ("E", "A"), ("B", "F"), ("F", "G")) if r.random() < (0.6 if outcome == "fail" else 0.3)}
        edges += [(outcome, f"g{g}", a, b) for a, b in mine]
    e = spark.createDataFrame(edges, "outcome string, graph_id string, src string, dst string")
    v = e.select("outcome", "graph_id", F.explode(F.array("src", "dst")).alias("label")).distinct()
    return e, v


def best(df):
    return [(tuple(r["pattern"]), round(r["score"], 12)) for r in df.orderBy(F.desc("score"), F.array_join("pattern", "; ")).collect()]


def test_leaps_follow_their_definition(spark, profiles):
    edges, vertices = profiles
    sigma = 0.05
    stats, plain = {}, {}
    got = mining.leap(edges, vertices, "precision", 2, 2, k=100, sigma=sigma, stats=stats)
    everything = {tuple(r["pattern"]): r for r in mining.mine(edges, vertices, "precision", 2, 2, stats=plain).collect()}
    ok = {}
    for part, n in mining._part_counts(edges, vertices).collect():
        ok[part] = n
    o = lambda r: sum(ok.get(x, 0) for x in [*r["pattern"], *r["labels"]]) / (len(r["pattern"]) + len(r["labels"]))
    near = lambda a, b: a + b == 0 or 2 * (a - b) / (a + b) < sigma
    gone = set()
    for p, kid in everything.items():
        if len(p) == 2:
            parents = sorted(((x,) for x in p if (x,) in everything), key=lambda x: (-everything[x]["score"], "; ".join(x)))
            gone |= {x for x in parents[1:] if near(everything[x]["fail_graphs"], kid["fail_graphs"]) and near(o(everything[x]), o(kid)) and kid["score"] >= everything[x]["score"]}
    assert {tuple(r["pattern"]) for r in got.collect()} == {p for p in everything if p not in gone} and gone and stats["leapt"] == len(gone)


def test_leaps_change_the_result(spark, profiles):
    edges, vertices = profiles
    leapt = best(mining.leap(edges, vertices, "precision", 3, 2, k=200, sigma=0.3))
    plain = best(mining.mine(edges, vertices, "precision", 3, 2, k=200))
    assert set(leapt) < set(plain) and leapt[0] == plain[0]


def test_halved_rounds_prune_the_last_pass(spark):
    """P -> Q -> R scores more than Q -> R alone; known from the start, it rules out what Y -> Z could grow to."""
    edges = [("fail", f"f{g}", a, b) for g in range(20) for a, b in [("P", "Q"), ("Q", "R"), *([("Y", "Z")] if g < 16 else [])]]
    edges += [("ok", f"o{g}", a, b) for g in range(20) for a, b in [("S", "R"), *([("Y", "Z")] if g < 3 else [])]]
    e = spark.createDataFrame(edges, "outcome string, graph_id string, src string, dst string")
    v = e.select("outcome", "graph_id", F.explode(F.array("src", "dst")).alias("label")).distinct()
    started, plain = {}, {}
    got = best(mining.halving_leap(e, v, "contrast", 2, 2, k=2, stats=started))
    assert got == best(mining.mine(e, v, "contrast", 2, 2, k=2, stats=plain))
    assert [p for p, _ in got] == [("P -> Q",), ("P -> Q", "Q -> R")]
    assert (started["extended"], plain["extended"]) == (2, 3)


@pytest.mark.parametrize("n", ["1", "7"])
def test_groups_of_ties_by_ranges(spark, n):
    r = random.Random(1)
    scores = [r.choice([0.5, 0.25, float("nan"), None, *(r.random() for _ in range(30))]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(scores)), "id int, score double").withColumns({"order_key": F.lit(1), "part_of_range": F.lit(2), "row_of_order": F.lit(3)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {x["id"]: (x["score_group"], x["size"], x["before"], x["mid_rank"]) for x in ranking.with_groups(df).collect()}
        placed = {x["id"]: x["place"] for x in ranking.with_place(df, "id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda s: float("inf") if s is None or s != s else -s
    keys = [key(s) for s in scores]
    order = sorted(set(keys))
    assert got == {i: (order.index(k) + 1, keys.count(k), sum(x < k for x in keys), sum(x < k for x in keys) + keys.count(k) / 2) for i, k in enumerate(keys)}
    assert placed == {i: p for p, i in enumerate(sorted(range(400), key=lambda i: (keys[i], i)), 1)}
