"""Data flow against the textbook's iteration over sets."""

from __future__ import annotations

import random

import pytest

from tracelode.operators import dataflow

KEYS = "abc"


def graphs(n_graphs=12, n=7, seed=3):
    r = random.Random(seed)
    for k in range(n_graphs):
        edges = sorted({(s, r.choice(range(n))) for s in range(n) for _ in range(2) if r.random() < 0.8} | {(0, 1)})
        gen = {(b, r.choice(KEYS), b) for b in range(n) if r.random() < 0.6}
        kill = {(b, key) for b, key, _ in gen} | {(b, r.choice(KEYS)) for b in range(n) if r.random() < 0.3}
        derive = {(b, *r.sample(KEYS, 2)) for b in range(n) if r.random() < 0.4}
        yield f"f{k}", edges, gen, kill, derive


def iterate(edges, gen, kill, derive, meet, forward, n=7):
    """What enters each node, from the greatest or least sets on until nothing changes."""
    flow = edges if forward else [(d, s) for s, d in edges]
    nodes = sorted({x for e in edges for x in e})
    every = {(key, v) for _, key, v in gen}
    before = {b: [s for s, d in flow if d == b] for b in nodes}
    starts = {b for b in nodes if not before[b]} | ({0} if forward else set())
    into = {b: set(every) if meet == "intersection" else set() for b in nodes}

    def out(b):
        made = {(m, v) for c, key, m in derive if c == b for k2, v in into[b] if k2 == key}
        return {(key, v) for c, key, v in gen if c == b} | {x for x in into[b] if (b, x[0]) not in kill} | made

    while True:
        new = {}
        for b in nodes:
            sets = [out(s) for s in before[b]] + ([set()] if b in starts else [])
            new[b] = set.union(*sets) if meet == "union" else set.intersection(*sets)
        if new == into:
            return into
        into = new


def reached(edges, forward):
    flow = edges if forward else [(d, s) for s, d in edges]
    nodes = {x for e in edges for x in e}
    seen = {b for b in nodes if b not in {d for _, d in flow}} | ({0} if forward else set())
    while more := {d for s, d in flow if s in seen} - seen:
        seen |= more
    return seen


@pytest.mark.parametrize("meet,forward,copies", [("union", True, True), ("union", False, False), ("intersection", True, False), ("intersection", False, False)])
def test_solve_matches_iteration(spark, meet, forward, copies):
    data = list(graphs())
    edges = spark.createDataFrame([(f, *e) for f, es, *_ in data for e in es] + [(None, 0, 1), ("f0", None, 1)], "fn string, src int, dst int")
    gen = spark.createDataFrame([(f, *g) for f, _, gs, *_ in data for g in gs] + [("f0", 0, None, 1)], "fn string, node int, key string, value int")
    kill = spark.createDataFrame([(f, *k) for f, _, _, ks, _ in data for k in ks], "fn string, node int, key string")
    derive = spark.createDataFrame([(f, *x) for f, *_, xs in data for x in xs], "fn string, node int, key string, made string") if copies else None
    got = {tuple(r) for r in dataflow.solve(edges, gen.unionByName(gen), kill, derive, forward, meet).collect()}
    expected, compared = set(), set()
    for f, es, gs, ks, xs in data:
        into = iterate(es, gs, ks, xs if copies else set(), meet, forward)
        known = reached(es, forward) if meet == "intersection" else set(into)
        compared |= {(f, b) for b in known}
        expected |= {(f, b, *x) for b in known for x in into[b]}
    assert {x for x in got if x[:2] in compared} == expected and expected


def test_analyses_of_a_loop(spark):
    # 0: x = fresh, 1: loop head, 2: y = x, 3: x = fresh, uses y
    edges = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 1), ("f", 1, 3)], "fn string, src int, dst int")
    defs = spark.createDataFrame([("f", 0, "x"), ("f", 3, "x")], "fn string, bbid int, name string")
    copies = spark.createDataFrame([("f", 2, "y", "x")], "fn string, bbid int, name string, source string")
    uses = spark.createDataFrame([("f", 2, "x"), ("f", 3, "y")], "fn string, bbid int, name string")
    all_defs = defs.unionByName(copies.drop("source"))
    assert {tuple(r)[1:] for r in dataflow.live_names(edges, uses, all_defs).collect()} == {(0, "x"), (0, "y"), (1, "x"), (1, "y"), (2, "x"), (2, "y")}
    assert {tuple(r)[1:] for r in dataflow.assigned_names(edges, all_defs).collect()} == {(1, "x"), (2, "x"), (3, "x")}
    assert {tuple(r)[1:] for r in dataflow.value_origins(edges, defs, copies).collect()} == {(1, "x", 0), (2, "x", 0), (3, "x", 0), (1, "y", 0), (2, "y", 0), (3, "y", 0)}


def test_no_edges(spark):
    edges = spark.createDataFrame([], "fn string, src int, dst int")
    defs = spark.createDataFrame([("f", 0, "x")], "fn string, bbid int, name string")
    assert dataflow.reaching_definitions(edges, defs).count() == 0 and dataflow.assigned_names(edges, defs).count() == 0


def test_bad_arguments(spark):
    edges = spark.createDataFrame([], "fn string, src int, dst int")
    gen = spark.createDataFrame([], "fn string, node int, key string, value int")
    with pytest.raises(ValueError):
        dataflow.solve(edges, gen, meet="most")
    with pytest.raises(ValueError):
        dataflow.solve(edges, gen, derive=gen, meet="intersection")


def test_reaching_definitions(spark):
    edges = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 1), ("f", 2, 3)], "fn string, src int, dst int")
    defs = spark.createDataFrame([("f", 0, "x"), ("f", 2, "x"), ("f", 0, "y")], "fn string, bbid int, name string")
    got = {(r["bbid"], r["name"], r["def_bbid"]) for r in dataflow.reaching_definitions(edges, defs).collect()}
    assert got == {(1, "x", 0), (1, "x", 2), (1, "y", 0), (2, "x", 0), (2, "x", 2), (2, "y", 0), (3, "x", 2), (3, "y", 0)}


@pytest.mark.parametrize("meet,copies", [("union", True), ("intersection", False)])
def test_large_functions_are_solved_by_joins_and_others_in_a_call(spark, monkeypatch, meet, copies):
    data = list(graphs(8))
    frame = lambda k, schema: spark.createDataFrame([(x[0], *r) for x in data for r in x[k]], schema)
    parts = [frame(1, "fn string, src int, dst int"), frame(2, "fn string, node int, key string, value int"), frame(3, "fn string, node int, key string"), frame(4, "fn string, node int, key string, made string") if copies else None]
    called = []
    real = dataflow._solve_rows
    monkeypatch.setattr(dataflow, "_solve_rows", lambda *args: called.append(1) or real(*args))
    found = []
    for whole in (10_000, sorted(sum(map(len, x[1:])) for x in data)[4], 0):
        monkeypatch.setattr(dataflow, "WHOLE", whole)
        found.append(sorted(map(tuple, dataflow.solve(*parts, meet=meet).collect())))
    assert found[0] == found[1] == found[2] and found[0] and len(called) == 2
