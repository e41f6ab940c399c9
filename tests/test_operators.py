"""Hand-sized goldens: formats, scores, chains, clusters, medoids, graphs, inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.functions import scores
from tracelode.operators import cfg, clustering, components, markov, minimise, mining, objects, points, ranking, support
from tracelode.sources import dot, faults, simple

PATHS = {"g1": ("fail", "ABC"), "g2": ("fail", "ABD"), "g3": ("ok", "AC"), "g4": ("ok", "AD"), "g5": ("ok", "AB")}


@pytest.fixture(scope="module")
def vertices(spark):
    return spark.createDataFrame([(o, g, x) for g, (o, p) in PATHS.items() for x in ["entry", *p]], "outcome string, graph_id string, label string")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(o, g, s, d, 1) for g, (o, p) in PATHS.items() for s, d in zip(["entry", *p], p, strict=False)]
    return spark.createDataFrame(rows, "outcome string, graph_id string, src string, dst string, traversed long")


GOLDEN = {
    "A": (-0.1, -0.125, -1 / 6, -0.129099, 0.4, 0.5, 1 / 3, 0.266667, 0.516398, -0.2, -1 / 6, None, -0.086592),
    "B": (1 / 6, 1 / 6, 0, 1 / 6, 2 / 3, 2 / 3, 0.5, 0.444444, 2 / 3, 0.2, 0.25, 0.166660, -0.033937),
    "C": (0, 0, -0.25, 0, 0.5, 0.4, 0.25, 1 / 6, 0.408248, 0, 0, -0.166660, -0.115641),
}


@pytest.mark.parametrize(("k", "name"), list(enumerate(scores.SCORES)))
def test_scores(vertices, k, name):
    got = {r["label"]: r["score"] for r in support.with_score(support.label_support(vertices), name).collect()}
    for label, golden in GOLDEN.items():
        if golden[k] is None:
            assert got[label] < -10_000
        else:
            assert got[label] == pytest.approx(golden[k], abs=2e-6)


def test_score_names_and_true_priors(vertices):
    assert scores.score("rf1") is scores.SCORES["relative_f1"]
    with pytest.raises(KeyError):
        scores.score("none")
    r = support.with_score(support.label_support(vertices), "rp", true_prior=True).where("label = 'B'").first()
    assert r["score"] == pytest.approx(2 / 3 - 0.4)


def test_ieee_division(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 2.0), (float("nan"), 0.0)], "a double, b double")
    got = [r[0] for r in df.select(scores.ieee_div(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(got[0]) and got[1:4] == [math.inf, -math.inf, 0.5] and math.isnan(got[4])


def test_pattern_scores(edges, vertices):
    found = {tuple(r["pattern"]): (r["fail_graphs"], r["score"]) for r in mining.mine(edges, vertices, "precision", max_edges=2).collect()}
    assert found["A -> B",] == (2, pytest.approx(0.545455, abs=1e-6))
    assert found["A -> B", "entry -> A"] == (2, pytest.approx(0.476190, abs=1e-6))
    assert ("B -> C",) not in found


def test_top_k_is_the_head_of_all_patterns(edges, vertices):
    every = mining.mine(edges, vertices, "precision", max_edges=3, min_fails=1).collect()
    best = sorted(every, key=lambda r: (-r["score"], "; ".join(r["pattern"])))[:4]
    top = mining.mine(edges, vertices, "precision", max_edges=3, min_fails=1, k=4).collect()
    assert [tuple(r["pattern"]) for r in top] == [tuple(r["pattern"]) for r in best]
    with pytest.raises(ValueError):
        mining.mine(edges, vertices, max_edges=0)


def test_walks_climb_and_repeat(edges, vertices):
    a, b = (sorted(map(tuple, mining.walks(edges, vertices, 5, "precision", min_fails=1, seed=4).select("walk", F.array_join("pattern", ";"), "score").collect())) for _ in range(2))
    assert a == b and len(a) == 5


def test_leap_finds_the_best_pattern(edges, vertices):
    assert mining.leap(edges, vertices, "precision", max_edges=2, k=1).first()["pattern"] == ["A -> B"]


def test_labels_made_unique(spark):
    v = spark.createDataFrame([("ok", "g", 0, "a"), ("ok", "g", 1, "a"), ("ok", "h", 0, "a")], "outcome string, graph_id string, vid int, label string")
    assert not mining.labels_unique(v).first()[0]
    assert mining.labels_unique(mining.with_unique_labels(v)).first()[0]


def test_ranking(spark, vertices):
    ranked = support.with_score(support.label_support(vertices), "precision").select("label", "score")
    groups = {r["label"]: (r["score_group"], r["mid_rank"]) for r in ranking.with_groups(ranked).collect()}
    assert groups == {"B": (1, 0.5), "C": (2, 2.0), "D": (2, 2.0), "entry": (3, 4.0), "A": (3, 4.0)}
    of = lambda *labels: spark.createDataFrame([(x,) for x in labels], "label string")
    assert ranking.rank_eval(ranked, of("B"), "label").first()[0] == 0.5
    assert ranking.rank_eval(ranked, of("C"), "label").first()[0] == 2
    assert ranking.hit_rank_eval(ranked, of("C"), "label").first().asDict() == {"rank": 1 + 3 / 2, "score_group": 2}
    assert ranking.hit_rank_eval(ranked, of("Z"), "label").first().asDict() == {"rank": math.inf, "score_group": -1}
    nan = spark.createDataFrame([("x", float("nan")), ("y", -5.0)], "label string, score double")
    assert ranking.top_k(nan, 1).first()["label"] == "y"
    line = ranking.result_lines(spark.createDataFrame([("m", "e", math.inf, 0.5)], "method string, eval string, rank double, score double")).first()[0]
    assert '"rank":-1.0' in line


# -- sources


def graph_text():
    return 'start-graph\nvertex\t0, "entry", 0, "entry", "<none>", "0s"\nvertex\t1, "A, \\"q\\" blk 0", 0, "A", "m.go:1:1"\n\nedge\t0, 1, 3\nend-graph\nstart-graph\nvertex\t0, "entry", 0, "entry", "<none>", "0s"\nedge\t0, 0, 1\nend-graph\n'


def test_simple_format(spark, tmp_path):
    import gzip

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text(graph_text())
    (tmp_path / "in" / "deep" / "b.txt").write_text("nonsense")
    with gzip.open(tmp_path / "in" / "c.txt.gz", "wt") as f:
        f.write(graph_text())
    v, e = simple.read(spark, str(tmp_path / "in"), "fail")
    assert v.count() == 6 and e.count() == 4
    assert {r["dst"] for r in e.collect()} == {'A, "q" blk 0', "entry"}
    assert simple.location_info(v).where("label = 'entry'").first()["position"] == "<none>"
    simple.write(v, e, str(tmp_path / "out"))
    v2, e2 = simple.read(spark, str(tmp_path / "out"), "fail")
    assert sorted(map(tuple, e2.select("src", "dst", "traversed").collect())) == sorted(map(tuple, e.select("src", "dst", "traversed").collect()))
    assert v2.count() == 6


@pytest.mark.parametrize("line", ["vertex\t0, a", 'vertex\t0, "a, 0, "b", "c"', "what\tx", "edge\t0, 1", "vertex\t0, \\"])
def test_malformed_lines_are_errors(line):
    with pytest.raises(ValueError):
        list(simple.parse(f"start-graph\n{line}\nend-graph\n"))


def test_tokens():
    assert simple.tokens('1, "a,b", "c\\"d", x') == ["1", '"a,b"', '"c\\"d"', "x"]


def test_edge_of_an_undeclared_vertex_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("start-graph\nedge\t0, 9, 1\nend-graph\n")
    with pytest.raises(Exception, match="undeclared"):
        simple.read(spark, str(tmp_path), "ok")[1].collect()


def test_dot_format(spark, tmp_path):
    text = 'digraph {\n // note\n node [shape=box];\n 0 [label="entry", bbid=0];\n 1 [label="A \\"x\\"", fn_name="A", bbid=2, position="m.go:1"];\n subgraph c { 7; 8 -> 9; }\n 0 -> 1 [traversed=4];\n 1 -> z -> -3;\n rank=same;\n}\ndigraph b { a -> b }\n'
    (tmp_path / "p.dot").write_text(text)
    v, e = dot.read(spark, str(tmp_path), "ok")
    assert {(r["label"], r["bbid"]) for r in v.collect()} == {("entry", 0), ('A "x"', 2), ("z", 0), ("-3", 0), ("a", 0), ("b", 0)}
    assert {(r["src"], r["dst"], r["traversed"]) for r in e.collect()} == {("entry", 'A "x"', 4), ('A "x"', "z", 1), ("z", "-3", 1), ("a", "b", 1)}
    again = tmp_path / "again"
    dot.lines(v, e).select("value").write.text(str(again))
    assert dot.read(spark, str(again), "ok")[1].count() == 4


def test_faults(spark, tmp_path):
    line = '{"Type":"branch","Mutation":"x ---> !x","FnName":"B","BasicBlockId":1,"SrcPosition":{"Filename":"m.go","Offset":0,"Line":5,"Column":1}}'
    (tmp_path / "m.json").write_text(f"{line}\n\n{line}\n")
    assert [tuple(r) for r in faults.faults(spark, str(tmp_path / "m.json")).collect()] == [("m.go:5:1", "B", 1)]
    back = points.exported(faults.mutations(spark, str(tmp_path / "m.json"))).first()[0]
    assert back == line
    (tmp_path / "l.txt").write_text("org/x/Foo.java#42#text\n\norg/x/Foo.java#42\n")
    assert [tuple(r) for r in faults.line_faults(spark, str(tmp_path / "l.txt")).collect()] == [("org/x/Foo.java:42", "", 0)]
    assert spark.range(1).select(faults.source_position(F.lit("org.x.Foo#42"))).first()[0] == "org/x/Foo.java:42"
    (tmp_path / "bad.txt").write_text("a#b\n")
    with pytest.raises(Exception, match="no line number"):
        faults.line_faults(spark, str(tmp_path / "bad.txt")).collect()


def test_object_profiles(spark, tmp_path):
    text = '{"Types":[]}\n{"FuncName":"m.f","In":[[{"Name":"x","Val":{"Val":3,"JSONType":"IntValue"}}]],"Out":[[{"Name":"r","Val":{"Val":true,"JSONType":"BoolValue"}}]]}\n'
    (tmp_path / "o").write_text(text)
    r = faults.object_profiles(spark, str(tmp_path / "o")).select("func_name", F.variant_get(F.col("inputs")[0][0]["Val"], "$.Val", "int").alias("x")).first()
    assert (r["func_name"], r["x"]) == ("m.f", 3)


# -- chains


def test_chain_and_hitting_times(spark):
    ranked = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.5)], "label string, score double")
    chain = markov.ranked_chain(ranked)
    got = {(r["src"], r["dst"]): r["p"] for r in chain.collect()}
    assert got["g0", "g0"] == pytest.approx(1 / 4) and got["g0", "g1"] == pytest.approx(1 / 4) and got["g1", "g1"] == pytest.approx(1 / 4)
    assert got["a", "g0"] == 1 and got["g0", "a"] == 0.5 and got["g1", "b"] == 0.25
    sums = {}
    for (s, _), p in got.items():
        sums[s] = sums.get(s, 0) + p
    assert all(x == pytest.approx(1) for x in sums.values())
    times = {r["state"]: r["hitting_time"] for r in markov.hitting_times(chain).collect()}
    names = sorted({x for k in got for x in k})
    p = np.array([[got.get((s, d), 0.0) for d in names] for s in names])
    for t in names:
        if t == "g0":
            continue
        keep = [k for k, s in enumerate(names) if s != t]
        h = np.linalg.solve(np.eye(len(keep)) - p[np.ix_(keep, keep)], np.ones(len(keep)))
        assert times[t] == pytest.approx(h[keep.index(names.index("g0"))])
    sampled = {r["state"]: r["hitting_time"] for r in markov.sampled_hitting_times(chain, n_walks=400, seed=2).collect()}
    assert sampled["b"] == pytest.approx(times["b"], rel=0.25)
    fault = spark.createDataFrame([("b",)], "label string")
    assert markov.hitting_rank(markov.hitting_times(chain), fault).first()[0] == 2


def test_walks_tell_late_states_apart(spark):
    rows = [("g0", "g0", 0.99995), ("g0", "a", 0.00005), ("a", "a", 0.99995), ("a", "b", 0.00005), ("b", "g0", 1.0)]
    chain = spark.createDataFrame(rows, "src string, dst string, p double")
    times = {r["state"]: r["hitting_time"] for r in markov.sampled_hitting_times(chain, seed=3).collect()}
    assert times["g0"] == 0 and abs(times["a"] - 20_000) < 4000 and abs(times["b"] - 40_000) < 6000


def test_large_chains_are_sampled_for_ranks(spark, monkeypatch):
    rows = [("g0", "x", 0.5), ("g0", "y", 0.5), ("x", "g0", 1.0), ("y", "z", 1.0), ("z", "g0", 1.0)]
    chain = spark.createDataFrame(rows, "src string, dst string, p double")
    exact = {r["state"]: r["hitting_time"] for r in markov.any_hitting_times(chain).collect()}
    monkeypatch.setattr(markov, "EXACT_STATES", 3)
    found = {r["state"]: r["hitting_time"] for r in markov.any_hitting_times(chain).collect()}
    assert found.keys() == exact.keys() and found != exact and all(abs(found[s] - exact[s]) < 0.5 for s in exact)


def test_unreachable_states_take_forever(spark):
    chain = spark.createDataFrame([("g0", "a", 1.0), ("a", "g0", 1.0), ("x", "g0", 1.0)], "src string, dst string, p double")
    assert {r["state"]: r["hitting_time"] for r in markov.hitting_times(chain).collect()}["x"] == math.inf


def test_jump_rows_are_sub_stochastic_until_renormalised(spark):
    ranked = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "label string, score double")
    chain = markov.ranked_chain(ranked, 0.5, spark.createDataFrame([("a", "zz")], "src string, dst string"))
    total = lambda c: c.where("src = 'a'").agg(F.sum("p")).first()[0]
    assert total(chain) == 0.5 and total(markov.renormalise(chain)) == 1


# -- clusters


def test_clusters(spark):
    sets = spark.createDataFrame([(1, ["1", "2", "3"], 0.9), (2, ["1", "2", "3", "4"], 0.7), (3, ["9"], 0.4)], "id long, items array<string>, score double")
    assert {r["id"]: r["cluster"] for r in clustering.cluster(sets, 0.25).collect()} == {1: 1, 2: 1, 3: 3}
    members = sets.join(clustering.cluster(sets, 0.25), "id")
    assert {r["cluster"]: r["score"] for r in clustering.cluster_scores(members).collect()} == {1: pytest.approx(0.653197, abs=1e-6), 3: pytest.approx(0.282843, abs=1e-6)}


@pytest.mark.parametrize("epsilon", [0.0, 0.2, 0.5, 0.9])
def test_similar_pairs_match_all_pairs(spark, epsilon):
    r = random.Random(8)
    sets = {k: sorted({r.choice("abcdefghij") for _ in range(r.randint(1, 8))}) for k in range(60)}
    got = {(x["a"], x["b"]) for x in clustering.similar_pairs(spark.createDataFrame(list(sets.items()), "id long, items array<string>"), epsilon).collect()}
    distance = lambda a, b: 1 - len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(a, b) for a in sets for b in sets if a < b and distance(sets[a], sets[b]) <= epsilon + 1e-12}


def test_components_do_not_depend_on_order(spark):
    r = random.Random(1)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)]
    root = list(range(60))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if v in (x, y) else v for v in root]
    r.shuffle(pairs)
    got = {x["vertex"]: x["component"] for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(root[v] == c for v, c in got.items())


def test_medoids(spark):
    pts = [(0.0, 10.0), (10.0, 0.0), (10.0, 10.0), (10.0, 1.0), (10.0, 11.0), (10.0, 12.0)]
    frame = spark.createDataFrame([(k, list(p)) for k, p in enumerate(pts)], "id long, v array<double>")
    medoids = frame.where("id < 3").select(F.col("id").cast("int").alias("medoid"), "v")
    own = clustering.assign(frame.where("id >= 3"), medoids)
    assert {r["medoid"]: (r["n"], r["cost"]) for r in clustering.cost(own).collect()} == {1: (1, 1.0), 2: (2, 3.0)}
    best = clustering.k_medoids(frame, 3)
    assert best.agg(F.sum("distance")).first()[0] == 3.0  # (10, 11) replaces (10, 10)
    assert clustering.k_medoids(frame.limit(2), 3).count() == 0


# -- objects


def test_dissimilarities(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    text = lambda a, b: one(objects.string_dissimilar(F.lit(a), F.lit(b)))
    assert text("ab", "ac") == text("ab", "abcd") == 0.5 and math.isnan(text("", "")) and text("", "a") == 1
    whole = lambda a, b, compat: one(objects.int_dissimilar(F.lit(a), F.lit(b), compat))
    assert whole(5, 3, True) == pytest.approx(0) and whole(3, 5, True) == pytest.approx(1) and whole(3, 5, False) == pytest.approx(0)
    assert one(objects.bool_dissimilar(F.lit(True), F.lit(False))) == 1
    i = lambda n: {"Val": n, "JSONType": "IntValue"}
    array = lambda *x: {"Val": list(x), "JSONType": "ArrayValue"}
    struct = lambda *x: {"JSONType": "StructValue", "Fields": [{"Name": "f", "Val": v} for v in x]}
    assert objects.value_dissimilar(struct({"Val": True, "JSONType": "BoolValue"}, i(1)), struct({"Val": False, "JSONType": "BoolValue"}, i(1))) == 0.5
    assert objects.value_dissimilar(array(i(1)), array(i(1), i(2))) == 0.5
    assert objects.value_dissimilar(None, i(1)) == 1 and objects.value_dissimilar(None, None) == 0


def test_effects(spark):
    rows = [("f", 1, 0, 1.0, 1.0), ("f", 2, 0, 5.0, 1.0), ("f", 3, 1, 1.5, 0.0), ("f", 4, 1, 9.0, 0.0), ("g", 5, 0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "func_name string, id long, bin int, covariate double, outcome double")
    near = {(r["id"], r["other_bin"]): (r["other_id"], r["distance"]) for r in objects.nearest_covariate(frame).collect()}
    assert near == {(1, 1): (3, 0.5), (2, 1): (3, 3.5), (3, 0): (1, 0.5), (4, 0): (2, 4.0)}
    assert {r["func_name"]: r["score"] for r in objects.suspiciousness(frame).collect()} == {"f": 0.5, "g": 0.0}


# -- control-flow graphs


def test_diamond(spark):
    edges = spark.createDataFrame([("f", s, d) for s, d in ((0, 1), (0, 2), (1, 3), (2, 3))], "fn string, src int, dst int")
    pairs = lambda df, c: {(r["bbid"], r[c]) for r in df.collect()}
    assert pairs(cfg.dominators(edges), "idom") == {(0, 0), (1, 0), (2, 0), (3, 0)}
    assert pairs(cfg.post_dominators(edges), "ipdom") == {(0, 3), (1, 3), (2, 3), (3, 3)}
    assert pairs(cfg.dominance_frontier(edges), "frontier") == {(1, 3), (2, 3)}
    assert pairs(cfg.control_dependencies(edges), "controller") == {(1, 0), (2, 0), (3, 0)}


def test_dominators_match_removal():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(2, 9)
        g = {k: sorted({r.randrange(n) for _ in range(r.randint(0, 3))}) for k in range(n)}

        def reach(without, g=g):
            seen, todo = set(), [0] if without != 0 else []
            while todo:
                x = todo.pop()
                if x not in seen and x != without:
                    seen.add(x)
                    todo += g[x]
            return seen

        idom = cfg.immediate_dominators(g)
        assert set(idom) == reach(None)
        for b in idom:
            strict = {d for d in idom if d != b and b not in reach(d)}
            chain, x = set(), b
            while x != idom[x]:
                x = idom[x]
                chain.add(x)
            assert chain == strict
        # a block is in another's frontier if that one dominates a predecessor but not the block itself strictly
        front = cfg.frontier(g, idom)
        dominates = lambda a, b, reach=reach: a == b or b not in reach(a)
        expected = {a: {b for b in idom for p in idom if b in g[p] and dominates(a, p) and not (a != b and dominates(a, b))} for a in idom}
        assert {a: front[a] for a in idom} == expected


def test_chains_merge(spark):
    edges = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 3), ("f", 2, 4)], "fn string, src int, dst int")
    assert {(r["src"], r["dst"]) for r in cfg.merge_chains(edges).collect()} == {(0, 1), (0, 2)}


# -- inputs and points


def test_ranges():
    data = b"a\nb{c}\nd"
    assert minimise.offsets(data) == [0, 1, 6, 7]
    assert minimise.line_ranges(data) == [(0, 1), (2, 6), (7, 7)]
    assert minimise.curly_ranges(data) == [(3, 5)]
    assert minimise.line_curly_ranges(data) == [(2, 6)]
    assert all(f(b"") == [] for f in minimise.GENERATORS.values())


def test_native_lines_match_python(spark):
    texts = ["a\nb{c}\nd", "", "x", "ab", "\n", "\n\n", "a\n", "\na", "one\ntwo\n\nthree"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = sorted(tuple(r) for r in minimise.line_ranges_native(frame).collect())
    assert got == sorted((k, i, j) for k, t in enumerate(texts) for i, j in minimise.line_ranges(t.encode()))
    cut = spark.createDataFrame([("a\nb{c}\nd", 3, 5), ("é{x}", 2, 4)], "t string, i int, j int").select(minimise.without_range(F.col("t"), F.col("i"), F.col("j")).alias("x")).collect()
    assert [r["x"] for r in cut] == ["a\nb\nd", "é"]
    assert minimise.ranges(frame, "curly").count() == 1


def test_minimise(spark):
    text = "keep\nnoise {inner} more\nBUG here\nother\n"
    small = minimise.minimise(spark, text, lambda t: "BUG" in t, phases=(("lines", 20), ("blocks", 60)), seed=1)
    assert "BUG" in small and len(small) <= 8


def test_points(spark):
    frame = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "branch").otherwise("int").alias("kind"), F.concat(F.lit("fmt/x"), F.col("id").cast("string")).alias("package"))
    assert points.of_kinds(frame, []).count() == 100 and points.of_kinds(frame, ["int"]).count() == 50
    assert points.allowed(frame, ["fmt"]).count() == 0 and points.allowed(frame, ["os"], ["fmt/x1"]).count() == 1
    assert points.sample(frame, 7, seed=1).select("id").distinct().count() == 7
    assert points.sample_rate(frame, 0.0001).count() == 1
    with pytest.raises(ValueError):
        points.sample(frame, 101)


# -- patterns with repeated labels


def test_pattern_text_and_keys(spark):
    from tracelode.functions import patterns

    r = random.Random(2)
    v = ["a", "b(c)", "a", "]\\x"]
    e = [(0, 1, "x"), (2, 1, ""), (1, 3, "[y]")]
    assert patterns.parse_pretty(patterns.pretty(v, e)) == (v, e)
    assert patterns.parse_pretty("{0:1}(f(x) blk 1)") == (["f(x) blk 1"], [])
    assert patterns.from_key(patterns.key(v, e)) == patterns.canonical(v, e)
    for _ in range(20):
        order = r.sample(range(4), 4)
        place = {k: p for p, k in enumerate(order)}
        assert patterns.key([v[k] for k in order], [(place[s], place[t], x) for s, t, x in e]) == patterns.key(v, e)
    assert patterns.key(["a", "a"], [(0, 1, "")]) == patterns.key(["a", "a"], [(1, 0, "")]) != patterns.key(["a", "a"], [(0, 1, ""), (1, 0, "")])
    for bad in ("{1:1}(a)", "(a)", "{0:1}(a"):
        with pytest.raises(ValueError):
            patterns.parse_pretty(bad)
    with pytest.raises(ValueError):
        patterns.from_key(patterns.key(v, e)[:-1])
    frame = spark.createDataFrame([(v, [{"s": s, "t": t, "label": x} for s, t, x in e])], patterns.PATTERN)
    row = frame.select(patterns.pattern_key(F.struct("v", "e")).alias("k"), patterns.pattern_pretty(F.struct("v", "e")).alias("p"), patterns.dotty(F.struct("v", "e")).alias("d")).first()
    assert bytes(row["k"]) == patterns.key(v, e) and row["p"] == patterns.pretty(v, e) and row["d"].startswith("digraph{")
    back = spark.createDataFrame([(row["p"],)], "p string").select(patterns.pattern_of("p").alias("x")).first()["x"]
    assert back["v"] == v


def test_embeddings_match_brute_force(spark):
    import itertools

    from tracelode.operators import embeddings as emb

    r = random.Random(6)
    vs, es = [], []
    for g in range(6):
        vs += [("fail" if g % 2 else "ok", f"g{g}", k, r.choice("ab")) for k in range(5)]
        es += [("fail" if g % 2 else "ok", f"g{g}", s, t, "") for s in range(5) for t in range(5) if r.random() < 0.35]
    v = spark.createDataFrame(vs, "outcome string, graph_id string, vid int, label string")
    e = spark.createDataFrame(es, "outcome string, graph_id string, src int, dst int, label string")
    pattern = (["a", "b", "a"], [(0, 1, ""), (1, 2, "")])
    got = {(x["graph_id"], tuple(x["m"])) for x in emb.embeddings(pattern, v, e).collect()}
    label = {(g, k): x for _, g, k, x in vs}
    edge = {(g, s, t) for _, g, s, t, _ in es}
    expected = {(f"g{g}", m) for g in range(6) for m in itertools.permutations(range(5), 3) if all(label[f"g{g}", k] == x for k, x in zip(m, pattern[0], strict=True)) and all((f"g{g}", m[s], m[t]) in edge for s, t, _ in pattern[1])}
    assert got == expected and expected
    found = emb.embeddings(pattern, v, e)
    image = {x["outcome"]: x["support"] for x in emb.image_support(found).collect()}
    for o in image:
        mine = [(g, m) for g, m in expected if (int(g[1]) % 2 == 1) == (o == "fail")]
        assert image[o] == min(len({(g, m[k]) for g, m in mine}) for k in range(3))
    greedy: dict = {}
    for g, m in sorted(expected):
        o = "fail" if int(g[1]) % 2 else "ok"
        n, seen = greedy.setdefault((o, g), [0, set()])
        greedy[o, g] = [n + (not seen & set(m)), seen | set(m)]
    sums: dict = {}
    for (o, _), (n, _) in greedy.items():
        sums[o] = sums.get(o, 0) + n
    assert {x["outcome"]: x["support"] for x in emb.independent_support(found).collect()} == sums
    matched = {x["graph_id"]: x["matched"] for x in emb.largest_match(pattern, v, e).collect()}
    assert all((n == 2) == any(g == h for h, _ in expected) for g, n in matched.items())
    assert {x["graph_id"] for x in emb.embedded_in((["a"], []), v, e).collect()} == {g for (g, _), x in label.items() if x == "a"}


def test_walks_and_samples(spark):
    from tracelode.operators import walk_similarity as ws

    chain = (["a", "b"], [(0, 1)])
    assert ws.walk_distance(chain, chain) == 0 and ws.walk_distance(chain, (["a", "b"], [(1, 0)])) > 0
    rows = spark.createDataFrame([("x", t) for t in (1, 1, 3, 5)], "state string, time long")
    # gaps 1, 2, 2 before 1, 3, 5 weigh 0, 2/4, 3/4
    assert ws.expected_time(rows).first()["expected"] == 5 - (0 + 1.0 + 1.5) == np.mean([1, 1, 3, 5])


def test_names(spark):
    from tracelode.functions import names

    assert names.fnv1a(b"") == 0xCBF29CE484222325 and names.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    texts = ["1.5ms", "2m0.1s", "0s", "-3h", "1h2m", "0"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in [*texts, "x"]], "t string").select(names.duration_column(F.col("t"))).collect()]
    assert got == [*map(names.duration_nanos, texts), None] and got[0] == 1_500_000
    named = spark.createDataFrame([(None, 0), ("A", 2), (None, 3)], "f string, b int").select(names.block_name(F.col("f"), F.col("b"))).collect()
    assert [r[0] for r in named] == ["entry", "A blk 2", "unknown blk 3"]


def test_streamed_calls(spark, tmp_path):
    from tracelode.streaming.flows import call_profile

    rows = [("e", 1, 0, "enter", "main", 0, 0), ("e", 1, 1, "block", None, 1, 10), ("e", 1, 2, "enter", "f", 0, 30), ("e", 1, 3, "exit", None, 0, 35), ("e", 1, 4, "block", None, 2, 50)]
    schema = "exec_id string, thread int, seq int, kind string, fn string, bbid int, nanos long"
    for k in range(2):
        spark.createDataFrame(rows[k * 3 : k * 3 + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = call_profile(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.parquet(f"{tmp_path}/out/b={n}")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["kind"], r["src"], r["dst"]): (r["n"], r["nanos"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["call", "main", "f"] == (1, 0) and got["call", "entry", "main"] == (1, 0)
    assert got["flow", "main blk 0", "main blk 1"] == (1, 10) and got["flow", "f blk 0", "main blk 1"] == (1, 5) and got["flow", "main blk 1", "main blk 2"] == (1, 15)


# -- sinks


def test_text_sinks(spark):
    members = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.7), (3, 3, 0.1)], "id long, cluster long, score double")
    first = clustering.cluster_lines(members).first()["value"]
    assert first.startswith('{"cluster":1,') and '"id":1' in first
    rows = spark.createDataFrame([("a", k, float(k)) for k in range(1, 4)] + [("b", k, 0.0) for k in range(1, 6)], "method string, place int, score double")
    stats = {r["method"]: r for r in ranking.compare_stats(rows).collect()}
    assert stats["a"]["n"] == stats["b"]["n"] == 3 and stats["b"]["stderr"] == pytest.approx(math.sqrt(14 / 2)) and stats["a"]["stddev"] == 1
    assert ranking.stats_table(ranking.compare_stats(rows)).first()["value"].startswith("a  ")
    edges = spark.createDataFrame([("f", 0, 1), ("f", 1, 2)], "fn string, src int, dst int")
    assert cfg.dotty(edges).first()["value"] == 'digraph {\n"blk 0" -> "blk 1";\n"blk 1" -> "blk 2";\n}'
    jumps = markov.cluster_jumps(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "cluster int, label string"))
    assert {tuple(r) for r in jumps.collect()} == {("a", "b"), ("b", "a")}
