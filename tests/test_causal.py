"""Metric-space operators and causal localisation against brute force."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import causal, metric
from tracelode.plans import queries
from tracelode.sources import profiles

DATA = "/root/testdata/sf0.001"


def number(x):
    return {"Val": x, "JSONType": "IntValue"}


def text(x):
    return {"Val": x, "JSONType": "StringValue"}


def random_value(r, depth=2):
    kind = r.randrange(7 if depth else 4)
    if kind == 0:
        return number(r.randrange(6) << 61)
    if kind == 1:
        return text("".join(r.choice("ab") for _ in range(r.randrange(4))))
    if kind == 2:
        return {"Val": r.random() < 0.5, "JSONType": "BoolValue"}
    if kind == 3:
        return None
    inner = [random_value(r, depth - 1) for _ in range(r.randrange(4))]
    if kind == 4:
        return {"JSONType": "ArrayValue", "Val": inner}
    if kind == 5:
        return {"JSONType": "StructValue", "TypName": f"T{len(inner)}", "Fields": [{"Name": str(k), "Val": v} for k, v in enumerate(inner)]}
    return {"JSONType": "PointerValue", "Elem": random_value(r, depth - 1)}


def test_the_distance_is_a_metric():
    r = random.Random(7)
    values = [random_value(r) for _ in range(60)]
    d = [[causal.value_distance(a, b) for b in values] for a in values]
    n = len(values)
    assert all(d[i][j] == d[j][i] and 0 <= d[i][j] <= 1 for i in range(n) for j in range(n))
    assert all(d[i][i] == 0 for i in range(n))
    # numbers beyond a double's 53 bits, empty strings, references inside a struct
    assert causal.value_distance(number((1 << 64) - 1), number(0)) == 1.0 and causal.value_distance(text(""), text("")) == 0.0
    of = lambda e: {"JSONType": "StructValue", "TypName": "N", "Fields": [{"Name": "next", "Val": {"JSONType": "PointerValue", "Elem": e}}]}
    assert causal.value_distance(of(number(1)), of(number(1 << 63))) == 0.0 and causal.value_distance(of(None), of(number(1))) == 1.0
    worst = max(d[i][k] - d[i][j] - d[j][k] for i in range(n) for j in range(n) for k in range(n))
    assert worst < 1e-12


def random_profiles(r, n):
    return [json.dumps([{"Name": "a", "Val": number(r.randrange(64) << 58)}, {"Name": "s", "Val": text("".join(r.choice("abc") for _ in range(r.randrange(5))))}]) for _ in range(n)]


@pytest.mark.parametrize("block", [7, metric.BLOCK])
def test_nearest_equals_brute_force_and_prunes(spark, block):
    r = random.Random(5)
    offers = [(g, b, v, k) for k, (g, b, v) in enumerate((r.choice("xy"), r.randrange(3), v) for v in random_profiles(r, 500))]
    seekers = sorted({(r.choice("xyz"), v) for v in random_profiles(r, 120)})
    counts = {}
    got = metric.nearest(spark.createDataFrame(seekers, "g string, v string"), spark.createDataFrame(offers, "g string, bin int, v string, id long"), causal.decode, causal.profile_distance, block=block, counts=counts)
    got = {(x["g"], x["v"], x["bin"]): (x["distance"], x["id"]) for x in got.collect()}
    expected = {}
    for g, v in seekers:
        for og, b, ov, k in offers:
            if g == og:
                found = (causal.profile_distance(causal.decode(v), causal.decode(ov)), k)
                expected[g, v, b] = min(expected.get((g, v, b), (9, 0)), found)
    assert got == expected and counts["measured"] < 0.6 * counts["pairs"]
    empty = metric.nearest(spark.createDataFrame([], "g string, v string"), spark.createDataFrame(offers, "g string, bin int, v string, id long"), causal.decode, causal.profile_distance)
    assert empty.count() == 0


def brute_medoids(values, k):
    """values: list of (v, w), by first."""
    decoded = {v: causal.decode(v) for v, _ in values}
    d = lambda a, b: causal.profile_distance(decoded[a], decoded[b])
    start = k if len(values) >= k else max(1, len(values) // 2)
    medoids = {m: v for m, (v, _) in enumerate(values[:start])}
    last, done = None, None
    while True:
        assigned = {v: min((d(v, x), m) for m, x in medoids.items()) for v, _ in values}
        cost = sum(w * assigned[v][0] for v, w in values)
        if last is not None and not cost < last * (1 - 1e-12):
            return done
        last, done = cost, {v: (m, x) for v, (x, m) in assigned.items()}
        for m in list(medoids):
            own = [(v, w) for v, w in values if assigned[v][1] == m]
            if not own:
                del medoids[m]
                continue
            sums = {v: sum(w * d(v, x) for x, w in own) for v, _ in own}
            best = min(sums.values())
            if best < sums[medoids[m]] * (1 - 1e-12):
                medoids[m] = next(v for v, _ in own if sums[v] <= best * (1 + 1e-12))


def test_medoids_equal_brute_force(spark):
    r = random.Random(9)
    groups = {g: list(dict.fromkeys(random_profiles(r, n))) for g, n in (("big", 60), ("small", 2), ("one", 1), ("few", 12))}
    rows = [(g, v, r.randrange(1, 5), k) for g, vs in groups.items() for k, v in enumerate(vs)]
    counts = {}
    got = metric.k_medoids(spark.createDataFrame(rows, "g string, v string, w long, first long"), 4, causal.decode, causal.profile_distance, candidates=5, counts=counts)
    got = {(x["g"], x["v"]): (x["medoid"], x["distance"]) for x in got.collect()}
    expected = {(g, v): x for g in groups for v, x in brute_medoids([(v, w) for h, v, w, _ in rows if h == g], 4).items()}
    assert got == expected and counts["measured"] > 0


def brute_scores(people, k):
    out = {}
    for f in {p["func_name"] for p in people}:
        own = sorted((p for p in people if p["func_name"] == f), key=lambda p: tuple(p["id"]))
        treatments = {}
        for p in own:
            treatments[p["treatment"]] = treatments.get(p["treatment"], 0) + 1
        bins = brute_medoids(list(treatments.items()), k)
        covariates = {p["covariate"]: causal.decode(p["covariate"]) for p in own}
        means = {}
        for b in {m for m, _ in bins.values()}:
            inside = {}
            for p in own:
                if bins[p["treatment"]][0] == b:
                    inside.setdefault(p["covariate"], p["outcome"])
            first = {c: k for k, c in reversed(list(enumerate(p["covariate"] for p in own if bins[p["treatment"]][0] == b)))}
            match = {c: inside[min(inside, key=lambda o: (causal.profile_distance(covariates[c], covariates[o]), first[o]))] for c in covariates}
            means[b] = sum(match[p["covariate"]] for p in own) / len(own)
        order = sorted(means)
        out[f] = (abs(sum(means[a] - means[b] for i, a in enumerate(order) for b in order[i + 1 :])) / len(means), len(means), len(own))
    return out


def test_causal_functions_equal_brute_force(spark):
    found = queries._event_profiles(spark, DATA)
    people = causal.individuals(found["ok"], found["fail"]).collect()
    assert len(people) == spark.read.parquet(f"{DATA}/events.parquet").count()
    expected = brute_scores(people, 10)
    got = {r["func_name"]: (r["score"], r["n_bins"], r["n"]) for r in causal.localize(found["ok"], found["fail"], 10).collect()}
    assert got.keys() == expected.keys()
    for f, (score, bins, n) in expected.items():
        assert got[f][1:] == (bins, n) and abs(got[f][0] - score) < 1e-9
    assert max(s for s, *_ in got.values()) > 0


def test_profile_files(spark, tmp_path):
    lines = [{"FuncName": f"f{k % 7}", "In": [[{"Name": "a", "Val": number(k << 50)}]], "Out": [[{"Name": "r", "Val": None}]] if k % 5 else None} for k in range(4000)]
    (tmp_path / "one").write_text("\n".join(['{"Types":[{"Kind":"int"},{"Kind":"string"}]}', *(json.dumps(x) for x in lines[:3000]), "", "junk"]) + "\n")
    (tmp_path / "two").write_text("\n".join(['{"Types":[{"Kind":"int"}]}', *(json.dumps(x) for x in lines[3000:])]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        got = profiles.read(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 3 and got.count() == 4000
        assert got.select("seq").distinct().count() == 4000 and got.where(F.size("outputs") == 0).count() == 800
        total = got.select(F.sum(F.variant_get(F.get(F.get("inputs", F.lit(0)), F.lit(0))["Val"], "$.Val", "decimal(20,0)"))).first()[0]
        assert total == sum(k << 50 for k in range(4000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["type_id"], r["j"]) for r in profiles.types(spark, str(tmp_path)).select("type_id", F.to_json("type").alias("j")).collect()) == [(0, '{"Kind":"int"}'), (1, '{"Kind":"string"}')]
    people = causal.individuals(got, got.limit(7))
    assert people.where("treatment is null or covariate is null").count() == 0
    only_one_side = causal.localize(got.where("func_name = 'f1'"), got.where("func_name = 'f2'"))
    assert only_one_side.count() == 0
    few = causal.localize(got.limit(1), got.limit(1))
    assert [(r["score"], r["n_bins"]) for r in few.collect()] == [(0.0, 0)]


def test_hashes_of_levels(spark):
    of = lambda x, typ="T": {"JSONType": "StructValue", "TypName": typ, "Fields": [{"Name": "f", "Val": x}]}
    to = lambda x: {"JSONType": "PointerValue", "Elem": x}
    deep = lambda x: of(to(of(x)))
    values = [deep(number(1)), deep(number(2)), of(to(of(number(1), "U"))), of(to(None)), {"JSONType": "ArrayValue", "Val": [number(1), deep(number(3))]}, {"JSONType": "ArrayValue", "Val": [number(1), deep(text("3"))]}, number(1), text("1"), None]
    df = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in enumerate(values)], "id int, j string").withColumn("v", F.parse_json("j"))
    for depth in range(1, 6):
        got = {r["id"]: r["h"] for r in df.select("id", causal.level_hash(F.col("v"), depth).alias("h")).collect()}
        texts = [json.dumps(causal.levels(v, depth)) for v in values]
        for a in range(len(values) - 1):
            for b in range(len(values) - 1):
                assert (got[a] == got[b]) == (texts[a] == texts[b])
        assert got[8] is None
        assert (got[0] == got[1]) == (depth < 4) and (got[0] == got[2]) == (depth < 3) and (got[4] == got[5]) == (depth < 4) and got[6] != got[7]
        # a null is told apart where it is looked at
        assert (got[0] == got[3]) == (depth < 2)
