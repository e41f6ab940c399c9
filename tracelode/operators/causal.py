"""Causal localisation: from the object profiles of failing and passing runs to a score a function.

Every call of a function is an individual: what went in is its covariate, what came out its treatment, and whether its run passed its
outcome.  Treatments are binned by k-medoids over the dissimilarity of nested values; each individual is matched in every bin with the one whose
covariate is nearest, and the effect of one bin against another is the mean difference of the matches' outcomes.  A function's score is the absolute
sum of the effects of all pairs of bins over the number of bins.

The dissimilarity is a metric in [0, 1] (differences of elements by place, a missing one counting 1, over the longer length), so bins and
matches come from ``metric`` without all pairs.  Equal values are measured once.

Where the reference depends on order: individuals are ordered by outcome (passing first), profile and place; of equally near ones the first counts;
the first distinct treatments start the bins.  Inputs and outputs are paired within a profile, and a call without an output is none.
The reference overwrites treatment bins with covariate bins; ``bins="covariate"`` does so, the default doesn't.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import metric

_TWO64 = float(1 << 64)
_REFERENCES = ("PointerValue", "InterfaceValue", "ReferenceValue")


def value_distance(a, b) -> float:
    """Of two decoded values, a metric in [0, 1]; null against a value, or values of two kinds, are 1 apart."""
    if a is None or b is None:
        return float(a is not b)
    kind = a.get("JSONType")
    if kind != b.get("JSONType"):
        return 1.0
    if kind == "StructValue":
        if a.get("TypName") != b.get("TypName"):
            return 1.0
        return _by_place([f.get("Val") for f in a.get("Fields") or []], [f.get("Val") for f in b.get("Fields") or []], _field_distance)
    if kind in _REFERENCES:
        return value_distance(a.get("Elem"), b.get("Elem"))
    x, y = a.get("Val"), b.get("Val")
    if kind == "ArrayValue":
        return _by_place(x or [], y or [], value_distance)
    if kind == "StringValue":
        return _by_place(x or "", y or "", str.__ne__)
    if x is None or y is None:
        return float(x is not y)
    if kind == "IntValue":
        return abs(int(x) - int(y)) / _TWO64
    return float(x != y)


def _field_distance(a, b) -> float:
    """Fields that refer to something differ by whether they do, as what they refer to may refer back."""
    if all(x is None or x.get("JSONType") in _REFERENCES for x in (a, b)):
        return float((a or {}).get("Elem") is None) != float((b or {}).get("Elem") is None)
    return value_distance(a, b)


def _by_place(x, y, of) -> float:
    longest = max(len(x), len(y))
    if not longest:
        return 0.0
    return (sum(map(of, x, y)) + longest - min(len(x), len(y))) / longest


def profile_distance(a: list, b: list) -> float:
    """Of two object profiles, lists of values: the mean over parameters."""
    return _by_place(a, b, value_distance)


def decode(profile: str) -> list:
    return [p.get("Val") for p in json.loads(profile)]


def levels(value, depth: int):
    """What a decoded value is down to a depth: fields of structs and what references refer to are one deeper, elements of arrays are not.  Names of
    fields don't count."""
    if value is None:
        return None
    if depth <= 0:
        return "..."
    kind = value.get("JSONType")
    if kind == "StructValue":
        return [kind, value.get("TypName"), [levels(f.get("Val"), depth - 1) for f in value.get("Fields") or []]]
    if kind in _REFERENCES:
        return [kind, levels(value.get("Elem"), depth - 1)]
    if kind == "ArrayValue":
        return [kind, [levels(v, depth) for v in value.get("Val") or []]]
    return [kind, value.get("Val")]


def level_hash(value: Column, depth: int) -> Column:
    """A 64-bit hash of a VARIANT value that is the same for values that are the same down to a depth; null for null."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else json.dumps(levels(json.loads(x), depth), ensure_ascii=False))

    return F.when(value.isNotNull(), F.xxhash64(text(F.to_json(value))))


def individuals(ok: DataFrame, fail: DataFrame) -> DataFrame:
    """func_name, id, covariate, treatment (JSON of object profiles), outcome: the calls of functions that both sides hold.

    ok, fail: func_name, seq, inputs, outputs (arrays of object profiles; those are arrays of struct<Name, Val> with Val as VARIANT).
    """

    def side(profiles: DataFrame, outcome: float) -> DataFrame:
        calls = profiles.select("func_name", F.col("seq").cast("long").alias("seq"), F.posexplode(F.arrays_zip(F.col("inputs").alias("i"), F.col("outputs").alias("o"))).alias("at", "call"))
        calls = calls.where("call.i is not null and call.o is not null")
        # ids order as outcome, profile, place
        order = F.struct(F.lit(int(outcome == 0.0)).alias("failed"), "seq", "at")
        return calls.select("func_name", order.alias("id"), _text("call.i").alias("covariate"), _text("call.o").alias("treatment"), F.lit(outcome).alias("outcome"))

    both = staged(side(ok, 1.0).unionByName(side(fail, 0.0)), "calls")
    names = both.groupBy("func_name").agg(F.count_distinct("outcome").alias("sides"), F.count("*").alias("n")).where("sides = 2 and n >= 3")
    return both.join(names.select("func_name"), "func_name")


def _text(profile: str) -> Column:
    return F.to_json(profile)


def binned(people: DataFrame, k: int, of: str = "treatment") -> DataFrame:
    """people with bin: the number of the medoid of their treatment's (or covariate's) cluster."""
    values = people.groupBy(F.col("func_name").alias("g"), F.col(of).alias("v")).agg(F.count("*").alias("w"), F.min("id").alias("first"))
    clusters = metric.k_medoids(values, k, decode, profile_distance).select(F.col("g").alias("func_name"), F.col("v").alias(of), F.col("medoid").alias("bin"))
    return people.join(clusters, ["func_name", of])


def matched(people: DataFrame, counts: dict | None = None) -> DataFrame:
    """func_name, covariate, bin, distance, id: for each covariate of a function and each of its bins, the individual of the nearest covariate."""
    seekers = people.select(F.col("func_name").alias("g"), F.col("covariate").alias("v")).distinct()
    offers = people.select(F.col("func_name").alias("g"), "bin", F.col("covariate").alias("v"), "id")
    found = metric.nearest(seekers, offers, decode, profile_distance, counts=counts)
    return found.withColumnsRenamed({"g": "func_name", "v": "covariate"})


def effects(people: DataFrame) -> DataFrame:
    """func_name, bin, other_bin, effect: the mean over all individuals of how the outcomes of their matches in two bins differ, each pair once."""
    people = staged(people, "people")
    found = matched(people).join(people.select("func_name", "id", "outcome"), ["func_name", "id"])
    weights = people.groupBy("func_name", "covariate").agg(F.count("*").alias("w"))
    means = found.join(weights, ["func_name", "covariate"]).groupBy("func_name", "bin").agg((F.sum(F.col("w") * F.col("outcome")) / F.sum("w")).alias("y"))
    means = staged(means, "means")
    one, two = means.withColumnRenamed("y", "y1"), means.select("func_name", F.col("bin").alias("other_bin"), F.col("y").alias("y2"))
    # at most k bins a function
    return one.join(two, "func_name").where("bin < other_bin").select("func_name", "bin", "other_bin", (F.col("y1") - F.col("y2")).alias("effect"))


def localize(ok: DataFrame, fail: DataFrame, k: int = 10, bins: str = "treatment") -> DataFrame:
    """func_name, score, n_bins, n: every function of both sides with its score, 0 for those of fewer than three individuals."""
    people = staged(binned(individuals(ok, fail), k, bins), "binned")
    sizes = people.groupBy("func_name").agg(F.count_distinct("bin").alias("n_bins"), F.count("*").alias("n"))
    sums = effects(people).groupBy("func_name").agg(F.sum("effect").alias("effect"))
    scored = sizes.join(sums, "func_name", "left").select("func_name", F.coalesce(F.abs(F.col("effect") / F.col("n_bins")), F.lit(0.0)).alias("score"), "n_bins", "n")
    names = ok.select("func_name").distinct().join(fail.select("func_name").distinct(), "func_name")
    return names.join(scored, "func_name", "left").select("func_name", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_bins", F.lit(0)).alias("n_bins"), F.coalesce("n", F.lit(0)).alias("n"))
