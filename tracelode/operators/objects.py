"""Object profiles: how values differ, and the causal effect of what functions return on whether runs fail.

Values are self-describing JSON, kept as VARIANT columns; scalar dissimilarities are Column expressions, nested ones
one pandas UDF.  Effects are estimated by nearest-covariate matching: individuals are put in treatment bins by their
outputs, and each is matched with the individual of another bin whose input is nearest.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import partitions, staged
from .joins import join_split

_TWO64 = "18446744073709551616"
#: Rows of a range of covariates, and the most bins that are broadcast.
RANGE, BINS = 500_000, 20_000


def int_dissimilar(a: Column, b: Column, compat: bool = False) -> Column:
    """Of unsigned 64-bit integers, in [0, 1]: |a - b| / 2^64; in compat mode the difference wraps round, so that it isn't
    symmetric."""
    d = a.cast("decimal(38,0)") - b.cast("decimal(38,0)")
    modulus = F.lit(_TWO64).cast("decimal(38,0)")
    return ((F.when(d < 0, d + modulus).otherwise(d) if compat else F.abs(d)).cast("double") / float(_TWO64)).cast("double")


def bool_dissimilar(a: Column, b: Column) -> Column:
    return (a != b).cast("double")


def string_dissimilar(a: Column, b: Column) -> Column:
    """Places that differ in the common length, plus the difference of lengths, over the longer length; two empty
    strings give NaN."""
    n, m = F.length(a), F.length(b)
    longest, shortest = F.greatest(n, m), F.least(n, m)
    left, right = F.split(F.substring(a, F.lit(1), shortest), ""), F.split(F.substring(b, F.lit(1), shortest), "")
    wrong = F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda d: d))
    total = F.when(shortest == 0, 0).otherwise(wrong) + longest - shortest
    return F.when(longest == 0, F.lit(float("nan"))).otherwise(total / F.when(longest != 0, longest))


def value_dissimilar(a, b) -> float:
    """Of two decoded values: by kind for scalars, the mean over fields for structs, over elements for arrays (a length
    that differs counts), through pointers; null against a value is 1."""
    if a is None or b is None:
        return float(a is not b)
    kind = a.get("JSONType")
    if kind != b.get("JSONType"):
        return 1.0
    if kind == "StructValue":
        pairs = list(zip(a.get("Fields") or [], b.get("Fields") or [], strict=False))
        return sum(value_dissimilar(x.get("Val"), y.get("Val")) for x, y in pairs) / len(pairs) if pairs else 0.0
    if kind in ("PointerValue", "InterfaceValue", "ReferenceValue"):
        return value_dissimilar(a.get("Elem"), b.get("Elem"))
    x, y = a.get("Val"), b.get("Val")
    if kind == "ArrayValue":
        x, y = x or [], y or []
        longest = max(len(x), len(y))
        return (sum(value_dissimilar(p, q) for p, q in zip(x, y, strict=False)) + longest - min(len(x), len(y))) / longest if longest else 0.0
    if kind == "IntValue":
        return abs(int(x) - int(y)) / float(_TWO64)
    if kind == "StringValue":
        longest = max(len(x), len(y))
        return (sum(p != q for p, q in zip(x, y, strict=False)) + longest - min(len(x), len(y))) / longest if longest else float("nan")
    return float(x != y)


@F.pandas_udf(T.DoubleType())
def json_dissimilar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two values as JSON strings."""
    return pd.Series([value_dissimilar(*(None if x is None else json.loads(x) for x in pair)) for pair in zip(a, b, strict=True)], dtype="float64")


def profile_dissimilar(a: Column, b: Column) -> Column:
    """Of two object profiles (arrays of struct<Name, Val> with Val as JSON): the mean over parameters."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    as_struct = lambda c: F.concat(F.lit('{"JSONType":"StructValue","Fields":['), F.array_join(F.transform(c, lambda p: F.concat(F.lit('{"Val":'), F.coalesce(p["Val"], F.lit("null")), F.lit("}"))), ","), F.lit("]}"))
    return F.when(F.size(pairs) == 0, F.lit(0.0)).otherwise(json_dissimilar(as_struct(a), as_struct(b)))


def collate(profiles: DataFrame) -> DataFrame:
    """func_name, inputs, outputs: the profiles of a function in order.  profiles: func_name, seq, inputs, outputs (arrays)."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "inputs", "outputs")))
    flat = lambda c: F.flatten(F.transform(F.col("rows"), lambda r: F.coalesce(r[c], F.array())))
    return profiles.groupBy("func_name").agg(listed.alias("rows")).select("func_name", flat("inputs").alias("inputs"), flat("outputs").alias("outputs"))


def nearest_covariate(individuals: DataFrame, width: float | None = None, own: bool = False) -> DataFrame:
    """func_name, id, bin, other_bin, other_id, distance: for each individual, the one of each other treatment bin of its
    function whose covariate is nearest, of equally near ones the smallest id; with ``own``, of its own bin as well.

    individuals: func_name, id, bin, covariate.  Instead of all pairs, each bin's covariates are merged in one order with
    the seekers, and the nearest one before and after is carried along.  Rows are dealt by ranges of function, bin and covariate, so that a
    hot function or bin is spread, as many ranges as hold about RANGE rows each, a range a task; what reaches over a border, the last offer before
    a range and the first one behind it, joins the range as two more rows a bin.
    """
    keys = ["func_name", "other_bin"]
    bins = staged(individuals.groupBy("func_name", F.col("bin").alias("other_bin")).agg(F.count("*").alias("n")), "bins")
    by_function = bins.groupBy("func_name").agg(F.collect_list(F.struct("other_bin")).alias("bins"), F.sum("n").alias("n"))
    total = by_function.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for a, c in (("rows", F.col("n")), ("bins", F.size("bins")), ("seekers", F.col("n") * F.size("bins"))))).first()
    ranges = max(partitions(individuals.sparkSession), -(-(total["rows"] + total["seekers"]) // RANGE))
    # few bins go to where the individuals are
    met = individuals.join(F.broadcast(by_function.drop("n")), "func_name") if total["bins"] <= BINS else join_split(individuals, by_function, "func_name", "n", total["rows"])
    pairs = met.withColumn("of", F.explode("bins")).withColumn("other_bin", F.col("of.other_bin"))
    seekers = (pairs if own else pairs.where("bin != other_bin")).select(*keys, "covariate", "id", "bin", F.lit(None).cast("struct<c:double,i:bigint>").alias("offer"))
    offers = individuals.groupBy("func_name", F.col("bin").alias("other_bin"), "covariate").agg(F.min("id").alias("i")).select(
        *keys, "covariate", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("bin"), F.struct(F.col("covariate").cast("double").alias("c"), F.col("i").cast("long").alias("i")).alias("offer")
    )
    ranged = staged(seekers.unionByName(offers).repartitionByRange(ranges, *keys, "covariate").withColumn("part", F.spark_partition_id()), "ranged")
    end = F.when(F.col("offer").isNotNull(), F.struct("covariate", "offer"))
    ends = staged(ranged.groupBy("part", *keys).agg(F.min(end).alias("first"), F.max(end).alias("last")), "ends")
    along = Window.partitionBy(*keys).orderBy("part")
    before, behind = F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.last("first", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))
    reach = ends.select("part", *keys, before.alias("before"), behind.alias("behind"))
    over = reach.select("part", *keys, F.explode(F.array("before", "behind")).alias("at")).where("at IS NOT NULL").select(*keys, "at.covariate", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("bin"), "at.offer", "part")
    inside = Window.partitionBy("part", *keys)
    below = F.last("offer", ignorenulls=True).over(inside.orderBy("covariate", F.col("offer").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    above = F.last("offer", ignorenulls=True).over(inside.orderBy(F.desc("covariate"), F.col("offer").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.unionByName(over).repartitionById(ranges, "part").select("*", below.alias("below"), above.alias("above")).where("id IS NOT NULL")
    far = lambda o: F.when(o.isNotNull(), F.struct(F.abs(F.col("covariate") - o["c"]).alias("distance"), o["i"].alias("other_id")))
    best = F.least(far(F.col("below")), far(F.col("above")))
    out = found.select("func_name", "id", "bin", "other_bin", best.alias("m")).select("func_name", "id", "bin", "other_bin", "m.other_id", "m.distance")
    return out if width is None else out.where(F.col("distance") < width)


def pair_effects(individuals: DataFrame, width: float | None = None) -> DataFrame:
    """func_name, bin, other_bin, effect: over all individuals of the function, each matched in both bins, the mean difference of the
    matches' outcomes.  individuals as above, with outcome.

    Every individual is matched in every bin, or those matched in both (width) count: the sum of a pair's differences is the difference of
    two sums, so individuals are not paired with bins twice over unless a width leaves some unmatched.
    """
    matched = nearest_covariate(individuals, width, own=True)
    other = individuals.select("func_name", F.col("id").alias("other_id"), F.col("outcome").alias("y"))
    found = staged(matched.join(other, ["func_name", "other_id"]).select("func_name", "id", "other_bin", "y"), "matched")
    if width is None:
        means = found.groupBy("func_name", "other_bin").agg(F.avg("y").alias("y"))
        one, two = means.withColumnsRenamed({"other_bin": "bin", "y": "y1"}), means.withColumnRenamed("y", "y2")
        return one.join(two, "func_name").where("bin != other_bin").select("func_name", "bin", "other_bin", (F.col("y1") - F.col("y2")).alias("effect"))
    one, two = found.withColumnsRenamed({"other_bin": "bin", "y": "y1"}), found.withColumnRenamed("y", "y2")
    return one.join(two, ["func_name", "id"]).where("bin != other_bin").groupBy("func_name", "bin", "other_bin").agg(F.avg(F.col("y1") - F.col("y2")).alias("effect"))


def suspiciousness(individuals: DataFrame, width: float | None = None) -> DataFrame:
    """func_name, score: the absolute sum of the effects of the pairs of bins (each once) over the number of bins; a
    function with fewer than three individuals scores 0."""
    effects = pair_effects(individuals, width).where("bin < other_bin")
    sizes = individuals.groupBy("func_name").agg(F.count("*").alias("n"), F.count_distinct("bin").alias("bins"))
    sums = effects.groupBy("func_name").agg(F.sum("effect").alias("effect"))
    score = F.when((F.col("n") < 3) | F.col("effect").isNull(), F.lit(0.0)).otherwise(F.abs(F.col("effect") / F.col("bins")))
    return sizes.join(sums, "func_name", "left").select("func_name", score.alias("score"))


def serialise(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """func_name, value: one JSON line a function, with what was captured on either side.  Both: func_name, profile (JSON)."""
    i = inputs.groupBy("func_name").agg(F.array_sort(F.collect_list("profile")).alias("i"))
    o = outputs.groupBy("func_name").agg(F.array_sort(F.collect_list("profile")).alias("o"))
    joined = i.join(o, "func_name", "full_outer")
    text = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]"))
    return joined.select("func_name", F.concat(F.lit('{"FuncName":'), F.to_json(F.array("func_name")).substr(F.lit(2), F.length(F.to_json(F.array("func_name"))) - 2), F.lit(',"In":'), text(F.col("i")), F.lit(',"Out":'), text(F.col("o")), F.lit("}")).alias("value"))
