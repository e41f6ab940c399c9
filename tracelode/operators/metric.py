"""Nearest neighbours and medoids in any metric space, for values that have distances but no coordinates.

Values are strings (here JSON of object profiles) and ``Distance`` turns two of them into a number in [0, 1].  Nothing forms all pairs:

* ``nearest`` measures every value against a few pivots of its group.  A block of offers is bounded by its least and largest distance
  to each pivot; the triangle inequality tells which blocks can hold a seeker's nearest offer, and in a block which offers can.
* ``medoids`` finds each cluster's exact medoid: if i has the mean distance E(i), then E(j) >= |E(i) - d(i, j)| for every j, so each
  candidate that is measured rules others out (Newling and Fleuret, A Sub-Quadratic Exact Medoid Algorithm, 2017).

Equal values are one row with a weight, so copies cost nothing.  Where the rows of a group meet what is known of it (one row of bounded size: pivots, k
medoids, the candidates of a pass; or a box for BLOCK offers) that is a join with one row a key, whose hot keys adaptive execution splits: nothing
above needs a group's rows together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import partitions, staged

#: Pivots of a group, offers of a block, seekers that meet a block in one call, and medoid candidates of a cluster that one pass measures.
PIVOTS, BLOCK, SEEKERS, CANDIDATES = 8, 20_000, 20_000, 16
#: What rounding may add to the difference of two distances, as a share of their sum.
SLACK = 1e-13

#: Decodes a value once; then tells the distance of two decoded ones.
Decode = Callable[[str], object]
Distance = Callable[[object, object], float]


def measured(rows: DataFrame, against: str, name: str, decode: Decode, distance: Distance) -> DataFrame:
    """rows with the distances of v to each of the array column ``against`` in place of that column."""
    kept = [c for c in rows.columns if c != against]
    at, fields = rows.columns.index(against), [f for f in rows.schema.fields if f.name != against]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, object] = {}

        def decoded(v: str) -> object:
            if v not in known:
                if len(known) > 10_000:
                    known.clear()
                known[v] = decode(v)
            return known[v]

        for b in batches:
            values, others = b.column(b.schema.get_field_index("v")).to_pylist(), b.column(at).to_pylist()
            found = []
            for v, o in zip(values, others, strict=True):
                x = decode(v)
                found.append([distance(x, decoded(y)) for y in o])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(found, pa.list_(pa.float64()))], [*kept, name])

    return rows.mapInArrow(run, schema)


def first_of(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows a key, the first by order; Spark keeps only so many of each task before the exchange."""
    return rows.withColumn("place_of_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place_of_row") <= n)


def nearest(seekers: DataFrame, offers: DataFrame, decode: Decode, distance: Distance, pivots: int = PIVOTS, block: int = BLOCK, counts: dict | None = None) -> DataFrame:
    """g, v, bin, distance, id: for each seeker (g, v; distinct) and each bin of its group, the nearest offer; of equally near ones the least id.

    offers: g, bin, v, id (any type that orders).  counts, if given, gets the number of distances measured besides those to pivots.
    """
    spark, on = seekers.sparkSession, ["g"]
    # of an offer's equal values in a bin the least id can be the answer
    offers = offers.groupBy("g", "bin", "v").agg(F.min("id").alias("id"))
    chosen = first_of(offers.select("g", "v").distinct(), on, [F.xxhash64("v"), F.col("v")], pivots).groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("pivots"))
    chosen = staged(chosen, "pivots")
    offers = measured(offers.join(chosen, "g"), "pivots", "far", decode, distance)
    # blocks: cells of offers whose nearest pivot is the same, cut in parts
    offers = staged(offers.withColumn("cell", F.array_position("far", F.array_min("far")).cast("int")), "offers")
    cells = offers.groupBy("g", "bin", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    offers = offers.join(cells, ["g", "bin", "cell"])
    offers = offers.withColumn("cut", F.pmod(F.xxhash64("v"), F.col("cuts")).cast("int")).withColumn("block", F.xxhash64("g", "bin", "cell", "cut")).drop("cuts", "cell", "cut")
    offers = staged(offers, "blocked")
    ends = [f(F.get("far", F.lit(k))).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in range(pivots)]
    boxes = offers.groupBy("g", "bin", "block").agg(*ends)
    side = lambda n: F.array(*(F.col(f"{n}{k}") for k in range(pivots)))
    boxes = boxes.groupBy("g").agg(F.collect_list(F.struct("bin", "block", side("lo").alias("lo"), side("hi").alias("hi"))).alias("boxes"))
    seekers = measured(seekers.select("g", "v").join(chosen, "g"), "pivots", "far", decode, distance)
    asked = staged(_within(staged(seekers, "seekers").join(boxes, "g")), "asked")
    # a block with many seekers meets them in slices
    slices = asked.groupBy("block").agg(F.ceil(F.count("*") / SEEKERS).cast("int").alias("slices"))
    spread = F.pmod(F.xxhash64("v"), F.col("slices")).cast("int")
    asked = asked.join(slices, "block").withColumn("slice", spread).drop("slices")
    copies = offers.join(slices, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices", "g", "bin")
    shape = f"g {_type(offers, 'g')}, v string, bin {_type(offers, 'bin')}, distance double, id {_type(offers, 'id')}, tried long"
    met = asked.groupBy("block", "slice").cogroup(copies.groupBy("block", "slice")).applyInPandas(_meet(decode, distance), shape)
    if counts is not None:
        met = staged(met, "met")
        counts["measured"] = met.agg(F.sum("tried")).first()[0] or 0
        counts["pairs"] = asked.select("g", "v").distinct().join(offers.groupBy("g").agg(F.count("*").alias("n")), "g").agg(F.sum("n")).first()[0] or 0
    best = met.groupBy("g", "v", "bin").agg(F.min(F.struct("distance", "id")).alias("best"))
    return best.select("g", "v", "bin", "best.distance", "best.id")


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _within(rows: DataFrame) -> DataFrame:
    """g, v, far, block, limit: for each seeker the blocks that can hold the nearest offer of their bin, and how near that is at least.

    Some offer of a block is as near to a pivot as the block's least distance to it, which bounds the nearest one from above; no offer is nearer
    than the seeker's distance to a pivot differs from what the block's offers have.
    """
    lower = F.array_max(F.zip_with("far", F.arrays_zip(F.col("box.lo").alias("lo"), F.col("box.hi").alias("hi")), lambda d, b: F.greatest(d - b["hi"] - SLACK * (d + b["hi"]), b["lo"] - d - SLACK * (d + b["lo"]))))
    upper = F.array_min(F.zip_with("far", F.col("box.lo"), lambda d, lo: (d + lo) * (1 + SLACK)))
    each = rows.select("g", "v", "far", F.explode("boxes").alias("box")).select("g", "v", "far", "box.bin", "box.block", lower.alias("lower"), upper.alias("upper"))
    limit = F.min("upper").over(Window.partitionBy("g", "v", "bin"))
    return each.withColumn("limit", limit).where(F.col("lower") <= F.col("limit")).select("g", "v", "far", "bin", "block", "limit")


def _meet(decode: Decode, distance: Distance):
    def run(asked: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(offers):
            return pd.DataFrame({"g": [], "v": [], "bin": [], "distance": [], "id": [], "tried": []})
        offers = offers.iloc[sorted(range(len(offers)), key=[tuple(x.values()) if isinstance(x, dict) else x for x in offers["id"]].__getitem__)]
        far, ids = np.array(offers["far"].tolist()), offers["id"].tolist()
        values = [decode(v) for v in offers["v"]]
        rows = []
        for g, v, own, b, limit in zip(asked["g"], asked["v"], asked["far"], asked["bin"], asked["limit"], strict=True):
            own = np.asarray(own, float)
            lower = (np.abs(far - own) - SLACK * (far + own)).max(axis=1)
            x, best, at, tried = decode(v), limit, -1, 0
            for k in np.argsort(lower, kind="stable"):
                if lower[k] > best:
                    break
                d, tried = distance(x, values[k]), tried + 1
                if d < best or (d == best and (at < 0 or k < at)):
                    best, at = d, k
            if at >= 0:
                rows.append((g, v, b, best, ids[at], tried))
        return pd.DataFrame(rows, columns=["g", "v", "bin", "distance", "id", "tried"])

    return run


# -- medoids


def k_medoids(values: DataFrame, k: int, decode: Decode, distance: Distance, candidates: int = CANDIDATES, counts: dict | None = None) -> DataFrame:
    """g, v, medoid, distance: each value's cluster in its group, by the medoid's number, at an optimum.

    values: g, v (distinct in a group), w (how often), first (any type that orders).  The first k values of a group start (half of a group's values
    where it has fewer than k).  Values go to the nearest medoid, of equally near ones the first; each cluster's value with the least weighted sum of
    distances becomes its medoid; that goes on while some group's cost falls.  No value of a cluster is then a better medoid than its own.
    """
    values = staged(values.select("g", "v", F.col("w").cast("double").alias("w"), "first"), "values")
    sizes = values.groupBy("g").agg(F.count("*").alias("n"))
    start = first_of(values, ["g"], [F.col("first"), F.col("v")], k).join(sizes, "g")
    start = start.where(F.col("place_of_row") <= F.when(F.col("n") >= k, k).otherwise(F.greatest(F.floor(F.col("n") / 2), F.lit(1))))
    medoids = start.select("g", (F.col("place_of_row") - 1).alias("medoid"), "v")
    done, last = None, None
    while True:
        assigned = staged(_assigned(values, medoids, decode, distance), "assigned")
        costs = assigned.groupBy("g").agg(F.sum(F.col("w") * F.col("distance")).alias("cost"))
        # groups whose cost has not fallen keep what they had
        falls = costs if last is None else costs.join(last.withColumnRenamed("cost", "before"), "g").where(F.col("cost") < F.col("before") * (1 - 1e-12)).drop("before")
        falls = staged(falls, "costs")
        if not falls.limit(1).count():
            return (assigned if done is None else done).select("g", "v", "medoid", "distance")
        going = assigned.join(falls.select("g"), "g", "left_semi")
        done = going if done is None else staged(done.join(falls.select("g"), "g", "left_anti").unionByName(going), "done")
        last, values = falls, going
        medoids = _medoids(values, decode, distance, candidates, counts)
        values = values.select("g", "v", "w", "first")


def _assigned(values: DataFrame, medoids: DataFrame, decode: Decode, distance: Distance) -> DataFrame:
    """values with medoid and distance."""
    # k medoids a group
    listed = medoids.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("medoid", "v"))).alias("m")).select("g", F.transform("m", lambda x: x["v"]).alias("of"), F.transform("m", lambda x: x["medoid"]).alias("numbers"))
    far = measured(values.join(listed, "g"), "of", "far", decode, distance)
    least = F.array_min("far")
    return far.select("g", "v", "w", "first", F.element_at("numbers", F.array_position("far", least).cast("int")).cast("int").alias("medoid"), least.alias("distance"))


def _medoids(assigned: DataFrame, decode: Decode, distance: Distance, candidates: int, counts: dict | None) -> DataFrame:
    """g, medoid, v: the value of each cluster with the least weighted sum of distances, of equal ones the present medoid, then the first."""
    keys = ["g", "medoid"]
    present = F.min(F.when(F.col("distance") == 0, F.struct("first", "v"))).alias("top")
    best = assigned.groupBy(*keys).agg(F.sum("w").alias("whole"), F.sum(F.col("w") * F.col("distance")).alias("cost"), present).select(*keys, "whole", "cost", "top.v")
    # what the present medoid rules out costs nothing: its distances are known
    known = assigned.join(best.select(*keys, "whole", "cost"), keys).withColumn("low", F.abs(F.col("cost") / F.col("whole") - F.col("distance")) * F.col("whole")).drop("cost")
    while True:
        left = known.join(best.select(*keys, "cost"), keys).where(F.col("low") < F.col("cost") * (1 - 1e-12)).drop("cost")
        asked = first_of(left, keys, [F.col("low"), F.col("first"), F.col("v")], candidates).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "v"))).alias("asked"))
        asked = staged(asked, "candidates")
        n = asked.count()
        if not n:
            return best.select(*keys, "v")
        rows = known.join(asked, keys).withColumn("against", F.transform("asked", lambda x: x["v"]))
        rows = staged(measured(rows, "against", "far", decode, distance), "measured")
        if counts is not None:
            counts["measured"] = counts.get("measured", 0) + (rows.agg(F.sum(F.size("far"))).first()[0] or 0)
        each = rows.select(*keys, "w", F.posexplode("far").alias("k", "d")).groupBy(*keys, "k").agg(F.sum(F.col("w") * F.col("d")).alias("total"))
        totals = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "total"))).alias("totals"))  # at most ``candidates`` a row
        totals = staged(totals.join(asked, keys), "totals")
        tried = totals.select(*keys, F.explode(F.arrays_zip("totals", "asked")).alias("x")).groupBy(*keys).agg(F.min(F.struct(F.col("x.totals.total").alias("cost"), F.col("x.asked.first").alias("first"), F.col("x.asked.v").alias("v"))).alias("t"))
        gain = F.coalesce(F.col("t.cost") < F.col("cost") * (1 - 1e-12), F.lit(False))
        best = staged(best.join(tried, keys, "left").select(*keys, "whole", F.when(gain, F.col("t.cost")).otherwise(F.col("cost")).alias("cost"), F.when(gain, F.col("t.v")).otherwise(F.col("v")).alias("v")), "best")
        low = F.array_max(F.zip_with("far", "totals", lambda d, t: F.abs(t["total"] / F.col("whole") - d) * F.col("whole") * (1 - SLACK)))
        out = F.exists("asked", lambda x: x["v"] == F.col("v"))
        known = rows.drop("asked").join(totals, keys).withColumn("low", F.when(out, F.lit(float("inf"))).otherwise(F.greatest("low", low)))
        known = known.drop("far", "totals", "asked", "against")
