"""Mutation points as a table: filters and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Growth of the rate while no point would be drawn.
GROWTH = 1.01


def of_kinds(points: DataFrame, kinds: list[str], column: str = "kind") -> DataFrame:
    """Points of the kinds, or all for no kinds."""
    return points.where(F.col(column).isin(kinds)) if kinds else points


def excluded(package: Column, denied: list[str]) -> Column:
    """Whether a package, or its first path segment, is on the list."""
    return package.isin(denied) | F.split(package, "/")[0].isin(denied)


def allowed(points: DataFrame, denied: list[str], only: list[str] | None = None, column: str = "package") -> DataFrame:
    kept = points.where(~excluded(F.col(column), denied))
    return kept.where(F.col(column).isin(only)) if only else kept


def sample(points: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """n points, uniformly without replacement, the same ones for the same seed; asking for more than there are is an error."""
    there = points.count()
    if n > there:
        raise ValueError(f"{n} points asked of {there}")
    return points.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def sample_rate(points: DataFrame, rate: float, seed: int = 0, key: str = "id") -> DataFrame:
    """That share of the points; the rate grows until there is at least one."""
    there = points.count()
    if there and rate > 0:
        while int(rate * there) < 1:
            rate *= GROWTH
    return sample(points, min(int(rate * there), there), seed, key)


def exported(points: DataFrame) -> DataFrame:
    """Mutations as JSON lines: kind, mutation, fn_name, bbid, file, offset, line, column."""
    place = F.struct(F.col("file").alias("Filename"), F.col("offset").alias("Offset"), F.col("line").alias("Line"), F.col("column").alias("Column"))
    return points.select(F.to_json(F.struct(F.col("kind").alias("Type"), F.col("mutation").alias("Mutation"), F.col("fn_name").alias("FnName"), F.col("bbid").alias("BasicBlockId"), place.alias("SrcPosition"))).alias("value"))
