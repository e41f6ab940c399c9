"""Ranking with ties, and what rankings are worth against known faults.

Rows are ordered by score, highest first; NaN scores come last; equal scores form a group.  Groups are aggregated
before any global order is needed, so the single ordered partition holds a row for each distinct score only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import partitions, staged


def order_key(score: Column) -> Column:
    """Ascending order of this is the ranking's order."""
    return F.when(F.isnan(score) | score.isNull(), F.lit(float("inf"))).otherwise(-score)


def tie_groups(ranked: DataFrame, score: str = "score") -> DataFrame:
    """One row a distinct score: order_key, score_group (from 1), size, before (rows in earlier groups)."""
    groups = staged(ranked.groupBy(order_key(F.col(score)).alias("order_key")).agg(F.count("*").alias("size")), "groups")
    ranged = _ranged(groups, "order_key")
    inside = Window.partitionBy("part_of_range").orderBy("order_key")
    sizes = ranged.groupBy("part_of_range").agg(F.count("*").alias("n"), F.sum("size").alias("rows"))
    earlier = Window.orderBy("part_of_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = sizes.select("part_of_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "rows")))
    before = F.col("rows_before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = (F.col("n_before") + F.row_number().over(inside)).cast("int")
    return ranged.join(F.broadcast(bases), "part_of_range").select("order_key", group.alias("score_group"), "size", before.alias("before"))


def _ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df, which is written already, in ranges of the order, with the number of its range in part_of_range; written."""
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order)
    return staged(ranged.withColumn("part_of_range", F.spark_partition_id()), "ranged")


def with_groups(ranked: DataFrame, score: str = "score") -> DataFrame:
    """ranked with score_group, size, before and mid_rank (rows in earlier groups plus half its group's)."""
    key = _fresh(ranked, "order_key")
    keyed, groups = ranked.withColumn(key, order_key(F.col(score))), tie_groups(ranked, score)
    return keyed.join(groups.withColumnRenamed("order_key", key), key).drop(key).withColumn("mid_rank", F.col("before") + F.col("size") / 2)


def _fresh(df: DataFrame, base: str) -> str:
    """base, or base with as many underscores as make it no column of df."""
    names = {c.lower() for c in df.columns}
    while base in names:
        base += "_"
    return base


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in the given order.  Rows are dealt by ranges and sorted inside of them; only the number of
    rows in each range (a row a partition) is added up in one place."""
    df = staged(df, "unnumbered")  # ranges are found by a pass of their own
    row, part, n, ahead = (_fresh(df, c) for c in ("row_of_order", "part_of_order", "n_of_part", "n_ahead"))
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = staged(ranged.withColumn(row, F.monotonically_increasing_id()), "numbered")
    of = F.shiftright(row, 33)
    sizes = rows.groupBy(of.alias(part)).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(sizes.select(part, before.alias(ahead)))  # a row a partition
    inside = F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(part, of).join(bases, part).withColumn(name, (F.col(ahead) + inside + 1).cast("long")).drop(part, row, ahead)


def with_place(ranked: DataFrame, *ties: str, score: str = "score", name: str = "place") -> DataFrame:
    """ranked with place: 1 for the best score, ties broken by the given columns."""
    return numbered(ranked, order_key(F.col(score)), *ties, name=name)


def top_k(ranked: DataFrame, k: int, *ties: str, score: str = "score") -> DataFrame:
    """The k best rows, ties broken by the given columns."""
    return ranked.orderBy(order_key(F.col(score)), *ties).limit(k)


def unique_first(nodes: DataFrame, key: str, score: str = "score") -> DataFrame:
    """One row for each key, that of the best score."""
    names = [c for c in nodes.columns if c != key]
    return nodes.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(order_key(F.col(score)), *[c for c in names if c != score])).alias("best")).select(key, "best.*")


def rank_eval(ranked: DataFrame, faults: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """One row, rank: the smallest mid-rank of a faulty location (null if none is ranked)."""
    return with_groups(ranked, score).join(faults.select(*keys).distinct(), list(keys), "left_semi").agg(F.min("mid_rank").alias("rank"))


def hit_rank_eval(ranked: DataFrame, faults: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """One row, rank and score_group: expected looks until a fault is met, looking through groups in random order:
    (hits + misses + 1) / (hits + 1) within the first group with a hit plus the size of the groups before it;
    infinite and -1 if no location is faulty."""
    groups = with_groups(ranked, score).join(faults.select(*keys).distinct().withColumn("hit", F.lit(1)), list(keys), "left")
    per = groups.groupBy("score_group", "before", "size").agg(F.count("hit").alias("hits")).where("hits > 0")
    ranks = per.withColumn("rank", (F.col("size") + 1) / (F.col("hits") + 1) + F.col("before"))
    best = ranks.agg(F.min("rank").alias("r"), F.min_by("score_group", F.struct("rank", "score_group")).alias("g"))
    return best.select(F.coalesce("r", F.lit(float("inf"))).alias("rank"), F.coalesce("g", F.lit(-1)).alias("score_group"))


def average_results(results: DataFrame) -> DataFrame:
    """Mean rank and score by case; a name that differs within a case is blank.  results: case_id, method, eval, rank, score."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c)).otherwise(F.lit("")).alias(c)
    return results.groupBy("case_id").agg(one("method"), one("eval"), F.avg("rank").alias("rank"), F.avg("score").alias("score"))


def result_lines(results: DataFrame) -> DataFrame:
    """Results as JSON lines; an infinite rank is -1."""
    rank = F.when(F.abs("rank") == float("inf"), F.lit(-1.0)).otherwise(F.col("rank"))
    return results.select(F.to_json(F.struct(rank.alias("rank"), "method", "score", "eval")).alias("value"))


def stats_table(stats: DataFrame) -> DataFrame:
    """value: the rows of compare_stats as lines of a comma-separated table of fixed width."""
    cells = [F.format_string("%-24s", "method"), F.format_string("%8d", "n"), *(F.format_string("%14.6f", c) for c in ("sum", "mean", "stddev", "stderr"))]
    return stats.orderBy("method").select(F.concat_ws(", ", *cells).alias("value"))


def compare_stats(outputs: DataFrame) -> DataFrame:
    """outputs: method, place, score.  All methods are cut to the shortest; then by method: n, sum, mean, stddev (of the
    sample from three values on), and the root of the mean squared difference from the first method (over n - 1 from three values
    on), negative where the first method's sum is the smaller one."""
    shortest = outputs.groupBy("method").agg(F.count("*").alias("n")).agg(F.min("n").alias("shortest"))
    cut = outputs.join(F.broadcast(shortest)).where("place <= shortest").drop("shortest")
    first = outputs.agg(F.min("method").alias("first_method"))
    base = cut.join(F.broadcast(first)).where("method = first_method").select("place", F.col("score").alias("base"))
    both = cut.join(base, "place").withColumn("d", F.col("score") - F.col("base"))
    squares = F.sum(F.col("d") * F.col("d")) / F.when(F.count("*") > 2, F.count("*") - 1).otherwise(F.count("*"))
    deviation = F.when(F.count("*") > 2, F.stddev_samp("score")).otherwise(F.stddev_pop("score"))
    return both.groupBy("method").agg(
        F.count("*").alias("n"), F.sum("score").alias("sum"), F.avg("score").alias("mean"), deviation.alias("stddev"), (F.sqrt(squares) * F.when(F.sum("d") > 0, -1).otherwise(1)).alias("stderr")
    )
