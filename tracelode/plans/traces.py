"""The events table as graph profiles: a trace is a user's week, a label is event type and block, a trace fails if a
value in it exceeds 150; an edge leads from each event to the next one, the first from ``entry``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

ENTRY = "entry"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id (user and week), ts, event_id, label, fn_name, bbid, value."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    bbid = (F.floor(F.col("value") / 10) % 4).cast("int")
    graph = F.struct("user_id", F.date_trunc("week", "ts").alias("wk"))
    return e.select(graph.alias("graph_id"), "ts", "event_id", F.concat(F.col("event_type"), F.lit(" blk "), bbid.cast("string")).alias("label"), F.col("event_type").alias("fn_name"), bbid.alias("bbid"), "value")


def outcomes(events: DataFrame) -> DataFrame:
    """graph_id, outcome."""
    return events.groupBy("graph_id").agg(F.when(F.max(F.when(F.col("value") > 150, 1).otherwise(0)) == 1, "fail").otherwise("ok").alias("outcome"))


def _failed(window: WindowSpec) -> Column:
    """outcome, found where a trace's events meet anyway."""
    return F.when(F.max(F.when(F.col("value") > 150, 1).otherwise(0)).over(window) == 1, "fail").otherwise("ok").alias("outcome")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """outcome, graph_id, label, fn_name, bbid, one row for each label of a trace."""
    e = steps(spark, sf_dir)
    return e.select("graph_id", "label", "fn_name", "bbid", _failed(Window.partitionBy("graph_id"))).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """outcome, graph_id, src, dst, traversed."""
    e = steps(spark, sf_dir)
    w = Window.partitionBy("graph_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flows = e.select("graph_id", F.coalesce(F.lag("label").over(w), F.lit(ENTRY)).alias("src"), F.col("label").alias("dst"), _failed(whole))
    return flows.groupBy("graph_id", "src", "dst", "outcome").agg(F.count("*").alias("traversed")).select("graph_id", "src", "dst", "traversed", "outcome")


def labels(edges: DataFrame) -> DataFrame:
    """outcome, graph_id, label of the traces that edges are of: an edge leads to each event.  A label may come more than once."""
    return edges.select("outcome", "graph_id", F.col("dst").alias("label"))


#: The same in SQL: ev (events with label), tr (traces), v (labels of traces), fl (edges of traces), n (totals).
SQL = """
with ev as (select user_id, date_trunc('week', ts) wk, ts, event_id, event_type, cast(floor(value/10) % 4 as int) bbid,
                   event_type || ' blk ' || cast(floor(value/10) % 4 as int) as label, value from events),
     tr as (select user_id, wk, max(case when value > 150 then 1 else 0 end) failed from ev group by user_id, wk),
     v  as (select distinct e.user_id, e.wk, e.label, e.event_type, e.bbid, t.failed from ev e join tr t on e.user_id = t.user_id and e.wk = t.wk),
     fl0 as (select user_id, wk, coalesce(lag(label) over (partition by user_id, wk order by ts, event_id), 'entry') src, label dst from ev),
     fl as (select f.user_id, f.wk, f.src, f.dst, count(*) traversed, max(t.failed) failed from fl0 f join tr t on f.user_id = t.user_id and f.wk = t.wk group by all),
     n  as (select sum(failed) nf, sum(1 - failed) n_ok, count(*) nt from tr)"""
