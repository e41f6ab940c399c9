"""Known faults and object profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MUTATION = "Type STRING, Mutation STRING, FnName STRING, BasicBlockId INT, SrcPosition STRUCT<Filename: STRING, Offset: INT, Line: INT, Column: INT>"


def mutations(spark: SparkSession, path: str) -> DataFrame:
    """kind, mutation, fn_name, bbid, file, offset, line, column of JSON lines; blank lines are skipped."""
    raw = spark.read.schema(_MUTATION).option("mode", "FAILFAST").json(path)
    p = "SrcPosition"
    return raw.select(F.col("Type").alias("kind"), F.col("Mutation").alias("mutation"), F.col("FnName").alias("fn_name"), F.col("BasicBlockId").alias("bbid"), F.col(f"{p}.Filename").alias("file"), F.col(f"{p}.Offset").alias("offset"), F.col(f"{p}.Line").alias("line"), F.col(f"{p}.Column").alias("column"))


def faults(spark: SparkSession, path: str) -> DataFrame:
    """position, fn_name, bbid, each once."""
    m = mutations(spark, path)
    return m.select(F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string")).alias("position"), "fn_name", "bbid").distinct()


def line_faults(spark: SparkSession, path: str) -> DataFrame:
    """position, fn_name, bbid of ``path#line[#...]`` lines; the line must be a number."""
    parts = F.split(F.trim("value"), "#")
    raw = spark.read.text(path).where(F.trim("value") != "")
    line = F.when(parts[1].rlike("^[0-9]+$"), parts[1]).otherwise(F.raise_error(F.concat(F.lit("no line number: "), F.col("value"))))
    return raw.select(F.concat_ws(":", parts[0], line).alias("position"), F.lit("").alias("fn_name"), F.lit(0).alias("bbid")).distinct()


def source_position(label: Column) -> Column:
    """org.x.Foo#42 as org/x/Foo.java:42."""
    return F.regexp_replace(F.translate(label, ".", "/"), "^([^#]*)#", "$1.java:")


def object_profiles(spark: SparkSession, path: str) -> DataFrame:
    """path, func_name, inputs, outputs (arrays of arrays of struct<Name, Val> with Val as VARIANT): the first line of a file
    lists types, each other line is a function's profile."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("l"))
    rows = raw.select("path", F.explode(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("line")).where(F.trim("line") != "")
    param = "array<array<struct<Name string, Val variant>>>"
    decoded = rows.select("path", F.from_json("line", f"FuncName string, In {param}, Out {param}").alias("p"))
    return decoded.select("path", F.col("p.FuncName").alias("func_name"), F.col("p.In").alias("inputs"), F.col("p.Out").alias("outputs"))


def failures(events: DataFrame) -> DataFrame:
    """value: one JSON line a failed position of a run.  events: exec_id, position, fn_name, bbid."""
    once = events.dropDuplicates(["exec_id", "position"])
    return once.select(F.to_json(F.struct(F.col("position").alias("Position"), F.col("fn_name").alias("FnName"), F.col("bbid").alias("BasicBlockId"))).alias("value"))


def functions_json(cfg: DataFrame) -> DataFrame:
    """value: {name: {CFG, IPDom, Calls, DynCDP}} of a function a line.  cfg: fn, cfg, ipdom, calls, dyn_cdp."""
    return cfg.select(F.to_json(F.create_map("fn", F.struct(F.col("cfg").alias("CFG"), F.col("ipdom").alias("IPDom"), F.col("calls").alias("Calls"), F.col("dyn_cdp").alias("DynCDP")))).alias("value"))
