"""Files of object profiles: a line of types, then a function's profile a line, as JSON.

Every line tells by its keys what it is, so files are read by lines: a file of any size is split among tasks, and several files, or a folder, may
be read at once.  Lines that aren't JSON of either kind are skipped, as are blank ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARAM = "array<array<struct<Name string, Val variant>>>"


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """func_name, seq, inputs, outputs (arrays of arrays of struct<Name, Val> with Val as VARIANT); seq grows with file and line."""
    lines = spark.read.text(path).where(F.col("value").contains('"FuncName"')).select("value", F.monotonically_increasing_id().alias("seq"))
    decoded = lines.select("seq", F.from_json("value", f"FuncName string, In {_PARAM}, Out {_PARAM}").alias("p")).where("p.FuncName is not null")
    empty = F.array().cast(_PARAM)
    return decoded.select(F.col("p.FuncName").alias("func_name"), "seq", F.coalesce("p.In", empty).alias("inputs"), F.coalesce("p.Out", empty).alias("outputs"))


def types(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """type_id (place in the list), type (VARIANT): what the files' lines of types list, each distinct one once."""
    lines = spark.read.text(path).where(F.col("value").contains('"Types"') & ~F.col("value").contains('"FuncName"'))
    decoded = lines.select(F.from_json("value", "Types array<variant>").alias("t")).select(F.posexplode("t.Types").alias("type_id", "type"))
    return decoded.groupBy("type_id", F.to_json("type").alias("json")).agg(F.lit(1)).select("type_id", F.parse_json("json").alias("type"))


def write(profiles: DataFrame, path: str, types_line: str = '{"Types":[]}') -> None:
    """A line of types in each file, then func_name, inputs, outputs (arrays of arrays of struct<Name, Val>, Val as VARIANT or JSON-like structs) as JSON."""
    value = F.to_json(F.struct(F.col("func_name").alias("FuncName"), F.col("inputs").alias("In"), F.col("outputs").alias("Out")))
    rows = profiles.select(value.alias("value"))
    rows.unionByName(profiles.sparkSession.range(1).select(F.lit(types_line).alias("value"))).write.text(path)
