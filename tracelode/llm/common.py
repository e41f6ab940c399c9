"""What the operators share: reading tables, the shared folder, cutting lineage, Arrow helpers.

Conventions of every operator:

* it selects the columns that it needs, so extra columns of any name do no harm;
* a null text is an empty text; a null id stays a null id;
* whatever a task hands to Python arrives in Arrow batches bounded by rows, and state inside a task is
  bounded by a documented parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_path, partitions, shared_dir, staged

__all__ = ["fresh_name", "map_batches", "new_path", "partitions", "quoted", "shared_dir", "staged", "table", "texts"]

#: Rows and bytes in one Arrow batch, whichever is reached first; a longer text is a batch by itself.
BATCH_ROWS, BATCH_BYTES = "256", str(16 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; only Spark's reader opens the path."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what Spark hands to Python at once, for the whole session: it has no setting of one operator.  The queries and the
    pipeline call this; the operators leave the session as it is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh_name(columns: list[str], base: str) -> str:
    """base, or base with as many underscores as make it none of the columns."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and back quotes in them included."""
    return [F.col(quote(c)) for c in columns]


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just key and text, null texts as empty ones."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """fn takes a dict of column lists of one batch (strings as UTF-8 bytes) and returns a dict of columns; done is called
    at the end of each task."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn({n: as_list(b.column(i)) for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in arrow], schema=arrow)
        if done:
            done()

    return df.mapInArrow(run, schema)


def as_list(column: pa.Array) -> list:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return column.to_pylist()


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
