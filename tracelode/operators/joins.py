"""Joins of rows with a table of one row a key, where few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of at most so many rows is never split; and the most keys that are, whatever the number of rows.
WHOLE, KEYS = 512, 20_000


def join_split(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The inner join of rows with keyed on ``key``, without ``count``.

    keyed has one row a key and says in ``count`` how many of the ``total`` rows have it.  A key of over total / KEYS rows (so
    of these there are at most KEYS: the bound of what is broadcast) is dealt in parts by a hash of its rows, and its one row
    goes to each part.  Null keys match nothing.
    """
    limit = max(WHOLE, -(-total // KEYS))
    names = {c.lower() for c in rows.columns + keyed.columns}
    part, parts = (next(n for k in range(len(names) + 1) if (n := f"{base}{k or ''}") not in names) for base in ("part", "parts"))
    dealt = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    heavy = keyed.where(F.col(count) > limit).select(key, dealt.alias(parts))
    spread = rows.join(F.broadcast(heavy), key, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col(parts)).cast("int"), F.lit(0))).drop(parts)
    copies = keyed.withColumn(part, F.explode(F.sequence(F.lit(0), F.greatest(dealt, F.lit(1)) - 1))).drop(count)
    return spread.join(copies, [key, part]).drop(part)
