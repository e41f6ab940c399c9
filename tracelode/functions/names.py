"""Names, hashes and durations of profile rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset and prime of the 64-bit FNV-1a hash.
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3
_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def block_name(fn: Column, bbid: Column) -> Column:
    """``<function> blk <number>``; the entry for neither, ``unknown`` for a function that isn't known."""
    return F.when(fn.isNull() & (F.coalesce(bbid, F.lit(0)) == 0), F.lit("entry")).otherwise(F.concat(F.coalesce(fn, F.lit("unknown")), F.lit(" blk "), F.coalesce(bbid, F.lit(0)).cast("string")))


def fnv1a(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = (h ^ b) * _PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def identity_hash(text: Column) -> Column:
    """A 64-bit hash for identity only."""
    return F.xxhash64(text)


def duration_nanos(text: str) -> int:
    """``1.5ms``, ``2m0.1s`` or ``-3h`` in nanoseconds."""
    sign = -1 if text.startswith("-") else 1
    body = text.lstrip("+-")
    if body == "0":
        return 0
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"no duration: {text}")
    return sign * sum(round(float(n) * _UNITS[u]) for n, u in parts)


def duration_column(text: Column) -> Column:
    """The same in DataFrame functions, null for what is no duration."""
    body = F.regexp_replace(text, "^[+-]", "")
    numbers, units = F.regexp_extract_all(body, F.lit(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|ms|s|m|h)"), F.lit(1)), F.regexp_extract_all(body, F.lit(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|ms|s|m|h)"), F.lit(2))
    scale = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: F.round(n.cast("double") * scale[u]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    whole = F.array_join(F.zip_with(numbers, units, lambda n, u: F.concat(n, u)), "") == body
    return F.when(body == "0", F.lit(0).cast("long")).when((F.size(numbers) > 0) & whole, F.when(text.startswith("-"), -total).otherwise(total))
