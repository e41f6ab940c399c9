"""Smaller test inputs: ranges of an input that may go, and the greedy search for the smallest one that still fails.

A range [i, j] is inclusive and in bytes.  The generators are table functions, one for each kind; a search
round tries a sample of ranges, all at once as rows, and takes the first that keeps the property.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf


def offsets(data: bytes) -> list[int]:
    """Of the first byte, each line feed and the last byte."""
    if not data:
        return []
    found = [0, *(k for k, c in enumerate(data) if c == 10)]
    return found if found[-1] == len(data) - 1 else [*found, len(data) - 1]


def _line_start(data: bytes, at: int) -> int:
    return min(at + 1, len(data) - 1) if data[at] == 10 else at


def line_ranges(data: bytes) -> list[tuple[int, int]]:
    """Each line with its line feed."""
    at = offsets(data)
    pairs = [(_line_start(data, a) if a else 0, b) for a, b in zip(at, at[1:], strict=False)]
    return [(i, j) for i, j in pairs if i <= j]


def line_end_ranges(data: bytes) -> list[tuple[int, int]]:
    """From each line to the end."""
    last = len(data) - 1
    return [(a + 1, last) for a in offsets(data) if a + 1 < last]


def line_start_ranges(data: bytes) -> list[tuple[int, int]]:
    """From the start to each line."""
    return [(0, a) for a in offsets(data)]


def block_span(size: int, most: int) -> int:
    """Lines or bytes that a block spans at most: a tenth of all, 15 at least, capped."""
    return min(max(15, size // 10), most)


def line_block_ranges(data: bytes) -> list[tuple[int, int]]:
    """Runs of lines."""
    at = offsets(data)
    span = block_span(len(at), 100)
    pairs = [(_line_start(data, at[a]), at[b]) for a in range(len(at)) for b in range(a + 1, min(a + span, len(at)))]
    return [(i, j) for i, j in pairs if i + 1 < j]


def block_ranges(data: bytes) -> list[tuple[int, int]]:
    """Runs of up to ten bytes."""
    span = block_span(len(data), 10)
    return [(i, j) for i in range(len(data)) for j in range(i, min(i + span, len(data)))]


def line_curly_ranges(data: bytes) -> list[tuple[int, int]]:
    """From the line in which a brace opens to the end of the line in which its partner closes."""
    out, open_, closed, line = [], [], [], 0
    for k, c in enumerate(data):
        if k and data[k - 1] == 10:
            line = k
        if c == 123:
            open_.append(line)
        elif c == 125 and open_:
            closed.append(open_.pop())
        elif c == 10:
            out += [(a, k) for a in closed]
            closed = []
    return out


def curly_ranges(data: bytes) -> list[tuple[int, int]]:
    """Each pair of curly braces that belong together, in order of the closing one."""
    out, open_ = [], []
    for k, c in enumerate(data):
        if c == 123:
            open_.append(k)
        elif c == 125 and open_:
            out.append((open_.pop(), k))
    return out


GENERATORS: dict[str, Callable[[bytes], list[tuple[int, int]]]] = {
    "lines": line_ranges, "line_ends": line_end_ranges, "line_starts": line_start_ranges, "line_blocks": line_block_ranges, "blocks": block_ranges, "curly": curly_ranges, "line_curly": line_curly_ranges,
}


@udtf(returnType=T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))
class Ranges:
    """ranges(kind, text): the ranges of one generator."""

    def eval(self, kind: str, text: str) -> Iterator[tuple[int, int]]:
        yield from GENERATORS[kind]((text or "").encode())


def ranges(inputs: DataFrame, kind: str) -> DataFrame:
    """id, i, j for every range of every input.  inputs: id, text."""
    if kind not in GENERATORS:
        raise ValueError(f"no generator {kind}")
    spark = inputs.sparkSession
    spark.udtf.register("tracelode_ranges", Ranges)
    inputs.createOrReplaceTempView("tracelode_inputs")
    return spark.sql(f"SELECT id, i, j FROM tracelode_inputs, LATERAL tracelode_ranges('{kind}', text)")


def without_range(text: Column, i: Column, j: Column) -> Column:
    """text without bytes i to j."""
    b = F.encode(text, "UTF-8")
    return F.decode(F.concat(F.substring(b, F.lit(1), i), F.substring(b, j + 2, F.octet_length(text))), "UTF-8")


def line_ranges_native(inputs: DataFrame) -> DataFrame:
    """id, i, j of the lines, as line_ranges but in DataFrame functions."""
    lines = inputs.select("id", "text", F.split("text", "\n").alias("lines")).where(F.octet_length("text") > 0)
    size = F.octet_length("text")

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + F.octet_length(x) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("i"), F.least(acc["at"] + F.octet_length(x), size - 1).alias("j")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,j:int>>").alias("out"))
    found = lines.select("id", size.alias("n"), F.contains("text", F.lit("\n")).alias("fed"), F.explode(F.aggregate("lines", start, step, lambda a: a["out"])).alias("r"))
    # a range behind a line feed at the very start takes that in
    return found.where("r.i <= r.j AND (fed OR n > 1)").select("id", F.when(F.col("r.i") == 1, 0).otherwise(F.col("r.i")).alias("i"), "r.j")


def minimise(spark, text: str, still_fails: Callable[[str], bool], phases: tuple[tuple[str, int], ...] = (("lines", 50), ("line_blocks", 50), ("curly", 50), ("line_ends", 150), ("blocks", 50)), seed: int = 0) -> str:
    """The smallest text that the greedy search finds for which still_fails holds.

    Each round draws at most the phase's number of ranges, tries them as rows of one job, and goes on from the first (in
    drawing order) that keeps the property; a phase ends when none does.
    """
    for kind, sample in phases:
        step, kept = 0, True
        while kept:
            found = GENERATORS[kind](text.encode())
            if not found:
                break
            # draw first: the text travels once, not once a range
            order = F.xxhash64(F.lit(seed + step), "id")
            drawn = [r["id"] for r in spark.range(len(found)).orderBy(order).limit(sample).collect()]
            shared = spark.sparkContext.broadcast(text.encode())

            def tried(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                for b in batches:
                    cut = (shared.value[:i] + shared.value[j + 1 :] for i, j in zip(b["i"], b["j"], strict=True))
                    yield b[[bool(still_fails(t.decode(errors="replace"))) for t in cut]]

            asked = spark.createDataFrame([(o, *found[k]) for o, k in enumerate(drawn)], "o int, i int, j int")
            kept = asked.mapInPandas(tried, "o int, i int, j int").orderBy("o").limit(1).collect()
            if kept:
                data = text.encode()
                text = (data[: kept[0]["i"]] + data[kept[0]["j"] + 1 :]).decode(errors="replace")
            shared.destroy()
            step += 1
    return text
