"""Patterns as values: canonical form, key, and text.

A pattern is struct<v: array<string>, e: array<struct<s: int, t: int, label: string>>>: vertex labels, and edges between
positions.  In Python it is a pair of lists.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Pattern = tuple[list[str], list[tuple[int, int, str]]]
PATTERN = T.StructType([
    T.StructField("v", T.ArrayType(T.StringType())),
    T.StructField("e", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("label", T.StringType())]))),
])
def _refined(colour: list, e: list[tuple[int, int, str]]) -> list[int]:
    """Ranks of the vertices' colours, told apart by what their neighbours are until it settles."""
    n = len(colour)
    while True:
        rank = {c: k for k, c in enumerate(sorted(set(colour)))}
        now = [rank[c] for c in colour]
        near: list[list] = [[] for _ in range(n)]
        for s, t, label in e:
            near[s].append((0, label, now[t]))
            near[t].append((1, label, now[s]))
        colour = [(now[k], tuple(sorted(near[k]))) for k in range(n)]
        if len(set(colour)) == len(rank):
            return now


def canonical(v: list[str], e: list[tuple[int, int, str]]) -> Pattern:
    """The same pattern in canonical form."""
    return canonical_order(v, e)[0]


def canonical_order(v: list[str], e: list[tuple[int, int, str]]) -> tuple[Pattern, list[int]]:
    """The canonical form, and which vertex of the pattern stands in each of its places.

    Vertices are ordered by label, then by what their neighbours are.  Where vertices are still alike, each of the first alike ones is set apart in turn and the rest refined anew; the order with the smallest edge list wins.

    The search is whole.  Of vertices that can be swapped without changing the pattern only one is set apart, so many alike ones cost no more.
    """
    best: tuple[Pattern, list[int]] | None = None
    edges = sorted(e)

    def swappable(a: int, b: int) -> bool:
        to = {a: b, b: a}
        return sorted((to.get(s, s), to.get(t, t), label) for s, t, label in e) == edges

    def search(rank: list[int]) -> None:
        nonlocal best
        cells: dict[int, list[int]] = {}
        for k, r in enumerate(rank):
            cells.setdefault(r, []).append(k)
        alike = next((cells[r] for r in sorted(cells) if len(cells[r]) > 1), None)
        if alike is None:
            order = sorted(range(len(v)), key=rank.__getitem__)
            place = {k: p for p, k in enumerate(order)}
            found = ([v[k] for k in order], sorted((place[s], place[t], label) for s, t, label in e))
            best = (found, order) if best is None or found[1] < best[0][1] else best
            return
        tried: list[int] = []
        for k in alike:
            if not any(swappable(k, other) for other in tried):
                tried.append(k)
                search(_refined([(r, j != k) for j, r in enumerate(rank)], e))

    search(_refined([(x,) for x in v], e))
    return best


def key(v: list[str], e: list[tuple[int, int, str]]) -> bytes:
    """A binary key, the same for patterns that are the same: counts, then length-prefixed labels and edges, big endian."""
    v, e = canonical(v, e)
    text = lambda s: struct.pack(">I", len(s.encode())) + s.encode()
    return struct.pack(">II", len(e), len(v)) + b"".join(map(text, v)) + b"".join(struct.pack(">II", s, t) + text(l) for s, t, l in e)


def from_key(data: bytes) -> Pattern:
    at = 8

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("a pattern's key is cut short")
        at += n
        return data[at - n : at]

    text = lambda: take(struct.unpack(">I", take(4))[0]).decode()
    n_e, n_v = struct.unpack(">II", data[:8])
    v = [text() for _ in range(n_v)]
    e = [(*struct.unpack(">II", take(8)), text()) for _ in range(n_e)]
    if at != len(data):
        raise ValueError("a pattern's key is too long")
    return v, e


_ESCAPED = re.compile(r"([()\[\]\\])")


def pretty(v: list[str], e: list[tuple[int, int, str]]) -> str:
    """{edges:vertices}(label)...[source->target:label]..."""
    esc = lambda s: _ESCAPED.sub(r"\\\1", s)
    return f"{{{len(e)}:{len(v)}}}" + "".join(f"({esc(x)})" for x in v) + "".join(f"[{s}->{t}:{esc(l)}]" for s, t, l in e)


def parse_pretty(text: str) -> Pattern:
    """What pretty writes; brackets inside labels may also stand in balanced pairs without a backslash."""
    head = re.match(r"\{(\d+):(\d+)\}", text)
    if not head:
        raise ValueError(f"no counts at the start of {text!r}")
    at = head.end()

    def label(open_: str, close: str) -> str:
        nonlocal at
        depth, out = 1, []
        while at < len(text):
            c = text[at]
            at += 1
            if c == "\\" and at < len(text):
                c = text[at]
                at += 1
            elif c == open_:
                depth += 1
            elif c == close:
                depth -= 1
                if not depth:
                    return "".join(out)
            out.append(c)
        raise ValueError(f"an open bracket in {text!r}")

    v, e = [], []
    for _ in range(int(head[2])):
        if text[at : at + 1] != "(":
            raise ValueError(f"a vertex is missing in {text!r}")
        at += 1
        v.append(label("(", ")"))
    for _ in range(int(head[1])):
        m = re.compile(r"\[(\d+)->(\d+):").match(text, at)
        if not m:
            raise ValueError(f"an edge is missing in {text!r}")
        at = m.end()
        e.append((int(m[1]), int(m[2]), label("[", "]")))
    return v, e


def dotty(pattern: Column) -> Column:
    """A pattern as a Graphviz digraph."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    v = F.transform(pattern["v"], lambda x, k: F.concat(F.lit("n"), k.cast("string"), F.lit(" [label="), quoted(x), F.lit("];")))
    e = F.transform(pattern["e"], lambda x: F.concat(F.lit("n"), x["s"].cast("string"), F.lit("->n"), x["t"].cast("string"), F.lit(" [label="), quoted(x["label"]), F.lit("]")))
    return F.concat(F.lit("digraph{\n"), F.array_join(F.concat(v, e), "\n"), F.lit("\n}"))


def _parts(row: dict) -> Pattern:
    return list(row["v"]), [(x["s"], x["t"], x["label"]) for x in row["e"]]


@F.pandas_udf(T.BinaryType())
def pattern_key(p: pd.DataFrame) -> pd.Series:
    """Patterns' keys."""
    return pd.Series([key(*_parts(r)) for r in p.to_dict("records")])


@F.pandas_udf(T.StringType())
def pattern_pretty(p: pd.DataFrame) -> pd.Series:
    return pd.Series([pretty(*_parts(r)) for r in p.to_dict("records")])


@F.pandas_udf(PATTERN)
def pattern_of(text: pd.Series) -> pd.DataFrame:
    """Patterns from their text."""
    found = [parse_pretty(t) for t in text]
    return pd.DataFrame({"v": [v for v, _ in found], "e": [[{"s": s, "t": t, "label": l} for s, t, l in e] for _, e in found]})


def label_pattern(edges: Column) -> Column:
    """The pattern struct of an array of struct<src, dst> label edges, in graphs whose labels are unique."""
    v = F.array_sort(F.array_distinct(F.flatten(F.transform(edges, lambda x: F.array(x["src"], x["dst"])))))
    e = F.transform(edges, lambda x: F.struct((F.array_position(v, x["src"]) - 1).cast("int").alias("s"), (F.array_position(v, x["dst"]) - 1).cast("int").alias("t"), F.lit("").alias("label")))
    return F.struct(v.alias("v"), F.array_sort(e).alias("e"))
