"""Graphviz profiles: each ``digraph`` is a graph, subgraphs inside it are skipped.

A line that begins with ``digraph`` separates records, so files are read in byte ranges as in ``simple``; graphs that begin elsewhere stay in
the record before.  A quoted text with such a line inside is an error, as its record ends in the middle of a graph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .simple import Parsed, flattened, parsed, quoted, records

VERTICES = "vid string, label string, bbid int, fn_name string, position string, attrs map<string,string>"
EDGES = "src string, dst string, label string, traversed long"
START = "\ndigraph"
_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|->|--|[{}\[\];,=]|[^\s{}\[\];,="-]+(?:-(?!>)[^\s{}\[\];,="-]*)*|-(?!>)[0-9.]+|#[^\n]*', re.S)


def _word(t: str) -> str:
    return re.sub(r"\\(.)", r"\1", t[1:-1]) if t.startswith('"') else t


def parse(text: str) -> Iterator[tuple[int, dict[str, dict[str, str]], list[tuple[str, str, dict[str, str]]]]]:
    """(number, attributes by vertex id, edges) of each digraph.  An endpoint that isn't declared is a vertex too."""
    toks = [t for t in _TOKEN.findall(text) if not t.startswith(("//", "/*", "#"))]
    at, number = 0, 0
    while at < len(toks):
        if toks[at].lower() != "digraph":
            at += 1
            continue
        while toks[at] != "{":
            at += 1
        at += 1
        vertices: dict[str, dict[str, str]] = {}
        edges = []
        while toks[at] != "}":
            if toks[at].lower() == "subgraph" or toks[at] == "{":
                while toks[at] != "{":
                    at += 1
                depth = 1
                while depth:
                    at += 1
                    depth += {"{": 1, "}": -1}.get(toks[at], 0)
                at += 1
                continue
            if toks[at] in ";,":
                at += 1
                continue
            chain = [_word(toks[at])]
            at += 1
            if toks[at] == "=":  # a graph attribute
                at += 2
                continue
            while toks[at] == "->":
                chain.append(_word(toks[at + 1]))
                at += 2
            attrs: dict[str, str] = {}
            while toks[at] == "[":
                at += 1
                while toks[at] != "]":
                    if toks[at] in ";,":
                        at += 1
                        continue
                    key, value = _word(toks[at]), "true"
                    if toks[at + 1] == "=":
                        value = _word(toks[at + 2])
                        at += 2
                    attrs[key] = value
                    at += 1
                at += 1
            if len(chain) == 1:
                if chain[0].lower() not in ("node", "edge", "graph"):
                    vertices.setdefault(chain[0], {}).update(attrs)
            else:
                for s, d in zip(chain, chain[1:], strict=False):
                    vertices.setdefault(s, {})
                    vertices.setdefault(d, {})
                    edges.append((s, d, attrs))
        at += 1
        yield number, vertices, edges
        number += 1


def _graphs(text: str, first: bool) -> Parsed:
    try:
        for _, vs, es in parse(text if first else "digraph" + text):
            name = {i: a.get("label", i) for i, a in vs.items()}
            vertices = [(i, a.get("label", i), int(a.get("bbid", 0)), a.get("fn_name", ""), a.get("position", ""), a) for i, a in vs.items()]
            yield vertices, [(name[s], name[d], a.get("label", ""), int(a.get("traversed", 1))) for s, d, a in es]
    except IndexError:
        raise ValueError(f"a graph does not end: {text[:80]}") from None


def read(spark: SparkSession, path: str | list[str], outcome: str) -> tuple[DataFrame, DataFrame]:
    """vertices and edges of the profiles under path; a bbid that is no number is an error."""
    return flattened(staged(parsed(records(spark.read, path, START), outcome, _graphs, VERTICES, EDGES), "profiles"))


def lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, value: each graph as a digraph.  Vertices are named by their labels."""
    v = vertices.select("graph_id", F.concat(quoted(F.col("label")), F.lit(" [label="), quoted(F.col("label")), F.lit(", fn_name="), quoted(F.col("fn_name")), F.lit(", bbid="), F.coalesce("bbid", F.lit(0)).cast("string"), F.lit(", position="), quoted(F.col("position")), F.lit("];")).alias("line"))
    e = edges.select("graph_id", F.concat(quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" [traversed="), F.col("traversed").cast("string"), F.lit("];")).alias("line"))
    body = v.groupBy("graph_id").agg(F.array_sort(F.collect_set("line")).alias("vs")).join(e.groupBy("graph_id").agg(F.array_sort(F.collect_list("line")).alias("es")), "graph_id", "left")
    return body.select("graph_id", F.concat(F.lit("digraph {\n"), F.array_join(F.concat("vs", F.coalesce("es", F.array().cast("array<string>"))), "\n"), F.lit("\n}\n")).alias("value"))
