"""The simple text format of graph profiles: reading and writing.

``start-graph``, ``vertex<TAB>id, "label", bbid, "fn_name", "position"[, "duration"]``, ``edge<TAB>src, dst, count`` and
``end-graph`` lines.  Ids hold within their graph; an edge that names an undeclared id is an error.

Files are read by Spark's text source with the line that starts a graph as the separator of records.  So a file of any size is read in byte
ranges by many tasks, a record is one graph, and a range that begins inside a graph leaves it to the range before.  (A file whose lines end
otherwise than in a line feed is one record; compressed files aren't split.)  Records are parsed once, into a row a graph, and written to the shared
folder, which vertices and edges are then read from.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from ..staging import staged

#: graph_id is the file and the place of the graph in it: its number, in a range that doesn't begin the file after where the range begins.
VERTICES = "vid int, label string, bbid int, fn_name string, position string, duration string"
EDGES = "src string, dst string, traversed long"
START = "start-graph\n"
#: Vertices and edges that a task holds as objects before it hands their graphs on, and those of one graph.
HELD = 10_000


def tokens(line: str) -> list[str]:
    """Fields between commas that no quotes enclose; a backslash takes the next character's meaning."""
    out, field, quoted, escaped = [], [], False, False
    for c in line:
        if c == "," and not quoted and not escaped:
            out.append("".join(field).strip())
            field = []
            continue
        if c == '"' and not escaped:
            quoted = not quoted
        escaped = c == "\\" and not escaped
        field.append(c)
    if escaped:
        raise ValueError(f"a backslash ends the line: {line}")
    if quoted:
        raise ValueError(f"an open quote: {line}")
    return out + (["".join(field).strip()] if field else [])


def unquote(s: str) -> str:
    return json.loads(s)


def parse(text: str) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """(number, vertices, edges) of each graph of a file."""
    number, vertices, edges = 0, [], []
    for raw in text.splitlines():
        line = raw.strip()
        if not line:
            continue
        kind, _, rest = line.partition("\t")
        if kind == "start-graph":
            continue
        if kind == "end-graph":
            yield number, vertices, edges
            number, vertices, edges = number + 1, [], []
        elif kind == "vertex":
            t = tokens(rest)
            if len(t) < 5:
                raise ValueError(f"a vertex has five fields or more: {line}")
            vertices.append((int(t[0]), unquote(t[1]), int(t[2]), unquote(t[3]), unquote(t[4]), unquote(t[5]) if len(t) > 5 else None))
        elif kind == "edge":
            t = tokens(rest)
            if len(t) < 3:
                raise ValueError(f"an edge has three fields or more: {line}")
            edges.append((int(t[0]), int(t[1]), int(t[2])))
        else:
            raise ValueError(f"no such kind of line: {kind}")


def records(reader: DataFrameReader | DataStreamReader, path: str | list[str], separator: str) -> DataFrame:
    """path, start, content: what lies between separators, and the byte at which its range of the file starts; in folders the files at the top."""
    reader = reader.option("recursiveFileLookup", "false").option("lineSep", separator)
    raw = reader.text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("content"))


Parsed = Iterator[tuple[list[tuple], list[tuple]]]


def parsed(found: DataFrame, outcome: str, of: Callable[[str, bool], Parsed], vertices: str, edges: str) -> DataFrame:
    """outcome, graph_id, vertices, edges, a row a graph.  of takes a record and whether it is the first of its file."""
    names = lambda fields: [f.split()[0] for f in fields.split(", ")]
    v, e = names(vertices), names(edges)
    names_of = ["outcome", "graph_id", "vertices", "edges"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, number, first = None, 0, True
        for b in batches:
            rows, held = [], 0
            for p, start, text in zip(b["path"], b["start"], b["content"], strict=True):
                if at != (p, start):
                    at, number, first = (p, start), 0, start == 0
                for vs, es in of(text, first):
                    rows.append((outcome, f"{p}#{number}" if start == 0 else f"{p}#{start}+{number}", [dict(zip(v, x, strict=True)) for x in vs], [dict(zip(e, x, strict=True)) for x in es]))
                    number += 1
                    held += len(vs) + len(es)
                    if held >= HELD:
                        yield pd.DataFrame(rows, columns=names_of)
                        rows, held = [], 0
                first = False
            if rows:
                yield pd.DataFrame(rows, columns=names_of)

    struct = lambda fields: "array<struct<" + ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", ")) + ">>"
    return found.mapInPandas(run, f"outcome string, graph_id string, vertices {struct(vertices)}, edges {struct(edges)}")


def flattened(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges with the outcome and graph_id of each."""
    return graphs.select("outcome", "graph_id", F.inline("vertices")), graphs.select("outcome", "graph_id", F.inline("edges"))


def _graphs(text: str, first: bool) -> Parsed:
    for n, vs, es in parse(text):
        label = {v[0]: v[1] for v in vs}
        if missing := [x for e in es for x in e[:2] if x not in label]:
            raise ValueError(f"graph {n} of a record has an edge of undeclared vertex {missing[0]}")
        yield vs, [(label[s], label[d], t) for s, d, t in es]


def read(spark: SparkSession, path: str | list[str], outcome: str) -> tuple[DataFrame, DataFrame]:
    """vertices and edges (with labels for ids) of the profiles under path."""
    return flattened(staged(parsed(records(spark.read, path, START), outcome, _graphs, VERTICES, EDGES), "profiles"))


def read_stream(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    """outcome, graph_id, vertices, edges: a stream of the graphs of files as they appear in a folder."""
    return parsed(records(spark.readStream, path, START), outcome, _graphs, VERTICES, EDGES)


def read_both(spark: SparkSession, failing: str | list[str], passing: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of failing and passing profiles together."""
    a, b = read(spark, failing, "fail"), read(spark, passing, "ok")
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])


def location_info(vertices: DataFrame) -> DataFrame:
    """label, bbid, fn_name, position: of each label, as its last graph has them."""
    return vertices.groupBy("label").agg(F.max_by(F.struct("bbid", "fn_name", "position"), F.struct("graph_id", "vid")).alias("i")).select("label", F.coalesce("i.bbid", F.lit(0)).alias("bbid"), F.coalesce("i.fn_name", F.lit("")).alias("fn_name"), F.coalesce("i.position", F.lit("")).alias("position"))


def quoted(c: Column) -> Column:
    """A JSON string literal, which the format's quoting is for common labels."""
    j = F.to_json(F.array(F.coalesce(c, F.lit(""))))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, value: each graph's text, a row a graph.  Vertices: graph_id, label, bbid, fn_name, position, duration."""
    numbered = vertices.groupBy("graph_id").agg(F.array_sort(F.collect_set(F.struct((F.col("label") != "entry").alias("rest"), "label", "bbid", "fn_name", "position", "duration"))).alias("vs"))
    flows = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "traversed"))).alias("es"))
    both = numbered.join(flows, "graph_id", "left").withColumn("ids", F.map_from_arrays(F.transform("vs", lambda v: v["label"]), F.transform("vs", lambda v, k: k)))
    vertex = F.transform("vs", lambda v, k: F.concat(F.lit("vertex\t"), F.concat_ws(", ", k.cast("string"), quoted(v["label"]), F.coalesce(v["bbid"], F.lit(0)).cast("string"), quoted(v["fn_name"]), quoted(v["position"]), quoted(F.coalesce(v["duration"], F.lit("0s"))))))
    edge = F.transform(F.coalesce("es", F.array().cast("array<struct<src:string,dst:string,traversed:bigint>>")), lambda e: F.concat(F.lit("edge\t"), F.concat_ws(", ", F.col("ids")[e["src"]].cast("string"), F.col("ids")[e["dst"]].cast("string"), e["traversed"].cast("string"))))
    return both.select("graph_id", F.array_join(F.concat(F.array(F.lit("start-graph")), vertex, edge, F.array(F.lit("end-graph"))), "\n").alias("value"))


def write(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Graphs as text files; a graph stays within its file."""
    lines(vertices, edges).select("value").write.text(path)
