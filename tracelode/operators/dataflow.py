"""Data-flow analyses over control-flow graphs of any size, all functions at once.

A function of at most WHOLE rows of edges and facts is solved where its rows meet, on sets of facts as bits, so that only the rows themselves are shuffled.
Larger ones are solved together as a semi-naive fixed point over rows.

edges: fn, src, dst.  A fact is a key and a value; gen: fn, node, key, value of the facts that a node makes; kill: fn, node, key, and value where a node ends
one fact and not all of a key.  A node ends facts before it makes its own.  Only facts that a round finds anew are carried along edges in the next one, so
that a fact crosses an edge once; for large functions rounds are as many as the longest way that a fact must go, and each is written to the shared folder.  Joins are on function
and node, so their rows spread over tasks.  Rows with a null function, node, key or value count for nothing; repeated rows are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..staging import new_path, staged

FACT = ["fn", "node", "key", "value"]

#: A function of more rows is solved by joins: a whole one has WHOLE / 3 blocks, keys and values at most, each alike, thus under 40 MB of bits.
WHOLE = 2000
#: Functions whose facts make one batch of rows.
CALLS = 64


def _along(leaving: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts that leave a node, at the nodes behind it."""
    e = edges.select(F.col("fn").alias("fn"), F.col("src").alias("node"), F.col("dst").alias("to"))
    return leaving.join(e, ["fn", "node"]).select("fn", F.col("to").alias("node"), "key", "value").distinct()


def _left(arrived: DataFrame, kill: DataFrame | None, derive: DataFrame | None) -> DataFrame:
    """What of the facts that arrive at nodes leaves them, and what they turn into there."""
    kept = arrived
    if kill is not None:
        kept = arrived.join(kill, [c for c in FACT if c in kill.columns], "left_anti")
    if derive is None:
        return kept
    made = arrived.join(derive, ["fn", "node", "key"]).select("fn", "node", F.col("made").alias("key"), "value")
    return kept.unionByName(made).distinct()


def _spread(edges: DataFrame, first: DataFrame, kill: DataFrame | None, derive: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """first (facts that arrive at nodes) and all that comes of them along edges; within: only facts of these rows count."""
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "facts")
    paths: list[str] = []
    new = first
    while True:
        paths.append(f"{path}/{len(paths)}")
        new.write.parquet(paths[-1])
        new = spark.read.schema(first.schema).parquet(paths[-1])
        seen = spark.read.schema(first.schema).parquet(*paths)
        if new.isEmpty():
            return seen
        new = _along(_left(new, kill, derive), edges)
        if within is not None:
            new = new.join(within, FACT, "left_semi")
        new = new.join(seen, FACT, "left_anti")


def _solve_function(edges: list, gen: list, kill: list, derive: list, intersection: bool, entry: int | None) -> tuple[list, list, list, list[tuple[int, int, int]]]:
    """nodes, keys, values, and by their numbers (node, key, value) the facts that enter the nodes of one function.

    A set of facts is an integer: the bit of a fact is its key's number times the number of values plus its value's.
    """
    nodes: dict = {}
    for s, d in edges:
        nodes.setdefault(s, len(nodes))
        nodes.setdefault(d, len(nodes))
    values: dict = {}
    keys: dict = {}
    for _, k, v in gen:
        keys.setdefault(k, len(keys))
        values.setdefault(v, len(values))
    for _, k, made in derive:
        keys.setdefault(k, len(keys))
        keys.setdefault(made, len(keys))
    n, width = len(nodes), len(values)
    all_of_key = (1 << width) - 1
    makes, ends = [0] * n, [0] * n
    turns: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for b, k, v in gen:
        if b in nodes:
            makes[nodes[b]] |= 1 << keys[k] * width + values[v]
    for b, k, *v in kill:
        if b in nodes and k in keys and (not v or v[0] in values):
            ends[nodes[b]] |= 1 << keys[k] * width + values[v[0]] if v else all_of_key << keys[k] * width
    for b, k, made in derive:
        if b in nodes:
            turns[nodes[b]].append((keys[k] * width, keys[made] * width))
    behind: list[set[int]] = [set() for _ in range(n)]
    for s, d in edges:
        behind[nodes[s]].add(nodes[d])

    def leaving(b: int, arrived: int) -> int:
        out = makes[b] | arrived & ~ends[b]
        for k, made in turns[b]:
            out |= (arrived >> k & all_of_key) << made
        return out

    into = [0] * n
    due = list(range(n))
    waiting = set(due)
    while due:
        b = due.pop()
        waiting.discard(b)
        out = leaving(b, into[b])
        for d in behind[b]:
            if out & ~into[d]:
                into[d] |= out
                if d not in waiting:
                    waiting.add(d)
                    due.append(d)
    if intersection:
        lost = [0] * n
        for b in range(n):
            missing = ~leaving(b, into[b])
            for d in behind[b]:
                lost[d] |= into[d] & missing
        if entry is not None and entry in nodes:  # the entry may be led back to; nothing ever arrives at other starts
            lost[nodes[entry]] = into[nodes[entry]]
        due = [b for b in range(n) if lost[b]]
        while due:
            b = due.pop()
            for d in behind[b]:
                if more := lost[b] & ~makes[b] & into[d] & ~lost[d]:
                    lost[d] |= more
                    due.append(d)
        into = [x & ~y for x, y in zip(into, lost, strict=True)]
    found = []
    for b, held in enumerate(into):
        while held:
            low = held & -held
            found.append((b, *divmod(low.bit_length() - 1, width)))
            held ^= low
    return list(nodes), list(keys), list(values), found


def _each(rows: DataFrame, kinds: list[str], forward: bool, meet: str, entry: int) -> DataFrame:
    """The solution of each function where its rows meet."""
    listed = rows.groupBy("fn").agg(*(F.collect_list(name).alias(name) for name in kinds))
    fact = rows.schema["gen"].dataType
    node = rows.schema["edges"].dataType["src"].dataType
    schema = T.StructType([T.StructField("fn", rows.schema["fn"].dataType), T.StructField("node", node), T.StructField("key", fact["key"].dataType), T.StructField("value", fact["value"].dataType)])
    arrow = to_arrow_schema(schema)
    start = entry if forward else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = {name: b.column(name).to_pylist() for name in kinds}
            for at in range(0, b.num_rows, CALLS):
                fns, names, parts = [], ([], [], []), []
                for k in range(at, min(at + CALLS, b.num_rows)):
                    args = [[tuple(x.values()) for x in lists[name][k]] if name in lists else [] for name in ("edges", "gen", "kill", "derive")]
                    *named, found = _solve_function(*args, meet == "intersection", start)
                    if found:
                        parts.append(np.array(found) + [len(x) for x in names])
                        fns.append(np.full(len(found), k))
                        for x, more in zip(names, named, strict=True):
                            x.extend(more)
                if parts:
                    index = np.concatenate(parts)
                    columns = [b.column("fn").take(pa.array(np.concatenate(fns)))] + [pa.array(x, f.type).take(pa.array(index[:, j])) for j, (x, f) in enumerate(zip(names, list(arrow)[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return listed.mapInArrow(run, schema)


def solve(edges: DataFrame, gen: DataFrame, kill: DataFrame | None = None, derive: DataFrame | None = None, forward: bool = True, meet: str = "union", entry: int = 0) -> DataFrame:
    """fn, node, key, value: facts that hold where the flow enters each node, that is before it, or behind it where the flow goes backwards.

    meet "union": facts that hold on some way; "intersection": those that hold on every way from the function's start, which is ``entry`` and each node that
    nothing leads to (backwards: each node that leads nowhere).  Nodes that no start reaches have what holds on some way and is lost on none.
    derive: fn, node, key, made: a fact of this key that enters the node leaves it as one of key made with the same value too, as in assignments
    from name to name; its own key is kept unless killed.  For "union" only.
    """
    if meet not in ("union", "intersection"):
        raise ValueError("meet is union or intersection")
    if derive is not None and meet == "intersection":
        raise ValueError("derived facts are joined by union only")
    parts = {"edges": edges.select("fn", *(F.col(a).alias(b) for a, b in zip(("src", "dst") if forward else ("dst", "src"), ("src", "dst"), strict=True))), "gen": gen.select(FACT)}
    if kill is not None:
        parts["kill"] = kill.select([c for c in FACT if c in kill.columns])
    if derive is not None:
        parts["derive"] = derive.select("fn", "node", "key", "made")
    # all inputs as rows of one table, each in the column of its kind
    kinds = {name: (part.na.drop(), T.StructType([f for f in part.schema if f.name != "fn"])) for name, part in parts.items()}
    rows = None
    for name, (df, _) in kinds.items():
        cells = [F.struct(*kind.names).alias(other) if other == name else F.lit(None).cast(kind).alias(other) for other, (_, kind) in kinds.items()]
        df = df.select("fn", *cells)
        rows = df if rows is None else rows.unionByName(df)
    rows = staged(rows, "flow")
    large = staged(rows.groupBy("fn").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("fn"), "large")
    if large.isEmpty():
        return _each(rows, list(kinds), forward, meet, entry)
    small, rest = rows.join(large, "fn", "left_anti"), rows.join(large, "fn", "left_semi")
    of = lambda name: staged(rest.where(F.col(name).isNotNull()).select("fn", f"{name}.*").distinct(), name) if name in kinds else None
    return _each(small, list(kinds), forward, meet, entry).unionByName(_solve_rows(of("edges"), of("gen"), of("kill"), of("derive"), forward, meet, entry))


def _solve_rows(e: DataFrame, gen: DataFrame, kill: DataFrame | None, derive: DataFrame | None, forward: bool, meet: str, entry: int) -> DataFrame:
    """The solution by joins; edges lead where the flow goes."""
    may = _spread(e, _along(gen, e), kill, derive)
    if meet == "union":
        return may
    # lost at a node: what some node before it doesn't hand on, and anything at a start; then what follows from that until a node makes it anew
    leaving = gen.unionByName(_left(may, kill, None))
    asked = may.join(e.select("fn", F.col("dst").alias("node"), "src"), ["fn", "node"]).select("fn", F.col("src").alias("node"), "key", "value", F.col("node").alias("at"))
    lost = asked.join(leaving, FACT, "left_anti").select("fn", F.col("at").alias("node"), "key", "value")
    if forward:  # the entry may be led back to; nothing ever arrives at other starts
        lost = lost.unionByName(may.where(F.col("node") == entry))
    return may.join(_spread(e, lost.distinct(), gen, within=may), FACT, "left_anti")


def reaching_definitions(edges: DataFrame, statements: DataFrame) -> DataFrame:
    """fn, bbid, name, def_bbid: definitions that reach the start of each block.  statements: fn, bbid, name (defined there); a block's last
    definition of a name kills all others."""
    defs = statements.select("fn", F.col("bbid").alias("node"), F.col("name").alias("key"), F.col("bbid").alias("value"))
    found = solve(edges, defs, defs.drop("value"))
    return found.select("fn", F.col("node").cast("int").alias("bbid"), F.col("key").alias("name"), F.col("value").cast("int").alias("def_bbid"))


def _names(statements: DataFrame) -> DataFrame:
    return statements.select("fn", F.col("bbid").alias("node"), F.col("name").alias("key"), F.lit(True).alias("value"))


def live_names(edges: DataFrame, uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """fn, bbid, name: names that some way from the end of each block uses before it defines them.  uses: fn, bbid, name (used before the block
    defines it); definitions: fn, bbid, name."""
    found = solve(edges, _names(uses), _names(definitions).drop("value"), forward=False)
    return found.select("fn", F.col("node").alias("bbid"), F.col("key").alias("name"))


def assigned_names(edges: DataFrame, definitions: DataFrame, entry: int = 0) -> DataFrame:
    """fn, bbid, name: names that every way from the entry to the start of each block defines."""
    found = solve(edges, _names(definitions), meet="intersection", entry=entry)
    return found.select("fn", F.col("node").alias("bbid"), F.col("key").alias("name"))


def value_origins(edges: DataFrame, definitions: DataFrame, copies: DataFrame) -> DataFrame:
    """fn, bbid, name, def_bbid: blocks whose definition a name's value may come from at the start of each block, through copies from name to name.

    definitions: fn, bbid, name (a fresh value); copies: fn, bbid, name, source (name takes source's value).  A block has one of these for a name at
    most; copies of a block read what enters it.
    """
    gen = definitions.select("fn", F.col("bbid").alias("node"), F.col("name").alias("key"), F.col("bbid").alias("value"))
    derive = copies.select("fn", F.col("bbid").alias("node"), F.col("source").alias("key"), F.col("name").alias("made"))
    kill = gen.select("fn", "node", "key").unionByName(derive.select("fn", "node", F.col("made").alias("key")))
    return solve(edges, gen, kill, derive).select("fn", F.col("node").alias("bbid"), F.col("key").alias("name"), F.col("value").alias("def_bbid"))
