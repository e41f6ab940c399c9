"""Embeddings of patterns in graphs whose labels may repeat, and supports by them.

An embedding maps a pattern's vertices to different vertices of one graph, labels and edges agreeing.  It is found as a
chain of joins, one an edge of the pattern, in an order that starts at the rarest label and stays connected; where
labels are unique the cheaper operators of ``mining`` give the same.

vertices: outcome, graph_id, vid, label; edges: outcome, graph_id, src, dst (vertex ids), label.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

Pattern = tuple[list[str], list[tuple[int, int, str]]]


#: How often the pattern's labels occur, and its edges by labels of both ends and their own: all, and those between different vertices.
Statistics = tuple[dict[str, int], dict[tuple[str, str, str], tuple[int, int]]]

STARTS = ("random", "least_frequent", "most_frequent", "least_connected", "most_connected", "fewest_extensions", "most_extensions", "lowest_cardinality", "highest_cardinality")


def edge_order(pattern: Pattern, counts: dict[str, int]) -> list[tuple[int, int, str]]:
    """The pattern's edges, each after the first touching those before; rare labels come first."""
    v, e = pattern
    weight = lambda x: min(counts.get(v[x[0]], 0), counts.get(v[x[1]], 0))
    rest, out, met = sorted(e, key=weight), [], set()
    while rest:
        nxt = next((x for x in rest if not met or x[0] in met or x[1] in met), None)
        if nxt is None:
            raise ValueError("a pattern is connected")
        rest.remove(nxt)
        out.append(nxt)
        met |= {nxt[0], nxt[1]}
    return out


def start_vertex(pattern: Pattern, statistics: Statistics, mode: str, seed: int = 0) -> int:
    """The pattern's vertex that a search begins at: by how frequent its label is, how many edges it has in the pattern, how many edges of the graphs extend it
    to another vertex, or how many edges of the graphs are like its own; the first of several alike, or a random one."""
    v, e = pattern
    labels, triples = statistics
    if mode not in STARTS:
        raise ValueError(f"start is one of {', '.join(STARTS)}")
    if mode == "random":
        return random.Random(seed).randrange(len(v))
    touching = [[triples.get((v[s], v[t], l), (0, 0)) for s, t, l in e if k in (s, t)] for k in range(len(v))]
    weights = {
        "frequent": [labels.get(l, 0) for l in v],
        "connected": [len(x) for x in touching],
        "extensions": [sum(n for _, n in x) for x in touching],
        "cardinality": [sum(n for n, _ in x) for x in touching],
    }[mode.split("_")[1]]
    return weights.index((min if mode.split("_")[0] in ("least", "fewest", "lowest") else max)(weights))


def edge_order_from(pattern: Pattern, statistics: Statistics, start: int) -> list[tuple[int, int, str]]:
    """The pattern's edges from a vertex on, each time the one that is expected to leave the fewest partial embeddings: edges like it a vertex
    like its known end, or a pair of vertices like both ends if both are known."""
    v, e = pattern
    labels, triples = statistics
    rest, out, met = list(e), [], {start}
    while rest:
        open_ = [x for x in rest if x[0] in met or x[1] in met]
        if not open_:
            raise ValueError("a pattern is connected")

        def growth(x: tuple[int, int, str]) -> float:
            known = 1
            for k in {x[0], x[1]} & met:
                known *= max(1, labels.get(v[k], 0))
            return triples.get((v[x[0]], v[x[1]], x[2]), (0, 0))[0] / known

        nxt = min(open_, key=growth)
        rest.remove(nxt)
        out.append(nxt)
        met |= {nxt[0], nxt[1]}
    return out


def _typed(pattern: Pattern, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between vertices with labels of the pattern, with these."""
    keys = ["outcome", "graph_id"]
    labelled = vertices.select(*keys, "vid", F.col("label").alias("l")).where(F.col("l").isin(pattern[0]))
    found = edges.select(*keys, "src", "dst", F.col("label").alias("el")).where(F.col("el").isin(list({l for *_, l in pattern[1]})))
    return found.join(labelled.withColumnsRenamed({"vid": "src", "l": "sl"}), [*keys, "src"]).join(labelled.withColumnsRenamed({"vid": "dst", "l": "dl"}), [*keys, "dst"])


def statistics_of(pattern: Pattern, vertices: DataFrame, edges: DataFrame, typed: DataFrame | None = None) -> Statistics:
    """At most as many rows as the pattern has labels, and pairs of labels with a label of an edge, reach the driver."""
    labels = {r["label"]: r["count"] for r in vertices.where(F.col("label").isin(pattern[0])).groupBy("label").count().collect()}
    if not pattern[1]:
        return labels, {}
    counts = (_typed(pattern, vertices, edges) if typed is None else typed).groupBy("sl", "dl", "el").agg(F.count("*").alias("n"), F.count_if(F.col("src") != F.col("dst")).alias("apart"))
    return labels, {(r["sl"], r["dl"], r["el"]): (r["n"], r["apart"]) for r in counts.collect()}


def _partial(pattern: Pattern, order: list[tuple[int, int, str]], typed: DataFrame) -> Iterator[tuple[tuple[int, int, str], DataFrame]]:
    """Each edge in order, with the embeddings of the edges up to it."""
    v, _ = pattern
    keys = ["outcome", "graph_id"]
    found, met = None, set()
    for s, t, label in order:
        step = typed.where((F.col("sl") == v[s]) & (F.col("dl") == v[t]) & (F.col("el") == label)).select(*keys, F.col("src").alias(f"v{s}"), *([F.col("dst").alias(f"v{t}")] if s != t else [])).distinct()
        if s == t:
            step = typed.where((F.col("src") == F.col("dst")) & (F.col("sl") == v[s]) & (F.col("el") == label)).select(*keys, F.col("src").alias(f"v{s}")).distinct()
        if found is None:
            found = step
        else:
            found = found.join(step, keys + [f"v{k}" for k in dict.fromkeys((s, t)) if k in met])
        met |= {s, t}
        mine = [F.col(f"v{k}") for k in sorted(met)]
        found = found.where(F.size(F.array_distinct(F.array(*mine))) == len(mine))
        yield (s, t, label), found


def embeddings(pattern: Pattern, vertices: DataFrame, edges: DataFrame, start: str | None = None, seed: int = 0) -> DataFrame:
    """outcome, graph_id, m: array of the vertex ids that the pattern's vertices map to.

    start: one of STARTS, the vertex that joins begin at; edges then follow by estimated growth.  Without it they go by rare labels.  The result is the same.
    """
    v, e = pattern
    keys = ["outcome", "graph_id"]
    if not e:
        return vertices.where(F.col("label") == v[0]).select(*keys, F.array("vid").alias("m"))
    if start is None:
        counts = {r["label"]: r["count"] for r in vertices.where(F.col("label").isin(v)).groupBy("label").count().collect()}  # as many rows as the pattern has labels
        order = edge_order(pattern, counts)
    else:
        known = statistics_of(pattern, vertices, edges)
        order = edge_order_from(pattern, known, start_vertex(pattern, known, start, seed))
    for _, found in _partial(pattern, order, _typed(pattern, vertices, edges)):
        pass
    return found.select(*keys, F.array(*(F.col(f"v{k}") for k in range(len(v)))).alias("m"))


def starts(pattern: Pattern, vertices: DataFrame, edges: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """mode, vertex, embeddings: where each mode starts, and the number of embeddings found from there.  The pattern's edges are typed and counted once, and
    modes that join in the same order share one search."""
    typed = staged(_typed(pattern, vertices, edges), "typed")
    known = statistics_of(pattern, vertices, edges, typed)
    orders: dict[tuple, list[tuple[str, int]]] = {}
    for mode in modes:
        vertex = start_vertex(pattern, known, mode)
        orders.setdefault(tuple(edge_order_from(pattern, known, vertex)), []).append((mode, vertex))
    found = []
    for order, theirs in orders.items():
        *_, (_, last) = _partial(pattern, list(order), typed)
        each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(k).alias("vertex")) for m, k in theirs))).alias("at")
        found.append(last.agg(F.count("*").alias("embeddings")).select(each, "embeddings").select("at.mode", "at.vertex", "embeddings"))
    return reduce(DataFrame.unionByName, found)


def join_sizes(pattern: Pattern, vertices: DataFrame, edges: DataFrame, start: str, seed: int = 0) -> DataFrame:
    """step (from 1), src, dst (vertices of the pattern), rows: partial embeddings after each join of the order that a start gives."""
    known = statistics_of(pattern, vertices, edges)
    order = edge_order_from(pattern, known, start_vertex(pattern, known, start, seed))
    sizes = [
        found.agg(F.lit(k).alias("step"), F.lit(s).alias("src"), F.lit(t).alias("dst"), F.count("*").alias("rows"))
        for k, ((s, t, _), found) in enumerate(_partial(pattern, order, _typed(pattern, vertices, edges)), 1)
    ]
    return reduce(DataFrame.unionByName, sizes)


def embedded_in(pattern: Pattern, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """outcome, graph_id of the graphs that hold the pattern."""
    return embeddings(pattern, vertices, edges).select("outcome", "graph_id").distinct()


def image_support(found: DataFrame) -> DataFrame:
    """outcome, support: the least number of different vertices that a pattern's vertex maps to, at most the number of embeddings."""
    places = found.select("outcome", "graph_id", F.posexplode("m").alias("k", "vid"))
    per = places.groupBy("outcome", "k").agg(F.count_distinct("graph_id", "vid").alias("n"))
    return per.groupBy("outcome").agg(F.min("n").alias("support"))


def first_at_all(found: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, n: embeddings in a group of equal keys that share no vertex with any before them in order of their vertices, taken or not.

    Such a one is the first at each of its vertices; so each vertex keeps its least embedding, and those are counted that as many vertices keep as they have.
    """
    firsts = found.select(*keys, "m", F.explode(F.array_distinct("m")).alias("vid")).groupBy(*keys, "vid").agg(F.min("m").alias("m"))
    held = firsts.groupBy(*keys, "m").agg(F.count("*").alias("n"))
    return held.groupBy(*keys).agg(F.count_if(F.col("n") == F.size(F.array_distinct("m"))).alias("n"))


def independent_support(found: DataFrame) -> DataFrame:
    """outcome, support: embeddings taken in order of graph and vertices, each that shares no vertex with any before it,
    taken or not.  Overlaps happen within a graph only, so graphs are counted apart and added up."""
    return first_at_all(found, ["outcome", "graph_id"]).groupBy("outcome").agg(F.sum("n").alias("support"))


def largest_match(pattern: Pattern, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """outcome, graph_id, matched, ratio: edges of the pattern that the best partial embedding in a graph covers, growing from
    each edge while an edge that touches it can be added."""
    v, e = pattern
    keys = ["outcome", "graph_id"]
    graphs = vertices.groupBy(*keys).agg(F.collect_list(F.struct("vid", "label")).alias("vs")).join(edges.groupBy(*keys).agg(F.collect_list(F.struct("src", "dst", "label")).alias("es")), keys, "left")
    shared = edges.sparkSession.sparkContext.broadcast((v, e))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, e = shared.value

        def grow(mapped: dict[int, int], done: frozenset, label: dict[int, str], es: list) -> int:
            best = len(done)
            for k, (s, t, l) in enumerate(e):
                if k in done or (mapped and s not in mapped and t not in mapped):
                    continue
                for a, b, el in es:
                    if el != l or label[a] != v[s] or label[b] != v[t] or (s == t) != (a == b) or mapped.get(s, a) != a or mapped.get(t, b) != b:
                        continue
                    new = {**mapped, s: a, t: b}
                    if len(set(new.values())) == len(new):
                        best = max(best, grow(new, done | {k}, label, es))
                        if best == len(e):
                            return best
            return best

        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                label = {x["vid"]: x["label"] for x in r["vs"]}
                n = grow({}, frozenset(), label, [(x["src"], x["dst"], x["label"]) for x in (r["es"] if r["es"] is not None else [])])
                out.append((r["outcome"], r["graph_id"], n, n / len(e) if e else 1.0))
            yield pd.DataFrame(out, columns=["outcome", "graph_id", "matched", "ratio"])

    return graphs.mapInPandas(match, "outcome string, graph_id string, matched int, ratio double")


def first_order(found: DataFrame, attributes: DataFrame) -> DataFrame:
    """outcome, graph_id, order: the least ``order`` attribute of an embedding's vertices, -1 if none has one.
    attributes: outcome, graph_id, vid, attrs (map of strings)."""
    a = attributes.select("outcome", "graph_id", "vid", F.expr("try_cast(attrs['order'] as int)").alias("o"))
    places = found.select("outcome", "graph_id", F.explode("m").alias("vid")).join(a, ["outcome", "graph_id", "vid"], "left")
    return places.groupBy("outcome", "graph_id").agg(F.coalesce(F.min("o"), F.lit(-1)).alias("order"))


def numbered(vertices: DataFrame) -> DataFrame:
    """vertices with vid, numbered within their graph in order of label, for tables that name vertices by label."""
    return vertices.withColumn("vid", F.row_number().over(Window.partitionBy("outcome", "graph_id").orderBy("label")))
