"""Static analyses of control-flow graphs that are given as data: one function's graph is a group.

blocks are numbers; edges: fn, src, dst; block 0 is the entry.  A function's graph is small whatever the number of
functions, so each is analysed in one call of ``applyInPandas`` and functions spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Graph = dict[int, list[int]]


def graph_of(pdf: pd.DataFrame) -> Graph:
    """Successors of each block, in order; block 0 is always there."""
    g: Graph = {0: []}
    for s, d in sorted(set(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))):
        g.setdefault(s, []).append(d)
        g.setdefault(d, [])
    return g


def reverse_postorder(g: Graph, root: int) -> list[int]:
    order, seen, stack = [], {root}, [(root, iter(g[root]))]
    while stack:
        node, rest = stack[-1]
        nxt = next((d for d in rest if d not in seen), None)
        if nxt is None:
            order.append(node)
            stack.pop()
        else:
            seen.add(nxt)
            stack.append((nxt, iter(g[nxt])))
    return order[::-1]


def immediate_dominators(g: Graph, root: int = 0) -> dict[int, int]:
    """The immediate dominator of each block that root reaches; root's is root (Cooper, Harvey and Kennedy's iteration)."""
    order = reverse_postorder(g, root)
    place = {b: k for k, b in enumerate(order)}
    before: Graph = {b: [] for b in order}
    for s in order:
        for d in g[s]:
            before[d].append(s)
    idom = {root: root}
    changed = True
    while changed:
        changed = False
        for b in order[1:]:
            new = None
            for p in before[b]:
                if p in idom:
                    if new is None:
                        new = p
                        continue
                    a = p
                    while a != new:
                        while place[a] > place[new]:
                            a = idom[a]
                        while place[new] > place[a]:
                            new = idom[new]
            if new is not None and idom.get(b) != new:
                idom[b], changed = new, True
    return idom


def immediate_post_dominators(g: Graph) -> dict[int, int]:
    """Dominators of the reversed graph from a virtual exit behind all sinks; a block that only the exit
    post-dominates is its own."""
    back: Graph = {b: [] for b in g}
    for s, ds in g.items():
        for d in ds:
            back[d].append(s)
    back[-1] = [b for b, ds in g.items() if not ds]
    idom = immediate_dominators(back, -1)
    return {b: (b if d == -1 else d) for b, d in idom.items() if b != -1}


def frontier(g: Graph, idom: dict[int, int]) -> dict[int, set[int]]:
    """Blocks where each block's dominance ends."""
    before: Graph = {b: [] for b in g}
    for s, ds in g.items():
        for d in ds:
            before[d].append(s)
    out: dict[int, set[int]] = {b: set() for b in g}
    for b in g:
        if b not in idom:
            continue
        for p in before[b]:
            while p in idom and not (p == idom[b] and b != idom[b]):
                out[p].add(b)
                if p == idom[p]:
                    break
                p = idom[p]
    return out


def control_dependence(g: Graph) -> dict[int, set[int]]:
    """Blocks that decide whether each block runs; one that nothing decides hangs on block 0."""
    back: Graph = {b: [] for b in g}
    for s, ds in g.items():
        for d in ds:
            back[d].append(s)
    back[-1] = [b for b, ds in g.items() if not ds]
    idom = immediate_dominators(back, -1)
    found = {b: {c for c in cs if c != -1} for b, cs in frontier(back, idom).items() if b != -1}
    return {b: cs or ({0} if b else set()) for b, cs in found.items()}


def _per_function(edges: DataFrame, fn: Callable[[Graph], list[tuple]], names: tuple[str, ...]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf["fn"].iloc[0], *r) for r in fn(graph_of(pdf))]
        return pd.DataFrame(rows, columns=["fn", *names])

    return edges.select("fn", "src", "dst").groupBy("fn").applyInPandas(run, ", ".join(["fn string", *(f"{n} int" for n in names)]))


def dominators(edges: DataFrame) -> DataFrame:
    """fn, bbid, idom."""
    return _per_function(edges, lambda g: sorted(immediate_dominators(g).items()), ("bbid", "idom"))


def post_dominators(edges: DataFrame) -> DataFrame:
    """fn, bbid, ipdom."""
    return _per_function(edges, lambda g: sorted(immediate_post_dominators(g).items()), ("bbid", "ipdom"))


def dominance_frontier(edges: DataFrame) -> DataFrame:
    """fn, bbid, frontier: one row for each block of a frontier."""
    return _per_function(edges, lambda g: sorted((b, f) for b, fs in frontier(g, immediate_dominators(g)).items() for f in fs), ("bbid", "frontier"))


def control_dependencies(edges: DataFrame) -> DataFrame:
    """fn, bbid, controller."""
    return _per_function(edges, lambda g: sorted((b, c) for b, cs in control_dependence(g).items() for c in cs), ("bbid", "controller"))


def dotty(edges: DataFrame, name: str = "blk") -> DataFrame:
    """fn, value: each function's graph (or tree of src and dst) as Graphviz text."""
    line = F.format_string('"%s %d" -> "%s %d";', F.lit(name), "src", F.lit(name), "dst")
    lines = edges.groupBy("fn").agg(F.array_sort(F.collect_set(F.struct("src", "dst", line.alias("line")))).alias("l"))
    return lines.select("fn", F.concat(F.lit("digraph {\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("value"))


def merge_chains(edges: DataFrame) -> DataFrame:
    """fn, src, dst after joining each block with its only successor where it is that one's only predecessor; blocks are
    renumbered in order of their first one."""

    def merged(g: Graph) -> list[tuple]:
        g = {b: list(d) for b, d in g.items()}
        changed = True
        while changed:
            changed = False
            before: Graph = {b: [] for b in g}
            for s, ds in g.items():
                for d in ds:
                    before[d].append(s)
            for s in sorted(g):
                if len(g[s]) == 1 and g[s][0] != s and g[s][0] != 0 and before[g[s][0]] == [s]:
                    g[s] = g.pop(g[s][0])
                    changed = True
                    break
        number = {b: k for k, b in enumerate(sorted(g))}
        return sorted((number[s], number[d]) for s, ds in g.items() for d in ds)

    return _per_function(edges, merged, ("src", "dst"))
