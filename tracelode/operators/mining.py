"""Discriminative patterns: connected sets of labelled edges that tell failing from passing graphs.

The labels of a runtime profile are unique within a graph, so a connected pattern is a set of label edges, it
embeds in a graph at most once, its canonical form is the sorted set, and its support the number of distinct graphs
that hold all of its edges.  Mining is then level-wise joins: the embeddings of a level (pattern, graph) meet the
edges of the same graph that touch the pattern.  ``labels_unique`` tests the premise; graphs that break it are
relabelled by ``with_unique_labels``, which numbers the repeats of a label within its graph.

Scale: inside, edges and labels are numbers.  A level is one join on graph_id whose rows, a pattern's embedding and an edge that touches it, are
counted where they arise by pattern and edge: that count is the grown pattern's support, whichever part it grew from, so no embedding is
shuffled or made distinct to be counted.  Where all frequent patterns grow, each set of edges arises once, in its canonical order (``Graphs.met``).
Patterns below the support threshold and, for top-k, those whose bound can't reach the k-th best score are dropped before the next join.
Only the k-th score and counts (a few numbers a level) reach the driver.  The patterns of each level are written to the shared folder, and so
are embeddings of three edges and more.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import ieee_div, score, upper_bound
from ..staging import staged
from .ranking import order_key, with_place
from .support import graph_totals, priors

SEP = " -> "
#: Rows of edges in a task of a join (with fewer, what it counts by pattern is hardly fewer rows than it met), and the most patterns that are broadcast.
ROWS, BROADCAST = 250_000, 50_000
#: An edge in rows, and what tells a graph there; the hash alone wouldn't.
EDGE, GRAPH = ("eid", "s", "d"), ["hash", "outcome", "graph_id"]
#: outcome, graph_id, label, or how they are found from edges (outcome, graph_id, src, dst).
Vertices = DataFrame | Callable[[DataFrame], DataFrame]


def labels_unique(vertices: DataFrame) -> DataFrame:
    """One row, labels_unique: whether no graph has a label twice.  vertices: outcome, graph_id, vid, label."""
    per = vertices.groupBy("outcome", "graph_id", "label").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("labels_unique"))


def with_unique_labels(vertices: DataFrame) -> DataFrame:
    """Repeats of a label in a graph numbered in order of vid, so that labels are unique."""
    w = Window.partitionBy("outcome", "graph_id", "label").orderBy("vid")
    n = F.row_number().over(w)
    return vertices.withColumn("label", F.when(n > 1, F.concat("label", F.lit(" #"), n.cast("string"))).otherwise(F.col("label")))


def edge_name(src: str = "src", dst: str = "dst") -> Column:
    return F.concat(F.col(src), F.lit(SEP), F.col(dst))


def _key(pattern: Column) -> Column:
    return F.array_join(pattern, "; ")


def _part_counts(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """part (a label or an edge name), n: passing graphs that hold it."""
    v = vertices.where("outcome = 'ok'").select("graph_id", F.col("label").alias("part")).distinct()
    e = edges.where("outcome = 'ok'").select("graph_id", edge_name().alias("part")).distinct()
    return v.unionByName(e).groupBy("part").agg(F.count("*").alias("n"))


def with_pattern_score(patterns: DataFrame, parts: DataFrame, totals: DataFrame, name: str, max_edges: int, min_fails: int, true_prior: bool = False, keep_parts: bool = False) -> DataFrame:
    """patterns with score, and bound, the most that a pattern grown from it may score; parts_ok, the passing graphs of its parts added up, if
    asked for."""
    total = (F.col("fail_total") + F.col("ok_total")).cast("double")
    exploded = patterns.select("pattern", F.explode(F.concat("labels", "pattern")).alias("part"))
    okay = exploded.join(parts, "part", "left").groupBy("pattern").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("parts_ok"))
    f = ieee_div(F.col("fail_graphs").cast("double"), total)
    o = ieee_div(F.col("parts_ok"), total) / (F.size("pattern") + F.size("labels"))
    least_o = ieee_div(F.col("parts_ok"), total) / (2 * max_edges + 1)
    pf, po = priors(true_prior)
    joined = patterns.join(okay, "pattern").join(F.broadcast(totals))
    return joined.withColumn("score", score(name)(f, o, pf, po)).withColumn("bound", upper_bound(name, pf, po, f, o, ieee_div(F.lit(float(min_fails)), total), least_o)).drop("fail_total", "ok_total", *([] if keep_parts else ["parts_ok"]))


class Graphs:
    """What every level reads, written once.

    names: src, dst, edge, eid, s, d (numbers of the edge and of its labels), fail_graphs, ok_graphs, one row a label edge; rows: outcome, graph_id, eid, s, d,
    one row an edge of a graph; totals and parts as the scores take them, if there are vertices.  Vertices may be a function of the edges, which then reads
    what is written here, so that the source is read once.
    """

    def __init__(self, edges: DataFrame, vertices: Vertices | None = None):
        e = staged(edges.select("outcome", "graph_id", "src", "dst").distinct(), "edges")
        found = staged(e.groupBy("src", "dst").agg(*_counts()).withColumn("eid", F.monotonically_increasing_id()), "names")
        ends = found.select(F.explode(F.array("src", "dst")).alias("label")).distinct().where("label IS NOT NULL")
        labels = staged(ends.withColumn("lid", F.monotonically_increasing_id()), "labels")
        numbers = lambda c, name: labels.select(F.col("label").alias(c), F.col("lid").alias(name))
        self.names = staged(found.join(numbers("src", "s"), "src", "left").join(numbers("dst", "d"), "dst", "left").withColumn("edge", edge_name()), "names")
        self.rows = staged(e.join(self.names.select("src", "dst", "eid", "s", "d"), ["src", "dst"]).select("outcome", "graph_id", "eid", "s", "d"), "rows")
        self.n_edges = self.names.count()
        self.dealt = max(self.rows.sparkSession.sparkContext.defaultParallelism, -(-self.rows.count() // ROWS))
        if vertices is not None:
            # dealt by graph, a graph's labels stay together in what is written
            held = vertices if isinstance(vertices, DataFrame) else vertices(e).repartition(self.dealt, "outcome", "graph_id")
            v = staged(held.select("outcome", "graph_id", "label").distinct(), "vertices")
            self.totals = staged(graph_totals(v), "totals")
            self.parts = staged(self._parts(e, v), "parts")

    def _parts(self, e: DataFrame, v: DataFrame) -> DataFrame:
        """As _part_counts, of rows that are distinct already; the graphs of edges are counted in names."""
        if self.names.select("edge").distinct().count() != self.n_edges:
            return _part_counts(e, v)  # labels hold the separator: a graph may have two edges of one name
        labels = v.where("outcome = 'ok'").groupBy(F.col("label").alias("part")).agg(F.count("*").alias("n"))
        named = self.names.where("ok_graphs > 0").select(F.col("edge").alias("part"), F.col("ok_graphs").alias("n"))
        return labels.unionByName(named).groupBy("part").agg(F.sum("n").alias("n"))

    def one_edge(self, min_fails: int = 2) -> DataFrame:
        """pattern, labels, fail_graphs, ok_graphs and seq (the numbers of the edges, as they were joined) of the frequent one-edge patterns."""
        labels = F.array_sort(F.array_distinct(F.array("src", "dst")))
        return self.names.where(F.col("fail_graphs") >= min_fails).select(F.array("edge").alias("pattern"), labels.alias("labels"), "fail_graphs", "ok_graphs", F.array("eid").alias("seq"))

    def edges(self, min_fails: int = 2) -> DataFrame:
        """The rows of frequent edges (no other one is part of a frequent pattern), dealt by graph.  hash orders graphs quickly where they are sorted to be joined."""
        frequent = self.names.where(F.col("fail_graphs") >= min_fails).select("eid")
        kept = _semi(self.rows, frequent, ["eid"], self.n_edges)
        return kept.withColumn("hash", F.xxhash64("outcome", "graph_id")).repartition(self.dealt, *GRAPH)

    def first(self, min_fails: int = 2) -> DataFrame:
        """The embeddings of the frequent one-edge patterns: seq_0, s_0, d_0 (numbers, where arrays would be made and searched at every pair), at, hash, outcome, graph_id."""
        return self.edges(min_fails).select(*(F.col(c).alias(n) for c, n in zip(EDGE, _edge(0))), F.lit(0).alias("at"), *GRAPH)

    def met(self, level: DataFrame, min_fails: int = 2, full: bool = False) -> DataFrame:
        """Embeddings with each edge of their graph that touches them: seq_i, s_i, d_i of what they grow to, at, hash, outcome, graph_id.

        ``at`` is the place of the first edge that the last one touches.  If level is ``full`` (it has all frequent patterns, each
        in its canonical order), grown patterns are kept in their canonical order only, so each arises once: its least edge first, then the edges that touch
        it, in order, then those that touch the second but not the first, in order, and so on.  An order's beginnings are canonical and connected.
        """
        size = _size(level)
        numbers = [F.col(_edge(i)[0]) for i in range(size)]
        touched = [F.col("s").isin(*ends) | F.col("d").isin(*ends) for ends in ([F.col(c) for c in _edge(i)[1:]] for i in range(size))]
        touches = reduce(lambda rest, i: F.when(touched[i], F.lit(i)).otherwise(rest), reversed(range(size)), F.lit(size))
        new = F.col("eid") > numbers[0] if full else ~F.col("eid").isin(*numbers)
        met = level.join(self.edges(min_fails), GRAPH).where(new & reduce(Column.__or__, touched)).withColumn("touches", touches)
        if full:
            met = met.where((F.col("touches") > F.col("at")) | ((F.col("touches") == F.col("at")) & (F.col("eid") > numbers[-1])))
        grown = (F.col(c).alias(n) for c, n in zip(EDGE, _edge(size)))
        return met.select(*(c for i in range(size) for c in _edge(i)), *grown, F.col("touches").alias("at"), *GRAPH)

    def grown(self, level: DataFrame, alive: DataFrame, min_fails: int = 2, full: bool = False) -> DataFrame:
        """As one_edge, the frequent patterns of one more edge that alive ones grow to.  level: embeddings of the alive patterns."""
        met = self.met(level, min_fails, full)
        seq = [_edge(i)[0] for i in range(_size(met))]
        counts = met.groupBy(*seq).agg(*_counts()).where(F.col("fail_graphs") >= min_fails).withColumn("seq", F.array(*seq)).drop(*seq)
        parents = alive.select(F.col("seq").alias("parent"), F.col("pattern").alias("of"), F.col("labels").alias("of_labels"))
        keyed = counts.withColumn("parent", F.slice("seq", F.lit(1), F.size("seq") - 1)).withColumn("eid", F.element_at("seq", -1))
        named = keyed.join(parents, "parent").join(self.names.select("eid", "edge", "src", "dst"), "eid")
        labels = F.array_sort(F.array_distinct(F.concat("of_labels", F.array("src", "dst"))))
        kids = named.select(F.array_sort(F.concat("of", F.array("edge"))).alias("pattern"), labels.alias("labels"), "fail_graphs", "ok_graphs", "seq")
        if full:
            return kids
        # from whichever part a pattern grew, its support is the same
        return kids.groupBy(F.array_sort("seq").alias("edges")).agg(F.min_by(F.struct("pattern", "labels", "fail_graphs", "ok_graphs", "seq"), "seq").alias("kid")).select("kid.*")

    def level(self, before: DataFrame | None, size: int, alive: DataFrame, n_alive: int, min_fails: int = 2, full: bool = False, whole: bool = False) -> DataFrame:
        """The embeddings of the n_alive patterns of size edges, which those of the level before, if any, grew to.  Those of two edges follow the join that made
        them, larger ones are written.  whole: all frequent patterns are alive, so those of one edge need no looking up, and both sides of the join are the same shuffle."""
        if before is None and whole:
            return self.first(min_fails)
        seq = [_edge(i)[0] for i in range(size)]
        keys = alive.select(*(F.col("seq")[i].alias(c) for i, c in enumerate(seq)))
        kept = _semi(self.first(min_fails) if before is None else self.met(before, min_fails, full), keys, seq, n_alive)
        return kept if size < 3 else staged(kept, "embeddings")


def _edge(i: int) -> tuple[str, str, str]:
    """The columns of an embedding's edge."""
    return f"seq_{i}", f"s_{i}", f"d_{i}"


def _size(embeddings: DataFrame) -> int:
    """How many edges the embeddings have."""
    return sum(c.startswith("seq_") for c in embeddings.columns)


def _counts() -> tuple[Column, Column]:
    return F.count_if(F.col("outcome") == "fail").alias("fail_graphs"), F.count_if(F.col("outcome") == "ok").alias("ok_graphs")


def _semi(rows: DataFrame, keyed: DataFrame, key: list[str], n: int) -> DataFrame:
    """The rows whose key is among the n of keyed; a broadcast join leaves rows where they are."""
    return rows.join(F.broadcast(keyed) if n <= BROADCAST else keyed, key, "left_semi")


def frequent(edges: DataFrame, n_edges: int, min_fails: int = 2) -> DataFrame:
    """pattern, labels, fail_graphs, ok_graphs of all patterns of n_edges edges in at least min_fails failing graphs."""
    g = Graphs(edges)
    found, level = g.one_edge(min_fails), None
    for size in range(1, n_edges):
        # anti-monotone: a pattern that is frequent has frequent parts
        found = staged(found, "patterns")
        level = g.level(level, size, found, found.count(), min_fails, full=True, whole=True)
        found = g.grown(level, found, min_fails, full=True)
    return found.drop("seq")


def mine(edges: DataFrame, vertices: Vertices, name: str = "relative_f1", max_edges: int = 3, min_fails: int = 2, min_edges: int = 1, k: int | None = None, improving: bool = False, timeout_s: float | None = None, true_prior: bool = False, start: DataFrame | None = None, stats: dict | None = None) -> DataFrame:
    """Scored patterns of min_edges to max_edges edges: pattern, labels, fail_graphs, ok_graphs, score, bound.

    With k, the k best ones (ties by pattern), and what can't reach the k-th score is not extended.  With improving,
    a pattern is extended only to patterns that score more.  A timeout ends the search after a level; the result so
    far is returned.  start holds patterns that are known already, whose scores prune from the first level on.  stats, if given, gets the number of
    patterns extended.
    """
    _check(max_edges, min_edges, min_fails)
    until = None if timeout_s is None else time.monotonic() + timeout_s
    return _mine(Graphs(edges, vertices), name, max_edges, min_fails, min_edges, k, improving, until, true_prior, start, stats)


def mine_each(edges: DataFrame, vertices: Vertices, names: Iterable[str], max_edges: int = 3, min_fails: int = 2, k: int | None = None) -> dict[str, DataFrame]:
    """What ``mine`` finds by each of the scores, of graphs that are written once."""
    _check(max_edges, 1, min_fails)
    g = Graphs(edges, vertices)
    return {name: _mine(g, name, max_edges, min_fails, k=k) for name in names}


def _check(max_edges: int, min_edges: int, min_fails: int) -> None:
    if max_edges < 1 or min_edges < 0 or min_fails < 1:
        raise ValueError("max_edges and min_fails start at 1, min_edges at 0")


def _mine(g: Graphs, name: str, max_edges: int, min_fails: int, min_edges: int = 1, k: int | None = None, improving: bool = False, until: float | None = None, true_prior: bool = False, start: DataFrame | None = None, stats: dict | None = None) -> DataFrame:
    found = start
    frequent, level, full = g.one_edge(min_fails), None, True
    previous: DataFrame | None = None
    for size in range(1, max_edges + 1):
        frequent = staged(frequent, "frequent")
        scored = with_pattern_score(frequent, g.parts, g.totals, name, max_edges, min_fails, true_prior)
        if improving and previous is not None:
            # a pattern stays if one of its parents scores less
            parents = scored.select("pattern", F.explode("pattern").alias("edge")).select("pattern", F.array_remove(F.col("pattern"), F.col("edge")).alias("parent"))
            kept = parents.join(previous, "parent").groupBy("pattern").agg(F.min("parent_score").alias("parent_score"))
            scored = scored.join(kept, "pattern").where("score > parent_score").drop("parent_score")
        scored = staged(scored, "patterns")
        previous = scored.select(F.col("pattern").alias("parent"), F.col("score").alias("parent_score"))
        if size >= min_edges:
            now = scored.drop("seq")
            found = now if found is None else found.unionByName(now)
        if size == max_edges or (until is not None and time.monotonic() > until):
            break
        alive = scored
        if k is not None and found is not None:
            found, alive = _best(found, k, scored)
        n_alive = alive.count()
        if stats is not None:
            stats["extended"] = stats.get("extended", 0) + n_alive
        whole = n_alive == frequent.count()
        level = g.level(level, size, alive, n_alive, min_fails, full, whole)
        full = full and whole
        frequent = g.grown(level, alive, min_fails, full)
    assert found is not None
    return _top(found, k) if k is not None else found


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best patterns, each once."""
    return found.dropDuplicates(["pattern"]).orderBy(order_key(F.col("score")), _key(F.col("pattern"))).limit(k)


def _best(found: DataFrame, k: int, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The k best patterns so far, written, and those of scored that a better one may grow from."""
    best = staged(_top(found, k), "best")
    worst = best.agg(F.count("*").alias("n"), F.min("score").alias("worst")).first()
    return best, scored.where(F.col("bound") >= worst["worst"]) if worst["n"] == k else scored


def contains_pattern(edges: DataFrame, pattern: list[tuple[str, str]], graphs: DataFrame, missing: bool = False) -> DataFrame:
    """outcome, graph_id of the graphs that hold every edge of a pattern, or of those that miss one."""
    wanted = edges.sparkSession.createDataFrame(pattern, "src string, dst string")
    held = edges.select("outcome", "graph_id", "src", "dst").distinct().join(F.broadcast(wanted), ["src", "dst"]).groupBy("outcome", "graph_id").agg(F.count("*").alias("n")).where(F.col("n") == len(set(pattern)))
    return graphs.select("outcome", "graph_id").distinct().join(held, ["outcome", "graph_id"], "left_anti" if missing else "left_semi")


def leap(edges: DataFrame, vertices: Vertices, name: str = "relative_f1", max_edges: int = 3, min_fails: int = 2, k: int = 10, sigma: float = 0.01, start: DataFrame | None = None, stats: dict | None = None) -> DataFrame:
    """Top-k with structural leaps.

    A pattern leaps to an extension of it if their failing and their passing frequencies both differ by less than sigma (2 d / (a + b)), the extension
    scores no less, and the extension has another parent that comes before the pattern (by score, then pattern).  A pattern that leaps is
    neither kept nor extended; what it leaps to is kept, whatever becomes of its parents.  The reference, which searches best first, leaps where such an
    extension happens to have been visited; here it doesn't depend on the order of a search.  start and stats as in ``mine``.
    """
    return _leap(Graphs(edges, vertices), name, max_edges, min_fails, k, sigma, start, stats)


def _leap(g: Graphs, name: str, max_edges: int, min_fails: int, k: int, sigma: float, start: DataFrame | None = None, stats: dict | None = None) -> DataFrame:
    def patterns(frequent: DataFrame) -> DataFrame:
        return staged(with_pattern_score(staged(frequent, "frequent"), g.parts, g.totals, name, max_edges, min_fails, keep_parts=True), "patterns")

    kids, level, full = patterns(g.one_edge(min_fails)), None, True
    scored, found = kids, start
    for size in range(1, max_edges + 1):
        now = scored.drop("parts_ok", "seq")
        before = now if found is None else found.unionByName(now)
        if size == max_edges:
            return _top(before, k)
        _, alive = _best(before, k, scored)
        n_alive = alive.count()
        if stats is not None:
            stats["extended"] = stats.get("extended", 0) + n_alive
        whole = n_alive == kids.count()
        level = g.level(level, size, alive, n_alive, min_fails, full, whole)
        full = full and whole
        kids = patterns(g.grown(level, alive, min_fails, full))
        jumps = staged(_jumps(alive, kids, sigma), "jumps")
        gone = jumps.where("leaps").select(F.col("parent").alias("pattern")).distinct()
        if stats is not None:
            stats["leapt"] = stats.get("leapt", 0) + gone.count()
        found = staged(before.join(gone, "pattern", "left_anti"), "found")
        # a kid stays if a pattern leaps to it or some parent of it stays
        held = jumps.join(gone.select(F.col("pattern").alias("parent"), F.lit(True).alias("gone")), "parent", "left").where(F.col("leaps") | F.col("gone").isNull()).select("pattern").distinct()
        scored = staged(kids.join(held, "pattern", "left_semi"), "patterns")
    raise ValueError("max_edges starts at 1")


def _jumps(parents: DataFrame, kids: DataFrame, sigma: float) -> DataFrame:
    """pattern, parent, leaps for each parent of each kid."""
    freq = lambda df: df.withColumn("o", F.col("parts_ok") / (F.size("pattern") + F.size("labels")))
    mine = freq(kids).select("pattern", "fail_graphs", "o", "score", F.explode("pattern").alias("edge")).withColumn("parent", F.array_remove(F.col("pattern"), F.col("edge")))
    of = freq(parents).select(F.col("pattern").alias("parent"), F.col("fail_graphs").alias("parent_fails"), F.col("o").alias("parent_o"), F.col("score").alias("parent_score"))
    pairs = mine.join(of, "parent")
    order = [order_key(F.col("parent_score")), _key(F.col("parent"))]
    first = F.row_number().over(Window.partitionBy("pattern").orderBy(*order)) == 1  # a pattern has at most as many parents as edges

    def near(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        return F.when(x + y == 0, True).otherwise(2 * (x - y) / F.when(x + y != 0, x + y) < sigma)

    leaps = ~first & near("parent_fails", "fail_graphs") & near("parent_o", "o") & (order_key(F.col("score")) <= order_key(F.col("parent_score")))
    return pairs.select("pattern", "parent", leaps.alias("leaps"))


def halving_leap(edges: DataFrame, vertices: Vertices, name: str = "relative_f1", max_edges: int = 3, min_fails: int = 2, k: int = 10, sigma: float = 0.01, settled: float = 0.01, stats: dict | None = None) -> DataFrame:
    """Leaps at a support that is halved, from all failing graphs on, until the sum of the k best scores moves by no more than
    ``settled`` or the support is down at min_fails; then a pass without leaps at min_fails.  Each pass starts from the best patterns of the one before,
    whose k-th score prunes it from its first level on.  stats gets the number of patterns that the last pass extends."""
    g = Graphs(edges, vertices)
    fails = g.totals.first()["fail_total"]
    share, before, now = 1.0, -math.inf, math.inf
    best: DataFrame | None = None
    while True:
        support = max(1, min_fails, int(share * fails))
        best = staged(_leap(g, name, max_edges, support, k, sigma, best), "best")
        before, now = now, best.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("s")).first()["s"]
        if support <= min_fails or abs(now - before) <= settled:
            break
        share /= 2
    # what a pass of higher support says of the most that may grow from a pattern holds for that support only
    return _mine(g, name, max_edges, min_fails, k=k, start=best, stats=stats)


class _Climb:
    """Random walks up the pattern lattice, all as rows of one table: a walk goes on to a better extension, uniformly or
    in proportion to the score, until there is none.  The choice is an argmax of seeded exponential keys, so it can be repeated."""

    def __init__(self, edges: DataFrame, vertices: Vertices, name: str, max_edges: int, min_fails: int, seed: int, weighted: bool):
        self.g = Graphs(edges, vertices)
        self.name, self.max_edges, self.min_fails, self.seed, self.weighted = name, max_edges, min_fails, seed, weighted

    def scored(self, frequent: DataFrame) -> DataFrame:
        return staged(with_pattern_score(staged(frequent, "frequent"), self.g.parts, self.g.totals, self.name, self.max_edges, self.min_fails, keep_parts=True), "patterns")

    @staticmethod
    def better(than: str) -> Column:
        """A pattern scores more, or the same while no passing graph holds any part of it."""
        return (F.col("score") > F.col(than)) | ((F.col("score") == F.col(than)) & (F.col("parts_ok") == 0))

    def chosen(self, options: DataFrame, step: int) -> DataFrame:
        """walk, pattern, labels, score: one option for each walk."""
        least = options.agg(F.min("score").alias("least"))
        weight = F.col("score") - F.col("least") + 1e-8 if self.weighted else F.lit(1.0)
        u = (F.pmod(F.xxhash64(F.lit(self.seed), F.lit(step), "walk", "pattern"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        key = -F.log(u) / weight
        return options.join(F.broadcast(least)).groupBy("walk").agg(F.min_by(F.struct("pattern", "labels", "score"), F.struct(key, _key(F.col("pattern")))).alias("at")).select("walk", "at.*")

    def run(self, first: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """first turns the scored one-edge patterns into the options (walk, pattern, labels, score) of every walk."""
        level, scored = None, self.scored(self.g.one_edge(self.min_fails))
        at = staged(self.chosen(first(scored), 0), "walks")
        for step in range(1, self.max_edges):
            alive = staged(scored.join(at.select("pattern").distinct(), "pattern", "left_semi"), "alive")
            level = self.g.level(level, step, alive, alive.count(), self.min_fails)
            scored = self.scored(self.g.grown(level, alive, self.min_fails))
            grown = scored.select("pattern", "labels", "score", "parts_ok", F.explode("pattern").alias("edge")).withColumn("parent", F.array_remove(F.col("pattern"), F.col("edge")))
            options = at.select("walk", F.col("pattern").alias("parent"), F.col("score").alias("parent_score")).join(grown, "parent").where(self.better("parent_score")).select("walk", "pattern", "labels", "score")
            moved = self.chosen(options, step)
            at = staged(moved.unionByName(at.join(moved.select("walk"), "walk", "left_anti")), "walks")
        return at


def walks(edges: DataFrame, vertices: Vertices, n_walks: int = 10, name: str = "relative_f1", max_edges: int = 3, min_fails: int = 2, seed: int = 0, weighted: bool = True) -> DataFrame:
    """walk, pattern, score of where each walk ends.  A walk starts at a one-edge pattern."""
    # each pattern offers itself to every walk, and the offers are aggregated where they arise
    offers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_walks - 1).cast("long"))).alias("walk")
    found = _Climb(edges, vertices, name, max_edges, min_fails, seed, weighted).run(lambda one: one.select("pattern", "labels", "score", offers))
    return found.select("walk", "pattern", "score")


def top_labels(ranked: DataFrame, share: float = 0.0625, least: int = 10, min_groups: int = 2, apart: float = 1e-4) -> DataFrame:
    """label, score, place: the best labels, a share of all but at least so many, and on until min_groups times the score has
    dropped by more than ``apart`` from one label to the next.  ranked: label, score."""
    placed = staged(with_place(ranked.select("label", "score"), "label"), "placed")
    total = placed.agg(F.count("*").alias("n")).select(F.least(F.col("n"), F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("n")))).alias("total"))
    # a drop lies between two distinct scores, so drops are counted on one row a score
    groups = placed.groupBy("score").agg(F.min("place").alias("first"))
    w = Window.orderBy("first")
    drop = F.coalesce((F.lag("score").over(w) - F.col("score") > apart).cast("int"), F.lit(0))
    dropped = groups.withColumn("drop", drop).select("score", "first", F.sum("drop").over(w).alias("drops"), "drop")
    joined = placed.join(dropped, "score").join(F.broadcast(total))
    # the drop to a label counts from the label after it on
    before = F.col("drops") - F.when(F.col("place") == F.col("first"), F.col("drop")).otherwise(F.lit(0))
    return joined.where((F.col("place") <= F.col("total")) | (before < min_groups)).select("label", "score", "place")


def label_walks(edges: DataFrame, vertices: Vertices, ranked: DataFrame, per_label: int = 2, name: str = "relative_f1", max_edges: int = 3, min_fails: int = 2, min_edges: int = 1, share: float = 0.0625, least: int = 10, min_groups: int = 2, skip_seen: bool = False, seed: int = 0, weighted: bool = True) -> DataFrame:
    """pattern, labels, score, label, place: the different patterns that walks from the best labels end at, each with the first label
    that led there.  With skip_seen, a label in a pattern of a label before it that isn't skipped itself has no walks.

    ranked: label, score, by the same score as the patterns'.
    """
    starts = staged(top_labels(ranked, share, least, min_groups), "labels")
    numbered = starts.select("label", F.col("score").alias("label_score"), F.explode(F.sequence(F.lit(0), F.lit(per_label - 1))).alias("k")).withColumn("walk", F.concat_ws(" #", "label", F.col("k").cast("string")))

    def first(one: DataFrame) -> DataFrame:
        held = one.select("pattern", "labels", "score", "parts_ok", F.explode("labels").alias("label"))
        return numbered.join(held, "label").where(_Climb.better("label_score")).select("walk", "pattern", "labels", "score")

    climbed = _Climb(edges, vertices, name, max_edges, min_fails, seed, weighted).run(first)
    ends = staged(climbed.where(F.size("pattern") >= min_edges).join(numbered.select("walk", "label"), "walk").join(starts.select("label", "place"), "label"), "ends")
    if skip_seen:
        ends = ends.join(_skipped(ends), "label", "left_anti")
    best = ends.groupBy("pattern", "labels", "score").agg(F.min(F.struct("place", "label")).alias("at"))
    return best.select("pattern", "labels", "score", "at.label", "at.place")


def _skipped(ends: DataFrame) -> DataFrame:
    """label of those that a pattern of an earlier, kept label holds.  A round settles every label whose earlier coverers are settled."""
    covers = staged(ends.select("place", F.explode("labels").alias("covered")).distinct().join(ends.select(F.col("label").alias("covered"), F.col("place").alias("at")).distinct(), "covered").where("place < at").select("place", "at").distinct(), "covers")
    open_ = staged(ends.select("label", "place").distinct(), "open")
    skipped: DataFrame | None = None
    while not open_.isEmpty():
        by_open = covers.join(open_.select("place"), "place", "left_semi").select(F.col("at").alias("place")).distinct()
        kept = staged(open_.join(by_open, "place", "left_anti"), "kept")
        gone = staged(open_.join(covers.join(kept.select("place"), "place", "left_semi").select(F.col("at").alias("place")).distinct(), "place", "left_semi"), "gone")
        skipped = gone if skipped is None else skipped.unionByName(gone)
        open_ = staged(open_.join(kept.unionByName(gone).select("place"), "place", "left_anti"), "open")
    return (ends.limit(0) if skipped is None else skipped).select("label").distinct()
