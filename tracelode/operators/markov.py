"""Markov chains over rankings, and hitting times as the number of looks a programmer takes to reach a fault.

A chain is a table transitions(src, dst, p) over string states: ``g<k>`` for the k-th score group and the label itself
for a label.  Where rules give a transition twice the later rule wins, by rule number.  Rows of a chain with jumps may
sum to less than one; ``renormalise`` scales them.

Exact hitting times come from one dense solve a target state, the chain (at most ``EXACT_STATES`` states, so a proven
bound) being broadcast and the targets spread over tasks; larger chains are sampled by seeded walks, each a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .ranking import with_groups

#: Walks and the most steps of each; steps whose random numbers are drawn at once.
WALKS, STEPS, DRAWN = 500, 1_000_000, 4096
#: States up to which hitting times are solved exactly, and the most that a chain may have at all.
EXACT_STATES, MAX_STATES = 1000, 20_000


def group_state(k: Column) -> Column:
    return F.concat(F.lit("g"), (k - 1).cast("string"))


def ranked_chain(ranked: DataFrame, jump: float = 0.0, jumps: DataFrame | None = None) -> DataFrame:
    """src, dst, p of the chain of a ranking (label, score), with jumps (src, dst) between labels.

    A group goes to each of its labels with half its probability mass, the rest of it to its neighbours: back with
    (B - 1) / B of a half, on with 1 / B of a half, B being the number of groups; the first group keeps its way back, the
    last its way on.  A label goes back to its group with 1 - jump and jumps to each of its known neighbours
    with an equal share of jump.
    """
    grouped = staged(with_groups(ranked.select("label", "score")).select("label", "score_group", "size"), "ranking")  # every rule reads it
    groups = grouped.select("score_group", "size").distinct()
    n = groups.agg(F.count("*").cast("double").alias("b"))
    g = groups.join(F.broadcast(n))
    half, b = F.lit(0.5), F.col("b")
    here = group_state(F.col("score_group"))
    rule = lambda df, number, src, dst, p: df.select(src.alias("src"), dst.alias("dst"), p.cast("double").alias("p"), F.lit(number).alias("rule"))
    rows = [
        rule(grouped, 0, here, F.col("label"), half / F.col("size")),
        rule(grouped, 1, F.col("label"), here, F.lit(1.0 - jump)),
        rule(g.where("score_group > 1"), 3, here, group_state(F.col("score_group") - 1), half * (b - 1) / b),
        rule(g.where("score_group < b"), 4, here, group_state(F.col("score_group") + 1), half / b),
        rule(g.where("score_group = 1"), 5, here, here, half * (b - 1) / b),
        rule(g.where("score_group = b"), 6, here, here, half / b + F.when(F.col("b") == 1, half * (b - 1) / b).otherwise(F.lit(0.0))),
    ]
    if jumps is not None and jump > 0:
        known = jumps.select("src", "dst").distinct().join(grouped.select(F.col("label").alias("src")), "src", "left_semi").join(grouped.select(F.col("label").alias("dst")), "dst", "left_semi")
        share = known.withColumn("p", F.lit(jump) / F.count("*").over(Window.partitionBy("src")))
        rows.append(rule(share, 2, F.col("src"), F.col("dst"), F.col("p")))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("src", "dst").agg(F.max_by("p", "rule").alias("p"))


def behavioural_jumps(edges: DataFrame) -> DataFrame:
    """src, dst: labels next to each other in a graph, both ways."""
    e = edges.select("src", "dst").distinct()
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()


def spatial_jumps(locations: DataFrame) -> DataFrame:
    """src, dst: different labels of one function.  locations: label, fn_name."""
    one = locations.select("label", "fn_name").distinct()
    return one.withColumnRenamed("label", "src").join(one.withColumnRenamed("label", "dst"), "fn_name").where("src != dst").select("src", "dst").distinct()


def cluster_jumps(cluster_labels: DataFrame) -> DataFrame:
    """src, dst: different labels of one cluster.  cluster_labels: cluster, label."""
    one = cluster_labels.select("cluster", "label").distinct()
    return one.withColumnRenamed("label", "src").join(one.withColumnRenamed("label", "dst"), "cluster").where("src != dst").select("src", "dst").distinct()


def all_jumps(edges: DataFrame, locations: DataFrame) -> DataFrame:
    return behavioural_jumps(edges).unionByName(spatial_jumps(locations)).distinct()


def control_chain(labels: DataFrame, jumps: DataFrame, restart: float = 0.01) -> DataFrame:
    """src, dst, p of the restart chain: from ``start`` to each label alike; from a label back with ``restart`` (surely, if it
    has no jumps), else along its jumps alike."""
    one = labels.select("label").distinct()
    n = one.agg(F.count("*").cast("double").alias("n"))
    known = jumps.select("src", "dst").distinct().join(one.select(F.col("label").alias("src")), "src", "left_semi").join(one.select(F.col("label").alias("dst")), "dst", "left_semi")
    out = known.groupBy("src").agg(F.count("*").cast("double").alias("k"))
    back = one.join(out.withColumnRenamed("src", "label"), "label", "left").select(F.col("label").alias("src"), F.lit("start").alias("dst"), F.when(F.col("k").isNull(), F.lit(1.0)).otherwise(F.lit(restart)).alias("p"))
    away = one.join(F.broadcast(n)).select(F.lit("start").alias("src"), F.col("label").alias("dst"), (1 / F.col("n")).alias("p"))
    along = known.join(out, "src").select("src", "dst", (F.lit(1.0 - restart) / F.col("k")).alias("p"))
    return away.unionByName(back).unionByName(along)


def pattern_chain(patterns: DataFrame, pattern_labels: DataFrame, jumps: DataFrame | None = None, jump: float = 0.5) -> DataFrame:
    """src, dst, p of the chain of ranked patterns (pattern, score): groups as in ranked_chain, a pattern being reached from
    its group, its labels from the pattern; a label goes back to each pattern that holds it alike.  With jumps (src, dst), it does so
    with 1 - jump and jumps to its known neighbours with an equal share of jump.

    pattern_labels: pattern, label.
    """
    top = ranked_chain(patterns.select(F.col("pattern").alias("label"), "score")).withColumn("p", F.when(F.col("src").rlike("^g[0-9]+$"), F.col("p")).otherwise(F.col("p") / 2))
    held = pattern_labels.select("pattern", "label").distinct()
    down = held.withColumn("p", F.lit(0.5) / F.count("*").over(Window.partitionBy("pattern"))).select(F.col("pattern").alias("src"), F.col("label").alias("dst"), "p")
    up = held.withColumn("p", F.lit(1.0) / F.count("*").over(Window.partitionBy("label"))).select(F.col("label").alias("src"), F.col("pattern").alias("dst"), "p")
    if jumps is None:
        return top.unionByName(down).unionByName(up)
    one = held.select("label").distinct()
    known = jumps.select("src", "dst").distinct().join(one.withColumnRenamed("label", "src"), "src", "left_semi").join(one.withColumnRenamed("label", "dst"), "dst", "left_semi")
    shares = known.groupBy("src").agg(F.count("*").alias("k"))
    along = known.join(shares, "src").select("src", "dst", (F.lit(jump) / F.col("k")).alias("p"))
    up = up.join(shares, "src", "left").select("src", "dst", F.when(F.col("k").isNull(), F.col("p")).otherwise(F.col("p") * (1 - jump)).alias("p"))
    return top.unionByName(down).unionByName(up).unionByName(along)


def renormalise(transitions: DataFrame) -> DataFrame:
    total = F.sum("p").over(Window.partitionBy("src"))
    return transitions.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(F.lit(0.0)))


def _index(transitions: DataFrame) -> tuple[list[str], list[tuple[int, int, float]]]:
    """States in order and numbered transitions of a chain that MAX_STATES bounds."""
    states = transitions.select(F.col("src").alias("s")).union(transitions.select("dst")).distinct().orderBy("s").limit(MAX_STATES + 1)
    names = [r["s"] for r in states.collect()]
    if len(names) > MAX_STATES:
        raise ValueError(f"a chain of more than {MAX_STATES} states")
    at = {s: k for k, s in enumerate(names)}
    return names, [(at[r["src"]], at[r["dst"]], r["p"]) for r in transitions.collect()]


def hitting_times(transitions: DataFrame, start: str = "g0") -> DataFrame:
    """state, hitting_time: expected steps from start to each state, exactly; infinite where it can't be reached."""
    spark = transitions.sparkSession
    names, rows = _index(staged(transitions, "chain"))
    if len(names) > EXACT_STATES:
        raise ValueError("too many states for exact hitting times; sample them")
    shared = spark.sparkContext.broadcast((names, rows, start))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        names, rows, start = shared.value
        n = len(names)
        p = np.zeros((n, n))
        for i, j, x in rows:
            p[i, j] = x
        at = {s: k for k, s in enumerate(names)}
        follow = [np.flatnonzero(r) for r in p]
        for batch in batches:
            out = []
            for state in batch["state"]:
                target = at[state]
                if start not in at:
                    out.append(float("inf"))
                    continue
                # what the start reaches without passing the target; the target itself counts as reached if it is met
                reached, todo, met = {at[start]}, [at[start]], at[start] == target
                while todo:
                    for j in follow[todo.pop()].tolist():
                        met = met or j == target
                        if j != target and j not in reached:
                            reached.add(j)
                            todo.append(j)
                if not met or at[start] == target:
                    out.append(0.0 if met else float("inf"))
                    continue
                q = sorted(reached)
                try:
                    h = np.linalg.solve(np.eye(len(q)) - p[np.ix_(q, q)], np.ones(len(q)))
                    x = float(h[q.index(at[start])])
                    out.append(x if x > 0 and np.isfinite(x) else float("inf"))
                except np.linalg.LinAlgError:
                    out.append(float("inf"))
            yield pd.DataFrame({"state": batch["state"], "hitting_time": out})

    targets = spark.createDataFrame([(s,) for s in names], "state string")
    return targets.repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism))).mapInPandas(solve, "state string, hitting_time double")


def sampled_hitting_times(transitions: DataFrame, start: str = "g0", n_walks: int = WALKS, max_steps: int = STEPS, seed: int = 0) -> DataFrame:
    """state, hitting_time: expected steps by seeded walks, each walk a row of its own generator; a task's walks go in step.

    A walk that doesn't meet a state within max_steps counts as max_steps.  Rows of the chain are renormalised, an empty
    row leads back to the start.
    """
    spark = transitions.sparkSession
    names, rows = _index(staged(renormalise(transitions), "chain"))
    shared = spark.sparkContext.broadcast((names, rows, start))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        names, rows, start = shared.value
        first, n = names.index(start), len(names)
        out: list[list[tuple[int, float]]] = [[] for _ in names]
        for i, j, x in rows:
            if x > 0:
                out[i].append((j, x))
        out = [o or [(first, 1.0)] for o in out]
        to = np.array([j for o in out for j, _ in o])
        # the row of state i lies between i and i + 1, its last bound at i + 1 exactly
        bounds = np.concatenate([i + np.append((c := np.cumsum([x for _, x in o]))[:-1] / c[-1], 1.0) for i, o in enumerate(out)])
        for batch in batches:
            ids = batch["id"].to_numpy()
            draw = [np.random.default_rng([seed, int(w)]) for w in ids]
            times = np.full((len(ids), n), max_steps)
            times[:, first] = 0
            going, at, left = np.arange(len(ids)), np.full(len(ids), first), np.full(len(ids), n - 1)
            step = 1
            while step < max_steps and (left[going] > 0).any():
                stay = left[going] > 0
                going, at = going[stay], at[stay]
                # below 1, so that a state's number plus the draw stays in its row
                drawn = np.minimum(np.stack([draw[w].random(DRAWN) for w in going]).T, 1 - 1e-9)[: max_steps - step].copy()
                path = np.empty(drawn.shape, dtype=np.int64)
                for k, u in enumerate(drawn):
                    path[k] = at = to.take(bounds.searchsorted(at + u, side="right"))
                # in reverse, so that the first visit is the last one written
                met = np.full(times.size, max_steps)
                met[(going * n + path)[::-1].ravel()] = np.repeat(np.arange(step, step + len(path))[::-1], len(going))
                times = np.minimum(times, met.reshape(times.shape))
                left = (times == max_steps).sum(axis=1)
                step += len(path)
            for k in range(len(ids)):
                yield pd.DataFrame({"state": names, "time": times[k]})

    walked = spark.range(n_walks).repartition(spark.sparkContext.defaultParallelism).mapInPandas(walk, "state string, time long")
    return walked.groupBy("state").agg(F.avg("time").alias("hitting_time"))


def any_hitting_times(transitions: DataFrame, start: str = "g0", seed: int = 0, exact: bool | None = None, limit: int | None = None) -> DataFrame:
    """state, hitting_time: exactly where the chain has at most ``limit`` (EXACT_STATES) states (or ``exact`` says so), else from walks."""
    chain = staged(transitions, "chain")
    if exact is None:
        limit = EXACT_STATES if limit is None else limit
        states = chain.select(F.col("src").alias("s")).union(chain.select("dst")).distinct()
        exact = states.limit(limit + 1).count() <= limit
    return hitting_times(chain, start) if exact else sampled_hitting_times(chain, start, seed=seed)


def hitting_rank(times: DataFrame, faults: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """One row, rank: states in order of their rounded hitting time, ties by mid-rank; the smallest one of a faulty label.
    times: state, hitting_time; faults: label.  Groups are no locations and don't count; nor do other states than locations (label), if given."""
    if locations is not None:
        times = times.join(locations.select(F.col("label").alias("state")), "state", "left_semi")
    labels = times.where(~F.col("state").rlike("^g[0-9]+$")).select(F.col("state").alias("label"), F.when(F.col("hitting_time") <= 0, F.lit(float("inf"))).otherwise(F.round("hitting_time")).alias("t"))
    ranked = with_groups(labels.select("label", (-F.col("t")).alias("score")))
    return ranked.join(faults.select("label").distinct(), "label", "left_semi").agg(F.min("mid_rank").alias("rank"))


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """label: what can be reached from start, itself included; breadth first, a join a round, staged each time."""
    e = staged(edges.select("src", "dst").distinct(), "edges")
    seen = e.sparkSession.createDataFrame([(start,)], "label string")
    frontier = seen
    while True:
        new = frontier.join(e, frontier["label"] == e["src"]).select(F.col("dst").alias("label")).distinct().join(seen, "label", "left_anti")
        new = staged(new, "frontier")
        if new.isEmpty():
            break
        seen, frontier = staged(seen.unionByName(new), "seen"), new
    return seen
