"""Fault localisation end to end: patterns are clustered, their labels ranked, and rankings and chains evaluated against faults.

Any miner's patterns will do (pattern, labels, score).  Each step is one of the library's operators; what is read more than
once is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import clustering, markov, ranking, support

#: The ways to evaluate a ranking: along the list, along the chain of groups, and along chains with jumps between labels.
LIST, CHAIN, SPATIAL, BEHAVIOURAL, BOTH = "Ranked-List", "Markov-Ranked-List", "Spacial-Jumps", "Behavioral-Jumps", "Behavioral+Spacial-Jumps"
JUMP = 0.5


@dataclass(frozen=True)
class Localisation:
    """members: id (the pattern's text), items (its labels), score, cluster; clusters: cluster, n, score; locations: label, score."""

    members: DataFrame
    clusters: DataFrame
    locations: DataFrame


def pattern_id(patterns: DataFrame) -> DataFrame:
    """id, items, score: one row a pattern, whatever how often a miner found it."""
    return patterns.select(F.array_join("pattern", "; ").alias("id"), F.col("labels").alias("items"), "score").groupBy("id").agg(F.min("items").alias("items"), F.max("score").alias("score"))


def localize(patterns: DataFrame, label_scores: DataFrame, epsilon: float = 0.05) -> Localisation:
    """Patterns whose label sets are within epsilon of one another are linked; clusters are ranked by their patterns, locations by their own
    score and their clusters'.  patterns: pattern, labels, score; label_scores: label, score."""
    nodes = staged(pattern_id(patterns), "nodes")
    members = staged(nodes.join(clustering.cluster(nodes.select("id", "items"), epsilon), "id"), "members")
    clusters = staged(clustering.cluster_scores(members), "clusters")
    labels = members.select("cluster", F.explode("items").alias("label")).distinct()
    return Localisation(members, clusters, staged(clustering.location_scores(clusters, labels, label_scores), "locations"))


def _jumps(kind: str, edges: DataFrame, locations: DataFrame) -> DataFrame | None:
    return {SPATIAL: lambda: markov.spatial_jumps(locations), BEHAVIOURAL: lambda: markov.behavioural_jumps(edges), BOTH: lambda: markov.all_jumps(edges, locations)}.get(kind, lambda: None)()


def evaluate(edges: DataFrame, vertices: DataFrame, faults: DataFrame, scores: Iterable[str], miners: dict[str, tuple[str, DataFrame]], label_chains: Iterable[str] = (LIST, SPATIAL, BEHAVIOURAL, BOTH), pattern_chains: Iterable[str] = (LIST, CHAIN, SPATIAL, BEHAVIOURAL, BOTH), jump: float = JUMP) -> DataFrame:
    """method, score, eval, rank: what each ranking of labels (method cbsfl, one a score) and each miner's ranking of patterns is worth in each way.

    edges, vertices (with fn_name): labelled graphs; faults: label; miners: (score, patterns) by name.  A rank along a list is the looks until a fault is met, along a chain the rank
    of its hitting time: exact where the chain is small enough, else from walks.
    """
    locations = staged(vertices.select("label", "fn_name").distinct(), "locations")
    flows = staged(edges.select("src", "dst").distinct(), "flows")
    rows: list[DataFrame] = []

    def add(method: str, score: str, way: str, rank: DataFrame) -> None:
        rows.append(rank.select(F.lit(method).alias("method"), F.lit(score).alias("score"), F.lit(way).alias("eval"), F.col("rank").cast("double").alias("rank")))

    for name in scores:
        ranked = staged(support.with_score(support.label_support(vertices), name).select("label", "score"), "ranked")
        for way in label_chains:
            if way == LIST:
                add("cbsfl", name, way, ranking.rank_eval(ranked, faults, "label"))
            else:
                add("cbsfl", name, way, markov.hitting_rank(markov.any_hitting_times(markov.ranked_chain(ranked, jump, _jumps(way, flows, locations))), faults))
    for method, (name, patterns) in miners.items():
        nodes = staged(pattern_id(patterns), "nodes")
        held = nodes.select("id", F.explode("items").alias("label"))
        for way in pattern_chains:
            if way == LIST:
                add(method, name, way, ranking.hit_rank_eval(nodes, held.join(faults.select("label"), "label", "left_semi").select("id").distinct(), "id"))
            else:
                chain = markov.pattern_chain(nodes.select(F.col("id").alias("pattern"), "score"), held.withColumnRenamed("id", "pattern"), _jumps(way, flows, locations), jump)
                add(method, name, way, markov.hitting_rank(markov.any_hitting_times(chain), faults, held.select("label").distinct()))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def compare(runs: dict[str, DataFrame], faults: DataFrame) -> DataFrame:
    """method, n, sum, mean, stddev, stderr (against the first run in order of names), score_group and rank of the first group with a fault: two or more miners' patterns, all
    cut to the shortest for the statistics.  runs: patterns (pattern, labels, score) by name; faults: label."""
    if len(runs) < 2:
        raise ValueError("a comparison takes two runs at least")
    outputs, ranks = None, None
    for method, patterns in runs.items():
        nodes = staged(pattern_id(patterns), "nodes")
        placed = ranking.with_place(nodes, "id").select(F.lit(method).alias("method"), "place", "score")
        hit = nodes.select("id", F.explode("items").alias("label")).join(faults.select("label"), "label", "left_semi").select("id").distinct()
        rank = ranking.hit_rank_eval(nodes, hit, "id").select(F.lit(method).alias("method"), "rank", "score_group")
        outputs, ranks = (placed, rank) if outputs is None else (outputs.unionByName(placed), ranks.unionByName(rank))
    return ranking.compare_stats(outputs).join(ranks, "method")
