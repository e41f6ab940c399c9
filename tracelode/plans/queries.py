"""The queries of the library over the driver's tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import SCORES
from ..operators import causal, cfg, clustering, dataflow, embeddings, lattice, localisation, markov, metric, minimise, mining, objects, points, ranking, support, walk_similarity
from ..sources import dot, profiles, simple
from ..staging import new_path, staged
from ..streaming import flows, ordered
from . import traces
from .traces import ENTRY, SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EPSILON = 0.1


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            ORACLES[name or fn.__name__] = sql
        return fn

    return add


def rounded(c: str | Column, digits: int = 9) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def by_trace(df: DataFrame) -> DataFrame:
    return df.select("graph_id.*", *[c for c in df.columns if c != "graph_id"])


# -- traces and supports


@query(f"{SQL} select user_id, wk, label, case when failed = 1 then 'fail' else 'ok' end outcome from v")
def trace_vertices(spark: SparkSession, d: str) -> DataFrame:
    return by_trace(traces.vertices(spark, d).select("graph_id", "label", "outcome"))


@query(f"{SQL} select user_id, wk, src, dst, traversed, case when failed = 1 then 'fail' else 'ok' end outcome from fl")
def trace_edges(spark: SparkSession, d: str) -> DataFrame:
    return by_trace(traces.edges(spark, d).select("graph_id", "src", "dst", "traversed", "outcome"))


_LS = "ls as (select label, sum(failed) fa, sum(1 - failed) oa, any_value(event_type) fn_name, any_value(bbid) bbid from v group by label having sum(failed) > 0)"


@query(f"{SQL}, {_LS} select label, cast(fa as bigint) fail_graphs, cast(oa as bigint) ok_graphs, cast(nf as bigint) fail_total, cast(n_ok as bigint) ok_total from ls, n")
def label_support(spark: SparkSession, d: str) -> DataFrame:
    return support.label_support(traces.vertices(spark, d))


_PLOGP = "case when {0} > 0 then {0} * log2({0}) else 0 end"
#: f, o, p: the shares of failing and passing graphs with the label, and the prior of both.
_SCORE_SQL = {
    "relative_precision": "f/(f+o) - p/(p+p)",
    "relative_f1": "2*((f+o)/(p+f+o)) * (f/(f+o) - p/(p+p))",
    "relative_jaccard": "f/(p+o) - p/(p+p)",
    "relative_ochiai": "sqrt((f+o)/p) * (f/(f+o) - p/(p+p))",
    "precision": "f/(f+o)",
    "f1": "2*((f+o)/(p+f+o)) * (f/(f+o))",
    "jaccard": "f/(p+o)",
    "ochiai_squared": "(f/p)*(f/(f+o))",
    "ochiai": "sqrt((f/p)*(f/(f+o)))",
    "contrast": "f - o",
    "expr": "(f-o)/(p+o)",
    "associational_risk": "(f - p*f - p*o)/((f+o+0.00001) - (f+o)*(f+o))",
    "information_gain": f"{_PLOGP.format('(f/(f+o))')} + {_PLOGP.format('(o/(f+o))')} - 2*({_PLOGP.format('p')})",
}
_FO = "fo as (select ls.*, fa::double/nt f, oa::double/nt o, n_ok::double/nt p from ls, n)"


def _score_query(name: str) -> None:
    @query(f"{SQL}, {_LS}, {_FO} select label, round({_SCORE_SQL[name]}, 9) + 0.0 score from fo", name=f"score_{name}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return support.with_score(support.label_support(traces.vertices(spark, d)), name).select("label", rounded("score").alias("score"))


for _name in SCORES:
    _score_query(_name)


def scored_labels(spark: SparkSession, d: str, name: str = "precision") -> DataFrame:
    """label, fn_name, bbid, score."""
    v = traces.vertices(spark, d)
    where = v.select("label", "fn_name", "bbid").distinct()
    return support.with_score(support.label_support(v), name).join(where, "label").select("label", "fn_name", "bbid", rounded("score").alias("score"))


_SL = f"{SQL}, {_LS}, {_FO}, sl as (select label, fn_name, bbid, round({_SCORE_SQL['precision']}, 9) + 0.0 score from fo)"


@query(f"{_SL} select label, fn_name, bbid, score, row_number() over (order by score desc, label) as place from sl")
def rank_labels(spark: SparkSession, d: str) -> DataFrame:
    return ranking.with_place(scored_labels(spark, d), "label")


_GR = "gr as (select *, dense_rank() over (order by score desc) score_group, rank() over (order by score desc) - 1 before, count(*) over (partition by score) size from sl)"


@query(f"{_SL}, {_GR} select label, score_group, size from gr")
def rank_label_groups(spark: SparkSession, d: str) -> DataFrame:
    return ranking.with_groups(scored_labels(spark, d)).select("label", F.col("score_group").cast("long").alias("score_group"), "size")


@query(f"{_SL}, {_GR} select label, before + size / 2 as mid_rank from gr")
def rank_midrank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.with_groups(scored_labels(spark, d)).select("label", "mid_rank")


@query(f"{_SL} select label, score from sl order by score desc, label limit 5")
def top_labels(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(scored_labels(spark, d).select("label", "score"), 5, "label")


_ES = "es as (select src, dst, sum(failed) fa, sum(1 - failed) oa from fl group by src, dst having sum(failed) > 0)"


@query(f"{SQL}, {_ES} select src, dst, cast(fa as bigint) fail_graphs, cast(oa as bigint) ok_graphs, cast(nf as bigint) fail_total, cast(n_ok as bigint) ok_total from es, n")
def edge_support(spark: SparkSession, d: str) -> DataFrame:
    return support.edge_support(traces.edges(spark, d))


_VO = "vo as (select label, sum(1 - failed) k from v group by label)"


@query(
    f"{SQL}, {_ES}, {_VO}, ef as (select src, dst, fa::double/nt f, (oa + coalesce(a.k, 0) + coalesce(b.k, 0))::double/nt/3 o from es join n on true left join vo a on a.label = src left join vo b on b.label = dst) "
    "select src, dst, round(f/(f+o), 9) + 0.0 score from ef"
)
def edge_scores(spark: SparkSession, d: str) -> DataFrame:
    e = support.edge_pattern_support(traces.edges(spark, d), traces.vertices(spark, d))
    return e.select("src", "dst", rounded(SCORES["precision"](F.col("f"), F.col("o"), *support.priors())).alias("score"))


_ED = "ed as (select distinct src, dst from fl)"


@query(f"{SQL}, {_ED}, x as (select src label, 0 i, 1 o from ed union all select dst, 1, 0 from ed) select label, cast(sum(i) as bigint) in_degree, cast(sum(o) as bigint) out_degree, count(*) degree from x group by label")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return support.degrees(traces.edges(spark, d))


@query(f"{SQL} select case when failed = 1 then 'fail' else 'ok' end outcome, label, count(*) n from v group by 1, 2")
def label_frequency(spark: SparkSession, d: str) -> DataFrame:
    return support.label_frequency(traces.vertices(spark, d))


@query(f"{SQL} select case when failed = 1 then 'fail' else 'ok' end outcome, src, dst, count(*) n, cast(sum(traversed) as bigint) traversed from fl group by 1, 2, 3")
def edge_frequency(spark: SparkSession, d: str) -> DataFrame:
    return support.edge_frequency(traces.edges(spark, d))


@query(f"{SQL} select user_id exec_id, src, dst, cast(sum(traversed) as bigint) traversed, array_to_string(list_sort(list_distinct(list(cast(traversed as varchar)))), ',') positions, arg_max(cast(traversed as varchar), wk) last_position from fl group by 1, 2, 3")
def profile_merge(spark: SparkSession, d: str) -> DataFrame:
    parts = traces.edges(spark, d).select(F.col("graph_id.user_id").alias("exec_id"), F.col("graph_id.wk").alias("part"), "src", "dst", "traversed", F.col("traversed").cast("string").alias("position"))
    return support.merge_profiles(parts).withColumn("positions", F.array_join("positions", ","))


# -- jumps between labels

_JB = "jb as (select distinct src, dst from (select src, dst from ed union all select dst, src from ed) where src != dst)"
_LO = "lo as (select distinct label, event_type fn_name from v)"
_JS = "js as (select distinct a.label src, b.label dst from lo a join lo b on a.fn_name = b.fn_name and a.label != b.label)"


@query(f"{SQL}, {_ED}, {_JB} select src, dst from jb")
def jumps_behavioural(spark: SparkSession, d: str) -> DataFrame:
    return markov.behavioural_jumps(traces.edges(spark, d))


@query(f"{SQL}, {_LO}, {_JS} select src, dst from js")
def jumps_spatial(spark: SparkSession, d: str) -> DataFrame:
    return markov.spatial_jumps(traces.vertices(spark, d))


@query(f"{SQL}, {_ED}, {_JB}, {_LO}, {_JS} select * from jb union select * from js")
def jumps_both(spark: SparkSession, d: str) -> DataFrame:
    return markov.all_jumps(traces.edges(spark, d), traces.vertices(spark, d))


# -- patterns


def _pattern(c: str = "pattern") -> Column:
    return F.array_join(c, "; ")


_E2 = "ee as (select user_id, wk, failed, src, dst, src || ' -> ' || dst e from fl)"
_P1 = "p1 as (select e pattern, sum(failed) fa, sum(1 - failed) oa from ee group by e)"
_TOUCH = "({0}.src = {1}.src or {0}.src = {1}.dst or {0}.dst = {1}.src or {0}.dst = {1}.dst)"
_P2 = f"p2 as (select a.e || '; ' || b.e pattern, sum(a.failed) fa, sum(1 - a.failed) oa, a.e e1, b.e e2, any_value(a.src) s1, any_value(a.dst) d1, any_value(b.src) s2, any_value(b.dst) d2 from ee a join ee b on a.user_id = b.user_id and a.wk = b.wk and a.e < b.e and {_TOUCH.format('a', 'b')} group by a.e, b.e having sum(a.failed) >= 2)"
_P3 = f"""p3 as (select a.e || '; ' || b.e || '; ' || c.e pattern, sum(a.failed) fa, sum(1 - a.failed) oa from ee a join ee b on a.user_id = b.user_id and a.wk = b.wk and a.e < b.e
 join ee c on a.user_id = c.user_id and a.wk = c.wk and b.e < c.e
 where cast({_TOUCH.format('a', 'b')} as int) + cast({_TOUCH.format('a', 'c')} as int) + cast({_TOUCH.format('b', 'c')} as int) >= 2 group by 1 having sum(a.failed) >= 2)"""


def _mined(spark: SparkSession, d: str, size: int) -> DataFrame:
    return mining.frequent(traces.edges(spark, d), size).select(_pattern().alias("pattern"), "fail_graphs", "ok_graphs")


@query(f"{SQL}, {_E2}, {_P2} select pattern, cast(fa as bigint) fail_graphs, cast(oa as bigint) ok_graphs from p2")
def path2_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d, 2)


@query(f"{SQL}, {_E2}, {_P3} select pattern, cast(fa as bigint) fail_graphs, cast(oa as bigint) ok_graphs from p3")
def path3_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d, 3)


_PS = f"""{SQL}, {_E2}, {_VO}, eo as (select src, dst, sum(1 - failed) k from fl group by src, dst), edk as (select src || ' -> ' || dst e, src, dst, k from eo),
 q1 as (select e pattern, sum(failed) fa, 1 ne, case when any_value(src) = any_value(dst) then 1 else 2 end nv, any_value(src) s1, any_value(dst) d1, any_value(src) s2, any_value(dst) d2, e e1, cast(null as varchar) e2 from ee group by e having sum(failed) >= 2),
 {_P2}, q2 as (select pattern, fa, 2 ne, len(list_distinct([s1, d1, s2, d2])) nv, s1, d1, s2, d2, e1, e2 from p2),
 q as (select * from q1 union all select * from q2),
 lab as (select distinct pattern, unnest([s1, d1, s2, d2]) label from q), labk as (select pattern, sum(coalesce(k, 0)) k from lab left join vo using (label) group by pattern),
 sc as (select q.pattern, q.ne, q.e1, q.e2, fa, fa::double/nt f, (coalesce(labk.k, 0) + coalesce(x.k, 0) + coalesce(y.k, 0))::double/nt/(ne + nv) o from q join n on true join labk using (pattern) left join edk x on x.e = e1 left join edk y on y.e = e2),
 ss as (select *, f/(f+o) score from sc)"""


@query(f"{_PS} select pattern, cast(fa as bigint) fail_graphs, round(score, 9) + 0.0 score from ss order by ss.score desc, pattern limit 10")
def topk_patterns(spark: SparkSession, d: str) -> DataFrame:
    found = mining.mine(traces.edges(spark, d), traces.labels, "precision", max_edges=2, k=10)
    return found.select(_pattern().alias("pattern"), "fail_graphs", rounded("score").alias("score"))


@query(f"{_PS} select distinct b.pattern, round(b.score, 9) + 0.0 score from ss b join ss a on b.ne = 2 and a.ne = 1 and (a.e1 = b.e1 or a.e1 = b.e2) and b.score > a.score union all select pattern, round(score, 9) + 0.0 from ss where ne = 1")
def improving_patterns(spark: SparkSession, d: str) -> DataFrame:
    found = mining.mine(traces.edges(spark, d), traces.labels, "precision", max_edges=2, improving=True)
    return found.select(_pattern().alias("pattern"), rounded("score").alias("score"))


_PAT = [(ENTRY, "click blk 0"), ("click blk 0", "view blk 0")]
_HOLDS = "h as (select user_id, wk from fl where (src = 'entry' and dst = 'click blk 0') or (src = 'click blk 0' and dst = 'view blk 0') group by 1, 2 having count(*) = 2)"


@query(f"{SQL}, {_HOLDS} select user_id, wk, case when failed = 1 then 'fail' else 'ok' end outcome from tr semi join h using (user_id, wk)")
def pattern_in_traces(spark: SparkSession, d: str) -> DataFrame:
    return by_trace(mining.contains_pattern(traces.edges(spark, d), _PAT, traces.edges(spark, d)))


@query(f"{SQL}, {_HOLDS} select user_id, wk, case when failed = 1 then 'fail' else 'ok' end outcome from tr anti join h using (user_id, wk)")
def pattern_missing_in_traces(spark: SparkSession, d: str) -> DataFrame:
    return by_trace(mining.contains_pattern(traces.edges(spark, d), _PAT, traces.edges(spark, d), missing=True))


@query()
def leap_patterns(spark: SparkSession, d: str) -> DataFrame:
    return mining.leap(traces.edges(spark, d), traces.labels, max_edges=2).select(_pattern().alias("pattern"), "fail_graphs", "ok_graphs", rounded("score").alias("score"))


@query()
def walk_patterns(spark: SparkSession, d: str) -> DataFrame:
    return mining.walks(traces.edges(spark, d), traces.labels, n_walks=10, max_edges=2, seed=3).select("walk", _pattern().alias("pattern"), rounded("score").alias("score"))


# -- clusters


def user_labels(spark: SparkSession, d: str) -> DataFrame:
    e = traces.steps(spark, d).select(F.col("graph_id.user_id").alias("id"), "label", "value")
    return e.groupBy("id").agg(F.collect_set("label").alias("items"), F.avg("value").alias("score"))


_UL = "us as (select user_id id, list_distinct(list(label)) items, avg(value) score from ev group by 1)"
_JP = f"""jp as (select a.id a, b.id b, 1 - len(list_intersect(a.items, b.items))::double / len(list_distinct(list_concat(a.items, b.items))) distance from us a join us b on a.id < b.id),
 jl as (select * from jp where distance <= {EPSILON} + 1e-12)"""
_CC = "cc as (select id, min(other) cluster from re group by id)"
_RE = "re(id, other) as (select id, id from us union select re.id, l.y from re join (select a x, b y from jl union all select b, a from jl) l on l.x = re.other)"
_CLUSTERS = f"with recursive {SQL.strip()[5:]}, {_UL}, {_JP}, {_RE}, {_CC}"


_CL = "cl as (select list_sort(items) items, min(id) head, count(*) n from us group by 1)"


@query(f"{SQL}, {_UL}, {_CL}, {_JP} select a, b, ca.n n_a, cb.n n_b, round(distance, 9) + 0.0 distance from jl join cl ca on ca.head = a join cl cb on cb.head = b")
def label_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All links between different label sets, as pairs of the heads of classes of equal sets with the classes' sizes."""
    every = staged(clustering.classes(user_labels(spark, d)), "classes")
    heads = every.where("id = head")
    sizes = heads.select("head", "n")
    pairs = clustering.similar_pairs(heads.select("id", "items"), EPSILON).select("a", "b", rounded("distance").alias("distance"))
    return pairs.join(sizes.withColumnsRenamed({"head": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"head": "b", "n": "n_b"}), "b")


@query(f"{SQL}, {_UL}, {_CL} select id, head from us join cl on list_sort(us.items) = cl.items")
def label_classes(spark: SparkSession, d: str) -> DataFrame:
    return clustering.similar_classes(user_labels(spark, d), EPSILON)[1]


@query(f"{_CLUSTERS} select id, cluster from cc")
def cluster_components(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cluster(user_labels(spark, d), EPSILON)


def _clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    users = user_labels(spark, d)
    members = users.join(clustering.cluster(users, EPSILON), "id")
    return members, clustering.cluster_scores(members)


@query(f"{_CLUSTERS} select cluster, count(*) n, round(avg(score) * sqrt(count(*)::double / (count(*) + 1)), 6) + 0.0 score from cc join us using (id) group by cluster")
def cluster_score(spark: SparkSession, d: str) -> DataFrame:
    return _clustered(spark, d)[1].select("cluster", "n", rounded("score", 6).alias("score"))


#: Clusters' scores (cs), their labels (cb) and a label's own score (sl) as scores of locations: best clusters first, those within the tolerance of the mean so far.
_LOC = """cs as (select cluster, avg(score) * sqrt(count(*)::double / (count(*) + 1)) s from cc join us using (id) group by cluster),
 cb as (select distinct cluster, unnest(items) label from cc join us using (id)), li as (select label, list(s order by s desc) l from cb join cs using (cluster) group by label),
 fold(label, k, total, n) as (select label, 0, 0.0::double, 0 from li union all
  select label, k + 1, total + case when n = 0 or abs(l[k + 1] - total / n) <= 0.025 then l[k + 1] else 0 end, n + case when n = 0 or abs(l[k + 1] - total / n) <= 0.025 then 1 else 0 end from fold join li using (label) where k < len(l)),
 ls as (select label, sum(failed) fa, sum(1 - failed) oa, any_value(event_type) fn_name, any_value(bbid) bbid from v group by label having sum(failed) > 0),
 fo as (select ls.*, fa::double/nt f, oa::double/nt o, n_ok::double/nt p from ls, n), sl as (select label, round(f/(f+o), 9) + 0.0 score from fo),
 lf as (select fold.label, round(sl.score * (total / n), 6) + 0.0 score from fold join li using (label) join sl using (label) where k = len(l))"""


@query(f"{_CLUSTERS}, {_LOC} select label, score from lf")
def location_scores(spark: SparkSession, d: str) -> DataFrame:
    members, scores = _clustered(spark, d)
    labels = members.select("cluster", F.explode("items").alias("label"))
    return clustering.location_scores(scores, labels, scored_labels(spark, d)).select("label", rounded("score", 6).alias("score"))


@query(f"{_CLUSTERS}, cn as (select cluster, count(*) n from cc group by 1) select cluster, n from cn where n < (select max(n) from cn)")
def exclude_largest_clusters(spark: SparkSession, d: str) -> DataFrame:
    members, scores = _clustered(spark, d)
    largest = scores.join(F.broadcast(scores.agg(F.max("n").alias("most")))).where("n = most")
    return clustering.exclude(scores, members, largest)[0].select("cluster", "n")


_CI = "ci as (select cluster, id, items from cc join us using (id))"
_DIST = "1 - len(list_intersect(a.items, b.items))::double / len(list_distinct(list_concat(a.items, b.items)))"


@query(f"{_CLUSTERS}, {_CI} select a.cluster, round(avg({_DIST}), 9) + 0.0 intra, from ci a join ci b on a.cluster = b.cluster and a.id < b.id group by 1")
def cluster_distances(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cluster_quality(_clustered(spark, d)[0]).where("n > 1").select("cluster", rounded("intra").alias("intra"))


@query(
    f"{_CLUSTERS}, {_CI}, sz as (select cluster, count(*)::double n from ci group by 1), pr as (select a.cluster x, b.cluster y, {_DIST} d, case when a.cluster = b.cluster then 1.0 else 0.0 end c from ci a join ci b on a.id < b.id), mn as (select avg(d) md, avg(c) mc from pr), "
    "it as (select sum(s / n) v from (select x, sum(d) s from pr where x = y group by 1) join sz on cluster = x), ie as (select sum(s / (a.n * b.n)) v from (select least(x, y) x, greatest(x, y) y, sum(d) s from pr where x != y group by 1, 2) join sz a on a.cluster = x join sz b on b.cluster = y) "
    "select round(sum((d - md) * (c - mc)) / (sum((d - md) * (d - md)) * sum((c - mc) * (c - mc))) * 1e3, 6) + 0.0 correlation, round(any_value(it.v), 6) + 0.0 intra, round(any_value(ie.v), 4) + 0.0 inter from pr, mn, it, ie"
)
def cluster_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = clustering.cluster_metrics(_clustered(spark, d)[0])
    return m.select(rounded(F.col("correlation") * 1e3, 6).alias("correlation"), rounded("intra", 6).alias("intra"), rounded("inter", 4).alias("inter"))


# -- localisation end to end


def _mined_patterns(spark: SparkSession, d: str) -> DataFrame:
    return mining.mine(traces.edges(spark, d), traces.labels, "precision", max_edges=2, k=10)


_PJ = f"with recursive {_PS.strip()[5:]}, us as (select pattern id, list(distinct label) items, any_value(score) score from (select * from ss order by score desc, pattern limit 10) join lab using (pattern) group by 1), {_JP.replace(str(EPSILON), '0.5')}, {_RE}, {_CC}"


@query(f"{_PJ} select id as pattern, cluster from cc")
def localize_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The best mined patterns and the clusters that they are in."""
    found = localisation.localize(_mined_patterns(spark, d), scored_labels(spark, d).select("label", "score"), 0.5)
    return found.members.select(F.col("id").alias("pattern"), "cluster")


@query(f"{_PJ}, {_LOC} select label, score from lf")
def localize_locations(spark: SparkSession, d: str) -> DataFrame:
    """Mined patterns, clustered, and the locations ranked by them."""
    found = localisation.localize(_mined_patterns(spark, d), scored_labels(spark, d).select("label", "score"), 0.5)
    return found.locations.select("label", rounded("score", 6).alias("score"))


@query(f"{_PJ}, {_LOC}, lr as (select *, rank() over (order by score desc) - 1 before, count(*) over (partition by score) size from lf) select min(before + size / 2) as rank from lr where label = (select max(label) from lf)")
def localize_rank(spark: SparkSession, d: str) -> DataFrame:
    """What the ranking of locations is worth if the last label by name were faulty."""
    locations = localisation.localize(_mined_patterns(spark, d), scored_labels(spark, d).select("label", "score"), 0.5).locations.withColumn("score", rounded("score", 6))
    return ranking.rank_eval(locations, locations.agg(F.max("label").alias("label")), "label")


_TL = "tl as (select label, score, row_number() over (order by score desc, label) place, lag(score) over (order by score desc, label) - score > 0.0001 dropped from sl), tg as (select *, coalesce(sum(dropped::int) over (order by place rows between unbounded preceding and 1 preceding), 0) drops, greatest(10, floor(0.0625 * count(*) over ())) total from tl)"


@query(f"{_SL}, {_TL} select label, score, place from tg where place <= total or drops < 2")
def walk_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels from which walks start."""
    return mining.top_labels(scored_labels(spark, d))


def fewest_passing(f: Column, o: Column, pf: Column, po: Column) -> Column:
    """A score of one's own: what few passing runs hold."""
    return -o


@query()
def label_walk_patterns(spark: SparkSession, d: str) -> DataFrame:
    ranked = scored_labels(spark, d, fewest_passing)
    found = mining.label_walks(traces.edges(spark, d), traces.labels, ranked, name=fewest_passing, max_edges=2, skip_seen=True, seed=5)
    return found.select(_pattern().alias("pattern"), rounded("score").alias("score"), "label", "place")


@query(ORACLES["topk_patterns"])
def halving_leap_patterns(spark: SparkSession, d: str) -> DataFrame:
    found = mining.halving_leap(traces.edges(spark, d), traces.labels, "precision", max_edges=2, k=10)
    return found.select(_pattern().alias("pattern"), "fail_graphs", rounded("score").alias("score"))


def _run_sql(method: str, score: str) -> str:
    return f"select '{method}' as method, pattern, score, rank() over (order by score desc) - 1 before, dense_rank() over (order by score desc) score_group, row_number() over (order by score desc, pattern) place, count(*) over (partition by score) size from (select pattern, {score} score from sc order by score desc, pattern limit 10)"


_FAULTY = "click blk 0"
_RUNS = f"rn as ({_run_sql('contrast', 'f - o')} union all {_run_sql('precision', 'f/(f+o)')})"
_RH = f"rh as (select method, score_group, before, size, count(*) h from rn where pattern in (select pattern from lab where label = '{_FAULTY}') group by all), rk as (select method, coalesce(min((size + 1) / (h + 1) + before), 'inf'::double) as rank, coalesce(arg_min(score_group, ((size + 1) / (h + 1) + before, score_group)), -1) score_group from (select distinct method from rn) left join rh using (method) group by 1)"


@query(
    f"{_PS}, {_RUNS}, {_RH}, b as (select place, score base from rn where method = 'contrast') select method, count(*) n, round(sum(score), 6) + 0.0 sum, round(avg(score), 6) + 0.0 mean, round(stddev_samp(score), 6) + 0.0 stddev, "
    "round(sqrt(sum((score - base) * (score - base)) / (count(*) - 1)) * case when sum(score - base) > 0 then -1 else 1 end, 6) + 0.0 stderr, any_value(rk.rank) as rank, any_value(rk.score_group) score_group from rn join b using (place) join rk using (method) group by method"
)
def compare_miners(spark: SparkSession, d: str) -> DataFrame:
    """Two miners' patterns compared, with where the first fault is."""
    runs = mining.mine_each(traces.edges(spark, d), traces.labels, ("precision", "contrast"), max_edges=2, k=10)
    found = localisation.compare(runs, spark.range(1).select(F.lit(_FAULTY).alias("label")))
    return found.select("method", "n", *(rounded(c, 6).alias(c) for c in ("sum", "mean", "stddev", "stderr")), "rank", F.col("score_group").cast("long").alias("score_group"))


@query(
    f"{_PS}, {_RUNS}, {_RH}, {_LS}, {_FO}, el as (select label, round(f/(f+o), 9) score from fo), eg as (select *, rank() over (order by score desc) - 1 before, count(*) over (partition by score) size from el) "
    f"select 'cbsfl' as method, 'precision' score, 'Ranked-List' as eval, min(before + size / 2) as rank from eg where label = '{_FAULTY}' union all select 'best', 'precision', 'Ranked-List', rank from rk where method = 'precision'"
)
def evaluate_lists(spark: SparkSession, d: str) -> DataFrame:
    miners = {"best": ("precision", _mined_patterns(spark, d))}
    faults = spark.createDataFrame([(_FAULTY,)], "label string")
    return localisation.evaluate(traces.edges(spark, d), traces.vertices(spark, d), faults, ["precision"], miners, [localisation.LIST], [localisation.LIST])


@query()
def evaluate_chains(spark: SparkSession, d: str) -> DataFrame:
    miners = {"best": ("precision", _mined_patterns(spark, d))}
    faults = spark.createDataFrame([(_FAULTY,)], "label string")
    return localisation.evaluate(traces.edges(spark, d), traces.vertices(spark, d), faults, ["precision"], miners, [localisation.BEHAVIOURAL], [localisation.CHAIN, localisation.BOTH])


# -- embeddings with repeated labels: each event is a vertex with its type as label

_EMB = "em as (select user_id, wk, e1, e2, failed from (select ev.user_id, ev.wk, ev.event_id e1, ev.event_type t1, lead(ev.event_id) over w e2, lead(ev.event_type) over w t2, failed from ev join tr using (user_id, wk) window w as (partition by ev.user_id, ev.wk order by ts, ev.event_id)) where t1 = 'click' and t2 = 'view')"


def _event_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = traces.steps(spark, d)
    w = ranking.Window.partitionBy("graph_id").orderBy("ts", "event_id")
    steps = e.select("graph_id", F.col("event_id").alias("vid"), F.col("fn_name").alias("label"), F.lead("event_id").over(w).alias("dst")).join(traces.outcomes(e), "graph_id")
    steps = steps.withColumn("graph_id", F.concat_ws(" ", F.col("graph_id.user_id").cast("string"), F.date_format("graph_id.wk", "yyyy-MM-dd")))
    return steps.select("outcome", "graph_id", "vid", "label"), steps.where("dst IS NOT NULL").select("outcome", "graph_id", F.col("vid").alias("src"), "dst", F.lit("").alias("label"))


_CLICK_VIEW = (["click", "view"], [(0, 1, "")])


@query(f"{SQL}, {_EMB} select user_id || ' ' || cast(cast(wk as date) as varchar) graph_id, e1, e2 from em")
def event_embeddings(spark: SparkSession, d: str) -> DataFrame:
    found = embeddings.embeddings(_CLICK_VIEW, *_event_graph(spark, d))
    return found.select("graph_id", F.col("m")[0].alias("e1"), F.col("m")[1].alias("e2"))


_CLICK_VIEW_ERROR = (["click", "view", "error"], [(0, 1, ""), (1, 2, "")])


def _starts_sql() -> str:
    weights = {"frequent": "[f0, f1, f2]", "connected": "[1, 2, 1]", "extensions": "[c01, c01 + c12, c12]", "cardinality": "[c01, c01 + c12, c12]"}
    chosen = lambda mode: (weights[mode.split("_")[1]], "list_min" if mode.split("_")[0] in ("least", "fewest", "lowest") else "list_max")
    rows = [f"select '{m}' as mode, cast(list_position({w}, {pick}({w})) - 1 as int) vertex, n embeddings from s" for m in embeddings.STARTS[1:] for w, pick in [chosen(m)]]
    return (
        f"{SQL}, nx as (select event_type a, lead(event_type) over w b, lead(event_type, 2) over w c from ev window w as (partition by user_id, wk order by ts, event_id)), "
        "s as (select count(*) filter (a = 'click') f0, count(*) filter (a = 'view') f1, count(*) filter (a = 'error') f2, count(*) filter (a = 'click' and b = 'view') c01, "
        "count(*) filter (a = 'view' and b = 'error') c12, count(*) filter (a = 'click' and b = 'view' and c = 'error') n from nx) " + " union all ".join(rows)
    )


@query(_starts_sql())
def embedding_starts(spark: SparkSession, d: str) -> DataFrame:
    """The vertex of a pattern that each mode starts at, and the number of embeddings, which is the same from all."""
    v, e = (staged(x, "graph") for x in _event_graph(spark, d))
    return embeddings.starts(_CLICK_VIEW_ERROR, v, e, embeddings.STARTS[1:])  # all but the random one


_WALKS = f"""with recursive {SQL.strip()[5:]}, gv as (select user_id, wk, label l from v union select user_id, wk, 'entry' from tr), sz as (select user_id, wk, count(*) n from gv group by all),
 rc(user_id, wk, x, y, d) as (select user_id, wk, src, dst, 1 from fl join sz using (user_id, wk) where n >= 2 union select rc.user_id, rc.wk, x, dst, d + 1 from rc join fl on fl.user_id = rc.user_id and fl.wk = rc.wk and src = y
   join sz on sz.user_id = rc.user_id and sz.wk = rc.wk where 2 * (d + 1) <= n),
 sd as (select user_id, wk, x, y, min(d) d from rc group by all union all select user_id, wk, l, l, 0 from gv),
 bg as (select user_id, wk, l x, l l1, 0 h1 from gv union all select user_id, wk, dst, '', 1 from fl), fi as (select user_id, wk, l y, l l2, 0 h2 from gv union all select user_id, wk, src, '', 1 from fl),
 wm as (select user_id, wk, l1, l2, count(*) w from sd join bg using (user_id, wk, x) join fi using (user_id, wk, y) join sz using (user_id, wk)
   where case when h1 + h2 = 0 then d > 0 else x != y or d = 0 end and 2 * d + h1 + h2 <= n group by all),
 pr as (select a.user_id, a.wk wa, b.wk wb from tr a join tr b on a.user_id = b.user_id and b.wk = a.wk + interval 7 days),
 df as (select user_id, wa, wb, l1, l2, sum(w) w from (select user_id, wa, wb, l1, l2, w from pr join wm using (user_id) where wm.wk = wa union all select user_id, wa, wb, l1, l2, -w from pr join wm using (user_id) where wm.wk = wb) group by all),
 nl as (select user_id, wa, wb, count(distinct l) + 1 n from pr join gv using (user_id) where gv.wk in (wa, wb) group by all)
 select user_id || ' ' || cast(cast(wa as date) as varchar) a, user_id || ' ' || cast(cast(wb as date) as varchar) b, round(sqrt(sqrt(sum(pow(w, 4))) / (n * n)), 9) + 0.0 distance from df join nl using (user_id, wa, wb) group by user_id, wa, wb, n"""


@query(_WALKS)
def walk_distances(spark: SparkSession, d: str) -> DataFrame:
    """How far a user's flow graph of a week is from the next week's, by the labels that walks join."""
    name = lambda user, week: F.concat_ws(" ", user.cast("string"), F.date_format(week, "yyyy-MM-dd"))
    user, week = F.col("graph_id.user_id"), F.col("graph_id.wk")
    e = staged(traces.edges(spark, d), "flow")
    seen = e.select("graph_id").distinct()
    vertices = e.select("graph_id", F.col("dst").alias("label")).distinct().unionByName(seen.withColumn("label", F.lit(ENTRY)))
    weeks = seen.select(user.alias("user"), week.alias("wk"))
    pairs = weeks.join(weeks.select("user", (F.col("wk") - F.expr("interval 7 days")).alias("wk"), F.col("wk").alias("next")), ["user", "wk"])
    asked = pairs.select(name(F.col("user"), F.col("wk")).alias("a"), name(F.col("user"), F.col("next")).alias("b"))
    found = walk_similarity.matrix_distances(asked, vertices.select(name(user, week).alias("graph_id"), F.col("label").alias("vid"), "label"), e.select(name(user, week).alias("graph_id"), "src", "dst", F.lit("").alias("label")))
    return found.withColumn("distance", rounded("distance"))


@query(f"{SQL}, {_EMB} select case when failed = 1 then 'fail' else 'ok' end outcome, least(count(distinct e1), count(distinct e2)) support from em group by 1")
def event_image_support(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.image_support(embeddings.embeddings(_CLICK_VIEW, *_event_graph(spark, d)))


@query(f"{SQL}, {_EMB} select case when failed = 1 then 'fail' else 'ok' end outcome, count(*) support from em group by 1")
def event_independent_support(spark: SparkSession, d: str) -> DataFrame:
    """No two of these embeddings share a vertex, as a click is followed by one event only."""
    return embeddings.independent_support(embeddings.embeddings(_CLICK_VIEW, *_event_graph(spark, d))).withColumn("support", F.col("support").cast("long"))


_PATHS = """st as (select ev.user_id, ev.wk, failed, ts, event_id e1, event_type t1, lead(event_id) over w e2, lead(event_type) over w t2, lead(event_id, 2) over w e3, lead(event_type, 2) over w t3
   from ev join tr using (user_id, wk) window w as (partition by ev.user_id, ev.wk order by ts, event_id)),
 lb as (select t1, count(*) n from st where failed = 0 group by 1), ed as (select t1, t2, count(*) n from st where failed = 0 and t2 is not null group by 1, 2),
 p1 as (select t1, t2, least(count(distinct e1), count(distinct e2)) s from st where failed = 1 and t2 is not null group by 1, 2),
 p2 as (select t1, t2, t3, least(count(distinct e1), count(distinct e2), count(distinct e3)) s from st where failed = 1 and t3 is not null group by 1, 2, 3),
 l as (select t1 t, n from lb), pt as (
  select t1 || ' -> ' || t2 as path, 1 n_edges, s, (select coalesce(sum(n), 0) from l where t = p1.t1) + (select coalesce(sum(n), 0) from l where t = p1.t2) + (select coalesce(sum(n), 0) from ed where ed.t1 = p1.t1 and ed.t2 = p1.t2) o, 3 size from p1
  union all
  select t1 || ' -> ' || t2 || ' -> ' || t3, 2, s, (select coalesce(sum(n), 0) from l where t = p2.t1) + (select coalesce(sum(n), 0) from l where t = p2.t2) + (select coalesce(sum(n), 0) from l where t = p2.t3)
   + (select coalesce(sum(n), 0) from ed where ed.t1 = p2.t1 and ed.t2 = p2.t2) + (select coalesce(sum(n), 0) from ed where ed.t1 = p2.t2 and ed.t2 = p2.t3), 5 from p2 where exists (select 1 from p1 where p1.t1 = p2.t1 and p1.t2 = p2.t2 and p1.s >= 3) or exists (select 1 from p1 where p1.t1 = p2.t2 and p1.t2 = p2.t3 and p1.s >= 3))"""


@query(f"{SQL}, {_PATHS} select path, n_edges, s support, round((s / nt::double) / (s / nt::double + o / nt::double / size), 9) + 0.0 score from pt, n where s >= 3")
def repeated_label_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of the event types that follow each other, which repeat in a trace, by image support: a trace is a chain, so patterns are paths."""
    vertices, edges = _event_graph(spark, d)
    found = lattice.mine(vertices, edges, "precision", max_edges=2, min_support=3, kind="image")
    name = lambda k: F.get(F.col("v"), k)
    one, two = F.get(F.col("e"), F.lit(0)), F.get(F.col("e"), F.lit(1))
    step = lambda x, y: F.concat_ws(" -> ", name(x["s"]), name(x["t"]), name(y["t"]))
    path = F.when(two.isNull(), F.concat_ws(" -> ", name(one["s"]), name(one["t"]))).when(one["t"] == two["s"], step(one, two)).otherwise(step(two, one))
    return found.select(path.alias("path"), F.size("e").alias("n_edges"), "support", rounded("score").alias("score"))


# -- evaluation


def _faults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("error", 3)], "fn_name string, bbid int")


_HIT = "hit as (select *, fn_name = 'error' and bbid = 3 faulty from gr)"


@query(f"{_SL}, {_GR}, {_HIT} select min(before + size / 2) as rank from hit where faulty")
def rank_eval(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_eval(scored_labels(spark, d), _faults(spark), "fn_name", "bbid")


@query(f"{_SL}, {_GR}, {_HIT}, hg as (select score_group, before, size, count_if(faulty) h from hit group by all having count_if(faulty) > 0) select min((size + 1) / (h + 1) + before) as rank, arg_min(score_group, (size + 1) / (h + 1) + before) score_group from hg")
def hit_rank_eval(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hit_rank_eval(scored_labels(spark, d), _faults(spark), "fn_name", "bbid").select("rank", F.col("score_group").cast("long").alias("score_group"))


def _ranks(names: tuple[str, ...]) -> str:
    parts = " union all ".join(f"select '{n}' as method, round({_SCORE_SQL[n]}, 9) + 0.0 score, label from fo" for n in names)
    return f"{SQL}, {_LS}, {_FO}, al as ({parts})"


_COMPARED = ("precision", "ochiai", "relative_f1")


@query(f"{_ranks(_COMPARED)}, x as (select *, rank() over (partition by method order by score desc) - 1 + count(*) over (partition by method, score) / 2 as r from al) select 'labels' case_id, '' as method, 'mid-rank' as eval, avg(r) as rank, round(avg(score), 9) + 0.0 score from x where label = 'error blk 3'")
def rank_average(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for name in _COMPARED:
        r = ranking.with_groups(scored_labels(spark, d, name)).where("label = 'error blk 3'").select(F.lit("labels").alias("case_id"), F.lit(name).alias("method"), F.lit("mid-rank").alias("eval"), F.col("mid_rank").alias("rank"), "score")
        rows = r if rows is None else rows.unionByName(r)
    return ranking.average_results(rows).withColumn("score", rounded("score"))


@query(
    f"{_ranks(_COMPARED)}, x as (select *, row_number() over (partition by method order by score desc, label) place from al), b as (select place, score base from x where method = 'ochiai') "
    "select method, count(*) n, round(sum(score), 6) + 0.0 sum, round(avg(score), 6) + 0.0 mean, round(stddev_samp(score), 6) + 0.0 stddev, round(sqrt(sum((score - base) * (score - base)) / case when count(*) > 2 then count(*) - 1 else count(*) end) * case when sum(score - base) > 0 then -1 else 1 end, 6) + 0.0 stderr from x join b using (place) group by method"
)
def compare_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for name in _COMPARED:
        r = ranking.with_place(scored_labels(spark, d, name), "label").select(F.lit(name).alias("method"), "place", "score")
        rows = r if rows is None else rows.unionByName(r)
    return ranking.compare_stats(rows).select("method", "n", *(rounded(c, 6).alias(c) for c in ("sum", "mean", "stddev", "stderr")))


# -- chains and hitting times

_CH0 = """gg as (select distinct score_group k, size from gr), gb as (select max(k)::double b from gg),
 c0 as (select 'g' || (score_group - 1) src, label dst, 0.5 / size p, 0 rule from gr
  union all select label, 'g' || (score_group - 1), 1.0 - {j}, 1 from gr
  union all select 'g' || (k - 1), 'g' || (k - 2), 0.5 * (b - 1) / b, 3 from gg, gb where k > 1
  union all select 'g' || (k - 1), 'g' || k, 0.5 / b, 4 from gg, gb where k < b
  union all select 'g0', 'g0', 0.5 * (b - 1) / b, 5 from gb
  union all select 'g' || cast(b - 1 as int), 'g' || cast(b - 1 as int), 0.5 / b + case when b = 1 then 0.5 * (b - 1) / b else 0 end, 6 from gb {more})"""
_CH = "select src, dst, round(arg_max(p, rule), 9) + 0.0 p from c0 group by src, dst"


def _chain(spark: SparkSession, d: str, jumps: DataFrame | None = None) -> DataFrame:
    return markov.ranked_chain(scored_labels(spark, d), 0.5 if jumps is not None else 0.0, jumps)


@query(f"{_SL}, {_GR}, {_CH0.format(j='0.0', more='')} {_CH}")
def chain_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d).withColumn("p", rounded("p"))


_JK = "jk as (select distinct src, dst from {0} where src in (select label from gr) and dst in (select label from gr))"
_JMORE = "union all select src, dst, 0.5 / count(*) over (partition by src), 2 from jk"


@query(f"{_SL}, {_GR}, {_ED}, {_JB}, {_JK.format('jb')}, {_CH0.format(j='0.5', more=_JMORE)} {_CH}")
def chain_behavioural(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d, markov.behavioural_jumps(traces.edges(spark, d))).withColumn("p", rounded("p"))


@query(f"{_SL}, {_GR}, {_LO}, {_JS}, {_JK.format('js')}, {_CH0.format(j='0.5', more=_JMORE)} {_CH}")
def chain_spatial(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d, markov.spatial_jumps(traces.vertices(spark, d))).withColumn("p", rounded("p"))


@query(
    f"{_SL}, {_GR}, {_ED}, {_JB}, {_JK.format('jb')}, ko as (select src, count(*) k from jk group by src) select 'start' src, label dst, round(1.0 / count(*) over (), 9) + 0.0 p from gr "
    "union all select label, 'start', case when k is null then 1.0 else 0.01 end from gr left join ko on ko.src = label union all select jk.src, jk.dst, round(0.99 / k, 9) + 0.0 from jk join ko using (src)"
)
def chain_control(spark: SparkSession, d: str) -> DataFrame:
    return markov.control_chain(scored_labels(spark, d), markov.behavioural_jumps(traces.edges(spark, d))).withColumn("p", rounded("p"))


@query()
def chain_patterns(spark: SparkSession, d: str) -> DataFrame:
    found = mining.mine(traces.edges(spark, d), traces.labels, "precision", max_edges=2, k=10).select(_pattern().alias("pattern"), "labels", rounded("score").alias("score"))
    return markov.pattern_chain(found, found.select("pattern", F.explode("labels").alias("label"))).withColumn("p", rounded("p"))


@query()
def hitting_times_exact(spark: SparkSession, d: str) -> DataFrame:
    return markov.hitting_times(_chain(spark, d)).withColumn("hitting_time", rounded("hitting_time", 6))


@query()
def hitting_times_sampled(spark: SparkSession, d: str) -> DataFrame:
    return markov.sampled_hitting_times(_chain(spark, d), seed=1)


@query()
def hitting_time_rank(spark: SparkSession, d: str) -> DataFrame:
    return markov.hitting_rank(markov.any_hitting_times(_chain(spark, d)), spark.createDataFrame([("error blk 3",)], "label string"))


@query(f"with recursive {SQL.strip()[5:]}, {_ED}, rr(label) as (select 'entry' union select dst from rr join ed on ed.src = rr.label) select label from rr")
def reachable_labels(spark: SparkSession, d: str) -> DataFrame:
    return markov.reachable(traces.edges(spark, d), ENTRY)


# -- vectors and object values

_MEDOIDS = 5


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _first_medoids(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where(F.col("id") < _MEDOIDS).select(F.col("id").cast("int").alias("medoid"), "v")


_AS = f"""with di as (select e.vec_id id, m.vec_id medoid, list_sum(list_transform(list_zip(e.embedding, m.embedding), lambda x: abs(x[1]::double - x[2]::double))) distance from embeddings e, embeddings m where m.vec_id < {_MEDOIDS}),
 am as (select id, cast(arg_min(medoid, (distance, medoid)) as int) medoid, min(distance) distance from di group by id)"""


@query(f"{_AS} select id, medoid, round(distance, 6) + 0.0 distance from am")
def assign_to_medoids(spark: SparkSession, d: str) -> DataFrame:
    return clustering.assign(_vectors(spark, d), _first_medoids(spark, d)).withColumn("distance", rounded("distance", 6))


@query(f"{_AS} select medoid, count(*) n, round(sum(distance), 4) + 0.0 as cost from am group by medoid")
def cluster_cost(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cost(clustering.assign(_vectors(spark, d), _first_medoids(spark, d))).withColumn("cost", rounded("cost", 4))


@query()
def k_medoids(spark: SparkSession, d: str) -> DataFrame:
    return clustering.k_medoids(_vectors(spark, d), _MEDOIDS).withColumn("distance", rounded("distance", 6))


def _individuals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as individuals: the priority as function, a bin by customer, the price as covariate, the status as outcome."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("func_name"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).cast("int").alias("bin"), F.col("o_totalprice").alias("covariate"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("outcome"))


_IN = "with ind as (select o_orderpriority func_name, o_orderkey id, cast(o_custkey % 4 as int) bin, o_totalprice covariate, case when o_orderstatus = 'F' then 1.0 else 0.0 end outcome from orders)"
_NC = "nc as (select a.func_name, a.id, a.bin, b.bin other_bin, min(abs(a.covariate - b.covariate)) distance, arg_min(b.id, (abs(a.covariate - b.covariate), b.id)) other_id from ind a join ind b on a.func_name = b.func_name and a.bin != b.bin group by 1, 2, 3, 4)"


@query(f"{_IN}, {_NC} select func_name, id, bin, other_bin, other_id, round(distance, 6) + 0.0 distance from nc")
def nearest_covariate(spark: SparkSession, d: str) -> DataFrame:
    return objects.nearest_covariate(_individuals(spark, d)).withColumn("distance", rounded("distance", 6))


_PE = """na as (select a.func_name, a.id, b.bin, arg_min(b.outcome, (abs(a.covariate - b.covariate), b.id)) y from ind a join ind b on a.func_name = b.func_name group by 1, 2, 3),
 pe as (select p.func_name, p.bin, q.bin other_bin, avg(p.y - q.y) effect from na p join na q on p.func_name = q.func_name and p.id = q.id and p.bin != q.bin group by 1, 2, 3)"""


@query(f"{_IN}, {_PE} select func_name, bin, other_bin, round(effect, 9) + 0.0 effect from pe")
def pair_effects(spark: SparkSession, d: str) -> DataFrame:
    return objects.pair_effects(_individuals(spark, d)).withColumn("effect", rounded("effect"))


@query(f"{_IN}, {_PE}, s as (select func_name, sum(effect) e from pe where bin < other_bin group by 1) select func_name, round(abs(e / b), 9) + 0.0 score from s join (select func_name, count(distinct bin) b from ind group by 1) using (func_name)")
def suspiciousness(spark: SparkSession, d: str) -> DataFrame:
    return objects.suspiciousness(_individuals(spark, d)).withColumn("score", rounded("score"))


@query("select c_custkey, round(abs(c_custkey - c_nationkey)::double / 18446744073709551616 * 1e15, 9) + 0.0 d from customer")
def dissimilar_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", rounded(objects.int_dissimilar(F.col("c_custkey"), F.col("c_nationkey")) * 1e15).alias("d"))


@query("select c_custkey, case when (c_acctbal > 0) != (c_nationkey > 10) then 1.0 else 0.0 end::double d from customer")
def dissimilar_bool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", objects.bool_dissimilar(F.col("c_acctbal") > 0, F.col("c_nationkey") > 10).alias("d"))


@query("select p_partkey, round((list_sum(list_transform(range(1, least(len(p_name), len(p_type)) + 1), lambda k: case when p_name[k] != p_type[k] then 1 else 0 end)) + abs(len(p_name) - len(p_type)))::double / greatest(len(p_name), len(p_type)), 9) + 0.0 d from part")
def dissimilar_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rounded(objects.string_dissimilar(F.col("p_name"), F.col("p_type"))).alias("d"))


@query("select event_id, case when cast(json_extract(props, '$.k') as bigint) = 0 then 0.0 else round((abs(cast(json_extract(props, '$.k') as bigint))::double / 18446744073709551616 + 1.0) / 2 , 9) + 0.0 end::double d from events")
def dissimilar_struct(spark: SparkSession, d: str) -> DataFrame:
    """The struct of an event's k and whether it is zero, against that of zero."""
    e = table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
    param = lambda name, val: F.struct(F.lit(name).alias("Name"), val.alias("Val"))
    value = lambda v, kind: F.to_json(F.struct(v.alias("Val"), F.lit(kind).alias("JSONType")))
    mine = F.array(param("k", value(F.col("k"), "IntValue")), param("zero", value(F.col("k") == 0, "BoolValue")))
    zero = F.array(param("k", F.lit('{"Val":0,"JSONType":"IntValue"}')), param("zero", F.lit('{"Val":true,"JSONType":"BoolValue"}')))
    return e.select("event_id", rounded(objects.profile_dissimilar(mine, zero)).alias("d"))


@query("select conv_id func_name, array_to_string(list(text order by turn) filter (where role = 'user'), chr(10)) inputs, count_if(role = 'user') n_inputs, count_if(role != 'user') n_outputs from conversations group by conv_id having count_if(role = 'user') > 0")
def collate_profiles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    side = lambda ok: F.when(ok, F.array("text")).otherwise(F.array().cast("array<string>"))
    rows = c.select(F.col("conv_id").alias("func_name"), F.col("turn").alias("seq"), side(F.col("role") == "user").alias("inputs"), side(F.col("role") != "user").alias("outputs"))
    out = objects.collate(rows)
    return out.where(F.size("inputs") > 0).select("func_name", F.array_join("inputs", "\n").alias("inputs"), F.size("inputs").cast("long").alias("n_inputs"), F.size("outputs").cast("long").alias("n_outputs"))


def _int_value(x: Column) -> Column:
    """An integer spread over the range of its kind, so that its differences count beside other parameters."""
    return F.to_json(F.struct((x.cast("decimal(20,0)") * F.lit(1 << 57).cast("decimal(20,0)")).cast("decimal(20,0)").alias("Val"), F.lit("IntValue").alias("JSONType")))


def _value(x: Column, kind: str) -> Column:
    return F.to_json(F.struct(x.alias("Val"), F.lit(kind).alias("JSONType")))


def _object(**values: Column) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("Name"), F.parse_json(v).alias("Val")) for name, v in values.items()))


def _part_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as individuals of their brand: size and type go in, a bin comes out."""
    p = table(spark, d, "part")
    profile = F.to_json(_object(size=_int_value(F.col("p_size")), kind=_value(F.col("p_type"), "StringValue")))
    return p.select(F.col("p_brand").alias("func_name"), F.col("p_partkey").alias("id"), profile.alias("covariate"), (F.col("p_partkey") % 4).cast("int").alias("bin"), "p_size", "p_type")


@query(
    """with p as (select p_brand f, p_size s, p_type t, p_partkey % 4 b, min(p_partkey) id from part group by all), q as (select distinct f, s, t from p),
 m as (select q.f, q.s, q.t, p.b, p.id, (abs(q.s - p.s)::double / 128 + (len(list_filter(range(1, least(len(q.t), len(p.t)) + 1), lambda k: q.t[k] != p.t[k])) + abs(len(q.t) - len(p.t)))::double / greatest(len(q.t), len(p.t))) / 2 d from q join p using (f))
 select f func_name, s size, t kind, cast(b as int) bin, round(min(d), 9) + 0.0 distance, arg_min(id, (d, id)) id from m group by 1, 2, 3, 4"""
)
def nearest_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The part of the same brand and of each bin whose nested profile is nearest, by pivots and the triangle inequality."""
    people = _part_profiles(spark, d)
    found = causal.matched(people).join(people.select("func_name", "covariate", "p_size", "p_type").distinct(), ["func_name", "covariate"])
    return found.select("func_name", F.col("p_size").alias("size"), F.col("p_type").alias("kind"), "bin", rounded("distance").alias("distance"), "id")


@query()
def profile_medoids(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's part profiles in clusters around medoids of a metric without coordinates."""
    values = _part_profiles(spark, d).groupBy(F.col("func_name").alias("g"), F.col("covariate").alias("v"), "p_size", "p_type").agg(F.count("*").alias("w"), F.min("id").alias("first"))
    found = metric.k_medoids(values, 3, causal.decode, causal.profile_distance)
    return found.join(values.select("g", "v", "p_size", "p_type"), ["g", "v"]).select(F.col("g").alias("func_name"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"), "medoid", rounded("distance").alias("distance"))


def _event_profiles(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Events as calls of their type in their user's week, written as two sets of profile files and read back: k goes in, the value's tens and whether
    there are over ten of them come out."""
    e = table(spark, d, "events")
    e = e.withColumns({"graph_id": F.struct("user_id", F.date_trunc("week", "ts").alias("wk")), "tens": F.floor(F.col("value") / 10)})
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    calls = e.select("graph_id", "event_type", "event_id", _object(k=_int_value(k)).alias("i"), _object(tens=_int_value(F.col("tens")), many=_value(F.col("tens") > 10, "BoolValue")).alias("o"))
    listed = calls.groupBy("graph_id", F.col("event_type").alias("func_name")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.to_json("i").alias("i"), F.to_json("o").alias("o")))).alias("c"))  # the calls of one trace
    back = lambda side: F.transform("c", lambda x: F.from_json(x[side], "array<struct<Name string, Val variant>>"))
    rows = listed.select("graph_id", "func_name", back("i").alias("inputs"), back("o").alias("outputs")).join(traces.outcomes(e), "graph_id")
    found = {}
    for outcome in ("ok", "fail"):
        path = new_path(spark, f"profiles-{outcome}")
        profiles.write(rows.where(F.col("outcome") == outcome), path)
        found[outcome] = profiles.read(spark, path)
    return found


@query()
def causal_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions by the causal effect of what they return on whether runs fail, from files of failing and passing profiles."""
    found = _event_profiles(spark, d)
    return causal.localize(found["ok"], found["fail"], 10).withColumn("score", rounded("score"))


# -- inputs and points


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(
    """with l as (select doc_id id, text, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) k from documents where len(text) > 0),
 p as (select id, text, strlen(x) n, coalesce(sum(strlen(x) + 1) over (partition by id order by k rows between unbounded preceding and 1 preceding), 0) i from l),
 r as (select id, cast(i as int) i, cast(least(i + n, strlen(text) - 1) as int) j from p where contains(text, chr(10)) or strlen(text) > 1) select id, case when i = 1 then 0 else i end i, j from r where i <= j"""
)
def mutants_lines(spark: SparkSession, d: str) -> DataFrame:
    return minimise.line_ranges_native(_inputs(spark, d))


_BLOCKS = """with t as (select item_id id, text, strlen(text) n from benchmark where strlen(text) > 0), c as (select id, text, unnest(range(1, len(text) + 1)) k from t),
 nl as (select id, strlen(left(text, k - 1)) p from c where text[k] = chr(10)), a0 as (select id, 0 p from t union select id, p from nl union select id, n - 1 from t),
 a as (select id, p, row_number() over (partition by id order by p) k, count(*) over (partition by id) m, (id, p) in (select (id, p) from nl) fed from a0)
 select x.id, cast(case when x.fed then least(x.p + 1, n - 1) else x.p end as int) i, cast(y.p as int) j from a x join a y on x.id = y.id and y.k > x.k and y.k < x.k + least(greatest(15, x.m // 10), 100) join t on t.id = x.id
 where case when x.fed then least(x.p + 1, n - 1) else x.p end + 1 < y.p"""


@query(_BLOCKS)
def mutants_line_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = minimise.ranges(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "line_blocks")
    return found.select("id", "i", "j")


#: Braces with their depth: an unmatched closing one takes the running sum to a new minimum and counts for nothing.
_CURLY = """with c as (select page_id id, html, unnest(range(1, len(html) + 1)) k from pages), b as (select id, k, strlen(left(html, k - 1)) p, case when html[k] = '{' then 1 else -1 end s from c where html[k] in ('{', '}')),
 r as (select *, sum(s) over (partition by id order by k) t from b), m as (select *, least(0, coalesce(min(t) over (partition by id order by k rows between unbounded preceding and 1 preceding), 0)) low from r),
 o as (select id, k, p, t - low depth from m where s = 1), z as (select id, k, p, t - low + 1 depth from m where s = -1 and t >= low)
 select id, cast(i as int) i, cast(p as int) j from (select z.id, z.p, arg_max(o.p, o.k) i from z join o on o.id = z.id and o.depth = z.depth and o.k < z.k group by z.id, z.k, z.p)"""


@query(_CURLY)
def mutants_curly(spark: SparkSession, d: str) -> DataFrame:
    return minimise.ranges(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), "curly")


@query("select p_partkey, p_type, p_size from part where p_type in ('ECONOMY', 'PROMO') and p_brand not in ('Brand#2')")
def filter_points(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_brand")
    return points.allowed(points.of_kinds(p, ["ECONOMY", "PROMO"], "p_type"), ["Brand#2"], column="p_brand").drop("p_brand")


@query()
def sample_points(spark: SparkSession, d: str) -> DataFrame:
    return points.sample(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type"), 20, seed=1)


# -- control-flow graphs: each user's flow graph as a function, blocks numbered by label with the entry first


def user_cfg(spark: SparkSession, d: str) -> DataFrame:
    e = staged(traces.edges(spark, d).select(F.col("graph_id.user_id").cast("string").alias("fn"), "src", "dst").distinct(), "flow")
    labels = e.select("src").unionByName(e.select(F.col("dst").alias("src"))).distinct()
    names = ranking.numbered(labels, F.col("src") != ENTRY, F.col("src"), name="n").select("src", (F.col("n") - 1).cast("int").alias("n"))
    numbered = e.join(names, "src").select("fn", F.col("n").alias("s"), "dst").join(names.withColumnsRenamed({"src": "dst", "n": "d"}), "dst")
    return numbered.select("fn", F.col("s").alias("src"), F.col("d").alias("dst"))


def _dominators_sql(back: bool) -> str:
    """sd: fn, b, d (d strictly dominates b), by removal: b can't be reached from the root without d.  dm adds b itself, id the nearest one.
    Backwards, the root is -1, an exit behind all blocks that lead nowhere."""
    edges = "select fn, dst s, src t from cg union select fn, -1, bb from bk where (fn, bb) not in (select (fn, src) from cg)" if back else "select fn, src s, dst t from cg"
    root = -1 if back else 0
    return f"""with recursive {SQL.strip()[5:]}, ce as (select distinct cast(user_id as varchar) fn, src, dst from fl), cn as (select label, row_number() over (order by label != 'entry', label) - 1 k from (select src as label from ce union select dst from ce)),
 cg as (select fn, cast(a.k as int) src, cast(b.k as int) dst from ce join cn a on a.label = ce.src join cn b on b.label = ce.dst), bk as (select fn, src bb from cg union select fn, dst from cg union select fn, 0 from cg), g as ({edges}),
 rt(fn, gone, b) as (select fn, gone, {root} from (select fn, bb gone from bk where bb != {root} union select distinct fn, -2 from bk) union select rt.fn, gone, t from rt join g on g.fn = rt.fn and g.s = rt.b where t != gone),
 rb as (select fn, b from rt where gone = -2),
 sd as (select rb.fn, rb.b, x.b d from rb join rb x on x.fn = rb.fn and x.b != rb.b where x.b = {root} or (rb.fn, x.b, rb.b) not in (select (fn, gone, b) from rt)),
 dm as (select fn, b, d from sd union all select fn, b, b from rb), dc as (select fn, b, count(*) n from dm group by 1, 2),
 id as (select sd.fn, sd.b, arg_max(sd.d, dc.n) i from sd join dc on dc.fn = sd.fn and dc.b = sd.d group by 1, 2),
 df as (select distinct dm.fn, dm.d b, g.t f from g join dm on dm.fn = g.fn and dm.b = g.s where (g.fn, g.t) in (select (fn, b) from rb) and (dm.fn, g.t, dm.d) not in (select (fn, b, d) from sd))"""


@query(f"{_dominators_sql(False)} select fn, b bbid, i idom from id union all select distinct fn, 0, 0 from bk")
def dominators(spark: SparkSession, d: str) -> DataFrame:
    return cfg.dominators(user_cfg(spark, d))


@query(f"{_dominators_sql(True)} select fn, b bbid, case when i = -1 then b else i end ipdom from id")
def post_dominators(spark: SparkSession, d: str) -> DataFrame:
    return cfg.post_dominators(user_cfg(spark, d))


@query(f"{_dominators_sql(False)} select fn, b bbid, f frontier from df")
def dominance_frontier(spark: SparkSession, d: str) -> DataFrame:
    return cfg.dominance_frontier(user_cfg(spark, d))


@query(f"{_dominators_sql(True)}, cd as (select fn, b, f from df where b != -1 and f != -1) select fn, b bbid, f controller from cd union all select fn, bb, 0 from bk where bb != 0 and (fn, bb) not in (select (fn, b) from cd)")
def control_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return cfg.control_dependencies(user_cfg(spark, d))


#: Each block defines one of five names; the entry defines none.
_DEFS = f"{_dominators_sql(False)}, ds as (select distinct fn, dst bb, 'x' || cast(dst % 5 as varchar) as name from cg)"


def _named(blocks: DataFrame, number: str) -> DataFrame:
    return blocks.select("fn", "bbid", F.concat(F.lit("x"), F.expr(number).cast("string")).alias("name"))


def _targets(e: DataFrame) -> DataFrame:
    return e.select("fn", F.col("dst").alias("bbid")).distinct()


@query(
    f"{_DEFS}, rd(fn, bbid, name, def_bbid) as (select cg.fn, cg.dst, ds.name, ds.bb from cg join ds on ds.fn = cg.fn and ds.bb = cg.src "
    "union select rd.fn, cg.dst, rd.name, rd.def_bbid from rd join cg on cg.fn = rd.fn and cg.src = rd.bbid where (rd.fn, rd.bbid, rd.name) not in (select (fn, bb, name) from ds)) select fn, bbid, name, def_bbid from rd"
)
def reaching_definitions(spark: SparkSession, d: str) -> DataFrame:
    e = staged(user_cfg(spark, d), "cfg")
    return dataflow.reaching_definitions(e, _named(_targets(e), "bbid % 5"))


@query(
    f"{_DEFS}, us as (select distinct fn, dst bb, 'x' || cast((dst * 3 + 1) % 5 as varchar) as name from cg), lv(fn, bbid, name) as (select cg.fn, cg.src, us.name from cg join us on us.fn = cg.fn and us.bb = cg.dst "
    "union select lv.fn, cg.src, lv.name from lv join cg on cg.fn = lv.fn and cg.dst = lv.bbid where (lv.fn, lv.bbid, lv.name) not in (select (fn, bb, name) from ds)) select fn, bbid, name from lv"
)
def live_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that each user's flow graph may yet use behind a block."""
    e = staged(user_cfg(spark, d), "cfg")
    return dataflow.live_names(e, _named(_targets(e), "(bbid * 3 + 1) % 5"), _named(_targets(e), "bbid % 5"))


@query(
    f"{_DEFS}, av(fn, name, bbid) as (select distinct fn, name, 0 from ds union select av.fn, av.name, cg.dst from av join cg on cg.fn = av.fn and cg.src = av.bbid where (av.fn, av.bbid, av.name) not in (select (fn, bb, name) from ds)) "
    "select b.fn, b.bb bbid, n.name from (select distinct fn, dst bb from cg) b join (select distinct fn, name from ds) n using (fn) where (b.fn, n.name, b.bb) not in (select (fn, name, bbid) from av)"
)
def assigned_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that every way to a block of each user's flow graph has defined."""
    e = staged(user_cfg(spark, d), "cfg")
    return dataflow.assigned_names(e, _named(_targets(e), "bbid % 5"))


@query(
    f"{_DEFS}, df2 as (select * from ds where bb % 2 = 0), cp as (select fn, bb, name, 'x' || cast((bb + 2) % 5 as varchar) src from ds where bb % 2 = 1), vo(fn, bbid, name, def_bbid) as (select cg.fn, cg.dst, df2.name, df2.bb from cg join df2 on df2.fn = cg.fn and df2.bb = cg.src "
    "union select vo.fn, cg.dst, case when k.keep then vo.name else cp.name end, vo.def_bbid from vo join cg on cg.fn = vo.fn and cg.src = vo.bbid cross join (select unnest([true, false]) as keep) k left join cp on cp.fn = vo.fn and cp.bb = vo.bbid and cp.src = vo.name "
    "where case when k.keep then (vo.fn, vo.bbid, vo.name) not in (select (fn, bb, name) from ds) else cp.name is not null end) select fn, bbid, name, def_bbid from vo"
)
def value_origins(spark: SparkSession, d: str) -> DataFrame:
    """Even blocks define a name afresh, odd ones copy another name: where a name's value may come from."""
    e = staged(user_cfg(spark, d), "cfg")
    blocks = _targets(e)
    copies = _named(blocks.where("bbid % 2 = 1"), "bbid % 5").withColumn("source", F.concat(F.lit("x"), ((F.col("bbid") + 2) % 5).cast("string")))
    return dataflow.value_origins(e, _named(blocks.where("bbid % 2 = 0"), "bbid % 5"), copies)


# -- files and streams


@query(ORACLES["trace_edges"].replace("select user_id, wk, src, dst, traversed,", "select cast(user_id as varchar) || ' ' || cast(cast(wk as date) as varchar) graph, src, dst, traversed,"))
def simple_profiles_reread(spark: SparkSession, d: str) -> DataFrame:
    """The traces written in the simple text format, a file a trace's outcome, and read back."""
    name = F.concat(F.col("graph_id.user_id").cast("string"), F.lit(" "), F.date_format("graph_id.wk", "yyyy-MM-dd"))
    v = traces.vertices(spark, d).withColumn("graph_id", name)
    e = traces.edges(spark, d).withColumn("graph_id", name)
    entry = e.select("graph_id", "outcome").distinct().select("outcome", "graph_id", F.lit(ENTRY).alias("label"), F.lit(ENTRY).alias("fn_name"), F.lit(0).alias("bbid"))
    # the graph's name travels as the position of its entry
    v = v.select("outcome", "graph_id", "label", "fn_name", "bbid").unionByName(entry).withColumns({"position": F.col("graph_id"), "duration": F.lit("0s")})
    paths = {}
    for outcome in ("fail", "ok"):
        paths[outcome] = new_path(spark, f"profiles-{outcome}")
        simple.write(v.where(F.col("outcome") == outcome), e.where(F.col("outcome") == outcome), paths[outcome])
    vertices, edges = simple.read_both(spark, paths["fail"], paths["ok"])
    names = vertices.where(F.col("label") == ENTRY).select("outcome", "graph_id", F.col("position").alias("graph"))
    return edges.join(names, ["outcome", "graph_id"]).select("graph", "src", "dst", "traversed", "outcome")


@query(f"{SQL} select user_id || ' ' || cast(cast(wk as date) as varchar) trace, src, dst, cast(sum(traversed) as bigint) traversed from fl group by 1, 2, 3")
def stream_flow_edges(spark: SparkSession, d: str) -> DataFrame:
    """The flow edges of the event stream, each micro-batch appended to the shared folder."""
    static = table(spark, d, "events")
    stream = spark.readStream.schema(static.schema).parquet(f"{d}/events.parquet*")
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    label = F.concat("event_type", F.lit(" blk "), (F.floor(F.col("value") / 10) % 4).cast("int").cast("string"))
    events = stream.select(F.concat(F.col("user_id").cast("string"), F.lit(" "), week).alias("trace"), "ts", "event_id", label.alias("label"))
    out, marks = new_path(spark, "flows"), new_path(spark, "flows-checkpoint")
    stepped = flows.flow_edges(events)
    run = stepped.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", marks).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("trace string, src string, dst string, traversed long, batch int").parquet(out).groupBy("trace", "src", "dst").agg(F.sum("traversed").alias("traversed"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time with a zone


def _streamed(rows: DataFrame, name: str) -> DataFrame:
    """What a stream in append mode emits until its source is exhausted, written to the shared folder."""
    spark = rows.sparkSession
    out, marks = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


#: Events that a watermark six hours behind the latest one, in whole milliseconds, has passed; a trace ends with a pause of over twelve hours.
_PASSED = "epoch_us(ts) <= (select max(epoch_us(ts)) // 1000 * 1000 from events) - 21600000000"


@query(
    f"with e as (select cast(user_id as varchar) trace, ts, event_id, event_type || ' blk ' || cast(floor(value/10) % 4 as int) as label from events where {_PASSED}), "
    "s as (select trace, label dst, lag(label) over w p, epoch_us(ts) - epoch_us(lag(ts) over w) gap from e window w as (partition by trace order by ts, event_id)) "
    "select trace, case when gap <= 43200000000 then p else 'entry' end src, dst, count(*) traversed from s group by 1, 2, 3"
)
def stream_ordered_edges(spark: SparkSession, d: str) -> DataFrame:
    """The flow edges of the event stream in order of the events' times, late ones put in their place; the state of silent users is dropped."""
    label = F.concat("event_type", F.lit(" blk "), (F.floor(F.col("value") / 10) % 4).cast("int").cast("string"))
    events = _event_stream(spark, d).select(F.col("user_id").cast("string").alias("trace"), "ts", "event_id", label.alias("label"))
    found = _streamed(ordered.flow_edges(events, "6 hours", 12 * 3600), "ordered")
    return found.groupBy("trace", "src", "dst").agg(F.sum("traversed").alias("traversed"))


@query(ORACLES["simple_profiles_reread"])
def dot_profiles_reread(spark: SparkSession, d: str) -> DataFrame:
    """The traces written as Graphviz text, a digraph each, and read back."""
    name = F.concat(F.col("graph_id.user_id").cast("string"), F.lit(" "), F.date_format("graph_id.wk", "yyyy-MM-dd"))
    v = traces.vertices(spark, d).withColumn("graph_id", name)
    e = traces.edges(spark, d).withColumn("graph_id", name)
    entry = e.select("graph_id", "outcome").distinct().select("outcome", "graph_id", F.lit(ENTRY).alias("label"), F.lit(ENTRY).alias("fn_name"), F.lit(0).alias("bbid"))
    # the graph's name travels as the position of its vertices
    v = v.select("outcome", "graph_id", "label", "fn_name", "bbid").unionByName(entry).withColumn("position", F.col("graph_id"))
    out = None
    for outcome in ("fail", "ok"):
        path = new_path(spark, f"dot-{outcome}")
        dot.lines(v.where(F.col("outcome") == outcome), e.where(F.col("outcome") == outcome)).select("value").write.text(path)
        vertices, edges = dot.read(spark, path, outcome)
        names = vertices.where(F.col("label") == ENTRY).select("graph_id", F.col("position").alias("graph"))
        found = edges.join(names, "graph_id").select("graph", "src", "dst", F.col("traversed").cast("long").alias("traversed"), "outcome")
        out = found if out is None else out.unionByName(found)
    return out


@query("select user_id exec_id, event_type func_name, count(*) n_inputs, array_to_string(list(cast(event_id as varchar) order by event_id), ',') outputs from events group by 1, 2")
def method_profiles(spark: SparkSession, d: str) -> DataFrame:
    """What a call takes and gives, each event being a call whose id is what it gives."""
    e = table(spark, d, "events").select(F.col("user_id").alias("exec_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("func_name"), F.col("event_id").cast("string").alias("value"))
    captured = e.withColumn("kind", F.lit("input")).unionByName(e.withColumn("kind", F.lit("output")))
    found = flows.method_profiles(captured)
    return found.select("exec_id", "func_name", F.size("inputs").cast("long").alias("n_inputs"), F.array_join("outputs", ",").alias("outputs"))


@query("select distinct user_id exec_id, event_type || ':' || cast(cast(floor(value + 0.5) as int) as varchar) as position, event_type fn_name, 0 bbid from events where value > 150")
def run_failures(spark: SparkSession, d: str) -> DataFrame:
    """The failures that runs report, each position once."""
    e = table(spark, d, "events")
    reported = e.select(F.col("user_id").alias("exec_id"), F.when(F.col("value") > 150, "fail").otherwise("block").alias("kind"), F.concat("event_type", F.lit(":"), F.floor(F.col("value") + 0.5).cast("int").cast("string")).alias("position"), F.col("event_type").alias("fn_name"), F.lit(0).alias("bbid"))
    return flows.failures(reported)
