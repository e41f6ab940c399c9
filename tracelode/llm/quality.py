"""Quality rules as weak supervision, in DataFrame functions only.

Eight rules vote good (1), bad (-1) or abstain (0) on every document.  Expectation-maximisation over the counts
of vote patterns (at most 3 ** 8 rows, whatever the corpus) of the documents that pass the base rule estimates how often each rule votes which way on good
and on bad documents; a document's posterior probability of being good replaces the demand that it passes
every rule.  A bounded sample of labelled documents (``LABELLED``) tells the two classes apart and with that how
accurate each rule is; without labels ``fit`` has to stand in, whose result is that of passing every rule.

Scale: the features are functions of one row, without Python and without a shuffle; one aggregation counts the
patterns.  The features are written once and reread, so texts are split once.

Defined cases: null and empty texts have no words, fail the base rule and are not kept; equal rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, quoted, staged

#: Documents of fewer words fail, as do those of which more than this share (in %) lies in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Posterior probability of being good from which a document is kept.
THRESHOLD = 0.5
#: The most that a good vote adds to the log odds, and the least that a bad vote takes: six good votes outvote a rule
#: whose bad votes say next to nothing.
GOOD_VOTE, BAD_VOTE = 0.2, -1.0
#: A window hash repeated in a text is looked up in a list of at most so many of them, else by sorting.
FEW = 32
#: Labelled documents that estimation uses, about, by a hash of their ids; a Dirichlet count for each outcome.
LABELLED, PRIOR = 4096, 1.0
_SPACE = r"[ \t\n\x0B\f\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, pattern: str) -> Column:
    """Characters that a pattern of a class and + covers."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more in the text, by 64-bit hashes of the windows."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def neighbour(s: Column, i: Column, x: Column) -> Column:
        return F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))

    def sorted_places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, i: neighbour(s, i - 1, x) | neighbour(s, i + 1, x)), lambda x: x["i"]))

    def listed_places(w: Column, known: Column) -> Column:
        return F.filter(F.transform(w, lambda h, i: F.when(F.array_contains(known, h), i)), lambda i: i.isNotNull())

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(F.sort_array(w), lambda s: F.array_distinct(F.filter(s, lambda h, i: F.coalesce(F.get(s, i - 1) == h, F.lit(False)))))
        return let(twice, lambda known: F.when(F.size(known) == 0, F.lit(0))
                   .when(F.size(known) <= FEW, let(listed_places(w, known), covered))
                   .otherwise(let(pairs, lambda s: let(sorted_places(s), covered))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h), count))).cast("long")


def features(text: Column) -> Column:
    """A struct of counts over the whole text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^ \t\x0B\f\r]")))
        return let(split_words(t), lambda w: let(lines, lambda x: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            count_of(t, "[#*$%&|<>]+").alias("n_symbols"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(x).cast("long").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            count_of(t, "[A-Z]+").alias("n_upper"),
            count_of(t, "[.!?。！？]+").alias("n_stops"),
        )))

    return let(text, of)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(f: Column) -> list[Column]:
    """The rules, in order: length, word length, symbols, repeated lines, repeated windows, capitals, sentences, variety."""
    n, chars = f["n_words"], f["word_chars"]
    return [
        _vote(n >= 100, n < MIN_WORDS),
        _vote((chars >= 3 * n) & (chars <= 8 * n), (chars < 2 * n) | (chars > 40 * n)),
        _vote(100 * f["n_symbols"] <= 2 * n, 10 * f["n_symbols"] > n),
        _vote((f["n_dup_lines"] == 0) & (f["n_lines"] > 1), 10 * f["n_dup_lines"] > 4 * f["n_lines"]),
        _vote(100 * f["n_repeat_words"] <= 5 * n, 100 * f["n_repeat_words"] > 30 * n),
        _vote(10 * f["n_upper"] <= chars, 10 * f["n_upper"] > 4 * chars),
        _vote((3 * f["n_stops"] <= n) & (100 * f["n_stops"] >= n), f["n_stops"] == 0),
        _vote(10 * f["n_distinct"] >= 3 * n, (n >= MIN_WORDS) & (10 * f["n_distinct"] < n)),
    ]


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEATED * f["n_words"])


def fit(patterns: list[tuple[list[int], int]], rounds: int = 50, balance: float = 0.5, prior: float = 0.05) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over (votes, count) rows.  Returns the log odds of good before any vote, and for
    each rule what each of its votes adds to them; abstaining adds nothing.

    The balance of good and bad is given, as is usual where it can't be told from votes alone: estimated, it would let
    a corpus of mostly good documents outvote the one rule that a poor document breaks.  For the same reason the
    expectation step assigns each pattern to its likelier class (classification EM; soft shares of the bad class drift
    into the good one where poor documents break one rule each).  Patterns with a bad vote start as bad, ``prior`` is a Dirichlet count for each outcome, and a bad vote takes BAD_VOTE at least while a good vote adds
    between 0 and GOOD_VOTE.
    """
    rules = len(patterns[0][0]) if patterns else 0
    good = [0.0 if -1 in v else 1.0 for v, _ in patterns]
    before, weights = math.log(balance / (1 - balance)), [{-1: BAD_VOTE, 1: 0.0} for _ in range(rules)]
    for _ in range(rounds):
        of_good = sum(g * n for g, (_, n) in zip(good, patterns, strict=True)) + 2 * prior
        of_bad = sum((1 - g) * n for g, (_, n) in zip(good, patterns, strict=True)) + 2 * prior
        weights = []
        for r in range(rules):
            ratio = {}
            for vote in (-1, 1):
                a = sum(g * n for g, (v, n) in zip(good, patterns, strict=True) if v[r] == vote) + prior
                b = sum((1 - g) * n for g, (v, n) in zip(good, patterns, strict=True) if v[r] == vote) + prior
                ratio[vote] = math.log((a / of_good) / (b / of_bad))
            weights.append({-1: min(ratio[-1], BAD_VOTE), 1: min(max(ratio[1], 0.0), GOOD_VOTE)})
        odds = [before + sum(w.get(x, 0.0) for w, x in zip(weights, v, strict=True)) for v, _ in patterns]
        after = [float(o >= 0) for o in odds]
        if after == good:
            break
        good = after
    return before, weights


def fit_labelled(patterns: list[tuple[list[int], int]], labelled: list[tuple[list[int], int, int]], rounds: int = 500) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation with soft shares over (votes, count) rows and (votes, count, 1 if good) rows of both
    classes.  Returns what fit does; abstaining is an outcome like the others and has a weight of its own.

    Labelled rows keep their class.  Together the others weigh no more than the labelled ones, so that a large corpus
    doesn't drown the labels; the balance of classes and each rule's outcomes in each class are estimated from both.
    """
    rules, share = len(labelled[0][0]), min(1.0, sum(n for _, n, _ in labelled) / max(1, sum(n for _, n in patterns)))
    rows = [(v, float(n)) for v, n, _ in labelled] + [(v, n * share) for v, n in patterns]
    known = [float(y) for _, _, y in labelled]

    def estimate(good: list[float], rows: list[tuple[list[int], float]]) -> tuple[float, list[dict[int, float]]]:
        sides = [[g * n for g, (_, n) in zip(good, rows, strict=True)], [(1 - g) * n for g, (_, n) in zip(good, rows, strict=True)]]
        totals = [sum(side) for side in sides]

        def chance(side: int, r: int, vote: int) -> float:
            return (sum(x for x, (v, _) in zip(sides[side], rows, strict=True) if v[r] == vote) + PRIOR) / (totals[side] + 3 * PRIOR)

        weights = [{vote: math.log(chance(0, r, vote) / chance(1, r, vote)) for vote in (-1, 0, 1)} for r in range(rules)]
        return math.log((totals[0] + PRIOR) / (totals[1] + PRIOR)), weights

    good = known + [0.0] * len(patterns)
    before, weights = estimate(known, rows[: len(known)])  # the labelled rows alone are the start
    for _ in range(rounds):
        odds = [before + sum(w[x] for w, x in zip(weights, v, strict=True)) for v, _ in patterns]
        after = known + [1 / (1 + math.exp(-max(-500.0, min(500.0, o)))) for o in odds]
        done = max((abs(a - g) for a, g in zip(after, good, strict=True)), default=0.0) < 1e-9
        good = after
        before, weights = estimate(good, rows)
        if done:
            break
    return before, weights


def labelled_sample(labels: DataFrame) -> DataFrame:
    """doc_id, label (1 if good) of about LABELLED documents at most, by a hash of their ids; ids whose rows disagree say
    nothing.  labels: doc_id, quality."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    n = rows.count()
    some = rows if n <= LABELLED else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < LABELLED)
    return some.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", "label")


def judged(docs: DataFrame, threshold: float = THRESHOLD, carry: bool = True, labels: DataFrame | None = None) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned): the features, votes, p_good, base_failed and kept.

    labels: doc_id, quality (0 or 1) of any of the documents."""
    name = fresh_name(docs.columns, "quality")
    counted = docs.withColumn(name, features(F.col("text")))
    counted = staged(counted if carry else counted.drop("text"), "features")
    f = F.col(name)
    rules = votes(f)
    passed = counted.where(~base_failed(f)).select(F.col("doc_id").cast("long").alias("doc_id"), *[r.alias(f"v{k}") for k, r in enumerate(rules)])
    passed = passed.withColumn("label", F.lit(None).cast("int")) if labels is None else passed.join(F.broadcast(labelled_sample(labels)), "doc_id", "left")
    rows = passed.groupBy(*[f"v{k}" for k in range(len(rules))], "label").count().collect()  # 3 ** 9 rows at most
    labelled = sorted((list(r[:-2]), r[-1], r[-2]) for r in rows if r[-2] is not None)
    if {y for _, _, y in labelled} == {0, 1}:
        before, weights = fit_labelled(sorted((list(r[:-2]), r[-1]) for r in rows if r[-2] is None), labelled)
    else:
        every: dict[tuple, int] = {}
        for r in rows:
            every[r[:-2]] = every.get(r[:-2], 0) + r[-1]
        before, weights = fit(sorted((list(v), n) for v, n in every.items()))
    odds = F.lit(before)
    for rule, w in zip(rules, weights, strict=False):
        odds = odds + F.when(rule == 1, F.lit(w[1])).when(rule == -1, F.lit(w[-1])).otherwise(F.lit(w.get(0, 0.0)))
    p_good = 1 / (1 + F.exp(-odds))
    return counted.withColumn(name, f.withField("p_good", p_good).withField("base_failed", base_failed(f)).withField("kept", ~base_failed(f) & (p_good >= threshold))), name


def quality(docs: DataFrame, threshold: float = THRESHOLD, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, the counts, p_good, base_failed and kept of every document."""
    found, name = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), threshold, carry=False, labels=labels)
    return found.select("doc_id", f"{name}.*")


def keep_good(docs: DataFrame, threshold: float = THRESHOLD, labels: DataFrame | None = None) -> DataFrame:
    """docs without those that the base rule or the posterior rejects."""
    found, name = judged(docs, threshold, labels=labels)
    return found.where(F.col(f"{name}.kept")).select(*quoted(docs.columns))
