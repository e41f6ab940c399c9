"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the frequent form of each rare word.

Forward and reversed sorted dictionaries.  Take two words that differ by one edit and let m be the length of the shorter one (of
either, if equal).  Where the edit lies behind the first half of m, both words begin with the same half; else both end with the same
half.  So each word is entered for m = its length and for m = its length - 1, in a forward dictionary (sorted by its first half) and in a
reversed one (sorted by its last half), and near words stand in one block of equal halves of at least one of them.  Range partitions of
the sorted dictionaries are scanned; only words of one block are compared, and every pair is verified code point by code point.

A block whose middle of t code points holds the edit is subdivided in the same way: an edit behind half of the middle leaves a longer
shared beginning, else there is a longer shared end.  In a task that goes on until a few words are left; blocks of over LIMIT words are
subdivided before, as rows, so that their parts are scanned by many tasks.  A middle of one code point ends it: words of equal length are then
all near each other and are counted without forming pairs, and longer words look the shorter one up.  Each pair has one place (the length of
the beginning that both words share) and is found only in the block whose range holds that place, so counts need no removal of
doubles; blocks give one row a word with its near words' number and the best one, never the pairs.

Defined cases: null texts have no words; a null id is allowed; texts and words of any length are taken whole (a word of a million letters has
four entries); repeated rows count as often as they come; equally frequent near words are chosen by code points; an empty table gives no rows; of
other columns than the named ones none is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_split
from .common import partitions, staged

#: The letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block that one task scans; larger blocks are subdivided as rows first.
LIMIT = 4096
#: Words of a block that are compared with each other rather than subdivided on.
FEW = 5
_KEY = ["a", "b", "m", "head", "tail"]
_SHAPE = "word string, near long, best_n long, best string"


def letter_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """key, run for each maximal run of letters of at least ``least`` code points, A-Z in lower case."""
    found = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), 0)
    return docs.select(F.col(key).alias("key"), F.explode(found).alias("run")).select("key", F.translate("run", UPPER, LOWER).alias("run"))


def vocabulary(words: DataFrame, word: str = "word", min_length: int = 7, min_count: int = 2) -> DataFrame:
    """word, n: the distinct words of enough code points and occurrences."""
    return words.select(F.col(word).alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near, best_n, best: of each word with near words their number and the most frequent one, of ``words`` (word, n; distinct)."""
    size = F.length("word")
    entries = [F.struct(m.alias("m"), a.alias("a"), b.alias("b")) for m in (size, size - 1) for half in (F.floor(m / 2).cast("int"),) for a, b in ((half, F.lit(0)), (F.lit(0), m - half))]
    level, leaves = _entered(words, F.array(*entries)), []
    while True:
        heavy = staged(level.where("m - a - b > 1").groupBy("block").agg(F.count("*").alias("many")).where(F.col("many") > limit), "heavy")
        total = heavy.agg(F.sum("many")).first()[0]
        if not total:
            leaves.append(level)
            break
        leaves.append(level.join(heavy, "block", "left_anti"))
        half = F.expr("int((m - a - b) / 2)")
        parts = F.array(
            F.struct("m", (F.col("a") + half).alias("a"), "b"),
            F.struct("m", "a", F.expr("m - a - int((m - a - b) / 2)").alias("b")),
        )
        level = staged(_entered(join_split(level, heavy, "block", "many", total), parts), "blocks")
    entered = leaves[0]
    for more in leaves[1:]:
        entered = entered.unionByName(more)
    dictionary = entered.select(*_KEY, "word", "n").repartitionByRange(partitions(words.sparkSession), *_KEY).sortWithinPartitions(*_KEY)
    found = dictionary.mapInArrow(_scan, _SHAPE)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top")).select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.word").alias("best"))


def group(words: DataFrame, ratio: int = 10, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``words`` (word, n; distinct, of at least four code points).

    A word's form is its most frequent near word, if that is at least ``ratio`` times as frequent; root is where following forms ends.
    Frequencies grow by ``ratio`` a step, so chains are short; their ends are found by doubling.
    """
    if ratio < 2:
        raise ValueError("forms need a ratio of at least 2, else chains of them may be long or closed")
    words = staged(words, "words")
    if words.where(F.length("word") < 4).limit(1).count():
        raise ValueError("halves of words of under four code points tell nothing apart")
    is_form = F.col("best_n") >= ratio * F.col("n")
    near = words.join(near_words(words, limit), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    near = staged(near, "forms")
    ends = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = staged(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not ends.where("moved").limit(1).count():
            break
        ends = ends.drop("moved")
    return near.join(ends.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _entered(words: DataFrame, entries: Column) -> DataFrame:
    """A row for each entry (m, a, b) of each word: it stands in the block of words of m or m + 1 code points with its first a and last b."""
    rows = words.select("word", "n", F.explode(entries).alias("e")).select("word", "n", "e.*")
    rows = rows.withColumns({"head": F.expr("left(word, a)"), "tail": F.expr("right(word, b)")})
    return rows.withColumn("block", F.xxhash64(*_KEY))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted dictionary one after the other; of a block at most LIMIT words, or those that share all but a code point or two, are held."""
    out = _Found()
    last, block = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for key, entry in zip(zip(*columns[:5], strict=True), zip(*columns[5:], strict=True), strict=True):
            if key != last:
                if len(block) > 1:
                    out.block(*last[:3], block)
                last, block = key, []
            block.append(entry)
        if len(out.rows) > 5000:
            yield out.batch()
    if len(block) > 1:
        out.block(*last[:3], block)
    yield out.batch()


class _Found:
    """Near words of each block, added up by word."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, str]] = []

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows, strict=True) if rows else ([],) * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "best_n", "best"])

    def block(self, a: int, b: int, m: int, words: list[tuple[str, int]]) -> None:
        found: dict[str, list] = {}

        def add(word: str, other: str, n: int, times: int = 1) -> None:
            at = found.get(word)
            if at is None:
                found[word] = [times, -n, other]
            else:
                at[0] += times
                if (-n, other) < (at[1], at[2]):
                    at[1:] = -n, other

        for head, tail, part in _narrowed(a, b, m, words):
            last = m - tail if tail else m + 1  # the first place that isn't this block's
            if len(part) > FEW:
                _ends(head, last, m, part, add)
                continue
            for k, (x, nx) in enumerate(part):
                for y, ny in part[:k]:
                    s, w = (x, y) if len(x) <= len(y) else (y, x)
                    if len(s) != m:
                        continue
                    p = head
                    while p < m and s[p] == w[p]:
                        p += 1
                    if p < last and s[p + (len(w) == m) :] == w[p + 1 :]:
                        add(x, y, ny)
                        add(y, x, nx)
        self.rows += ((w, c, -n, o) for w, (c, n, o) in found.items())


def _narrowed(a: int, b: int, m: int, words: list[tuple[str, int]]) -> Iterator[tuple[int, int, list[tuple[str, int]]]]:
    """The parts of a block after subdividing it to few words or to a middle of one code point; parts that can hold no pair are left out."""
    stack = [(a, b, words)]
    while stack:
        a, b, words = stack.pop()
        middle = m - a - b
        if len(words) <= FEW or middle <= 1:
            yield a, b, words
            continue
        half = middle // 2
        ahead: dict[str, list] = {}
        behind: dict[str, list] = {}
        for entry in words:
            w = entry[0]
            ahead.setdefault(w[a : a + half], []).append(entry)
            end = len(w) - b
            behind.setdefault(w[end - middle + half : end], []).append(entry)
        stack += ((a + half, b, p) for p in ahead.values() if len(p) > 1)
        stack += ((a, b + middle - half, p) for p in behind.values() if len(p) > 1)


def _ends(head: int, last: int, m: int, words: list[tuple[str, int]], add) -> None:
    """Near words of a block whose middle is one code point: those of length m are all near each other."""
    equal = {w: n for w, n in words if len(w) == m}
    first = sorted((-n, w) for w, n in equal.items())[:2] if len(equal) > 1 else []
    if first and head < last:
        for w in equal:
            n, other = first[first[0][1] == w]
            add(w, other, -n, len(equal) - 1)
    for w, n in words:
        if len(w) == m:
            continue
        for p in range(head, last):
            s = w[:p] + w[p + 1 :]
            if s in equal and (p == m or s[p] != w[p]):
                add(s, w, n)
                add(w, s, equal[s])
