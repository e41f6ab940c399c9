"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are numbered and inserted in one suffix automaton.  Each document is streamed through
it a word at a time while the length of the longest suffix that occurs in an item is tracked; where that
length reaches ``window`` (or covers a whole shorter item), the words are hit.  Only runs of words that
all occur in some item are streamed: a match can't cross another word.

Scale: documents are never shuffled.  The automaton is broadcast in blocks of at most 9/8 of ``BLOCK_WORDS`` item words (about 300 bytes a
word), whatever the items' lengths and ids: long items are cut into pieces that overlap by window - 1 words, and pieces are packed by a running
sum.  More items mean more passes, each adding its hits to those before in the shared folder, with one block's automaton alive at a time.

Defined cases: null or empty text has no words and no hits; an item without words has no window; an item
with a null id counts as id ''; items with equal ids are one item; repeated documents are each reported; no documents or
no items give no rows or no hits; texts of any length are scanned whole; of other columns than doc_id (item_id) and text none is read,
whatever it is called.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_list, fresh_name, map_batches, partitions, staged, texts

#: Words of benchmark items in one automaton.
BLOCK_WORDS = 1_000_000
#: Lower-cases A-Z, keeps digits, a-z and every byte of a non-ASCII character, blanks the rest.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class ItemAutomaton:
    """Suffix automaton over the word numbers of many items."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    shortest: int = 1 << 30
    #: for each state, the state of its suffix of ``window`` words, or -1
    at_window: list[int] = field(default_factory=list)
    items_at: dict[int, set[str]] = field(default_factory=dict)
    #: for each state, (length, item ids) of the whole short items that end there
    short_at: dict[int, list[tuple[int, str]]] = field(default_factory=dict)

    def _append(self, last: int, c: int) -> int:
        """Extend the automaton behind state ``last`` by word c; items share states."""
        step, link, length = self.step, self.link, self.length

        def split(p: int, q: int) -> int:
            clone = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = clone
                p = link[p]
            link[q] = clone
            return clone

        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else split(last, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    @classmethod
    def build(cls, items: list[tuple[str, bytes]], window: int) -> ItemAutomaton:
        a = cls(window)
        numbered = []
        for item, text in items:
            w = words_of(text)
            if w:
                numbered.append((item, [a.vocabulary.setdefault(x, len(a.vocabulary)) for x in w]))
        for _, ids in numbered:
            last = 0
            for c in ids:
                last = a._append(last, c)
        order = sorted(range(len(a.length)), key=a.length.__getitem__)
        a.at_window = [-1] * len(a.length)
        for v in order:
            if a.length[v] >= window:
                up = a.link[v]
                a.at_window[v] = a.at_window[up] if a.length[up] >= window else v
        whole: dict[int, list[tuple[int, str]]] = {}
        for item, ids in numbered:
            a.shortest = min(a.shortest, window, len(ids))
            v = n = 0
            for c in ids:
                v, n = a.step[v][c], n + 1
                if n >= window:
                    a.items_at.setdefault(a.at_window[v], set()).add(item)
            if len(ids) < window:
                whole.setdefault(v, []).append((len(ids), item))
        for v in order[1:]:
            found = whole.get(v, []) + a.short_at.get(a.link[v], [])
            if found:
                a.short_at[v] = found
        return a

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs [start, end) of hit words, and the ids of the items with an occurring window."""
        n = len(words)
        if n < self.shortest:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long_enough = ends - starts >= self.shortest
        runs: list[list[int]] = []
        items: set[str] = set()
        step, link, length, window = self.step, self.link, self.length, self.window
        for s, e in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            state = matched = 0
            for p, c in enumerate(ids[s:e].tolist(), s):
                while c not in step[state]:  # every word of a run has a step from the root
                    state = link[state]
                    matched = length[state]
                state, matched = step[state][c], matched + 1
                begin = p + 1
                if matched >= window:
                    begin = p + 1 - window
                    items |= self.items_at[self.at_window[state]]
                for size, item in self.short_at.get(state, ()):
                    if size <= matched:
                        begin = min(begin, p + 1 - size)
                        items.add(item)
                if begin <= p:
                    while runs and begin <= runs[-1][1]:
                        begin = min(begin, runs.pop()[0])
                    runs.append([begin, p + 1])
        return [tuple(r) for r in runs], items


def pieces_of(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """item_id, text, n: the items' words, cut into pieces of at most ``most`` words that overlap by window - 1, so that each window lies in one.
    No piece of an item with a whole window is shorter than one."""
    folded = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("w"))
    n = F.size("w")
    starts = F.when(n <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - window, F.lit(most - window + 1)))
    cut = items.where(n > 0).select("item_id", F.explode(starts).alias("s"), "w").select("item_id", F.slice("w", F.col("s") + 1, F.lit(most)).alias("w"))
    return cut.select("item_id", F.array_join("w", " ").alias("text"), F.size("w").alias("n"))


def blocks_of(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """item_id and text of the items' pieces, in parts of at most 9/8 of block_words words: pieces of an eighth of that at most are packed by a
    running sum, taken in ranges."""
    most = max(block_words // 8, 2 * window)
    pieces = staged(pieces_of(benchmark, window, most), "pieces")
    ranged = staged(pieces.repartitionByRange(partitions(pieces.sparkSession), "item_id", "text").withColumn("part", F.spark_partition_id()), "pieces")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("whole"))  # a row a partition
    bases = sums.select("part", F.coalesce(F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    packed = staged(ranged.join(F.broadcast(bases), "part").select("item_id", "text", F.floor(ahead / block_words).alias("block")), "packed")
    last = packed.agg(F.max("block")).first()[0] or 0
    return [packed.where(F.col("block") == k).select("item_id", "text") for k in range(last + 1)]


def automaton_of(items: DataFrame, window: int):
    """The broadcast automaton of one block; its rows stream to the driver, which holds this block only."""
    rows = [(r["item_id"], r["text"].encode()) for r in items.toLocalIterator()]
    return items.sparkSession.sparkContext.broadcast(ItemAutomaton.build(sorted(rows), window))


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, scan: Callable[[DataFrame, object, bool], DataFrame]) -> DataFrame:
    """docs after scan(docs, automaton, whether it is the last) for each block of items.  All passes but the last are written to
    the shared folder, and their automaton is given up before the next one is built, so that one is alive at a time."""
    parts = blocks_of(benchmark, window, block_words)
    for part in parts[:-1]:
        automaton = automaton_of(part, window)
        docs = staged(scan(docs, automaton, False), "hits")
        automaton.destroy()
    return scan(docs, automaton_of(parts[-1], window), True)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, runs (flat array of hit word runs: start, end, ...) and item_ids of every document."""
    schema = "doc_id long, text string, n_words long, n_hit long, runs array<int>, item_ids array<string>"

    def scan(df: DataFrame, automaton, last: bool) -> DataFrame:
        def run(c: dict) -> dict:
            n_words, n_hit, runs, ids = [], [], [], []
            for text, before, known in zip(c["text"], c["runs"], c["item_ids"], strict=True):
                w = words_of(text)
                found, items = automaton.value.match(w)
                n_words.append(len(w))
                both = merge(list(zip(before[::2], before[1::2], strict=True)) + found)
                n_hit.append(sum(e - s for s, e in both))
                runs.append([x for r in both for x in r])
                ids.append(sorted(items.union(known)))
            return {"doc_id": c["doc_id"], "text": [b""] * len(ids) if last else c["text"], "n_words": n_words, "n_hit": n_hit, "runs": runs, "item_ids": ids}

        return map_batches(df, run, schema)

    start = texts(docs).select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("item_ids"))
    return _passes(start, benchmark, window, block_words, scan).drop("text")


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(r) for r in out]


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with every hit span cut out of text (and n_chars brought up to date); documents of which more than max_coverage is hit go.

    All columns of docs stay.  A span runs from the first character of its first word to the last of its last word.
    """
    names = docs.columns
    at = {n: i for i, n in enumerate(names)}
    # names may hold dots, which mapInArrow doesn't take; the last column holds the runs found so far
    start = docs.select("*", F.array().cast("array<int>").alias(fresh_name(names, "runs"))).toDF(*(f"c{i}" for i in range(len(names) + 1)))
    schema = start.schema

    def scan(df: DataFrame, automaton, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                arrays, bodies = list(b.columns), as_list(b.column(at["text"]))
                runs = []
                for text, before in zip(bodies, as_list(b.column(len(names))), strict=True):
                    found, _ = automaton.value.match(words_of(text or b""))
                    runs.append(merge(list(zip(before[::2], before[1::2], strict=True)) + found))
                if not last:
                    arrays[-1] = pa.array([[x for r in rs for x in r] for rs in runs], type=arrays[-1].type)
                    yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)
                    continue
                keep = [sum(e - s for s, e in rs) <= max_coverage * len(words_of(t or b"")) if rs else True for t, rs in zip(bodies, runs, strict=True)]
                done = [None if t is None else without(t, rs).decode() for t, rs in zip(bodies, runs, strict=True)]
                arrays[at["text"]] = pa.array(done, type=arrays[at["text"]].type)
                if "n_chars" in at:
                    arrays[at["n_chars"]] = pa.array([None if t is None else len(t) for t in done], type=arrays[at["n_chars"]].type)
                yield pa.RecordBatch.from_arrays(arrays, schema=b.schema).filter(pa.array(keep, type=pa.bool_()))

        return df.mapInArrow(run, schema)

    out = _passes(start, benchmark, window, block_words, scan)
    return out.drop(out.columns[-1]).toDF(*names)


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """text without the given runs of its words."""
    if not runs:
        return text
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    pieces, last = [], 0
    for s, e in runs:
        pieces.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*pieces, text[last:]])
