"""Runs: maximal stretches of words that repeat with a period at least four times over, and texts without the repetitions.

Block matching.  For each power of two b, the aligned blocks of b words of a text are the keys of Aho-Corasick automata over integer
sequences (pyahocorasick) that the text is searched with.  Equal words, or for long blocks equal eighths of a block, have equal integers.  A run of smallest period q whose length is at least four periods holds an
aligned block together with its next two occurrences q further on, if b is the largest power of two with 2b - 1 <= 3q; so an occurrence of a
block at a distance d with 2b - 1 <= 3d < 4b - 1 is a seed.  Each seed is extended in both directions, word by word, as long as words d
apart are equal; extents that are long enough and have no smaller period are the runs, and no others are.

What keeps the work near n log n for a text of n words:

* words of a run but its last period come again within a period, so at the scale b only stretches of at least 2b - 1 such words, and what follows them within
  the largest distance, are cut into blocks and searched;
* for each distance an extent is found once, whatever number of seeds lie in it;
* a seed inside a known run of period p <= b is left out: what it would extend to has the period gcd(p, d) < d (Fine and Wilf).

Each text is worked on alone and whole; what is held at once are its word numbers, an automaton of at most 64 blocks, and its runs.

Defined cases: a null text has no words; a null id is allowed; repeated rows get equal results; texts of any length are taken whole; an empty table gives
no rows; other columns than the named ones aren't read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts

#: A run is at least so many words long, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Aligned blocks that are the keys of one automaton: its nodes keep their edges in lists, which many different blocks would make long.
BLOCKS = 64
#: Numbers in a key: from 16 words a block on, a number stands for an eighth of the block, so that automata stay shallow.
DEPTH = 8

Run = tuple[int, int, int]


def find_runs(words: np.ndarray, stats: dict | None = None) -> list[Run]:
    """(start, length, period) of every run of ``words`` (numbers), by start, then period.  stats gets counts of seeds and extents."""
    n, runs = len(words), []
    if n < LEAST_WORDS:
        return runs
    words = np.ascontiguousarray(words, np.uint32)
    again = _next_distance(words)
    b, names, size = 2, words, 1
    while 2 * b - 1 <= 3 * (n // LEAST_PERIODS):
        low, high = max(1, -(-(2 * b - 1) // 3)), min((4 * b - 2) // 3, n // LEAST_PERIODS)
        near = again <= high
        if _stretches(near, 2 * b - 1):
            while size < b // DEPTH:
                names, size = _doubled(names, size), 2 * size
            runs += _runs_at(words, names, near, b, low, high, runs, stats if stats is not None else {})
        b *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _next_distance(words: np.ndarray) -> np.ndarray:
    """How far on each word comes again; n if it doesn't."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), len(words))
    same = words[order[1:]] == words[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of each maximal stretch of at least ``least`` true places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _runs_at(words: np.ndarray, names: np.ndarray, near: np.ndarray, b: int, low: int, high: int, known: list[Run], stats: dict) -> list[Run]:
    """The runs of period low to high, whose aligned blocks of b words come again at such a distance."""
    n, found, extended = len(words), [], np.zeros(high + 1, np.int64)
    # where the run that begins here or before and reaches furthest ends, of those whose period is at most b
    reach = np.zeros(n, np.int64)
    for start, length, period in known:
        if period <= b:
            reach[start] = max(reach[start], start + length)
    np.maximum.accumulate(reach, out=reach)
    for i, d in _seeds(names, near, reach, b, low, high):
        if extended[d] > i or reach[i] >= i + d + b:
            continue
        start, end = _extent(words, i, d, b)
        extended[d] = end
        stats["extents"] = stats.get("extents", 0) + 1
        length = end + d - start
        if length >= max(LEAST_WORDS, LEAST_PERIODS * d) and _is_smallest(words, start, d):
            found.append((start, length, d))
    return found


def _seeds(names: np.ndarray, near: np.ndarray, reach: np.ndarray, b: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Place of an aligned block and a distance at which it comes again; for each distance by place.  Blocks of which no seed could
    leave the known run that they lie in are none."""
    n, size, step = len(names), BLOCKS * b, max(1, b // DEPTH)
    depth = b // step
    for start, end in _stretches(near, 2 * b - 1):
        first, last = -(-start // b) * b, end // b * b
        for begin in range(first, last, size):
            stop = min(begin + size, last)
            places: dict[tuple, list[int]] = {}
            at = np.arange(begin, stop, b)
            for i in at[reach[at] < np.minimum(at + high + b, n)].tolist():
                places.setdefault(tuple(names[i : i + b : step].tolist()), []).append(i)
            if not places:
                continue
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for block, found in places.items():
                automaton.add_word(block, found)
            automaton.make_automaton()
            seeds = []
            for offset in range(begin, begin + step):
                for k, blocks in automaton.iter(tuple(names[offset : min(stop + high, n) : step].tolist())):
                    j = offset + (k - depth + 1) * step
                    for k in range(bisect_right(blocks, j - low) - 1, -1, -1):
                        if j - blocks[k] > high:
                            break
                        seeds.append((j - blocks[k], blocks[k]))
            yield from ((i, d) for d, i in sorted(seeds))


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the stretches of 2 * size words from each place, from those of size words; a stretch that the text's end cuts off equals no other."""
    n = len(names)
    if n < 2 * size:
        return np.arange(n, dtype=np.uint32)
    pairs = (names[: n - size].astype(np.uint64) << np.uint64(32)) | names[size:]
    whole = np.unique(pairs[: n - 2 * size + 1], return_inverse=True)[1].astype(np.uint32)
    return np.concatenate((whole, np.arange(n, 2 * n - len(whole), dtype=np.uint32)))


def _extent(words: np.ndarray, i: int, d: int, b: int) -> tuple[int, int]:
    """The first and one past the last place around i from which the word d further on is equal."""
    n = len(words) - d
    end, step = i + b, max(b, 16)
    while end < n:
        stop = min(end + step, n)
        bad = words[end:stop] != words[end + d : stop + d]
        if bad.any():
            end += int(bad.argmax())
            break
        end, step = stop, step * 2
    start, step = i, max(b, 16)
    while start > 0:
        begin = max(0, start - step)
        bad = words[begin:start] != words[begin + d : start + d]
        if bad.any():
            start -= int(bad[::-1].argmax())
            break
        start, step = begin, step * 2
    return start, end


def _is_smallest(words: np.ndarray, start: int, d: int) -> bool:
    """Whether a run of period d, of two periods at least, has no smaller one: that would divide d."""
    rest, f = d, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            p = d // f
            if np.array_equal(words[start : start + d], words[start + p : start + p + d]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words by equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint32, len(words))


def keep_mask(n: int, runs: list[Run]) -> np.ndarray:
    """False for the words that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (start, length, period of each, by start, then period) and collapsed: the words outside repetitions, joined by one space."""

    def of(batch: dict) -> dict:
        out: dict[str, list] = {key: batch[key], "n_words": [], "runs": [], "collapsed": []}
        for t in batch[text]:
            words = t.split()  # at the six ASCII white-space characters, as t is UTF-8 bytes
            found = find_runs(numbered(words))
            out["n_words"].append(len(words))
            if found:
                words = [words[k] for k in np.flatnonzero(keep_mask(len(words), found))]
            out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in found])
            out["collapsed"].append(b" ".join(words))
        out["collapsed"] = pa.array(out["collapsed"], pa.binary()).cast(pa.string())
        return out

    return map_batches(texts(docs, key, text), of, f"{key} long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
