"""Removal of byte strings that an earlier document holds, by bucketed suffix sorting with difference-cover ranks.

A byte is removed if a string of ``LENGTH`` = 50 bytes around it also starts in a document with a smaller id.  The
suffixes of all documents together can't be sorted in one place, nor shipped (each would need its next 50 bytes),
so the work is cut in three passes over the texts, each of which moves a small part of them:

1. *Anchors.*  Each 50-byte string is assigned the place in it of the 25-byte string with the least hash (leftmost
   of equal ones), so equal strings have equal anchors at equal offsets; one suffix in 13 or so is an anchor.
   Hashes of anchors, as short as their number allows, are packed, bucketed and compared: those of one document only
   can't be part of a repeat.
2. *Buckets.*  For the shared anchors, the 75 bytes around them are packed and bucketed by anchor.  A task sorts
   one bucket at a time.  A difference cover of period 13 (``COVER``) marks sample places; the strings of 38 bytes
   at them are ranked first.  A suffix is then keyed by the bytes before its next sample place, the bytes behind the
   sample's string (12 bytes together) and the sample's rank: long ties are resolved by the ranks, 16 bytes a
   suffix bound the memory.  For each suffix follows whether a smaller document has the same 50 bytes.
3. *Removal.*  The answers, 4 bytes for each anchor, are joined to the documents, and the runs are cut.

Scale: exact copies are found by the SHA-256 of the text first; all but the smallest document of a group are removed
whole and take no further part.  Near copies are pre-aggregated: within what a task packs at once, equal surroundings travel once, for
the smallest document; larger ones are known to be covered right there.  An anchor that ``HOT`` packs hold is hot:
its surroundings are dealt by halves instead.  Strings that begin at places 0 to 12 of the surroundings all hold the 38
bytes from 12 on, the others those from 25 on: so a half is 62 bytes, meets the others of the same 38, and travels once
for a pack.  Many packs make many anchors hot; the 50-byte strings one by one would be 1300 bytes an anchor.
The texts are shuffled once, compressed (one exchange serves all passes).  Hashes of anchors only decide what is
looked at and where; equality of strings is decided by bytes.  There are as many buckets as make each hold the anchors of
about ``BUCKET`` bytes of text; a task takes its buckets one after the other.  Finding the anchors of one text takes about
100 bytes of memory a byte of it, in pieces of ``PIECE`` bytes.

Defined cases: null and empty texts have no bytes and no runs; a null doc_id counts as larger than all others;
rows with equal ids don't cover each other; overlapping repeats inside one document alone are not removed; texts of any length
are worked on whole; of other columns than doc_id and text none is read, whatever it is called.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_split
from .common import as_list, partitions, staged, texts

#: Bytes of a repeat, bytes of an anchor, and a difference cover (every difference modulo 13 occurs in it).
LENGTH, GRAM = 50, 25
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text that a task packs at once, and packs that hold a hot anchor.
PACK, HOT = 8 << 20, 200
#: Strings of a text whose anchors are found at once.
PIECE = 1 << 20
#: Bytes of text whose anchors share a bucket: a task holds the anchors of one bucket, about a third of that at a time.
BUCKET = 32 << 20
#: Numbers that a task holds before it sends them to their documents.
SENT = 1 << 20
#: Bytes around an anchor: LENGTH - GRAM on both sides.  Padding is a byte that UTF-8 doesn't know.
SIDE = LENGTH - GRAM
AROUND, PAD = GRAM + 2 * SIDE, 255
_SAMPLE = LENGTH - PERIOD + 1
_NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)
#: Bits of the hashes that anchors are chosen by.
_HASH = np.uint64((1 << 48) - 2)
#: The strings at HALF offsets in a row have the middle LENGTH - HALF + 1 = 38 of their WIDE bytes in common; two halves hold all offsets.
HALF = (SIDE + 1) // 2
WIDE = LENGTH + HALF - 1
#: Anchors are sent as numbers of so many bits more than tell one from another: about one in 2 ** SPARE is held to be shared and is not.
SPARE = 8


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-byte strings of a (uint64 values), by doubling."""
    n, out, done, size = len(a) - k + 1, None, 0, 1
    while k:
        if k & 1:
            part = a[done : done + n]
            out = part if out is None else out * _power(size) + part
            done += size
        k >>= 1
        if k:
            a = a[:-size] * _power(size) + a[size:]
            size *= 2
    return out


def anchors(text: bytes, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """For each 50-byte string of text: hash and place of its anchor."""
    if len(text) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(text) > piece + LENGTH:
        parts = [(at, *anchors(text[at : at + piece + LENGTH - 1], piece)) for at in range(0, len(text) - LENGTH + 1, piece)]
        return np.concatenate([h for _, h, _ in parts]), np.concatenate([p + at for at, _, p in parts])
    h = _mix(gram_hashes(np.frombuffer(text, np.uint8).astype(np.uint64) + _ONE, GRAM)) & _HASH
    at, size, window = np.arange(len(h)), 1, SIDE + 1

    def least(h1, p1, h2, p2):
        right = h2 < h1
        return np.where(right, h2, h1), np.where(right, p2, p1)

    n = len(h) - window + 1
    while size * 2 <= window:
        h, at = least(h[:-size], at[:-size], h[size:], at[size:])
        size *= 2
    return least(h[:n], at[:n], h[window - size : window - size + n], at[window - size : window - size + n])


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))  # noqa: S301  written by a task of this job


def _planes(a: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all lowest ones first and so on, so that empty ones compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T)


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").ravel()


def _steps(a: np.ndarray) -> np.ndarray:
    """Planes of 64-bit numbers in ascending order, by their differences."""
    a = a.view(np.uint64)
    return _planes(np.diff(a, prepend=np.uint64(0)))


def _from_steps(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_numbers(planes), dtype=np.uint64)


def _pack_pairs(h: np.ndarray, d: np.ndarray) -> bytes:
    """Sorted anchors and documents."""
    return _packed(_steps(h), _planes(d))


def _unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    h, d = _unpacked(blob)
    return _from_steps(h), _numbers(d).view(np.int64)


def _pack_asked(half: int, did: np.ndarray, rid: np.ndarray, at: np.ndarray, strings: np.ndarray) -> bytes:
    """Surroundings (half -1), or one half of each, with their rows and places; in order of their documents."""
    order = np.argsort(did, kind="stable")
    return _packed(np.array([half]), _steps(did[order]), _planes(rid[order]), _planes(at[order].astype(np.uint32)), strings[order])


def _unpack_asked(blob: bytes) -> tuple[np.ndarray, ...]:
    """did, rid, at and surroundings; what a half doesn't have of them is padding."""
    half, did, rid, at, strings = _unpacked(blob)
    if half[0] >= 0:
        around = np.full((len(strings), AROUND), PAD, np.uint8)
        around[:, half[0] * HALF : half[0] * HALF + WIDE] = strings
        strings = around
    return _from_steps(did).view(np.int64), _numbers(rid).view(np.int64), _numbers(at), strings


def _compressed(docs: DataFrame) -> DataFrame:
    """did, digest and body: texts as they are shuffled, and their SHA-256."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            bodies = as_list(b.column(1))
            made = (b.column(0), pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary()), pa.array([small(x) for x in bodies], pa.binary()))
            yield pa.RecordBatch.from_arrays(list(made), names=["did", "digest", "body"])

    return docs.select("did", "text").mapInArrow(compress, "did long not null, digest binary not null, body binary not null")


_ROW = pa.schema([("bucket", pa.int32()), ("did", pa.int64()), ("blob", pa.binary())])
_ROW_DDL = "bucket int, did long, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, _ROW, strict=True)], schema=_ROW)


def _flushes(batches: Iterator[pa.RecordBatch], columns: int, pack: int) -> Iterator[list[list]]:
    """Rows of batches in packs of about ``pack`` bytes of their second column, a text that was compressed."""
    held: list[list] = [[] for _ in range(columns)]
    size, text = 0, zstandard.ZstdDecompressor().decompress
    for b in batches:
        lists = [as_list(b.column(k)) for k in range(columns)]
        lists[1] = map(text, lists[1])
        for row in zip(*lists, strict=True):
            for h, x in zip(held, row, strict=True):
                h.append(x)
            size += len(row[1])
            if size >= pack:
                yield held
                held, size = [[] for _ in range(columns)], 0
    if held[0]:
        yield held


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, (did, blob) rows) of rows sorted by bucket."""
    now, held = None, []
    for b in batches:
        for bucket, did, blob in zip(*(as_list(b.column(k)) for k in range(3)), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append((did, blob))
    if held:
        yield now, held


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _anchor_numbers(h: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits for the hashes of anchors, which themselves are small ones, being the least of many."""
    return _mix(h) >> np.uint64(64 - bits)


def _bounds(bits: int, buckets: int) -> np.ndarray:
    """The first numbers of all buckets but the first one: a bucket is a range of numbers, so that they differ little from one to the next."""
    return np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)


def _ranges(h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, positions) of sorted numbers."""
    at = np.searchsorted(h, bounds).tolist()
    for b, (x, y) in enumerate(zip([0, *at], [*at, len(h)], strict=True)):
        if x < y:
            yield b, slice(x, y)


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, positions) of each key."""
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
        yield int(key[part[0]]), part


class _Sender:
    """Collects arrays whose first one is documents, and packs them by where the document belongs."""

    def __init__(self, targets: int):
        self.targets, self.held, self.size = targets, [], 0

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(arrays)
        self.size += len(arrays[0])
        if self.size > SENT:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            arrays = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            yield _rows([(t, None, _sent(*(x[p] for x in arrays))) for t, p in _split(_target_of(arrays[0], self.targets))])
        self.held, self.size = [], 0


def _target_of(did: np.ndarray, targets: int) -> np.ndarray:
    return _bucket_of(_mix(did.view(np.uint64)), targets)


def _sent(*arrays: np.ndarray) -> bytes:
    """Arrays in order of their documents."""
    order = np.lexsort(arrays[1::-1])
    return _packed(_steps(arrays[0][order]), *(_planes(x[order]) for x in arrays[1:]))


def _received(blob: bytes) -> list[np.ndarray]:
    did, *rest = _unpacked(blob)
    return [_from_steps(did).view(np.int64), *map(_numbers, rest)]


def _of_document(blob: bytes, *sizes: int) -> list[np.ndarray]:
    """The arrays of numbers of so many bytes that ``_by_document`` has put together."""
    n, at, out = len(blob) // sum(sizes), 0, []
    for size in sizes:
        out.append(_numbers(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)))
        at += n * size
    return out


def _by_document(sent: DataFrame, name: str) -> DataFrame:
    """did and a blob of all that was sent for it."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            arrays = [np.concatenate(x) for x in zip(*(_received(blob) for _, blob in rows), strict=True)]
            order = np.argsort(arrays[0], kind="stable")
            arrays = [x[order] for x in arrays]
            bounds = [*np.flatnonzero(np.concatenate(([True], arrays[0][1:] != arrays[0][:-1]))).tolist(), len(order)]
            for at in range(0, len(bounds) - 1, 1000):
                part = bounds[at : at + 1001]
                yield _rows([(0, int(arrays[0][x]), b"".join(_planes(a[x:y]).tobytes() for a in arrays[1:])) for x, y in zip(part, part[1:], strict=False)])

    n = partitions(sent.sparkSession)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, _ROW_DDL).select("did", F.col("blob").alias(name))


def shared_anchors(docs: DataFrame, bits: int, buckets: int, pack: int = PACK, hot: int = HOT) -> DataFrame:
    """did, shared: a document's anchors that others have (numbers of so many bits and one more, the lowest, that is set if hot)."""

    bounds = _bounds(bits, buckets)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dids, bodies in _flushes(batches, 2, pack):
            hashes, owners = [], []
            for did, body in zip(dids, bodies, strict=True):
                h, _ = anchors(body)
                u = np.unique(_anchor_numbers(h[np.concatenate(([True], h[1:] != h[:-1]))], bits)) if len(h) else h
                hashes.append(u)
                owners.append(np.full(len(u), did, np.int64))
            h, d = np.concatenate(hashes), np.concatenate(owners)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
            # the first document of this pack for each anchor, and all of those that share one inside it
            repeated = ~first
            repeated[:-1] |= ~first[1:]
            yield _rows([(b, kind, _pack_pairs(g[p], o[p])) for kind, g, o in ((0, h[first], d[first]), (1, h[repeated], d[repeated])) for b, p in _ranges(g, bounds)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, often, sender = None, [], np.empty(0, np.uint64), _Sender(buckets)

        def across() -> Iterator[pa.RecordBatch]:
            """Anchors of the bucket that several packs have; notes the hot ones."""
            nonlocal parts, often
            if parts:
                h, d = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                order = np.argsort(h, kind="stable")
                h, d = h[order], d[order]
                start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                size = np.diff(np.append(start, len(h)))
                n = np.repeat(size, size)
                often = h[start[size > hot]]
                parts = []
                yield from sender.add(d[n > 1], h[n > 1] << _ONE | (n[n > 1] > hot).astype(np.uint64))

        # sorted by bucket and kind: a bucket's first documents are held together, its repeats inside packs pass one by one
        for b in batches:
            for bucket, kind, blob in zip(*(as_list(b.column(k)) for k in range(3)), strict=True):
                if bucket != now or kind:
                    yield from across()
                if bucket != now:
                    now, often = bucket, often if kind else np.empty(0, np.uint64)
                h, d = _unpack_pairs(blob)
                if kind:
                    yield from sender.add(d, h << _ONE | np.isin(h, often).astype(np.uint64))
                else:
                    parts.append((h, d))
        yield from across()
        yield from sender.flush()

    packed = docs.select("did", "body").mapInArrow(gather, _ROW_DDL)
    found = packed.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "did").mapInArrow(compare, _ROW_DDL)
    return _by_document(found, "shared")


def windows_covered(around: np.ndarray, did: np.ndarray) -> np.ndarray:
    """around: 75 bytes around anchors of one bucket, one row each; did: their documents.  Bit o of the result is set
    if the 50 bytes from o on are also in a row of a smaller document."""
    n = len(around)
    covered = np.zeros(n, np.uint32)
    # cover-sample ranks: strings of _SAMPLE bytes at the cover's places, equal ranks for equal strings
    prefix = np.zeros((n, AROUND + 1), np.uint64)
    for k in range(AROUND):
        prefix[:, k + 1] = prefix[:, k] * np.uint64(_BASE) + around[:, k].astype(np.uint64) + _ONE
    rank = {}
    for s in (s for s in range(AROUND - _SAMPLE + 1) if s % PERIOD in COVER):
        h = prefix[:, s + _SAMPLE] - prefix[:, s] * _power(_SAMPLE)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        strings = around[:, s : s + _SAMPLE]
        if (strings != strings[first[inverse]]).any():  # two strings share a hash: rank by bytes
            _, inverse = np.unique(np.ascontiguousarray(strings).view(f"V{_SAMPLE}").ravel(), return_inverse=True)
        rank[s] = inverse.astype(np.uint32)
    del prefix
    for o in range(SIDE + 1):
        s = next(s for s in range(o, o + PERIOD) if s % PERIOD in COVER)
        key = np.empty((n, 16), np.uint8)
        key[:, : s - o] = around[:, o:s]
        key[:, s - o : 12] = around[:, s + _SAMPLE : o + LENGTH]
        key[:, 12:] = rank[s].view(np.uint8).reshape(n, 4)
        a, b = key.view(np.uint64).T
        order = np.lexsort((did, b, a))
        start = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
        least = did[order][np.maximum.accumulate(np.where(start, np.arange(n), 0))]
        hit = order[least < did[order]]
        covered[hit[(around[hit, o : o + LENGTH] != PAD).all(axis=1)]] |= np.uint32(1 << o)
    return covered


def halves(around: np.ndarray, did: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Surroundings of hot anchors by halves: (half, its WIDE bytes of all rows, rows to ask about, rows whose strings there are all covered).

    Two strings of one half that are equal have the WIDE bytes' middle in common, so a half meets the others of the same
    middle.  Equal halves are asked about once, for the smallest document."""
    for half in (0, 1):
        wide = around[:, half * HALF : half * HALF + WIDE]
        rows = np.flatnonzero((wide[:, HALF - 1 : LENGTH] != PAD).all(axis=1))
        later = _later(wide[rows], did[rows])
        yield half, wide, rows[~later], rows[later]


def _later(strings: np.ndarray, did: np.ndarray) -> np.ndarray:
    """Whether a row has the bytes of a smaller document's row."""
    order = _order(strings, did)
    same = np.concatenate(([False], (strings[order][1:] == strings[order][:-1]).all(axis=1)))[: len(order)]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.zeros(len(order), bool)
    later[order] = did[order][start] < did[order]
    return later


def answers(docs: DataFrame, shared: DataFrame, bits: int, buckets: int, pack: int = PACK) -> DataFrame:
    """did, answers: rows, places and answers for anchors of a document."""
    bounds = _bounds(bits, buckets)

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dids, bodies, rids, known in _flushes(batches, 4, pack):
            found: list[tuple] = []
            for k, (body, numbers) in enumerate(zip(bodies, known, strict=True)):
                h, at = anchors(body)
                if not len(h):
                    continue
                asked = np.unique(_of_document(numbers, 8)[0])
                hot = asked[(asked & _ONE) == 1] >> _ONE
                asked = np.unique(asked >> _ONE)
                new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                h, at = _anchor_numbers(h[new], bits), at[new]
                place = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
                h, at = h[asked[place] == h], at[asked[place] == h]
                padded = np.concatenate((np.full(SIDE, PAD, np.uint8), np.frombuffer(body, np.uint8), np.full(SIDE, PAD, np.uint8)))
                found.append((h, at, np.full(len(h), k), np.isin(h, hot), padded[at[:, None] + np.arange(AROUND)]))
            if not found:
                continue
            h, at, doc, hot, around = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            did, rid = np.array(dids, np.int64)[doc], np.array(rids, np.int64)[doc]
            rows: list[tuple] = []

            def covered(p: np.ndarray, first: int, n: int) -> None:
                """Rows p have all their strings at n offsets in smaller documents of this pack."""
                for t, x in _split(_target_of(did[p], buckets)):  # noqa: B023  called at once
                    x = p[x]
                    rows.append((-1 - t, None, _sent(did[x], rid[x].view(np.uint64), at[x].astype(np.uint32), np.full(len(x), (1 << n) - 1 << first, np.uint32))))  # noqa: B023

            # of equal surroundings in this pack, only the smallest document's are asked about
            later = _later(around, did)
            covered(np.flatnonzero(later), 0, SIDE + 1)
            rest = np.flatnonzero(~later & ~hot)
            for b, p in _split(np.searchsorted(bounds, h[rest], side="right")):
                p = rest[p]
                rows.append((b, None, _pack_asked(-1, did[p], rid[p], at[p], around[p])))
            rest = np.flatnonzero(~later & hot)
            for half, wide, asked, known in halves(around[rest], did[rest]):
                covered(rest[known], half * HALF, HALF)
                for b, p in _split(_bucket_of(_mix(_hash_of(wide[asked, HALF - 1 : LENGTH])), buckets)):
                    p = asked[p]
                    rows.append((b, None, _pack_asked(half, did[rest[p]], rid[rest[p]], at[rest[p]], wide[p])))
            yield _rows(rows)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets)
        for bucket, rows in _by_bucket(batches):
            if bucket < 0:  # answered already
                yield _rows([(-1 - bucket, None, blob) for _, blob in rows])
                continue
            did, rid, at, around = (np.concatenate(x) for x in zip(*(_unpack_asked(blob) for _, blob in rows), strict=True))
            covered = windows_covered(around, did)
            some = covered > 0
            yield from sender.add(did[some], rid[some].view(np.uint64), at[some], covered[some])
        yield from sender.flush()

    asked = docs.join(shared.hint("shuffle_hash"), "did").select("did", "body", "rid", "shared")
    packed = asked.mapInArrow(surround, _ROW_DDL)
    solved = packed.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(solve, _ROW_DDL)
    return _by_document(solved, "answers")


def _hash_of(strings: np.ndarray) -> np.ndarray:
    h = np.zeros(len(strings), np.uint64)
    for k in range(strings.shape[1]):
        h = h * np.uint64(_BASE) + strings[:, k].astype(np.uint64) + _ONE
    return h


def _order(strings: np.ndarray, did: np.ndarray) -> np.ndarray:
    """Order that brings equal rows together (by bytes), smaller documents first among them."""
    width = strings.shape[1]
    wide = np.zeros((len(strings), -(-width // 8) * 8), np.uint8)
    wide[:, :width] = strings
    return np.lexsort((did, *wide.view(np.uint64).T))


def removed_runs(text: bytes, rid: int, answers: bytes) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes to remove, by the answers for the row rid."""
    rids, places, covered = _of_document(answers, 8, 4, 4)
    mine = rids.view(np.int64) == rid
    places, covered = places[mine], covered[mine]
    _, at = anchors(text)
    answer = np.zeros(len(text) + 1, np.uint32)
    np.bitwise_or.at(answer, places.astype(np.int64), covered)
    i = np.arange(len(at))
    hit = np.flatnonzero((answer[at] >> (i - (at - SIDE)).astype(np.uint32)) & np.uint32(1))
    if not len(hit):
        return []
    gap = np.flatnonzero(np.diff(hit) > LENGTH)
    return list(zip(hit[np.concatenate(([0], gap + 1))].tolist(), (hit[np.concatenate((gap, [-1]))] + LENGTH).tolist(), strict=True))


def cut(docs: DataFrame, pack: int = PACK, hot: int = HOT, bucket: int = BUCKET, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and the bytes kept if asked for."""
    spark = docs.sparkSession
    asked = texts(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"), "text")
    digest = F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b""))  # not null, or a filter on it would make the exchange another one
    heads = staged(asked.select("did", digest.alias("digest"), F.octet_length("text").cast("long").alias("size")), "digests")
    firsts = staged(heads.groupBy("digest").agg(F.min("did").alias("first"), F.max("did").alias("last"), F.count("*").alias("n")).where("first < last").drop("last"), "copied")
    totals = heads.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    size = totals["size"] or 0
    copies = join_split(heads.drop("size"), firsts, "digest", "n", totals["n"]).where("did > first").select("did", "digest", F.lit(False).alias("twice"))
    twice = heads.groupBy("did").agg(F.count("*").alias("n")).where("n > 1").select("did", F.lit(None).cast("binary").alias("digest"), F.lit(True).alias("twice"))
    known = copies.unionByName(twice).groupBy("did").agg(F.collect_set("digest").alias("copies"), F.max("twice").alias("twice"))
    keyed = _compressed(asked).repartition(partitions(spark), "did")
    copy = F.coalesce(F.array_contains("copies", F.col("digest")), F.lit(False)).alias("copy")
    rid = F.when(F.col("twice"), F.xxhash64("body")).otherwise(F.lit(0)).cast("long").alias("rid")  # which of the rows of one id; of most ids there is one
    flagged = keyed.join(known.hint("shuffle_hash"), "did", "left").select("did", "body", rid, copy)
    live = flagged.where("NOT copy").select("did", "body", "rid")
    buckets = max(partitions(spark), -(-size // bucket))  # bounded in bytes, however few partitions there are
    bits = min(47, (size // PERIOD).bit_length() + SPARE)
    found = answers(live, shared_anchors(live, bits, buckets, pack, hot), bits, buckets, pack)
    joined = flagged.join(found.hint("shuffle_hash"), "did", "left").select(F.expr(f"nullif(did, {_NO_ID})").alias("doc_id"), "body", "rid", "answers", "copy")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out: dict[str, list] = {"doc_id": as_list(b.column(0)), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for body, rid, answered, copy in zip(*(as_list(b.column(k)) for k in (1, 2, 3, 4)), strict=True):
                text = whole(body)
                runs = [(0, len(text))] * (len(text) >= LENGTH) if copy else removed_runs(text, rid, answered) if answered else []
                pieces, last = [], 0
                for s, e in runs:
                    pieces.append(text[last:s])
                    last = e
                kept = b"".join([*pieces, text[last:]])
                for name, x in (("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("n_spans", len(runs)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept)):
                    out[name].append(x)
            kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
            names = list(kinds) if with_text else list(kinds)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=kinds[n]) for n in names], names=names)

    return joined.mapInArrow(remove, schema)
