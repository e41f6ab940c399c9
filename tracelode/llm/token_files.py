"""Token ids as flat binary files with 64-bit offsets, and reading them back through a memory map.

Layout of one data set, a folder with three files a partition and a manifest:

* ``part-00000.ids``  unsigned little-endian ids (uint16 where the vocabulary allows it, else uint32);
* ``part-00000.off``  uint64 offsets of its documents in that file, one more than documents;
* ``part-00000.doc``  int64 document ids, null ids (which sort first) as zeros counted in the manifest;
* ``manifest.json``   dtype, end id, and for each partition its counts and its base: the prefix sum of the
  ids in all partitions before it, so that base + offset is a document's place in the whole corpus.

Partitions are ranges of doc_id, sorted inside, so the files in order hold the documents in ascending order.
A task writes under a name of its own and renames at its end: an attempt that is lost or repeated leaves the
same bytes.  The driver sees one row a partition.

Defined cases: a null or empty text is one end id; documents with equal ids are ordered by text; null ids come first; texts of any
length are encoded whole; of other columns than doc_id and text none is read, whatever it is called.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import new_path, partitions, texts

#: White-space chunks whose ids a worker remembers in each of two generations; about 200 bytes each.
CACHE_WORDS = 700_000
#: Chunks that go to the library in one call, and in one string of it.
SLICE, JOINED = 16_000, 1_000
#: Bytes of texts whose chunks are told apart at once; a batch that has more is taken by itself.
GATHERED = 4 << 20
#: Letters that every composing normaliser leaves alone but for case, each a character for itself; a chunk of them and ASCII symbols but apostrophes.
LETTERS = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)))
_WORD = re.compile(f"([{LETTERS}]*)([!-&(-/:-@\\[-`{{-~]*)").fullmatch
_SUMMARY = "part long, n_docs long, n_null long, n_tokens long"


def drops_white_space(tokenizer) -> bool:
    """Whether the ids of a text are those of its chunks between ASCII white space, in order.

    That holds if the normaliser works on single characters (or composes them, which ASCII white space stops), and the
    pre-tokenizer first takes matches of a pattern and removes all else, where no match holds white space; the pattern is tried on
    every white-space character between any two of some letters, digits and all ASCII punctuation.  A tokenizer whose parts aren't known to do so encodes whole texts.
    """
    made = json.loads(tokenizer.to_str())

    def parts(step: dict | None, inner: str) -> list[dict]:
        return [] if step is None else [x for s in step[inner] for x in parts(s, inner)] if step["type"] == "Sequence" else [step]

    normal, split = parts(made["normalizer"], "normalizers"), parts(made["pre_tokenizer"], "pretokenizers")
    plain = all(n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ") for n in normal)
    taken = bool(split) and split[0]["type"] == "Split" and split[0]["behavior"] == "Removed" and split[0]["invert"]
    apart = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] for s in split[1:])
    if not (plain and taken and apart) or made["post_processor"] and made["post_processor"]["type"] not in ("RobertaProcessing", "TemplateProcessing", "BertProcessing"):
        return False
    if any(c.isspace() for t in tokenizer.get_added_tokens_decoder().values() for c in t.content):
        return False
    sides = [*"aZ7", *(chr(c) for c in range(33, 127) if not chr(c).isalnum())]
    probe = "".join(f"{a}{w}{b}" for w in " \t\n\x0b\x0c\r" for a in sides for b in sides)
    return all(not any(c.isspace() for c in probe[s:e]) for _, (s, e) in tokenizer.pre_tokenizer.pre_tokenize_str(probe))


def takes_words(tokenizer) -> bool:
    """Whether the model of a tokenizer that drops white space gets each chunk of letters and then ASCII symbols as two pre-tokens,
    the run of letters (in lower case if the normaliser makes it so) and the run of symbols, and no special token is in such a chunk.

    That holds if the pattern's alternatives are runs of letters, runs of what is neither letter, number nor white space, single
    numbers, and contractions, which begin with an apostrophe; no such chunk has one.
    """
    made = json.loads(tokenizer.to_str())
    steps, model = made["pre_tokenizer"].get("pretokenizers", []), made["model"]
    if len(steps) != 2 or steps[0]["type"] != "Split" or steps[1]["type"] != "ByteLevel" or steps[1]["use_regex"] or model["type"] != "BPE" or model["dropout"]:
        return False
    parts = {re.sub(r"^\[(\\p\{[LN]\})\]", r"\1", p) for p in steps[0]["pattern"].get("Regex", "").split("|")}
    known = {r"\p{L}+", r"[^\s\p{L}\p{N}]+"}
    if not known <= parts or any(p != r"\p{N}" and not re.fullmatch("'[a-z]+", p) for p in parts - known):
        return False
    normal = tokenizer.normalizer
    kept = LETTERS if normal is None else normal.normalize_str(LETTERS)
    return kept in (LETTERS, LETTERS.lower()) and not any(_WORD(t.content) for t in tokenizer.get_added_tokens_decoder().values())


class ChunkEncoder:
    """Encodes texts with the tokenizers library; each distinct white-space chunk once if the tokenizer drops white space.

    Chunks are told apart by Arrow, many texts at a time.  Of a chunk of letters and symbols the library's model gets the letters and the
    symbols, without the normaliser and the pattern that would leave them as they are.  Other chunks go to the library many in one
    string, with a separator between them that is a token of its own.
    """

    SEPARATOR = "\x01"

    def __init__(self, path: str, end_id: int = 0, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.in_chunks = drops_white_space(self.tokenizer)
        self.in_words = self.in_chunks and takes_words(self.tokenizer)
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        normal = self.tokenizer.normalizer
        self.lowers = normal is not None and normal.normalize_str("AZ") == "az"
        self.model = self.tokenizer.model
        if self.in_words:
            self.written = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS if not c.isascii()}
            size, data = self.dtype.itemsize, np.arange(max(self.tokenizer.get_vocab().values()) + 1, dtype=self.dtype).tobytes()
            self.id_bytes = [data[at : at + size] for at in range(0, len(data), size)]
            specials = "".join(f"|(?i:{re.escape(t.content)})" for t in self.tokenizer.get_added_tokens_decoder().values())
            self.odd = rf"[\x{{300}}-\x{{36f}}]|[^0-9\s{LETTERS}][.,][ \n]{specials}"
        alone = self.tokenizer.encode(f"a {self.SEPARATOR} a", add_special_tokens=False).ids
        self.separator = alone[1] if len(alone) == 3 and alone[0] == alone[2] else None

    def _alone(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as bytes."""
        if self.separator is None:
            return self._alone(chunks)
        mark = self.SEPARATOR
        if any(mark in c for c in chunks):
            own = {c: ids for c in chunks if mark in c for ids in self._alone([c])}
            others = [c for c in chunks if c not in own]
            own.update(zip(others, self.ids_of(others), strict=True))
            return [own[c] for c in chunks]
        out: list[bytes] = []
        parts = [chunks[at : at + JOINED] for at in range(0, len(chunks), JOINED)]
        found = self.tokenizer.encode_batch_fast([f" {mark} ".join(part) for part in parts], add_special_tokens=False)
        for part, e in zip(parts, found, strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) != len(part) - 1:
                out += self._alone(part)
                continue
            size, data = self.dtype.itemsize, ids.tobytes()
            starts, ends = [0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(data)]
            out += [data[s:t] for s, t in zip(starts, ends, strict=True)]
        return out

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks that aren't known; of words of letters and of runs of symbols by the model alone."""
        whole = chunks
        if self.in_words:
            tokens, written, as_bytes = self.model.tokenize, self.written, self.id_bytes
            whole = []
            for c in chunks:
                if _WORD(c):
                    self.known[c] = b"".join([as_bytes[t.id] for t in tokens(c if c.isascii() else c.translate(written))])
                else:
                    whole.append(c)
        for at in range(0, len(whole), SLICE):
            part = whole[at : at + SLICE]
            self.known.update(zip(part, self.ids_of(part), strict=True))

    def ids_of_distinct(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of some distinct chunks, most of which are known."""
        found = list(map(self.known.get, chunks))
        missed: list[tuple[int, str, str]] = []  # (place, chunk or its letters, its symbols)
        for at, f in enumerate(found):
            if f is None:
                m = _WORD(chunks[at]) if self.in_words else None
                missed.append((at, m[1].lower() if self.lowers else m[1], m[2]) if m else (at, chunks[at], ""))
        wanted = {w for _, w, _ in missed} | {s for _, _, s in missed if s}
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > self.cache_words:
            self.older, self.known, new = self.known, {}, wanted
        # what the generation before knew moves on; the rest of it is forgotten with the next one
        older = self.older
        old = [w for w in new if w in older]
        self.known.update((w, older.pop(w)) for w in old)
        self.learn(list(new.difference(old)))
        get = self.known.__getitem__
        for at, w, s in missed:
            found[at] = get(w) + get(s) if s else get(w)
        return found

    def eased(self, batch: pa.Array) -> pa.Array:
        """Texts with the same ids and fewer different chunks: ASCII in lower case if the normaliser makes it so, and white space before
        the full stop or comma that ends a chunk.  Left as they are: texts with a mark that may be composed with a letter (a caron
        with j, but not with J), with such a stop behind what may be a symbol (a pre-token with it), or with a special token in any case."""
        if not self.in_words:
            return batch
        eased = pc.ascii_lower(batch) if self.lowers else batch
        for stop in (". ", ", ", ".\n", ",\n"):
            eased = pc.replace_substring(eased, stop, f" {stop}")
        return pc.if_else(pc.match_substring_regex(batch, self.odd), batch, eased)

    def encode(self, batch: pa.Array, end: list[int]) -> Iterator[np.ndarray]:
        """The ids of each text and the end ids behind it."""
        if not self.in_chunks:
            for e in self.tokenizer.encode_batch_fast(batch.to_pylist(), add_special_tokens=False):
                yield np.array([*e.ids, *end], self.dtype)
            return
        cut = pc.ascii_split_whitespace(self.eased(batch))
        chunks = cut.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = pa.array(self.ids_of_distinct(distinct), pa.large_binary()).take(chunks.indices)
        _, offsets, data = found.buffers()
        ends = (np.frombuffer(offsets, np.int64, len(found) + 1, found.offset * 8)[cut.offsets.to_numpy()] // self.dtype.itemsize).tolist() if len(found) else [0] * (len(cut) + 1)
        ids = np.frombuffer(data, self.dtype, ends[-1]) if ends[-1] else np.empty(0, self.dtype)
        last = np.array(end, self.dtype)
        for start, to in pairwise(ends):
            yield np.concatenate([ids[start:to], last])


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The ids and texts of batches, of as many at once as have size bytes."""
    held: list[pa.RecordBatch] = []
    joined = lambda: tuple(pa.concat_arrays([h.column(i) for h in held]) for i in range(2))
    for b in batches:
        if held and b.nbytes + sum(h.nbytes for h in held) > size:
            yield joined()
            held = []
        held.append(b)
    if held:
        yield joined()


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> ChunkEncoder:
    """One encoder a worker process: its tokenizer is loaded once, and its chunks serve later tasks."""
    return ChunkEncoder(path, end_id)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> str:
    """Encode docs in ascending doc_id order into a new data set; returns its folder."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1])
    arrow = pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64())])

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        encoder = encoder_of(tokenizer_path, end_id)
        name = f"{root}/part-{task.partitionId():05d}"
        own = f"{name}.{task.taskAttemptId()}.tmp"
        docs_in, sizes = [], [0]
        with fs.open_output_stream(f"{own}.ids") as out:
            for ids_in, texts_in in gathered(batches, GATHERED if encoder.in_chunks else 0):
                docs_in += ids_in.to_pylist()
                for ids in encoder.encode(texts_in, [end_id]):
                    sizes.append(len(ids))
                    out.write(ids.tobytes())
        offsets = np.cumsum(np.array(sizes, "<u8"), dtype="<u8")
        for kind, data in (("off", offsets), ("doc", np.array([d or 0 for d in docs_in], "<i8"))):
            with fs.open_output_stream(f"{own}.{kind}") as out:
                out.write(data.tobytes())
        for kind in ("ids", "off", "doc"):
            fs.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "n_docs": len(docs_in), "n_null": docs_in.count(None), "n_tokens": int(offsets[-1])}], schema=arrow)

    ranged = texts(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted((r.asDict() for r in ranged.mapInArrow(write_part, _SUMMARY).collect()), key=lambda r: r["part"])  # one row a partition
    for p, base in zip(parts, accumulate([0, *(p["n_tokens"] for p in parts)]), strict=False):
        p["base"] = base
    dtype = encoder_of(tokenizer_path, end_id).dtype
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype.name, "end_id": end_id, "parts": parts}).encode())
    return folder


def manifest(folder: str) -> dict:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def load(folder: str, part: int, kind: str, dtype: str) -> np.ndarray:
    """One file as an array: mapped where the folder is a local or mounted one, else read."""
    fs, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/part-{part:05d}.{kind}"
    size = fs.get_file_info(path).size
    if not size:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    made = manifest(folder)
    dtype = np.dtype(made["dtype"]).newbyteorder("<")
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                ids, off, doc = (load(folder, p["part"], k, t) for k, t in (("ids", dtype), ("off", "<u8"), ("doc", "<i8")))
                off = off.astype(np.int64)
                for at in range(0, len(doc), 10_000):
                    to = min(at + 10_000, len(doc))
                    crc = [zlib.crc32(ids[off[i] : off[i + 1]].astype("<u4").tobytes()) for i in range(at, to)]
                    docs = pa.array(doc[at:to], mask=np.arange(at, to) < p["n_null"])
                    yield pa.RecordBatch.from_arrays([docs, pa.array(off[at:to] + p["base"]), pa.array(off[at + 1 : to + 1] - off[at:to]), pa.array(crc, type=pa.int64())], schema=arrow)

    schema = "part long, n_docs long, n_null long, n_tokens long, base long"
    parts = spark.createDataFrame([tuple(p[c.split()[0]] for c in schema.split(", ")) for p in made["parts"]], schema)
    return parts.repartition(max(1, len(made["parts"])), "part").mapInArrow(read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")
