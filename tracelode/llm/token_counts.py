"""Token counts by a unigram model, with the dynamic programme shared along a trie of distinct pre-tokens.

A text is normalised as the model says (character map, marker for spaces, dummy prefix) and cut in pre-tokens before each
marker and around line feeds, where no piece spans such a place.  A pre-token's segmentation is the sequence of pieces of the
highest total score, of equal scores the one whose last piece is longest; a character in no piece costs ``UNKNOWN_PENALTY`` below the lowest score and is
a token for each of its UTF-8 bytes (one for each run of such characters where the model has no byte fallback).

The forward score of a prefix depends on nothing after it.  Distinct pre-tokens are inserted in a trie whose nodes keep
the forward score and the count, so that a prefix which pre-tokens share is computed once, in whatever batch or task of the worker they
come; the count at a pre-token's last node is kept as its terminal count.

Scale: one pass without a shuffle.  A worker holds the counts of at most ``CACHE_WORDS`` pre-tokens and a trie of at most
``CACHE_NODES`` nodes (about 200 bytes each; a full trie is begun anew, with the same results); pre-tokens of over
``STORED_LENGTH`` characters are computed without being stored.

Defined cases: null and empty texts have no tokens; white space beyond single spaces counts as the model writes it; equal rows
get equal counts; of other columns than doc_id and text none is read, whatever it is called.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_batches, texts
from .sentencepiece_codec import Normaliser
from .sentencepiece_model import Model

CACHE_WORDS, CACHE_NODES = 400_000, 1_200_000
STORED_LENGTH = 64
#: What an unknown character costs below the lowest score.
UNKNOWN_PENALTY = 10.0


class TrieCounter:
    def __init__(self, scores: dict[str, float], bytes_for_unknown: bool = True, cache_words: int = CACHE_WORDS, cache_nodes: int = CACHE_NODES):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes_for_unknown = bytes_for_unknown
        self.cache_words, self.cache_nodes = cache_words, cache_nodes
        self.known: dict[str, int] = {}
        #: scores that were computed, for tests of sharing
        self.computed = 0
        #: lengths of the pieces of three characters or more by their last three, longest first
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        self.clear()

    def clear(self) -> None:
        """An empty trie: its root has node number 0.  A child's key is its parent's number and its character's code point."""
        self.child: dict[int, int] = {}
        #: (forward score, tokens, whether an unknown character ends it) of each node
        self.values: list[tuple[float, int, bool]] = [(0.0, 0, False)]

    def terminals(self, words: list[str]) -> list[int]:
        """The count of each word, in order; words that follow one another in sorted order walk a common prefix once."""
        pieces, lengths, unknown, as_bytes = self.scores.get, self.lengths, self.unknown, self.bytes_for_unknown
        child, values = self.child, self.values
        before, nodes, path, out = "", [0], [values[0]], []
        for text in words:
            size, stored = len(text), len(text) <= STORED_LENGTH
            if stored and len(values) + size > self.cache_nodes:
                self.clear()
                child, values = self.child, self.values
                before, nodes, path = "", [0], [values[0]]
            at = 0
            for a, b in zip(before, text, strict=False):
                if a != b:
                    break
                at += 1
            del nodes[at + 1 :], path[at + 1 :]
            node = nodes[-1]
            for i in range(at + 1, size + 1):
                c = text[i - 1]
                key = node << 21 | ord(c)
                found = child.get(key) if stored else None
                if found is None:
                    self.computed += 1
                    best, end = None, None
                    # longer ones first, so that of equal scores the longest last piece stays
                    for n in lengths.get(text[i - 3 : i], ()) if i > 2 else ():
                        if n <= i:
                            s = pieces(text[i - n : i])
                            if s is not None:
                                start = path[i - n]
                                s += start[0]
                                if best is None or s > best:
                                    best, end = s, (s, start[1] + 1, False)
                    s = pieces(text[i - 2 : i]) if i > 1 else None
                    if s is not None:
                        start = path[i - 2]
                        s += start[0]
                        if best is None or s > best:
                            best, end = s, (s, start[1] + 1, False)
                    score, count, after_unknown = path[i - 1]
                    s = pieces(c)
                    if s is not None:
                        s += score
                        if best is None or s > best:
                            end = (s, count + 1, False)
                    else:  # an unknown character stands by itself
                        score += unknown
                        if best is None or score > best:
                            end = (score, count + (len(c.encode()) if as_bytes else not after_unknown), True)
                    if stored:
                        node = child[key] = len(values)
                        values.append(end)
                else:
                    node, end = found, values[found]
                nodes.append(node)
                path.append(end)
            out.append(path[size][1])
            # a word that isn't stored leaves no nodes to go on from
            before = text if stored else ""
            if not stored:
                nodes, path = [0], [values[0]]
        return out

    def counts(self, batch: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens."""
        new = {w for words in batch for w in words}.difference(self.known)
        if len(self.known) + len(new) > self.cache_words:
            self.known = {}
            new = {w for words in batch for w in words}
        fresh = sorted(new)
        self.known.update(zip(fresh, self.terminals(fresh), strict=True))
        get = self.known.__getitem__
        out = [sum(map(get, words)) for words in batch]
        for w in fresh:
            if len(w) > STORED_LENGTH:
                del self.known[w]
        return out


@lru_cache(maxsize=1)
def counter_of(path: str, cache_words: int) -> tuple[Normaliser, TrieCounter]:
    """One counter a worker process, so that later tasks find its pre-tokens."""
    model = Model.load(path)
    return Normaliser(model), TrieCounter(model.unigram_scores(), model.byte_fallback, cache_words)


def count_tokens(docs: DataFrame, model_path: str, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_words (runs of other characters than white space) and n_tokens of every document."""

    def run(c: dict) -> dict:
        normaliser, counter = counter_of(model_path, cache_words)
        return {"doc_id": c["doc_id"], "n_words": [len(t.split()) for t in c["text"]], "n_tokens": counter.counts([normaliser.chunks(t.decode()) for t in c["text"]])}

    return map_batches(texts(docs), run, "doc_id long, n_words long, n_tokens long")
