"""Reading a SentencePiece model file: its pieces, scores, normaliser and flags, from the protobuf's wire format."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

#: Fixed values of the model file: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The marker that stands for a space.
META = "▁"


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a message: ints for varints, floats for 32 bits, bytes for the rest."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            at += 8
            yield key >> 3, data[at - 8 : at]
        elif kind == 5:
            at += 4
            yield key >> 3, struct.unpack("<f", data[at - 4 : at])[0]
        elif kind == 2:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]
        else:
            raise ValueError(f"wire type {kind} in a model file")


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls([], [], [])
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                m.pieces.append(piece.get(1, b"").decode())
                m.scores.append(piece.get(2, 0.0))
                m.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(fields(value))
                m.model_type, m.byte_fallback, m.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            elif number == 3:
                spec = dict(fields(value))
                m.charsmap = spec.get(2, b"")
                m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return m

    def unigram_scores(self) -> dict[str, float]:
        """Log probabilities of the pieces that text can hold.

        A unigram model's file states them.  A BPE model's states merge ranks; its pieces then get Zipf's law of
        their rank, log(1 / (rank + 2)) up to a constant.
        """
        kept = [(p, s) for p, s, t in zip(self.pieces, self.scores, self.types, strict=True) if t in (NORMAL, USER_DEFINED)]
        if self.model_type == UNIGRAM:
            return dict(kept)
        total = math.log(sum(1 / (k + 2) for k in range(len(kept))))
        return {p: -math.log(k + 2) - total for k, (p, _) in enumerate(sorted(kept, key=lambda x: -x[1]))}
