"""A SentencePiece vocabulary and the units of a text in which pieces lie.

No piece spans a line feed, and a blank stands only at the start of a piece, so
a text falls into units (blanks with the characters up to the next blank or line
feed) whose piece lattices do not touch. Units repeat, so a task prepares each
distinct one once and remembers a bounded number of them.

The vocabulary file is read on the driver and shipped as bytes (its size is that
of one file); tokenizers are never trained here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import sentencepiece

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")


def model_bytes(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def units_of(text: str) -> list[str]:
    """The units of a text behind its dummy blank; none for the empty text."""
    return UNIT.findall(" " + text) if text else []


@dataclass
class Layout:
    """Units in one string with a gap in front of each; nodes are positions of it.

    A node's depth is its place in the unit; the gap, at depth 0, is the unit's
    start. The nodes of one depth are ``order[cuts[depth - 1]: cuts[depth]]``.
    """

    codes: np.ndarray  # characters
    escaped: np.ndarray  # the same with blanks as in pieces
    first: np.ndarray  # the gap of each unit
    lengths: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, units: list[str]) -> Layout:
        codes = np.frombuffer("".join(["\x00" + u for u in units]).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        first = np.cumsum(lengths + 1) - lengths - 1
        depth = np.arange(len(codes)) - np.repeat(first, lengths + 1)
        escaped = np.where(codes == ord(BLANK), np.uint32(0), np.where(codes == ord(" "), np.uint32(ord(BLANK)), codes))
        return cls(codes, escaped, first, lengths, depth)

    def by_depth(self):
        """The nodes of depth 1, 2, ..."""
        depth = self.depth.astype(np.uint16) if self.lengths.max() < 1 << 16 else self.depth
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, int(self.lengths.max()) + 2))
        return [order[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]


class Vocabulary:
    def __init__(self, model: bytes):
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [p.id_to_piece(i) for i in range(len(p))]
        self.byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(len(p)) if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i)}
        self.scores = {t: p.get_score(i) for i, t in enumerate(self.pieces) if i not in special}
        self.ids = {t: i for i, t in enumerate(self.pieces) if i not in special}
        if any(BLANK in t.lstrip(BLANK) or "\n" in t or " " in t for t in self.ids) or not all(p.is_byte(i) for i in self.byte_ids):
            raise ValueError("blanks must start a piece, line feeds be in none, and bytes be pieces")
        self.unknown_score = min(self.scores.values()) - 10.0  # fixed penalty of the public tokenizer
        self.surface = [b""] * len(p)
        for t, i in self.ids.items():
            self.surface[i] = t.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Enumerates all pieces in a string, by its characters."""
        a = ahocorasick.Automaton()
        for t, i in self.ids.items():
            a.add_word(t, i)
        a.make_automaton()
        return a

    def decode(self, ids) -> bytes:
        """The text of piece ids, without its dummy blank."""
        surface = self.surface
        return b"".join([surface[i] for i in ids])[1:]
