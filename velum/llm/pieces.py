"""Piece vocabularies: reading the model file, cutting texts where no piece can reach across, and keeping results.

A piece never has two neighbouring characters that are neighbours in no piece of the vocabulary. So a text may be cut
there: neither a merge nor a piece spans the cut, and the parts are encoded on their own. The cuts used are those
around words (runs of the characters that pieces connect with the letter "a") and before the word mark.
"""

from __future__ import annotations

import re
from collections.abc import Callable

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts of texts whose result a task keeps, in each of two generations; longer parts aren't kept.
CACHED, CACHED_LENGTH = 150_000, 48


class Pieces:
    """A vocabulary with byte fallback and without text normalization."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        n = proto.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only vocabularies with byte fallback and the identity normalization are supported")
        kinds = {p.type for p in proto.pieces}
        if kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("user-defined and unused pieces aren't supported")
        self.dummy_prefix = n.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.end_id = next(i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece)
        self.characters = {c for p in self.ids for c in p}
        self.longest = max(map(len, self.ids))
        self._cut = self._cutter()

    def _cutter(self) -> re.Pattern:
        joined: dict[str, set[str]] = {}
        inside = False
        for p in self.ids:
            inside |= SPACE in p.lstrip(SPACE)
            q = p.lstrip(SPACE)
            for a, b in zip(q, q[1:], strict=False):
                joined.setdefault(a, set()).add(b)
                joined.setdefault(b, set()).add(a)
        if inside:
            return re.compile(r"(?s).+")
        reached, todo = set(), ["a"]
        while todo:
            c = todo.pop()
            if c not in reached:
                reached.add(c)
                todo += joined.get(c, ())
        word = "".join(re.escape(c) for c in sorted(reached))
        return re.compile(f" *[{word}]+| *[^{word} ]+| +")

    def cut(self, text: str) -> list[str]:
        """The parts of a text. Spaces and word marks, which are the same, are spaces in them."""
        if not text:
            return []
        return self._cut.findall((" " if self.dummy_prefix else "") + text.replace(SPACE, " "))

    def fallback(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")]


class Kept(dict):
    """Results of ``make`` by part. When a generation is full, the one before it is dropped, and what is asked for again
    moves on into the new one: frequent parts stay."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, part: str):
        made = self.old.get(part)
        if made is None:
            made = self.make(part)
            if len(part) > CACHED_LENGTH:
                return made
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[part] = made
        return made
