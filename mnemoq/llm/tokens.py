"""Ids of whole texts by a byte-level BPE file of the tokenizers library, with pieces looked up once.

Byte-level BPE never merges across the pieces its split makes, and a single space between two other
characters always starts a new piece; so a text can be cut there, and equal cuts have equal ids. Cuts
are encoded by the library once and kept in dicts of bounded size, cleared when they are full. Texts
that offer no such cuts (white space doubled, or at either end of a line) are encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class NotAlone(Exception):
    """A part whose ids depend on what is around it."""


class Parts(dict):
    """From a word to its ids, as they are after `before` (a space, or nothing)."""

    def __init__(self, owner: Encoder, before: str):
        self.owner, self.before = owner, before

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise NotAlone
        if word.isalpha():
            ids = self.owner.piece(self.before + word)
        else:
            at = len(word)
            while at and not word[at - 1].isalnum():
                at -= 1
            if 0 < at < len(word) and word[at - 1].isalpha() and not any(map(str.isspace, word[at:])):
                ids = self[word[:at]] + self.owner.marks[word[at:]]  # marks after a letter are a piece of their own
            else:
                ids = self.owner.plain(self.before + word)
        self[word] = ids
        return ids


class Marks(dict):
    """From marks that follow a letter to their ids."""

    def __init__(self, owner: Encoder):
        self.owner = owner

    def __missing__(self, marks: str) -> bytes:
        ids = self[marks] = self.owner.piece(marks)
        return ids


class Encoder:
    def __init__(self, path: str, keep: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        # the cuts below are those of this split and of no other; with any other one texts are encoded whole
        split = parts["pre_tokenizer"] or {}
        self.cuts = parts["normalizer"] is None and parts["model"]["type"] == "BPE" and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.keep = keep
        self.after_space, self.first, self.marks = Parts(self, " "), Parts(self, ""), Marks(self)
        # byte-level models spell bytes that don't print as characters from 256 on, in the bytes' order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.spelling = {b: 256 + i for i, b in enumerate(hidden)}
        self.space = chr(self.spelling[ord(" ")])
        self.line_break = self.plain("\n")

    def piece(self, text: str) -> bytes:
        """The ids of a text that the split leaves whole, from the library's model alone: the split is the slower part."""
        if text.isascii() and text.isprintable():
            spelt = text.replace(" ", self.space)
        else:
            spelt = text.encode().decode("latin-1").translate(self.spelling)
        return self.packed([t.id for t in self.model.tokenize(spelt)])

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def plain(self, text: str) -> bytes:
        """The library's ids of a text, as bytes."""
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def _by_parts(self, text: str) -> bytes:
        get, lines = self.after_space.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.first[words[0]] + b"".join(map(get, words[1:])))
        return self.line_break.join(lines)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian."""
        out = []
        for t in texts:
            if len(self.after_space) + len(self.first) + len(self.marks) > self.keep:
                self.after_space.clear()
                self.first.clear()
                self.marks.clear()
            try:
                out.append(self.plain(t) if not self.cuts or any(s in t for s in self.special) else self._by_parts(t) if t else b"")
            except NotAlone:
                out.append(self.plain(t))
        return out


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept across its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
