"""Token ids of whole texts with the tokenizers library, word by word from a cache.

Both vocabularies split a text so that no token spans the gap between a non-space and the space after it. A text
can therefore be encoded in units, a word with the space before it, and the ids of a unit do not depend on its
neighbours. Units seen before come from a dictionary; a new one of letters with marks behind it goes straight to
the library's merges, any other through its whole path. Texts with white space other than single spaces and line
ends inside are encoded whole. The ids equal those of one whole call.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

CACHED = 500_000
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_MADE: dict = {}


class _Units(dict):
    """ids of units as bytes, made when first asked for. At half of CACHED the units become the old half and the former one goes."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids

    def turn(self) -> None:
        if len(self) > CACHED // 2:
            self.old = dict(self)
            self.clear()


class Encoder:
    """ids of texts as little-endian bytes, two per id. `spaces`: the vocabulary keeps white space in its tokens."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        self.spaces = spaces
        self.merge = self.whole.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(0xC0, 0x100)])}
        self.marks = _Units(self.one)
        self.inner = _Units(lambda w: self._unit(w, " " if spaces else "", "Ġ" if spaces else ""))
        self.outer = _Units(lambda w: self._unit(w, "", "")) if spaces else self.inner
        self.line = self.one("\n") if spaces else b""

    def one(self, text: str) -> bytes:
        """A whole text through the library."""
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _unit(self, word: str, space: str, mapped: str) -> bytes:
        found = _PLAIN.fullmatch(word)
        if not found:
            return self.one(space + word) if word else b""
        letters, marks = found.groups()
        if not self.spaces:
            letters = letters.lower()
        if not letters.isascii():
            letters = letters.translate(self.letters)
        ids = array("H", [t.id for t in self.merge(mapped + letters)]).tobytes()
        return ids + self.marks[marks] if marks else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        for known in (self.inner, self.outer, self.marks):
            known.turn()
        start, inside, line = self.outer.__getitem__, self.inner.__getitem__, self.line
        out = []
        for text in texts:
            if not self.spaces:  # split() alone takes four signs as white space
                plain = not any(c in text for c in "\x1c\x1d\x1e\x1f")
                out.append(b"".join(map(inside, text.split())) if plain else self.one(text))
                continue
            led = text[:1] == " "
            lines = text[led:].split("\n")
            # In printable lines the plain space is the only white space.
            if "  " in text or " \n" in text or "\n " in text or text[-1:] == " " or not all(lines) or not all(map(str.isprintable, lines)):
                out.append(self.one(text) if text else b"")
                continue
            lines = [x.split(" ") for x in lines]
            if led:
                lines[0].insert(0, "")
            out.append(line.join([start(x[0]) + b"".join(map(inside, x[1:])) for x in lines]))
        return out


def encoder(path: str, spaces: bool) -> Encoder:
    """One encoder per worker process, kept with its cache from task to task."""
    if (path, spaces) not in _MADE:
        _MADE[path, spaces] = Encoder(path, spaces)
    return _MADE[path, spaces]


def encoded(path: str, spaces: bool, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text; null is empty."""
    for ids in encoder(path, spaces).encode([t or "" for t in texts]):
        yield np.frombuffer(ids, "<u2").astype("<u4")
