"""Encoding of whole texts with caches around the tokenizers library.

The library spends its time on words it has seen before. A text is cut where its pre-tokenizer always has a
boundary, and the pieces are looked up. A piece that is new is split into words, by the library's own normalizer and
pre-tokenizer or, if it is ASCII, by the same pattern; the library's model encodes words not seen yet. The cut never
changes a result:

* ``white``: the tokenizer drops white space, so no token spans it, and every run of white space is a boundary.
* ``space``: byte-level pre-tokenization starts a new piece at a space before a character that is not white space.

A text with a white space character on which Python and the library might differ goes to the library whole, and so
does a piece that may hold the text of a special token.
"""

from __future__ import annotations

import gc
import re
import sys
from array import array

import numpy as np

#: Separators that only one of the two may take for white space.
ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2028\u2029\ufeff]")
WIDE_SPACE = re.compile(r" (?=\s|\Z)")
# --- fixed values: the patterns of the two pre-tokenizers over ASCII --------------
ASCII_WORDS = {
    "white": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+"),
    "space": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"),
}
# ----------------------------------------------------------------------------------
CACHED = 500_000
STALE = 4_000_000


def byte_letters() -> list[str]:
    """The letter that byte-level pre-tokenization writes for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


LETTERS = byte_letters()


class Cache(dict):
    """Fills itself. When it is full it keeps what came first, mostly the frequent keys, until many more were missed."""

    def __init__(self, make, most: int = CACHED):
        super().__init__()
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        else:
            self.missed += 1
            if self.missed > STALE:
                self.clear()
                self.missed = 0
        return value


class Encoder:
    """Encodes text to ids of the smallest unsigned type; one for each task."""

    def __init__(self, path: str, cut: str, cached: int = CACHED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        gc.set_threshold(200_000, 50, 100)  # tokens come and go by the million, and none is part of a cycle
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.type = np.dtype("<u2") if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        assert sys.byteorder == "little" and array(self.code).itemsize == self.type.itemsize
        self.cut, self.lower = cut, cut == "white"
        self.model, self.before, self.normal = self.library.model, self.library.pre_tokenizer, self.library.normalizer
        self.pieces, self.words = Cache(self.piece, cached), Cache(self.word, cached)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.heads = re.compile("|".join(re.escape(t[:2]) for t in added) or r"(?!)")
        self.longest_added = max((len(t.encode()) for t in added), default=0)
        self.spaced_added = any(any(map(str.isspace, t)) for t in added)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type)

    def word(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def piece(self, piece: str) -> bytes:
        if self.heads.search(piece):
            return self.whole(piece).tobytes()
        if piece.isascii():
            words = ASCII_WORDS[self.cut].findall(piece.lower() if self.lower else piece)
            if not piece.isprintable() or " " in piece:
                words = ["".join([LETTERS[b] for b in w.encode()]) for w in words]
        else:
            words = [w for w, _ in self.before.pre_tokenize_str(self.normal.normalize_str(piece) if self.normal else piece)]
        if self.cut == "space" and len(words) == 1 and len(self.pieces) < self.pieces.most:  # one of the caches has it
            return self.words.get(words[0]) or self.word(words[0])
        return b"".join(map(self.words.__getitem__, words))

    def cuts(self, text: str) -> list[str] | None:
        """Parts that encode independently; None if the text has to be taken whole."""
        if self.spaced_added or ODD.search(text):
            return None
        if self.cut == "white":
            return text.split()
        parts = text.split(" ")
        if not WIDE_SPACE.search(text):
            return [parts[0], *[" " + p for p in parts[1:]]]
        out = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace():
                out.append(" " + part)
            else:
                out[-1] += " " + part
        return out

    def encode(self, text: str) -> np.ndarray:
        parts = self.cuts(text)
        if parts is None:
            return self.whole(text)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, parts)), self.type)


def byte_table(library) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    back = {c: b for b, c in enumerate(LETTERS)}
    out = [b""] * library.get_vocab_size(with_added_tokens=True)
    for token, k in library.get_vocab(with_added_tokens=True).items():
        known = all(c in back for c in token)
        out[k] = bytes(back[c] for c in token) if known else token.encode()
    return out


class Numbers:
    """Decimal ids joined by commas, by table instead of one string a token."""

    def __init__(self, size: int):
        texts = [f"{k},".encode() for k in range(size)]
        self.length = np.array([len(t) for t in texts], np.uint8)
        width = int(self.length.max(initial=1))
        self.chars = np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(-1, width)
        self.used = np.arange(width) < self.length[:, None]

    def joined(self, ids: np.ndarray) -> bytes:
        return self.chars[ids][self.used[ids]][:-1].tobytes()
