"""Cutting texts where a byte-level tokenizer cuts too, so that encoded parts can be kept.

Texts of ASCII, the Latin letters to U+017F and typographic punctuation are cut
into the words of the splitting pattern, all of a batch at once; each distinct
word is looked up once for a batch.  Others are cut at spaces: a single space between two characters that are no white space always starts a
new word of the splitting pattern.  A text whose only white space is single
spaces and line feeds that don't touch is cut there, and each distinct piece is
encoded once.  Any other text is encoded whole.  What is kept is bounded in number and
length, so in bytes: some 160 for each piece or word of usual length.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import text_buffer

#: Characters of the longest piece that is kept.
LONGEST = 64
END_OF_TEXT = "<|endoftext|>"
_ASCII_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_ODD = re.compile("[\x85\xa0 ᠎ -‏    ⁠　﻿]")


def pieces(text: str) -> list[str] | None:
    """The parts between spaces, or None if cutting there isn't safe."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or END_OF_TEXT in text:
        return None
    if any(c in text for c in _ASCII_ODD) or not text.isascii() and _WIDE_ODD.search(text):
        return None
    return text.split(" ")


_MARKS = frozenset(".,;:!?")


class _Kept(dict):
    """Pieces after ``before`` and their encodings; ``bare`` keeps those that follow nothing."""

    def __init__(self, encode: Callable[[str], bytes], before: str, bare: _Kept | None = None):
        self.encode, self.before, self.bare = encode, before, self if bare is None else bare
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        """Start anew; what was kept stays at hand until the next time."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return self.encode(self.before + piece)
        if (known := self.older.pop(piece, None)) is not None:
            self[piece] = known
            return known
        if "\n" in piece and "\n\n" not in piece and len(piece) > 1:
            # A single line feed is a word of its own, and the next word starts without a space.
            head, *lines = piece.split("\n")
            out = self[head] + b"".join([self.bare["\n"] + self.bare[line] for line in lines])
        elif piece[-1:] in _MARKS and piece[-2:-1].isalpha():
            # So is a mark after a letter; the rest may be known already.
            out = self[piece[:-1]] + self.bare[piece[-1]]
        else:
            out = self.encode(self.before + piece)
        self[piece] = out
        return out


class PieceCache:
    """The bytes that ``encode`` gives for a text, from kept pieces where that is safe.

    ``encode_piece`` gives the same for one piece, if there is a shorter way.  Beyond ``most`` pieces those that have not been used since the last time go.
    An instance serves a worker process, over all its tasks.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = 700_000, encode_piece: Callable[[str], bytes] | None = None):
        self.encode_whole, self.most = encode, most
        self.first = _Kept(encode_piece or encode, "")
        self.later = _Kept(encode_piece or encode, " ", self.first)

    def encode(self, text: str) -> bytes:
        cut = pieces(text)
        if cut is None:
            return self.encode_whole(text)
        if len(self.first) + len(self.later) > self.most:
            self.first.age()
            self.later.age()
        return b"".join([self.first[cut[0]], *map(self.later.__getitem__, cut[1:])])


_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
#: What the pattern takes each byte for; the later bytes of a letter are letters too.
_KINDS = np.array([
    _SPACE if b in b"\t\n\v\f\r " else _ODD if 0x1C <= b < 0x20 else _DIGIT if 48 <= b < 58
    else _LETTER if chr(b).isalpha() and b < 0x80 or 0x80 <= b < 0xC0 or 0xC3 <= b < 0xC6
    else _OTHER if b < 0x80 or b == 0xE2 else _ODD for b in range(256)
], np.uint8)
_END = re.compile(re.escape(END_OF_TEXT).encode())


def _after(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The bytes ``k`` behind those at ``at``; zero behind the end."""
    return np.where(at + k < len(data), data[np.minimum(at + k, len(data) - 1)], 0)


def odd_texts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text has what ``word_starts`` doesn't know: other characters, or a token that is none of its words."""
    bad = [np.flatnonzero(_KINDS[data] == _ODD)]
    # The signs of multiplication and division are no letters.
    signs = np.flatnonzero((data == 0x97) | (data == 0xB7)) - 1
    bad.append(signs[data[signs] == 0xC3])
    wide = np.flatnonzero(data == 0xE2)
    last = _after(data, wide, 2)
    bad.append(wide[(_after(data, wide, 1) != 0x80) | (last < 0x90) | (last > 0xA7)])
    bad.append(np.array([m.start() for m in _END.finditer(data)], np.int64))
    out = np.zeros(len(bounds) - 1, bool)
    out[np.searchsorted(bounds, np.concatenate(bad), side="right") - 1] = True
    return out


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words of the splitting pattern start, in texts that aren't odd; each reaches to the next one."""
    if not len(data):
        return np.zeros(0, np.int64)
    kinds = _KINDS[data]
    wide = np.flatnonzero(data == 0xE2)
    kinds[wide + 1] = kinds[wide + 2] = _OTHER
    first, texts = bounds[:-1][np.diff(bounds) > 0], bounds[1:-1]
    texts = texts[(texts > 0) & (texts < len(data))]
    starts, space = np.ones(len(data), bool), kinds == _SPACE
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    # The last of white space is a word apart, or joins the next word if it is a space.
    ends = space[:-1] & ~space[1:]
    ends[texts - 1] = False
    starts[:-1] |= ends
    starts[1:] &= ~(ends & (data[:-1] == 32))
    starts[first] = True
    marks = np.flatnonzero(data == 39)
    marks = marks[starts[marks]]
    if len(marks):
        left = bounds[np.searchsorted(bounds, marks, side="right")] - marks
        one, two = _after(data, marks, 1), _after(data, marks, 2)
        long = (left > 2) & ((two == 101) & ((one == 114) | (one == 118)) | (two == 108) & (one == 108))
        short = (left > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        starts[marks[short | long] + 1] = False
        ends = np.concatenate([marks[short] + 2, marks[long] + 3])
        starts[ends[ends < len(data)]] = True
    return np.flatnonzero(starts)


class WordCache:
    """The bytes that an encoding gives for each text of a column, from kept words where that is safe.

    ``encode_words`` gives those of words (None: no text is cut), ``odd`` those of
    a text that isn't cut into words.  Beyond ``most`` words those that have not been used since the
    last time go.  An instance serves a worker process, over all its tasks.
    """

    def __init__(self, encode_words: Callable[[list[bytes]], list[bytes]] | None, odd: Callable[[str], bytes], most: int = 500_000):
        self.encode_words, self.odd, self.most = encode_words, odd, most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _of(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        out = list(map(self.known.get, words))
        new = [k for k, found in enumerate(out) if found is None]
        for k in new:
            if (found := self.older.pop(words[k], None)) is not None:
                out[k] = self.known[words[k]] = found
        new = [k for k in new if out[k] is None]
        for k, found in zip(new, self.encode_words([words[k] for k in new])):
            out[k] = found
            if len(words[k]) <= LONGEST:
                self.known[words[k]] = found
        return out

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """A null text counts as empty."""
        if self.encode_words is None:
            return [self.odd(t or "") for t in column.to_pylist()]
        data, bounds = text_buffer(column)
        odd = odd_texts(data, bounds)
        if odd.any():
            whole = iter([self.odd(t) for t in column.filter(pa.array(odd)).to_pylist()])
            plain = iter(self.encode_column(column.filter(pa.array(~odd))))
            return [next(whole if x else plain) for x in odd]
        starts = word_starts(data, bounds)
        if not len(starts):
            return [b""] * len(column)
        offsets = np.append(starts, len(data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = pa.array(self._of(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        ids = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[np.searchsorted(starts, bounds)].tolist()
        whole = memoryview(found.buffers()[2])
        return [bytes(whole[a:b]) for a, b in zip(ids, ids[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.large_string()))[0]
