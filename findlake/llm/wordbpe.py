"""Encoding whole texts with a ``tokenizers`` file, each different word once.

The tokenizer file normalises, lower-cases and splits at white space before its merges, so no token
spans white space and the ids of a text are the ids of its words in a row. Words repeat; a bounded
cache keeps the packed ids of the recent ones, and only words that it lacks go to the library. Texts are
encoded many at a time: Arrow splits them, finds their different words and puts the ids of these in place.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from findlake.llm.warm import keep_warm

#: Latin blocks: in NFC already, with lower case that depends on one character only.
LATIN_END = 0x300
CACHE_WORDS = 150_000
LONGEST_CACHED = 48
#: Texts of so many characters are encoded together; a longer one by itself, and not by way of Arrow.
CHARS_AT_ONCE = 1 << 22
#: Packing of so many ids.
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _ranges(major: str) -> str:
    """A regex class body of the Latin characters whose Unicode category starts with ``major``."""
    out, start = [], None
    for c in range(LATIN_END + 1):
        inside = c < LATIN_END and unicodedata.category(chr(c)).startswith(major)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return "".join(out)


LETTERS, NUMBERS = _ranges("L"), _ranges("N")
#: The file's own split pattern, for a word of Latin characters without white space.
PIECE = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")
BEYOND_LATIN = re.compile(f"[{chr(LATIN_END)}-{chr(0x10FFFF)}]")
#: White space to ``str.split``, but not to the tokenizer's pattern.
SEPARATOR_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """``encode(text)``: the ids of the whole text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.alphabet = byte_alphabet()
        self.cache_words = cache_words
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in SEPARATOR_CONTROLS):
            return self._whole(text)
        return b"".join(self._words(text.split()))

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """``encode`` of each text."""
        out: list[bytes] = [b""] * len(texts)
        together: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > CHARS_AT_ONCE or any(c in text for c in SEPARATOR_CONTROLS):
                out[i] = self.encode(text)
                continue
            if size + len(text) > CHARS_AT_ONCE:
                self._together(texts, together, out)
                together, size = [], 0
            together.append(i)
            size += len(text)
        self._together(texts, together, out)
        return out

    def _together(self, texts: Sequence[str | None], places: list[int], out: list[bytes]) -> None:
        if not places:
            return
        split = pc.utf8_split_whitespace(pa.array([texts[i] for i in places], pa.string()))
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return
        # no word has a space: one joined string comes over faster than so many words
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py().split(" ")
        ids = pa.array(self._words(words), pa.binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int32)[split.offsets.to_numpy()].tolist()
        whole = data.to_pybytes() if data is not None else b""
        for i, start, end in zip(places, ends[:-1], ends[1:], strict=True):
            out[i] = whole[start:end]

    def _words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.recent.get, words))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            word = words[at]
            if len(word) > LONGEST_CACHED:
                found[at] = self._fresh(word)
                continue
            # an earlier place of the same text may have brought it in
            out = self.recent.get(word) or self.older.get(word)
            if out is None:
                out = self._fresh(word)
            if len(self.recent) >= self.cache_words:
                self.older, self.recent = self.recent, {}
            self.recent[word] = found[at] = out
        return found

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _fresh(self, word: str) -> bytes:
        lower = word.lower()
        if not lower.isascii():
            if BEYOND_LATIN.search(lower):
                return self._whole(word)
        elif not lower.isalpha() and (head := lower[:-1]).isalpha() and not lower[-1].isdigit():
            # letters and one mark are two pieces
            return (self.pieces.get(head) or self._piece(head)) + (self.pieces.get(lower[-1]) or self._piece(lower[-1]))
        if "<|" in word:
            return self._whole(word)
        if lower.isalpha():
            return self.pieces.get(lower) or self._piece(lower)
        return b"".join([self.pieces.get(p) or self._piece(p) for p in PIECE.findall(lower)])

    def _piece(self, piece: str) -> bytes:
        out = self.older_pieces.get(piece)
        if out is None:
            mapped = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.model.tokenize(mapped)]
            out = PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_CACHED:
            if len(self.pieces) >= self.cache_words:
                self.older_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = out
        return out


def word_encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """The worker's encoder for ``path``; the next tasks of the same operator find its cache warm."""
    return keep_warm(("words", path, cache_words), lambda: WordEncoder(path, cache_words))
