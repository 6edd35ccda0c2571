"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of symbols. Each adjacent pair that merges to a token lies, by its left
position, in the bucket of that token's rank. A bitmap of two levels of 256-bit words marks the buckets in use,
so find-first-set on two words gives the lowest rank; the leftmost position of its bucket merges next. Entries that
a merge has made stale stay where they are and are skipped when they come up. A merge costs a few
word operations however long the pre-token is.
"""

from __future__ import annotations

import base64
import re
import struct
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns
from findlake.llm.wordbpe import BEYOND_LATIN, LETTERS, NUMBERS

CACHE_ENTRIES = 400_000
LONGEST_CACHED = 64
#: The pre-token pattern that COMMON_LATIN can stand for (a fixed value of the public vocabulary).
COMMON = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = "\t-\r \x85\xa0"
#: The same for texts of Latin characters only, spelt out for ``re``, which is several times as fast.
COMMON_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{_SPACE}{LETTERS}{NUMBERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    """``encode(text)`` as packed unsigned 32-bit ids, ``decode(ids)`` as bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.find = regex.compile(pattern).findall
        self.find_latin = COMMON_LATIN.findall if pattern == COMMON else self.find
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.token_of = self.tokens.__getitem__
        self.bytes_to_id = [ranks[bytes([b])] for b in range(256)]
        # the rank of each pair of tokens that joins to a token
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        self.low = [0] * (self.size // 256 + 1)  # the bitmap's lower level; empty between pre-tokens
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, pair_rank, low, top = self.size, self.pairs.get, self.low, 0
        buckets: dict[int, list[int]] = {}
        symbols = [self.bytes_to_id[b] for b in piece]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # positions come in ascending order, so that appending keeps a bucket a heap
        for i, rank in enumerate(map(pair_rank, [a * size + b for a, b in zip(symbols, symbols[1:], strict=False)])):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            j = after[i]
            # stale: i or its neighbour has been merged since
            if symbols[i] < 0 or j >= n or pair_rank(symbols[i] * size + symbols[j]) != rank:
                continue
            k, h = after[j], before[i]
            symbols[i], symbols[j], after[i] = rank, -1, k
            made = []
            if k < n:
                before[k] = i
                made.append((pair_rank(rank * size + symbols[k]), i))
            if h >= 0:
                made.append((pair_rank(symbols[h] * size + rank), h))
            for new, at in made:
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        low[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        latin = text.isascii() or not BEYOND_LATIN.search(text)
        pieces = self.find_latin(text) if latin else self.find(text)
        found = list(map(self.pieces.get, pieces))
        if None in found:
            get, piece = self.pieces.get, self._piece
            found = [get(p) or piece(p) for p in pieces]
        return b"".join(found)

    def _piece(self, piece: str) -> bytes:
        """The packed ids of a pre-token that the recent ones lack."""
        out = self.older_pieces.get(piece)
        if out is None:
            ids = self.merge(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_CACHED:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.older_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = out
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """The worker's codec, kept for its next tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with ``out_col``: the ids of each whole text, little-endian unsigned 32-bit; empty for null or empty texts."""

    def make():
        encode = codec(ranks_path, pattern).encode
        return lambda texts: ([encode(t) for t in texts],)

    return append_columns(df, [text_col], [T.StructField(out_col, T.BinaryType())], make)


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the bytes that the packed ids stand for; null ids give null."""

    def make():
        decode = codec(ranks_path, pattern).decode
        return lambda ids: ([None if i is None else decode(i) for i in ids],)

    return append_columns(df, [ids_col], [T.StructField(out_col, T.BinaryType())], make)



def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one task: doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    encoded = encode_texts(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), ranks_path, pattern)
    both = decode_ids(encoded.select("doc_id", "ids"), ranks_path, pattern)
    return both.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
