"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q that is at least FOLD times as long and can't go on to either side. Blocks of
2^k words at multiples of 2^k are looked up in the windows next to them: a run of period q, with 2^k the least power that is q or
more, holds such a block whose nearest occurrence on one side lies exactly q words away and inside the run. Occurrences of a
block that overlap are an arithmetic progression, and the difference of its first terms is a candidate period. Occurrences come from
a range successor query: those of a block are an interval of the suffix array, in which a wavelet tree over its positions finds the
next one before and after the block. A candidate is extended word by word to both sides; that decides whether it is a run.

Suffix array, tree and queries are array operations on the words of many documents at once; words of different documents
count as different, so that nothing matches across documents.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns
from findlake.llm.storage import small_batches

#: A run has at least so many words, and is at least so many times as long as its period.
LEAST_WORDS = 6
FOLD = 4
#: Words handled at once; a longer document is handled by itself.
BATCH_WORDS = 1 << 16


def suffix_blocks(keys: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of ``keys`` as far as ``longest`` keys decide, and per power of two from 2 the blocks that occur again.

    Prefix doubling: after the round of width h suffixes are in order of their first h keys, and only those of groups that these
    don't tell apart are sorted again. A level is (h, at, low, high): blocks at multiples of h and their intervals.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(n, np.int64)
    place = np.arange(n)
    sorted_keys = keys[order]
    sizes = np.ones(n, np.int64)
    levels = []
    width = 1
    while True:
        # groups of equal keys among the places still open
        new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(place)])
        ranks[order[place]] = np.repeat(place[first], size)
        sizes[place[first]] = size
        if width >= 2:
            at = np.arange(0, n, width)
            low = ranks[at]
            again = sizes[low] > 1
            levels.append((width, at[again], low[again], (low + sizes[low])[again]))
        place = place[np.repeat(size > 1, size)]
        width *= 2
        if not len(place) or width > longest:
            return order, levels
        own = order[place]
        beyond = own + width // 2
        follow = np.where(beyond < n, ranks[np.minimum(beyond, n - 1)], -1)
        sorted_keys = ranks[own] * (n + 1) + follow + 1
        by = np.argsort(sorted_keys, kind="stable")
        order[place] = own[by]
        sorted_keys = sorted_keys[by]


class WaveletTree:
    """Which numbers lie in a range of an array: for each bit from the highest, how many places before one have a zero there."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        values = values.astype(np.int32)
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.r_[np.int32(0), np.cumsum(~one, dtype=np.int32)])
            values = np.r_[values[~one], values[one]]

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers of each range are less than ``value``."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, b = zeros[low], zeros[high]
            one = (value >> bit & 1).astype(bool)
            found += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found

    def pick(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with ``k`` smaller ones in each range."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            found |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found

    def neighbours(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next smaller and the next larger number of each range than ``value``, which lies in it; -1 where there is none."""
        rank = self.below(low, high, value)
        previous, following = np.full(len(low), -1), np.full(len(low), -1)
        has = rank > 0
        previous[has] = self.pick(low[has], high[has], rank[has] - 1)
        has = rank + 1 < high - low
        following[has] = self.pick(low[has], high[has], rank[has] + 1)
        return previous, following


def _equal_for(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of ``a`` and ``b`` are equal."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        end = min(n, at + step)
        differs = a[at:end] != b[at:end]
        if differs.any():
            return at + int(differs.argmax())
        at, step = end, step * 4
    return n


def find_runs(keys: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of ``keys``, of which no stretch over ``longest`` items can be one."""
    n = len(keys)
    if n < LEAST_WORDS:
        return []
    order, levels = suffix_blocks(keys, max(2, longest // 2))
    at = np.concatenate([level[1] for level in levels]) if levels else np.zeros(0, np.int64)
    if not len(at):
        return []
    width = np.concatenate([np.full(len(level[1]), level[0]) for level in levels])
    low, high = (np.concatenate([level[i] for level in levels]) for i in (2, 3))
    previous, following = WaveletTree(order).neighbours(low, high, at)
    left, right = (previous >= 0) & (at - previous <= width), (following >= 0) & (following - at <= width)
    starts = np.r_[previous[left], at[right]]
    periods = np.r_[(at - previous)[left], (following - at)[right]]
    runs, period, end = [], 0, 0
    by = np.lexsort((starts, periods))
    for start, p in zip(starts[by].tolist(), periods[by].tolist(), strict=True):
        if p != period:
            period, end = p, 0
        if start + p < end:  # inside the stretch found last
            continue
        back = _equal_for(keys[:start][::-1], keys[p : start + p][::-1])
        end = start + p + _equal_for(keys[start:], keys[start + p :])
        length = end - start + back
        if length >= max(LEAST_WORDS, FOLD * p):
            runs.append((start - back, length, p))
    return runs


def _texts_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    parts = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in texts]
    lengths = [len(p) for p in parts]
    begins = np.cumsum([0, *lengths])
    keys = np.concatenate(parts) + np.repeat(np.arange(len(parts)) * len(ids), lengths)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in sorted(find_runs(keys, max(lengths))):
        text = int(np.searchsorted(begins, start, side="right")) - 1
        found[text].append((start - int(begins[text]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [w for w, d in zip(words, np.cumsum(drop)[:-1].tolist(), strict=True) if not d]
    return b" ".join(words).decode()


RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed``: the words outside of repetitions.

    Words end at blanks, tabs and line ends of ASCII. A word is left out of ``collapsed`` if a run holds it after the run's first
    period; kept words are joined by one blank. Null and empty texts have no run and an empty ``collapsed``. Texts of any length are
    read whole, by themselves where they are long; equal rows have equal results. Columns named like the new ones are replaced.
    """
    small_batches(docs.sparkSession)

    def make():
        def compute(texts):
            runs, collapsed, held, size = [], [], [], 0

            def settle():
                for words, found in zip(held, _texts_runs(held), strict=True):
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    collapsed.append(_collapsed(words, found))
                held.clear()

            for text in texts:
                words = text.encode().split() if text else []
                if held and size + len(words) > BATCH_WORDS:
                    settle()
                    size = 0
                held.append(words)
                size += len(words)
            if held:
                settle()
            return runs, collapsed

        return compute

    return append_columns(docs, [text_col], [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())], make)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of a table of ``periodic_runs``: id, n_runs, the longest run (ties: smallest start, then period), and two digests."""
    runs = F.col("runs")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select(id_col, F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.minus"), F.col("best.period")
    exponent = F.expr("-best.minus * 1000 div best.period")
    return out.select(id_col, "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def planted(text: Column, doc_id: Column) -> Column:
    """``text`` with a repetition in every tenth document, by the crc32 of its decimal id: from word a on it has period p.

    Other texts, those without words and those of a null id stay as they are.
    """
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    unit = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), F.flatten(unit)), F.lit(1), n), " ")).otherwise(text)
