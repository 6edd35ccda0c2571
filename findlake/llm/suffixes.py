"""Repeated passages through sparse suffix arrays.

Suffixes of the word sequences are kept at minimiser positions only: of 16 successive positions the one whose next 8 words
hash lowest, so that copies of a passage keep the same suffixes. Any passage of 50 words has a kept suffix within its first 16
positions, its minimiser. Kept suffixes are sorted by (a hash of) their first 35 words, then by their surroundings: all passages
of 50 words whose minimiser they are, which start at most 15 words before them. Neighbours are compared: equal surroundings
make all those passages repeated at once. Where only the first words are equal, the match is extended word by word to the left
and to the right: the passages around the suffix are sorted and compared with their neighbours in turn. Each passage is kept
where it occurs first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns
from findlake.llm.storage import discard, materialize, small_batches
from findlake.llm.warm import only

MIN_WORDS = 50
#: Successive positions of which one is kept, and words that its choice looks at.
SAMPLE_WINDOW = 16
SAMPLE_WORDS = 8
WORD = re.compile(r"\S+")
CACHE_WORDS = 60_000
LONGEST_CACHED = 40

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class WordHashes:
    """64-bit hashes of words; those of recent words are kept."""

    def __init__(self) -> None:
        self.recent: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        get = self.recent.get
        found = list(map(get, words))
        if None in found:
            if len(self.recent) > CACHE_WORDS:
                self.recent = {}
            for i, value in enumerate(found):
                if value is None:
                    word = words[i]
                    found[i] = value = xxhash.xxh64_intdigest(word)
                    if len(word) <= LONGEST_CACHED:
                        self.recent[word] = value
        return np.array(found, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of runs of words in a document."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        with np.errstate(over="ignore"):
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)], dtype=np.uint64)
            powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)
            self.sums = np.r_[np.uint64(0), np.cumsum(hashes * powers[:n], dtype=np.uint64)]

    def runs(self, width: int) -> np.ndarray:
        """Of all runs of ``width`` words."""
        with np.errstate(over="ignore"):
            return _mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])

    def between(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the words from ``start`` to ``end``, and of how they lie around ``at``."""
        with np.errstate(over="ignore"):
            shape = (at - start).astype(np.uint64) << np.uint64(32) | (end - at).astype(np.uint64)
            return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + _mix(shape + _BASE))


def kept_suffixes(rolling: Rolling, n: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept positions, and of each the first and the last start of the passages whose minimiser it is.

    A passage's minimiser depends on its own words only, so wherever it occurs the suffix at it is kept.
    """
    grams = rolling.runs(SAMPLE_WORDS)
    views = np.lib.stride_tricks.sliding_window_view(grams, SAMPLE_WINDOW)[: n - min_words + 1]
    at, first, count = np.unique(views.argmin(1) + np.arange(len(views)), return_index=True, return_counts=True)
    return at, first, first + count - 1


def _places(docs: DataFrame, per_text, names: str, more: str | None = None) -> DataFrame:
    """``doc_id, text_key`` and the long columns ``names`` that ``per_text(words' hashes, value of more)`` gives, a row each."""
    columns = names.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = only(WordHashes)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                owners: list[int] = []
                found: list[tuple[np.ndarray, ...]] = []
                extra = part.column(3).to_pylist() if more else [None] * part.num_rows
                for row, (text, value) in enumerate(zip(part.column(2).to_pylist(), extra, strict=True)):
                    words = text.split() if text else []
                    got = per_text(words, hashes, value)
                    if got is not None and len(got[0]):
                        owners.append(row)
                        found.append(got)
                if found:
                    owner = pa.array(np.repeat(np.array(owners, np.int64), [len(g[0]) for g in found]))
                    values = [pa.array(np.concatenate(c).astype(np.int64, copy=False)) for c in zip(*[tuple(a.view(np.int64) if a.dtype == np.uint64 else a for a in g) for g in found], strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), *values], names=["doc_id", "text_key", *columns])

    chosen = docs.select("doc_id", "text_key", "__text", *([more] if more else []))
    return chosen.mapInArrow(run, "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in columns))


def _suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """A row a kept suffix: key (its first words), around (its surroundings), doc_id, text_key, spot.

    ``spot`` is 256 times the position, 16 times the words by which its first passage starts earlier, and those of its last one.
    """
    prefix = min_words - SAMPLE_WINDOW + 1

    def per_text(words, hashes, _):
        n = len(words)
        if n < min_words:
            return None
        rolling = Rolling(hashes(words))
        at, first, last = kept_suffixes(rolling, n, min_words)
        return rolling.runs(prefix)[at], rolling.between(first, last + min_words, at), at << 8 | (at - first) << 4 | at - last

    return _places(docs, per_text, "key, around, spot").select("key", "around", "doc_id", "text_key", "spot")


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """A row a passage around the suffixes in ``spots``: key, doc_id, text_key, at, and copies = 1 where it has copies anyway."""

    def per_text(words, hashes, spots):
        spots = np.array(spots, np.int64)
        at, copies = spots >> 9, spots & 1
        start, end = at - (spots >> 5 & 15), at - (spots >> 1 & 15) + 1
        starts = np.concatenate([np.arange(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        return Rolling(hashes(words)).runs(min_words)[starts], starts, np.repeat(copies, end - start)

    return _places(docs, per_text, "key, at, copies", "__spots").select("key", "doc_id", "text_key", "at", "copies")


def _in_order(rows: DataFrame, each, schema: str) -> DataFrame:
    """``each(rows, before, after)`` on all rows in the order of their columns, over which they are dealt out in ranges.

    A row comes as an array of its columns as longs (a null doc_id as two columns: 0 and 0, others 1 and the id), equal rows once.
    ``before`` and ``after`` are the rows that stand there, None at the ends of a task's range; each gives an Arrow batch.
    """
    names = rows.columns
    width = len(names)
    null_at = names.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = held = None
        for batch in batches:
            columns = []
            for i in range(width):
                column = batch.column(i)
                if i == null_at:
                    columns.append(np.asarray(column.is_valid()).astype(np.int64))
                    column = column.fill_null(0)
                columns.append(np.asarray(column))
            part = np.stack(columns, axis=1)
            if held is not None:
                part = np.concatenate([held, part])
            part = part[np.r_[True, (part[1:] != part[:-1]).any(1)]] if len(part) else part
            if len(part) < 2:
                held = part if len(part) else held
                continue
            yield from each(part[:-1], before, part[-1])
            before, held = part[-2], part[-1:]
        if held is not None:
            yield from each(held, before, None)

    return rows.repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(run, schema)


def _nullable(known: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=known == 0)


def _same(rows: np.ndarray, before: np.ndarray | None, after: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row whether the one before and the one after have the same first ``width`` columns (False where none is known)."""
    equal = (rows[1:, :width] == rows[:-1, :width]).all(1)
    first = before is not None and bool((before[:width] == rows[0, :width]).all())
    last = after is not None and bool((after[:width] == rows[-1, :width]).all())
    return np.r_[first, equal], np.r_[equal, last]


#: What the comparison of neighbours says of a suffix: all passages around it are repeated; they occur here first; look closer.
REPEATED, FIRST, OPEN = 0, 1, 2


def _compared(suffixes: DataFrame) -> DataFrame:
    """``doc_id, text_key, spot, kind, copies`` of suffixes that share their first words with another, or may do so."""

    def each(rows, before, after):
        key_back, key_on = _same(rows, before, after, 1)
        back, on = _same(rows, before, after, 2)
        edge = np.zeros(len(rows), bool)
        edge[0], edge[-1] = before is None, after is None
        # suffixes of one key that all have one surrounding need no closer look, unless they may go on beyond these rows
        run = np.cumsum(~key_back) - (0 if not key_back[0] else 0)
        run = np.cumsum(~key_back)
        run -= run[0]
        mixed = np.bincount(run, ~back, run[-1] + 1) > 1
        if before is None or key_back[0]:
            mixed[0] = True
        if after is None or key_on[-1]:
            mixed[-1] = True
        kind = np.where(back, REPEATED, np.where(mixed[run], OPEN, FIRST))
        keep = key_back | key_on | edge
        r, kind, copies = rows[keep], kind[keep], on[keep]
        if len(r):
            yield pa.RecordBatch.from_arrays([_nullable(r[:, 2], r[:, 3]), pa.array(r[:, 4]), pa.array(r[:, 5]), pa.array(kind.astype(np.int32)), pa.array(copies)], names=["doc_id", "text_key", "spot", "kind", "copies"])

    return _in_order(suffixes, each, "doc_id long, text_key long, spot long, kind int, copies boolean")


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """``doc_id, text_key, at, repeated`` of the passages that occur more than once; repeated says that one is before."""

    def each(rows, before, after):
        back, on = _same(rows, before, after, 1)
        edge = np.zeros(len(rows), bool)
        edge[0], edge[-1] = before is None, after is None
        keep = back | on | edge | (rows[:, 5] == 1)
        r = rows[keep]
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array(r[:, 0]), _nullable(r[:, 1], r[:, 2]), pa.array(r[:, 3]), pa.array(r[:, 4]), pa.array(back[keep]), pa.array((on[keep] | (r[:, 5] == 1))), pa.array(edge[keep])],
                names=["key", "doc_id", "text_key", "at", "repeated", "again", "edge"],
            )

    schema = "key long, doc_id long, text_key long, at long, repeated boolean, again boolean, edge boolean"
    told = materialize(_in_order(windows, each, schema), "passages")
    # the first and the last row of each task's range, two a task, are compared with those of other ranges
    edges = told.where("edge")
    place = F.struct("doc_id", "text_key", "at")
    ends = edges.groupBy("key").agg(F.min(place).alias("least"), F.count_distinct(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "text_key", "at")).alias("n"))
    settled = edges.join(ends, "key").withColumn("repeated", F.col("repeated") | ~place.eqNullSafe(F.col("least"))).withColumn("again", F.col("again") | (F.col("n") > 1))
    both = told.where(~F.col("edge")).select("doc_id", "text_key", "at", "repeated", "again").unionByName(settled.select("doc_id", "text_key", "at", "repeated", "again"))
    return both.where("repeated or again").select("doc_id", "text_key", "at", "repeated")


def text_key(text_col: str) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row a document that shares a passage of ``min_words`` words with another place: doc_id, text_key (a hash of the text), repeats, firsts.

    Words end at white space. ``repeats`` are the spans of words (start, end) that have occurred before, in a smaller doc_id (null
    first) or further up in the same document; ``firsts`` those that occur here first. Spans overlap where passages do. Null and
    short texts share nothing; rows that repeat a doc_id (null or not) and text count once, those of other texts come in the order
    of text_key. Words, suffixes and passages are compared by 64-bit hashes.
    """
    if min_words < SAMPLE_WINDOW + SAMPLE_WORDS:
        raise ValueError(f"min_words must be at least {SAMPLE_WINDOW + SAMPLE_WORDS}")
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("__text"))
    # written first: ranges are cut by a sample of it
    suffixes = materialize(_suffixes(slim, min_words), "suffixes")
    compared = materialize(_compared(suffixes), "compared-suffixes")
    discard(suffixes)
    spots = compared.where(F.col("kind") == OPEN).groupBy("doc_id", "text_key").agg(F.collect_set(F.col("spot") * 2 + F.col("copies").cast("long")).alias("__spots"))
    around = slim.alias("d").join(spots.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key"))).select("d.doc_id", "d.text_key", "__text", "__spots")
    windows = materialize(_windows(around, min_words), "windows")
    closer = _repeated_windows(windows).select("doc_id", "text_key", F.col("at").alias("lo"), F.col("at").alias("hi"), "repeated")
    at = F.shiftright("spot", 8)
    whole = compared.where((F.col("kind") == REPEATED) | (F.col("kind") == FIRST) & F.col("copies"))
    whole = whole.select("doc_id", "text_key", (at - F.shiftright("spot", 4).bitwiseAND(F.lit(15))).alias("lo"), (at - F.col("spot").bitwiseAND(F.lit(15))).alias("hi"), (F.col("kind") == REPEATED).alias("repeated"))
    grouped = whole.unionByName(closer).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi", "repeated")).alias("found"))

    def make():
        def spans(lo, hi):
            if not len(lo):
                return []
            order = np.argsort(lo, kind="stable")
            lo, reach = lo[order], np.maximum.accumulate(hi[order] + min_words)
            new = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
            last = np.r_[new[1:] - 1, len(lo) - 1]
            return [{"start": int(lo[a]), "end": int(reach[b])} for a, b in zip(new, last, strict=True)]

        def one(found):
            values = np.array([(f["lo"], f["hi"], f["repeated"]) for f in found], np.int64)
            again = values[:, 2] == 1
            return spans(values[again, 0], values[again, 1]), spans(values[~again, 0], values[~again, 1])

        return lambda lists: tuple(zip(*map(one, lists), strict=True))

    fields = [T.StructField("repeats", T.ArrayType(SPAN)), T.StructField("firsts", T.ArrayType(SPAN))]
    return append_columns(grouped, ["found"], fields, make).select("doc_id", "text_key", "repeats", "firsts")


def cut_words(text: str | None, spans: list[dict] | None) -> str | None:
    """``text`` without the words of ``spans``; white space before a cut stays with the text before it."""
    if not text or not spans:
        return text
    starts = [m.start() for m in WORD.finditer(text)]
    out, at = [], 0
    for span in spans:
        out.append(text[at : starts[span["start"]]])
        at = starts[span["end"]] if span["end"] < len(starts) else len(text)
    out.append(text[at:])
    return "".join(out).strip() if spans else text


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with each repeated passage kept at its first place only; a document left without a word goes.

    Other columns stay as they are, but ``n_chars`` (where there is one) follows the text.
    """
    found = repeated_passages(docs, id_col, text_col, min_words).where(F.size("repeats") > 0).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), F.col("repeats").alias("__spans"))
    joined = docs.join(found, docs[id_col].cast("long").eqNullSafe(found["__doc"]) & (text_key(text_col) == found["__key"]), "left")
    cut = append_columns(joined, [text_col, "__spans"], [T.StructField(text_col, T.StringType())], lambda: lambda texts, spans: ([cut_words(t, s) for t, s in zip(texts, spans, strict=True)],))
    cut = cut.where(F.col("__spans").isNull() | (F.length(F.trim(text_col)) > 0))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return cut.select(*docs.columns)
