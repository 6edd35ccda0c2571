"""Best-fit packing of documents into sequences under several capacities at once.

Every demand of a piece (tokens, one document, attention cost) follows from its length, so pieces of one
length are alike. The plan is made on the histogram of lengths, which has no more entries than the
sequence has tokens, by vector best-fit decreasing over *groups of like bins*; pieces then find their place
by their rank among the pieces of their length. The plan stays small however large the corpus is, and
is the one that packing piece by piece, longest first, would give.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.storage import materialize, small_batches
from findlake.llm.wordbpe import word_encoder

PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


@dataclass(frozen=True)
class Capacities:
    """What one sequence holds. A piece of n tokens takes n tokens, 1 document and n * n attention cost."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    #: weights of the three residuals, each as a share of its capacity
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    #: "norm": smallest weighted residual after placing; "dot": largest dot-product of demand and residual
    rule: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.float64)


def plan_bins(histogram: dict[int, int], caps: Capacities) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over a histogram of lengths.

    Returns rows (length, first rank, first bin, pieces a bin, offset) sorted by length and rank, and the number
    of bins. A row places the pieces of that length from its first rank up to the next row's.
    A piece that no empty bin can hold under every constraint raises ValueError.
    """
    full, weights = caps.vector(), np.array(caps.weights)
    residual = np.zeros((0, 3))  # of each group of like bins
    low, high = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the bins of a group
    rows, n_bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        demand = np.array([length, 1, length * length], np.float64)
        if (demand > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((residual >= demand).all(1))
            if len(fits):
                share = (residual[fits] - demand) / full
                score = (weights * share * share).sum(1) if caps.rule == "norm" else -(weights * (demand / full) * (residual[fits] / full)).sum(1)
                g = int(fits[np.argmin(score)])
            else:  # new bins: as many as the rest of this length fills
                g = len(low)
                with np.errstate(divide="ignore"):
                    each = max(1, int(np.floor(np.where(demand > 0, full / np.maximum(demand, 1e-9), np.inf).min())))
                residual = np.vstack([residual, full])
                low, high = np.r_[low, n_bins], np.r_[high, n_bins + -(-left // each)]
                n_bins = int(high[-1])
            with np.errstate(divide="ignore"):
                each = max(1, int(np.floor(np.where(demand > 0, residual[g] / np.maximum(demand, 1e-9), np.inf).min())))
            if caps.rule == "dot":
                each = 1
            offset = int(full[0] - residual[g, 0])
            first, bins = int(low[g]), int(high[g] - low[g])
            whole, rest = divmod(min(left, bins * each), each)
            rows.append((length, rank, first, each, offset))
            parts = [(first, first + whole, residual[g] - demand * each), (first + whole, first + whole + (rest > 0), residual[g] - demand * rest), (first + whole + (rest > 0), first + bins, residual[g].copy())]
            keep = [p for p in parts if p[1] > p[0]]
            low[g], high[g], residual[g] = keep[0]
            for a, b, r in keep[1:]:
                low, high, residual = np.r_[low, a], np.r_[high, b], np.vstack([residual, r])
            placed = whole * each + rest
            left, rank = left - placed, rank + placed
        # groups that are full can take nothing any more
        open_ = residual[:, 0] > 0
        low, high, residual = low[open_], high[open_], residual[open_]
    plan = np.array(rows, np.int64).reshape(-1, 5)
    return plan[np.lexsort((plan[:, 1], plan[:, 0]))], n_bins


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None, longest: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts, append ``end_id`` and cut documents of over ``longest`` ids.

    A row a piece: doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit, where asked for).
    Null and empty texts give one piece with the end id; without an end id they give none.
    """
    small_batches(docs.sparkSession)
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = PIECE_COLUMNS + ["ids"] * with_ids
    wide = 4 * longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path).encode_all
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    data = ids + tail
                    for k in range(0, len(data), wide):
                        own = data[k : k + wide]
                        out.append((doc, k // wide, k // 4, len(own) // 4, zlib.crc32(own)) + (own,) * with_ids)
                columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0, without bringing a length together in one task.

    Each task numbers its own pieces; how many the tasks before it have of a length comes from a table of
    (task, length) counts.
    """
    fields = [*pieces.schema.names, "__task", "__local"]
    at = pieces.schema.names.index("length")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            local = []
            for n in batch.column(at).to_pylist():
                local.append(seen.get(n, 0))
                seen[n] = local[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * batch.num_rows, pa.int32()), pa.array(local, pa.int64())], names=fields)

    schema = T.StructType([*pieces.schema.fields, T.StructField("__task", T.IntegerType()), T.StructField("__local", T.LongType())])
    numbered = materialize(pieces.mapInArrow(number, schema), "pieces")
    counts = numbered.groupBy("__task", "length").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return numbered.join(base, ["__task", "length"]).withColumn("__rank", F.col("__local") + F.col("__base")).drop("__task", "__local", "__base")


def best_fit_pack(pieces: DataFrame, caps: Capacities = Capacities()) -> DataFrame:
    """``pieces`` (any table with a positive integer ``length``) with ``sequence_id`` and ``offset`` (long, from 0).

    Every piece is placed, without gaps. Pieces of length 0 or null take no place: both columns are null.
    Columns named sequence_id or offset are replaced. An empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset").withColumn("length", F.col("length").cast("long"))
    ranked = _ranked(pieces)
    # a row a length, of which the capacity bounds the number
    histogram = {int(n): int(c) for n, c in ranked.where("length > 0").groupBy("length").count().collect()}
    plan, _ = plan_bins(histogram, caps)
    shared = ranked.sparkSession.sparkContext.broadcast(plan)
    names = [c for c in ranked.schema.names if c != "__rank"] + ["sequence_id", "offset"]
    schema = T.StructType([*ranked.drop("__rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    i_length, i_rank = ranked.schema.names.index("length"), ranked.schema.names.index("__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        lengths, firsts = np.unique(rows[:, 0], return_index=True)
        ends = np.r_[firsts[1:], len(rows)]
        for batch in batches:
            n = np.array(batch.column(i_length).fill_null(0), np.int64)
            rank = np.array(batch.column(i_rank), np.int64)
            sequence, offset = np.full(len(n), -1), np.full(len(n), -1)
            for value in np.unique(n[n > 0]):
                k = int(np.searchsorted(lengths, value))
                own = rows[firsts[k] : ends[k]]
                mine = np.flatnonzero(n == value)
                r = own[np.searchsorted(own[:, 1], rank[mine], side="right") - 1]
                bin_, slot = np.divmod(rank[mine] - r[:, 1], r[:, 3])
                sequence[mine], offset[mine] = r[:, 2] + bin_, r[:, 4] + slot * value
            off = n <= 0
            columns = [c for i, c in enumerate(batch.columns) if i != i_rank]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64(), mask=off), pa.array(offset, pa.int64(), mask=off)], names=names)

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, doc_ids and ids, pieces in order of offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return (
        packed.where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .select("sequence_id", "n_tokens", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), joined.alias("ids"))
    )
