"""Token-ID files: canonical length-limited Huffman codes of ids, in independently decodable blocks.

A file set is a folder with two Parquet parts. ``header`` has a row for each id that occurs: its global
count and code length; the codes follow from the lengths (canonical order: length, then id). ``blocks``
has a row for each block: whole documents in ascending id order, their lengths, one bit stream, and the
bit offset of every ``CHECKPOINT``-th id. Offsets let a reader start inside a block; here they let the
decoder run all stretches of a block side by side, by table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns
from findlake.llm.storage import materialize
from findlake.llm.wordbpe import word_encoder

#: No code is longer; 2**18 ids at most, and a decoding table of 2**20 entries.
LONGEST_CODE = 20
LARGEST_ALPHABET = 1 << 18
BLOCK_IDS = 1 << 17
CHECKPOINT = 128
#: Words whose ids a worker keeps.
CACHE_WORDS = 300_000

BLOCK_SCHEMA = "file_no int, block_no int, file_start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, n_bits long, bits binary, checkpoints array<long>"


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_bytes: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts to ids: ``doc_id, ids`` (little-endian unsigned integers of ``id_bytes``, 2 or 4; ``end_id`` appended).

    Null and empty texts have the end id only. Rows with equal doc_id stay apart.
    """
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def make():
        encode = word_encoder(tokenizer_path, CACHE_WORDS).encode_all
        return lambda texts: ([_narrow(ids + tail, id_bytes) for ids in encode(texts)],)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    return append_columns(slim, ["__text"], [T.StructField("ids", T.BinaryType())], make).select("doc_id", "ids")


def _narrow(ids: bytes, id_bytes: int) -> bytes:
    if id_bytes == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError("an id needs more than 2 bytes")
    return wide.astype("<u2").tobytes()


def count_ids(tokens: DataFrame, id_bytes: int = 4) -> DataFrame:
    """``token_id, count`` over all rows: each task adds up its own ids first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            # the values of a batch lie in a row
            column = batch.column(0)
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
            if not len(column) or ends[0] == ends[-1]:
                continue
            part = np.bincount(np.frombuffer(data, f"<u{id_bytes}", count=int(ends[-1] - ends[0]) // id_bytes, offset=int(ends[0])))
            if len(part) > LARGEST_ALPHABET:
                raise ValueError(f"an id of {LARGEST_ALPHABET} or more can't be coded")
            if len(part) > len(total):
                total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
            total[: len(part)] += part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token_id", "count"])

    return tokens.select("ids").mapInArrow(run, "token_id long, count long").groupBy("token_id").agg(F.sum("count").alias("count"))


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge) for positive counts."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << longest:
        raise ValueError("more symbols than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    packages, leaf_flags = np.zeros(0), []
    for _ in range(longest):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        leaf_flags.append(by < n)
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(leaf_flags):
        taken = int(flags[:take].sum())
        lengths[:taken] += 1
        take = 2 * (take - taken)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class CanonicalCode:
    """Codes of the ids with the given lengths; arrays are indexed by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.width = max(1, int(lengths.max())) if len(lengths) else 1
        #: decoding table: id and length (5 bits) of the code that a run of bits starts with
        self.table = np.zeros(1 << self.width, np.uint32)
        by = np.lexsort((ids, lengths))
        ids, lengths = ids[by], lengths[by]
        # the k-th code starts where the codes before it, each as wide as its share of the table, end
        shares = np.left_shift(1, self.width - lengths)
        starts = np.cumsum(shares) - shares
        self.code[ids] = (starts >> (self.width - lengths)).astype(np.uint64)
        self.length[ids] = lengths
        end = int(shares.sum())
        self.table[:end] = np.repeat(ids.astype(np.uint32) << np.uint32(5) | lengths.astype(np.uint32), shares)

    def encode(self, ids: np.ndarray) -> tuple[bytes, int, np.ndarray]:
        """The bit stream (big-endian), its number of bits and the bit offset of every CHECKPOINT-th id."""
        if not len(ids):
            return b"", 0, np.zeros(0, np.int64)
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        starts, n_bits = ends - lengths, int(ends[-1])
        words = np.zeros(n_bits // 32 + 3, np.uint64)
        at, shift = starts >> 5, (64 - (starts & 31) - lengths).astype(np.uint64)
        placed = self.code[ids] << shift  # 64 bits from the start of 32-bit word `at`
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words[at[first]] += np.bitwise_or.reduceat(placed >> np.uint64(32), first)
        words[at[first] + 1] += np.bitwise_or.reduceat(placed & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes()[: (n_bits + 7) // 8], n_bits, starts[::CHECKPOINT]

    def decode(self, bits: bytes, n_ids: int, checkpoints: np.ndarray) -> np.ndarray:
        """The ids of a bit stream: one table look-up gives the next id of every stretch at once."""
        out = np.empty((CHECKPOINT, len(checkpoints)), np.uint32)
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, last = np.array(checkpoints, np.int64), len(window) - 1
        mask = np.uint32((1 << self.width) - 1)
        for i in range(min(CHECKPOINT, n_ids)):
            slot = window[np.minimum(at >> 3, last)] >> (32 - self.width - (at & 7)).astype(np.uint32) & mask
            out[i] = self.table[slot]
            at += out[i] & 31
        return (out >> 5).T.reshape(-1)[:n_ids]


def write_ids(tokens: DataFrame, path: str, id_bytes: int = 4, block_ids: int = BLOCK_IDS) -> None:
    """Write ``doc_id, ids`` (see encode_documents) as a file set at ``path``, in ascending doc_id order.

    Blocks hold whole documents, up to ``block_ids`` ids or one longer document. Null doc_ids come first,
    equal ones in order of their ids. An empty table gives an empty header and no blocks.
    """
    spark = tokens.sparkSession
    tokens = materialize(tokens, "ids")
    counts = count_ids(tokens, id_bytes).toPandas().sort_values("token_id")
    ids, numbers = counts.token_id.to_numpy(np.int64), counts["count"].to_numpy(np.int64)
    lengths = code_lengths(numbers)
    header = [(int(i), int(c), int(n)) for i, c, n in zip(ids, numbers, lengths, strict=True)]
    spark.createDataFrame(header, "token_id long, count long, code_length int").coalesce(1).write.parquet(f"{path}/header")
    shared = spark.sparkContext.broadcast((ids, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file_no = CanonicalCode(*shared.value), TaskContext.get().partitionId()
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held, start, block_no = 0, 0, 0

        def block() -> pa.RecordBatch:
            joined = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            bits, n_bits, checkpoints = code.encode(joined)
            row = [[file_no], [block_no], [start], [len(joined)], [docs], [[len(p) for p in parts]], [n_bits], [bits], [checkpoints.tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        names = ["file_no", "block_no", "file_start", "n_ids", "doc_ids", "doc_lengths", "n_bits", "bits", "checkpoints"]
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(value.as_buffer(), f"<u{id_bytes}") if value.is_valid and value.as_buffer().size else np.zeros(0, np.uint32)
                if docs and held + len(own) > block_ids:
                    yield block()
                    start, block_no, docs, parts, held = start + held, block_no + 1, [], [], 0
                docs.append(doc)
                parts.append(own)
                held += len(own)
        if docs:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.select("doc_id", "ids").mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decode a file set: ``doc_id, start, n_tokens, ids``; ``start`` counts the ids of all documents before."""
    header = spark.read.parquet(f"{path}/header")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    rows = header.select("token_id", "code_length").toPandas().sort_values("token_id")
    # one total for each file, of which there are as many as tasks that wrote them
    totals = dict(blocks.groupBy("file_no").agg(F.sum("n_ids")).collect())
    before, base = 0, {}
    for file_no in sorted(totals):
        base[file_no], before = before, before + totals[file_no]
    shared = spark.sparkContext.broadcast((rows.token_id.to_numpy(np.int64), rows.code_length.to_numpy(np.int64), base))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, bases = shared.value
        code = CanonicalCode(ids, lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                data = code.decode(b["bits"], b["n_ids"], np.array(b["checkpoints"], np.int64)).astype("<u4").tobytes()
                ends = np.cumsum(np.array(b["doc_lengths"], np.int64))
                starts = ends - np.array(b["doc_lengths"], np.int64)
                first = bases[b["file_no"]] + b["file_start"]
                columns = [b["doc_ids"], (starts + first).tolist(), b["doc_lengths"], [data[s * 4 : e * 4] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
