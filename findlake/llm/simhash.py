"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints of a block, which agree in a set of fixed bits, are sorted by Gray rank, so that neighbours differ in
few bits. Runs of them form nodes; a node holds the bits that all of its fingerprints share, as a mask
and a pattern, and runs of nodes form the nodes above. A search walks pairs of nodes from the top, adds up
the differences in bits shared on both sides, and drops a whole pair of groups when they exceed the limit.

Blocks are dealt out by pigeonhole: of ``limit + 1`` sets of bits, two linked fingerprints agree in one at least.
A block with very many fingerprints is cut, in Gray order, in runs, one node each: the index over the nodes says which pairs
of runs may hold a link, and each such pair is a piece of work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns
from findlake.llm.components import connected_components
from findlake.llm.storage import materialize, small_batches

SEED = 42
LIMIT = 3
#: Children of a node.
FANOUT = 8
#: Blocks with more fingerprints are cut in runs of a quarter of it. Memory of a task: some hundred bytes for each.
LARGEST_BLOCK = 200_000
PAIRS_AT_ONCE = 1 << 16
SHINGLES_AT_ONCE = 1 << 15

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; they end at space and U+0009 to U+000D only."""
    # all bytes of the separators are ASCII, and bytes.split() cuts at exactly those
    return text.encode().translate(_LOWER).split() if text else []


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of a whole text, as an unsigned 64-bit integer; 0 without words.

    A-Z are lower-cased; words end at space and U+0009 to U+000D only. Each shingle counts as often as it occurs;
    a bit is set if more than half of the hashes have it.
    """
    words = words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    width = min(shingle, len(words))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = words[at : at + SHINGLES_AT_ONCE + width - 1]
        grams = map(b" ".join, zip(*[part[i : len(part) - width + 1 + i] for i in range(width)], strict=True))
        ones += _ones(np.array([digest(g, SEED) for g in grams], "<u8"))
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, each counted once; 0 of the empty set."""
    return _majority(sum((_ones(hashes[at : at + SHINGLES_AT_ONCE]) for at in range(0, len(hashes), SHINGLES_AT_ONCE)), np.zeros(64, np.int64)), len(hashes))


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with ``out_col``: the fingerprint of each whole text, its 64 bits in a long."""

    def make():
        return lambda texts: (np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64).tolist(),)

    return append_columns(df, [text_col], [T.StructField(out_col, T.LongType())], make)


def gray_rank(bits: Column) -> Column:
    """The place of a 64-bit code in reflected Gray order; compare as unsigned, or after flipping the top bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


class GrayTree:
    """The hierarchical index over codes in Gray order: nodes with the bits that all codes below share."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None):
        """``patterns`` are codes, or with ``masks`` nodes of which only the masked bits are known."""
        full = np.full(len(patterns), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.patterns, self.masks = [patterns], [full if masks is None else masks]
        while len(self.patterns[-1]) > 1:
            self._grow()

    def _grow(self) -> None:
        pattern, mask = self.patterns[-1], self.masks[-1]
        starts = np.arange(0, len(pattern), FANOUT)
        ones = np.bitwise_and.reduceat(pattern & mask, starts)
        zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
        self.patterns.append(ones)
        self.masks.append(ones | zeros)

    def raise_to(self, height: int) -> None:
        while len(self.patterns) < height:
            self._grow()


class Components:
    """Union-find over the places of an array; a component goes by its first place."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
        while not np.array_equal(self.parent, up := self.parent[self.parent]):
            self.parent = up

    def single(self, start: int, n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each run of ``span`` places from ``start`` on whether it is one component, and that of its first place."""
        part = self.parent[start : start + n]
        starts = np.arange(0, n, span)
        return np.minimum.reduceat(part, starts) == np.maximum.reduceat(part, starts), part[starts]


def near_pairs(left: GrayTree, right: GrayTree | None, limit: int, found, skip=None) -> None:
    """Walk pairs of nodes from the top; ``found(a, b)`` gets the places of leaves that differ in at most ``limit`` known bits.

    Without ``right`` the pairs are those of ``left`` with itself, each once. A pair of nodes goes with all below it as soon as its
    differences exceed the limit, or ``skip(level, a, b)`` says that it can add nothing.
    """
    other = right or left
    height = max(len(left.patterns), len(other.patterns))
    left.raise_to(height)
    other.raise_to(height)
    stack = [(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    child = np.arange(FANOUT)
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            stack += [(level, a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]) for i in range(0, len(a), PAIRS_AT_ONCE)]
            continue
        differ = np.bitwise_count((left.patterns[level][a] ^ other.patterns[level][b]) & left.masks[level][a] & other.masks[level][b])
        keep = differ <= limit
        if skip is not None:
            keep &= ~skip(level, a, b)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            found(a, b)
            continue
        ca = (a[:, None, None] * FANOUT + child[None, :, None]).repeat(FANOUT, 2).ravel()
        cb = (b[:, None, None] * FANOUT + child[None, None, :]).repeat(FANOUT, 1).ravel()
        good = (ca < len(left.patterns[level - 1])) & (cb < len(other.patterns[level - 1]))
        if right is None:
            good &= (ca <= cb) if level > 1 else (ca < cb)
        stack.append((level - 1, ca[good], cb[good]))


def components_within(codes: np.ndarray, limit: int) -> np.ndarray:
    """For each code, in Gray order, the place of the first code that links lead to."""
    n, all_ = len(codes), Components(len(codes))
    # neighbours in Gray order first: most links of a dense group are found here
    near = np.flatnonzero(np.bitwise_count(codes[1:] ^ codes[:-1]) <= limit)
    all_.unite(near, near + 1)

    def skip(level, a, b):
        one, first = all_.single(0, n, FANOUT**level)
        return one[a] & one[b] & (first[a] == first[b])

    near_pairs(GrayTree(codes), None, limit, all_.unite, skip)
    return all_.parent


def links_between(left: np.ndarray, right: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``left``, in ``right``) of links that join all that links between the two arrays join."""
    n, all_ = len(left), Components(len(left) + len(right))
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def found(a, b):
        us.append(a)
        vs.append(b)
        all_.unite(a, b + n)

    def skip(level, a, b):
        one, first = all_.single(0, n, FANOUT**level)
        other, start = all_.single(n, len(right), FANOUT**level)
        return one[a] & other[b] & (first[a] == start[b])

    near_pairs(GrayTree(left), GrayTree(right), limit, found, skip)
    return np.concatenate(us), np.concatenate(vs)


def _bit_sets(parts: int) -> list[int]:
    """The 64 bits in ``parts`` runs of nearly equal length, as masks."""
    cuts = [round(k * 64 / parts) for k in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _whole_groups(rows: DataFrame, keys: int, order: list[Column], each, schema: str) -> DataFrame:
    """``each(rows)`` for runs of whole groups: rows (longs) that agree in the first ``keys`` columns are together and in ``order``."""
    names = rows.columns
    out = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send(whole: np.ndarray) -> Iterator[pa.RecordBatch]:
            for columns in each(whole):
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([np.asarray(batch.column(i)) for i in range(len(names))], axis=1)
            if held and (part[-1, :keys] == held[0][0, :keys]).all():
                held.append(part)
                continue
            whole = np.concatenate([*held, part]) if held else part
            last = int(np.flatnonzero((whole[:, :keys] != whole[-1, :keys]).any(1))[-1]) + 1 if (whole[0, :keys] != whole[-1, :keys]).any() else 0
            if last:
                yield from send(whole[:last])
            held = [whole[last:]]
        if held:
            yield from send(np.concatenate(held))

    group = names[:keys]
    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def _cuts(rows: np.ndarray, keys: int) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (rows[1:, :keys] != rows[:-1, :keys]).any(1), True])


def _gray_order(code: str = "code") -> Column:
    return gray_rank(F.col(code)).bitwiseXOR(F.lit(-(1 << 63)))


def _block_links(limit: int):
    def each(rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Of blocks (mask, value, code): every linked code with the first code of its component."""
        cuts = _cuts(rows, 2)
        starts, sizes = cuts[:-1], np.diff(cuts)
        pairs = starts[sizes == 2]
        near = pairs[np.bitwise_count((rows[pairs, 2] ^ rows[pairs + 1, 2]).view(np.uint64)) <= limit]
        us, vs = [rows[near + 1, 2]], [rows[near, 2]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            codes = rows[start : start + size, 2]
            first = components_within(codes.view(np.uint64), limit)
            linked = np.flatnonzero(first != np.arange(size))
            us.append(codes[linked])
            vs.append(codes[first[linked]])
        yield np.concatenate(us), np.concatenate(vs)

    return each


def _runs(blocks: DataFrame, limit: int, longest: int) -> DataFrame:
    """``mask, value, run, code, first``: large blocks in Gray order, cut in runs of at most ``longest`` codes, each with its own components."""
    schema = "mask long, value long, run long, code long, first long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held = np.zeros((0, 3), np.int64)

        def send(rows: np.ndarray) -> pa.RecordBatch:
            first = components_within(rows[:, 2].view(np.uint64), limit)
            columns = [rows[:, 0], rows[:, 1], np.full(len(rows), number), rows[:, 2], rows[first, 2]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            part = np.stack([np.asarray(batch.column(i)) for i in range(3)], axis=1)
            held = np.concatenate([held, part])
            while len(held):
                end = min(longest, int(_cuts(held, 2)[1]))
                if end == len(held) < longest:
                    break
                yield send(held[:end])
                number, held = number + 1, held[end:]
        if len(held):
            yield send(held)

    return blocks.repartitionByRange("mask", "value", _gray_order()).sortWithinPartitions("mask", "value", _gray_order()).mapInArrow(run, schema)


def _run_links(runs: DataFrame, joined: DataFrame, limit: int) -> DataFrame:
    """``u, v``: links between codes of different runs of a block; ``joined`` has the components that are known.

    A run is one node with the bits that its codes share. Pairs of nodes that may hold a link, and aren't both of one component
    already, are found by the index over the nodes; the codes of each such pair are then compared.
    """
    known = runs.join(joined.withColumnsRenamed({"node": "code"}), "code", "left").withColumn("root", F.coalesce("component", "code"))
    nodes = known.groupBy("mask", "value", "run").agg(F.bit_and("code").alias("ones"), F.bit_and(F.bitwise_not("code")).alias("zeros"), F.min("root").alias("least"), F.max("root").alias("most"))

    def pairs(rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        cuts = _cuts(rows, 2)
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            block = rows[start:end]
            ones, zeros = block[:, 3].view(np.uint64), block[:, 4].view(np.uint64)
            some: list[tuple[np.ndarray, np.ndarray]] = []

            def found(a, b, block=block, some=some):
                open_ = (block[a, 5] != block[a, 6]) | (block[b, 5] != block[b, 6]) | (block[a, 5] != block[b, 5])
                some.append((a[open_], b[open_]))

            near_pairs(GrayTree(ones, ones | zeros), None, limit, found)
            for a, b in some:
                yield block[a, 2], block[b, 2]

    node_columns = nodes.select("mask", "value", "run", "ones", "zeros", "least", "most")
    candidates = materialize(_whole_groups(node_columns, 2, [F.col("run")], pairs, "a long, b long"), "run-pairs")
    dealt = candidates.select("a", "b", F.explode(F.array("a", "b")).alias("run")).join(runs.select("run", "code"), "run").select("a", "b", "run", "code")

    def links(rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        cuts = _cuts(rows, 2)
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            pair = rows[start:end]
            left, right = (pair[pair[:, 2] == pair[0, side], 3] for side in (0, 1))
            u, v = links_between(left.view(np.uint64), right.view(np.uint64), limit)
            yield left[u], right[v]

    return _whole_groups(dealt, 2, [F.col("run"), _gray_order()], links, "u long, v long")


def code_links(codes: DataFrame, limit: int = LIMIT, largest_block: int = LARGEST_BLOCK) -> DataFrame:
    """``u, v``: pairs of different 64-bit codes that join all that links of at most ``limit`` bits join, and no more."""
    distinct = materialize(codes.select("code").where("code is not null").distinct(), "codes")
    masks = F.array(*[F.lit(_signed(m)) for m in _bit_sets(limit + 1)])
    blocks = distinct.select("code", F.explode(masks).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("code")).alias("value"), "code")
    large = materialize(blocks.groupBy("mask", "value").count().where(F.col("count") > largest_block).select("mask", "value"), "large-blocks")
    if large.isEmpty():
        edges = _whole_groups(blocks, 2, [_gray_order()], _block_links(limit), "u long, v long")
    else:
        small = _whole_groups(blocks.join(large, ["mask", "value"], "left_anti").select("mask", "value", "code"), 2, [_gray_order()], _block_links(limit), "u long, v long")
        # written first: ranges are cut by a sample of it
        dealt = materialize(blocks.join(large, ["mask", "value"], "left_semi").select("mask", "value", "code"), "large-block-codes")
        runs = materialize(_runs(dealt, limit, max(2, largest_block // 4)), "gray-runs")
        within = materialize(small.unionByName(runs.where("code <> first").select(F.col("code").alias("u"), F.col("first").alias("v"))), "links")
        edges = within.unionByName(_run_links(runs, connected_components(within), limit))
    return edges


def code_components(codes: DataFrame, limit: int = LIMIT, largest_block: int = LARGEST_BLOCK) -> DataFrame:
    """``code, component``: for each different 64-bit code that has a link, the smallest code reachable over links of at most ``limit`` bits."""
    return connected_components(code_links(codes, limit, largest_block)).withColumnsRenamed({"node": "code"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, largest_block: int = LARGEST_BLOCK) -> DataFrame:
    """A row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable, itself included).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id come out as often as they go
    in. A null doc_id is never a component_id while its component has another id. Links of documents are links of their
    different fingerprints, so copies add no work.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    printed = materialize(fingerprints(slim, "__text", "code").select("doc_id", "code"), "fingerprints")
    by_code = printed.groupBy("code").agg(F.min("doc_id").alias("first"))
    linked = code_components(printed, limit, largest_block)
    roots = by_code.join(linked, "code", "left").withColumn("root", F.coalesce("component", "code")).select("code", "root", "first")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = roots.join(least, "root").select("code", "component_id")
    return printed.join(classes, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
