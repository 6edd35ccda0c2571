"""Exact BM25 top-k by an inverted index with block-max WAND pruning, run per shard and merged.

A shard is a run of documents that one task reads; it is one row of the index, with the postings of every term in document order.
Documents lie in blocks of 128. With the global statistics each frequent term has a largest gain in each block, every other
term one in the shard. The pivots of a query are the blocks whose summed largest gains reach its k-th best score so far.
Some hundred queries are asked at once: blocks that are no query's pivot and queries without a pivot are left out, the scores
of the rest are added up, and the k-th best scores rise. They go along from shard to shard of a task. Bounds never fall
below scores, so the result is that of scoring everything.

Postings of terms that many documents of a shard have are kept as rows of a table, a place a document: what they add comes
from one matrix product, over the rows that enough of its queries ask for. Queries that share terms are asked together, so
that a product has few rows. The other postings of all its queries are added up together as well.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns
from findlake.llm.storage import discard, materialize, small_batches

WORD = re.compile(r"\w+")
BLOCK_DOCS = 128
SHARD_DOCS = 4096
SHARD_CHARS = 16_000_000
#: (query, term) pairs that are searched at once: 12 bytes each are broadcast, and 8 a term. A longer query is a block by itself.
PAIRS_AT_ONCE = 1_500_000
#: Query buckets whose sizes the driver looks at for each block that it makes of them.
BUCKETS = 16
DIGITS = 6
#: Terms that one in so many documents of a shard have, and so many at least, are kept as rows: the most frequent ones, up to
#: a number. Where there are more, and in small shards, postings are added up without; the scores are the same.
ROW_ONE_IN = 64
ROW_FEWEST = 32
MOST_ROWS = 2048
#: Queries of one matrix product.
QUERIES_AT_ONCE = 256
#: Terms by which queries are put in order, so that those of one product share their rows.
ORDER_TERMS = 24
#: A row is in the product if the postings that it saves, so many times, are as many as the places that it adds to the product.
PRODUCT_GAIN = 384
#: Postings that are added up at once, over as many queries as have them: what a task holds of them.
POSTINGS_AT_ONCE = 1 << 16
INDEX_SCHEMA = "shard long, n int, words long, ids binary, lengths binary, terms binary, ends binary, ords binary, freqs binary"


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def idf(self, n_docs: int, df: np.ndarray) -> np.ndarray:
        return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))

    def gain(self, freq: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
        return freq * (self.k1 + 1) / (freq + self.k1 * (1 - self.b + self.b * length / mean))


def terms_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows of INDEX_SCHEMA: a row a shard. ``terms`` are hashes in ascending order, ``ends`` where their postings end.

    Whole texts are indexed; null and empty ones have no term and length 0. Rows of a null doc_id are left out. Terms are told
    apart by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        lengths: list[int] = []
        places: dict[str, int] = {}
        terms, ords, freqs = array("i"), array("i"), array("i")
        chars = 0

        def shard() -> pa.RecordBatch:
            hashes = np.array([term_hash(t) for t in places], np.uint64)
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            term = rank[np.frombuffer(terms, np.int32)] if len(terms) else np.zeros(0, np.int32)
            by = np.argsort(term, kind="stable")  # documents stay in order within a term
            ends = np.cumsum(np.bincount(term, minlength=len(order)))
            doc, freq = np.frombuffer(ords, np.int32)[by], np.frombuffer(freqs, np.int32)[by]
            values = [number, len(ids), sum(lengths), np.array(ids, np.int64), np.array(lengths, np.int32), hashes[order], ends.astype(np.int32), doc.astype(np.uint16), freq]
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = terms_of(text)
                    counts = Counter(words)
                    terms.extend([places.setdefault(t, len(places)) for t in counts])
                    freqs.extend(counts.values())
                    ords.extend([len(ids)] * len(counts))
                    ids.append(doc)
                    lengths.append(len(words))
                    chars += len(text or "")
                    if len(ids) == SHARD_DOCS or chars >= SHARD_CHARS:
                        yield shard()
                        number, ids, lengths, places, chars = number + 1, [], [], {}, 0
                        terms, ords, freqs = array("i"), array("i"), array("i")
        if ids:
            yield shard()

    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, INDEX_SCHEMA)


class Shard:
    """One shard's postings, with the largest gain of every term, and of frequent terms that in every block."""

    def __init__(self, row: dict, mean: float, bm25: Bm25):
        self.ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int32)
        self.terms, ends = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["ends"], np.int32).astype(np.int64)
        self.ords = np.frombuffer(row["ords"], np.uint16).astype(np.int64)
        self.gains = bm25.gain(np.frombuffer(row["freqs"], np.int32).astype(np.float64), lengths[self.ords], mean)
        self.by_id = np.argsort(self.ids, kind="stable")
        #: where each term's postings begin; behind them the next term's do
        self.begins = np.r_[0, ends]
        self.most = np.maximum.reduceat(self.gains, self.begins[:-1]) if len(ends) else np.zeros(0)

        self.counts = np.diff(self.begins)
        often = np.flatnonzero(self.counts >= max(ROW_FEWEST, len(self.ids) / ROW_ONE_IN))
        often = np.sort(often[np.argsort(-self.counts[often], kind="stable")[:MOST_ROWS]])
        #: of each term its row, or -1
        self.row = np.full(len(self.terms), -1)
        self.row[often] = np.arange(len(often))
        self.row_counts = self.counts[often]
        inside = _runs(self.begins[often], self.row_counts)
        self.rows = np.zeros((len(often), len(self.ids)))
        self.rows[np.repeat(np.arange(len(often)), self.row_counts), self.ords[inside]] = self.gains[inside]
        self.row_bounds = np.maximum.reduceat(self.rows, np.arange(0, len(self.ids), BLOCK_DOCS), axis=1)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash the number of its term, or -1; fastest where they ascend."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search(self, begins: np.ndarray, hashes: np.ndarray, weights: np.ndarray, best: list[Best], without: list[int] | None) -> None:
        """Bring the documents of this shard into the best ones of queries; the terms of each lie from its begin to the next one."""
        self.search_numbers(begins, self.numbers(hashes), weights, best, without)

    def search_numbers(self, begins: np.ndarray, numbers: np.ndarray, weights: np.ndarray, best: list[Best], without: list[int] | None) -> None:
        known = np.flatnonzero(numbers >= 0)
        term, weight = numbers[known], weights[known]
        query = np.repeat(np.arange(len(best)), np.diff(begins))[known]
        row = self.row[term]
        # rows that so few of the queries ask for that adding their postings up is less work are left out of the product
        asked = np.bincount(row[row >= 0], minlength=len(self.rows)) * self.row_counts
        chosen = np.flatnonzero(asked * PRODUCT_GAIN >= len(best) * len(self.ids))
        place = np.full(len(self.rows) + 1, -1)
        place[chosen] = np.arange(len(chosen))
        row = place[row]
        often = row >= 0
        table = np.zeros((len(best), len(chosen)))
        table[query[often], row[often]] = weight[often]
        query, term, weight = query[~often], term[~often], weight[~often]

        least = np.array([x.least for x in best])
        reach = table @ self.row_bounds[chosen] + np.bincount(query, weight * self.most[term], len(best))[:, None]
        reach *= 1 + 1e-9  # sums in another order
        reach += 10.0**-DIGITS  # rounding
        pivots = reach >= least[:, None]
        # queries without a pivot, and blocks that are no query's pivot, are left out
        active, blocks = np.flatnonzero(pivots.any(1)), pivots.any(0)
        if not len(active):
            return
        if len(active) < len(best):
            table, least = table[active], least[active]
            number = np.full(len(best), -1)
            number[active] = np.arange(len(active))
            kept = np.flatnonzero(number[query] >= 0)
            query, term, weight = number[query[kept]], term[kept], weight[kept]
        if blocks.all():
            scores = table @ self.rows[chosen]
        else:
            docs = np.flatnonzero(np.repeat(blocks, BLOCK_DOCS)[: len(self.ids)])
            scores = np.zeros((len(active), len(self.ids)))
            scores[:, docs] = table @ self.rows[np.ix_(chosen, docs)]
        self._add_postings(scores, query, term, weight)

        if without is not None:
            own = np.array(without)[active]
            first = np.searchsorted(self.ids, own, sorter=self.by_id)
            times = np.searchsorted(self.ids, own, "right", sorter=self.by_id) - first
            scores[np.repeat(np.arange(len(active)), times), self.by_id[_runs(first, times)]] = 0.0
        low = np.maximum(least - 10.0**-DIGITS, 0.1 * 10.0**-DIGITS)
        fresh, k = np.flatnonzero(least == 0), best[0].k
        if len(fresh) and len(self.ids) > k:  # no k-th best score so far: this shard's own
            low[fresh] = np.maximum(low[fresh], np.partition(scores[fresh], -k, axis=1)[:, -k] - 2 * 10.0**-DIGITS)
        at, doc = np.divmod(np.flatnonzero(scores >= low[:, None]), len(self.ids))
        rounded, ids = np.round(scores[at, doc], DIGITS), self.ids[doc]
        good = rounded >= np.maximum(least, 10.0**-DIGITS)[at]
        at, rounded, ids = at[good], rounded[good], ids[good]
        cuts = np.searchsorted(at, np.arange(len(active) + 1)).tolist()
        for q, a, b in zip(active.tolist(), cuts[:-1], cuts[1:], strict=True):
            if a < b:
                best[q].add(rounded[a:b], ids[a:b])

    def _add_postings(self, scores: np.ndarray, query: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Add the postings of ``term`` to the scores of ``query``, which ascends, some POSTINGS_AT_ONCE at a time."""
        n = len(self.ids)
        count = self.counts[term]
        done = np.cumsum(count)
        cuts = np.searchsorted(done, np.arange(0, int(done[-1]) if len(done) else 0, POSTINGS_AT_ONCE)).tolist() + [len(term)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            first, last = int(query[a]), int(query[b - 1])
            times, posting = count[a:b], _runs(self.begins[term[a:b]], count[a:b])
            cell = np.repeat((query[a:b] - first) * n, times)
            cell += self.ords[posting]
            gain = np.repeat(weight[a:b], times)
            gain *= self.gains[posting]
            scores[first : last + 1] += np.bincount(cell, gain, (last - first + 1) * n).reshape(-1, n)


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one run behind the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Best:
    """The k best scores of a query so far, ties to the smaller id."""

    __slots__ = ("k", "scores", "ids", "least")

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.zeros(0), np.zeros(0, np.int64), 0.0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        if len(scores) > self.k:
            if len(scores) > 8 * self.k:
                keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
                scores, ids = scores[keep], ids[keep]
            keep = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[keep], ids[keep]
            self.least = float(scores[-1])
        elif len(scores) == self.k:
            self.least = float(scores.min())
        self.scores, self.ids = scores, ids


def _query_blocks(coded: DataFrame) -> list[list[int]]:
    """Buckets of queries, several a block, so that a block has PAIRS_AT_ONCE pairs at most where it has more than one bucket."""
    total = int(coded.agg(F.sum("n")).first()[0] or 0)
    buckets = BUCKETS * (total // PAIRS_AT_ONCE + 1)
    # one number a bucket: BUCKETS for each block that will be searched
    sizes = coded.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n")).orderBy("bucket").collect()
    out: list[list[int]] = [[]]
    room = PAIRS_AT_ONCE
    for bucket, n in sizes:
        if out[-1] and n > room:
            out.append([])
            room = PAIRS_AT_ONCE
        out[-1].append(bucket)
        room -= n
    return [[buckets, *b] for b in out if b]


def search(index: DataFrame, queries: DataFrame, k: int = 10, bm25: Bm25 = Bm25(), query_id: str = "query_id", query_text: str = "text", without_own: bool = False) -> DataFrame:
    """The exact ``k`` best documents of each query: query_id, rank, doc_id, score (rounded to 6 decimals before ranking, so that equal texts tie).

    Scores use the number of documents, mean length and document frequencies of the whole index. Documents without
    a term of the query are no results; queries without a term have none, nor null ids; a repeated query id asks with
    the text that sorts first. With ``without_own`` the documents whose id is the query's are no results. Queries are searched in
    blocks of bounded size: one pass over the index a block, in which nothing but results is shuffled.
    """
    spark = index.sparkSession
    n_docs, words = (int(v or 0) for v in index.agg(F.sum("n"), F.sum("words")).first())
    schema = "query_id long, doc_id long, score double"
    if not n_docs:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    mean = max(1e-9, words / n_docs)
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_text).cast("string").alias("text")).where("query_id is not null").groupBy("query_id").agg(F.min("text").alias("text"))

    def make():
        def counts(texts):
            return ([[{"term": (h := term_hash(t)) - (h >> 63 << 64), "count": n} for t, n in Counter(terms_of(x)).items()] for x in texts],)

        return counts

    pair = T.StructType([T.StructField("term", T.LongType()), T.StructField("count", T.IntegerType())])
    pairs = materialize(append_columns(asked, ["text"], [T.StructField("pairs", T.ArrayType(pair))], make).select("query_id", F.inline("pairs")), "bm25-asked")
    df = _frequencies(index).join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    coded = pairs.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "count", "df")).alias("pairs"))
    coded = materialize(coded.select("query_id", F.size("pairs").alias("n"), F.col("pairs.term").alias("terms"), F.col("pairs.count").alias("counts"), F.col("pairs.df").alias("dfs")), "bm25-queries")
    discard(pairs)
    found = [materialize(index.mapInArrow(_searcher(_block(coded, block, bm25, n_docs), mean, bm25, k, without_own), schema), "bm25-found") for block in _query_blocks(coded)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _frequencies(index: DataFrame) -> DataFrame:
    """``term, df`` of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.diff(np.r_[0, np.frombuffer(ends, np.int32)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(counts)], names=["term", "df"])

    return index.select("terms", "ends").mapInArrow(run, "term long, df long")


def _block(coded: DataFrame, block: list[int], bm25: Bm25, n_docs: int):
    """A broadcast of the block's queries: ids, where each begins, hashes of all terms in order, of each query's terms their places there, ascending, and their weights. Queries that share terms stand together."""
    buckets, *own = block
    rows = coded.where(F.pmod(F.xxhash64("query_id"), F.lit(buckets)).isin(own)).orderBy("query_id").toArrow()
    ids, counts = np.asarray(rows.column("query_id")), np.asarray(rows.column("n")).astype(np.int64)
    flat = {c: np.asarray(rows.column(c).combine_chunks().flatten()) for c in ("terms", "counts", "dfs")}
    hashes, number = np.unique(flat["terms"].view(np.uint64), return_inverse=True)
    weights = flat["counts"] * bm25.idf(n_docs, flat["dfs"].astype(np.float64))
    by = _alike(counts, number)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    order = np.lexsort((number, np.repeat(place, counts)))
    return coded.sparkSession.sparkContext.broadcast((ids[by], np.r_[0, np.cumsum(counts[by])], hashes, number[order].astype(np.int32), weights[order]))


def _alike(counts: np.ndarray, number: np.ndarray) -> np.ndarray:
    """An order of queries: by which of the terms that most of them have they have, the most frequent one first."""
    held = np.bincount(number)
    most = np.argsort(-held, kind="stable")[:ORDER_TERMS]
    column = np.full(len(held), -1)
    column[most] = np.arange(len(most))
    column = column[number]
    has = np.zeros((len(counts), len(most)), bool)
    has[np.repeat(np.arange(len(counts)), counts)[column >= 0], column[column >= 0]] = True
    return np.lexsort((counts, *has.T[::-1]))


def _searcher(shared, mean: float, bm25: Bm25, k: int, without_own: bool):
    """Best results of the broadcast queries in all shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, begins, hashes, numbers, weights = shared.value
        best = [Best(k) for _ in range(len(ids))]
        own = ids.tolist()
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], mean, bm25)
                here = shard.numbers(hashes)
                for q in range(0, len(best), QUERIES_AT_ONCE):
                    part = slice(q, q + QUERIES_AT_ONCE)
                    cuts = begins[q : q + QUERIES_AT_ONCE + 1]
                    terms = slice(cuts[0], cuts[-1])
                    shard.search_numbers(cuts - cuts[0], here[numbers[terms]], weights[terms], best[part], own[part] if without_own else None)
        sizes = [len(x.ids) for x in best]
        if sum(sizes):
            columns = [np.repeat(ids, sizes), np.concatenate([x.ids for x in best]), np.concatenate([x.scores for x in best])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "doc_id", "score"])

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", without_own: bool = False) -> DataFrame:
    """Index ``docs`` once in the shared folder and search it."""
    return search(materialize(build_index(docs, id_col, text_col), "bm25"), queries, k, query_id=query_id, query_text=query_text, without_own=without_own)
