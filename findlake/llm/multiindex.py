"""Approximate nearest neighbours by an inverted multi-index.

Vectors are normalised and cut in two halves; each half has its own centroids, so that a pair of centroids is a
cell. A query goes through the pairs in order of summed distance with a heap until their cells hold enough
vectors; those are reranked by exact cosine of the original vectors in double precision. Cells of one left centroid lie together:
a query goes there once, with a bit for each right centroid that it came to, so that fine cells don't multiply the queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns
from findlake.llm.storage import materialize


@dataclass(frozen=True)
class IndexSettings:
    #: centroids of each half; cells are their square. They are no fewer than the first number and grow with the root of the rows, an
    #: eighth of it, to the second
    centroids: int = 64
    most_centroids: int = 512
    #: vectors that centroids are fitted on: those with the smallest hash of their id
    sample: int = 20_000
    rounds: int = 12
    #: a query goes on until its cells hold so many vectors, and this share of all, at least; vectors without clusters
    #: need a large share
    candidates: int = 2_000
    share: float = 0.45
    #: rows of a left centroid, and queries, that one task compares at once; more are cut
    part: int = 4_096
    query_part: int = 1_024

    def centroids_for(self, rows: int) -> int:
        return max(self.centroids, min(self.most_centroids, round(rows**0.5 / 8)))


@dataclass
class Codebook:
    """Centroids of the left and the right half."""

    left: np.ndarray
    right: np.ndarray

    def cells(self, unit: np.ndarray) -> np.ndarray:
        h = self.left.shape[1]
        return _nearest(unit[:, :h], self.left) * len(self.right) + _nearest(unit[:, h:], self.right)

    def walk(self, unit: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
        """Which cells (left by right) come first by summed distance until they hold ``wanted`` vectors."""
        h = self.left.shape[1]
        dl, dr = ((self.left - unit[:h]) ** 2).sum(1), ((self.right - unit[h:]) ** 2).sum(1)
        ol, orr = np.argsort(dl, kind="stable").tolist(), np.argsort(dr, kind="stable").tolist()
        dl, dr = np.sort(dl).tolist(), np.sort(dr).tolist()
        # a row of pairs enters with its first pair, once the row before it has come up
        heap, visited, held = [(dl[0] + dr[0], 0, 0)], [], 0
        while heap and held < wanted:
            _, i, j = heap[0]
            cell = ol[i] * len(orr) + orr[j]
            visited.append(cell)
            held += sizes[cell]
            if j + 1 < len(orr):
                heapq.heapreplace(heap, (dl[i] + dr[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(ol):
                heapq.heappush(heap, (dl[i + 1] + dr[0], i + 1, 0))
        out = np.zeros(len(ol) * len(orr), bool)
        out[visited] = True
        return out.reshape(len(ol), len(orr))


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1)[None, :] - 2 * points @ centroids.T, axis=1)


def _k_means(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    distinct = np.unique(points, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(rounds):
        own = _nearest(points, centroids)
        for c in range(len(centroids)):
            if (mine := own == c).any():
                centroids[c] = points[mine].mean(0)
    return centroids


def _usable(vec: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def fit(vectors: DataFrame, n_rows: int, settings: IndexSettings) -> Codebook:
    """Fit the centroids for ``n_rows`` rows on a bounded sample of ``vec_id, vec``."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).select("vec").collect()
    unit = _unit(np.array([r[0] for r in rows], np.float64))
    h = (unit.shape[1] + 1) // 2
    n = settings.centroids_for(n_rows)
    return Codebook(_k_means(unit[:, :h], n, settings.rounds), _k_means(unit[:, h:], n, settings.rounds))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 5, settings: IndexSettings = IndexSettings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query row among all other rows: query_id, rank, vec_id, score (cosine).

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than most have (of
    lengths that are equally frequent, the smallest counts).
    Equal vectors are indexed once, under their ``k + 1`` smallest ids: no others can be among ``k`` neighbours, as
    ties go to the smaller id. Ids are taken to be unique.
    """
    spark = vectors.sparkSession
    plain = vectors.where(_usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec"), is_query.alias("q"))
    length = plain.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plain = plain.where(F.size("vec") == length.d)
    book = fit(plain, length.n, settings)
    shared = spark.sparkContext.broadcast(book)

    def make():
        return lambda vecs: (shared.value.cells(_unit(np.array(vecs, np.float64))).tolist(),)

    celled = append_columns(plain, ["vec"], [T.StructField("cell", T.IntegerType())], make)
    order = Window.partitionBy("vec").orderBy("vec_id")
    table = materialize(celled, "multiindex")
    # a window group limit keeps k + 1 rows a task before the shuffle, so that a much repeated vector is no hot key
    entries = table.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k + 1).select("cell", "vec_id", "vec")
    entries = materialize(entries, "multiindex-entries")
    # a number a cell: centroids squared at most
    n_right = len(book.right)
    sizes = np.zeros(len(book.left) * n_right, np.int64)
    for cell, n in entries.groupBy("cell").count().collect():
        sizes[cell] = n
    sent = spark.sparkContext.broadcast(sizes.tolist())
    wanted = max(settings.candidates, int(settings.share * int(sizes.sum())))
    visit = T.ArrayType(T.StructType([T.StructField("left", T.IntegerType()), T.StructField("rights", T.BinaryType())]))

    def make_walk():
        def visits(unit: np.ndarray) -> list[dict]:
            came = shared.value.walk(unit, sent.value, wanted)
            return [{"left": int(i), "rights": np.packbits(came[i]).tobytes()} for i in np.flatnonzero(came.any(1))]

        return lambda vecs: ([visits(u) for u in _unit(np.array(vecs, np.float64))],)

    asking = table.where("q").select(F.col("vec_id").alias("query_id"), "vec")
    # many queries are cut, and so are the rows of a left centroid; each part meets each
    cut_queries = max(1, -(-asking.count() // settings.query_part))
    cut = np.maximum(1, -(-sizes.reshape(-1, n_right).sum(1) // settings.part)).tolist()
    parts = F.element_at(F.array(*[F.lit(int(n)) for n in cut]), F.col("left") + 1)
    queries = append_columns(asking, ["vec"], [T.StructField("visits", visit)], make_walk)
    asked = queries.select("query_id", "vec", F.inline("visits")).withColumns({"part": F.explode(F.sequence(F.lit(0), parts - 1)), "query_part": F.pmod(F.xxhash64("query_id"), F.lit(cut_queries)).cast("int")})
    rows = entries.select(F.floor(F.col("cell") / n_right).cast("int").alias("left"), (F.col("cell") % n_right).alias("right"), "vec_id", "vec")
    dealt = rows.withColumns({"part": F.pmod(F.xxhash64("vec_id"), parts).cast("int"), "query_part": F.explode(F.sequence(F.lit(0), F.lit(cut_queries - 1)))})
    keys = ["left", "part", "query_part"]
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_compare(k, n_right), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _compare(k: int, n_right: int):
    def nearest(queries: pa.Table, entries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not queries.num_rows or not entries.num_rows:
            return schema.empty_table()
        ids, own, right = np.asarray(entries["vec_id"]), np.asarray(queries["query_id"]), np.asarray(entries["right"])
        data, asked = (_unit(_matrix(t["vec"].combine_chunks())) for t in (entries, queries))
        bits = np.frombuffer(b"".join(queries["rights"].to_pylist()), np.uint8).reshape(len(own), -1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(asked), 256):
            came = np.unpackbits(bits[at : at + 256], axis=1, count=n_right).astype(bool)
            # equal vectors must tie whatever order the products were added in
            score = np.round(asked[at : at + 256] @ data.T, 12)
            score[~came[:, right] | (own[at : at + 256, None] == ids[None, :])] = -np.inf
            least = np.partition(score, -k, axis=1)[:, [-k]] if len(ids) > k else -np.inf
            # rows that tie with the last one are all kept
            q, e = np.nonzero((score >= least) & (score > -np.inf))
            out.append((own[at + q], ids[e], np.einsum("qd,qd->q", asked[at + q], data[e])))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)

    return nearest
