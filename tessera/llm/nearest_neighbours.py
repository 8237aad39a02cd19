"""Approximate nearest neighbours by inner product, with vantage-point trees in every shard.

Every candidate x gets one more component, sqrt(M^2 - |x|^2), with M the largest norm of its tree;
queries are scaled to norm M and get a zero. Euclidean distance then orders candidates as the inner
product does, so the triangle inequality holds and vantage points can prune. A shard has a tree for
each band of norms, as bounds get loose where M is far above the norms; all are searched as one.

Every node's vantage point keeps its least and largest distance to every leaf of its tree, not only to
those below it, so that a leaf is bounded by all vantage points at once. Leaves are visited best first;
one is left out once ``factor`` times its bound exceeds the distance of the k-th best so far. Factor one
leaves out only what cannot be among the best; larger ones leave out more and may lose some. How much
there is to leave out depends on the vectors: much in groups or on few dimensions, next to nothing for
directions drawn evenly from many.

Vectors are compared with those of their own length. Shards are by hash of the id, so equal vectors
spread; inside a shard equal vectors are one entry with their smallest ids, of which no more than
k + 1 can ever be returned. A first pass over the leaves that are not left out finds each query's
k-th score, a second one takes all vectors of these leaves that reach it, so ties are whole.

Queries go out in broadcast blocks of ``block_bytes`` at most, each against all shards; one task
searches one shard's tree at a time, for ``TOGETHER`` queries at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, col, drop_stash, quoted, stash, table

LEAF = 32
SPREAD = 8  # vectors of a node that are tried as its vantage point
TOGETHER = 1024
BANDS = 4  # of norms, for each factor of two
ROUNDING = 1e-6  # of squared distances at largest norm one
TIE = 1e-11  # more than products of one pair can differ by, at norms of one


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, _v): rows whose vector is neither null nor zero and has finite components only."""
    v = f"transform({quoted(vec_col)}, x -> CAST(x AS double))"
    rows = vectors.select(col(id_col).cast("long").alias("_id"), F.expr(v).alias("_v")).where("_id IS NOT NULL AND size(_v) > 0")
    return rows.where("forall(_v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(_v, x -> x <> 0)")


def distance(products: np.ndarray) -> np.ndarray:
    """Between vectors of norm one, by their inner products."""
    return np.sqrt(np.maximum(2 - 2 * products, 0.0))


def norms(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(1))


class Band(NamedTuple):
    """The tree of one band of norms: its vantage points at largest norm one, and their distances to its leaves."""

    most: float
    first: int
    end: int
    vantage: np.ndarray
    near: np.ndarray  # (vantage point, leaf)
    far: np.ndarray


class VPTree:
    """Distinct vectors in leaf order, in a tree for each band of norms."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        norm = norms(vectors)
        band = np.floor(BANDS * np.log2(norm) + 0.5)
        self.order = np.lexsort((-norm, -band))
        self.leaves: list[tuple[int, int]] = []
        self.bands: list[Band] = []
        rng = np.random.default_rng(seed)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(band[self.order])) + 1, [len(vectors)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            most, first = norm[self.order[a]], len(self.leaves)
            own = self.order[a:b].copy()
            v = vectors[own] / most
            v = np.column_stack([v, np.sqrt(np.maximum(1 - (v**2).sum(1), 0.0))])
            place, points = np.arange(b - a), []
            self._split(v, place, 0, b - a, a, points, rng)
            self.order[a:b] = own[place]
            vantage = v[points]
            starts = [x - a for x, _ in self.leaves[first:]]
            away = distance(vantage @ v[place].T)
            self.bands.append(Band(most, first, len(self.leaves), vantage, np.minimum.reduceat(away, starts, axis=1), np.maximum.reduceat(away, starts, axis=1)))
        self.v = vectors[self.order]

    def _split(self, v: np.ndarray, place: np.ndarray, a: int, b: int, offset: int, points: list[int], rng: np.random.Generator) -> None:
        """Halves place[a:b] by distance from the vantage point whose distances are spread most."""
        if b - a <= LEAF:
            self.leaves.append((a + offset, b + offset))
            return
        own = place[a:b].copy()
        tried = own[rng.integers(len(own), size=SPREAD)]
        away = distance(v[own] @ v[tried].T)
        best = away.var(0).argmax()
        points.append(tried[best])
        place[a:b] = own[np.argsort(away[:, best], kind="stable")]
        half = (b - a) // 2
        self._split(v, place, a, a + half, offset, points, rng)
        self._split(v, place, a + half, b, offset, points, rng)

    def bounds(self, queries: np.ndarray, factor: float) -> np.ndarray:
        """(query, leaf): what inner products in the leaf are not above, with distances stretched by the factor."""
        high = np.empty((len(queries), len(self.leaves)))
        for band in self.bands:
            low = np.zeros((len(queries), band.end - band.first))
            for to, near, far in zip(distance(band.vantage[:, :-1] @ queries.T), band.near, band.far, strict=True):
                np.maximum(low, near - to[:, None], out=low)
                np.maximum(low, to[:, None] - far, out=low)
            high[:, band.first : band.end] = (1 - (factor * low) ** 2 / 2 + ROUNDING) * band.most
        return high

    def search(self, queries: np.ndarray, take: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, row in leaf order) of the best ``take`` found and of all found that tie with the last of them; pairs compared.

        Queries have norm one.
        """
        nq = len(queries)
        high = self.bounds(queries, factor)
        best = np.full((nq, take), -np.inf)
        bar = best[:, -1]  # a view
        visited = np.zeros(high.shape, bool)
        order = np.argsort(-high, axis=1, kind="stable")
        at, width = 0, 1
        while at < len(self.leaves):
            now = order[:, at : at + width]
            open_ = np.take_along_axis(high, now, 1) >= bar[:, None]
            if not open_.any():
                break  # those that follow are bounded lower
            who, leaf = np.nonzero(open_)[0], now[open_]
            by = np.argsort(leaf, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                one, asks = leaf[own[0]], who[own]
                asks = asks[high[asks, one] >= bar[asks]]  # bars have risen since
                a, b = self.leaves[one]
                s = np.concatenate([best[asks], queries[asks] @ self.v[a:b].T], axis=1)
                best[asks] = -np.partition(-s, take - 1, axis=1)[:, :take]
                visited[asks, one] = True
            at, width = at + width, 2 * width
        found, rows, compared = [], [], 0
        for leaf in np.flatnonzero(visited.any(0)):
            a, b = self.leaves[leaf]
            who = np.flatnonzero(visited[:, leaf])
            most = next(band.most for band in self.bands if leaf < band.end)
            x, y = np.nonzero(queries[who] @ self.v[a:b].T >= best[who, -1, None] - TIE * most)
            found.append(who[x])
            rows.append(y + a)
            compared += len(who) * (b - a)
        return np.concatenate(found), np.concatenate(rows), compared


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, components in order, so equal vectors score the same everywhere."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each length and shard: distinct vectors in leaf order, their ids, and the trees."""
    sharded = rows.withColumns({"_d": F.size("_v"), "_shard": F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int")})

    def build(group: pa.Table) -> pa.Table:
        import pickle

        ids, v = group["_id"].to_numpy(), _matrix(group["_v"])
        by = np.argsort(ids, kind="stable")
        ids, v = ids[by], v[by]
        v = np.ascontiguousarray(v) + 0.0
        _, first, same = np.unique(v.view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        tree = VPTree(v[first])
        by = np.argsort(same, kind="stable")  # ids of each distinct vector, smallest first
        starts = np.concatenate([[0], np.cumsum(np.bincount(same))])
        return pa.table({"_d": group["_d"][:1], "_tree": pa.array([pickle.dumps((tree, ids[by], starts))], pa.binary())})

    return stash(sharded.groupBy("_d", "_shard").applyInArrow(build, "_d int, _tree binary"), "vp-index")


def search_tree(tree: VPTree, ids: np.ndarray, starts: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
    """(query_id, vec_id, score): the k nearest of each query in one tree, without its own id."""
    take = min(k + 1, len(tree.v))  # one more, as the own id is left out
    who, row, _ = tree.search(q / norms(q)[:, None], take, factor)
    step = 1 << 15
    score = np.concatenate([exact_scores(q[who[i : i + step]], tree.v[row[i : i + step]]) for i in range(0, len(who), step)])
    u = tree.order[row]
    # an id among a query's best k is of one of its first k + 1 entries by score and smallest id
    by = np.lexsort((ids[starts[u]], -score, who))
    by = by[np.arange(len(by)) - np.searchsorted(who[by], who[by]) <= k]
    who, u, score = who[by], u[by], score[by]
    n = np.minimum(starts[u + 1] - starts[u], k + 1)
    at = np.repeat(starts[u] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    who, score, vec = np.repeat(who, n), np.repeat(score, n), ids[at]
    other = qid[who] != vec
    who, score, vec = who[other], score[other], vec[other]
    by = np.lexsort((vec, -score, who))
    by = by[np.arange(len(by)) - np.searchsorted(who[by], who[by]) < k]
    return pa.RecordBatch.from_arrays([pa.array(qid[who[by]]), pa.array(vec[by]), pa.array(score[by])], names=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    factor: float = 1.2,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = 8192,
    block_bytes: int = 1 << 24,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, the query's own id left out.

    Rows with a null id, or a vector that is null, empty, zero, or holds null or non-finite components
    take no part. The neighbours of a query are among vectors of its length. Ties go to the smaller
    id. Products beyond the range of doubles are infinite. Repeated rows of one id are separate
    candidates; other columns are ignored; empty inputs give an empty result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = stash(usable(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    schema = "query_id long, vec_id long, score double"
    wanted = usable(queries, id_col, vec_col)
    held = wanted.agg(F.sum(F.size("_v") * 8 + 8)).first()[0]
    found = []
    if n and held:
        index = build_index(rows, max(8, math.ceil(n / shard_rows)))
        blocks = math.ceil(held / block_bytes)
        for b in range(blocks):
            part = wanted.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(blocks)) == b).toArrow()
            length = pc.list_value_length(part["_v"]).to_numpy()
            own = {int(d): part.filter(pa.array(length == d)) for d in np.unique(length)}
            sent = spark.sparkContext.broadcast({d: (t["_id"].to_numpy(), _matrix(t["_v"]).copy()) for d, t in own.items()})

            def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                import pickle

                for batch in batches:
                    for i in range(batch.num_rows):
                        qid, q = sent.value.get(batch.column(0)[i].as_py(), ((), ()))
                        if len(qid):
                            tree, ids, starts = pickle.loads(batch.column(1)[i].as_buffer())
                            for a in range(0, len(qid), TOGETHER):
                                yield search_tree(tree, ids, starts, qid[a : a + TOGETHER], q[a : a + TOGETHER], k, factor)

            found.append(stash(index.mapInArrow(search, schema), "vp-found")._stash_path)
            sent.destroy()
        drop_stash(index)
    drop_stash(rows)
    every = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
