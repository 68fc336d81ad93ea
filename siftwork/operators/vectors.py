"""Nearest neighbours by cosine over an index of cells.

The index deals unit vectors to the nearest of a bounded number of cell centres, and a large cell to blocks of a bounded
number of rows, so that neither a popular region nor many copies of one vector gather in a task. A query visits the
blocks of some cells, where its similarities are one matrix product, and takes k candidates from each. The exact search
then visits every other cell whose ball can still hold a vector as good as the k-th found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Rows from which the cell centres are fitted; cells at most; rows of a block; cells that a search visits first.
SAMPLE, MOST_CELLS, BLOCK, PROBES = 20_000, 4096, 16_384, 8
#: Similarities are compared and returned at so many places.
PLACES = 6


@dataclass
class VectorIndex:
    """``rows``: (cell, block, vec_id, u); ``centres``: cells x dimensions; ``radius`` and ``blocks`` of each cell."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    dim: int


def unit_vectors(vectors: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, u): vectors of length 1. Vectors that are null, zero, of another dimension or with a null or non-finite
    component have no direction and are left out."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    v = v.where((F.size("x") == dim) & F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    v = v.withColumn("n", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))).where((F.col("n") > 0) & (F.col("n") < float("inf")))
    return v.select("vec_id", F.transform("x", lambda x: x / F.col("n")).alias("u"))


def dimension(vectors: DataFrame, vec_col: str = "embedding") -> int:
    """The commonest length of the vectors (ties: the smaller one), 0 without any."""
    top = vectors.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top.d if top else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None) -> VectorIndex:
    """An index of all rows of ``vectors`` that have a direction.

    Centres are fitted by k-means on at most SAMPLE rows (those whose id hashes lowest); their number is the square root
    of the rows unless ``cells`` says otherwise, MOST_CELLS at most. The driver holds the centres and a few numbers of
    each cell; the rows stay a table in the shared folder."""
    dim = dimension(vectors, vec_col)
    units = materialise(unit_vectors(vectors, dim, id_col, vec_col))
    n = units.count()
    k = max(1, min(MOST_CELLS, cells or int(n ** 0.5), n))
    if n:
        sample = units.orderBy(F.xxhash64("vec_id", "u")).limit(SAMPLE).select(array_to_vector("u").alias("features"))
        centres = np.array(KMeans(k=k, seed=1, maxIter=5, initMode="random").fit(sample).clusterCenters())
    else:
        centres = np.zeros((1, max(dim, 1)))

    def deal(batches):
        for b in batches:
            d = distances(matrix(b.column("u"), dim), centres)
            cell = d.argmin(1)
            yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), b.column("vec_id"), b.column("u")],
                                  names=["cell", "d", "vec_id", "u"])

    dealt = units.mapInArrow(deal, "cell int, d double, vec_id long, u array<double>")
    dealt = materialise(dealt)
    radius, blocks = np.zeros(len(centres)), np.ones(len(centres), np.int64)
    for r in dealt.groupBy("cell").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row for each cell
        radius[r.cell], blocks[r.cell] = r.far, -(-r.n // BLOCK)
    n_blocks = F.array(*[F.lit(int(x)) for x in blocks])
    block = F.pmod(F.xxhash64("vec_id", "u"), F.get(n_blocks, F.col("cell"))).cast("int")
    return VectorIndex(dealt.select("cell", block.alias("block"), "vec_id", "u"), centres, radius, blocks, dim)


def visits(queries: DataFrame, index: VectorIndex, choose) -> DataFrame:
    """(cell, block, q, u): each query once for each block of the cells that ``choose`` marks (a boolean matrix of
    queries and cells, from their distances and the batch)."""
    centres, blocks, dim = index.centres, index.blocks, index.dim

    def run(batches):
        for b in batches:
            x = matrix(b.column("u"), dim)
            at, cell = np.nonzero(choose(distances(x, centres), b))
            times = blocks[cell]
            at, cell = np.repeat(at, times), np.repeat(cell, times)
            block = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
            for i in range(0, len(at), 4096):
                part = pa.array(at[i:i + 4096])
                yield pa.record_batch([pa.array(cell[i:i + 4096].astype(np.int32)), pa.array(block[i:i + 4096].astype(np.int32)),
                                       b.column("vec_id").take(part), b.column("u").take(part)], names=["cell", "block", "q", "u"])

    return queries.mapInArrow(run, "cell int, block int, q long, u array<double>")


def candidates(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, similarity): the best ``k`` of each block that a query visits; a row isn't its own neighbour."""
    dim = index.dim
    rows = index.rows.select("cell", "block", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "u")
    both = rows.union(queries.select("cell", "block", F.lit(1).alias("kind"), F.col("q").alias("id"), "u"))
    by = ["cell", "block"]

    def best(q, x, ids, vecs):
        sim = np.round(x @ vecs.T, PLACES)
        sim[q[:, None] == ids[None, :]] = -np.inf
        m, repeats = min(k, len(ids)), len(np.unique(ids)) < len(ids)
        out = []
        for i in range(len(q)):
            s = sim[i]
            if repeats:  # an id counts once, by its nearest vector
                at = np.lexsort((ids, -s))
                at = at[np.sort(np.unique(ids[at], return_index=True)[1])][:k]
                at = at[s[at] > -np.inf]
            else:
                least = np.partition(s, len(s) - m)[len(s) - m]
                at = np.flatnonzero((s >= least) & (s > -np.inf))
                at = at[np.lexsort((ids[at], -s[at]))][:k]
            out.append((np.full(len(at), q[i]), ids[at], s[at]))
        return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["q", "vec_id", "similarity"])

    def run(batches):
        here, ids, vecs = None, [], []
        for b in batches:
            cell, block, kind = (b.column(c).to_numpy() for c in ("cell", "block", "kind"))
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cell)]):
                if hi == lo:
                    continue
                if here != (cell[lo], block[lo]):
                    here, ids, vecs = (cell[lo], block[lo]), [], []
                part = b.slice(lo, hi - lo)
                x, own = matrix(part.column("u"), dim), part.column("id").to_numpy(zero_copy_only=False)
                if kind[lo] == 0:
                    ids.append(own)
                    vecs.append(x)
                elif ids:
                    if len(ids) > 1:
                        ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
                    for i in range(0, len(own), 256):
                        yield best(own[i:i + 256], x[i:i + 256], ids[0], vecs[0])

    return both.repartition(*by).sortWithinPartitions(*by, "kind").mapInArrow(run, "q long, vec_id long, similarity double")


def top(found: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query by similarity, then id; pre-cut in every task before the shuffle."""
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(index: VectorIndex, queries: DataFrame, k: int = 5, probes: int = PROBES, exact: bool = True,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, similarity): the ``k`` nearest rows of the index for each row of ``queries`` (ids
    distinct and not null), by cosine rounded to PLACES, then id; a row with the query's id isn't its neighbour.

    Without ``exact`` only the ``probes`` nearest cells are visited. With it, each cell is visited whose ball comes as
    near as the k-th neighbour found so far: for unit vectors, similarity is at most 1 - d^2 / 2 at a distance d, and a
    ball's distance is that of its centre less its radius. Queries without a direction have no rows. An id of the index
    that repeats counts once, by its nearest vector.
    """
    q = unit_vectors(queries, index.dim, id_col, vec_col).where("vec_id is not null").dropDuplicates(["vec_id"])
    radius = index.radius
    first = min(probes, len(index.centres))

    def farthest(d):
        return np.partition(d, first - 1, axis=1)[:, first - 1:first]

    # a margin above all rounding: what the second pass takes for visited, the first has visited
    found = candidates(index, visits(q, index, lambda d, b: d <= farthest(d) + 1e-7), k)
    if exact and first < len(index.centres):
        found = materialise(top(found, k).drop("rank"))
        last = found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(-2.0).alias("least"))
        open_ = q.join(last.withColumnRenamed("q", "vec_id"), "vec_id", "left").select("vec_id", "u", F.coalesce("least", F.lit(-2.0)).alias("least"))

        def further(d, b):
            reach = np.maximum(d - radius - 1e-9, 0)
            return (1 - reach * reach / 2 >= b.column("least").to_numpy()[:, None] - 2 * 10.0 ** -PLACES) & (d > farthest(d))

        found = found.union(candidates(index, visits(open_, index, further), k))
    found = found.groupBy("q", "vec_id").agg(F.max("similarity").alias("similarity"))
    return top(found, k).select(F.col("q").alias("query_id"), "rank", "vec_id", "similarity")
