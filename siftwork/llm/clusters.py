"""Centroid clustering of integer vectors with geometric drift tightening."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Components beyond this would make a squared distance of 64 components leave the long range.
LARGEST = 1 << 27
#: Below this all products and sums of them are exact in doubles, so a matrix product gives exact distances.
EXACT_IN_DOUBLE = 1 << 21
#: Share and amount by which a bound must be met, more than all rounding of the bounds.
SLACK, LEAST = 1e-9, 1e-6


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): whole numbers floor(scale * x) of the vectors that have exactly ``dim`` finite components."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    low, high = F.lit(float(-LARGEST)), F.lit(float(LARGEST))
    # a null, a NaN (greater than any number for Spark) and the infinities are all outside
    fits = F.forall("x", lambda x: F.coalesce((x * scale >= low) & (x * scale <= high), F.lit(False)))
    return v.where((F.size("x") == dim) & fits).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def seeds(kept: DataFrame, k: int, label: str) -> np.ndarray:
    """The k vectors whose ``label`` and id hash lowest, in the order of the hash; equal ids by their components."""
    h = F.sha2(F.concat(F.lit(label), F.col("vec_id").cast("string")), 256)
    first = kept.select("v", h.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much a lower bound on the distance of its vectors to the other centroids must fall.

    Let a centroid move from a to b, over the length d, and m be the middle. For a vector x with s its signed distance
    beyond the hyperplane through m across the move, |x-a| - |x-b| = 2 d s / (|x-a| + |x-b|), which is at most 0 for
    s <= 0, and at most d s / |x-m| otherwise, since |x-a| + |x-b| >= 2 |x-m|. So it is at most d times the cosine of
    the angle at m between x and the direction of the move. The cluster's vectors lie in a ball; in the plane through
    the move and the ball's centre, the ball is seen from m under an angle, and the greatest cosine belongs to the
    tangent nearest the direction of the move. It is 1 only if the direction meets the ball.
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    move = new - old
    length = np.sqrt((move ** 2).sum(1))
    out = np.zeros(len(old))
    for i in range(len(old)):
        for j in np.flatnonzero(length > 0):
            if i == j:
                continue
            to = old[i] - (old[j] + new[j]) / 2
            along = float(to @ move[j]) / length[j]
            whole = float(to @ to)
            beside = max(0.0, whole - along * along) ** 0.5
            r = float(radius[i]) * (1 + SLACK) + LEAST
            if whole <= r * r or (along >= 0 and beside <= r):
                cosine = 1.0
            else:
                cosine = min(1.0, max(0.0, (along * (whole - r * r) ** 0.5 + beside * r) / whole))
            out[i] = max(out[i], length[j] * cosine)
    return out * (1 + SLACK) + LEAST


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers to all centres."""
    if max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) < EXACT_IN_DOUBLE:
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def assigned(state: DataFrame, centres: np.ndarray, fall: np.ndarray | None) -> DataFrame:
    """(vec_id, v, cluster, distance, lower, scans): every vector at its nearest centre.

    ``fall`` is None in the first round, which scans all. Later a vector whose exact distance to its own centre is
    below its lower bound, less ``fall`` of its cluster, stays; the others are scanned exactly. ``lower`` bounds the
    distance to any other centre, ``scans`` counts the scans so far.
    """
    dim, k = centres.shape[1], len(centres)

    def run(batches):
        for b in batches:
            n = b.num_rows
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dim).astype(np.int64)
            if fall is None:
                near, lower, scans = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
                own, unsure = np.zeros(n, np.int64), np.ones(n, bool)
            else:
                near = b.column("cluster").to_numpy().astype(np.int64)
                lower = np.maximum(b.column("lower").to_numpy() - fall[near], 0)
                scans = b.column("scans").to_numpy().astype(np.int64)
                own = ((x - centres[near]) ** 2).sum(1)
                unsure = np.sqrt(own.astype(np.float64)) * (1 + SLACK) + LEAST >= lower
            at = np.flatnonzero(unsure)
            if len(at):
                d = squared_distances(x[at], centres)
                best = d.argmin(1)  # the first of equals, so the smaller number
                own[at], near[at] = d[np.arange(len(at)), best], best
                if k > 1:
                    d[np.arange(len(at)), best] = np.iinfo(np.int64).max
                    lower = lower.copy()
                    lower[at] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK)
                else:
                    lower = np.full(n, np.inf)
                scans = scans.copy()
                scans[at] += 1
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array(near), pa.array(own), pa.array(lower), pa.array(scans)],
                                  names=["vec_id", "v", "cluster", "distance", "lower", "scans"])

    return state.mapInArrow(run, "vec_id long, v array<long>, cluster long, distance long, lower double, scans long")


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, dim: int = 64,
                      scale: int = 64, rounds: int = 3, label: str = "1:") -> DataFrame:
    """One row per kept vector: vec_id, v (its whole numbers), cluster, distance (squared, to the final centroid),
    cluster_inertia, inertia, centroid_sha256, scans (how often it was compared with all centroids).

    Each of ``rounds`` rounds assigns every vector to its nearest centroid (ties: smaller number) and replaces each
    non-empty centroid by floor(sum / count) of its vectors; a last assignment follows. After a move a vector is
    compared with all centroids only if its lower bound, loosened by the geometry of its cluster's ball, doesn't exceed
    its exact distance to its own one. Vectors stay where Spark has them; the driver holds k centroids, and for each of
    them a count, a radius and a sum per component, which are pre-aggregated. The state of a round is a table in the
    shared folder, and the one before it is deleted.

    A vector with another number of components, a null, NaN or infinite one, or one beyond 2**27 after scaling, is not
    kept. A null id is kept and becomes a seed only after all others; repeated ids are vectors of their own, equal ones
    are equal seeds of which the first takes all. With fewer than k vectors there are as many centroids as vectors. No
    kept vector gives no rows; other columns are ignored. Inertia beyond the long range is null.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, id_col, vec_col, dim, scale)
    out = "vec_id long, v array<long>, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int"
    centres = seeds(kept, k, label)
    if not len(centres):
        return spark.createDataFrame([], out)
    home = f"{checkpoint_dir(spark)}/clusters-{uuid.uuid4().hex}"
    state, fall, before = kept, None, None
    sums = [F.sum(F.get("v", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(dim)]
    for step in range(rounds + 1):
        path = f"{home}/{step}"
        assigned(state, centres, fall).write.parquet(path)
        state = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
        if step == rounds:
            break
        stats = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *sums).collect()
        moved, radius = centres.copy(), np.zeros(len(centres))
        for r in stats:
            moved[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
            radius[r.cluster] = float(r.far) ** 0.5
        fall, centres = loosening(centres, moved, radius), moved
    as_long = F.try_sum(F.col("distance").cast("decimal(38,0)"))
    own = state.groupBy("cluster").agg(as_long.alias("d")).collect()
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    total = None if any(r.d is None for r in own) else sum(r.d for r in own)
    facts = [(r.cluster, fits(r.d), fits(total), hashlib.sha256(",".join(map(str, centres[r.cluster].tolist())).encode()).hexdigest()) for r in own]
    per = spark.createDataFrame(facts, "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = state.join(F.broadcast(per), "cluster")  # at most k rows
    return rows.select("vec_id", "v", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia",
                       "centroid_sha256", F.col("scans").cast("int").alias("scans"))


def clusters_sql(k: int = 16, dim: int = 64, scale: int = 64, rounds: int = 3, label: str = "1:") -> str:
    """The same in plain SQL, every vector against every centroid in each round."""
    parts = [f"""v as materialized (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim})""",
             f"c0 as materialized (select row_number() over (order by sha256('{label}' || vec_id) nulls last, v) - 1 as c, v as m from v qualify c < {k})"]
    for t in range(rounds + 1):
        parts.append(f"""a{t} as materialized (select i, min((d, c)) as best from (select i, c,
list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v, c{t}) group by i)""")
        if t < rounds:
            parts.append(f"""c{t + 1} as materialized (with e as (select a.best[2] as c, unnest(v.v) as x, generate_subscripts(v.v, 1) as p from v join a{t} a using (i)),
s as (select c, p, floor(sum(x)::hugeint // count(*) - (case when sum(x)::hugeint % count(*) < 0 then 1 else 0 end))::bigint as m from e group by all),
l as (select c, list(m order by p) as m from s group by c)
select c{t}.c, coalesce(l.m, c{t}.m) as m from c{t} left join l using (c))""")
    last = f"a{rounds}"
    return f"""with {', '.join(parts)},
r as (select vec_id, best[2] as cluster, best[1] as distance from v join {last} using (i))
select vec_id, cluster::integer as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
sum(distance) over ()::bigint as inertia, sha256(array_to_string(c.m, ',')) as centroid_sha256
from r join c{rounds} c on c.c = r.cluster"""
