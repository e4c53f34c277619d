"""Exact k-means on integers with Shallot search.

Every vector carries its nearest and second nearest centroid and two bounds: its
distance to the nearest is at most ``upper``, to all others at least ``lower``.
When the centroids move, the bounds move by how far each went; while ``upper``
stays below ``lower`` the vector needs no distance at all.  Otherwise the search
starts from the closer one of the two remembered centroids and walks its
neighbours in the order of their distance from it.  A neighbour that is farther
from the start than the vector plus the second best distance found so far cannot
be among the best two, nor can any behind it, and that ball shrinks with every
better find.  Bounds are floats with a margin and only spare work; what they do
not exclude is compared as exact integers, ties go to the smaller number.

Vectors are searched in batches inside the tasks, new centroids are sums over
task-wise sums.  The state goes to a stage table after each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import staged, table

SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
# Bounds are widened by this share, far more than their rounding errors.
MARGIN = 1e-9
ROWS = 4096
# Components beyond have no squared distances in 64 bits.
LARGEST = 1 << 31


@dataclass
class State:
    """What each vector remembers."""

    cluster: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances as int64, or an error where they do not fit."""
    gap = vectors - centroid
    if gap.size and float(np.abs(gap).max()) > 2**28:
        if (gap.astype(float) ** 2).sum(axis=1).max() >= 2**63:
            raise OverflowError("a squared distance is beyond 64 bits")
    return np.einsum("ij,ij->i", gap, gap)


@dataclass
class Searcher:
    """Centroids with their neighbours by distance."""

    centroids: np.ndarray
    compared: int = 0

    def __post_init__(self):
        spread = self.centroids.astype(float)
        self.apart = np.sqrt(((spread[:, None] - spread[None]) ** 2).sum(axis=2)) * (1 - MARGIN)
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        others = self.apart + np.where(np.eye(len(spread), dtype=bool), np.inf, 0)
        self.half = others.min(axis=1, initial=np.inf) / 2

    def distance(self, vectors: np.ndarray, k: int) -> np.ndarray:
        self.compared += len(vectors)
        return squared(vectors, self.centroids[k])

    def to_own(self, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Squared distance of each vector to the centroid it names."""
        out = np.zeros(len(vectors), np.int64)
        for k in np.unique(own):
            out[own == k] = self.distance(vectors[own == k], k)
        return out

    def first(self, vectors: np.ndarray) -> State:
        """No bounds yet: nothing is excluded ahead of the search."""
        n, last = len(vectors), min(1, len(self.centroids) - 1)
        state = State(np.zeros(n, np.int32), np.full(n, last, np.int32), np.full(n, np.inf), np.zeros(n))
        self.settle(vectors, state)
        return state

    def settle(self, vectors: np.ndarray, state: State) -> None:
        """Make ``state`` right for these centroids."""
        if len(self.centroids) < 2:
            state.lower[:] = np.inf
            return
        free = np.maximum(state.lower, self.half[state.cluster])
        doubtful = np.flatnonzero(~(state.upper < free))
        near = self.to_own(vectors[doubtful], state.cluster[doubtful])
        state.upper[doubtful] = np.sqrt(near.astype(float)) * (1 + MARGIN)
        lost = ~(state.upper[doubtful] < free[doubtful])
        at, near = doubtful[lost], near[lost]
        if not len(at):
            return
        a, b = state.cluster[at].astype(np.int64), state.second[at].astype(np.int64)
        far = self.to_own(vectors[at], b)
        swap = (far < near) | ((far == near) & (b < a))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        near, far = np.where(swap, far, near), np.where(swap, near, far)
        for start in np.unique(a):
            own = np.flatnonzero(a == start)
            self.scan(vectors[at[own]], int(start), own, a, b, near, far)
        state.cluster[at], state.second[at] = a, b
        state.upper[at] = np.sqrt(near.astype(float)) * (1 + MARGIN)
        state.lower[at] = np.sqrt(far.astype(float)) * (1 - MARGIN)

    def scan(self, vectors: np.ndarray, start: int, own: np.ndarray, a: np.ndarray, b: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        """Walk the neighbours of ``start`` for the vectors at ``own``; a, b, near and far are their best two."""
        from_start = np.sqrt(near[own].astype(float)) * (1 + MARGIN)
        known = b[own].copy()
        left = np.arange(len(own))
        for k in self.order[start]:
            if k == start:
                continue
            ball = from_start[left] + np.sqrt(far[own[left]].astype(float)) * (1 + MARGIN)
            left = left[self.apart[start, k] <= ball]
            if not len(left):
                return
            try_ = left[known[left] != k]
            found, rows = self.distance(vectors[try_], k), own[try_]
            best = (found < near[rows]) | ((found == near[rows]) & (k < a[rows]))
            next_ = ~best & ((found < far[rows]) | ((found == far[rows]) & (k < b[rows])))
            b[rows] = np.where(best, a[rows], np.where(next_, k, b[rows]))
            far[rows] = np.where(best, near[rows], np.where(next_, found, far[rows]))
            a[rows] = np.where(best, k, a[rows])
            near[rows] = np.where(best, found, near[rows])


def moved(state: State, drift: np.ndarray) -> None:
    """Bounds after each centroid went ``drift`` far."""
    state.upper += drift[state.cluster] * (1 + MARGIN)
    most = np.sort(drift)[::-1]
    others = np.where(drift[state.cluster] == most[0], most[1] if len(most) > 1 else 0, most[0])
    state.lower -= others * (1 + MARGIN)


VECTOR = T.StructField("vector", T.ArrayType(T.LongType()))
STATE = [
    T.StructField("cluster", T.IntegerType()), T.StructField("second", T.IntegerType()),
    T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()),
]
STATE_NAMES = [field.name for field in STATE]


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def lists(vectors: np.ndarray) -> pa.Array:
    n, d = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(vectors.reshape(-1)))


def integer_vectors(df: DataFrame, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """Rows of ``df`` whose vector has ``dimensions`` finite components, as floor(scale * x) in ``vector``."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                column = part.column(vector_col)
                right = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dimensions)
                part = part.take(pa.array(right))
                values = part.column(vector_col).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimensions)
                whole = np.flatnonzero(np.isfinite(values).all(axis=1))
                scaled = np.floor(scale * values[whole])
                if scaled.size and np.abs(scaled).max() > LARGEST:
                    raise OverflowError("a component is beyond 32 bits after scaling")
                yield pa.record_batch([part.column("id").take(pa.array(whole)), lists(scaled.astype(np.int64))], ["id", "vector"])

    return df.mapInArrow(convert, T.StructType([df.schema["id"], VECTOR]))


def assigned(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """``rows`` with their state for ``centroids``; ``drift`` says how far these went since the state was written."""
    dimensions = centroids.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = matrix(part.column("vector"), dimensions)
                if drift is None:
                    state = searcher.first(vectors)
                else:
                    state = State(*[part.column(c).to_numpy(zero_copy_only=False).copy() for c in STATE_NAMES])
                    moved(state, drift)
                    searcher.settle(vectors, state)
                columns = [part.column("id"), part.column("vector"), state.cluster.astype(np.int32), state.second.astype(np.int32), state.upper, state.lower]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["id", "vector", *STATE_NAMES])

    return rows.mapInArrow(search, T.StructType([rows.schema["id"], VECTOR, *STATE]))


def next_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster; a cluster without vectors stays where it is.

    A task sends at most ``k`` sums for each batch, ``k * dimensions`` numbers come back.
    """
    k, dimensions = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, own = matrix(batch.column("vector"), dimensions), batch.column("cluster").to_numpy()
            found = np.unique(own)
            if not len(found):
                continue
            sums = np.stack([np.append(vectors[own == c].sum(axis=0), (own == c).sum()) for c in found])
            yield pa.record_batch([pa.array(found), lists(sums)], ["cluster", "sums"])

    local = state.select("vector", "cluster").mapInArrow(add, "cluster int, sums array<long>")
    totals = local.select("cluster", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("part").alias("total"))
    sums = np.zeros((k, dimensions + 1), object)
    for row in totals.collect():
        sums[row.cluster, row.at] = row.total
    return np.array([[s // n for s in row[:-1]] if (n := row[-1]) else old for row, old in zip(sums, centroids.tolist(), strict=True)], np.int64).reshape(k, dimensions)


def starting_centroids(rows: DataFrame, k: int, dimensions: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``; ties by components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = rows.select(key.alias("key"), "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()
    return np.array([r.vector for r in chosen], np.int64).reshape(len(chosen), dimensions)


def clusters(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64, k: int = CENTROIDS,
    rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) for every usable vector, and the final centroids.

    A vector is usable with exactly ``dimensions`` components, none null or not
    finite; others give no row.  Components become floor(scale * x), distances are
    squared and exact; beyond 64 bits they are an error.  Ties go to the smaller
    number.  Fewer than ``k`` usable vectors make that many centroids, repeated
    vectors may make equal ones, of which the later stay empty.  Repeated and null
    ids are rows like others, other columns are not looked at, an empty table
    gives no rows.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows = staged(integer_vectors(own, "vector", dimensions, scale), "centroid-vectors")
    centroids = starting_centroids(rows, k, dimensions, seed)
    drift = None
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        rows = staged(assigned(rows, centroids, drift), "centroid-state")
        new = next_centroids(rows, centroids)
        drift = np.sqrt(((new - centroids).astype(float) ** 2).sum(axis=1))
        centroids = new
    last = assigned(rows, centroids, drift)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(centroids)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            distance = searcher.to_own(matrix(batch.column("vector"), dimensions), cluster)
            yield pa.record_batch([batch.column("id"), pa.array(cluster), pa.array(distance)], [id_col, "cluster", "distance"])

    kind = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), STATE[0], T.StructField("distance", T.LongType())])
    return staged(last.mapInArrow(measure, kind), "centroid-clusters"), centroids


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    own = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # a row for each centroid
    facts = [(k, ",".join(map(str, centroids[k].tolist())), total, sum(own.values())) for k, total in own.items()]
    shown = spark.createDataFrame(facts, "cluster int, components string, cluster_inertia long, inertia long")
    return found.join(F.broadcast(shown), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256")
    )


def _twin() -> str:
    """The rounds one after the other as SQL, by comparing all vectors with all centroids."""
    parts = [
        """
v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as (
  select (row_number() over (order by sha256('1:' || vec_id), v) - 1)::int as cluster, v as c from v
  qualify row_number() over (order by sha256('1:' || vec_id), v) <= 16
)"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""
a{r} as (
  select vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, k := cluster)) as best
  from (select row_number() over () as nr, * from v) v, c{r} group by nr, vec_id, v
)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""
m{r} as (
  select best.k as cluster, i, sum(v[i])::bigint as s, count(*) as n from a{r}, (select unnest(range(1, 65)) as i) group by all
), c{r + 1} as (
  select cluster, coalesce(list((s - ((s % n) + n) % n) // n order by i) filter (n is not null), any_value(c)) as c
  from c{r} left join m{r} using (cluster) group by cluster
)"""
            )
    return (
        "with "
        + ", ".join(parts)
        + f"""
select vec_id, best.k as cluster, best.d as distance, (sum(best.d) over (partition by best.k))::bigint as cluster_inertia,
       (sum(best.d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} on cluster = best.k
"""
    )


OP11_SQL = _twin()
