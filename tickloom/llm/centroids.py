"""Exact k-means over integer vectors by bounded assignment with a shrinking ball (Shallot search).

A vector remembers its centroid ``a``, the second nearest ``b``, an upper bound of its distance to ``a`` and a lower bound of
its distance to every other centroid. When centroids move, the bounds are loosened by the moves (the lower one by the largest
move among the others). While upper < lower, ``a`` is still the nearest and nothing is computed. Otherwise the distance to ``a``
is made exact, and if that does not settle it, so is that to ``b``; the scan then starts from the closer of the two, p. Any
centroid that could be among the two nearest lies in a ball around p of radius (distance to p) + (second smallest distance so
far). The other centroids are visited in the order of their distance from p, the second smallest distance shrinks as they are,
and the ball with it; a vector leaves the scan at the first centroid outside. Whoever is visited is compared by squared
distances in integers, so that ties fall to the smaller number exactly; bounds and radii are doubles rounded away from a
wrong decision.

A round is one pass over the vectors: the table of vectors and bounds is written with one row more for each task and
centroid, the sums of its vectors. Only these sums (centroids x components, by partial aggregation) come to the driver, which
holds the centroids: k x components numbers, a size that the caller sets and the data do not. The former table is deleted.

Rows whose vector has another number of components, a null, a NaN or an infinity take no part. Equal vectors, and rows that
share a ``vec_id``, are rows of their own; equal hashes at the choice of first centroids fall to the smaller vector. A null
``vec_id`` is hashed as an empty one. With fewer vectors than k there are fewer centroids; an empty table gives no rows.
Components beyond ``LARGEST`` in absolute value are refused with an error, since squared distances would leave 64 bits. Only
``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import pick, released, table, written

#: 64 squares of differences of twice this size stay below 2**63.
LARGEST = 1 << 27
STATE = "vec_id long, v array<int>, a int, b int, upper double, lower double, squared long, members long, sums array<long>"
#: Vectors that one step compares; bounds a worker's memory.
ROWS = 4096


def integers(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of the usable vectors."""
    x = F.col("embedding")
    usable = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    bound = F.forall(scaled, lambda c: F.abs(c) <= LARGEST)
    whole = F.when(bound, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a vector component lies beyond {LARGEST}")).cast("array<int>"))
    return pick(rows, "vec_id", "embedding").filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, as integers."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def up(x):
    return np.nextafter(np.sqrt(x), np.inf)


def down(x):
    return np.maximum(np.nextafter(np.sqrt(x), -np.inf), 0.0)


class Search:
    """Centroids with, for each, the others sorted by distance; and how far they moved since the round before."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.c, k = now, len(now)
        apart = np.stack([distances(now, np.broadcast_to(row, now.shape)) for row in now])
        order = np.argsort(apart + 0, axis=1, kind="stable")
        self.others = np.stack([row[row != i] for i, row in enumerate(order)])
        self.apart = down(np.take_along_axis(apart, self.others, 1).astype(np.float64))
        moved = np.zeros(k) if before is None else up(distances(now, before).astype(np.float64)) * (distances(now, before) > 0)
        self.moved = moved
        # The largest move among the others than each centroid.
        top = np.argsort(moved)[::-1]
        self.largest = np.full(k, moved[top[0]] if k else 0.0)
        if k:
            self.largest[top[0]] = moved[top[1]] if k > 1 else 0.0

    def loosened(self, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nextafter(upper + self.moved[a], np.inf), np.nextafter(lower - self.largest[a], -np.inf)

    def scan(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray) -> None:
        """The two nearest centroids of each row, in place: start at the closer one, visit its sorted others, shrink the ball."""
        swap = (db < da) | ((db == da) & (b < a))
        a[swap], b[swap], da[swap], db[swap] = b[swap], a[swap], db[swap], da[swap]
        center, near, other = a.copy(), up(da.astype(np.float64)), b.copy()
        live = np.arange(len(x))
        for t in range(self.others.shape[1]):
            live = live[self.apart[center[live], t] <= near[live] + up(db[live].astype(np.float64))]
            if not len(live):
                break
            j = self.others[center[live], t]
            fresh = j != other[live]
            at, j = live[fresh], j[fresh]
            d = distances(x[at], self.c[j])
            first = (d < da[at]) | ((d == da[at]) & (j < a[at]))
            second = ~first & ((d < db[at]) | ((d == db[at]) & (j < b[at])))
            s = at[first]
            b[s], db[s] = a[s], da[s]
            a[s], da[s] = j[first], d[first]
            s = at[second]
            b[s], db[s] = j[second], d[second]

    def assign(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Updates a, b and the bounds in place; the number of vectors that were scanned comes back."""
        if len(self.c) < 2:
            a[:], b[:], lower[:] = 0, 0, np.inf
            upper[:] = up(distances(x, self.c[a]).astype(np.float64))
            return np.zeros(0, np.int64)
        upper[:], lower[:] = self.loosened(a, upper, lower)
        open_ = np.flatnonzero(upper >= lower)
        da = distances(x[open_], self.c[a[open_]])
        upper[open_] = up(da.astype(np.float64))
        still = upper[open_] >= lower[open_]
        open_, da = open_[still], da[still]
        part, one, two = x[open_], a[open_], b[open_]
        db = distances(part, self.c[two])
        self.scan(part, one, two, da, db)
        a[open_], b[open_] = one, two
        upper[open_], lower[open_] = up(da.astype(np.float64)), down(db.astype(np.float64))
        return open_


def assigned(search: Search, fresh: bool, exact: bool, batches):
    """One pass: vectors with new bounds, then the sums of this task's vectors by centroid.

    ``fresh`` starts without bounds; ``exact`` adds the squared distance to the centroid (the last pass needs it).
    """
    k, dims = search.c.shape
    sums, members, inertia = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("a", pa.int32()), ("b", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("squared", pa.int64()), ("members", pa.int64()), ("sums", pa.list_(pa.int64()))])
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            n = batch.num_rows
            flat = batch.column("v").flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(n, dims).astype(np.int64)
            if fresh:
                a, b, upper, lower = np.zeros(n, np.int64), np.full(n, min(1, k - 1), np.int64), np.full(n, np.inf), np.zeros(n)
            else:
                a, b = (batch.column(c).to_numpy().astype(np.int64) for c in ("a", "b"))
                upper, lower = (batch.column(c).to_numpy().copy() for c in ("upper", "lower"))
            search.assign(x, a, b, upper, lower)
            order = np.argsort(a, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]])) if n else order
            sums[a[order][heads]] += np.add.reduceat(x[order], heads, axis=0) if n else 0
            members += np.bincount(a, minlength=k)
            squared = distances(x, search.c[a]) if exact else None
            if exact:
                for j, d in zip(a[order][heads].tolist(), np.add.reduceat(squared[order], heads).tolist() if n else []):
                    inertia[j] += d
            offsets = pa.array(np.arange(0, (n + 1) * dims, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.ListArray.from_arrays(offsets, flat), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(upper), pa.array(lower), pa.array(squared, pa.int64()) if exact else pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
    used = np.flatnonzero(members)
    m = len(used)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), pa.array(used, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array([inertia[i] for i in used], pa.int64()), pa.array(members[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], schema=schema)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors goes to the floor of their mean."""
    parts = state.filter("members IS NOT NULL").select("a", "members", F.posexplode("sums").alias("i", "s"))
    out = centroids.copy()
    for r in parts.groupBy("a", "i").agg(F.sum("members").alias("n"), F.sum("s").alias("s")).collect():
        out[r["a"], r["i"]] = r["s"] // r["n"]
    return out


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    The k vectors of smallest hashed id are the first centroids; each of ``rounds`` assigns every vector and moves the
    centroids, and the vectors are assigned once more.
    """
    vectors = integers(rows, dims, scale)
    centroids, before, state = first_centroids(vectors, k, seed), None, None
    columns = ("vec_id", "v", "a", "b", "upper", "lower")
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for r in range(rounds + 1):
        search, old = Search(centroids, before), state
        source = vectors if r == 0 else state.filter("members IS NULL").select(*columns)
        state = written(source.mapInArrow(partial(assigned, search, r == 0, r == rounds), STATE), "clusters")
        if old is not None:
            released(old)
        if r < rounds:
            before, centroids = centroids, moved(state, centroids)
    sums = {r["a"]: r["s"] for r in state.filter("members IS NOT NULL").groupBy("a").agg(F.sum("squared").alias("s")).collect()}
    names = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    facts = rows.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    own = state.filter("members IS NULL").select("vec_id", F.col("a").alias("cluster"), F.col("squared").alias("distance"))
    return own.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _round(n: int) -> str:
    """One round in SQL: distances to every centroid, the nearest, and the moved centroids."""
    return f"""
p{n} AS MATERIALIZED (SELECT row, vec_id, v, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT row, vec_id, x.v, c, CAST(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x CROSS JOIN c{n} y) GROUP BY row, vec_id, v),
m{n} AS (SELECT c, i, sum(CAST(e AS HUGEINT)) AS s, count(*) AS k FROM (SELECT best.c AS c, unnest(v) AS e, unnest(range(64)) AS i FROM p{n}) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(g.v, c{n}.v) AS v FROM c{n} LEFT JOIN (SELECT c, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS v FROM m{n} GROUP BY c) g ON g.c = c{n}.c)"""


SQL = f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM x ORDER BY h, v LIMIT 16)),
{",".join(_round(n) for n in range(4))},
o AS (SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance FROM p3)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM o JOIN c3 ON c3.c = o.cluster
"""
