"""Centroid clustering with exact integers, screened by float32 matrix products.

A batch of vectors is multiplied by all centroids in float32. Each product has a rounding error of at most
gamma(66) * |x| * |c| (64 products and both conversions, in any order of summation), so |c|^2 - 2 x.c lies in a known
interval. Centroids whose interval begins above the least upper end are out; vectors with one centroid left are assigned,
for the others the distances of those left are computed again in 64-bit integers, ties to the smaller number. So the
result is that of exact arithmetic, whatever the order and shape of the batches.

A round is one pass over the vectors: each task sums the vectors of each centroid and yields k rows; these are added by
centroid and bucket of tasks, then by centroid, so no vectors are shuffled and only k sums reach the driver.

Cases: vectors with another number of components, a null or a non-finite one, and null vectors are left out. Components
beyond narrow() (far above what embeddings hold) take Python's integers throughout; a distance or sum beyond a long is null.
Repeated ids and rows count as often as they stand; equal hashes of initial centroids are ordered by their components.
A null id is assigned a cluster, but is never an initial centroid. With fewer vectors than centroids there are fewer
centroids; without any the result is empty. Extra columns are ignored.
"""

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import free, written

#: Vectors that are multiplied at once.
ROWS = 4096
#: Buckets in which the sums of tasks are added before those of a centroid meet.
BUCKETS = 128
#: Unit roundoff of float32.
UNIT = 2.0**-24


def narrow(size: int) -> int:
    """Components from here on leave 64-bit arithmetic: below, size squares of differences stay under 2 ** 62."""
    return 1 << (62 - (size - 1).bit_length()) // 2 - 1


def integers(vectors: pa.Array, size: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows, their integers floor(scale * x) and whether these are wide, for the vectors that are kept; scale is a power of two."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    some = np.flatnonzero(lengths == size)
    if not len(some):
        return
    parts = vectors.take(pa.array(some)).flatten()
    x = parts.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
    fine = np.isfinite(x).all(axis=1)
    some, x = some[fine], x[fine]
    large = (np.abs(x) >= narrow(size) / scale).any(axis=1)
    if not large.all():
        yield some[~large], np.floor(x[~large] * scale).astype(np.int64), False
    for row, own in zip(some[large], x[large], strict=True):
        whole = [int(v) * scale if abs(v) > 1 << 53 else math.floor(v * scale) for v in own.tolist()]
        yield np.array([row]), np.array([whole], dtype=object), True


def shortlists(x: np.ndarray, centroids: np.ndarray, products: np.ndarray | None = None) -> np.ndarray:
    """(vectors, centroids): whether a centroid may be the nearest. products: float32 x.c, where they are given."""
    n = x.shape[1] + 2
    gamma = n * UNIT / (1 - n * UNIT)
    if products is None:
        products = x.astype(np.float32) @ centroids.astype(np.float32).T
    xs, cs = x.astype(np.float64), centroids.astype(np.float64)
    squares = np.einsum("ij,ij->i", cs, cs)
    # 1e-9 is far above what the float64 steps here lose
    error = (2 * gamma * (1 + 1e-9)) * np.sqrt(np.einsum("ij,ij->i", xs, xs))[:, None] * np.sqrt(squares)[None, :]
    middle = squares[None, :] - 2 * products.astype(np.float64)
    error += 1e-12 * (squares[None, :] + 2 * np.abs(products))
    return middle - error <= (middle + error).min(axis=1)[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray, wide: bool = False) -> np.ndarray:
    """The number of the nearest centroid of each vector, the smaller one of a tie."""
    if wide or centroids.dtype == object:
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids.tolist()] for v in x.tolist()]
        return np.array([min(range(len(row)), key=row.__getitem__) for row in far], np.int64)
    found = np.empty(len(x), np.int64)
    for begin in range(0, len(x), ROWS):
        part = x[begin : begin + ROWS]
        left = shortlists(part, centroids)
        best = left.argmax(axis=1)
        for row in np.flatnonzero(left.sum(axis=1) > 1):
            among = np.flatnonzero(left[row])
            best[row] = among[((centroids[among] - part[row]) ** 2).sum(axis=1).argmin()]
        found[begin : begin + ROWS] = best
    return found


def distances(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, wide: bool = False) -> list[int]:
    if wide or centroids.dtype == object:
        return [sum((a - b) ** 2 for a, b in zip(v, centroids[c].tolist(), strict=True)) for v, c in zip(x.tolist(), cluster, strict=True)]
    return ((x - centroids[cluster]) ** 2).sum(axis=1).tolist()


def as_array(rows: Iterable[list[int]]) -> np.ndarray:
    rows = list(rows)
    return np.array(rows, dtype=object if any(abs(v) >= narrow(len(row)) for row in rows for v in row) else np.int64)


def initial(vectors: DataFrame, k: int, seed: int, size: int, scale: int) -> list[list[int]]:
    """The k kept vectors with the smallest hash, in its order."""

    def run(batches):
        for batch in batches:
            rows, wholes = [], []
            for at, x, _ in integers(batch.column("x"), size, scale):
                rows += at.tolist()
                wholes += [list(map(str, v)) for v in x.tolist()]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("x").take(at).cast(pa.list_(pa.float64())), pa.array(wholes, pa.list_(pa.string()))], ["id", "x", "whole"])

    kept = vectors.where("id IS NOT NULL").mapInArrow(run, "id bigint, x array<double>, whole array<string>")
    place = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), "UTF-8"), 256)
    first = kept.select(place.alias("place"), "x", "whole").orderBy("place", "x").limit(k)
    return [[int(v) for v in r.whole] for r in first.collect()]  # k rows


def _added(rows: pa.Table) -> tuple[int, list[int]]:
    total, sums = 0, None
    for n, own in zip(rows.column("n").to_pylist(), rows.column("sums").to_pylist(), strict=True):
        total += n
        own = [int(v) for v in own]
        sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
    return total, sums


SUMS = "cluster int, bucket int, n bigint, sums array<string>"


def added(partial: DataFrame, *keys: str) -> DataFrame:
    """Counts and sums (decimal digits, of any size) of the rows of each key; bucket becomes 0 beyond it."""

    def run(rows: pa.Table) -> pa.Table:
        n, sums = _added(rows)
        return pa.table({"cluster": rows.column("cluster")[:1].cast(pa.int32()), "bucket": pa.array([0], pa.int32()), "n": pa.array([n], pa.int64()), "sums": pa.array([list(map(str, sums))], pa.list_(pa.string()))})

    return partial.groupBy(*keys).applyInArrow(run, SUMS)


def moved(vectors: DataFrame, centroids: list[list[int]], size: int, scale: int) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of their vectors, as they were where there are none."""

    def run(batches):
        now, counts, sums = as_array(centroids), [0] * len(centroids), np.zeros((len(centroids), size), dtype=object)
        for batch in batches:
            for _, x, wide in integers(batch.column("x"), size, scale):
                cluster = nearest(x, now, wide)
                for c in np.unique(cluster).tolist():
                    own = x[cluster == c]
                    counts[c] += len(own)
                    sums[c] += own.sum(axis=0).astype(object)
        used = [c for c, n in enumerate(counts) if n]
        bucket = TaskContext.get().partitionId() % BUCKETS
        columns = [pa.array(used, pa.int32()), pa.array([bucket] * len(used), pa.int32()), pa.array([counts[c] for c in used], pa.int64()), pa.array([list(map(str, sums[c])) for c in used], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "bucket", "n", "sums"])

    found = added(added(vectors.mapInArrow(run, SUMS), "cluster", "bucket"), "cluster").collect()  # a row for each centroid
    means = {r.cluster: [int(v) // r.n for v in r.sums] for r in found}
    return [means.get(c, old) for c, old in enumerate(centroids)]


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared, of the integers), cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("x"))
    centroids = initial(own, k, seed, size, scale)
    for _ in range(rounds if centroids else 0):
        centroids = moved(own, centroids, size, scale)

    def run(batches):
        now = as_array(centroids)
        for batch in batches:
            rows, clusters, far = [], [], []
            for at, x, wide in integers(batch.column("x"), size, scale):
                cluster = nearest(x, now, wide)
                rows += at.tolist()
                clusters += cluster.tolist()
                far += [d if d < 1 << 63 else None for d in distances(x, now, cluster, wide)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(clusters, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    found = written(own.mapInArrow(run, "id bigint, cluster int, distance bigint"), "clusters")
    whole = lambda c: F.when(F.count(F.when(F.col("distance").isNull(), 1)) == 0, F.sum(F.col("distance").cast("decimal(38,0)"))).alias(c)
    inertia = {r.cluster: r.far for r in found.groupBy("cluster").agg(whole("far")).collect()}  # a row for each centroid
    fits = lambda n: int(n) if n is not None and n < 1 << 63 else None
    total = fits(None if None in inertia.values() else sum(inertia.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(c, fits(inertia.get(c)), total, digest(x)) for c, x in enumerate(centroids)]
    names = free(found, "of", "cluster_inertia", "inertia", "centroid_sha256")
    table = found.sparkSession.createDataFrame(facts, f"{names[0]} int, {names[1]} bigint, {names[2]} bigint, {names[3]} string")
    joined = found.join(F.broadcast(table), F.col("cluster") == F.col(names[0]))  # k rows
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """All rounds as common tables: distances of all pairs of vector and centroid, in huge integers."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS HUGEINT)"
    parts = ["""v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS x FROM embeddings
        WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS k, x FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), x LIMIT 40)"""]
    for t in range(6):
        parts.append(f"""a{t} AS (SELECT r, min_by(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT r, k, list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) FOR i IN range(1, 65)]) AS d FROM v, c{t} c) GROUP BY r)""")
        if t < 5:
            parts.append(f"""m{t} AS (SELECT k, list({floor} ORDER BY i) AS x FROM (
        SELECT k, i, sum(v.x[i]) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{t} JOIN v USING (r), range(1, 65) g(i) GROUP BY k, i) GROUP BY k),
    c{t + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m ON c.k = m.k)""")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, CAST(a5.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a5.k) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256
    FROM a5 JOIN v USING (r) JOIN c5 ON a5.k = c5.k"""


ORACLE_SQL = _sql()
