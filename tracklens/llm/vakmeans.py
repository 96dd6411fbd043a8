"""k-means over a vector-approximation file, in exact integers.

Every vector is stored beside its approximation: for each component the number of a cell of a few bits on a grid of
equal cells, packed. A round scans approximations only. Lookup tables, a value for each component, cell and centroid,
add up to a row's distance from each centroid if it stood in the middle of its cells; how far the distances from two
centroids can differ from that is known from the width of the cells, so that each centroid has an interval of distance
beyond the leading one. Where only the leader's interval reaches zero the assignment is certain.

What a round needs is the change of each cluster's sum. A row whose assignment is certain under the round's centroids
and under those before, and the same, changes nothing. The full vectors of the others alone are fetched: their row
numbers are shuffled to the vectors, which are stored in buckets by row number and do not move. Assignments are never
stored between rounds, so a lost executor costs a scan of its part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import matrix
from .common import delete_table, shared_folder, written

#: A component of this size or more has no distance in 64 bits from some other; rows of a bucket; least buckets.
HUGE, BUCKET_ROWS, LEAST_BUCKETS = 2.0**62, 65_536, 16
SAFE = 2**27  # below it, squared distances of up to 256 components fit 64-bit integers


class Cells:
    """The grid: 2 ** bits cells of a whole width for each component."""

    def __init__(self, low: list[int], high: list[int], bits: int):
        self.bits, self.low = bits, np.array(low, object)
        self.width = np.array([max(1, -(-(h - l + 1) // 2**bits)) for l, h in zip(low, high, strict=True)], object)

    def codes(self, x: np.ndarray) -> list[bytes]:
        """A row's cells as bits, packed."""
        cell = ((x - self.low.astype(np.int64)) // self.width.astype(np.int64)).astype(np.uint8)
        bits = np.unpackbits(cell[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [c.tobytes() for c in np.packbits(bits.reshape(len(x), -1), axis=1)]

    def unpacked(self, codes: list[bytes], dim: int) -> np.ndarray:
        raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        bits = np.unpackbits(raw, axis=1)[:, : dim * self.bits].reshape(len(codes), dim, self.bits)
        return bits @ (1 << np.arange(self.bits)[::-1])


class Bounds:
    """Lookup tables of a set of centroids."""

    def __init__(self, cells: Cells, centroids: list[list[int]]):
        c = np.array(centroids, float)
        middle = cells.low.astype(float) + cells.width.astype(float) * (np.arange(2**cells.bits)[:, None]) + (cells.width.astype(float) - 1) / 2
        self.table = (middle.T[:, :, None] - c.T[:, None, :]) ** 2  # component, cell, centroid
        self.apart = np.abs(c[:, None] - c[None]) @ (cells.width.astype(float) - 1)

    def possible(self, cell: np.ndarray) -> np.ndarray:
        """Which centroids' intervals reach the leader's (a row each)."""
        middle = np.zeros((len(cell), self.table.shape[2]))
        for d, table in enumerate(self.table):
            middle += table[cell[:, d]]
        lead = middle.argmin(1)
        rows = np.arange(len(cell))
        rounding = 1e-9 * (middle + middle[rows, lead][:, None])
        return middle - middle[rows, lead][:, None] - self.apart[lead] <= rounding


def squared(x: np.ndarray, c: list[int]) -> np.ndarray:
    """Exact squared distances of the rows of x from c: 64-bit integers where they fit, whole numbers else."""
    if len(x) == 0 or (np.abs(x).max() < SAFE and max(map(abs, c)) < SAFE and x.shape[1] <= 256):
        return ((x - np.array(c, np.int64)) ** 2).sum(1)
    return ((x.astype(object) - np.array(c, object)) ** 2).sum(1)


def nearest(x: np.ndarray, centroids: list[list[int]], possible: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of the rows of x, ties to the smaller number; among the possible centroids, all of
    which can be nearest and one of which is."""
    best, distance = np.zeros(len(x), np.int32), np.full(len(x), -1, object)
    for k, c in enumerate(centroids):
        at = np.arange(len(x)) if possible is None else np.flatnonzero(possible[:, k])
        d = squared(x[at], c)
        nearer = (distance[at] < 0) | (d < distance[at])
        best[at[nearer]], distance[at[nearer]] = k, d[nearer]
    return best, distance


def _integers(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: float) -> DataFrame:
    """(_id, _x): the vectors that are kept, as integers."""
    usable = F.forall("_v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).filter(F.col("_id").isNotNull() & (F.size("_v") == dim) & usable)
    scaled = lambda x: F.lit(scale) * x
    whole = lambda x: F.when(F.abs(scaled(x)) < HUGE, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("OverflowError: a component is too large for 64-bit integers")).cast("long"))
    return rows.select("_id", F.transform("_v", whole).alias("_x"))


def _cells(rows: DataFrame, bits: int) -> Cells | None:
    """The grid between the extremes of all vectors; None if there are none."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b["_x"])
                yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1]), pa.int32()), pa.array(x.min(0)), pa.array(x.max(0))], ["d", "low", "high"])

    found = rows.select("_x").mapInArrow(extremes, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()  # a row for each component
    return Cells([r["low"] for r in found], [r["high"] for r in found], bits) if found else None


_SUMS = "cluster int, rows long, sums array<decimal(38,0)>"


def _partial_sums(x: np.ndarray, clusters: np.ndarray, k: int, sign: int) -> Iterator[tuple[int, int, list[int]]]:
    for c in range(k):
        mine = x[clusters == c]
        if len(mine):
            whole = mine if np.abs(mine).max() < 2**62 // len(mine) else mine.astype(object)
            yield c, sign * len(mine), [sign * int(s) for s in whole.sum(0)]


def _sums_batch(found: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["cluster", "rows", "sums"])


def _totals(partial: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(rows, sums) by cluster, of partial sums: a number for each cluster and component goes to the driver."""
    each = partial.select("cluster", "rows", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("rows").alias("rows"), F.sum("s").alias("s")).orderBy("cluster", "d")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.collect():
        out.setdefault(r["cluster"], (r["rows"], []))[1].append(int(r["s"]))
    return out


def centroid_clusters(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, seed: int = 3, bits: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector with `dim` components, none
    null or non-finite, each taken as floor(scale * component).

    Centroids 0, 1, ... start as the k vectors of the smallest sha256 of `seed:id`. A round assigns every vector to the
    nearest centroid (squared Euclidean distance, ties to the smaller number) and moves each centroid that has vectors
    to the floors of their means; after the last round vectors are assigned once more. Rows with a null id take no part;
    rows that repeat count each time (of equal ids the smaller vector comes first among the starts). With fewer than k
    vectors there are as many centroids; an empty table gives no rows. Components beyond 2 ** 62 and distances beyond 64
    bits end the job with an OverflowError.
    """
    spark = vectors.sparkSession
    rows = _integers(vectors, id_col, vector_col, dim, scale)
    out = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    cells = _cells(rows, bits)
    if cells is None:
        return spark.createDataFrame([], out)
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    centroids = [list(r["_x"]) for r in rows.orderBy(start, "_x").limit(k).collect()]
    table, path = f"tracklens_vectors_{uuid.uuid4().hex}", f"{shared_folder(spark)}/tracklens-vectors-{uuid.uuid4().hex}"

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["_row"], b["_id"], pa.array(cells.codes(matrix(b["_x"])), pa.binary()), b["_x"]], ["_row", "_id", "_code", "_x"])

    numbered = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_id", "_x")
    coded = numbered.mapInArrow(approximate, "_row long, _id long, _code binary, _x array<long>")
    buckets = max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS))
    coded.repartition(buckets, "_row").write.bucketBy(buckets, "_row").sortBy("_row").option("path", path).saveAsTable(table)
    file = spark.read.table(table)

    totals: dict[int, tuple[int, list[int]]] = {}
    before: list[list[int]] | None = None
    for _ in range(rounds):
        partial = _first_sums(file, cells, centroids, dim) if before is None else _changed_sums(file, cells, before, centroids, dim)
        for c, (n, sums) in _totals(partial).items():
            m, old = totals.get(c, (0, [0] * dim))
            totals[c] = (m + n, [a + b for a, b in zip(old, sums, strict=True)])
        before, moved = centroids, [[s // totals[c][0] for s in totals[c][1]] if totals.get(c, (0,))[0] else old for c, old in enumerate(centroids)]
        centroids = moved
        if moved == before:  # every later round is the same
            break
    final = written(_assigned(file, cells, centroids, dim, id_col), "clusters")
    delete_table(spark, table, path)
    inertias = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(c, inertias.get(c, 0), sum(inertias.values()), digest(x)) for c, x in enumerate(centroids)]
    known = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(known), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _first_sums(file: DataFrame, cells: Cells, centroids, dim: int) -> DataFrame:
    """The sums of all clusters: every vector is read, its distances from the possible centroids alone are computed."""
    bounds = Bounds(cells, centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b["_x"])
                near, _ = nearest(x, centroids, bounds.possible(cells.unpacked(b["_code"].to_pylist(), dim)))
                yield _sums_batch(list(_partial_sums(x, near, len(centroids), 1)))

    return file.select("_code", "_x").mapInArrow(add, _SUMS)


def uncertain_rows(file: DataFrame, cells: Cells, before, centroids, dim: int) -> DataFrame:
    """(_row, _old, _new) of the rows whose vectors are needed: possible centroids, as bits, under both sets."""
    old_bounds, new_bounds = Bounds(cells, before), Bounds(cells, centroids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = cells.unpacked(b["_code"].to_pylist(), dim)
                old, new = old_bounds.possible(cell), new_bounds.possible(cell)
                needed = (old.sum(1) > 1) | (new.sum(1) > 1) | (old != new).any(1)
                pack = lambda m: pa.array([r.tobytes() for r in np.packbits(m[needed], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([b["_row"].filter(pa.array(needed)), pack(old), pack(new)], ["_row", "_old", "_new"])

    return file.select("_row", "_code").mapInArrow(scan, "_row long, _old binary, _new binary")


def _changed_sums(file: DataFrame, cells: Cells, before, centroids, dim: int) -> DataFrame:
    """What the clusters' sums gain and lose when centroids take the place of `before`."""
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b["_x"])
            masks = [np.unpackbits(np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(len(x), -1), axis=1)[:, :k].astype(bool) for c in ("_old", "_new")]
            old, new = (nearest(x, c, m)[0] for c, m in zip((before, centroids), masks, strict=True))
            moved = old != new
            found = [*_partial_sums(x[moved], new[moved], k, 1), *_partial_sums(x[moved], old[moved], k, -1)]
            if found:
                yield _sums_batch(found)

    needed = uncertain_rows(file, cells, before, centroids, dim)
    return needed.join(file.select("_row", "_x"), "_row").select("_x", "_old", "_new").mapInArrow(add, _SUMS)


def _assigned(file: DataFrame, cells: Cells, centroids, dim: int, id_col: str) -> DataFrame:
    bounds = Bounds(cells, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, distance = nearest(matrix(b["_x"]), centroids, bounds.possible(cells.unpacked(b["_code"].to_pylist(), dim)))
                yield pa.RecordBatch.from_arrays([b["_id"], pa.array(near), pa.array([int(d) for d in distance], pa.int64())], [id_col, "cluster", "distance"])

    return file.select("_id", "_code", "_x").mapInArrow(assign, f"`{id_col}` long, cluster int, distance long")
