"""Exact top-k by inner product with vector-approximation files.

The file is a table of codes: every component of every vector as the number of its cell, a byte, on a grid of equal
cells between the least and the largest value of that component. A scan of the codes gives every row's inner product
with a query up to an error that is known: with equal cells the bounds of the product over a row's cell are the product
with the cell's centre plus and minus half a cell's width times the query's absolute components, so one product with
the codes yields both bounds. A row whose upper bound is below the kth largest lower bound is out.

The exact vectors of the others are then read in the order of their upper bounds, a batch after another, until the
upper bound of the next is below the kth best exact score: then the result is certain, and what is left is never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import TILE, asked, by_length, distinct, exactly, expanded, largest, matrix, ranked, scanned, usable
from .common import checkpointed, written

CELLS, ROUNDING = 256, 2.0**-22


@dataclass(frozen=True)
class Grid:
    """Equal cells of each component: least values and widths."""

    low: np.ndarray
    width: np.ndarray
    slack: np.ndarray  # for the rounding of cells

    @classmethod
    def between(cls, low, high) -> Grid:
        low, high = np.asarray(low, float), np.asarray(high, float)
        return cls(low, (high - low) / CELLS, 1e-9 * np.maximum(np.abs(low), np.abs(high)))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.low) / np.where(self.width > 0, self.width, 1.0), 0, CELLS - 1).astype(np.uint8)

    def products(self, codes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Products p (a row a query) in 32 bits, with the scale s, the middle m and the error e of each query: no
        row's inner product with it is further than e from m + s * p."""
        steps = queries * self.width
        s = np.maximum(np.abs(steps).max(1), 1e-300)
        p = (steps / s[:, None]).astype(np.float32) @ codes.astype(np.float32).T
        m = queries @ (self.low + self.width / 2)
        rounding = ROUNDING * (codes.shape[1] + 2) * CELLS * np.abs(steps).sum(1)
        e = (np.abs(queries) * (self.width / 2 + self.slack)).sum(1) + rounding + 1e-9 * np.abs(m)
        return p, s, m, e


def integer_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, exact inner products of integers held in floats; an OverflowError if one needs over 64 bits."""
    if not len(x):
        return np.zeros(0, np.int64)
    most = np.abs(x).max() * np.abs(q).max() * x.shape[1]
    if most < 2**53:
        return (x * q).sum(1).astype(np.int64)
    if most < 2**63:
        return (x.astype(np.int64) * q.astype(np.int64)).sum(1)
    whole = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(x.tolist(), q.tolist(), strict=True)]
    return np.array(whole, np.int64)


def _grids(rows: DataFrame, scale: float) -> dict[int, Grid]:
    """A grid for each vector length that occurs, from the extremes of all vectors."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in by_length(batches):
            x = np.floor(scale * matrix(b["_v"]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(x.min(0)), pa.array(x.max(0))], ["_dim", "_d", "_low", "_high"])

    each = rows.mapInArrow(extremes, "_dim int, _d int, _low double, _high double").groupBy("_dim", "_d").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    found: dict[int, list] = {}
    for r in each.orderBy("_dim", "_d").collect():  # two numbers for each component
        found.setdefault(r["_dim"], []).append((r["_low"], r["_high"]))
    return {dim: Grid.between(*zip(*x, strict=True)) for dim, x in found.items()}


def exact_top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other rows of the largest
    integer inner product of floor(scale * component), ties to the smaller id; all, if there are fewer.

    Vectors that are null or empty, or hold null or non-finite components, and null ids take no part. Vectors of
    different lengths are not compared. Rows that repeat an id count once. Equal vectors are searched once, whether they
    are rows or queries, so a vector of a third of all rows costs what one row costs. Scores are exact as far as they are 64-bit
    integers; one that is not, but has to be read, ends the job with an OverflowError.
    """
    every_row = usable(vectors, id_col, vector_col)
    rows = distinct(every_row, k + 1)
    pairs, queries = asked(every_row, rows, every)
    grids = _grids(rows, scale)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in by_length(batches):
            codes = grids[dim].codes(np.floor(scale * matrix(b["_v"]).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([b["_id"], b["_dim"], pa.array([c.tobytes() for c in codes], pa.binary())], ["_id", "_dim", "_code"])

    def find(a: pa.Table, b: pa.Table, blocks: int):
        ids, out = a["_id"].to_numpy(), []
        codes = np.frombuffer(b"".join(a["_code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        order = np.argsort(ids)
        ids, codes = ids[order], codes[order]
        qids, q = b["_id"].to_numpy(), np.floor(scale * matrix(b["_v"]).astype(np.float64))
        for t in range(0, len(q), TILE):
            products, s, m, e = grids[q.shape[1]].products(codes, q[t : t + TILE])
            for j, row in enumerate(products):
                bar = -np.inf
                if len(row) > k + 1:
                    bar = row[largest(row, k + 1)].min() - 2 * e[j] / s[j]  # lower and upper bounds of a query's rows are all 2 * e apart
                at = np.flatnonzero(row >= bar)
                out.append((np.full(len(at), qids[t + j]), ids[at], m[j] + s[j] * row[at].astype(np.float64) + e[j], np.full(len(at), 2 * e[j])))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    file = written(rows.mapInArrow(quantise, "_id long, _dim int, _code binary"), "va-file")
    found = scanned(file, queries, find, "query_id long, vec_id long, upper double, apart double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id"))
    kth = F.max(F.when(F.col("place") == k + 1, F.col("upper"))).over(Window.partitionBy("query_id"))
    found = found.withColumn("place", place).withColumn("_kth", kth).filter(F.col("_kth").isNull() | (F.col("upper") >= F.col("_kth") - F.col("apart")))
    best = _read_in_order(written(found.select("query_id", "vec_id", "upper", "place"), "candidates"), rows, k + 1, scale)
    return expanded(best, pairs, rows, k)


def _read_in_order(unread: DataFrame, rows: DataFrame, k: int, scale: float) -> DataFrame:
    """The k best of each query: exact vectors are read in batches by place, four times larger each, while the upper
    bound of an unread one reaches the query's kth best score."""
    measure = lambda x, q: integer_products(np.floor(scale * x.astype(np.float64)), np.floor(scale * q.astype(np.float64)))
    best, begin, batch = None, 0, max(16, 4 * k)
    while True:
        now = unread.filter((F.col("place") > begin) & (F.col("place") <= begin + batch)).select("query_id", "vec_id")
        scores = exactly(now, rows, measure, "long")
        best = checkpointed(ranked(scores if best is None else best.select("query_id", "vec_id", "score").unionByName(scores), k))
        begin, batch = begin + batch, batch * 4
        certain = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
        unread = unread.filter(F.col("place") > begin).join(certain, "query_id", "left").filter(F.col("_kth").isNull() | (F.col("upper") >= F.col("_kth"))).drop("_kth")
        unread = checkpointed(unread)
        if unread.isEmpty():
            return best
