"""Search of a query set against all rows: codes are scanned block by block, exact vectors are read for a shortlist.

Coded rows and queries are dealt into blocks by a hash of their id. Each block of codes meets each block of queries in
a task of its own, so neither side is ever broadcast or held whole. A task returns the rows of its block that can be
among a query's best; exact vectors are joined to those pairs only, or come with the codes where the task itself decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of a block of codes as 32-bit floats, and of a block of queries as 64-bit floats.
ROW_BYTES, QUERY_BYTES, LEAST_ROWS, TILE = 1 << 25, 1 << 25, 4096, 128


def usable(vectors: DataFrame, id_col: str, vector_col: str, *, nonzero: bool = False) -> DataFrame:
    """(_id, _dim, _v): a table of the rows with an id and a vector without null or non-finite components.

    Rows that repeat an id count once, with the smallest of their vectors.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v")).filter(F.col("_id").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda x: F.coalesce(fine(x), F.lit(False))))
    rows = rows.filter(F.exists("_v", lambda x: x != 0)) if nonzero else rows
    return written(rows.groupBy("_id").agg(F.min("_v").alias("_v")).select("_id", F.size("_v").alias("_dim"), "_v"), "vectors")


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(_id, _dim, _v, _ids) of rows (_id, _dim, _v): every vector once, with the `keep` smallest ids that have it.

    A window's limit cuts each task's rows before the shuffle, so that a vector of a third of all rows sends `keep` rows
    of each task.
    """
    place = F.row_number().over(Window.partitionBy("_v").orderBy("_id"))
    few = rows.withColumn("_place", place).filter(F.col("_place") <= keep).drop("_place")
    return written(few.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids")).select(F.col("_ids")[0].alias("_id"), F.size("_v").alias("_dim"), "_v", "_ids"), "distinct-vectors")


def asked(rows: DataFrame, vectors: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, _id), vectors of the queries): for each row whose id is divisible by `every` the id that stands for
    its vector, and of the distinct vectors those with a query."""
    pairs = written(rows.filter(F.col("_id") % every == 0).select(F.col("_id").alias("query_id"), "_v").join(vectors.select("_v", "_id"), "_v").select("query_id", "_id"), "queries")
    return pairs, written(vectors.join(pairs.select("_id").distinct(), "_id", "left_semi").select("_id", "_dim", "_v"), "query-vectors")


def expanded(best: DataFrame, pairs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, of the best k + 1 vectors of its vector, each of
    which has its k + 1 smallest ids. No other row can be among the k best, for equal vectors score alike and ties go to
    the smaller id; the query's own row is one of a vector's at most."""
    ids = best.join(vectors.select(F.col("_id").alias("vec_id"), "_ids"), "vec_id").select(F.col("query_id").alias("_id"), "score", F.explode("_ids").alias("vec_id"))
    first = ranked(ids.withColumnRenamed("_id", "query_id"), k + 1).select(F.col("query_id").alias("_id"), "vec_id", "score")
    return ranked(pairs.join(first, "_id").filter("vec_id <> query_id").select("query_id", "vec_id", "score"), k)


def matrix(column) -> np.ndarray:
    """The vectors of an Arrow column, all of one length."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut so that all vectors of one have the same length."""
    for b in batches:
        lengths = b["_dim"].to_numpy()
        for dim in np.unique(lengths).tolist():
            yield dim, b.filter(pa.array(lengths == dim))


def largest(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest in no order."""
    return np.arange(len(scores)) if len(scores) <= k else np.argpartition(scores, len(scores) - k)[len(scores) - k :]


def scanned(coded: DataFrame, queries: DataFrame, find: Callable, columns: str, of: DataFrame | None = None) -> DataFrame:
    """What find returns for every block of coded rows (_id, _dim and more) and block of queries (_id, _dim, _v).

    find(codes, queries, blocks) gets Arrow tables of one vector length and the number of blocks of rows, and returns
    arrays of the columns `columns` names. Where coded rows are not stored, `of` is the table that they are made of, row
    by row, so that they need not be made to be counted.
    """
    n, long = (coded if of is None else of).agg(F.count("*"), F.max("_dim")).first()
    per_block = min(max(LEAST_ROWS, n // 64), max(TILE, ROW_BYTES // (4 * (long or 1))))
    row_blocks, query_blocks = max(1, -(-n // per_block)), max(1, -(-queries.count() // max(TILE, QUERY_BYTES // (8 * (long or 1)))))
    deal = lambda salt, blocks: F.pmod(F.xxhash64(F.lit(salt), "_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = coded.withColumn("_r", deal("row", row_blocks)).withColumn("_q", every(query_blocks))
    right = queries.withColumn("_q", deal("query", query_blocks)).withColumn("_r", every(row_blocks))
    names = [c.split()[0] for c in columns.split(", ")]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = find(a, b, row_blocks) if a.num_rows and b.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0)] * (len(names) - 2))
        return pa.table(dict(zip(names, found, strict=True)))

    key = ["_dim", "_r", "_q"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, columns)


def exactly(pairs: DataFrame, rows: DataFrame, measure: Callable, score_type: str) -> DataFrame:
    """(query_id, vec_id, score) of pairs (query_id, vec_id), by measure(row vectors, query vectors) of exact vectors."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in by_length(batches):
            scores = pa.array(measure(matrix(b["_v"]), matrix(b["_qv"])), pa.float64() if score_type == "double" else pa.int64())
            yield pa.RecordBatch.from_arrays([b["query_id"], b["vec_id"], scores], ["query_id", "vec_id", "score"])

    theirs = pairs.join(rows.select(F.col("_id").alias("vec_id"), "_dim", "_v"), "vec_id")
    both = theirs.join(rows.select(F.col("_id").alias("query_id"), F.col("_v").alias("_qv")), "query_id")
    return both.select("query_id", "vec_id", "_dim", "_v", "_qv").mapInArrow(score, f"query_id long, vec_id long, score {score_type}")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
