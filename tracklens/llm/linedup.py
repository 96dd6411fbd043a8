"""Line de-duplication by overlapping three-line windows.

Every `window` consecutive lines of a document form a window. A window that occurs anywhere in the corpus before (in
the order of document id, then text, then line) is a later occurrence, and all lines that later occurrences cover,
taken together, are removed. Each removed line has an equal one earlier in that order, so no content is lost entirely.

A document is a row: rows that share an id but differ in text are two documents, told apart by a hash of the text.
Rows equal in both are copies of one document and keep the same lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, free_names


def text_key(text: Column) -> Column:
    """60 bits of a text's MD5, which SQL engines compute alike."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _windows(documents: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(_id, _key, p, a, b): a window's document, first line and 128-bit hash; windows of blank lines are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, digests = [], [], []
            for row, text in enumerate(batch["_text"].to_pylist()):
                lines = [line.strip(" ") for line in text.split("\n")]
                for p in range(len(lines) - window + 1):
                    if any(lines[p : p + window]):
                        rows.append(row)
                        places.append(p)
                        digests.append(xxhash.xxh3_128_digest("\n".join(lines[p : p + window])))
            halves, at = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["_id"].take(at), batch["_key"].take(at), pa.array(places, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["_id", "_key", "p", "a", "b"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.filter(F.col(id_col).isNotNull() & F.col(text_col).contains("\n"))
    return rows.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text")).mapInArrow(cut, f"_id {kind}, _key long, p int, a long, b long")


def repeated_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """(id, text_key, covered array<int>): the lines, from 0, to remove from each document that has any.

    Lines are compared without surrounding blanks. Null ids and texts, and texts of fewer lines than a window, have
    nothing to remove.
    """
    bounded_batches(documents.sparkSession)
    rows = _windows(documents, id_col, text_col, window)
    # Partial aggregation leaves a row for each window and task, so a window that a third of all documents share is
    # counted where it is read. The firsts are checkpointed so that both sides of the join are plain exchanges, whose
    # hot keys adaptive execution splits.
    place = F.struct("_id", "_key", "p")
    firsts = rows.groupBy("a", "b").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).filter("_n > 1").drop("_n")
    later = rows.join(checkpointed(firsts), ["a", "b"]).filter(place > F.col("_first"))
    starts = later.groupBy("_id", "_key").agg(F.collect_set("p").alias("_p"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("_p", lambda p: F.sequence(p, p + (window - 1))))))
    return starts.select(F.col("_id").alias(id_col), F.col("_key").alias("text_key"), covered.alias("covered"))


def drop_repeated_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3, counts: tuple[str, str] | None = None) -> DataFrame:
    """All rows and columns of documents, the text without later occurrences; counts names two columns to add, of the
    lines that were there and of those removed.

    A text that is a copy as a whole becomes empty; null stays null (0 lines). Columns may have any names.
    """
    covered_id, covered_key, gone = free_names(documents, "covered_id", "covered_key", "covered")
    covered = repeated_lines(documents, id_col=id_col, text_col=text_col, window=window).toDF(covered_id, covered_key, gone)
    joined = documents.join(covered, (F.col(id_col) == F.col(covered_id)) & (text_key(F.col(text_col)) == F.col(covered_key)), "left")

    def keep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = texts.to_pylist()
            for i, removed in enumerate(lists.to_pylist()):
                if removed is not None and out[i] is not None:
                    without = set(removed)
                    out[i] = "\n".join(line for k, line in enumerate(out[i].split("\n")) if k not in without)
            yield pa.array(out, pa.string())

    text = F.arrow_udf(keep, "string")(F.col(text_col), F.col(gone))
    columns = [(text if c == text_col else F.col(f"`{c}`")).alias(c) for c in documents.columns]
    if counts:
        lines = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
        columns += [F.coalesce(lines, F.lit(0)).alias(counts[0]), F.coalesce(F.size(gone), F.lit(0)).alias(counts[1])]
    return joined.select(*columns)
