"""What several corpus operators share: the shared folder, bounded samples and word hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.plans.session import checkpointed, shared_folder  # noqa: F401  for the operators

WORD = regex.compile(r"\w+")
#: An odd 64-bit multiplier (the golden ratio), for rolling and mixing hashes.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BATCH = 1000
_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Like checkpointed(), as compressed Parquet: for wide rows that are read more than once."""
    path = f"{shared_folder(df.sparkSession)}/tracklens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_tables(spark: SparkSession) -> list[str]:
    """The tables that written() has left in the shared folder so far."""
    return [path for session, path in _written if session is spark]


def delete_written(spark: SparkSession, paths: list[str]) -> None:
    """Deletes such tables; for those that no result still to be read depends on."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove((spark, path))


def delete_table(spark: SparkSession, table: str, path: str) -> None:
    """Drops a table of the session's catalogue together with its files."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that df has no columns of (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Python workers get at most BATCH rows at once, for texts can be long; a smaller setting stays."""
    spark, key = spark or SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_column, folds: int):
    """crc32 of the id's text modulo folds."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds


def unambiguous(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y) of the ids with one label, 0 or 1; ids with both are left out."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    return rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_max")).filter("_y = _max").drop("_max")


def hashed_sample(df: DataFrame, order, rows: int) -> DataFrame:
    """The rows with the smallest hashes: a reproducible sample of at most `rows`.

    Where there are many more, those with hashes beyond twice the expected bar are filtered out where they are read, so
    that the final top-k sees about 2 * rows, however many partitions there are.
    """
    hashed, n = F.xxhash64(order), df.count()
    if n > 4 * rows:
        df = df.filter(hashed < int(-(2**63) + 2**64 * (2 * rows + 100) / n))
    return df.orderBy(hashed, order).limit(rows)


def word_lists(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (lower case) of a batch of texts, one after another, and each text's word count."""
    found = [WORD.findall(t.lower()) if isinstance(t, str) else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    flat = [w for words in found for w in words]
    return hash_strings(flat), counts


def hash_strings(strings) -> np.ndarray:
    """The same 64-bit hashes in every process; repeated strings are hashed once."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(strings, dtype=object), categorize=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (splitmix64's finaliser)."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))
