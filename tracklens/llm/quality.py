"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text that its own kind's
dictionary compresses better than the other's shows where it belongs: the difference of the two compressed sizes, in
bytes saved for each byte of text, becomes a probability through a logistic calibration. The difference is the only
input of the score. All chunks of a whole text are compressed apart, like those that the dictionaries were trained on:
in one piece a long text would soon be compressed by what it said before, and the dictionaries would hardly differ.

Dictionaries and calibration are fitted on bounded hashed samples of labelled rows (`per_class`, `calibration_rows`),
disjoint from each other, of which whole texts are used; the dictionaries are trained in tasks. Every whole text is
scored, inside one Arrow-batched scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hashed_sample, sigmoid, unambiguous

CHUNK, DICTIONARY_BYTES = 1024, 112_640


@dataclass(frozen=True)
class QualityModel:
    """Plain values of bounded size: two dictionaries of at most DICTIONARY_BYTES and four numbers."""

    good: bytes
    bad: bytes
    trained: tuple[bool, bool]  # else the bytes are raw content
    mean: float
    scale: float
    intercept: float
    slope: float


def _compressor(content: bytes, trained: bool) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind), write_content_size=False, write_dict_id=False)


def compressed_differences(texts, good: tuple[bytes, bool], bad: tuple[bytes, bool]) -> np.ndarray:
    """For each text, by how many bytes for each of its own the good dictionary beats the bad one; null counts as empty."""
    first, second = _compressor(*good), _compressor(*bad)
    saved, size = np.zeros(len(texts)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace") if isinstance(text, str) else b""
        chunks = [data[at : at + CHUNK] for at in range(0, len(data), CHUNK)] or [b""]
        saved[i], size[i] = sum(len(second.compress(c)) - len(first.compress(c)) for c in chunks), len(data)
    return saved / (size + 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Ridge-penalised logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        curvature = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _dictionary(texts) -> tuple[bytes, bool]:
    """A dictionary trained on all chunks of the texts, or the chunks themselves where they are too few to train on."""
    whole = [text.encode("utf-8", "replace") for text in texts if isinstance(text, str)]
    chunks = [data[i : i + CHUNK] for data in whole for i in range(0, len(data), CHUNK)]
    if len(chunks) >= 20:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, chunks, k=64, d=8).as_bytes(), True
        except zstandard.ZstdError:
            pass
    return b"".join(chunks)[-DICTIONARY_BYTES:] or b"\0" * 8, False


def fit_quality(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, calibration_rows: int = 8000) -> QualityModel:
    """Learns from rows of labels (id, 0/1); pass only those that may be learned from.

    At most per_class rows of either class (by hash of the id) go, with their whole texts, into the dictionaries, and
    at most calibration_rows others into the calibration. Null labels, labels whose document is missing, and ids with
    both labels are ignored; with no labelled rows, or one class only, the score is the (smoothed) share of label 1.
    """
    bounded_batches(documents.sparkSession)
    known = unambiguous(labels, id_col, label_col)
    half = F.xxhash64(F.lit("half"), "_id") % 2 == 0
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def joined(sample: DataFrame) -> DataFrame:  # the sample is bounded by its row count
        return texts.join(F.broadcast(sample), "_id")

    def trained(rows: pd.DataFrame) -> pd.DataFrame:
        content, is_trained = _dictionary(rows.sort_values("_id", kind="stable")["_text"])
        return pd.DataFrame({"_y": rows["_y"].iloc[:1], "content": [content], "trained": [is_trained]})

    samples = [hashed_sample(known.filter(half & (F.col("_y") == y)), F.col("_id"), per_class) for y in (0, 1)]
    found = joined(samples[0].unionByName(samples[1])).groupBy("_y").applyInPandas(trained, "_y int, content binary, trained boolean").collect()
    by_class = {r["_y"]: (bytes(r["content"]), r["trained"]) for r in found}
    bad, good = (by_class.get(y, (b"\0" * 8, False)) for y in (0, 1))

    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(compressed_differences(texts.tolist(), good, bad))

    measure = F.pandas_udf(measured, "double")
    rows = joined(hashed_sample(known.filter(~half), F.col("_id"), calibration_rows)).select("_id", "_y", measure("_text").alias("_x")).orderBy("_id").collect()
    x, y = np.array([r["_x"] for r in rows]), np.array([r["_y"] for r in rows], float)
    if len(rows) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(good[0], bad[0], (good[1], bad[1]), 0.0, 1.0, float(np.log(share / (1 - share))), 0.0)
    mean, scale = float(x.mean()), max(float(x.std()), 1e-9)
    intercept, slope = _logistic(_inputs(x, mean, scale), y)
    return QualityModel(good[0], bad[0], (good[1], bad[1]), mean, scale, float(intercept), float(slope))


def _inputs(x: np.ndarray, mean: float, scale: float) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.arcsinh((x - mean) / scale)])  # long tails count less


def quality_scores(texts, model: QualityModel) -> np.ndarray:
    x = compressed_differences(texts, (model.good, model.trained[0]), (model.bad, model.trained[1]))
    return sigmoid(_inputs(x, model.mean, model.scale) @ np.array([model.intercept, model.slope]))


def quality_score(text: Column | str, model: QualityModel) -> Column:
    """Probability that the text is good, for every row (null and empty texts get that of an empty text)."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(quality_scores(batch.tolist(), model))

    bounded_batches()
    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(text)
