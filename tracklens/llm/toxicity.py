"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between them of a text, hashed to 2^bits
coordinates. A bounded labelled sample is learned with per-coordinate learning rates and L1 sparsity (in `shards`
tasks whose weights are averaged; one by default, for several learn less from fewer rows each). The model has at
most 2^bits weights, nearly all of them zero, whatever the size of the corpus; scoring is one Arrow-batched scan
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, bounded_batches, hashed_sample, mix, sigmoid, unambiguous, word_lists


SLICE = 1000  # texts whose words are in memory at once


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    index: np.ndarray  # sorted coordinates with a weight
    weight: np.ndarray
    bias: float


def hashed_features(texts, bits: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates of each text, text after text, and where each text's begin (one more entry than texts).

    among: keeps the coordinates at which it is not zero.
    """
    words, counts = word_lists(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    parts, owners = [mix(words)], [owner]
    for gap, salt in ((1, 1), (2, 2)):
        same = owner[gap:] == owner[:-gap] if len(owner) > gap else np.zeros(0, bool)
        left, right = words[: len(same)][same], words[gap : gap + len(same)][same]
        parts.append(mix(left * GOLDEN + right + np.uint64(salt)))
        owners.append(owner[: len(same)][same])
    slots = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    pairs = (np.concatenate(owners) << bits) | slots
    if among is not None:
        pairs = pairs[among[slots] != 0]
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    return pairs & ((1 << bits) - 1), np.searchsorted(pairs, np.arange(len(counts) + 1, dtype=np.int64) << bits)


def ftrl(features: np.ndarray, starts: np.ndarray, labels: np.ndarray, bits: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dense weights and bias after `epochs` passes in the given order."""
    z, n, w = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0
    for _ in range(epochs):
        for k, y in enumerate(labels):
            at = features[starts[k] : starts[k + 1]]
            g = sigmoid(w[at].sum() + bias) - y
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w[at]
            n[at] += g * g
            shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
            w[at] = -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias  # the bias has no penalty
            nb += g * g
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    return w, bias


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 16_000, shards: int = 1, bits: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.134, l2: float = 0.01, epochs: int = 4) -> ToxicityModel:
    """Learns from rows of labels (id, 0/1); pass only those that may be learned from.

    At most sample_rows of them, by hash of the id, are used. Null labels, labels whose document is missing, and ids
    with both labels are ignored; without any rows all scores are 0.5. The L1 penalty is l1 times the root of the rows:
    a coordinate's sum of gradients that is mere chance grows with the root of the rows it was summed over.
    """
    bounded_batches(documents.sparkSession)
    known = unambiguous(labels, id_col, label_col)
    sample = hashed_sample(known, F.col("_id"), sample_rows)
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[i : i + SLICE] for whole in batches for i in range(0, len(whole), SLICE)):
            found, starts = hashed_features(b["_text"].tolist(), bits)
            yield pd.DataFrame({"_shard": b["_shard"].to_numpy(), "_order": b["_order"].to_numpy(), "_y": b["_y"].to_numpy(), "_f": [found[s:e].astype(np.int32) for s, e in zip(starts[:-1], starts[1:], strict=True)]})

    def learned(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_order", kind="stable")
        starts = np.concatenate([[0], np.cumsum(group["_f"].map(len))])
        labels_of, rows = group["_y"].to_numpy(float), len(group)
        features = np.concatenate([*group.pop("_f"), np.zeros(0, np.int32)])
        w, bias = ftrl(features, starts, labels_of, bits, alpha=alpha, beta=beta, l1=l1 * rows**0.5, l2=l2, epochs=epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"n": [rows], "at": [at.astype(np.int32)], "w": [w[at]], "bias": [bias]})

    order = F.xxhash64(F.lit("order"), "_id")
    rows = (
        texts.join(F.broadcast(sample), "_id")  # the sample is bounded by its row count
        .select("_text", "_y", order.alias("_order"), F.pmod(order, F.lit(shards)).cast("int").alias("_shard"))
        .mapInPandas(featured, "_shard int, _order long, _y int, _f array<int>")
        .groupBy("_shard").applyInPandas(learned, "n long, at array<int>, w array<double>, bias double")
        .collect()
    )  # at most `shards` rows of sparse weights
    total = sum(r["n"] for r in rows)
    weights, bias = np.zeros(1 << bits), 0.0
    for r in sorted(rows, key=lambda r: (r["n"], r["bias"])):
        weights[np.asarray(r["at"], np.int64)] += np.asarray(r["w"]) * (r["n"] / total)
        bias += r["bias"] * (r["n"] / total)
    at = np.flatnonzero(weights)
    return ToxicityModel(bits, at, weights[at], bias)


def toxicity_scores(texts, model: ToxicityModel, table: np.ndarray | None = None) -> np.ndarray:
    if table is None:
        table = dense(model)
    found, starts = hashed_features(texts, model.bits, table)
    sums = np.concatenate([[0.0], np.cumsum(table[found])])
    return sigmoid(sums[starts[1:]] - sums[starts[:-1]] + model.bias)


def dense(model: ToxicityModel) -> np.ndarray:
    table = np.zeros(1 << model.bits, np.float64)
    table[model.index] = model.weight
    return table


def toxicity_score(text: Column | str, model: ToxicityModel) -> Column:
    """Probability that the text is toxic, for every row (null and empty texts have no features: the bias alone)."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = dense(model)
        for batch in batches:
            texts = batch.tolist()
            parts = [toxicity_scores(texts[i : i + SLICE], model, table) for i in range(0, len(texts), SLICE)]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    bounded_batches()
    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(text)
