"""Nearest neighbours by additive quantisation, made certain.

A unit vector is the sum of one word from each of several full-dimensional codebooks. The codebooks are fitted on a
bounded hashed sample of the vectors of one length, in one task: residual k-means, then rounds of beam-search encoding
and joint least squares. Every row is encoded by beam search over the residual codebooks and keeps the angle between
itself and the sum of its words. A row's approximate cosine is that of this sum. In each block the rows of the best
approximations of each query are compared exactly, which sets a bar. By the triangle inequality of angles a row whose
sum is further from the query than the bar's angle and the row's own angle together is below the bar; all others are
compared exactly too. So how well the codes fit decides how much is compared, and never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import TILE, asked, by_length, distinct, expanded, largest, matrix, ranked, scanned, usable
from .common import written

#: Rows taken at once by the encoder and by the exact comparison, and cells of a block's rows times queries.
BEAM, PART, CELLS = 4, 2048, 1 << 22
TINY = 1e-9


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes and norms of the reconstructions. Beams are kept for each row by the error that is left."""
    n, (m, k, d) = len(x), books.shape
    residual = x[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for j in range(m):
        width = residual.shape[1]
        gain = (residual.reshape(-1, d) @ books[j].T * -2 + (books[j] ** 2).sum(1)).reshape(n, width, k)
        error = (gain + (residual**2).sum(2)[:, :, None]).reshape(n, width * k)
        keep = min(beam, width * k) if j < m - 1 else 1
        at = np.argpartition(error, keep - 1, axis=1)[:, :keep] if keep < width * k else np.tile(np.arange(width * k), (n, 1))
        parent, word = at // k, at % k
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1) if j else np.zeros((n, keep, 0), np.uint8), word[:, :, None].astype(np.uint8)], axis=2)
        residual = np.take_along_axis(residual, parent[:, :, None], 1) - books[j][word]
    code = codes[:, 0]
    return code, np.sqrt((_sums(code, books) ** 2).sum(1))


def _sums(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][code[:, j]] for j in range(len(books)))


def reconstructed(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The sums of the words of each row, as unit vectors; a sum of (nearly) nothing stays nothing."""
    sums = _sums(code, books)
    norm = np.sqrt((sums**2).sum(1, keepdims=True))
    return np.where(norm > TINY, sums / np.maximum(norm, TINY), 0.0)


def angles(unit: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Between unit vectors and their reconstructions, row by row; half a turn where there is no reconstruction."""
    apart = 2 * np.arcsin(np.minimum(1.0, np.sqrt(((unit - near) ** 2).sum(1)) / 2))
    return np.where(near.any(1), apart, np.pi)


def fit(x: np.ndarray, books: int = 8, words: int = 256, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimension) for the rows of x, unit vectors."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    residual, found = x.copy(), []
    for _ in range(books):
        c = _kmeans(residual, words, rng)
        residual -= c[np.argmax(residual @ c.T - 0.5 * (c**2).sum(1), axis=1)]
        found.append(c)
    out = np.stack(found)
    for _ in range(rounds):
        codes = np.concatenate([encode(x[i : i + PART], out)[0] for i in range(0, len(x), PART)])
        flat = codes.astype(np.int64) + np.arange(books) * words
        gram, right = np.zeros((books * words,) * 2), np.zeros((books * words, x.shape[1]))
        for a in range(books):
            np.add.at(right, flat[:, a], x)
            for b in range(books):
                np.add.at(gram, (flat[:, a], flat[:, b]), 1.0)
        gram[np.diag_indices_from(gram)] += 0.5  # words that nothing uses stay where they were
        out = np.linalg.solve(gram, right + 0.5 * out.reshape(-1, x.shape[1])).reshape(out.shape)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # tiny and huge components stay in range
    return v / np.sqrt((v**2).sum(1, keepdims=True))


def _codebooks(rows: DataFrame, sample_rows: int, books: int, words: int) -> dict[int, np.ndarray]:
    """Codebooks by vector length, fitted in a task for each length on the sample_rows vectors of the smallest hashes.

    As in hashed_sample, rows far beyond the bar are filtered out where they are read.
    """
    bar = F.when(F.col("_n") > 4 * sample_rows, F.lit(-(2.0**63)) + F.lit(2.0**64 * (2 * sample_rows + 100)) / F.col("_n"))
    counts = rows.groupBy("_dim").agg(F.count("*").alias("_n")).select("_dim", bar.alias("_bar"))
    hashed = rows.join(F.broadcast(counts), "_dim").withColumn("_hash", F.xxhash64("_id")).filter(F.col("_bar").isNull() | (F.col("_hash") < F.col("_bar")))
    place = F.row_number().over(Window.partitionBy("_dim").orderBy("_hash", "_id"))
    sample = hashed.withColumn("_place", place).filter(F.col("_place") <= sample_rows).select("_dim", "_id", "_v")

    def learn(t: pa.Table) -> pa.Table:
        v = matrix(t["_v"])
        found = fit(_unit(v[np.argsort(t["_id"].to_numpy())]), books, words)
        return pa.table({"_dim": pa.array([v.shape[1]], pa.int32()), "_books": pa.array([found.tobytes()], pa.binary())})

    found = sample.groupBy("_dim").applyInArrow(learn, "_dim int, _books binary").collect()  # one for each length
    return {r["_dim"]: np.frombuffer(r["_books"]).reshape(books, -1, r["_dim"]) for r in found}


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, in double precision. Rows are scaled by a power of two first, which changes no digit but keeps
    squares of huge and tiny components in range."""
    x, q = (np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0, keepdims=True))[1]) for v in (x.astype(np.float64), q.astype(np.float64)))
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))


def possible(scores: np.ndarray, away: np.ndarray, bars: np.ndarray, slack: float) -> np.ndarray:
    """Whether a row can have a cosine of a query's bar or more, from scores (a row a query), the cosines of the rows'
    reconstructions, and the rows' angles to these: not if the cosine is below that of bar's and row's angles together."""
    wide = np.arccos(np.clip(bars - 1e-9, -1.0, 1.0))
    cos, sin = np.cos(away).astype(np.float32), np.sin(away).astype(np.float32)
    limit = np.cos(wide).astype(np.float32)[:, None] * cos - np.sin(wide).astype(np.float32)[:, None] * sin
    return (scores >= limit - np.float32(slack)) | (wide[:, None] >= np.pi - 1e-3 - away)


def nearest_neighbours(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000, books: int = 16, words: int = 256, rerank: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other rows of the largest
    cosine, ties to the smaller id; all, if there are fewer. score is the exact cosine of the original vectors.

    The codebooks of each vector length (books * words vectors, which go through the driver) are fitted on at most
    sample_rows of its vectors; every row is encoded, in `books` bytes and an angle. The exact cosines of the `rerank`
    best by the codes (of all blocks together, roughly) set each block's bar, and every row that the codes do not rule
    out is compared exactly, in its block: nothing is missed, whatever the vectors are like. Vectors are compared with
    those of their length. Vectors that are null, empty or zero, or hold null or non-finite components, and null ids
    take no part. Rows that repeat an id count once. Equal vectors are searched once, whether they are rows or queries:
    of their rows the smallest ids come first, however many there are. Huge and tiny components are scaled.
    """
    every_row = usable(vectors, id_col, vector_col, nonzero=True)
    rows = distinct(every_row, k + 1)
    pairs, queries = asked(every_row, rows, every)
    codebooks = _codebooks(rows, sample_rows, books, words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in by_length(batches):
            unit = _unit(matrix(b["_v"]))
            parts = [unit[i : i + PART] for i in range(0, len(unit), PART)]
            codes = [encode(x, codebooks[dim])[0] for x in parts]
            away = np.concatenate([angles(x, reconstructed(c, codebooks[dim])) for x, c in zip(parts, codes, strict=True)])
            yield pa.RecordBatch.from_arrays([b["_id"], b["_dim"], b["_v"], pa.array([x.tobytes() for c in codes for x in c], pa.binary()), pa.array(away)], ["_id", "_dim", "_v", "_code", "_away"])

    def find(a: pa.Table, b: pa.Table, blocks: int):
        ids, x, away = a["_id"].to_numpy(), matrix(a["_v"]), a["_away"].to_numpy()
        code = np.frombuffer(b"".join(a["_code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        qids, q, out = b["_id"].to_numpy(), matrix(b["_v"]), []
        n, dim = x.shape
        near = np.concatenate([reconstructed(code[i : i + PART], codebooks[dim]).astype(np.float32) for i in range(0, n, PART)])
        # Rows are dealt to blocks by hash, so a block has its share of a query's shortlist, and hardly ever twice that.
        kept = max(k + 1, rerank if blocks == 1 else min(rerank, 2 * -(-rerank // blocks) + 16))
        slack, tie = (dim + 16) * 2.0**-22, 1e-12 + dim * 1e-15  # for the rounding of cosines in 32 and 64 bits
        step = max(1, min(TILE, CELLS // n))
        for t in range(0, len(qids), step):
            unit = _unit(q[t : t + step])
            scores = unit.astype(np.float32) @ near.T
            bars = np.full(len(unit), -1.0)
            if n > k + 1:
                for j, row in enumerate(scores):
                    bars[j] = np.sort(_unit(x[largest(row, kept)]) @ unit[j])[-(k + 1)]
            some = np.flatnonzero(possible(scores, away, bars, slack).any(0))
            cosine = np.concatenate([unit @ _unit(x[some[i : i + PART]]).T for i in range(0, len(some), PART)], axis=1)
            for j, row in enumerate(cosine):
                last = row[largest(row, k + 1)].min() - tie
                at = some[row >= last]
                exact = cosines(x[at], q[t + j : t + j + 1])
                first = np.lexsort((ids[at], -exact))[: k + 1]
                out.append((np.full(len(first), qids[t + j]), ids[at][first], exact[first]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    coded = rows.mapInArrow(index, f"_id long, _dim int, _v {rows.schema['_v'].dataType.simpleString()}, _code binary, _away double")
    found = scanned(coded, queries, find, "query_id long, vec_id long, score double", of=rows)
    return expanded(written(ranked(found, k + 1), "nearest"), pairs, rows, k)
