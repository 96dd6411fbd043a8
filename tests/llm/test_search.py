"""Exact and approximate search against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklens.llm.additive import angles, encode, fit, nearest_neighbours, possible
from tracklens.llm import vafile as V
from tracklens.llm.vafile import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=600, copies=60, seed=0):
    rng = np.random.default_rng(seed)
    v = (rng.standard_normal((n, 16)) * 0.3).astype(np.float32)
    v[100 : 100 + copies] = v[100]
    return v, spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    return {q: [x[k] for k in sorted(x)] for q, x in out.items()}


def brute(scores, ids, q, k=5):
    order = sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:k]
    return [(i, -s) for s, i in order]


def test_exact_top_k(spark):
    v, df = vectors(spark)
    x = np.floor(256 * v.astype(float))
    ours = result(exact_top_k(df.withColumn("_v", F.lit(1)).withColumn("score", F.lit(2))))
    assert set(ours) == set(range(0, 600, 50))
    for q in ours:
        assert ours[q] == [(i, int(s)) for i, s in brute(x @ x[q], range(600), q)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for spread in (1e-3, 100.0, 1e30):
        x, q = np.floor(rng.standard_normal((200, 8)) * spread), np.floor(rng.standard_normal((20, 8)) * spread)
        for rows in (x, np.tile(x[:1], (5, 1))):
            grid = V.Grid.between(rows.min(0), rows.max(0))
            p, s, m, e = grid.products(grid.codes(rows), q)
            assert (np.abs(m[:, None] + s[:, None] * p - q @ rows.T) <= e[:, None]).all()


def test_only_what_can_be_among_the_best_is_read(spark, monkeypatch):
    """Batches grow until the next upper bound is under the kth score; the second batch is small or empty."""
    v, df = vectors(spark, n=3000, copies=0)
    read = []
    monkeypatch.setattr(V, "exactly", lambda pairs, *rest, f=V.exactly: (read.append(pairs.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0), f(pairs, *rest))[1])
    x = np.floor(256 * v.astype(float))
    ours = result(exact_top_k(df))
    for q in ours:
        assert ours[q] == [(i, int(s)) for i, s in brute(x @ x[q], range(3000), q)]
    assert sum(read) < 300


def test_products_beyond_53_bits(spark):
    rng = np.random.default_rng(2)
    big = [(i, [float(np.float64(c)) for c in rng.integers(2**28, 2**29, 3)], 0) for i in range(60)]
    ours = result(exact_top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int"), scale=3.0))
    for q in ours:
        scores = {i: sum(int(3 * a) * int(3 * b) for a, b in zip(v, big[q][1])) for i, v, _ in big if i != q}
        assert ours[q] == sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
    huge = spark.createDataFrame([(i, [1e30, 1e30], 0) for i in range(3)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="OverflowError"):
        exact_top_k(huge).collect()


def test_neighbours(spark):
    v, df = vectors(spark)
    x = v.astype(float)
    n = np.sqrt((x * x).sum(1))
    ours, hit = result(nearest_neighbours(df)), 0
    for q in ours:
        exact = brute((x * x[q]).sum(1) / (n * n[q]), range(600), q)
        hit += len({i for i, _ in exact} & {i for i, _ in ours[q]})
        assert all(abs(s - (x[i] @ x[q]) / (n[i] * n[q])) < 1e-12 for i, s in ours[q])
    assert hit >= 0.9 * 5 * len(ours)
    assert [i for i, _ in ours[100]] == [101, 102, 103, 104, 105]  # ties to the smaller id


def test_neighbours_of_every_length(spark):
    rng = np.random.default_rng(4)
    v = [(rng.standard_normal(8 if i % 3 == 0 else 16) * 0.3).astype(np.float32) for i in range(600)]
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    ours, hit = result(nearest_neighbours(df)), 0
    assert set(ours) == set(range(0, 600, 50))
    for q in ours:
        ids = [i for i in range(600) if len(v[i]) == len(v[q])]
        x = np.array([v[i] for i in ids], float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        exact = brute(x @ x[ids.index(q)], ids, q)
        hit += len({i for i, _ in exact} & {i for i, _ in ours[q]})
    assert hit >= 0.9 * 5 * len(ours)


def test_codebooks_are_fitted_in_a_task(spark, monkeypatch):
    def checked(*args, fit=fit, **named):
        from pyspark import TaskContext

        assert TaskContext.get() is not None, "fitted on the driver"
        return fit(*args, **named)

    monkeypatch.setattr("tracklens.llm.additive.fit", checked)
    assert nearest_neighbours(vectors(spark)[1]).count() == 60


def test_recall_over_several_blocks(spark):
    """More rows than the fit sees, in five blocks, without structure: the hardest case for the codes."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((20_000, 32)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()})).repartition(4)
    ours, hit = result(nearest_neighbours(df, every=1000, sample_rows=4000)), 0
    x = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(1, keepdims=True))
    for q in ours:
        hit += len({i for i, _ in brute(x @ x[q], range(len(v)), q)} & {i for i, _ in ours[q]})
    assert len(ours) == 20 and hit >= 0.9 * 5 * 20


def test_rows_that_the_codes_tell_nothing_of(spark):
    """Codes that fit badly (many components, a small sample) and codes that cannot tell the rows of a tight group apart:
    what is found is the same as without codes."""
    rng = np.random.default_rng(12)
    wide = rng.standard_normal((5000, 256)).astype(np.float32)
    tight = np.concatenate([rng.standard_normal((600, 24)), rng.standard_normal(24) + 1e-3 * rng.standard_normal((1400, 24))]).astype(np.float32)
    for v in (wide, tight):
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}), "vec_id long, embedding array<float>").repartition(4)
        ours = result(nearest_neighbours(df, every=250, sample_rows=500, rerank=32))
        x = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(1, keepdims=True))
        assert set(ours) == set(range(0, len(v), 250))
        for q in ours:
            assert [i for i, _ in ours[q]] == [i for i, _ in brute(x @ x[q], range(len(v)), q)]


def test_no_possible_row_is_ruled_out():
    rng = np.random.default_rng(13)
    for spread in (0.0, 1e-4, 0.1, 1.0, 3.0):
        near, query = (u / np.linalg.norm(u, axis=1, keepdims=True) for u in (rng.standard_normal((300, 12)), rng.standard_normal((20, 12))))
        near[:20] = query
        near[20] = 0
        rows = near + spread * rng.standard_normal(near.shape) + (np.arange(300) == 20)[:, None]
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        exact, scores = query @ rows.T, (query @ near.T).astype(np.float32)
        for place in (-1, -6, 0):
            bars = np.sort(exact, axis=1)[:, place]
            open_ = possible(scores, angles(rows, near), bars, 28 * 2.0**-22)
            assert open_[exact >= bars[:, None]].all()
            assert spread > 0.1 or place == 0 or open_.mean() < 0.5


def test_search_keeps_clashing_columns_out(spark):
    _, df = vectors(spark, n=120, copies=0)
    for c in ("_id", "_v", "_dim", "_code", "rank", "query_id", "upper", "place"):
        df = df.withColumn(c, F.lit("x"))
    for f in (exact_top_k, nearest_neighbours):
        assert f(df).count() == 15


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    books = fit(x, books=4, words=16)
    error = {}
    for beam in (1, 6):
        code, norm = encode(x, books, beam)
        sums = sum(books[m][code[:, m]] for m in range(4))
        assert np.allclose(norm, np.sqrt((sums**2).sum(1)))
        error[beam] = ((x - sums) ** 2).sum()
    assert error[6] <= error[1] < (x**2).sum()


def test_search_edge_cases(spark):
    rows = [(0, [0.1, 0.2]), (0, [0.1, 0.2]), (1, [0.2, 0.1]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [0.0, 0.0]), (None, [0.3, 0.3]), (50, [0.1, 0.2])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    exact = result(exact_top_k(df))
    assert [i for i, _ in exact[0]] == [50, 1, 7] and [i for i, _ in exact[50]] == [0, 1, 7]
    near = result(nearest_neighbours(df))
    assert [i for i, _ in near[0]] == [50, 1] and [i for i, _ in near[50]] == [0, 1]
    for f in (exact_top_k, nearest_neighbours):
        assert f(df.limit(0)).count() == 0
        assert result(f(df.filter("vec_id = 50"))) == {}


def test_copies_of_a_vector_beyond_the_shortlist(spark):
    """1,000 equal vectors: the smallest ids come first, from both searches, for queries among the copies and not."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal((2000, 16)).astype(np.float32)
    v[1000:2000] = v[1000]
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    near, top = result(nearest_neighbours(df)), result(exact_top_k(df))
    assert [i for i, _ in near[1500]] == [1000, 1001, 1002, 1003, 1004]
    assert [i for i, _ in near[1000]] == [1001, 1002, 1003, 1004, 1005]
    x = np.floor(256 * v.astype(float))
    for q in top:
        assert top[q] == [(i, int(s)) for i, s in brute(x @ x[q], range(2000), q)]
    hits = total = 0
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for q in near:
        want = {i for i, _ in brute(np.round(unit @ unit[q], 12), range(2000), q)}
        hits, total = hits + len(want & {i for i, _ in near[q]}), total + 5
    assert hits >= 0.9 * total


def test_equal_rows_are_read_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(V, "exactly", lambda pairs, *rest, f=V.exactly: (read.append(pairs.count()), f(pairs, *rest))[1])
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0) for i in range(3000)], SCHEMA)
    ours = result(exact_top_k(df))
    assert len(ours) == 60 and ours[0] == [(i, 256 * 256 * 14) for i in range(1, 6)] and ours[50][0] == (0, 256 * 256 * 14)
    assert sum(read) == 1


def test_huge_and_tiny_components_have_cosines(spark):
    kind = "vec_id long, embedding array<double>, label int"
    rows = [(0, [1e200, 1e200, 0.0], 0), (1, [1e-200, 1e-200, 0.0], 0), (2, [1.0, 0.0, 0.0], 0), (3, [5e-324, 0.0, 0.0], 0), (4, [-1e308, 1e308, 1e308], 0), (50, [0.0, 0.0, 1e-300], 0)]
    ours = result(nearest_neighbours(spark.createDataFrame(rows, kind)))
    assert all(np.isfinite(s) for found in ours.values() for _, s in found)
    assert ours[0][0][0] == 1 and ours[0][0][1] == pytest.approx(1.0) and [i for i, _ in ours[0]][1:3] == [2, 3]
    assert ours[50][0][0] == 4 and ours[50][0][1] == pytest.approx(1 / np.sqrt(3))


def test_scaling_by_powers_of_two_changes_no_digit():
    from tracklens.llm.additive import cosines

    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((200, 64)), rng.standard_normal((200, 64))
    assert (cosines(x, q) == (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))).all()
