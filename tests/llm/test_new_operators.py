"""Phrases, personal data and centroid clusters against plain versions."""

import hashlib
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklens.llm import phrases as W
from tracklens.llm import pii as P
from tracklens.llm import queries as Q
from tracklens.llm import vakmeans as V

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- phrases -------------------------------------------------------------------------------------------------------


def plain_collocations(rows, least=10, top=2000):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    out = {}
    for (lang, words), a in counts.items():
        if len(words) > 1 and a >= least:
            cuts = [(1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
            longer = [f for (other, w), f in counts.items() if other == lang and len(w) > len(words) and f >= least and any(w[i : i + len(words)] == words for i in range(len(w)))]
            if not any(100 * f >= 50 * a for f in longer):
                score, _, l, r = min(cuts)
                out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


def phrase_rows():
    rng = np.random.default_rng(4)
    vocabulary = ["the", "Quick", "brown", "fox", "über", "naïve", "x y", "it's", "a", "B"]
    rows = []
    for i in range(300):
        words = [vocabulary[min(int(rng.exponential(2.5)), 9)] for _ in range(rng.integers(0, 40))]
        gaps = [str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "!?", " \x0b"], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])) for _ in words]
        rows.append((["en", "de", None, "und"][i % 4], "".join(w + g for w, g in zip(words, gaps))))
    return [*rows, *rows[:40], ("en", ""), ("en", None), (None, "   \t"), ("fr", "one time only"), ("en", "the quick brown fox " * 3000)]


@pytest.mark.parametrize(("bits", "most"), [(64, 2**23 - 1), (3, 2**23 - 1), (64, 5)])
def test_collocations_equal_plain_counts(spark, monkeypatch, bits, most):
    """Also where segments are far shorter than texts, (with three bits) where nearly all fingerprints collide, and where
    a count takes several rows."""
    monkeypatch.setattr(W, "SEGMENT", 700)
    monkeypatch.setattr(W, "MOST", most)
    rows = phrase_rows()
    df = spark.createDataFrame([(None if i % 7 == 0 else i // 2, t, g, 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, f int").repartition(3)
    got = {tuple(r) for r in W.collocations(df, bits=bits).collect()}
    want = plain_collocations(rows)
    assert got == want and len(want) > 50
    assert {tuple(r) for r in W.collocations(df, bits=bits, top=3).collect()} == {r for r in want if r[1] <= 3}


def test_counts_of_whole_texts_do_not_depend_on_segments():
    rng = np.random.default_rng(0)
    raw = b" ".join(bytes(rng.choice(list(b"abcXYZ."), rng.integers(1, 9))) for _ in range(400))
    whole, _, _, _ = [*W._segments(raw, 3)][0], 0, 0, 0
    assert whole[1] == -1
    before = W.SEGMENT
    try:
        W.SEGMENT = 100
        parts = list(W._segments(raw, 3))
    finally:
        W.SEGMENT = before
    words = [w for w in W.words_of(raw.decode())[0]]
    assert sum(own for _, own, _ in parts) == len(words) and len(parts) > 10
    for first, own, piece in parts:
        assert W.words_of(piece.decode())[0][: own + 2] == words[first : first + own + 2][: len(W.words_of(piece.decode())[0])]


def test_bitmap(spark):
    fps = [0, 1, 63, 64, 2**27 - 1, -1, -(2**63), 2**63 - 1, 12345678901]
    bitmap = W._bitmap(spark.createDataFrame([(x,) for x in fps], "_fp long"))
    asked = np.array([*fps, 2, 65, 777], np.int64).view(np.uint64)
    assert W._marked(asked, bitmap).tolist() == [True] * len(fps) + [False] * 3


def test_phrases_of_empty_tables(spark, no_documents):
    assert W.collocations(no_documents).collect() == []
    assert W.collocations(spark.createDataFrame([(1, None, None, "a", 0)], no_documents.schema)).collect() == []


def test_scores_beyond_64_bits(spark):
    """a * a * 1000000 needs more than 64 bits from a = 3,037,000 on; the arithmetic is decimal."""
    a, l, r = 4_000_000_000, 4_000_000_001, 4_000_000_003
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(W.score_of("a", "l", "r").alias("s")).first()
    assert row["s"] == 1000000 * a * a // (l * r)


# --- personal data -------------------------------------------------------------------------------------------------


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1:
                fine = all(int(p) <= 255 for p in m[0].split("."))
            elif k == 2:
                doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
                fine = 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
            else:
                fine = k == 0 or 9 <= len(digits) <= 15
            if fine:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1.@+-() 29:é\n", max_size=60))
def test_base_spans_are_the_patterns_matches(text):
    assert P.base_spans(text) == plain_spans(text)


def test_base_spans_of_every_text(spark, sf_dir):
    texts = [r["text"] for r in Q.read_table(spark, sf_dir.replace("0.001", "0.01"), "documents").select("text").collect()]
    assert sum(len(plain_spans(t or "")) for t in texts) > 20
    assert all(P.base_spans(t) == plain_spans(t or "") for t in texts)


def test_base_spans_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000 + ".", "1." * 100_000, "+1 " * 100_000, "a@" * 100_000, "+1" + " (" * 100_000):
        P.base_spans(text)
        g = P.Graph()
        g.add(0, text, [])


def trained(seed=0):
    rng = np.random.default_rng(seed)
    words = "lorem ipsum dolor sit amet sed do".split()
    texts = []
    for i in range(160):
        d = "".join(map(str, rng.integers(0, 10, 10)))
        mark = [f"+1 ({d[:3]}) 555-{d[6:]}", f"{words[i % 7]}.{d[:2]}@mail{d[0]}.example.com", ".".join(str(int(x)) for x in rng.integers(1, 255, 4)), f"version {d[0]}.{d[1]} of {d[:5]}"][i % 4]
        filler = " ".join(words[j] for j in rng.integers(0, 7, 30))
        texts.append(f"{filler} {mark} {filler}")
    return P.learn(texts)


def test_messages_are_exact_without_loops_and_close_with_them():
    rng = np.random.default_rng(1)
    model = P.Field(rng.normal(0, 1, (P.FEATURES, P.LABELS)), rng.normal(0, 0.6, (3, P.LABELS, P.LABELS)))
    model.pairs[1:] = (model.pairs[1:] + model.pairs[1:].transpose(0, 2, 1)) / 2
    features = rng.integers(0, P.FEATURES, (5, P.WIDTH))
    scores = model.nodes[features].sum(1)
    for links, tolerance in (([(0, 1, 0), (1, 2, 1), (1, 3, 2), (3, 4, 0)], 1e-3), ([(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1), (3, 4, 0)], 0.12)):
        exact = np.zeros((5, P.LABELS))
        for labels in product(range(P.LABELS), repeat=5):
            if labels[0] == 2:
                p = np.exp(sum(scores[i, y] for i, y in enumerate(labels) if i) + sum(model.pairs[k, labels[a], labels[b]] for a, b, k in links))
                exact[range(5), labels] += p
        exact /= exact.sum(1, keepdims=True)
        got = model.marginals(features, np.array(links), np.array([2, -1, -1, -1, -1]))
        assert np.abs(got - exact).max() < tolerance


def test_the_field_adds_other_mentions_and_leaves_the_rest():
    model = trained()
    text = "lorem +1 (743) 555-3824 ipsum sed. Dolor (743) 555-3824 amet"
    (base, added), = P.found_spans([text], model)
    assert [text[a:b] for _, a, b in base] == ["+1 (743) 555-3824"] and [text[a:b] for k, a, b in added if k == 3] == ["(743) 555-3824"]
    clean = ["version 2.0 of 2024-01-02", "lorem ipsum", "", None, "12345 sit 99", 'token = "24be64439e3e49cf46b2d7c90f3602a3"']
    assert all(not base and not added for base, added in P.found_spans(clean, model))


def test_skip_links_carry_labels():
    """The same unsure token is found where it repeats an observed one, and is not without the links."""
    features, links = np.zeros((2, P.WIDTH), int), np.array([(0, 1, P.REPEATED)])
    model = P.Field(np.zeros((P.FEATURES, P.LABELS)), np.zeros((3, P.LABELS, P.LABELS)))
    model.pairs[P.REPEATED] = 4 * np.eye(P.LABELS)
    seen = np.array([3, -1])
    assert model.marginals(features, links, seen)[1, 3] > 0.9
    assert abs(model.marginals(features, links[:0], seen)[1, 3] - 1 / P.LABELS) < 1e-9


def test_links_grow_with_tokens_not_with_pairs():
    g = P.Graph()
    g.add(0, " and ".join(["555-3824"] * 2000), [])
    assert len(g.features) == 2000 and len(g.links) == 2 * 1999  # repeated and similar


def test_personal_data_of_edge_rows(spark, edge_documents, no_documents):
    model = trained()
    extra = spark.createDataFrame([(20, "x +1 (743) 555-3824 y " * 2000, "en", "a", 1), (21, "a@b.co", None, None, None)], edge_documents.schema)
    rows = edge_documents.unionByName(extra).withColumn("kind", F.lit("k")).withColumn("start", F.lit(0))
    got = P.with_personal_data(rows, model).collect()
    assert len(got) == rows.count() and {r["kind"] for r in got} == {"k"}
    for r in got:
        assert [(P.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["spans"] if not s["added"]] == plain_spans(r["text"] or "")
    assert P.with_personal_data(no_documents, model).collect() == []
    assert P.fit_field(no_documents).nodes.shape == (P.FEATURES, P.LABELS)


def test_query_of_personal_data(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in Q.read_table(spark, sf_dir, "documents").collect()}
    rows = Q.op12_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(P.span_text(spans).encode()).hexdigest()
        assert set(P.span_text(spans).split(",")) <= set(r["spans"].split(","))


# --- centroid clusters ---------------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10, dim=64):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    each = Counter()
    for _, n, d in out:
        each[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, n, d, each[n], sum(each.values()), digest[n]) for i, n, d in out)


def clusters(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, _row int")
    return sorted(tuple(r) for r in V.centroid_clusters(df, **options).collect())


@pytest.mark.parametrize("spread", [0.2, 300.0, 2.0**30])
def test_clusters_equal_plain_ones(spark, spread):
    """Vectors in groups, repeated rows, ties, equal ids, and rows that take no part; the largest spread needs whole
    numbers beyond 64 bits on the way."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, spread, (5, 64))
    rows = [(i, (middles[i % 5] + rng.normal(0, spread / 3, 64)).tolist()) for i in range(200)]
    rows += rows[:20] + [(300 + i, rows[0][1]) for i in range(40)] + [(7, rows[9][1]), (7, rows[3][1])]
    odd = [(None, rows[1][1]), (900, None), (901, rows[1][1][:63]), (902, [float("nan")] * 64), (903, [float("inf")] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [])]
    if spread < 2.0**20:
        assert clusters(spark, rows + odd) == plain_clusters(rows + odd)
    else:
        with pytest.raises(Exception, match="OverflowError"):
            clusters(spark, rows)


def test_large_components_near_each_other(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (2.0**38 + rng.integers(0, 1000, 64)).astype(float).tolist()) for i in range(40)]
    assert clusters(spark, rows, rounds=3) == plain_clusters(rows, rounds=3)


def test_few_and_equal_vectors(spark):
    assert clusters(spark, []) == []
    assert clusters(spark, [(1, [0.5] * 63)]) == []
    for rows in ([(5, [0.25] * 64)], [(i, [1.0] * 64) for i in range(30)], [(i, [float(i % 2)] * 64) for i in range(12)]):
        assert clusters(spark, rows) == plain_clusters(rows)


def test_only_unsure_vectors_are_fetched(spark):
    """Of well separated groups nearly no full vector is read once centroids stand still."""
    rng = np.random.default_rng(7)
    middles = rng.normal(0, 1, (4, 64))
    x = np.floor(1024 * (middles[np.arange(400) % 4] + rng.normal(0, 0.02, (400, 64)))).astype(np.int64)
    cells = V.Cells(x.min(0).tolist(), x.max(0).tolist(), 6)
    codes = cells.codes(x)
    assert len(codes[0]) == 48
    assert (cells.unpacked(codes, 64) == (x - cells.low.astype(int)) // cells.width.astype(int)).all()
    centroids = np.floor(1024 * middles).astype(int).tolist()
    file = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(codes)], "_row long, _code binary")
    assert V.uncertain_rows(file, cells, centroids, centroids, 64).count() == 0
    shuffled = [centroids[1], centroids[0], *centroids[2:]]
    assert {r["_row"] for r in V.uncertain_rows(file, cells, centroids, shuffled, 64).collect()} == {i for i in range(400) if i % 4 < 2}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_the_nearest_is_always_possible(seed):
    rng = np.random.default_rng(seed)
    size = float(rng.choice([3, 1000, 2**40]))
    x = np.floor(rng.normal(0, size, (60, 8))).astype(np.int64)
    centroids = [[int(v) for v in c] for c in x[rng.integers(0, 60, 5)] + rng.integers(-2, 3, (5, 8))]
    cells = V.Cells(x.min(0).tolist(), x.max(0).tolist(), int(rng.integers(2, 8)))
    possible = V.Bounds(cells, centroids).possible(cells.unpacked(cells.codes(x), 8))
    best, distance = V.nearest(x, centroids)
    assert possible[np.arange(60), best].all()
    assert (V.nearest(x, centroids, possible)[0] == best).all() and list(V.nearest(x, centroids, possible)[1]) == list(distance)


def test_queries_equal_their_sql(spark, sf_dir):
    """The two new queries that SQL can express."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name in ("op11_collocations", "op13_centroid_clusters"):
        ours = Q.queries()[name](spark, sf_dir)
        theirs = con.execute(Q.oracle_sql()[name])
        columns = [d[0] for d in theirs.description]
        assert sorted(ours.columns) == sorted(columns)
        assert sorted(tuple(r) for r in ours.select(*columns).collect()) == sorted(theirs.fetchall())
