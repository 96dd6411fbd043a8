"""Near-duplicates and line de-duplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.llm import probminhash as P
from tracklens.llm.linedup import drop_repeated_lines


def brute_classes(rows, similarity=0.8):
    """Classes by (id, text), from all pairs: links are J_P >= similarity of shingles weighted by their counts."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", t.lower())
        sets[i, t] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else t
    head = {i: i for i in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    def alike(x, y):
        if x == y:
            return True
        if not (isinstance(x, Counter) and isinstance(y, Counter)):
            return False
        every = x.keys() | y.keys()
        return len(x.keys() & y.keys()) >= 0.3 * len(every) and sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in x.keys() & y.keys()) >= similarity - 1e-12

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            ra, rb = root(a), root(b)
            if ra != rb and alike(sets[a], sets[b]):
                head[max(ra, rb)] = min(ra, rb)
    return {i: root(i)[0] for i in ids}


def planted(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("klmnrst") + rng.choice("aeiou")
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([60, 150, 300]))]
        for _ in range(rng.choice([1, 2, 6, 14])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                text[rng.randrange(len(text))] = word()
            rows.append((i, " ".join(text)))
            i += 1
    chain = [word() for _ in range(200)]  # neighbours are alike, the ends are not
    for k in range(12):
        chain = chain[8:] + [word() for _ in range(8)]
        rows.append((i + k, " ".join(chain)))
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_classes_equal_brute_force(spark, seed):
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ours = {r["doc_id"]: r["class_id"] for r in P.near_duplicates(df).collect()}
    assert ours == {i: c for (i, _), c in brute_classes(rows).items()}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(i // 2, t) for i, t in planted(6)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id string, text string")  # ids of any type
    brute = brute_classes([(str(i), t) for i, t in rows])
    ours = P.near_duplicates(df, deviations=None)
    assert sorted((r["doc_id"], r["class_id"]) for r in ours.collect()) == sorted((str(i), brute[str(i), t]) for i, t in rows)
    kept = P.one_of_each_class(df).collect()
    assert len(kept) == ours.select("component").distinct().count() and len({r["text"] for r in kept}) == len(kept)


def test_one_of_each_class(spark, edge_documents, no_documents):
    rows = edge_documents.withColumn("_head_id", F.lit(1)).withColumn("_own_hash", F.lit("x")).withColumn("component", F.lit(2))
    kept = P.one_of_each_class(rows)
    assert kept.columns == rows.columns
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()) == [-1, 1, 3, 5, 6, 7, 9, 10, 11]  # 8 is like 7
    assert P.one_of_each_class(no_documents).count() == 0


def test_edge_cases(spark, edge_documents, no_documents):
    out = {}
    for r in P.near_duplicates(edge_documents).collect():
        out.setdefault(r["doc_id"], []).append((r["class_id"], r["copies"], r["class_size"]))
    assert out[1] == [(1, 3, 3)] * 2 and out[2] == [(1, 3, 3)]
    assert out[3] == out[4] == [(3, 2, 2)] and out[5] == [(5, 1, 1)]
    assert out[None] == [(None, None, None)]
    assert P.near_duplicates(no_documents).count() == 0
    clash = edge_documents.withColumn("_id", F.lit(0)).withColumn("class_id", F.lit("x")).withColumn("_text", F.lit("y"))
    assert P.near_duplicates(clash).count() == edge_documents.count()


def test_joining_links_in_blocks():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    sets, hashes = [], []
    for _ in range(8):
        h = base.copy()
        h[rng.integers(0, 100, 4)] = rng.integers(0, 1 << 60, 4)
        h = np.unique(h)
        hashes.append(h)
        sets.append((np.unique((h >> np.uint64(32)).astype(np.uint32)), np.ones(len(h))))
    owner = np.repeat(np.arange(8), [len(h) for h in hashes])
    sig = (P.signatures(owner, np.concatenate(hashes), np.ones(len(owner)), 8, 336) >> np.uint64(56)).astype(np.uint8)
    ids = np.arange(8)
    links = P.joining_links(ids, ids, np.zeros(8, int), sig, sets, 0, 7, 0.8, True)
    assert len(links) == 7  # a spanning tree, not all 28 pairs
    across = P.joining_links(ids, ids, np.array([0] * 4 + [1] * 4), sig, sets, 0, 7, 0.8, True)
    assert all((a < 4) != (b < 4) for a, b in across)


def test_only_whole_keys_show_an_earlier_band():
    base = np.arange(1, 101, dtype=np.uint64) << np.uint64(40)
    sets = [(base, np.ones(100)), (np.sort(np.append(base[:95], base[95:] + np.uint64(1))), np.ones(100))]
    sig = np.tile(np.arange(1, 15, dtype=np.uint64) << np.uint64(56), (2, 1))
    sig[1, 0] += np.uint64(1)  # another shingle with the same first byte
    keys, short = P.band_keys(sig, 2, 7), (sig >> np.uint64(56)).astype(np.uint8)
    assert (keys[0] == keys[1]).tolist().count(True) == 1 and (short[0] == short[1]).all()
    ids = np.arange(2)
    link = lambda k: P.joining_links(ids, ids, np.zeros(2, int), short, sets, 1, 7, 0.8, True, k)
    shared = np.array([[5, 7], [5, 7]], np.uint64)
    assert link(np.array([[4, 7], [5, 7]], np.uint64)) == [(0, 1)]  # they met in the second band only
    assert link(shared) == []
    assert P.joining_links(ids, ids, np.zeros(2, int), short, sets, 1, 7, 0.8, True) == [(0, 1)]


def test_verification_sees_whole_hashes(spark):
    texts = spark.createDataFrame([(1, 5, "a b c d e f g h"), (2, 6, "a b a b a b a b")], "_id long, _hash long, _text string")
    nodes = spark.createDataFrame([(1, 5, 1, bytearray(336), [0] * 48), (2, 6, 2, bytearray(336), [0] * 48)], "_id long, _hash long, _node long, _sig binary, _bands array<long>")
    rows = {r["_node"]: r for r in P._sketches(nodes, texts, 5, "count").collect()}
    found, weights = P._shingles(rows[1]["_set"], rows[1]["_weights"])
    hashes, _ = P.shingle_hashes(["a b c d e f g h"], 5)
    assert found.tolist() == sorted(hashes.tolist()) and weights.tolist() == [1.0] * 4 and rows[1]["_weights"] is None
    assert sorted(P._shingles(rows[2]["_set"], rows[2]["_weights"])[1].tolist()) == [2.0, 2.0]
    assert len(rows[1]["_keys"]) == 48 * 8


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 62, 60).astype(np.uint64))
    wa, wb = rng.integers(1, 6, 60).astype(float), rng.integers(1, 6, 60).astype(float)
    exact = P.probability_jaccard((hashes, wa), (hashes, wb))
    slow = sum(1 / sum(max(x / wa[d], y / wb[d]) for x, y in zip(wa, wb)) for d in range(60))
    assert exact == pytest.approx(slow)
    sig = P.signatures(np.repeat([0, 1], 60), np.tile(hashes, 2), np.concatenate([wa, wb]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def brute_lines(rows):
    """By (id, text); rows equal in both are one document."""
    key = lambda r: (r[0], int(hashlib.md5(r[1].encode()).hexdigest()[:15], 16))
    seen, gone = set(), {}
    for i, t in sorted(set(rows), key=key):
        lines = [x.strip(" ") for x in t.split("\n")]
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not any(w):
                continue
            if w in seen:
                gone.setdefault((i, t), set()).update((p, p + 1, p + 2))
            seen.add(w)
    return sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))) for i, t in rows)


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i % 50, "\n".join(rng.choice("abcd ") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(1, 30)))) for i in range(70)]
    rows += rows[:5]
    out = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == brute_lines(rows)


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    passage = "one line of the passage\ntwo lines of the passage\nthree lines of it"
    rows = [(1, passage), (2, passage), (2, "these lines\nare found\nnowhere else")]
    out = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, passage), (2, ""), (2, "these lines\nare found\nnowhere else")]


def test_line_edge_cases(spark, edge_documents, no_documents):
    clashing = ["p", "_covered", "_covered_id", "_COVERED_KEY", "_lines", "covered", "text_key", "_id", "_key", "_text"]
    rows = edge_documents
    for c in clashing:
        rows = rows.withColumn(c, F.lit(9))
    rows = drop_repeated_lines(rows, counts=("lines", "removed"))
    out = {r["doc_id"]: r for r in rows.collect()}
    assert rows.columns == [*edge_documents.columns, *clashing, "lines", "removed"] and out[8]["_covered"] == 9
    assert out[8]["text"] == "head\ntail" and out[8]["removed"] == 3 and out[7]["removed"] == 0
    assert out[5]["text"] is None and out[5]["lines"] == 0 and out[10]["text"] == "\n\n\n\n"
    assert drop_repeated_lines(no_documents).count() == 0
