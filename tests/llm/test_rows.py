"""Scores, shards, tokens and packing against brute force, exact round trips and held-out accuracy."""

import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklens.llm import packing as K
from tracklens.llm import queries as Q
from tracklens.llm import sentencepiece as SP
from tracklens.llm import toxicity as T
from tracklens.llm.licenses import TEMPLATES, document_licences, fit_licences, scan_paragraphs
from tracklens.llm.quality import fit_quality, quality_score
from tracklens.llm.sharding import SlotMap, shard_documents
from tracklens.llm.toxicity import fit_toxicity, toxicity_score


@pytest.fixture(scope="module")
def labelled(spark):
    good = [f"the river runs past the old mill number {i} and the children walk along the bank each summer" for i in range(120)]
    bad = [f"BUY NOW!!! ### click {i} $$$ click ### win %%% win &&& !!! {i}" for i in range(120)]
    docs = [(i, t) for i, t in enumerate(good + bad)]
    docs = [(i, t + (" you worthless idiot" if i % 3 == 0 else "")) for i, t in docs]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 120), int(i % 3 == 0)) for i, _ in docs], "doc_id long, quality int, toxic int")


def test_quality(spark, labelled, edge_documents, no_documents):
    docs, labels = labelled
    model = fit_quality(docs, labels.filter("doc_id % 4 <> 2"))
    held = docs.filter("doc_id % 4 = 2").join(labels, "doc_id").withColumn("s", quality_score("text", model))
    assert held.filter("(s >= 0.5) = (quality = 1)").count() >= 0.95 * held.count()
    scores = edge_documents.withColumn("s", quality_score("text", model))
    assert scores.filter("s between 0 and 1").count() == edge_documents.count()
    assert no_documents.withColumn("s", quality_score("text", model)).count() == 0
    none = fit_quality(docs, labels.limit(0))
    assert docs.limit(3).select(quality_score("text", none).alias("s")).distinct().count() == 1


def test_toxicity(spark, labelled, edge_documents, no_documents):
    docs, labels = labelled
    model = fit_toxicity(docs, labels.filter("doc_id % 5 <> 0"))
    assert 0 < len(model.index) < 5000
    held = docs.filter("doc_id % 5 = 0").join(labels, "doc_id").withColumn("s", toxicity_score("text", model))
    assert held.filter("(s >= 0.5) = (toxic = 1)").count() >= 0.95 * held.count()
    assert edge_documents.withColumn("s", toxicity_score("text", model)).filter("s between 0 and 1").count() == edge_documents.count()
    none = fit_toxicity(docs, labels.limit(0))
    assert docs.limit(1).select(toxicity_score("text", none)).first()[0] == 0.5
    assert no_documents.withColumn("s", toxicity_score("text", model)).count() == 0


def held_out_auc(df, column):
    rows = df.select("score", column).collect()
    good, bad = ([r["score"] for r in rows if r[column] == y] for y in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def sf_001():
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("the driver's tables are not here")
    return "/root/testdata/sf0.01"


def test_quality_of_held_out_rows_and_brute_force_scores(spark):
    """Scores are the calibrated difference of two compressed sizes and of nothing else."""
    import zstandard

    model = Q.quality_model(spark, sf_001())
    out = Q.op1_quality(spark, sf_001())
    labels = Q.read_table(spark, sf_001(), "labels")
    assert held_out_auc(out.filter("held_out").join(labels, "doc_id"), "quality") >= 0.9
    scores = {r["doc_id"]: r for r in out.collect()}
    kind = {True: zstandard.DICT_TYPE_FULLDICT, False: zstandard.DICT_TYPE_RAWCONTENT}
    squeeze = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind[t]), write_content_size=False, write_dict_id=False) for d, t in zip((model.good, model.bad), model.trained)]
    for r in Q.read_table(spark, sf_001(), "documents").collect():
        data = (r["text"] or "").encode()
        g, b = (sum(len(c.compress(data[i : i + 1024])) for i in range(0, max(1, len(data)), 1024)) for c in squeeze)
        z = model.intercept + model.slope * np.arcsinh(((b - g) / (len(data) + 1) - model.mean) / model.scale)
        found = scores[r["doc_id"]]
        assert found["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35)))) and found["predicted"] == int(found["score"] >= 0.7)
        assert found["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_does_not_fade_with_length(spark):
    """A long good text is as good as its parts: of the labelled rows of the table, joined."""
    model = Q.quality_model(spark, sf_001())
    good = Q.read_table(spark, sf_001(), "documents").join(Q.read_table(spark, sf_001(), "labels").filter("quality = 1"), "doc_id").filter("lang = 'en' and length(text) > 1000").orderBy("doc_id").limit(40)
    long = "\n".join(r["text"] for r in good.collect())
    assert len(long) > 40_000
    assert spark.createDataFrame([(long,)], "text string").select(quality_score("text", model)).first()[0] > 0.9


def test_toxicity_of_held_out_rows(spark):
    out = Q.op5_toxicity(spark, sf_001())
    labels = Q.read_table(spark, sf_001(), "labels")
    assert held_out_auc(out.filter("held_out").join(labels, "doc_id"), "toxic") >= 0.9


def test_ftrl_equals_a_plain_one():
    """With dictionaries in place of arrays, by the rule of the paper: per-coordinate rates, L1 and L2."""
    rng = np.random.default_rng(3)
    rows = [(sorted(rng.choice(64, rng.integers(1, 9), replace=False).tolist()), int(rng.random() < 0.4)) for _ in range(150)]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.8, 0.01
    z, n, zb, nb = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)
    bias = lambda: -zb / ((beta + nb**0.5) / alpha)
    for _ in range(2):
        for at, y in rows:
            old = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-(sum(old.values()) + bias()))) - y
            b = bias()
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * old[i]
                n[i] = n.get(i, 0.0) + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    features = np.array([i for at, _ in rows for i in at])
    starts = np.concatenate([[0], np.cumsum([len(at) for at, _ in rows])])
    w, found = T.ftrl(features, starts, np.array([y for _, y in rows], float), 6, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=2)
    assert w.tolist() == pytest.approx([weight(i) if i in z else 0.0 for i in range(64)]) and found == pytest.approx(bias())
    assert 0 < (w == 0).sum() < 64


def test_features_are_words_pairs_and_skips():
    mixed = T.hashed_features(["one two three two one two", "", None, "one two"], 24)
    count = np.diff(mixed[1]).tolist()
    assert count == [3 + 4 + 3, 0, 0, 2 + 1]  # one two, two three, three two, two one; one three, two two, three one, two two


def test_conflicting_and_null_labels_are_left_out(spark, labelled):
    docs, labels = labelled
    noise = spark.createDataFrame([(i, 0, 0) for i in range(10)] + [(i, 1, 1) for i in range(10)] + [(11, None, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    clean = labels.filter("doc_id >= 10")
    assert fit_quality(docs, clean.unionByName(noise)) == fit_quality(docs, clean)
    a, b = fit_toxicity(docs, clean.unionByName(noise)), fit_toxicity(docs, clean)
    assert a.bias == b.bias and a.weight.tolist() == b.weight.tolist()


def test_shards(spark, edge_documents, no_documents):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int")).alias("text"))
    rows = shard_documents(docs, shards=8).collect()
    assert len(rows) == 3000
    load = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows])
    assert load.max() < 1.01 * load.min()
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["text_crc32"] == zlib.crc32(b"x" * (r["doc_id"] % 300)) and r["size"] == r["doc_id"] % 300 + 1 for r in rows)
    edge = shard_documents(edge_documents.withColumn("vslot", F.lit("clash"))).collect()
    assert len(edge) == edge_documents.count()
    assert shard_documents(no_documents).count() == 0


def loads(rows, sizes):
    out = {}
    for r in rows:
        out[r["shard"]] = out.get(r["shard"], 0) + sizes[r["vslot"]]
    return out


def brute_edit(was, sizes, shards, tolerance=0.001):
    """The same moves, one by one."""
    home = [s if s < shards else v % shards for v, s in enumerate(was)]
    for _ in range(len(was)):
        load = [sum(sizes[v] for v in range(len(was)) if home[v] == s) for s in range(shards)]
        giver, taker = load.index(max(load)), load.index(min(load))
        gap = load[giver] - load[taker]
        gains = [min(sizes[v], gap - sizes[v]) if home[v] == giver and 0 < sizes[v] < gap else 0 for v in range(len(was))]
        if gap <= max(1, int(sum(sizes) / shards * tolerance)) or max(gains) <= 0:
            break
        home[gains.index(max(gains))] = taker
    return home


def test_the_map_is_stored_and_edited(spark, tmp_path):
    rng = np.random.default_rng(8)
    sizes = rng.integers(0, 1000, 256).tolist()
    table = spark.createDataFrame(list(enumerate(sizes)), "vslot int, bytes long")
    slot_map = SlotMap.create(spark, str(tmp_path / "map"), shards=4, slots=256)
    homes = [v % 4 for v in range(256)]
    for version, shards in ((2, 4), (3, 5), (4, 3)):
        slot_map.rebalance(table, shards)
        rows = sorted(slot_map.latest().collect(), key=lambda r: r["vslot"])
        new = brute_edit(homes, sizes, shards)
        assert [r["shard"] for r in rows] == new and {r["version"] for r in rows} == {version}
        load = loads(rows, sizes)
        assert len(load) == shards and max(load.values()) - min(load.values()) <= 0.02 * sum(sizes) / shards
        moved = sum(sizes[v] for v in range(256) if homes[v] != new[v])
        assert moved <= {2: 0.1, 3: 0.22, 4: 0.45}[version] * sum(sizes)  # about what the change of shards requires
        homes = new
    slot_map.rebalance(table, 3)  # already balanced: no version is added
    assert [r[0] for r in slot_map.versions().groupBy("version").count().orderBy("version").collect()] == [1, 2, 3, 4]


def test_a_map_of_other_slots_is_refused(spark, tmp_path, edge_documents):
    """Looking records up in it would lose rows. Nor does a map that lacks slots lose any."""
    path = str(tmp_path / "map")
    SlotMap.create(spark, path, shards=8, slots=1024)
    with pytest.raises(ValueError, match="1024 slots"):
        shard_documents(edge_documents, map_path=path)
    assert shard_documents(edge_documents, map_path=path, slots=1024).count() == edge_documents.count()
    short = SlotMap(spark, str(tmp_path / "short"), slots=4)
    short._add(spark.createDataFrame([(0, 0), (1, 1)], "vslot int, shard int"), 0)
    with pytest.raises(Exception, match="no shard for slot 3"):
        short.place(spark.createDataFrame([(0,), (3,)], "vslot int")).collect()


def test_a_crash_while_a_version_is_written_leaves_the_old_one(spark, tmp_path):
    slot_map = SlotMap.create(spark, str(tmp_path / "map"), shards=2, slots=8)
    before = sorted(map(tuple, slot_map.latest().collect()))
    spark.createDataFrame([(0, 1)], "vslot int, shard int").write.parquet(str(tmp_path / "map" / "rows-half"))
    (tmp_path / "map" / "versions" / f"{2:020d}").touch()
    assert sorted(map(tuple, slot_map.latest().collect())) == before


def test_sharding_goes_on_from_a_stored_map(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    path = str(tmp_path / "map")
    first = {r["doc_id"]: r for r in shard_documents(docs, map_path=path).collect()}
    grown = docs.unionByName(spark.range(2000, 2100).select(F.col("id").alias("doc_id"), F.lit("y" * 50).alias("text")))
    second = {r["doc_id"]: r for r in shard_documents(grown, map_path=path).collect()}
    assert {r["version"] for r in second.values()} != {r["version"] for r in first.values()}
    assert sum(first[d]["shard"] != second[d]["shard"] for d in first) < 200
    assert all(first[d]["vslot"] == second[d]["vslot"] for d in first)


def test_rows_that_share_an_id_are_spread(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text"), F.col("id").cast("string")).alias("text"))
    rows = shard_documents(docs).collect()
    counts = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows])
    assert counts.max() < 1.05 * counts.min()


def test_sentencepiece_equals_the_library_and_round_trips(spark, edge_documents, no_documents):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, library = SP.PieceModel.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["  Hello  world\nfoo bar\t", "", "a\x00b", "日本語\U0001f999", "     x   y        z\n\n", "x" * 3000, "internationalisation of the tokeniser " * 20, "éèêë ñandú straße"]
    codec = SP.Codec(model)
    for t, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(t)
        assert codec.decode_batch([ids.tolist()]) == [t]
    rows = {r["doc_id"]: r for r in SP.encoded(edge_documents, model).collect()}
    assert rows[3]["ids"] == [] and rows[5]["ids"] == [] and rows[6]["decoded"].startswith("word0 word1")
    assert SP.encoded(no_documents, model).count() == 0


def test_words_of_all_lengths_advance_together(monkeypatch):
    """One group for a batch's words, whatever their lengths, as long as its cells are within bounds; results stay."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library, groups = SP.Codec(SP.PieceModel.load(path)), sentencepiece.SentencePieceProcessor(model_file=path), []
    monkeypatch.setattr(SP.Codec, "_viterbi", lambda self, points, *rest, f=SP.Codec._viterbi: (groups.append(points.shape), f(self, points, *rest))[1])
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("abcdeiorst0é"), size)) for size in rng.permutation(np.arange(1, 61))) for _ in range(5)]
    texts += ["z" * 600, "a" * 512 + " b", ""]
    assert [x.tolist() for x in codec.encode_batch(texts[:5])] == [library.encode(t) for t in texts[:5]]
    assert len(groups) == 1 and groups[0][0] == 61
    monkeypatch.setattr(SP, "CELLS", 700)
    codec.words.clear()
    assert [x.tolist() for x in codec.encode_batch(texts)] == [library.encode(t) for t in texts]
    assert len(groups) > 10 and all(length * n <= 700 for length, n in groups[1:])


def test_pairs_are_merged_like_single_strings():
    codec = SP.Codec(SP.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model")))
    rng = np.random.default_rng(5)
    a, b = (rng.choice(codec.ids[codec.ids >= 0], 4000) for _ in range(2))
    a[:200] = -1
    b[200:300] = SP._FOREIGN + 0x1F999
    spell = lambda t: "" if t < 0 else chr(t - SP._FOREIGN) if t >= SP._FOREIGN else codec.model.pieces[t]
    slow = [codec.merged(spell(x) + spell(y)) == ([x, y] if x >= 0 else [y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert codec._stay_apart(a, b).tolist() == slow
    assert codec._stay_apart(a, b).tolist() == slow  # now from the table
    assert any(slow) and not all(slow)


def test_a_substring_with_a_pieces_hash_is_seen():
    for unigram in (True, False):
        codec = SP.Codec(SP.PieceModel(["<unk>", "a", "b", "c", "ab", "▁"], [0.0, -3.0, -4.0, -5.0, -1.0, -9.0], [2, 1, 1, 1, 1, 1], unigram=unigram))
        assert codec.encode_batch(["abc"])[0].tolist() == [5, 4, 3]
        codec.words.clear()
        codec.points[4] = codec.points[3]  # as if the hash of "ab" were also that of another text
        assert codec.encode_batch(["abc"])[0].tolist() == [5, 4, 3]


def test_sentencepiece_keeps_clashing_columns_out(spark):
    model = SP.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(1, "a b", "x", 2, 3), (None, None, None, None, None), (1, "a b", "x", 2, 3)], "doc_id long, text string, ids string, _id int, _text int")
    assert [(r["doc_id"], r["decoded"]) for r in SP.encoded(docs, model).orderBy("doc_id").collect()] == [(None, ""), (1, "a b"), (1, "a b")]


def test_unigram_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    pieces = ["<unk>", *"abc", "▁", "▁a", "ab", "bc", "abc", "ca", "▁ab", "cab"]
    model = SP.PieceModel(pieces, [0.0, *(-rng.random(len(pieces) - 1) * 5)], [2] + [1] * (len(pieces) - 1), unigram=True)
    codec = SP.Codec(model)
    score = dict(zip(pieces, model.scores, strict=True))

    def best(word):
        out = [(0.0, [])]
        for end in range(1, len(word) + 1):
            out.append(max((out[s][0] + score[word[s:end]], out[s][1] + [word[s:end]]) for s in range(end) if word[s:end] in score))
        return out[-1]

    for word in ("▁abcabc", "▁cabab", "▁bca", "▁aaa"):
        ids = codec.encode_batch([word[1:]])[0]
        assert sum(model.scores[i] for i in ids) == pytest.approx(best(word)[0], abs=1e-4)
    assert codec.encode_batch(["azzb"])[0].tolist().count(0) == 1  # a run of unknown characters


def test_encoder_equals_the_tokenizers_library(spark):
    """On every text of the table of sf0.01, and on texts that are no prose."""
    from tokenizers import Tokenizer

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("the driver's tables are not here")
    library, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), K.byte_bpe_encoder()
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"]]
    assert len(texts) >= 1000
    texts += ["a<|endoftext|>b", "  \n\n  x", "\U0001f999 日本語", "don't we'll", "x" * 5000, " " * 3000 + "y", "\x00\x01\r\n", "a\u0301\u200d\ufeff"]
    for t in texts:
        assert ours(t).tolist() == library.encode(t, add_special_tokens=False).ids


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_encoder_on_any_text(text):
    from tokenizers import Tokenizer

    if "both" not in _encoders:
        _encoders["both"] = K.byte_bpe_encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours, library = _encoders["both"]
    assert ours(text).tolist() == library.encode(text, add_special_tokens=False).ids


_encoders: dict = {}


def check_packing(docs, pieces, length):
    ids = {}
    encoder = K.byte_bpe_encoder()
    for r in docs:
        ids[r["doc_id"]] = [*encoder(r["text"] or "").tolist(), 1] if r["text"] else [1]
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_window.setdefault(p["sequence_id"], []).append(p)
    for d, ps in by_doc.items():
        if sum(r["doc_id"] == d for r in docs) == 1:
            whole = [x for p in sorted(ps, key=lambda p: p["start"]) for x in np.frombuffer(p["ids"], "<u4").tolist()]
            assert whole == ids[d] and all(p["doc_tokens"] == len(ids[d]) for p in ps)
    for w, ps in by_window.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == length or w == max(by_window)
    assert sorted(by_window) == list(range(len(by_window)))
    return by_window


def test_packing_covers_every_token_once(spark, edge_documents, no_documents):
    pieces = K.packed(edge_documents.withColumn("_part", F.lit(1)), length=256).collect()
    check_packing(edge_documents.collect(), pieces, 256)
    assert K.packed(no_documents).count() == 0


def sources(spark, sizes):
    """Documents of about `size` words for each (source, size), alternating."""
    rows, left = [], dict(sizes)
    while any(left.values()):
        for s in sizes:
            if left[s]:
                n = min(left[s], 37)
                rows.append((len(rows), " ".join(["alpha"] * n), s))
                left[s] -= n
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def shares(pieces):
    out = {}
    for p in pieces:
        out.setdefault(p["sequence_id"], {}).setdefault(p["source"], 0)
        out[p["sequence_id"]][p["source"]] += p["length"]
    return [out[w] for w in sorted(out)]


def test_packing_keeps_the_mixture(spark):
    docs = sources(spark, {"big": 6000, "s0": 3000, "s1": 1000})
    pieces = K.packed(docs, length=512).collect()
    check_packing(docs.collect(), pieces, 512)
    for w in shares(pieces)[:-2]:
        assert abs(w["big"] - 0.6 * 512) < 4 and abs(w["s0"] - 0.3 * 512) < 4 and abs(w["s1"] - 0.1 * 512) < 4
    pieces = K.packed(docs, length=512, targets={"big": 0.9, "absent": 0.02}).collect()
    check_packing(docs.collect(), pieces, 512)
    for w in shares(pieces)[:10]:
        assert abs(w["big"] / 512 - 0.9 / 0.98) < 0.01  # an absent source's share is shared by those that are there
    pieces = K.packed(docs, length=512, targets={"s1": 0.5, "s0": 0.5}).collect()
    check_packing(docs.collect(), pieces, 512)
    assert [set(w) <= {"s0", "s1"} or w["big"] <= 1 for w in shares(pieces)[:3]] == [True] * 3
    for bad in ({"big": 0.7, "s0": 0.4}, {"big": -0.1}):
        with pytest.raises(ValueError):
            K.packed(docs, targets=bad)


def test_packing_of_many_sources(spark):
    """Sources beyond the queues are all served evenly, and a small one's target holds."""
    docs = sources(spark, {f"s{k}": 148 for k in range(200)})
    pieces = K.packed(docs, length=2048, queues=16, targets={"s199": 0.05}).collect()
    check_packing(docs.collect(), pieces, 2048)
    first = shares(pieces)[0]
    assert abs(first["s199"] - 0.05 * 2048) < 3
    half = shares(pieces)[: len(shares(pieces)) // 2]
    served = {s: sum(w.get(s, 0) for w in half) for s in {f"s{k}" for k in range(199)}}
    assert min(served.values()) >= 37 and max(served.values()) <= 120  # of 152 tokens each


def test_null_and_empty_sources_are_two(spark):
    docs = spark.createDataFrame([(i, "alpha " * 50, s) for i, s in enumerate([None, ""] * 20)], "doc_id long, text string, source string")
    pieces = K.packed(docs, length=256, targets={None: 0.75}).collect()
    check_packing(docs.collect(), pieces, 256)
    assert {p["source"] for p in pieces} == {None, ""}
    assert abs(shares(pieces)[0][None] - 192) < 3


def test_schedule_is_deficit_round_robin():
    rng = np.random.default_rng(0)
    for _ in range(6):
        n = rng.integers(1, 60, 5).tolist()
        a = rng.choice([1000, K.RESOLUTION // 3, K.RESOLUTION * 2, K.RESOLUTION * 5 + 77], 5).tolist()
        order, deficit, taken = [], [K.HALF] * 5, [0] * 5  # simulated
        while sum(taken) < sum(n):
            for k in range(5):
                deficit[k] += a[k]
                while deficit[k] >= K.RESOLUTION and taken[k] < n[k]:
                    order.append((k, taken[k]))
                    deficit[k] -= K.RESOLUTION
                    taken[k] += 1
        schedule = K.Schedule(a, n, 64)
        q, i = (np.array(c) for c in zip(*order))
        assert schedule.position(q, i).tolist() == list(range(len(order)))


MIT = """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License."""
BSD = """  Redistribution and use in source and binary forms, with or without
  modification, are permitted provided that the following conditions
  are met:"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""


@pytest.fixture(scope="module")
def licence_model(spark, sf_dir):
    return fit_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_licences(spark, licence_model, edge_documents, no_documents):
    prose = "Along the quiet river some old boats were waiting for the summer and the people of the town walked by. " * 40
    texts = {
        1: ("MIT", "prose before\nReleased under the MIT License."), 2: ("Apache-2.0", "Licensed under the Apache License, Version 2.0.\nmore"), 3: ("GPL", "This work is licensed under the GNU General Public License, version 3."),
        4: ("CC-BY-NC", "x\nLicensed under CC BY-NC 4.0."), 5: (None, "The general public gave a copy to the library."), 6: (None, "My driving license was renewed."), 7: ("none", ""), 8: ("none", None),
        9: ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
        10: ("MIT", MIT), 11: ("GPL", GPL), 12: ("BSD", BSD), 13: ("Apache-2.0", APACHE), 14: ("MIT", "This file is distributed under the MIT licence."), 15: ("proprietary", "Copyright 2020 X.\nAll rights reserved."),
        16: ("GPL", f"{prose}\n{GPL}\n{prose}"), 17: ("MIT", prose + MIT.replace("\n", " ") + prose), 18: ("none", prose),
    }
    both = f"{MIT}\n\n{prose}\n \n{GPL}"
    df = spark.createDataFrame([(k, t) for k, (_, t) in texts.items()] + [(19, both), (20, "prose"), (20, MIT)], "doc_id long, text string")
    rows = document_licences(df, licence_model).collect()
    out = {r["doc_id"]: r for r in rows if r["doc_id"] < 20}
    assert {k: out[k]["licence"] for k, (f, _) in texts.items() if f} == {k: f for k, (f, _) in texts.items() if f}
    assert out[5]["licence"] in ("none", "unknown") and out[6]["licence"] in ("none", "unknown")
    assert out[19]["licences"] == ["GPL", "MIT"] and out[19]["paragraphs"] == 2
    assert sorted(r["licence"] for r in rows if r["doc_id"] == 20) == ["MIT", "none"]  # rows that share an id
    clashing = edge_documents.withColumn("family", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("words", F.lit(3)).withColumn("text_key", F.lit(4))
    assert document_licences(clashing, licence_model).count() == edge_documents.count()
    assert document_licences(no_documents, licence_model).count() == 0


def test_licence_scores_equal_a_plain_scan(spark, licence_model):
    """Windows, n-grams, scores and coverage of the texts, in Python."""
    texts = {1: MIT, 2: f"head\n\n{GPL}\n\nAll rights reserved.", 3: " ".join(["word"] * 70) + " " + APACHE, 4: "nothing here", 5: "the mit building and the license of the public"}
    m = licence_model
    words = lambda t: re.findall(r"[^\W_]+", re.sub("licen[cs]e", "license", t.lower()))
    grams = lambda w, n: [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    expected = {}
    for i, t in texts.items():
        for p, block in enumerate(re.split(r"\n[ \t\r]*\n\s*", t)):
            whole = words(block)
            for k in range(0, max(0, len(whole) - 33) + 1, 32):
                w = whole[k : k + 64]
                found = [m.weights[g] for g in {*w, *grams(w, 2), *grams(w, 3)} if g in m.weights]
                if not found:
                    continue
                s = np.sum(found, axis=0) + np.array(m.intercepts)
                probability = 1 / (1 + np.exp(-np.clip((s[:-1].max() - s[-1]) * m.slope + m.offset, -35, 35)))
                if probability >= 0.5:
                    family = m.families[int(s[:-1].argmax())]
                    share = max(len(set(grams(w, 2)) & set(grams(words(x), 2))) / len(set(grams(words(x), 2))) for x in TEMPLATES[family])
                    expected[i, p, k // 32, family] = (probability, share)
    rows = scan_paragraphs(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), m).collect()
    found = {(r["doc_id"], r["paragraph"], r["window"], r["family"]): (r["probability"], r["coverage"]) for r in rows}
    assert found.keys() == expected.keys() and all(found[x] == pytest.approx(expected[x], abs=1e-5) for x in found)
    assert {f for _, _, _, f in expected} == {"MIT", "GPL", "proprietary", "Apache-2.0"}


def test_planted_licences_are_found(spark):
    """Recall on the driver's table: of documents with a licence line of a known family, and of those without."""
    planted = {"This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "proprietary", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    rows = {r["doc_id"]: r["licences"] for r in Q.op6_licences(spark, sf_001()).collect()}
    hit = missed = wrong = 0
    for r in Q.read_table(spark, sf_001(), "documents").collect():
        families = {f for line, f in planted.items() if line in r["text"].split("\n")}
        hit += len(families & set(rows[r["doc_id"]]))
        missed += len(families - set(rows[r["doc_id"]]))
        wrong += len(set(rows[r["doc_id"]]) - families)
    print("licences: found", hit, "missed", missed, "others", wrong)
    assert hit >= 0.97 * (hit + missed) and wrong <= 0.02 * len(rows)
