"""Near-duplicates by ProbMinHash.

A text's weighted word shingles are signed as Poisson processes: shingle d of weight w arrives at times that are sums
of exponential steps of rate w, each arrival in a register chosen by chance, both a function of the shingle and the
number of the arrival only. A register keeps its first arrival, and a shingle stops once its next arrival is later
than the text's last register. Two texts agree in a register with a probability that is their probability Jaccard
similarity, J_P. With unit weights J_P is the Jaccard similarity of the shingle sets itself.

Signatures are banded; texts that share a band are candidates, and a candidate pair counts only after its exact J_P is
computed from the shingles. The passes:

1. Texts with the same weighted shingles become one node (a group of exact copies has no pairs at all), which keeps
   the signature they share; texts are signed once.
2. In each bucket every node is paired with the bucket's first node only, whatever the bucket's size. Verified pairs
   are links; connected components are found with links in the shared folder.
3. Where a bucket still holds several components its nodes meet in one task (in blocks of a bounded number of nodes,
   each pair of blocks a task of its own). Only pairs of different components are looked at, those first whose
   signatures agree most; pairs whose signatures put them five deviations below the threshold are out, all others are
   computed exactly until they are known to be linked. Only links that join components leave the task, so neither
   pairs nor links of a group multiply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, bounded_batches, checkpointed, free_names, mix, word_lists, written

BANDS, ROWS, BLOCK, SALTS = 48, 7, 1024, 16


def shingle_hashes(texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of `words` consecutive words of each text, and their counts; a text with fewer words,
    but any, has one shingle of all of them."""
    hashes, counts = word_lists(texts)
    begin = np.cumsum(counts) - counts
    number = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    at = np.repeat(begin - (np.cumsum(number) - number), number) + np.arange(number.sum())
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    left = np.repeat(begin + counts, number) - at  # words of the text from here on
    for j in range(words):
        out = out * GOLDEN + np.where(left > j, padded[at + j] + np.uint64(1), np.uint64(0))
        out ^= out >> np.uint64(29)
    return mix(out), number


def weighted(hashes: np.ndarray, owner: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) with weight: 1 ("set") or how often it occurs ("count")."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h))).astype(float)
    return o[at], h[at], np.ones(len(at)) if weights == "set" else count


def signatures(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """A row of registers for each text, 0 where it has no shingles. All texts' arrivals advance together."""
    first, holder = np.full(texts * registers, np.inf), np.zeros(texts * registers, np.uint64)
    time, rate, who, base, arrival = np.zeros(len(hashes)), weight, owner.astype(np.int64), hashes, 0
    latest = np.full(texts, np.inf)
    while len(base):
        arrival += 1
        random = mix(base + np.full(1, arrival, np.uint64) * GOLDEN)
        time = time - np.log(((random >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
        slot = who * registers + ((mix(random) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        early = np.flatnonzero(time < first[slot])
        slot_, time_ = slot[early], time[early]
        np.minimum.at(first, slot_, time_)
        won = time_ == first[slot_]
        holder[slot_[won]] = base[early[won]]  # base is sorted within a text, so equal times are decided by the hash
        if arrival < 4 or arrival % 8 == 0:  # between, an old bound only lets arrivals pass that win nothing
            some = who[np.concatenate([[True], who[1:] != who[:-1]])]
            latest[some] = first.reshape(texts, registers)[some].max(1)
        alive = time < latest[who]
        if not alive.all():
            time, rate, who, base = time[alive], rate[alive], who[alive], base[alive]
    return holder.reshape(texts, registers)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature: the buckets' names."""
    keys = np.tile(mix(np.arange(bands, dtype=np.uint64)), (len(sig), 1))
    for r in range(rows):
        keys = mix(keys ^ sig[:, r::rows])
    return keys


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two (sorted distinct hashes, weights)."""
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1], b[1]
    if (wa == 1).all() and (wb == 1).all():
        return len(common) / (len(wa) + len(wb) - len(common))
    # For shingle d: sum over all e of max(wa[e] / wa[d], wb[e] / wb[d]), by the order of the ratio wa[e] / wb[e].
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    xa, xb = wa[ia], wb[ib]
    order = np.argsort(xa / xb, kind="stable")
    xa, xb = xa[order], xb[order]
    above_a = np.cumsum(xa[::-1])[::-1] - xa
    below_b = np.cumsum(xb)
    total = (above_a + only_a) / xa + (below_b + only_b) / xb
    return float((1.0 / total).sum())


def _signed(documents: DataFrame, id_col: str, text_col: str, words: int, weights: str, bands: int, rows: int) -> DataFrame:
    """(_id, _hash, _key, _sig, _bands): _hash of the text; _key names the weighted shingles (or a text without words
    itself), null for a null text; _sig has a byte of each register, _bands the bands' whole keys, null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                texts = b["_text"].to_pylist()
                hashes, number = shingle_hashes(texts, words)
                owner, distinct, weight = weighted(hashes, np.repeat(np.arange(len(texts)), number), weights)
                begin = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
                sig = signatures(owner, distinct, weight, len(texts), bands * rows)
                band, short = band_keys(sig, bands, rows).view(np.int64), (sig >> np.uint64(56)).astype(np.uint8)
                keys = []
                for text, s, e in zip(texts, begin[:-1], begin[1:], strict=True):
                    if text is None:
                        keys.append(None)
                    elif s == e:
                        keys.append(b"t" + xxhash.xxh3_128_digest(text.encode()))
                    else:
                        keys.append(b"s" + xxhash.xxh3_128_digest(distinct[s:e].tobytes() + weight[s:e].tobytes()))
                some = [s < e for s, e in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b["_id"], b["_hash"], pa.array(keys, pa.binary()), pa.array([x.tobytes() if y else None for x, y in zip(short, some, strict=True)], pa.binary()), pa.array([x if y else None for x, y in zip(band, some, strict=True)], pa.list_(pa.int64()))],
                    ["_id", "_hash", "_key", "_sig", "_bands"],
                )

    rows_in = documents.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    return rows_in.mapInArrow(sign, f"_id {documents.schema[id_col].dataType.simpleString()}, _hash long, _key binary, _sig binary, _bands array<long>")


def _sketches(candidates: DataFrame, texts: DataFrame, words: int, weights: str) -> DataFrame:
    """(_node, _sig, _keys, _set, _weights) of candidates (_node, _sig, _bands and the _id and _hash of one of its
    texts): a byte a register, the bands' whole keys, sorted shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                hashes, number = shingle_hashes(b["_text"].to_pylist(), words)
                owner, distinct, weight = weighted(hashes, np.repeat(np.arange(b.num_rows), number), weights)
                cuts = np.searchsorted(owner, np.arange(b.num_rows + 1)).tolist()
                parts = list(zip(cuts[:-1], cuts[1:], strict=True))
                one = [bool((weight[s:e] == 1).all()) for s, e in parts]
                keys = [np.asarray(x, np.int64).tobytes() for x in b["_bands"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b["_node"], b["_sig"], pa.array(keys, pa.binary()), pa.array([distinct[s:e].tobytes() for s, e in parts], pa.binary()), pa.array([None if x else weight[s:e].tobytes() for (s, e), x in zip(parts, one, strict=True)], pa.binary())],
                    ["_node", "_sig", "_keys", "_set", "_weights"],
                )

    joined = texts.join(candidates, ["_id", "_hash"]).select("_node", "_sig", "_bands", "_text")
    return written(joined.mapInArrow(sketch, "_node long, _sig binary, _keys binary, _set binary, _weights binary").dropDuplicates(["_node"]), "sketches")


def _shingles(content: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(content, np.uint64)
    return found, np.ones(len(found)) if weights is None else np.frombuffer(weights, np.float64)


def _verified(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (_a, _b) whose exact J_P reaches similarity."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = [probability_jaccard(_shingles(sa, wa), _shingles(sb, wb)) >= similarity - 1e-12 for sa, wa, sb, wb in zip(b["_sa"], b["_wa"], b["_sb"], b["_wb"], strict=True)]
            yield b.loc[near, ["_a", "_b"]]

    side = lambda x: sketches.select(F.col("_node").alias(f"_{x}"), F.col("_set").alias(f"_s{x}"), F.col("_weights").alias(f"_w{x}"))
    return pairs.join(side("a"), "_a").join(side("b"), "_b").select("_a", "_b", "_sa", "_wa", "_sb", "_wb").mapInPandas(measure, "_a long, _b long")


def joining_links(nodes: np.ndarray, classes: np.ndarray, block: np.ndarray, sig: np.ndarray, sets: list, band: int, rows: int, similarity: float, sized: bool, keys: np.ndarray | None = None, deviations: float | None = 5.0) -> list[tuple[int, int]]:
    """Links between nodes of different classes that join them: of a bucket, or of two blocks of one.

    block is 0 or 1 for each node; only pairs across are taken if both occur. A pair that shares an earlier band is left
    to that band's bucket; whether it does is seen from the whole band keys (without them no pair is left out), for sig
    has a byte a register only, in which bands look equal that have no bucket in common.
    """
    n, registers = sig.shape
    least = -1.0 if deviations is None else similarity - deviations * np.sqrt(similarity * (1 - similarity) / registers)
    size = np.array([len(s[0]) for s in sets])
    across, found = block.min() != block.max(), []
    tile = max(1, 30_000_000 // (n * registers))
    for i in range(0, n, tile):
        agree = (sig[i : i + tile, None, :] == sig[None, :, :]).mean(2)
        fine = (agree >= least) & (classes[i : i + tile, None] != classes) & (np.arange(i, min(i + tile, n))[:, None] < np.arange(n))
        if across:
            fine &= block[i : i + tile, None] != block
        if sized:
            fine &= np.minimum(size[i : i + tile, None], size) >= similarity * np.maximum(size[i : i + tile, None], size) - 1e-9
        x, y = np.nonzero(fine)
        if band and len(x) and keys is not None:
            before = (keys[x + i, :band] == keys[y, :band]).any(1)
            x, y = x[~before], y[~before]
        found.append((agree[x, y], x + i, y))
    agree, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    head: dict[int, int] = {}

    def root(c: int) -> int:
        while head.get(c, c) != c:
            c = head[c]
        return c

    links = []
    for k in np.argsort(-agree, kind="stable"):
        a, b = root(int(classes[x[k]])), root(int(classes[y[k]]))
        if a != b and probability_jaccard(sets[x[k]], sets[y[k]]) >= similarity - 1e-12:
            head[max(a, b)] = min(a, b)
            links.append((int(nodes[x[k]]), int(nodes[y[k]])))
    return links


def components(links: DataFrame) -> DataFrame:
    """(_id, _class) for all ends of links (_a, _b): the smallest id of its connected component.

    Each round takes the smallest class among the neighbours, then the class of that class; long chains halve.
    """
    both = checkpointed(links.select("_a", "_b").unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct())
    state = checkpointed(both.groupBy("_a").agg(F.min("_b").alias("_m")).select(F.col("_a").alias("_id"), F.least("_a", "_m").alias("_class")))
    while True:
        offered = both.join(state.select(F.col("_id").alias("_b"), "_class"), "_b").groupBy("_a").agg(F.min("_class").alias("_offer"))
        lower = state.join(offered, F.col("_id") == F.col("_a")).select("_id", F.col("_class").alias("_old"), F.least("_class", "_offer").alias("_new"))
        jump = state.select(F.col("_id").alias("_new"), F.col("_class").alias("_further"))
        moved = checkpointed(lower.join(jump, "_new", "left").select("_id", "_old", F.least("_new", "_further").alias("_class")))
        state = moved.select("_id", "_class")
        if moved.filter("_class <> _old").isEmpty():
            return state


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, weights: str = "count", bands: int = BANDS, rows: int = ROWS, deviations: float | None = 5.0) -> DataFrame:
    """(id, class_id, copies, class_size, component, text_hash) for every row: class_id is the smallest id of its class,
    copies the rows with the same weighted shingles as this one, class_size the rows of the class, component a number
    of the class in this run (other than class_id it tells classes apart whose ids meet), text_hash xxhash64(text).

    Words are runs of letters, digits and underscores in lower case; a shingle weighs as often as it occurs ("count") or
    1 ("set"). A text of fewer than `words` words is one shingle. Texts without words, the empty one included, are in a
    class with their exact copies; a null text is in a class of its own, without a component; rows with a null id get
    nulls. Rows that share an id but differ in text are different documents. With 48 bands of 7 registers a pair at 0.8
    is missed with probability 1.2e-5 in its own right, and mostly joined through others then. Where a bucket's nodes
    all meet, a pair whose estimate is `deviations` under the threshold is not computed (None: all are).
    """
    bounded_batches(documents.sparkSession)
    signed = written(_signed(documents, id_col, text_col, words, weights, bands, rows), "signed")
    known = signed.filter("_id is not null and _key is not null")
    # One node for each group of equal shingles, numbered when it is written. Partial aggregation leaves a row for each
    # group and task, so a group of a third of all rows never meets in one place.
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in ("_sig", "_bands")]  # the same in all rows of a group
    groups = known.groupBy("_key").agg(F.min(F.struct("_id", "_hash")).alias("_one"), F.count("*").alias("_copies"), *firsts)
    groups = written(groups.withColumn("_node", F.monotonically_increasing_id()), "groups")
    buckets = written(groups.filter(F.col("_bands").isNotNull()).select("_node", F.posexplode("_bands").alias("_band", "_bucket")), "buckets")
    hubs = checkpointed(buckets.groupBy("_bucket").agg(F.min("_node").alias("_hub"), F.max("_node").alias("_last")).filter("_hub < _last").drop("_last"))
    crowded = written(buckets.join(hubs, "_bucket").filter("_node <> _hub"), "crowded")
    stars = checkpointed(crowded.select(F.col("_hub").alias("_a"), F.col("_node").alias("_b")).distinct())
    texts = documents.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text")).filter("_id is not null and _text is not null")
    candidates = groups.select("_node", "_sig", "_bands", "_one.*").join(stars.select(F.explode(F.array("_a", "_b")).alias("_node")).distinct(), "_node", "left_semi")
    sketches = _sketches(candidates, texts, words, weights)
    links = checkpointed(_verified(stars, sketches, similarity))
    classes = components(links)

    # What one star cannot see: nodes of different components that meet in a bucket away from its hub.
    met = crowded.join(classes, F.col("_node") == F.col("_id"), "left").select("_bucket", "_band", "_node", F.coalesce("_class", "_node").alias("_c"))
    mixed = met.groupBy("_bucket").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).filter("_lo < _hi").drop("_lo", "_hi")
    own = F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = met.join(checkpointed(mixed), "_bucket").withColumn("_own", own).withColumn("_other", other)
    dealt = dealt.select("_bucket", "_band", "_node", "_c", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("_block"))

    def join(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_node", kind="stable")
        sig = np.frombuffer(b"".join(g["_sig"]), np.uint8).reshape(len(g), -1)
        keys = np.frombuffer(b"".join(g["_keys"]), np.uint64).reshape(len(g), -1)
        found = joining_links(g["_node"].to_numpy(), g["_c"].to_numpy(), g["_block"].to_numpy(), sig, [_shingles(x, w) for x, w in zip(g["_set"], g["_weights"], strict=True)], int(g["_band"].iloc[0]), rows, similarity, weights == "set", keys, deviations)
        return pd.DataFrame(found, columns=["_a", "_b"])

    more = checkpointed(dealt.join(sketches, "_node").groupBy("_bucket", "_i", "_j").applyInPandas(join, "_a long, _b long").distinct())
    if not more.isEmpty():
        classes = components(links.unionByName(more))

    ends = classes.select(F.col("_id").alias("_end"), "_class")
    members = groups.select("_key", "_node", "_copies", "_one._id").join(ends, F.col("_node") == F.col("_end"), "left").withColumn("_linked", F.col("_class").isNotNull())
    named = written(members.select("_key", "_node", "_copies", "_id", "_linked", F.coalesce("_class", "_node").alias("_class")), "classes")
    # Only classes of several nodes need sums; each has SALTS copies, so that the nodes of a large class meet its sums in
    # many tasks.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    sizes = named.filter("_linked").groupBy("_class").agg(F.sum("_copies").alias("_size"), F.min("_id").alias("_least")).select("*", salts)
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("_node"), F.lit(SALTS)).cast("int")).join(sizes, ["_class", "_salt"], "left")
    named = written(salted.select("_key", "_class", "_copies", F.coalesce("_size", "_copies").alias("_size"), F.coalesce("_least", "_id").alias("_least")), "named")
    rows_out = signed.select("_id", "_hash", "_key").join(named, "_key", "left")
    known_id = F.col("_id").isNotNull()
    return rows_out.select(
        F.col("_id").alias(id_col), F.when(known_id, F.coalesce("_least", "_id")).alias("class_id"), F.when(known_id, F.coalesce("_copies", F.lit(1))).alias("copies"),
        F.when(known_id, F.coalesce("_size", F.lit(1))).alias("class_size"), F.when(known_id, F.col("_class")).alias("component"), F.col("_hash").alias("text_hash"),
    )


def one_of_each_class(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of documents that stay when one document of each class does: the one of the smallest id, then text hash.

    Of rows equal in id and text one stays. Rows with a null id or text are in no class and all stay.
    """
    classes = near_duplicates(documents, id_col=id_col, text_col=text_col, **options)
    heads = classes.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct(id_col, "text_hash")).alias("_head")).select("_head.*")
    head_id, head_hash, own_hash = free_names(documents, "head_id", "head_hash", "own_hash")
    hashed = documents.withColumn(own_hash, F.xxhash64(text_col))
    fits = (F.col(id_col) == F.col(head_id)) & (F.col(own_hash) == F.col(head_hash))
    kept = hashed.filter(F.col(text_col).isNotNull()).join(heads.toDF(head_id, head_hash), fits, "left_semi").dropDuplicates([id_col, own_hash])
    return kept.unionByName(hashed.filter(F.col(id_col).isNull() | F.col(text_col).isNull())).drop(own_hash)
