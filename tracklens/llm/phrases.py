"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are taken as UTF-8 bytes, a segment of about a megabyte at a time. A prefix polynomial over the bytes gives every
word's hash, a prefix polynomial over the words' hashes every n-gram's, each as one difference and one product; there
is no loop over words. Two such polynomials, of other bases and tables, give a fingerprint and a check.

An n-gram can only be frequent if both (n - 1)-grams in it are. So short fingerprints (32 bits, whose sums can only be
too large) are counted first, of words, then of pairs of words that can be frequent, and so on; which are frequent is
told to the tasks as a bitmap of fixed size. Where it fills up, more n-grams are counted than need be, and nothing is
lost. Whole fingerprints of what remains are then summed, with a pointer to where one of their n-grams stands: the smallest
corner, 8 bits of a hash of the row, of those that have it. The sums also keep the smallest and largest check; where these
differ, several phrases share the fingerprint. A last reading turns into text only frequent n-grams, in the rows that
their pointers lead to (and in all rows where several phrases share one: these are told apart and counted by their
text). So each frequent phrase is shuffled as text once or a few times, and no other ever is. Scores are then joins and
windows over the phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, mix, written

#: Bytes hashed together; rows a task's sums hold before equal ones are made one, and distinct ones it gives out.
SEGMENT, PENDING, FULL = 1 << 20, 2_000_000, 1_500_000
BITMAP, MOST = 1 << 27, (1 << 23) - 1  # bits: 16 MB, broadcast; the largest count of a row of sums
_ODD = np.uint64(0x9E3779B97F4A7C15)
NO_LANG = "und"
#: The bytes that end a piece, and the blanks between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)], _CLASS[list(ENDS)] = 1, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Two polynomials: a table of byte values, the bases over bytes and over words (odd, so that they have inverses).
_SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


@cache
def _lane(k: int) -> tuple[np.ndarray, int, int]:
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(_SEEDS[k]))
    bases = mix(np.arange(2, dtype=np.uint64) + np.uint64(_SEEDS[1 - k] >> 3)) | np.uint64(1)
    return table, int(bases[0]), int(bases[1])


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def _spans(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of values[start:end] for every pair, from one prefix polynomial."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=prefix[1:])
    inverse = pow(base, -1, 2**64)
    return (prefix[end] - prefix[start]) * _power(inverse, len(values) + 1)[start]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, starts and ends of words, and the number of each word's piece."""
    low = np.frombuffer(raw.translate(_LOWER), np.uint8)
    kind = _CLASS[low]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = kind == 0
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return low, start, end, np.searchsorted(np.flatnonzero(kind == 2), start)


def words_of(text: str) -> tuple[list[bytes], np.ndarray]:
    """A text's words in lower case, and the number of each word's piece."""
    low, start, end, piece = _words((text or "").encode())
    whole = low.tobytes()
    return [whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], piece


def _fingerprints(low, start, end, lane: int) -> list[np.ndarray]:
    """The hashes of all words."""
    table, base, _ = _lane(lane)
    return mix(_spans(table[low], base, start, end) + (end - start).astype(np.uint64))


def _segments(raw: bytes, longest: int) -> Iterator[tuple[int, int, bytes]]:
    """(words before, own words or -1 for all, bytes): a text in segments cut before a word, each with the longest - 1
    words that follow, so that every n-gram starts in one segment and is whole there."""
    if len(raw) <= SEGMENT:
        yield 0, -1, raw
        return
    _, start, _, _ = _words(raw)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(start, start[first] + SEGMENT)))
        stop = min(last + longest - 1, len(start))
        yield first, last - first, raw[start[first] : start[stop] if stop < len(start) else len(raw)]
        first = last


class _Counter:
    """Sums by fingerprint (and check) within a task, with the first of each one's other columns; parts are arrays
    (fingerprint, check, others, count)."""

    def __init__(self, cornered: bool = False):
        self.parts, self.rows, self.distinct, self.cornered = [], 0, 0, cornered

    def add(self, part: tuple[np.ndarray, ...]) -> None:
        self.parts.append(part)
        self.rows += len(part[0])
        if self.rows > PENDING:
            self._merge()
            self.distinct = self.rows

    def _merge(self) -> None:
        fp, check, *rest, count = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        drop = np.uint8(8 if self.cornered else 0)
        order = np.argsort(fp)
        a, b = fp[order], check[order] >> drop
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # a collision
            order = np.lexsort((check, fp))
            a, b = fp[order], check[order] >> drop
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        at, checks = order[new], np.minimum.reduceat(check[order], new)
        self.parts = [(a[new], checks, *(c[at] for c in rest), np.add.reduceat(count[order], new))]
        self.rows = len(new)

    def add_merged(self, part: tuple[np.ndarray, ...], smallest: bool = False) -> None:
        """add(), of a segment's rows, equal ones as one; smallest: of equal ones (but for a check's last 8 bits, the
        corner) the one of the smallest corner stands for all."""
        one = _Counter(self.cornered or smallest)
        self.cornered = one.cornered
        one.add(part)
        self.add(one.take())

    def full(self) -> bool:
        return self.distinct > FULL

    def take(self) -> tuple[np.ndarray, ...] | None:
        if not self.rows:
            return None
        self._merge()
        (out,), self.parts, self.rows, self.distinct = self.parts, [], 0, 0
        return out


class _Grams:
    """The n-grams of a segment that holds several texts' bytes."""

    def __init__(self, raws: list[bytes], keys: list[int], langs: list[int], own: list[int], tags: np.ndarray):
        self.low, self.start, self.end, self.piece = _words(b"\n".join(raws))
        ends = np.cumsum(np.array([len(r) + 1 for r in raws]))
        doc = np.searchsorted(ends, self.start, side="right")
        place = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(raws)))[doc]
        limit = np.array(own)[doc]
        self.mine = (limit < 0) | (place < limit)
        self.key, self.lang = np.array(keys, np.int64)[doc], np.array(langs, np.int32)[doc]
        self.corner = (self.key.view(np.uint64) >> np.uint64(56)).astype(np.uint8)
        self.tag, self.lanes = tags[self.lang], {}

    def hashes(self, n: int, at: np.ndarray, lane: int = 0) -> np.ndarray:
        if lane not in self.lanes:
            self.lanes[lane] = _fingerprints(self.low, self.start, self.end, lane)
        return mix(_spans(self.lanes[lane], _lane(lane)[2], at, at + n) + self.tag[at] + np.uint64(n))

    def phrases(self, n: int, at: np.ndarray) -> np.ndarray:
        """The n-grams' texts, words joined by a space."""
        low = self.low.tobytes()
        words = [[low[a:b] for a, b in zip(self.start[at + k].tolist(), self.end[at + k].tolist(), strict=True)] for k in range(n)]
        out = np.empty(len(at), object)
        out[:] = [b" ".join(w).decode() for w in zip(*words, strict=True)]
        return out

    def whole(self, n: int) -> np.ndarray:
        """The words at which an n-gram within a piece starts. (The byte between two texts ends a piece.)"""
        at = np.arange(len(self.start) - n + 1)
        return at[self.piece[at] == self.piece[at + n - 1]]

    def frequent(self, n: int, bitmaps: list[np.ndarray], keep: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(starts, fingerprints) of the n-grams whose parts of each shorter length with a bitmap are all marked in it,
        and who are marked themselves if there is one for n."""
        at, fp = self.whole(n), None
        for m in range(1, min(n, len(bitmaps)) + 1):
            fp = self.hashes(m, at) & keep
            good = _marked(fp, bitmaps[m - 1])
            for skip in range(1, n - m + 1):
                good[good] = _marked(self.hashes(m, at[good] + skip) & keep, bitmaps[m - 1])
            at, fp = at[good], fp[good]
        return at, fp if n <= len(bitmaps) else self.hashes(n, at) & keep


def _marked(fp: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = fp & np.uint64(BITMAP - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _bitmap(fingerprints: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP bits, those of the column _fp marked. Its size is fixed, and so is what the driver gets: a
    row for each 64 bits at most."""
    bit = F.col("_fp").bitwiseAND(BITMAP - 1)
    words = fingerprints.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_fp & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _read(rows: DataFrame, longest: int, work, schema: str) -> DataFrame:
    """work(grams, names) -> None for each segment of rows (_key, _lang, _text), and work(None, names) at the end or
    after any segment gives what it has for the output: a list of record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, step = {}, work()
        waiting, size = [[], [], [], []], 0
        for batch in batches:
            for key, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = names.setdefault(lang, len(names))
                for _, own, raw in _segments(text.encode(), longest):
                    for column, x in zip(waiting, (raw, key, at, own), strict=True):
                        column.append(x)
                    size += len(raw) + 1
                    if size >= SEGMENT:
                        yield from step(_Grams(*waiting, _tags(names)), names)
                        waiting, size = [[], [], [], []], 0
        if size:
            yield from step(_Grams(*waiting, _tags(names)), names)
        yield from step(None, names)

    return rows.mapInArrow(run, schema)


def _slices(columns: dict) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict(columns)
    for i in range(0, whole.num_rows, 100_000):
        yield whole.slice(i, 100_000)


def _bucket_counts(rows: DataFrame, n: int, longest: int, bitmaps, keep: int) -> DataFrame:
    """(_fp, _count): the tasks' counts of 32 bits of the fingerprints of n-grams whose shorter parts can be frequent."""

    def work():
        sums = _Counter()

        def step(grams: _Grams | None, names: dict):
            if grams is not None:
                at, fp = grams.frequent(n, [b.value for b in bitmaps], np.uint64(keep))
                fp = fp[grams.mine[at]].astype(np.uint32)
                if len(fp):
                    sums.add_merged((fp, np.zeros(len(fp), np.int8), np.ones(len(fp), np.int64)))
            if (grams is None or sums.full()) and (found := sums.take()) is not None:
                yield from _slices({"_fp": found[0].view(np.int32), "_count": found[2]})

        return step

    return _read(rows, longest, work, "_fp int, _count long")


def _sums(rows: DataFrame, longest: int, bitmaps, keep: int) -> DataFrame:
    """(_fp, _mark, _lang): the tasks' counts of the fingerprints of all lengths that can be frequent. _mark has 23 bits
    of a count (larger ones take several rows), 32 of the check and 8 of the smallest key. Rows with a language and no
    fingerprint have the count of its words as _mark."""

    def work():
        sums, words = _Counter(), {}

        def step(grams: _Grams | None, names: dict):
            if grams is not None:
                for lang, count in zip(*np.unique(grams.lang[grams.mine], return_counts=True), strict=True):
                    words[int(lang)] = words.get(int(lang), 0) + int(count)
                for n in range(1, longest + 1):
                    at, fp = grams.frequent(n, [b.value for b in bitmaps], np.uint64(keep))
                    at, fp = at[grams.mine[at]], fp[grams.mine[at]]
                    if len(at):
                        mark = grams.hashes(n, at, 1) >> np.uint64(32) << np.uint64(8) | grams.corner[at].astype(np.uint64)
                        sums.add_merged((fp, mark, np.ones(len(at), np.int64)), smallest=True)
            if (grams is None or sums.full()) and (found := sums.take()) is not None:
                fp, mark, count = found
                while len(fp):
                    part = np.minimum(count, MOST)
                    packed = mark.view(np.int64) | part << 40
                    yield from _slices({"_fp": fp.view(np.int64), "_mark": packed, "_lang": pa.nulls(len(fp), pa.string())})
                    left = count > part
                    fp, mark, count = fp[left], mark[left], (count - part)[left]
            if grams is None and words:
                langs = list(names)
                yield from _slices({"_fp": pa.nulls(len(words), pa.int64()), "_mark": list(words.values()), "_lang": [langs[i] for i in words]})

        return step

    return _read(rows, longest, work, "_fp long, _mark long, _lang string")


def _materialised(rows: DataFrame, longest: int, bitmaps, corners, keep: int) -> DataFrame:
    """(_fp, _lang, _n, phrase, _count): the tasks' counts of n-grams in rows whose corner is marked with their
    fingerprint, as text."""

    def work():
        sums = _Counter()

        def step(grams: _Grams | None, names: dict):
            if grams is not None:
                for n in range(1, longest + 1):
                    at, fp = grams.frequent(n, [b.value for b in bitmaps], np.uint64(keep))
                    mine = grams.mine[at] & _marked(_cornered(fp, grams.corner[at]), corners.value)
                    at, fp = at[mine], fp[mine]
                    if len(at):
                        one = _Counter()
                        one.add((fp, grams.hashes(n, at, 1), grams.lang[at], at, np.ones(len(at), np.int64)))
                        fp, check, lang, at, count = one.take()
                        sums.add((fp, check, lang, np.full(len(at), n, np.int8), grams.phrases(n, at), count))
            if (grams is None or sums.full()) and (found := sums.take()) is not None:
                fp, _, lang, lengths, phrases, count = found
                langs = pa.DictionaryArray.from_arrays(pa.array(lang, pa.int32()), pa.array(list(names), pa.string())).cast(pa.string())
                yield from _slices({"_fp": fp.view(np.int64), "_lang": langs, "_n": lengths, "phrase": pa.array(phrases, pa.string()), "_count": count})

        return step

    return _read(rows, longest, work, "_fp long, _lang string, _n byte, phrase string, _count long")


def _cornered(fp: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """A hash of a fingerprint and 8 bits of a key."""
    return mix(fp + corner.astype(np.uint64) * _ODD)


def _corner_bitmap(sums: DataFrame) -> np.ndarray:
    """Marks each frequent fingerprint with the corner of the smallest key that has it, or with all corners where
    several phrases share it."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, low, high = (b[c].to_numpy().view(np.uint64) for c in ("_fp", "_low", "_high"))
            one = low >> np.uint64(8) == high >> np.uint64(8)
            shared = np.repeat(fp[~one], 256)
            found = [_cornered(fp[one], low[one] & np.uint64(255)), _cornered(shared, np.tile(np.arange(256), len(fp) - one.sum()))]
            yield from _slices({"_fp": np.concatenate(found).view(np.int64)})

    return _bitmap(sums.select("_fp", "_low", "_high").mapInArrow(marks, "_fp long"))


def _tags(names: dict[str, int]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)


def frequent_phrases(documents: DataFrame, *, least: int = 10, longest: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f), (lang, n)): all phrases of up to `longest` words that occur at least `least` times in
    a language, and the languages' word counts.

    A-Z are lower-cased, texts are split at . , ; : ! ? and line ends into pieces and those at blanks and tabs into
    words. Null texts are empty, a null language is `und`. Ids may be null or repeat. An empty table has no phrases.
    Very long texts are hashed a megabyte at a time. Rows that repeat count each time. bits: of the fingerprint, fewer
    for tests.
    """
    bounded_batches(documents.sparkSession)
    lang = F.coalesce(F.col(lang_col), F.lit(NO_LANG))
    text = F.col(text_col)
    rows = documents.filter(text.isNotNull()).select(F.xxhash64(F.col(id_col), lang, text).alias("_key"), lang.alias("_lang"), text.alias("_text"))
    context, keep, bitmaps = documents.sparkSession.sparkContext, (1 << bits) - 1, []
    often = F.col("f") >= least
    for n in range(1, longest + 1):
        counts = _bucket_counts(rows, n, longest, list(bitmaps), keep).groupBy("_fp").agg(F.sum("_count").alias("f"))
        bitmaps.append(context.broadcast(_bitmap(counts.filter(often))))
    # Dealt out before they are grouped: a partial aggregate would find nothing to add and send wider rows.
    check = F.col("_mark").bitwiseAND((1 << 40) - 1)
    count = F.when(F.col("_fp").isNull(), F.col("_mark")).otherwise(F.shiftright("_mark", 40))
    sums = _sums(rows, longest, bitmaps, keep).repartition("_fp").groupBy("_fp", "_lang").agg(F.sum(count).alias("f"), F.min(check).alias("_low"), F.max(check).alias("_high"))
    sums = written(sums.filter(F.col("_fp").isNull() | often), "phrase-sums")
    frequent = sums.filter("_fp is not null")
    texts = _materialised(rows, longest, bitmaps, context.broadcast(_corner_bitmap(frequent)), keep)
    texts = texts.groupBy("_fp", "_lang", "_n", "phrase").agg(F.sum("_count").alias("_seen"))
    f = F.when(F.shiftright("_low", 8) == F.shiftright("_high", 8), F.col("f")).otherwise(F.col("_seen"))
    found = texts.join(frequent.drop("_lang"), "_fp").withColumn("f", f).filter(often)
    return found.select(F.col("_lang").alias("lang"), F.col("_n").cast("int").alias("words"), "phrase", F.col("f")), sums.filter("_fp is null").select(F.col("_lang").alias("lang"), F.col("f").alias("n"))


def score_of(a: str, l: str, r: str) -> Column:
    """floor(1000000 * a * a / (l * r)) of three columns, in exact decimals of 38 digits."""
    return F.expr(f"1000000 * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")


def collocations(documents: DataFrame, *, least: int = 10, longest: int = 3, top: int = 2000, share: int = 50, **columns) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to `longest` words of each language.

    a is the phrase's count. Cut after its first k words it has the parts' counts l and r and the score floor(1000000 *
    a * a / (l * r)), in exact decimals; the cut of the lowest score counts, ties to the smallest k. A phrase goes where
    a longer candidate holds it and has at least `share` percent of its count. Order: score, then a, descending, then
    the phrase's bytes. Columns and edge cases as in frequent_phrases.
    """
    found, sizes = frequent_phrases(documents, least=least, longest=longest, **columns)
    found = written(found, "phrases")
    candidates = found.filter("words > 1").withColumn("_w", F.split("phrase", " ", -1))
    # All parts of a candidate are at least as frequent as it is, so their counts are in the same table.
    cut = candidates.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    left, right = F.array_join(F.slice("_w", F.lit(1), F.col("_k")), " "), F.array_join(F.slice("_w", F.col("_k") + 1, F.col("words") - F.col("_k")), " ")
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "_k", left.alias("_left"), right.alias("_right"))
    count_of = lambda part, name: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cut = cut.join(count_of("_left", "l"), ["lang", "_left"]).join(count_of("_right", "r"), ["lang", "_right"])
    scored = cut.withColumn("score", score_of("a", "l", "r"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "_k", "a", "l", "r")).alias("_best")).select("lang", "phrase", "_best.score", "_best.a", "_best.l", "_best.r")
    # What stands inside a longer candidate: its runs of words, each with the largest count of a longer one.
    inside = candidates.filter("words > 2").withColumn("_m", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_m") + 1)))
    inside = inside.groupBy("lang", F.array_join(F.slice("_w", F.col("_s"), F.col("_m")), " ").alias("phrase")).agg(F.max("f").alias("_longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
