"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is escaped as the model asks (blanks become U+2581) and cut into words where no piece can cross. The distinct
words of a batch are sorted by length and cut into groups of a bounded number of cells, and all words of a group advance
together, an end position at a time, each until its end: rolling hashes of all substrings that end there are probed in
the sorted hashes of the pieces, and each word's best predecessor is stored as a backpointer.

The best predecessor is a vectorised maximum. In a unigram model its value is the largest sum of scores. In a BPE
model sums of scores do not give the model's result, which is defined by merges; but the encoding of every prefix ends
in exactly one piece, the one that together with the last piece of what is before it is left alone by the merge rules,
so a predecessor has the value 0 where it is and minus infinity elsewhere. Whether two pieces are left alone is looked
up in a table; pairs met for the first time are merged together in numpy. Runs of blanks, whose pieces tie in score,
and words of over `LONG` characters are merged directly. A substring whose hash is a piece's without being it is seen
when the found pieces are compared with the word, which is then encoded without hashes.

Words and pairs met are kept within bounds by each Python worker, over all of its tasks.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SPACE, LONG, CACHE, PAIRS, CELLS, DIRECTORY = "▁", 512, 600_000, 2_000_000, 400_000, 18
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, UNKNOWN, BYTE = 1, 2, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOREIGN = 1 << 22  # added to the code point of a character that no piece is


class PieceModel:
    """Pieces, scores and kinds of a model, plain values that are shipped to the tasks (of the vocabulary's size)."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], *, unigram: bool, dummy_prefix: bool = True):
        self.pieces, self.unigram, self.dummy_prefix = pieces, unigram, dummy_prefix
        self.name = xxhash.xxh3_128_hexdigest(repr((pieces, scores, kinds, unigram, dummy_prefix)))
        self.kinds, self.scores = np.asarray(kinds), np.asarray(scores, np.float32)
        if len(pieces) > _FOREIGN:
            raise ValueError("too many pieces")
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, kinds, strict=True) if k == NORMAL):
            raise ValueError("pieces that go on after a blank are not supported")

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or kind not in (1, 2):
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], unigram=kind == 1, dummy_prefix=norm.add_dummy_prefix)


def _mixed(key: np.ndarray) -> np.ndarray:
    """Spreads rolling hashes, of which those of short substrings are alike in their first bits; one to one."""
    return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Codec:
    """Encodes and decodes batches with a PieceModel; words and pairs met are remembered within bounds."""

    def __init__(self, model: PieceModel):
        self.model = model
        normal = np.flatnonzero(model.kinds == NORMAL)
        self.by_piece = {model.pieces[i]: int(i) for i in normal}
        self.longest = max((len(p) for p in self.by_piece), default=1)
        self.unknown = int(np.flatnonzero(model.kinds == UNKNOWN)[0]) if (model.kinds == UNKNOWN).any() else 0
        self.byte_ids = {int(model.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(model.kinds == BYTE)}
        keys = _mixed(np.array([self._hash(p) for p in self.by_piece], np.uint64))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], normal[order].astype(np.int64)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        # Where the keys with given first bits begin: a search among the sorted keys starts there.
        self.first = np.searchsorted(self.keys, np.arange(1 << DIRECTORY, dtype=np.uint64) << np.uint64(64 - DIRECTORY))
        self.crowd = int(np.diff(np.append(self.first, len(keys))).max()) if len(keys) else 0
        self.keys, self.ids = np.append(self.keys, np.zeros(self.crowd + 1, np.uint64)), np.append(self.ids, np.full(self.crowd + 1, -1))
        self.powers = np.ones(self.longest + 1, np.uint64)
        for j in range(self.longest):
            self.powers[j + 1 :] = self.powers[j + 1 :] * _BASE
        self.lengths = np.array([len(p) for p in model.pieces], np.int64)
        self.points = np.zeros((len(model.pieces), self.longest), np.int64)
        for i in normal.tolist():
            self.points[i, : self.lengths[i]] = [ord(c) for c in model.pieces[i]]
        self.scores = np.append(model.scores, np.float32(min((model.scores[i] for i in normal), default=0.0) - 10.0))
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b"" if k != UNKNOWN else " ⁇ ".encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.words: dict[str, bytes] = {}  # ids as 32-bit integers
        self.pair_keys, self.pair_apart, self.pair_count = np.full(1 << 18, -1), np.zeros(1 << 18, bool), 0

    @staticmethod
    def _hash(text: str) -> np.uint64:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
        return np.uint64(h)

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        return _WORDS.findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.split(t) if isinstance(t, str) else [] for t in texts]
        if len(self.words) > CACHE:
            self.words = {}
        new = sorted(set().union(*split).difference(self.words), key=len, reverse=True)
        while new:  # the longest is the first, so that the words whose end is not reached are the first ones of a group
            step = max(1, CELLS // len(new[0]))
            self._encode_words(new[:step])
            new = new[step:]
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), np.int32) for words in split]

    def decode_bytes(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts and where each begins; starts says where each text's ids begin (one entry more)."""
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        data = self.raw[np.repeat(self.raw_at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[starts]
        if not self.model.dummy_prefix or not len(data):
            return data, at
        begin, end = at[:-1], at[1:]
        gone = begin[(end > begin) & (data[np.minimum(begin, len(data) - 1)] == 32)]  # the blank that was put before
        return np.delete(data, gone), at - np.searchsorted(gone, at)

    def decode_batch(self, sequences) -> list[str]:
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
        data, at = self.decode_bytes(np.concatenate([np.asarray(s, np.int64) for s in sequences] or [np.zeros(0, np.int64)]), starts)
        data = data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _encode_words(self, words: list[str]) -> None:
        """Encodes words in the order of their lengths, the longest first."""
        if not self.model.unigram:
            direct = [w for w in words if len(w) > LONG or SPACE * 2 in w]
            for w in direct:
                self.words[w] = self._ids(self.merged(w))
            words = [w for w in words if w not in self.words] if direct else words
            if not words:
                return
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.zeros((len(words), lengths[0]), np.int64)
        points[np.arange(lengths[0]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.ascontiguousarray(points.T)
        rows, tokens, starts = self._paths(*self._viterbi(points, lengths), lengths)
        wrong = self._not_spelled(points, rows, tokens, starts)
        begin = np.searchsorted(rows, np.arange(len(words) + 1))
        foreign = np.zeros(len(words), bool)
        foreign[rows[tokens >= _FOREIGN]] = True
        data, cuts = tokens.astype(np.int32).tobytes(), (begin * 4).tolist()
        for i, w in enumerate(words):
            self.words[w] = data[cuts[i] : cuts[i + 1]]
        for i in np.flatnonzero(foreign).tolist():
            self.words[words[i]] = self._ids(tokens[begin[i] : begin[i + 1]].tolist())
        for i in wrong:  # a substring with the hash of a piece that it is not
            self.words[words[i]] = self._ids(self._best_path(words[i]) if self.model.unigram else self.merged(words[i]))

    def _viterbi(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers and last tokens for every end position (rows) of every word (columns, the longest first).

        The value of ending a word's prefix with a piece is the best sum of scores in a unigram model; in a BPE model
        it is 0 if the merge rules leave the piece alone after the piece before it, else minus infinity, so there the
        first finite value is the maximum. All words take each maximum together.
        """
        length, n = points.shape
        going = np.searchsorted(-lengths, -np.arange(length + 1), side="right")  # words of at least that length
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + points[j].astype(np.uint64) + np.uint64(1)
        best = np.full((length + 1, n), -np.inf, np.float32)
        best[0] = 0
        back, last = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int64)
        for end in range(1, length + 1):
            open_ = np.arange(going[end])
            for start in range(max(0, end - self.longest), end):
                token = self._probe(prefix[end][open_] - prefix[start][open_] * self.powers[end - start])
                if end - start == 1:
                    token = np.where(token < 0, points[start][open_] + _FOREIGN, token)  # a character always has a token
                some = np.flatnonzero(token >= 0)
                rows, token = open_[some], token[some]
                if self.model.unigram:
                    value = best[start][rows] + self.scores[np.minimum(token, len(self.scores) - 1)]
                else:
                    value = np.where(self._stay_apart(last[start][rows], token), np.float32(0), np.float32(-np.inf))
                more = value > best[end][rows]
                rows = rows[more]
                best[end][rows], back[end][rows], last[end][rows] = value[more], start, token[more]
                if not self.model.unigram:
                    open_ = open_[best[end][open_] == -np.inf]
                    if not len(open_):
                        break
        return back, last

    def _paths(self, back: np.ndarray, last: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, token, start) of the tokens of all words, word after word: the backpointers followed together."""
        rows, at, found = np.arange(len(lengths)), lengths, []
        while len(rows):
            start = back[at, rows].astype(np.int64)
            found.append((rows, last[at, rows], start))
            rows, at = rows[start > 0], start[start > 0]
        rows, tokens, starts = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((starts, rows))
        return rows[order], tokens[order], starts[order]

    def _not_spelled(self, points, rows, tokens, starts) -> list[int]:
        """Words of which a token does not spell the substring it stands for."""
        known = np.flatnonzero(tokens < _FOREIGN)
        rows, tokens, starts = rows[known], tokens[known], starts[known]
        wrong = np.zeros(len(rows), bool)
        for j in range(self.longest):
            some = np.flatnonzero(self.lengths[tokens] > j)
            wrong[some] |= points[starts[some] + j, rows[some]] != self.points[tokens[some], j]
        return np.unique(rows[wrong]).tolist()

    def _probe(self, key: np.ndarray) -> np.ndarray:
        """Piece ids of substrings by their hashes, -1 for none: a look into the sorted keys of the pieces."""
        key = _mixed(key)
        at = self.first[(key >> np.uint64(64 - DIRECTORY)).astype(np.int64)]
        found = np.where(self.keys[at] == key, self.ids[at], -1)
        left = np.flatnonzero((found < 0) & (self.keys[at] < key))
        for step in range(1, self.crowd):
            if not len(left):
                break
            there = at[left] + step
            hit = self.keys[there] == key[left]
            found[left[hit]] = self.ids[there[hit]]
            left = left[self.keys[there] < key[left]]
        return found

    def _best_path(self, word: str) -> list[int]:
        """The unigram encoding of one word, with a dictionary in place of hashes."""
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        for end in range(1, len(word) + 1):
            choices = []
            for start in range(max(0, end - self.longest), end):
                token = self.by_piece.get(word[start:end], ord(word[start]) + _FOREIGN if end - start == 1 else None)
                if token is not None:
                    choices.append((best[start][0] + float(self.scores[min(token, len(self.scores) - 1)]), -start, token))
            value, start, token = max(choices)
            best.append((value, -start, token))
        found, end = [], len(word)
        while end:
            found.append(best[end][2])
            end = best[end][1]
        return found[::-1]

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of pieces a and b (a is -1 for none) gives just these two.

        Answers are kept in a table of hashed places; pairs met for the first time are merged together.
        """
        key = (a + 1 << 23) | b
        at = self._pair_places(key)
        if (new := self.pair_keys[at] != key).any():
            some = np.unique(key[new])
            apart = self._merged_pairs((some >> 23) - 1, some & ((1 << 23) - 1))
            if 2 * (self.pair_count + len(some)) > len(self.pair_keys):
                old, old_apart = self.pair_keys[self.pair_keys >= 0], self.pair_apart[self.pair_keys >= 0]
                if len(old) > PAIRS:
                    old, old_apart = old[:0], old_apart[:0]
                size = 1 << int(4 * (len(old) + len(some))).bit_length()
                self.pair_keys, self.pair_apart, self.pair_count = np.full(size, -1), np.zeros(size, bool), 0
                self._add_pairs(old, old_apart)
            self._add_pairs(some, apart)
            at = self._pair_places(key)
        return self.pair_apart[at]

    def _pair_places(self, key: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it would go."""
        bits = len(self.pair_keys).bit_length() - 1
        at = (key.astype(np.uint64) * _BASE >> np.uint64(64 - bits)).astype(np.int64)
        there = self.pair_keys[at]
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.pair_keys) - 1)
            there = self.pair_keys[at[left]]
            left = left[(there != key[left]) & (there >= 0)]
        return at

    def _add_pairs(self, keys: np.ndarray, apart: np.ndarray) -> None:
        while len(keys):  # of keys that want one place the first gets it in each round
            at = self._pair_places(keys)
            _, won = np.unique(at, return_index=True)
            self.pair_keys[at[won]], self.pair_apart[at[won]] = keys[won], apart[won]
            self.pair_count += len(won)
            keys, apart = np.delete(keys, won), np.delete(apart, won)

    def _merged_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether the merge rules, applied to the characters of both, end in just a and b.

        All pairs merge a step at a time: each takes its best adjacent couple, the leftmost on ties.
        """
        spell = lambda t: np.where((t >= _FOREIGN)[:, None], np.eye(1, self.longest, dtype=np.int64) * (t - _FOREIGN)[:, None], self.points[np.where((t < 0) | (t >= _FOREIGN), 0, t)] * (t >= 0)[:, None])
        size = lambda t: np.where(t < 0, 0, np.where(t >= _FOREIGN, 1, self.lengths[np.where((t < 0) | (t >= _FOREIGN), 0, t)]))
        na, nb = size(a), size(b)
        width = int((na + nb).max())
        points = np.zeros((len(a), width), np.int64)
        pa, pb = spell(a), spell(b)
        for j in range(min(self.longest, width)):
            some = np.flatnonzero(na > j)
            points[some, j] = pa[some, j]
            some = np.flatnonzero(nb > j)
            points[some, na[some] + j] = pb[some, j]
        count = na + nb
        key, length = points.astype(np.uint64) + np.uint64(1), np.where(np.arange(width) < count[:, None], 1, 0)
        active = np.flatnonzero(count > 1)
        powers = np.append(self.powers, np.zeros(2 * self.longest, np.uint64))
        while len(active) and width > 1:
            k, n = key[active], length[active]
            both = n[:, :-1] + n[:, 1:]
            fits = (n[:, 1:] > 0) & (both <= self.longest)
            token = np.full(both.shape, -1)
            token[fits] = self._probe((k[:, :-1] * powers[n[:, 1:]] + k[:, 1:])[fits])
            value = np.where(token >= 0, self.model.scores[np.maximum(token, 0)], -np.inf)
            pick = value.argmax(1)
            going = value[np.arange(len(active)), pick] > -np.inf
            active, pick, k, n = active[going], pick[going], k[going], n[going]
            rows, right = np.arange(len(active)), pick + 1
            k[rows, pick] = k[rows, pick] * powers[n[rows, right]] + k[rows, right]
            n[rows, pick] += n[rows, right]
            shift = np.arange(width) > pick[:, None]
            k, n = np.where(shift, np.roll(k, -1, 1), k), np.where(shift, np.roll(n, -1, 1), n)
            n[:, -1] = np.where(shift[:, -1], 0, n[:, -1])
            key[active], length[active] = k, n
            count[active] -= 1
        whole = np.where(a >= 0, 2, 1)
        return (count == whole) & (length[:, 0] == np.where(a >= 0, na, nb))

    def merged(self, text: str) -> list[int]:
        """BPE of one string: the adjacent pair whose piece has the best score is merged, the leftmost on ties."""
        parts, nxt, prev = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list = []

        def offer(i):
            if i >= 0 and nxt[i] < len(parts) and (p := self.by_piece.get(both := parts[i] + parts[nxt[i]])) is not None:
                heapq.heappush(heap, (-float(self.model.scores[p]), i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], nxt[i] = both, "", nxt[j]
            if nxt[j] < len(parts):
                prev[nxt[j]] = i
            offer(prev[i])
            offer(i)
        return [self.by_piece[p] if p in self.by_piece else ord(p) + _FOREIGN for p in parts if p]

    def _ids(self, tokens: list[int]) -> bytes:
        if max(tokens) >= _FOREIGN:
            out: list[int] = []
            for before, t in pairwise([-1, *tokens]):
                if t < _FOREIGN:
                    out.append(t)
                elif self.byte_ids:
                    out += [self.byte_ids[x] for x in chr(t - _FOREIGN).encode("utf-8", "surrogatepass")]
                elif before < _FOREIGN:
                    out.append(self.unknown)  # one for a run of unknown characters
            tokens = out
        return array("i", tokens).tobytes()


_codecs: dict[str, Codec] = {}  # of this process, by the model's name


def _codec(model: PieceModel) -> Codec:
    if model.name not in _codecs:
        _codecs.clear()
        _codecs[model.name] = Codec(model)
    return _codecs[model.name]


def encoded(documents: DataFrame, model: PieceModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for every row: its ids, and the text they give back.

    A null or empty text has no ids. The decoded text equals the original but for U+2581, which comes back as a blank.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            ids = codec.encode_batch(b["_text"].to_pylist())
            starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            data, at = codec.decode_bytes(flat.astype(np.int64), starts)
            decoded = pa.StringArray.from_buffers(len(ids), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([b["_id"], pa.ListArray.from_arrays(starts, flat), decoded], ["_id", "ids", "decoded"])

    bounded_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(encode, f"_id {kind}, ids array<int>, decoded string")
    return rows.select(F.col("_id").alias(id_col), "ids", "decoded")
