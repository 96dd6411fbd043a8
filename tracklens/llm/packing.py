"""Mixture-controlled packing by deficit round-robin over source queues.

The queues are visited in rounds. In each round a queue's deficit grows by its quantum, its share of `length` tokens,
as many whole tokens as the deficit allows are served, and the fraction that is left is carried to the next round; an
empty queue is passed over. The served tokens, one after another, are cut into windows of `length`.

Deficits begin at half a token, so that rounding up and down evens out over the queues and a round has close to `length`
tokens. What a queue has been served before round w is therefore min(tokens, floor(w * quantum + 1/2)), and its
deficit is the fraction of w * quantum + 1/2: the deficits at any round are known without running through the rounds before it. So every
partition packs its own documents, and deficits carry across windows and partitions with nothing passed by hand.

Two passes: texts are tokenised once into a Parquet table in the shared folder, with each row's place in its
partition's share of its queue; the shares' sizes (a row for each partition and source) give all places in the queues.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, written

END_OF_DOCUMENT, QUEUES, RESOLUTION, BROADCAST_ROWS, BUCKETS, CELLS = 1, 256, 1 << 16, 200_000, 4096, 1_000_000
HALF = RESOLUTION // 2


class Encoder:
    """ids of byte-level BPE; the same as the tokenizers library gives for the JSON file of the same vocabulary."""

    def __init__(self, ranks_path: str, json_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        special = {"<|endoftext|>": max(ranks.values()) + 1}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.json_path, self.slow = json_path, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the pattern engine gives up on some very long runs, as an error or a Rust panic
            if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                raise
            from tokenizers import Tokenizer

            self.slow = self.slow or Tokenizer.from_file(self.json_path)
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def byte_bpe_encoder() -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


class Schedule:
    """Which token goes out when: quanta (in RESOLUTIONths of a token a round) and tokens of the queues."""

    def __init__(self, quanta, tokens, length: int):
        self.a, self.n, self.length = np.asarray(quanta, np.int64), np.asarray(tokens, np.int64), length
        self.done = -(-(self.n * RESOLUTION - HALF) // self.a)  # rounds after which a queue is empty

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """A row for each round: how many tokens of each queue go out before it."""
        return np.minimum(self.n, (np.minimum(rounds[:, None], self.done) * self.a + HALF) // RESOLUTION)

    def round_of(self, q: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The round in which token i of queue q goes out."""
        return -(-((i + 1) * RESOLUTION - HALF) // self.a[q]) - 1

    def turns(self, q: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queue q in a round: its first token, the token after its last, and the first one's place in the order."""
        out = np.zeros((3, len(q)), np.int64)
        step = max(1, CELLS // len(self.n))  # rounds whose turns are in memory at once
        for i in range(0, len(q), step):
            needed, at = np.unique(rounds[i : i + step], return_inverse=True)
            before, after = self.served(needed), self.served(needed + 1)
            place = before.sum(1)[:, None] + np.cumsum(after - before, axis=1) - (after - before)
            out[:, i : i + step] = [x[at, q[i : i + step]] for x in (before, after, place)]
        return out[0], out[1], out[2]

    def turns_of(self, q: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, round) of all turns in which some of the n tokens from `at` of queue q go out."""
        whole = self.a[q] >= RESOLUTION  # else at most a token a round, and rounds without one
        first = self.round_of(q, at)
        count = np.where(whole, self.round_of(q, at + n - 1) - first + 1, n)
        row = np.repeat(np.arange(len(q)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return row, np.where(whole[row], first[row] + step, self.round_of(q[row], at[row] + step))

    def position(self, q: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place in the whole order of token i of queue q."""
        first, _, place = self.turns(q, self.round_of(q, i))
        return place + i - first


def quanta(tokens: dict, targets: dict, length: int, rest: int = 0) -> list[int]:
    """A quantum for each source, and for the rest. Sources without a target divide what the targets leave by size."""
    if any(not 0 < t <= 1 for t in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets are positive shares that add up to 1 at most")
    free = max(sum(n for s, n in tokens.items() if s not in targets) + rest, 1)
    left = 1 - sum(targets.values())
    wanted = [targets[s] if s in targets else left * n / free for s, n in tokens.items()] + [left * rest / free] * (rest > 0)
    return [max(1, round(RESOLUTION * length * w)) for w in wanted]


def _tokenised(documents: DataFrame, id_col: str, text_col: str, source_col: str | None, make_encoder) -> DataFrame:
    """(id, source, name, part, local, n, ids): ids as little-endian 32-bit integers, local the tokens of that source
    before; name is the source's, never null."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = make_encoder(), TaskContext.get().partitionId(), {}
        end = np.array([END_OF_DOCUMENT], "<u4")
        for b in batches:
            ids = [encoder(t) if t else end[:0] for t in b["_text"].to_pylist()]
            n = [len(x) + 1 for x in ids]
            local = []
            for name, size in zip(b["_name"].to_pylist(), n, strict=True):
                local.append(before.get(name, 0))
                before[name] = local[-1] + size
            whole = np.concatenate([x for pair in zip(ids, [end] * len(ids), strict=True) for x in pair] or [end[:0]]).astype("<u4")
            data = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n) * 4]).astype(np.int32)), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([b["_id"], b["_source"], b["_name"], pa.array([part] * len(ids), pa.int32()), pa.array(local, pa.int64()), pa.array(n, pa.int64()), data], ["_id", "_source", "_name", "_part", "_local", "_n", "_ids"])

    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), source.alias("_source"), _name(source).alias("_name"))
    return rows.mapInArrow(encode, f"_id {documents.schema[id_col].dataType.simpleString()}, _source string, _name string, _part int, _local long, _n long, _ids binary")


def _name(source):
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def packed(documents: DataFrame, *, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", targets: dict[str | None, float] | None = None, queues: int = QUEUES, make_encoder=byte_bpe_encoder) -> DataFrame:
    """A row for each piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, source.

    targets: the share of a source in every window for as long as it lasts; those without one, like all by default,
    divide the rest by their sizes, and a target of a source that does not occur is shared by all that do. Targets
    that add up to 1 leave the other sources for the end. Every source with a target and the `queues` largest others
    have a queue of their own. All smaller ones, which own less than a few tokens of a window, share a queue in which
    documents take turns by how much of their source has gone before them, so that each source is served evenly there too.

    Every row is a document, repeated ones too; null and empty texts are the end mark alone; a null source is a source
    of its own (None in targets), as is an empty one. Only the last sequence can be short.
    """
    bounded_batches(documents.sparkSession)
    tokens = written(_tokenised(documents, id_col, text_col, source_col, make_encoder), "tokens")
    shares = checkpointed(tokens.groupBy("_name", "_part").agg(F.sum("_n").alias("_n")))
    sources = shares.groupBy("_name").agg(F.sum("_n").alias("_total"))
    wanted = {"null" if s is None else f"={s}": t for s, t in (targets or {}).items()}
    named = F.col("_name").isin(*wanted) if wanted else F.lit(False)
    own = {r["_name"]: r["_total"] for r in sources.filter(named).collect()}  # at most as many as there are targets
    own |= {r["_name"]: r["_total"] for r in sources.filter(~named).orderBy(F.desc("_total"), "_name").limit(queues).collect()}
    rest = (sources.agg(F.sum("_total")).first()[0] or 0) - sum(own.values())
    names, shared = list(own), len(own)
    schedule = Schedule(quanta(own, wanted, length, rest), [*own.values(), rest] if rest else list(own.values()), length)
    queue = F.coalesce(*[F.when(F.col("_name") == s, F.lit(k)) for k, s in enumerate(names)], F.lit(shared))
    order = Window.partitionBy("_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shares.withColumn("_queue", queue).select("_name", "_part", "_queue", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))
    bases = checkpointed(bases.join(sources, "_name") if rest else bases.withColumn("_total", F.lit(1)))
    if bases.count() <= BROADCAST_ROWS:  # else a plain join
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["_name", "_part"]).select("_id", "_source", "_name", "_queue", (F.col("_base") + F.col("_local")).alias("_at"), "_total", "_n", "_ids")
    if rest:
        own_queue = placed.filter(F.col("_queue") < shared)
        placed = own_queue.unionByName(_taking_turns(placed.filter(F.col("_queue") == shared)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _pieces(b, schedule)

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    pieces = placed.select("_id", "_source", "_queue", "_at", "_n", "_ids").mapInArrow(cut, schema)
    return pieces.select(F.col("_id").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset", F.col("_source").alias("source"))


def _taking_turns(rows: DataFrame) -> DataFrame:
    """rows of many small sources with _at, now the tokens before them in one queue: in the order of the share of their
    source that goes before them. That share, from 0 to 1 in every source, is cut into BUCKETS parts of like size."""
    due = F.col("_at") / F.col("_total")
    rows = rows.withColumn("_due", due).withColumn("_bucket", F.floor(F.col("_due") * BUCKETS).cast("int"))
    sizes = rows.groupBy("_bucket").agg(F.sum("_n").alias("_size"))  # at most BUCKETS rows
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = checkpointed(sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_bucket").orderBy("_due", "_name", "_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return placed.join(F.broadcast(sizes), "_bucket").withColumn("_at", F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside", "_due")


def _pieces(b: pa.RecordBatch, schedule: Schedule) -> pa.RecordBatch:
    q, at, n = (b[c].to_numpy().astype(np.int64) for c in ("_queue", "_at", "_n"))
    row, rounds = schedule.turns_of(q, at, n)
    turn, after, place = schedule.turns(q[row], rounds)
    begin, end = np.maximum(at[row], turn), np.minimum(at[row] + n[row], after)
    some = end > begin
    row, begin, end, place = row[some], begin[some], end[some], (place + begin - turn)[some]
    # Turns of one document that follow one another directly are one stretch; stretches are cut where windows end.
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + end[:-1] - begin[:-1])])[: len(row)]
    ends = np.concatenate([new[1:], [True]])[: len(row)]
    row, begin, end, place = row[new], begin[new], end[ends], place[new]
    window = place // schedule.length
    count = (place + end - begin - 1) // schedule.length - window + 1
    part = np.repeat(np.arange(len(row)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + window[part]
    left, right = np.maximum(place[part], window * schedule.length), np.minimum((place + end - begin)[part], (window + 1) * schedule.length)
    row, start, size = row[part], begin[part] + left - place[part] - at[row[part]], right - left
    # The pieces of a document lie one after another in its ids, so the ids' buffer only gets more cuts.
    ids = b["_ids"]
    cuts = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset :][0] + np.concatenate([[0], np.cumsum(size) * 4])
    data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts.astype(np.int32)), ids.buffers()[2]])
    rows = pa.array(row)
    return pa.RecordBatch.from_arrays([b["_id"].take(rows), b["_source"].take(rows), pa.array(start), pa.array(size), data, pa.array(n[row]), pa.array(window), pa.array(left - window * schedule.length)], ["_id", "_source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def ids_crc32(ids):
    """Unsigned crc32 of a binary column of ids."""
    return F.crc32(ids)


def crc32_of_ids(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
