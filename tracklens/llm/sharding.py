"""Sharding by fixed virtual slots, with DataFrame functions only.

A record is hashed into one of a fixed number of virtual slots, for ever. Bytes and rows are added up for each slot,
and a slot map, a versioned table of (version, vslot, shard), says where each slot lives. Version 1 deals the slots out
in turn; rebalancing appends a version in which as few slots have moved as the bytes require. Only the map is ever
edited, so placing a record is one hash and one lookup in a table whose size is fixed, whatever the corpus holds.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.sources.versioned import VersionedTable

from .common import shared_folder, written

SLOTS, SALTS = 4096, 16


def virtual_slot(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), *key), F.lit(slots)).cast("int")


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has none but the one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_sizes(parts: DataFrame, *, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) for all slots, empty ones included, of (vslot, size, rows): a table of `slots` rows."""
    used = parts.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.sum("rows").alias("rows"))
    every = parts.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(used, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


class SlotMap:
    """The stored map, a versioned table (vslot, shard) whose commits note the number of slots. A version is whole or
    absent, and of two who edit the same version one gets a Conflict."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots
        self.table = VersionedTable(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: the slots dealt out in turn."""
        out = cls(spark, path, slots)
        out._add(spark.range(slots).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard")), 0)
        return out

    def _add(self, version: DataFrame, on: int) -> None:
        self.table.commit(version.select("vslot", "shard"), on=on, files=1, notes={"slots": self.slots})  # `slots` rows

    def versions(self) -> DataFrame:
        """(version, vslot, shard) of all versions."""
        every = [self.table.read(v).select(F.lit(v).alias("version"), "vslot", "shard") for v in self.table.versions()]
        return reduce(DataFrame.unionByName, every)

    def latest(self) -> DataFrame:
        """(version, vslot, shard) of the newest version. A ValueError if it is a map of another number of slots: looking
        records up in it would lose those of slots that it has not."""
        version = self.table.version()
        stored = self.table.facts(version)["notes"].get("slots")
        if stored != self.slots:
            raise ValueError(f"the slot map at {self.path} has {stored} slots, not {self.slots}")
        return self.table.read(version).select(F.lit(version).alias("version"), "vslot", "shard")

    def rebalance(self, sizes: DataFrame, shards: int, tolerance: float = 0.001) -> None:
        """Adds a version in which the shards' bytes are near equal; none if they are already."""
        current, on = self.latest(), self.table.version()
        edited = written(edit(current, sizes, shards, tolerance), "map-edit")
        if not edited.join(current.select("vslot", F.col("shard").alias("was")), "vslot").filter("shard <> was").isEmpty():
            self._add(edited, on)

    def place(self, records: DataFrame) -> DataFrame:
        """records, which have vslot, with version and shard, by a lookup in a table of `slots` rows. A record of a slot
        that the map has not ends the job."""
        found = records.join(F.broadcast(self.latest()), "vslot", "left")
        known = F.when(F.col("shard").isNotNull(), F.col("shard")).otherwise(F.raise_error(F.concat(F.lit("no shard for slot "), F.col("vslot").cast("string"))).cast("int"))
        return found.withColumn("shard", known)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def edit(current: DataFrame, sizes: DataFrame, shards: int, tolerance: float = 0.001) -> DataFrame:
    """The version after `current` (version, vslot, shard), for `shards` shards: (version, vslot, shard).

    One slot at a time moves from the heaviest to the lightest shard, the one whose bytes come closest to half of their
    difference, until the difference is within `tolerance` of a shard's share or no slot lessens it. A shard that is
    new starts empty; one that goes first hands its slots to the others in turn. This is a fold over one row that holds
    the map, a fixed number of slots.
    """
    every = F.sort_array(F.collect_list(F.struct("vslot", "bytes", F.when(F.col("shard") < shards, F.col("shard")).otherwise(F.pmod("vslot", F.lit(shards))).cast("int").alias("shard"))))
    row = current.join(sizes, "vslot").groupBy().agg(F.max("version").alias("version"), F.count("*").cast("int").alias("slots"), every.alias("all"))
    row = row.select(
        "version", "slots", F.transform("all", lambda x: x["bytes"]).alias("bytes"), F.transform("all", lambda x: x["vslot"]).alias("vslots"), F.transform("all", lambda x: x["shard"]).alias("shard"),
        F.aggregate("all", F.array_repeat(F.lit(0).cast("bigint"), shards), lambda load, x: F.transform(load, lambda b, i: F.when(i == x["shard"], b + x["bytes"]).otherwise(b))).alias("load"),
    )
    total = F.aggregate("bytes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    enough = F.greatest(F.lit(1).cast("bigint"), (total / shards * tolerance).cast("bigint"))
    place = lambda array, value: F.array_position(array, value).cast("int") - 1
    start = F.struct(F.col("load"), F.col("shard"), F.lit(False).alias("done"))

    def move(state, _):
        load, shard = state["load"], state["shard"]
        high, low = F.array_max(load), F.array_min(load)
        ends = F.struct(place(load, high).alias("giver"), place(load, low).alias("taker"), (high - low).alias("gap"))
        stop = F.struct(load.alias("load"), shard.alias("shard"), F.lit(True).alias("done"))
        return F.when(state["done"], stop).otherwise(_let(ends, lambda e: F.when(e["gap"] <= enough, stop).otherwise(chosen(load, shard, e))))

    def chosen(load, shard, e):
        # How good each slot of the giver would be: the less it leaves of the difference the better.
        gains = F.zip_with(F.col("bytes"), shard, lambda b, s: F.when((s == e["giver"]) & (b > 0) & (b < e["gap"]), F.least(b, e["gap"] - b)).otherwise(F.lit(0).cast("bigint")))
        best = _let(gains, lambda g: _let(F.array_max(g), lambda most: F.struct((most > 0).alias("fine"), place(g, most).alias("slot"))))
        return _let(best, lambda m: _let(F.element_at(F.col("bytes"), m["slot"] + 1), lambda size: moved_by(load, shard, e, m, size)))

    def moved_by(load, shard, e, m, size):
        loads = F.transform(load, lambda b, i: F.when(m["fine"] & (i == e["giver"]), b - size).when(m["fine"] & (i == e["taker"]), b + size).otherwise(b))
        shards_now = F.transform(shard, lambda s, i: F.when(m["fine"] & (i == m["slot"]), e["taker"]).otherwise(s))
        return F.struct(loads.alias("load"), shards_now.alias("shard"), (~m["fine"]).alias("done"))

    moved = row.select("version", "vslots", F.aggregate(F.sequence(F.lit(1), F.col("slots")), start, move)["shard"].alias("shard"))
    pairs = moved.select("version", F.explode(F.arrays_zip("vslots", "shard")).alias("x"))
    return pairs.select((F.col("version") + 1).alias("version"), F.col("x.vslots").alias("vslot"), F.col("x.shard").alias("shard"))


def shard_documents(documents: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, vslot, version, shard, slot) for every row, by law `bytes`.

    The map is read from map_path, made there if there is none, and rebalanced for these documents; without a path it
    is stored in the shared folder. A map of another number of slots is a ValueError. A record is hashed by id and text, so rows that share an id (or have none) are
    spread; only rows equal in both stay together. slot is the row's place in its shard, gapless from 0: virtual slots
    one after another, each in SALTS parts by the partition the row was read in, so that no slot is sorted in one task.
    Rows that repeat get a place each. An empty table gives no rows. Texts are read once, for a narrow stored table.
    """
    spark, text = documents.sparkSession, F.col(text_col)
    rows = documents.select(
        F.col(id_col).alias("_id"), record_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(F.col(id_col), text, slots=slots).alias("vslot"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"),
    )
    rows = written(rows, "records")
    parts = written(rows.groupBy("vslot", "_salt").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "slot-parts")  # SALTS rows a slot at most
    sizes = written(slot_sizes(parts, slots=slots), "slot-sizes")
    slot_map = _stored_map(spark, map_path, shards, slots)
    slot_map.rebalance(sizes, shards)
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot", "_salt").rowsBetween(Window.unboundedPreceding, -1))  # over the parts
    offsets = slot_map.place(parts).select("vslot", "_salt", "version", "shard", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("vslot", "_salt").orderBy("_id", "text_crc32", "size")
    numbered = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    placed = numbered.join(F.broadcast(offsets), ["vslot", "_salt"])  # SALTS rows a slot at most
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "vslot", "version", "shard", (F.col("_before") + F.col("_inside")).cast("long").alias("slot"))


def _stored_map(spark: SparkSession, path: str | None, shards: int, slots: int) -> SlotMap:
    if path is None:
        path = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    found = SlotMap(spark, path, slots)
    return found if found.table.version() else SlotMap.create(spark, path, shards=shards, slots=slots)
