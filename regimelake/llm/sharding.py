"""Sharding by fixed virtual slots (operator 9): DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from .common import free_names, materialize, table

#: Virtual slots: fixed for good, as a record's slot never changes.
SLOTS = 8192

#: Rows of a virtual slot that one task numbers, unless a mean slot has more.
PER_TASK = 1 << 14

MAP = "version int, vslot int, shard int"


def _hash(text: Column) -> Column:
    """The first 32 bits of a text's md5, as other engines have them too."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A record's virtual slot: its key's hash. Null keys have the slot of the empty text."""
    return (_hash(F.coalesce(key.cast("string"), F.lit(""))) % slots).cast("int")


def write_version(slot_map: DataFrame, path: str) -> None:
    """Append a version of the map to the table at `path`; older versions stay as they are."""
    slot_map.selectExpr("cast(version as int) version", "cast(vslot as int) vslot", "cast(shard as int) shard").coalesce(1).write.mode("append").parquet(path)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, by default the latest."""
    versions = spark.read.schema(MAP).parquet(path)
    if version is None:
        return versions.join(F.broadcast(versions.agg(F.max("version").alias("version"))), "version", "left_semi")
    return versions.filter(F.col("version") == version)


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map (version, vslot, shard): the slots dealt out in turn."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def grow_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, with one more shard: each shard gives its share of slots to the new one, and no slot moves otherwise.

    The slots and the two shard counts decide alone. A map has SLOTS rows, whatever the records.
    """
    order = Window.partitionBy("shard").orderBy(_hash(F.concat_ws(":", "vslot", F.lit(shards))), "vslot")
    share = F.count(F.lit(1)).over(Window.partitionBy("shard")) / F.lit(shards + 1.0)
    # The fraction of a slot left over is carried by shard number, so that the new shard gets its whole share.
    give = F.floor((F.col("shard") + 1) * share) - F.floor(F.col("shard") * share)
    return slot_map.select((F.col("version") + 1).alias("version"), "vslot", F.when(F.row_number().over(order) <= give, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def rebalance_map(slot_map: DataFrame, slot_bytes: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version, edited for bytes: shards above (1 + tolerance) of the mean give slots to those below it.

    slot_bytes (vslot, bytes) are a table's sums by slot. Each overfull shard offers its smallest slots
    until it is at the mean; the offered bytes fill the shards' room in order, both as running sums.
    The work is on SLOTS rows.
    """
    m = slot_map.join(slot_bytes, "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    load = m.groupBy("shard").agg(F.sum("bytes").alias("load"))
    all_shards = slot_map.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(load, "shard", "left").withColumn("load", F.coalesce("load", F.lit(0)))
    mean = all_shards.agg(F.avg("load").alias("mean"))
    m = m.join(load, "shard").crossJoin(mean)  # one row
    inner = Window.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    offered = m.filter(F.col("load") > F.col("mean") * (1 + tolerance)).withColumn("sum", F.sum("bytes").over(inner)).filter(F.col("sum") <= F.col("load") - F.col("mean"))
    offered = offered.select("vslot", F.sum("bytes").over(Window.orderBy("vslot")).alias("at"))
    room = all_shards.crossJoin(mean).filter("load < mean").select(F.col("shard").alias("to"), F.sum(F.col("mean") - F.col("load")).over(Window.orderBy("shard")).alias("upto"), (F.col("mean") - F.col("load")).alias("free"))
    moved = offered.join(room, (F.col("at") > F.col("upto") - F.col("free")) & (F.col("at") <= F.col("upto"))).select("vslot", "to")
    return slot_map.join(moved, "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard"))


def slot_sums(records: DataFrame, size: str = "size", slot: str = "vslot") -> DataFrame:
    """(vslot, rows, bytes): SLOTS rows at most, summed in the map tasks first."""
    return records.groupBy(slot).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))


def shard(records: DataFrame, slot_map: DataFrame, key: str = "doc_id", size: str = "size", slots: int = SLOTS, per_task: int = PER_TASK) -> DataFrame:
    """Add vslot, slot_bytes (bytes of all the virtual slot's records), shard and slot (the record's place in its shard, gapless from 0).

    The key alone decides the shard; equal keys share one, null keys too, and repeated rows get places
    of their own. An empty table gives an empty one; no column's name is in the way but the four that are added.
    Sizes and keys are written once to the shared folder with the input partition they came from. Rows and
    bytes are summed by virtual slot; a slot of more than `per_task` rows, or four times the mean where that
    is more, is cut into parts by input partition, so many rows of one key are numbered by many tasks.
    Places come from the counts of the parts that lie before in the shard plus the place within the part.
    The map, the sums and the offsets have `slots` rows and one for each further part: a bound of twice
    `slots` where a part is four times the mean; they are broadcast.
    """
    part, salts, from_, place, offset, rows, n = free_names([*records.columns, "vslot", "slot_bytes", "shard", "slot"], "_part", "_salts", "_from", "_place", "_offset", "_rows", "_n")
    named = [c for c in records.columns if c.lower() not in ("vslot", "slot_bytes", "shard", "slot")]
    r = materialize(records.select(*named).withColumn("vslot", slot_of(F.col(key), slots)).withColumn(from_, F.spark_partition_id()))
    sums = materialize(r.groupBy("vslot").agg(F.count(F.lit(1)).alias(rows), F.sum(size).alias("slot_bytes")))
    limit = max(per_task, 4 * (sums.agg(F.sum(rows)).first()[0] or 0) // slots)
    cut = F.broadcast(sums.select("vslot", "slot_bytes", F.ceil(F.col(rows) / limit).cast("int").alias(salts)).join(F.broadcast(slot_map.select("vslot", "shard")), "vslot"))
    r = r.join(cut, "vslot").withColumn(part, F.pmod(F.col(from_), F.col(salts))).drop(from_, salts)
    before = Window.partitionBy("shard").orderBy("vslot", part).rowsBetween(Window.unboundedPreceding, -1)
    counts = r.groupBy("shard", "vslot", part).agg(F.count(F.lit(1)).alias(n)).select("vslot", part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    # Rows that agree in all columns may change places, which changes nothing.
    inside = Window.partitionBy("vslot", part).orderBy(key, *[c for c in named if c != key and _sortable(records, c)])
    placed = r.withColumn(place, F.row_number().over(inside) - 1).join(F.broadcast(counts), ["vslot", part])
    return placed.select(*named, "vslot", "slot_bytes", "shard", (F.col(offset) + F.col(place)).cast("long").alias("slot"))


def _sortable(records: DataFrame, name: str) -> bool:
    return records.schema[name].dataType.simpleString().split("<")[0] not in ("map", "variant")


def op9_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in 40 shards by their doc_id's slot; the map's next version has one shard more.

    The map is a stored table: version 1 is written, read and edited to version 2, and both are read from it.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    path = new_folder(spark, "slot-map")
    write_version(first_map(spark, shards), path)
    write_version(grow_map(read_version(spark, path), shards), path)
    now, grown = read_version(spark, path, 1), read_version(spark, path, 2).select("vslot", F.col("shard").alias("grown_shard"))
    out = shard(docs, now).join(F.broadcast(grown), "vslot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "vslot", "slot_bytes", F.lit(1).alias("map_version"))
