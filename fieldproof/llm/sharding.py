"""Sharding over fixed virtual slots.

A record's hash decides its virtual slot, for ever. Bytes are added up per slot, and a small versioned table says which
shard holds each slot. Version 1 deals slots out in turn; rebalancing edits the table: each shard keeps its heaviest
slots up to an equal share, and what is over goes, heaviest first, to the shard with the least bytes. Growing to more
shards is the same edit with a smaller share. Everything is DataFrame and SQL functions; the table has a row per slot.

The table is kept between runs with :func:`save_map` and given back with :func:`load_map`: only what the bytes of the
day ask for moves then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

SLOTS = 4096
OVERHEAD = 16


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) per row; a null text has no bytes."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return narrow.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) for every slot, empty ones included."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the table (version, virtual_slot, shard, bytes, rows): slots dealt out in turn."""
    return loads.select(F.lit(1).alias("version"), "virtual_slot", F.pmod("virtual_slot", F.lit(shards)).cast("int").alias("shard"), "bytes", "rows")


def save_map(table: DataFrame, path: str) -> None:
    """Add the versions of the table that the folder lacks; versions that are there stay as they are."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        last = spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
        table = table.where(F.col("version") > last)
    table.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(version, virtual_slot, shard) of a version, the last one if none is named."""
    every = spark.read.parquet(path).select("version", "virtual_slot", "shard")
    return every.where(F.col("version") == (every.agg(F.max("version")).first()[0] if version is None else version))


def with_loads(table: DataFrame, loads: DataFrame) -> DataFrame:
    """A table (version, virtual_slot, shard) with the bytes and rows that its slots hold now."""
    return table.select("version", "virtual_slot", "shard").join(loads, "virtual_slot").select("version", "virtual_slot", "shard", "bytes", "rows")


def rebalanced(table: DataFrame, shards: int) -> DataFrame:
    """The next version of the table for ``shards`` shards; slots move only where a shard has more than its share."""
    share = table.agg((F.sum("bytes") / shards).alias("share"))
    heaviest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    held = table.crossJoin(share).withColumn("stays", (F.sum("bytes").over(heaviest) <= F.col("share")) & (F.col("shard") < shards) & (F.col("bytes") > 0))
    load = held.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    # one row: the kept load of each shard, and the slots to place, heaviest first
    state = held.agg(F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot"))))).alias("moving")).crossJoin(
        load.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("kept")))
    start = f"transform(sequence(0, {shards - 1}), s -> coalesce(element_at(kept, s), 0L))"
    lightest = "cast(array_position(acc.loads, array_min(acc.loads)) as int) - 1"
    placed = state.select(F.expr(f"""explode(aggregate(moving,
        named_struct('loads', {start}, 'out', cast(array() as array<struct<virtual_slot: int, shard: int>>)),
        (acc, x) -> named_struct(
            'loads', transform(acc.loads, (b, i) -> if(i = {lightest}, b - x.less, b)),
            'out', concat(acc.out, array(named_struct('virtual_slot', x.virtual_slot, 'shard', {lightest})))),
        acc -> acc.out))""").alias("p")).select("p.*").withColumnRenamed("shard", "to")
    return held.join(placed, "virtual_slot", "left").select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").alias("shard"), "bytes", "rows")


def assign(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with shard and slot: the row's place in its shard, from 0 without gaps.

    Rows are numbered within their virtual slot and slots within their shard, so no task sees a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("_n", place).join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("start") + F.col("_n") - 1).drop("start", "_n")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 40, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot per row; the law is ``bytes``.

    Size is the text's UTF-8 bytes (none for null) plus 16. A row's virtual slot is a hash of its id and text, so copies
    of one text are spread like any other rows. Equal rows lie in one virtual slot, each at its own place; a null doc_id
    is hashed like any other value; an empty table gives an empty result. With ``map_path`` the slot-to-shard table of
    the last run there is where this one starts from, and its edited version is added there.
    """
    rows = stored(records(docs, id_col, text_col, slots), "records")
    loads = slot_loads(rows, slots)
    spark = docs.sparkSession
    known = None
    if map_path is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(map_path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            known = with_loads(load_map(spark, map_path), loads)
    start = first_map(loads, shards) if known is None else known
    table = stored(start.union(rebalanced(start, shards)), "slot-map", ("version",))
    if map_path is not None:
        save_map(table, map_path)
    out = assign(rows, table.where(F.col("version") == table.agg(F.max("version")).first()[0]))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
