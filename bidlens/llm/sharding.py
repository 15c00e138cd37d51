"""Placement of rows on shards by a lookup table that the shards fill in turns.

Each shard has a permutation of the slots of a prime-sized table, its preference order. In turns, each claims the
first slot of its order that is free, until the table is full. A row's key is hashed to a slot; the slot names the
shard. Shares differ by one slot at most, and adding or taking away a shard moves few other slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.text import packed, unpacked

#: A prime. The table has as many rows of two integers whatever the data, so it can be broadcast.
SLOTS = 65_537
ROWS_PER_FILE = 1_000_000
SHARDS = tuple(f"shard-{i:03d}" for i in range(96))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot. ``slots`` must be a prime of at least the number of shards."""
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, not below the number of shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    start = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    turn = [0] * len(shards)
    owner = [-1] * slots
    left = slots
    while True:
        for k in range(len(shards)):
            while owner[at := (start[k] + turn[k] * step[k]) % slots] >= 0:
                turn[k] += 1
            owner[at] = k
            turn[k] += 1
            left -= 1
            if not left:
                return owner


def lookup(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The table: slot, shard_index, shard."""
    names = spark.createDataFrame(list(enumerate(shards)), "shard_index int, shard string")
    table = spark.createDataFrame(list(enumerate(fill(shards, slots))), "slot int, shard_index int")
    return table.join(F.broadcast(names), "shard_index").select("slot", "shard_index", "shard")


def slot_of(*keys: str | Column, slots: int = SLOTS) -> Column:
    """The slot of a key; null parts count, too, and have a place of their own."""
    parts = [x for k in keys for c in [F.col(k) if isinstance(k, str) else k] for x in (c.isNull(), c)]
    return F.pmod(F.xxhash64(*parts), F.lit(slots)).cast("int")


def place(rows: DataFrame, keys: Sequence[str], shards: Sequence[str] = SHARDS, slots: int = SLOTS, out: str = "shard") -> DataFrame:
    """``rows`` with their shard, by one broadcast of the table; nothing is shuffled.

    A null key is a key like others. Equal keys, so repeated rows, share a shard: to spread a hot group, add a
    column that tells its rows apart to ``keys``. A column of the name ``out`` is replaced.
    """
    table = lookup(rows.sparkSession, shards, slots).select(F.col("slot").alias("_slot"), F.col("shard").alias("_shard"))
    rest = [c for c in rows.columns if c != out]
    keyed = rows.select(packed(rows, rest), slot_of(*keys, slots=slots).alias("_at"))
    return keyed.join(F.broadcast(table), F.col("_at") == F.col("_slot")).select(*unpacked(rest), F.col("_shard").alias(out))


def write(rows: DataFrame, keys: Sequence[str], path: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Parquet below ``path``, a folder for each shard, in files of about ``rows_per_file`` rows.

    A shard is written by as many tasks as its rows ask for, so one that has a third of all rows is no single task. Null
    keys, repeated rows and long texts are rows like others; an empty table makes no folder.
    """
    placed = place(rows, keys, shards, slots)
    files = placed.groupBy("shard").agg(F.count("*").alias("n")).select(F.col("shard").alias("_of"), F.ceil(F.col("n") / rows_per_file).cast("int").alias("_files")).collect()  # a row for each shard
    if not files:
        return
    of = placed.sparkSession.createDataFrame(files, "_of string, _files int")
    whole = [F.col(f"`{c}`") for c in placed.columns if not isinstance(placed.schema[c].dataType, T.MapType)]
    dealt = placed.join(F.broadcast(of), F.col("shard") == F.col("_of")).withColumn("_part", F.pmod(F.xxhash64(*whole), F.col("_files")).cast("int"))
    total = sum(r["_files"] for r in files)
    dealt.repartition(total, "shard", "_part").drop("_of", "_files", "_part").write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    placed = place(docs.withColumn("slot", slot_of("doc_id")), ["doc_id"])
    return placed.select("doc_id", "source", "slot", "shard")
