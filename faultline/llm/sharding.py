"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import map_arrow

#: The multiplier of the jump hash's generator, and the two of the 64-bit finalizer that spreads keys.
JUMP_MULTIPLIER = 2862933555777941757
FINAL_1, FINAL_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Rows of a shard that one sort of the slot numbering holds, about.
ROWS_PER_RUN = 200_000


def spread(keys: np.ndarray) -> np.ndarray:
    """64-bit keys, well mixed (a bijection)."""
    x = keys.astype(np.int64, copy=False).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FINAL_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(FINAL_2)
    return x ^ (x >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: about ln(shards) rounds, no ring table; only keys that jump again go on."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state, out = spread(keys), np.zeros(len(keys), np.int64)
    left = np.arange(len(keys))
    while len(left):
        state[left] = s = state[left] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        step = (out[left] + 1) * (float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0))
        on = step < shards
        left = left[on]
        out[left] = step[on].astype(np.int64)
    return out


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds shard and grown_shard (with one more shard) from the integer key alone.

    A null key counts as the smallest integer. Equal keys share a shard. No shuffle: extra columns pass through, but
    for columns named shard or grown_shard, which are replaced.
    """
    rest = [c for c in df.columns if c not in ("shard", "grown_shard")]
    fields = [f for f in df.select(*rest).schema.fields]
    at = rest.index(key)

    def run(batches):
        for b in batches:
            k = b.column(at).cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(jump_hash(k, shards).astype(np.int32)), pa.array(jump_hash(k, shards + 1).astype(np.int32))],
                [*b.schema.names, "shard", "grown_shard"],
            )

    schema = df.select(*rest).schema
    schema = type(schema)(fields).add("shard", "integer").add("grown_shard", "integer")
    return df.select(*rest).mapInArrow(run, schema)


def number_slots(df: DataFrame, group: str, order: list, runs: int) -> DataFrame:
    """Adds slot: 0, 1, ... within each group, gapless, without a task that holds a whole group.

    The rows of a group are dealt by a hash of their order columns into `runs` runs; slots follow (run, order). The
    table of run sizes has groups times runs rows, which its parameters bound, and is broadcast.
    """
    dealt = df.withColumn("_run", F.pmod(F.xxhash64(*order), F.lit(runs)))
    sizes = dealt.groupBy(group, "_run").count()
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_run").orderBy(*order)
    return (
        dealt.withColumn("_nth", F.row_number().over(within))
        .join(F.broadcast(starts), [group, "_run"])
        .withColumn("slot", (F.col("_start") + F.col("_nth") - 1).cast("long"))
        .drop("_run", "_nth", "_start")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: its shard under the `key` law, size, checksum and place in the shard.

    doc_id and the shard count alone decide the shard; with one more shard a row stays or goes to the new one. A null
    text has size 8 and the checksum of no bytes (0); a null doc_id counts as the smallest integer; repeated rows
    share a shard and take slots of their own. Only numbers are shuffled, never texts. Extra columns are ignored.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    placed = assign_shards(slim, "doc_id", shards).withColumn("law", F.lit("key"))
    rows = docs.select(F.lit(1)).count()
    runs = max(1, -(-rows // (shards * ROWS_PER_RUN)))
    return number_slots(placed, "shard", ["doc_id", "text_crc32", "size"], runs).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
