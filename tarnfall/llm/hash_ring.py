"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of cells; every virtual node of a shard sits on a cell, and a key belongs to the shard of
the next virtual node clockwise from its cell. A shard that has reached its capacity passes the key on clockwise to the
next shard with room. With ``slack`` 0 the capacities are the row count dealt out evenly, so counts differ by one at most.

What decides an overflow is the number of rows in each cell: those counts (as many as there are cells, a parameter, at
any size of the table) go to the driver, which deals ranges of ranks in a cell to shards and slots. Rows find their
range by their rank in the cell, a window over the keys of one cell. Equal rows are counted before the shuffle and
unfolded at the end, so that a row repeated any number of times is one key.

Defined results: a null text has size 1 and CRC 0; null and repeated ids are keys like any other, the key being id, CRC
and size together. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfall.llm.shared import saved, unfolded


def ring(shards: int, replicas: int, cells: int) -> list[list[int]]:
    """Of each cell the shards in the order in which a key meets them clockwise."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(replicas):
            cell = int.from_bytes(hashlib.sha256(f"{shard}/{replica}".encode()).digest()[:8], "big") % cells
            nodes.setdefault(cell, shard)
    out: list[list[int]] = [[]] * cells
    met: list[int] = []
    for cell in range(2 * cells - 1, -1, -1):  # the second turn starts with what lies beyond the seam
        if (shard := nodes.get(cell % cells)) is not None:
            met = [shard, *(x for x in met if x != shard)]
        if cell < cells:
            out[cell] = met
    return [[*order, *(s for s in range(shards) if s not in order)] for order in out]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard takes at most."""
    if slack > 0:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def deal(counts: dict[int, int], shards: int, replicas: int, cells: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """Ranges (cell, from rank, to rank, shard, slot of the first), where full shards pass keys on clockwise."""
    free, slot = capacities(sum(counts.values()), shards, slack), [0] * shards
    orders, out = ring(shards, replicas, cells), []
    waiting = [(cell, 0) for cell in sorted(counts)]
    for turn in range(shards):
        beyond = []
        for cell, rank in waiting:
            shard = orders[cell][turn]
            if take := min(free[shard], counts[cell] - rank):
                out.append((cell, rank, rank + take, shard, slot[shard]))
                free[shard] -= take
                slot[shard] += take
            if rank + take < counts[cell]:
                beyond.append((cell, rank + take))
        waiting = beyond
    return out


def shard_rows(docs: DataFrame, shards: int = 8, replicas: int = 64, cells: int = 16384, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    names = ["doc_id", "size", "text_crc32"]
    keys = rows.groupBy(*names).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(*names)).withColumn("cell", F.pmod("h", F.lit(cells)).cast("int"))
    keys = saved(keys, "keys")
    counts = {r.cell: r.n for r in keys.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most `cells` rows
    schema = "array<struct<cell: int, low: long, high: long, shard: int, first: long>>"
    dealt = json.dumps([dict(zip(("cell", "low", "high", "shard", "first"), x, strict=True)) for x in deal(counts, shards, replicas, cells, slack)])
    ranges = spark.range(1).select(F.inline(F.from_json(F.lit(dealt), schema)))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("h", *names).rowsBetween(Window.unboundedPreceding, -1))
    ranked = saved(keys.select(*names, "cell", "n", F.coalesce(before, F.lit(0)).alias("start")), "ranked")
    ranked = unfolded(ranked, "n", "copy").select(*names, "cell", (F.col("start") + F.col("copy")).alias("rank"))
    mine = (F.col("r.cell") == F.col("k.cell")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.alias("k").join(F.broadcast(ranges).alias("r"), mine).select(*names, "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"))
