"""Mixing sources to target weights in fixed-length blocks.

The words of a source form one stream (its documents in hash order), cut into blocks of equal length. Every output shard
draws its counts of source slots from a multinomial over what each source still owes, so the totals come out exactly.
A slot of a source is mapped to a block by a pseudorandom permutation of the block numbers, a new one for each pass over
the source, and slots are joined with blocks by number. A source's last slot is cut where its target is reached.

Offsets in a stream come from two levels of sums over hashed cells and a window inside each cell; no window holds a
whole source. Rows that repeat are counted before the shuffle and unfolded afterwards. Only one row for each source
reaches the driver, and the drawn counts: at most ``max_shards`` for each source.

Defined results: null and empty texts have size 0 and are never taken; the null source is the last one. Repeated rows
are each taken on their own. All draws come from the seed and the sources' sizes, so reruns agree. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfall.llm.representatives import text_keys
from tarnfall.llm.shared import saved, unfolded
from tarnfall.llm.textkernel import mix as scramble

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 32
KEY = ("doc_id", "source", "size", "one", "two")
UNFOLDED = 1 << 16


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 by swap-or-not rounds: each maps x to (k - x) mod n or leaves it, as a bit of
    the larger of both says; ``back`` inverts it."""
    x = x.astype(np.int64)
    keys = scramble(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key))
    for k in keys[::-1] if back else keys:
        other = (int(k % np.uint64(n)) - x) % n
        swap = scramble(np.maximum(x, other).astype(np.uint64) ^ k) & np.uint64(1)
        x = np.where(swap == 1, other, x)
    return x


def pass_key(seed: int, source: int, turn: int) -> int:
    return int(scramble(np.array([seed * 1_000_003 + source * 64 + turn]))[0])


def targets(sizes: list[int], weights: tuple[int, ...], share: float, most: float) -> list[float]:
    """Words due of each source: shares by weight of ``share`` times all words, none above ``most`` times the source;
    what is above is shared out again by weight among the rest."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), sorted(range(len(sizes)), key=lambda i: most * sizes[i] / w[i])
    total = sum(w)
    for i in open_:
        out[i] = min(most * sizes[i], left * w[i] / total if total else 0.0)
        left, total = left - out[i], total - w[i]
    return out


def draw(owed: list[int], seed: int, shard_slots: int, max_shards: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots): multinomial counts of each output shard over what the sources still owe."""
    rng, left = np.random.default_rng(seed), np.array(owed, np.int64)
    size, out, shard = max(shard_slots, -(-int(left.sum()) // max_shards)), [], 0
    while (total := int(left.sum())) > 0:
        counts = np.zeros_like(left)
        while (n := min(size, total) - int(counts.sum())) > 0:
            rest = left - counts
            counts += np.minimum(rng.multinomial(n, rest / rest.sum()), rest)
        out += [(shard, int(i), int(owed[i] - left[i]), int(counts[i])) for i in np.flatnonzero(counts)]
        left, shard = left - counts, shard + 1
    return out


def slot_plan(size: int, target: float, length: int, source: int, seed: int, most: float) -> tuple[int, int, int]:
    """(blocks, slots, words of the last slot) of a source whose words are taken up to its target."""
    goal = min(math.floor(target + 0.5), math.floor(most * size))
    if not goal:
        return -(-size // length), 0, 0
    blocks = -(-size // length)
    tail = size - (blocks - 1) * length
    turns, rest = divmod(goal, size)
    if not rest:
        turns, rest = turns - 1, size
    at = int(permute(np.array([blocks - 1]), blocks, pass_key(seed, source, turns), back=True)[0])  # where the short block comes
    words = lambda k: k * length - (length - tail) * (k > at)
    k = -(-rest // length) if rest <= at * length else max(at + 1, -(-(rest + length - tail) // length))
    last = rest - words(k - 1)
    return blocks, turns * blocks + k, last


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).cast("long")


class Mix:
    """A mix of a table of documents: its rows with their stream offsets, its sources, its slots."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, length: int = 512, seed: int = 7, shard_slots: int = 4096, max_shards: int = 4096):
        self.spark, self.length, self.seed = docs.sparkSession, length, seed
        rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *(c.alias(name[2:]) for name, c in text_keys().items()))
        rows = saved(rows.groupBy(*KEY).agg(F.count("*").alias("n")), "sizes")
        found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()  # a row for each source
        found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
        sizes = [r.source_size for r in found]
        due = targets(sizes, weights, share, most)
        self.plans = [slot_plan(s, t, length, i, seed, most) for i, (s, t) in enumerate(zip(sizes, due, strict=True))]
        self.drawn = draw([p[1] for p in self.plans], seed, shard_slots, max_shards)
        self.sizes = sizes
        table = [(r.source, i, r.source_size, float(t)) for i, (r, t) in enumerate(zip(found, due, strict=True))]
        self.sources = self.spark.createDataFrame(table, "source string, idx int, source_size long, target double")
        self.rows = self._placed(rows)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Every row (repeats unfolded) with idx, source_size, target and offset in its source's stream."""
        sources = (F.broadcast(self.sources) if len(self.sizes) <= 20_000 else self.sources).withColumnRenamed("source", "name")
        rows = rows.join(sources, rows["source"].eqNullSafe(F.col("name"))).drop("name")
        h = F.xxhash64("doc_id", "size", "one", "two")
        rows = rows.withColumn("h", h).withColumn("upper", F.pmod("h", F.lit(256)).cast("int")).withColumn("lower", F.pmod(F.shiftright("h", 8), F.lit(256)).cast("int"))
        cells = saved(rows.groupBy("idx", "upper", "lower").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "cells")
        before = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        uppers = cells.groupBy("idx", "upper").agg(F.sum("words").alias("words")).select("idx", "upper", before(Window.partitionBy("idx").orderBy("upper")).alias("base"))
        lowers = cells.select("idx", "upper", "lower", before(Window.partitionBy("idx", "upper").orderBy("lower")).alias("part"))
        starts = lowers.join(uppers, ["idx", "upper"]).select("idx", "upper", "lower", (F.col("base") + F.col("part")).alias("start"))
        inside = Window.partitionBy("idx", "upper", "lower").orderBy("h", *KEY).rowsBetween(Window.unboundedPreceding, -1)
        first = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
        placed = rows.join(starts, ["idx", "upper", "lower"]).withColumn("first", first)
        placed = placed.select(*KEY, "idx", "source_size", "target", "first", "n")
        if (rows.agg(F.max("n")).first()[0] or 0) > UNFOLDED:  # saved only for a row that one task should not unfold
            copies = unfolded(saved(placed, "placed"), "n", "copy", UNFOLDED)
        else:
            copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        return copies.withColumn("offset", F.col("first") + F.col("copy") * F.col("size")).drop("first", "n")

    def slots(self) -> DataFrame:
        """shard, idx, slot, turn, block, take: every slot with its block and the words taken of it from its start."""
        step = 1 << 16
        drawn = self.spark.createDataFrame(self.drawn, "shard int, idx int, first long, slots long")
        parts = drawn.select("shard", "idx", "first", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(step).cast("long"))).alias("at"))
        parts = parts.select("shard", "idx", (F.col("first") + F.col("at")).alias("first"), F.least(F.col("slots") - F.col("at"), F.lit(step)).alias("slots"))
        parts = parts.repartition(max(self.spark.sparkContext.defaultParallelism, len(self.drawn) // 64), "shard", "idx", "first")
        plans, sizes, length, seed = self.plans, self.sizes, self.length, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, idx, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    blocks, slots, last = plans[idx]
                    slot = np.arange(first, first + n)
                    turn, block = slot // blocks, slot % blocks
                    for t in range(int(turn[0]), int(turn[-1]) + 1):
                        block[turn == t] = permute(block[turn == t], blocks, pass_key(seed, idx, t))
                    take = np.where(block == blocks - 1, sizes[idx] - (blocks - 1) * length, length)
                    take[slot == slots - 1] = last
                    full = lambda v: pa.array(np.full(n, v, np.int32))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([full(shard), full(idx), pa.array(slot), pa.array(turn.astype(np.int32)), pa.array(block), pa.array(take.astype(np.int64))], names=["shard", "idx", "slot", "turn", "block", "take"])

        return parts.mapInArrow(run, "shard int, idx int, slot long, turn int, block long, take long")

    def pieces(self) -> DataFrame:
        """The rows' pieces by block: block, at (place in the block), from (place in the document), words."""
        size = F.lit(self.length).cast("long")
        blocks = F.sequence(F.expr(f"offset div {self.length}"), F.expr(f"(offset + size - 1) div {self.length}"))
        each = self.rows.where("size > 0").withColumn("block", F.explode(blocks))
        begin, end = F.greatest("offset", F.col("block") * size), F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * size)
        return each.withColumns({"at": begin - F.col("block") * size, "from": begin - F.col("offset"), "words": end - begin})

    def taken(self) -> DataFrame:
        """The pieces with the slots of their blocks: shard, slot, turn and the words taken, 0 where no slot takes the block."""
        # the slots grow out of a few drawn counts, whose size is all that the optimizer knows: without the hint it would broadcast them
        out = self.pieces().join(self.slots().hint("merge"), ["idx", "block"], "left")
        return out.withColumn("words", F.greatest(F.lit(0), F.least("words", F.coalesce("take", F.lit(0)) - F.col("at")))).drop("take", "at")

    def by_document(self) -> DataFrame:
        """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
        names = ["doc_id", "size", "source_size", "target"]
        some = self.taken().groupBy(*names, "idx", "offset").agg(F.sum("words").alias("taken")).select(*names, "taken")
        return some.unionByName(self.rows.where("size = 0").select(*names, F.lit(0).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, in the columns of ``docs``: for each pass that takes words of a document one row with these
    words; the text as it is where all are taken, else the taken words joined by spaces. ``n_chars`` follows the text."""
    mixed = Mix(docs, **options)
    pieces = F.array_sort(F.collect_list(F.struct("from", "words")))
    runs = mixed.taken().where("words > 0").groupBy(*KEY, "copy", "turn").agg(F.sum("words").alias("taken"), pieces.alias("runs"))
    runs = runs.select(*(F.col(c).alias(f"__mix_{c}") for c in (*KEY, "taken", "runs")))
    # two digests of all that tells rows apart, never null: texts are dealt out once for both the distinct and the join
    digest = lambda salt, *c: F.xxhash64(F.lit(salt), F.isnull(c[0]), c[0], F.isnull(c[1]), *c[1:])
    runs = runs.withColumns({f"__mix_{k}": digest(k, *(F.col(f"__mix_{c}") for c in KEY)) for k in ("left", "right")})
    own = ("doc_id", "source", "__mix_size", "__mix_one", "__mix_two")
    keyed = docs.withColumns({"__mix_size": word_count(F.col("text"))} | {f"__mix{name[1:]}": c for name, c in text_keys().items()}).where("__mix_size > 0")
    keyed = keyed.withColumns({f"__mix_{k}": digest(k, *map(F.col, own)) for k in ("left", "right")})
    keyed = keyed.drop("__mix_one", "__mix_two").dropDuplicates(["__mix_left", "__mix_right"])
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("__mix_runs", lambda r: F.slice(words, (r["from"] + 1).cast("int"), r["words"].cast("int")))), " ")
    text = F.when(F.col("__mix_taken") == F.col("__mix_size"), F.col("text")).otherwise(some)
    out = keyed.join(runs.select("__mix_left", "__mix_right", "__mix_taken", "__mix_runs"), ["__mix_left", "__mix_right"]).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
