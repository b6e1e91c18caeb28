"""Prefix tries of conversations: shared beginnings, what they hold, and what sharing them saves.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. Equal conversations
are merged first, so copies weigh nothing afterwards. The distinct sequences are dealt out by the digest of their first
turn, and each task builds its tries as nodes with a dictionary of children and sums them up by an iterative postorder.
A first turn under which more than ``max_turns`` turns lie is not given to one task: its sequences are dealt out again by
the next turn in which they differ (the turns that all of them share are one chain), and so on for what is still too
large. The nodes above such a split are put together from the sums of the tries below.

Turns travel as digests (16 bytes of SHA-256) with their text's size. A conversation is one row of these, 24 bytes a turn.
The conversations that end in a node are joined in id order, in ranges of ids, and hashed as a stream.

Defined results: rows without a conversation id take no part. A conversation with no turns ends in the root. Without
conversations there is no node. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfall.llm.shared import join_groups, saved

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NAMES = [x.split()[0] for x in NODE.split(", ")]
NO_ENDS = hashlib.sha256().hexdigest()


def digest(*values: Column) -> Column:
    """16 bytes of a hash of texts or bytes, each with its size before it."""
    parts = [x for v in values for x in (F.octet_length(v).cast("string").cast("binary"), F.lit(":").cast("binary"), v.cast("binary"))]
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and bytes of each turn. Turns come in their order, null first; of equal ones, by role
    and text. A null role or text is empty."""
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long")
    return turns.select("conv_id", place.alias("pos"), digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def sequences(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row of ``conv_id``, ``digests`` and ``sizes`` for each id, in the order of ``pos``; ids without turns have none."""
    marks = conv_ids.select("conv_id", F.lit(None).cast("struct<pos: bigint, digest: binary, bytes: bigint>").alias("t"))
    rows = turns.select("conv_id", F.struct("pos", "digest", "bytes").alias("t")).unionByName(marks)  # collecting leaves nulls out
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.bytes").alias("sizes"))


def ended(chunks: DataFrame) -> DataFrame:
    """The hash of each sequence's joined ids: seq, ends. chunks: seq, range, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            out = []
            for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if seq != last:
                    out += [(last, sha.hexdigest())] if last is not None else []
                    last, sha = seq, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["seq", "ends"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([sha.hexdigest()])], names=["seq", "ends"])

    return chunks.repartition("seq").sortWithinPartitions("seq", "range").select("seq", "ids").mapInArrow(run, "seq binary, ends string")


def distinct_sequences(own: DataFrame) -> DataFrame:
    """One row for each distinct sequence: its turns, how many conversations have it, the least of them, and the hash of all."""
    keyed = saved(own.withColumn("seq", digest(F.array_join(F.transform("digests", F.hex), ""))), "sequences")
    ranges = keyed.groupBy("seq", F.shiftright("conv_id", 12).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    merged = keyed.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("digests").alias("digests"), F.first("sizes").alias("sizes"))
    return merged.join(ended(ranges), "seq").drop("seq")


def forest(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the tries of some groups. A group's rows have one ``gid``, the top node's digest; ``top`` marks its node."""
    kids: list[dict[bytes, int]] = []
    n, conv, size, depth, parent, ends, up = [], [], [], [], [], [], []

    def node(own: int, own_depth: int, above: int) -> int:
        kids.append({})
        for column, value in ((n, 0), (conv, None), (size, own), (depth, own_depth), (parent, above), (ends, NO_ENDS), (up, None)):
            column.append(value)
        return len(kids) - 1

    tops: dict[bytes, int] = {}
    for r in rows.itertuples(index=False):
        at = tops.get(r.gid)
        if at is None:
            at = tops[r.gid] = node(int(r.size), int(r.depth), -1)
            up[at] = (r.parent, int(r.parent_conv))
        path = [at]
        for turn, own in zip(r.digests, r.sizes, strict=True):
            below = kids[at].get(turn)
            if below is None:
                below = kids[at][turn] = node(int(own), depth[at] + 1, at)
            path.append(at := below)
        for at in path:
            n[at] += r.n
            conv[at] = r.conv if conv[at] is None else min(conv[at], r.conv)
        ends[at] = r.ends
    leaves, spare = [0] * len(kids), [0] * len(kids)
    for top in tops.values():
        stack = [(top, False)]
        while stack:
            at, below_done = stack.pop()
            if below_done:
                leaves[at] = sum(leaves[k] for k in kids[at].values()) or 1
                spare[at] = (n[at] - 1) * size[at] + sum(spare[k] for k in kids[at].values())
            else:
                stack.append((at, True))
                stack.extend((k, False) for k in kids[at].values())
    above = [up[i][1] if p < 0 else conv[p] for i, p in enumerate(parent)]
    split = [x and x[0] for x in up]
    return pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": above, "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": spare, "ends_sha256": ends, "split": split})


def summed(rows: DataFrame) -> DataFrame:
    """The groups that are split: members, least member, children, the turns that all rows share, and who ends there."""
    of_group = rows.groupBy("gid").agg(
        F.first("parent").alias("parent"), F.first("parent_conv").alias("parent_conv"), F.first("depth").alias("depth"), F.first("size").alias("size"),
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum(1 + F.size("digests")).alias("turns"),
        F.min("digests").alias("least"), F.max("digests").alias("most"), F.min(F.struct("digests", "sizes", "ends")).alias("first"),
    )
    # what the least and the greatest sequence share is shared by all: the place of the first turn that differs, less one
    differs = "array_position(zip_with(least, most, (a, b) -> a <=> b), false)"
    told = of_group.withColumn("shared", F.expr(f"int(CASE WHEN {differs} > 0 THEN {differs} - 1 ELSE size(least) END)"))
    ends = F.when(F.size("least") == F.col("shared"), F.col("first.ends")).otherwise(F.lit(NO_ENDS))
    return told.select("gid", "parent", "parent_conv", "depth", "size", "n", "conv", "turns", "shared", F.slice("first.sizes", F.lit(1), F.col("shared")).alias("chain"), ends.alias("ends"))


def children(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of split groups, dealt out by the first turn that not all of their group share."""
    both = join_groups(rows.select("gid", "digests", "sizes", "n", "conv", "ends", F.col("depth").alias("above")), groups.select("gid", "shared", F.col("conv").alias("parent_conv"), "turns"), "gid", "turns")
    deeper = both.where(F.size("digests") > F.col("shared"))
    turn = F.element_at("digests", F.col("shared") + 1)
    rest = lambda c: F.slice(c, F.col("shared") + 2, F.greatest(F.lit(0), F.size(c) - F.col("shared") - 1))
    return deeper.select(
        digest(F.col("gid"), turn).alias("gid"), F.col("gid").alias("parent"), "parent_conv", (F.col("above") + F.col("shared") + 1).alias("depth"),
        F.element_at("sizes", F.col("shared") + 1).alias("size"), rest("digests").alias("digests"), rest("sizes").alias("sizes"), "n", "conv", "ends",
    )


def chains(groups: DataFrame, below: DataFrame) -> DataFrame:
    """Split groups with the sums of what lies below them, and those at their own top: ``n_leaves``, ``saved_tokens``."""
    sums = below.groupBy(F.col("split").alias("gid")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    own = (F.col("n") - 1) * F.aggregate("chain", F.col("size"), lambda a, b: a + b)
    return groups.join(sums, "gid", "left").withColumns(
        {"n_leaves": F.coalesce("n_leaves", F.lit(1)), "n_children": F.coalesce("n_children", F.lit(0)), "saved_tokens": F.coalesce("below", F.lit(0)) + own}
    )


def chain_nodes(groups: DataFrame) -> DataFrame:
    """The nodes of the turns that a split group shares, its top first."""
    steps = groups.select("*", F.posexplode(F.concat(F.array("size"), "chain")))
    passed = F.aggregate(F.slice(F.concat(F.array("size"), "chain"), F.lit(1), F.col("pos")), F.lit(0).cast("long"), lambda a, b: a + b)
    last = F.col("pos") == F.col("shared")
    return steps.select(
        F.col("conv").alias("conv_id"), (F.col("depth") + F.col("pos")).alias("depth"), F.when(F.col("pos") == 0, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("saved_tokens") - (F.col("n") - 1) * passed).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def nodes(own: DataFrame, max_turns: int = 20_000) -> DataFrame:
    """All nodes of the trie over ``own`` (:func:`sequences`): the least member, depth, the parent's least member, members,
    children, childless nodes below, bytes that sharing saves below, and the hash of the ids that end here."""
    spark = own.sparkSession
    root = {"gid": F.lit(b""), "parent": F.lit(None).cast("binary"), "parent_conv": F.lit(None).cast("long"), "depth": F.lit(0).cast("long"), "size": F.lit(0).cast("long")}
    rows, levels, small = saved(distinct_sequences(own).withColumns(root), "distinct"), [], []
    while True:
        groups = saved(summed(rows), "split")
        levels.append(groups)
        under = saved(children(rows, groups), "children")
        sizes = under.groupBy("gid").agg(F.sum(1 + F.size("digests")).alias("turns"))
        big = saved(sizes.where(F.col("turns") > max_turns), "big")
        if not big.count():
            small.append(under)
            break
        marked = under.join(F.broadcast(big.orderBy(F.desc("turns"), "gid").limit(10_000)).select("gid", F.lit(True).alias("large")), "gid", "left")
        if big.count() > 10_000:  # beyond what is broadcast no group holds over a ten-thousandth of the turns
            marked = marked.join(big.select("gid", F.lit(True).alias("other")), "gid", "left").withColumn("large", F.coalesce("large", "other")).drop("other")
        small.append(marked.where("large IS NULL").drop("large"))
        rows = saved(marked.where("large").drop("large"), "large")
    tries = small[0]
    for more in small[1:]:
        tries = tries.unionByName(more)
    turns = tries.agg(F.coalesce(F.sum(1 + F.size("digests")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * turns // max_turns)
    built = tries.groupBy(F.expr(f"pmod(xxhash64(gid), {buckets})").alias("bucket")).applyInPandas(lambda pdf: forest(pdf), f"{NODE}, split binary")
    built = saved(built, "tries")
    found, tops = built.select(NAMES), built.where("split IS NOT NULL").select("split", "n_leaves", "saved_tokens")
    for groups in reversed(levels):
        done = chains(groups, tops)
        found = found.unionByName(chain_nodes(done))
        tops = tops.unionByName(done.where("parent IS NOT NULL").select(F.col("parent").alias("split"), "n_leaves", "saved_tokens"))
    return found.select(NAMES)
