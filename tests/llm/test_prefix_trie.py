"""All nodes of the trie against a dictionary of prefixes, whole and split as often as can be."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tarnfall.llm import prefix_trie
from tarnfall.llm.registry import op13_prefix_trie
from tarnfall.llm.shared import saved

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_turns(rows):
    by_conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            by_conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(own)] for c, own in by_conv.items()}


def plain_nodes(own):
    """own: conversation -> list of turns."""
    members = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    kids, leaves, spare = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for key in members:
        if key:
            kids[key[:-1]] = kids.get(key[:-1], 0) + 1
    for key, of in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in kids
            spare[key[:d]] += (len(of) - 1) * len(key[-1][1].encode()) if key else 0
    return sorted(
        repr((min(of), len(key), min(members[key[:-1]]) if key else None, len(of), kids.get(key, 0), leaves[key], spare[key], sha(",".join(str(c) for c in sorted(of) if len(own[c]) == len(key)))))
        for key, of in members.items()
    )


def rebuilt(own):
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - c % 5
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def result(df):
    return sorted(repr(tuple(r)) for r in df.select(prefix_trie.NAMES).collect())


def some_rows(rng, convs=60, alphabet=3):
    """Conversations with shared beginnings, a long chain that many share, copies, and conversations that end within others."""
    rows = []
    chain = [("user", f"shared {i} é") for i in range(6)]
    for c in range(convs):
        kind = rng.random()
        head = chain if kind < 0.4 else chain[: rng.randrange(7)] if kind < 0.6 else []
        turns = head + [(rng.choice(["user", "assistant", None]), rng.choice([None, "", *"abc"[:alphabet]])) for _ in range(rng.randrange(6))]
        if kind > 0.9 and rows:
            turns = [(r[2], r[3]) for r in rows if r[0] == rows[0][0]]
        rows += [(c * 3, i if i or rng.random() < 0.5 else None, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("max_turns", [1, 25, 20_000], ids=["every group split", "some split", "none split"])
def test_against_all_prefixes(spark, max_turns):
    rows = some_rows(random.Random(max_turns))
    df = saved(prefix_trie.ordered_turns(spark.createDataFrame(rows, TURNS)), "turns")
    ids = df.select("conv_id").distinct()
    alone = spark.createDataFrame([(9_000_000_000,), (1,)], "conv_id long")  # conversations without turns
    own = plain_turns(rows) | {9_000_000_000: [], 1: []}
    got = prefix_trie.nodes(prefix_trie.sequences(df, ids.unionByName(alone)), max_turns)
    assert result(got) == plain_nodes(own)


def test_more_copies_than_a_range_of_ids(spark):
    """Ids of one node come from several ranges, negative ones first."""
    df = spark.range(-5000, 9000, 7).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("pos"), F.lit(b"x").alias("digest"), F.lit(3).cast("long").alias("bytes"))
    got = prefix_trie.nodes(prefix_trie.sequences(df, df.select("conv_id")))
    ids = range(-5000, 9000, 7)
    assert result(got) == sorted(
        map(repr, [(-5000, 0, None, 2000, 1, 1, 5997, sha("")), (-5000, 1, -5000, 2000, 0, 1, 5997, sha(",".join(map(str, ids))))])
    )


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, r, x) for c, t, r, x in some_rows(rng, 40)]
    rows = [(c // 3, t, r, x) for c, t, r, x in rows] + rows[:30] + [(None, 1, "user", "no id"), (77, None, None, None), (77, None, None, None), (78, 1, "user", "x")]
    df = spark.createDataFrame(rows, TURNS).withColumn("pos", F.lit("own")).withColumn("digest", F.lit(1))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(op13_prefix_trie(spark, str(tmp_path))) == plain_nodes(rebuilt(plain_turns(rows)))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_prefix_trie(spark, str(tmp_path)).collect() == []
