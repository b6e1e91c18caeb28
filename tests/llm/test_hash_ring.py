import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnfall.llm import hash_ring
from tarnfall.llm.shared import unfolded


def check(docs, **options):
    got = hash_ring.shard_rows(docs, **options).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return {k: len(v) for k, v in slots.items()}, got


def test_counts_differ_by_one_at_most(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes, _ = check(docs)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_odd_documents(odd_docs, no_docs):
    sizes, _ = check(odd_docs)
    counts = [sizes.get(s, 0) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert check(no_docs)[0] == {}


def test_one_key_repeated(spark):
    """A third of the rows is one row: copies flow over to the next shards."""
    docs = spark.range(300).selectExpr("if(id < 100, 7, id) as doc_id", "if(id < 100, 'copy', string(id)) as text")
    sizes, _ = check(docs)
    assert max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("shards", [1, 3, 9])
def test_other_shard_counts(spark, sf_dir, shards):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes, _ = check(docs, shards=shards)
    assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= 1


def test_slack_moves_few_rows(spark, sf_dir):
    """With room to spare a key stays on its own shard, and one more shard takes a share of keys."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = lambda n: {(r.doc_id, r.text_crc32): r.shard for r in check(docs, shards=n, slack=4.0)[1]}
    before, after = place(8), place(9)
    moved = [k for k in before if before[k] != after[k]]
    assert all(after[k] == 8 for k in moved) and 0 < len(moved) < len(before) / 4


def test_the_ring_is_walked_clockwise():
    orders = hash_ring.ring(4, 8, 256)
    assert len(orders) == 256 and all(sorted(o) == [0, 1, 2, 3] for o in orders)
    dealt = hash_ring.deal({5: 10, 9: 2}, 4, 8, 256, 0.0)
    taken = Counter()
    for _, low, high, shard, _ in dealt:
        taken[shard] += high - low
    assert taken == {0: 3, 1: 3, 2: 3, 3: 3}
    assert dealt[0][3] == orders[5][0]


def plain_shards(docs, shards=8, replicas=64, cells=16384):
    """Shard and slot of each row: rows wait in their cells in the order of their hashes, and turn by turn each goes to the
    next shard clockwise if that has room."""
    names = ["doc_id", "size", "text_crc32"]
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    rows = docs.select("doc_id", size, F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64(*names)).collect()
    orders = hash_ring.ring(shards, replicas, cells)
    key = lambda r: (r.h % cells, r.h, r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32)
    waiting, filled, out = sorted(rows, key=key), [0] * shards, []
    room = [len(rows) // shards + (k < len(rows) % shards) for k in range(shards)]
    for turn in range(shards):
        beyond = []
        for r in waiting:
            shard = orders[r.h % cells][turn]
            if filled[shard] < room[shard]:
                out.append((r.doc_id, r["size"], r.text_crc32, shard, filled[shard]))
                filled[shard] += 1
            else:
                beyond.append(r)
        waiting = beyond
    return out


def test_each_row_like_a_plain_ring(spark, sf_dir, odd_docs):
    """Rows that repeat each other may take each other's places."""
    copies = spark.range(500).selectExpr("if(id < 200, 7, id) as doc_id", "if(id < 200, 'copy', string(id)) as text")
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs, copies):
        for shards in (8, 3):
            got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in hash_ring.shard_rows(docs, shards=shards).collect()]
            assert sorted(map(str, got)) == sorted(map(str, plain_shards(docs, shards)))


def test_movement_of_the_even_deal(spark):
    """Without slack every shard is full, so one more shard also moves rows between the others; less than half of all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    place = lambda n: {(r.doc_id, r.text_crc32): r.shard for r in hash_ring.shard_rows(docs, shards=n).collect()}
    before, after = place(8), place(9)
    moved, new = [k for k in before if before[k] != after[k]], sum(s == 8 for s in after.values())
    print("moved", len(moved), "of", len(before), "into the new shard", new)
    assert new == len(before) // 9 + (len(before) % 9 > 8) and new <= len(moved) < 0.5 * len(before)


def test_a_row_repeated_very_often(spark):
    """Unfolded in parts of so many rows."""
    rows = spark.createDataFrame([("a", 10), ("b", 1), ("c", 4)], "k string, n long")
    got = sorted((r.k, r.copy) for r in unfolded(rows, "n", "copy", step=4).collect())
    assert got == [(k, c) for k, n in (("a", 10), ("b", 1), ("c", 4)) for c in range(n)]
