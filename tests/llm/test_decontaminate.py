"""Hits and items against a plain search of every window, in one block and in many."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnfall.llm import decontaminate
from tarnfall.llm.oracles import ORACLES
from tarnfall.llm.registry import op12_decontaminate
from tarnfall.llm.textkernel import texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(docs, items, width=10):
    """n_words, hit stretches and item ids of each text."""
    windows = {}
    for item, text in items:
        w = words_of(text)
        k = min(width, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for text in docs:
        w, hit, found = words_of(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= own
        starts = sorted(i for i in hit if i - 1 not in hit)
        ends = sorted(i + 1 for i in hit if i + 1 not in hit)
        out.append((len(w), [(a, b - a) for a, b in zip(starts, ends, strict=True)], sorted(str(x) for x in found if x is not None)))
    return out


def kernel(docs, items, width=10):
    block = decontaminate.Block([None if i is None else str(i) for i, _ in items], [t or "" for _, t in items], width)
    n = len(docs)
    hits = pa.array([[]] * n, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
    found = block.search(texts_of(pa.array(docs, pa.string())), hits, pa.array([[]] * n, pa.list_(pa.string())))
    return [(a, [(h["start"], h["length"]) for h in b], c) for a, b, c in zip(*(x.to_pylist() for x in found), strict=True)]


def some_case(rng):
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 3, 8, 40]))] + ["Ünï", "日本", "don't"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(rng.choice([None, 1, 2, 10, i]), rng.choice([None, "", text(rng.choice([1, 2, 5, 9, 10, 11, 40]))])) for i in range(rng.randrange(8))]
    docs = [None, "", "..."] + [text(rng.randrange(200)) for _ in range(5)]
    docs += [text(9) + " " + (t or "").upper() + "! " + text(3) for _, t in items]
    return docs, items


@pytest.mark.parametrize("stretch", [1, 5, 96])
def test_against_every_window(monkeypatch, stretch):
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(60):
        docs, items = some_case(rng)
        width = rng.choice([1, 2, 3, 10])
        assert kernel(docs, items, width) == plain(docs, items, width)


def test_equal_hashes_are_told_apart(monkeypatch):
    """All words hash alike: only the direct comparison is left."""
    monkeypatch.setattr(decontaminate.Words, "pair", lambda self, last, width: np.zeros(len(last), np.uint64))
    monkeypatch.setattr(decontaminate.Words, "window", lambda self, first, width: np.zeros(len(first), np.uint64))
    rng = random.Random(5)
    for _ in range(20):
        docs, items = some_case(rng)
        assert kernel(docs, items, 3) == plain(docs, items, 3)


def test_positions_are_skipped():
    rng = random.Random(6)
    item = " ".join(f"i{k}" for k in range(30))
    words = decontaminate.Words(texts_of(pa.array([" ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))])))
    group = decontaminate.Block(["1"], [item], 10).groups[0]
    looked = []
    pair = words.pair
    words.pair = lambda last, width: (looked.append(len(last)), pair(last, width))[1]
    group.ends(words)
    assert sum(looked) < 20_000 / 8


ROWS = "doc_id long, text string, hits int, items string, score double"


def result(df):
    return sorted((repr((r.doc_id, r.n_words, [tuple(h) for h in r.hits], r.items)) for r in df.collect()))


def test_blocks_and_pieces(spark, monkeypatch):
    """Many small blocks, items cut into pieces, and columns of the operator's names."""
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    rng = random.Random(9)
    docs, items = [], []
    for _ in range(8):
        d, i = some_case(rng)
        docs, items = docs + d, items + i
    rows = [(n, t, 1, "x", 0.5) for n, t in enumerate(docs)]
    df = spark.createDataFrame(rows, ROWS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(repr((n, *x)) for n, x in enumerate(plain(docs, items)))
    assert result(decontaminate.search(df, bench)) == expected
    assert result(decontaminate.search(df, bench, ("doc_id", "hits", "text"), block_bytes=300)) == expected
    assert decontaminate.blocks_of(bench, 10, 300)[1] > 2
    clean = decontaminate.keep_clean(df, bench)
    assert clean.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id for r in clean.collect()) == [n for n, x in enumerate(plain(docs, items)) if not x[1]]


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "The quick brown FOX jumps over the lazy dog again"), (2, None), (None, "naïve café"), (10, "one two three")], "item_id long, text string")
    got = decontaminate.search(odd_docs, bench)
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    expected = sorted(repr((i, *x)) for (i, _), x in zip(texts, plain([t for _, t in texts], items), strict=True))
    assert result(got) == expected
    assert decontaminate.search(no_docs, bench).collect() == []
    assert all(not r.hits and not r["items"] for r in decontaminate.search(odd_docs, bench.limit(0)).collect())


def test_query(spark, tmp_path):
    import duckdb

    rng = random.Random(11)
    docs, items = some_case(rng)
    docs += [t for _, t in items] * 2
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*items, *((20 + i, " ".join(f"w{i}" for _ in range(12))) for i in range(2))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op12_decontaminate(spark, str(tmp_path))
    rows = {r.doc_id: r for r in got.collect()}
    found = plain(docs, [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()])
    for n, (words, hits, ids) in enumerate(found):
        r = rows[n]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (words, sum(x for _, x in hits), len(ids), bool(hits))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    cur = con.execute(ORACLES["op12_decontaminate"])
    names = [x[0] for x in cur.description]
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in rows.values())


def test_extra_columns_stay(spark, odd_docs):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    out = decontaminate.search(odd_docs.withColumn("c0", F.lit(3)), bench, ("c0", "text", "score"))
    assert out.columns == ["c0", "text", "score", "n_words", "hits", "items"] and {r.c0 for r in out.collect()} == {3}
