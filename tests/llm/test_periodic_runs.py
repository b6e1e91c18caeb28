"""Runs and collapsed texts against a plain search of every lag, and the query against rows rebuilt word by word."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnfall.llm import periodic_runs as runs
from tarnfall.llm.registry import op11_periodic_runs
from tarnfall.llm.textkernel import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, min_words=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(min_words, 2 * q) and not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out)


def plain_collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_texts(rng):
    for _ in range(8):
        kinds, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 130, 260])
        w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
        if rng.random() < 0.7 and n > 4:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 2 + 1))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.5:
                w[rng.randrange(n)] = "x"
        yield "  ".join(w)


@pytest.mark.parametrize("limit", [None, 2.0, 1e9], ids=["as used", "all by transform", "all by pairs"])
def test_against_all_lags(monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(runs, "heavy_from", lambda n: limit)
    rng = random.Random(7)
    for _ in range(60):
        texts = list(some_texts(rng))
        codes, bounds, solid, lengths = runs.word_codes(texts_of(pa.array(texts)))
        found = runs.runs_of(codes, bounds)
        expected = [plain_runs(t.split()) for t in texts]
        assert found == expected
        assert runs.collapsed(found, bounds, solid, lengths).to_pylist() == [plain_collapsed(t.split(), x) for t, x in zip(texts, expected, strict=True)]


def test_small_pieces_of_positions(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 7)
    rng = random.Random(8)
    for _ in range(20):
        texts = list(some_texts(rng))
        codes, bounds, *_ = runs.word_codes(texts_of(pa.array(texts)))
        assert runs.runs_of(codes, bounds) == [plain_runs(t.split()) for t in texts]


def test_long_periods_and_overlaps():
    """Fibonacci words: many overlapping runs; a long period that stands in a text of few repeats."""
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    natural = [str(i * i % 7919) for i in range(3000)]
    texts = [" ".join(b[:700]), " ".join(natural[:700] * 2), " ".join(["x"] * 3000), " ".join([*"abc"] * 4 + ["d"])]
    codes, bounds, *_ = runs.word_codes(texts_of(pa.array(texts)))
    found = runs.runs_of(codes, bounds)
    assert found[0] == plain_runs(list(b[:700]))
    assert found[1:] == [[(0, 1400, 700)], [(0, 3000, 1)], [(0, 12, 3)]]


def test_odd_rows(spark, odd_docs, no_docs):
    named = odd_docs.withColumn("runs", F.lit("own")).withColumn("collapsed", F.lit(1))
    out = runs.find_runs(named, carry=("doc_id", "text", "score", "runs", "collapsed"))
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "score", "runs", "collapsed"] and len(rows) == odd_docs.count()
    for r in rows:
        w = WORD.findall(r.text or "")
        expected = plain_runs(w) if len(w) < 5000 else [tuple(x) for x in r.runs]
        assert [tuple(x) for x in r.runs] == expected and r.collapsed == plain_collapsed(w, expected)
    assert any(r.runs for r in rows)
    assert runs.find_runs(no_docs).collect() == []


def rebuilt(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, tmp_path, odd_docs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = odd_docs.where(F.length("text") < 5000).select("doc_id", "text")
    ids = spark.createDataFrame([(i, t) for i in range(400, 460) for t in ("", "one two", "a b c d e f g h i j k l m n o p q r s t u v w x y z")], "doc_id long, text string")
    docs.where(F.length("text") < 4000).unionByName(more).unionByName(ids).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        w = rebuilt(r.doc_id, r.text)
        found = plain_runs(w)
        s, length, q = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        expected.append((r.doc_id, len(found), s, length, q, 1000 * length // q if q else None, digest(lines), digest(plain_collapsed(w, found))))
    got = op11_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, got.select(names).collect()), key=str) == sorted((repr(spark_row(names, x)) for x in expected), key=str)
    assert {t for _, t in got.dtypes} == {"bigint", "string"}


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values, strict=True)))
