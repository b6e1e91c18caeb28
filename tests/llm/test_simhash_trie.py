import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnfall.llm import near_copies, simhash_trie
from tarnfall.llm.textkernel import texts_of


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(values, bits):
    """values: {key: fingerprint}; the least key reachable over all pairs."""
    keys = sorted(values)
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (values[a] ^ values[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_documents_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    least = plain_components(prints, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_trie.simhash_groups(docs).collect()}
    assert got == {k: (f"{prints[k]:016x}", least[k]) for k in texts}
    assert len(set(least.values())) < len(least)


def test_odd_documents(spark, odd_docs, no_docs):
    got = simhash_trie.simhash_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{plain_fingerprint(t):016x}") for i, t in texts)
    blank = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert blank == {0}
    assert simhash_trie.simhash_groups(no_docs).count() == 0
    kept = simhash_trie.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.where("doc_id = 5").count() == 1
    assert simhash_trie.keep_one(no_docs).count() == 0


def test_dense_and_chained_fingerprints(spark):
    """Chains, a ball of close values and far ones; small tasks, so that groups are cut into chunks."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    values = {base}
    for _ in range(150):  # a ball of values with up to 6 flips
        v = base
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    far = int(rng.integers(0, 1 << 63))
    for k in range(0, 60, 3):  # a chain of three-bit steps
        far ^= 0b111 << k
        values.add(far)
    values |= {int(x) for x in rng.integers(0, 1 << 63, 100)}
    values |= {v | 1 << 63 for v in list(values)[:40]}
    ordered = sorted(values)
    want = plain_components(dict(enumerate(ordered)), 4)
    signed = [v - (1 << 64) if v >> 63 else v for v in ordered]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for task_rows in (1024, 20):
        roots = simhash_trie.components(simhash_trie.links(fps, 4, task_rows=task_rows, max_chunks=5))
        root = {r.node: r.root for r in roots.collect()}
        groups = {}
        for k, v in enumerate(signed):
            groups.setdefault(root.get(v, v), set()).add(k)
        plain = {}
        for k, r in want.items():
            plain.setdefault(r, set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_many_copies(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the same eleven words are found in each of these many copies").alias("text"), F.lit("web").alias("source"))
    got = simhash_trie.simhash_groups(docs)
    assert got.count() == 500
    assert [r.component_id for r in got.select("component_id").distinct().collect()] == [0]
    assert [r.doc_id for r in simhash_trie.keep_one(docs).collect()] == [0]


A, B = "the first group has these eleven words in each of its rows", "another group with wholly different contents and some more words here"


@pytest.mark.parametrize("keep_one", [simhash_trie.keep_one, near_copies.keep_one])
@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, A), (5, A), (5, B)], [(1, A), (5, B)]),  # an id on two texts, one of them another id's
        ([(5, A), (5, A + " ")], [(5, None)]),  # one id, texts that differ by a space: either stays
        ([(None, A), (None, A), (None, B)], [(None, A), (None, B)]),  # null ids are reduced like others
        ([(None, A), (7, A), (7, A)], [(7, A)]),  # and come after all others
        ([(3, None), (2, ""), (4, " \n"), (9, A)], [(2, ""), (9, A)]),
    ],
)
def test_ids_of_all_kinds(spark, keep_one, rows, want):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, root string")
    got = keep_one(docs)
    assert got.columns == docs.columns
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.text if all(w[1] is not None for w in want) else None) for r in got.collect()), key=key) == sorted(want, key=key)


def test_a_long_text_in_blocks(spark, monkeypatch):
    """Bits are counted over blocks of shingles; every cut gives the same fingerprints."""
    texts = [" ".join(f"w{i * i % 9973}" for i in range(50_000)), None, "short text of a few words", "", "w " * 5000]
    t = texts_of(pa.array(texts))
    want = [plain_fingerprint(x) for x in texts]
    assert simhash_trie.fingerprints_of(t, 4).tolist() == want
    for block in (1, 3, 1000):
        if block > 1:
            monkeypatch.setattr(simhash_trie, "BLOCK", block)
            assert simhash_trie.fingerprints_of(texts_of(pa.array(texts[1:])), 4).tolist() == want[1:]
