import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfall.llm import block_mix
from tarnfall.llm.representatives import text_keys
from tarnfall.llm.textkernel import mix as scramble


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water filling: shares of what is left, capped sources fixed one round after another."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    fixed, left = {}, share * sum(sizes)
    while True:
        total = sum(w[i] for i in range(len(sizes)) if i not in fixed)
        due = {i: (left - sum(fixed.values())) * w[i] / total for i in range(len(sizes)) if i not in fixed} if total else {}
        over = [i for i, t in due.items() if t > most * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, due.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def check(docs, **options):
    rows = docs.select("doc_id", "source", "text").collect()
    by = defaultdict(int)
    for r in rows:
        by[r.source] += size_of(r.text)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    due = dict(zip(order, plain_targets([by[s] for s in order]), strict=True))
    mix = block_mix.Mix(docs, **options)
    got = mix.by_document().collect()
    want = sorted((str(r.doc_id), size_of(r.text), by[r.source], round(due[r.source], 6)) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6)) for r in got) == want
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s in order:
        if sum(by[t] == by[s] and round(due[t], 6) == round(due[s], 6) for t in order) == 1:
            assert abs(taken[by[s], round(due[s], 6)] - due[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, block_mix.Mix(docs, **options).by_document().collect()))
    return got


def test_documents(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@pytest.mark.parametrize("length", [7, 512])
def test_odd_documents(odd_docs, no_docs, length):
    check(odd_docs, length=length)
    assert check(no_docs) == []


def test_mixed_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = block_mix.mix_documents(docs, length=64)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken for r in block_mix.Mix(docs, length=64).by_document().collect()}
    words = defaultdict(int)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        words[r.doc_id] += size_of(r.text)
        assert set(r.text.split()) <= set(texts[r.doc_id].split())
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_mixed_odd_documents(odd_docs, no_docs):
    out = block_mix.mix_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert block_mix.mix_documents(no_docs).count() == 0


def test_clashing_names_and_null_ids(spark):
    """Documents' columns named like the operator's own; unlike texts of one size under null and repeated ids."""
    rows = [(None, f"text number {k} of null ids", "s", 1, [2], 3) for k in range(50)] + [(7, f"text {k} of one id", "s", 4, None, 6) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int, runs array<int>, size int")
    docs = docs.withColumns({"one": F.lit(1), "copy": F.lit("c"), "turn": F.lit(0), "idx": F.lit(5), "offset": F.lit(9)})
    out = block_mix.mix_documents(docs, length=8).collect()
    got = Counter(w for r in out for w in r.text.split())
    texts = Counter(w for r in docs.collect() for w in r.text.split())
    assert sum(got.values()) == int(1.5 * sum(texts.values()) + 0.5) and all(got[w] <= 2 * n for w, n in texts.items())
    assert {r.text for r in out if r.doc_id is None} >= {f"text number {k} of null ids" for k in range(50)}
    assert all(r.taken in (1, 4) and r.copy == "c" for r in out)


def test_a_row_that_repeats_very_often(spark, monkeypatch):
    monkeypatch.setattr(block_mix, "UNFOLDED", 4)
    rows = [(1, "the same row again", "s")] * 20 + [(k, f"row {k} of its own", "s") for k in range(2, 12)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), length=8)


def plain_permute(x, n, key):
    for r in range(block_mix.ROUNDS):
        k = int(scramble(np.array([(r + key) % 2**64], np.uint64))[0])
        other = (k % n - x) % n
        if int(scramble(np.array([max(x, other) ^ k], np.uint64))[0]) & 1:
            x = other
    return x


def plain_taken(docs, length, seed=7, share=1.5, most=2.0):
    """Words taken of each row: a source's words in a row, block by block, slot by slot, word by word."""
    h = F.xxhash64("doc_id", "size", "one", "two")
    keyed = docs.select("doc_id", "source", block_mix.word_count(F.col("text")).alias("size"), *(c.alias(n[2:]) for n, c in text_keys().items())).withColumn("h", h)
    by = defaultdict(list)
    for r in keyed.collect():
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    due = plain_targets([sum(r["size"] for r in by[s]) for s in order], share=share, most=most)
    out = []
    for idx, s in enumerate(order):
        rows = sorted(by[s], key=lambda r: (r.h % 256, (r.h >> 8) % 256, r.h, str(r.doc_id)))
        owner = [k for k, r in enumerate(rows) for _ in range(r["size"])]
        blocks, goal = -(-len(owner) // length), min(int(due[idx] + 0.5), int(most * len(owner)))
        taken, slot = [0] * len(rows), 0
        while goal:
            b = plain_permute(slot % blocks, blocks, block_mix.pass_key(seed, idx, slot // blocks))
            for k in owner[b * length : (b + 1) * length][:goal]:
                taken[k] += 1
                goal -= 1
            slot += 1
        out += [(str(r.doc_id), r["size"], n) for r, n in zip(rows, taken, strict=True)]
    return sorted(out)


@pytest.mark.parametrize("length", [16, 512])
def test_taken_word_by_word(spark, sf_dir, odd_docs, length):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])):
        got = sorted((str(r.doc_id), r["size"], r.taken) for r in block_mix.Mix(docs, length=length).by_document().collect())
        assert got == plain_taken(docs, length)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 4096])
def test_permutation(n):
    x = np.arange(n)
    y = block_mix.permute(x, n, 77)
    assert sorted(y.tolist()) == x.tolist()
    assert (block_mix.permute(y, n, 77, back=True) == x).all()


def test_slot_plans_reach_the_target():
    rng = np.random.default_rng(1)
    for _ in range(300):
        size, length = int(rng.integers(1, 400)), int(rng.integers(1, 60))
        target = float(rng.uniform(0, 2 * size))
        blocks, slots, last = block_mix.slot_plan(size, target, length, 3, 7, 2.0)
        turn, block = np.arange(slots) // blocks, np.arange(slots) % blocks
        for t in range(int(turn.max(initial=-1)) + 1):
            block[turn == t] = block_mix.permute(block[turn == t], blocks, block_mix.pass_key(7, 3, t))
        take = np.where(block == blocks - 1, size - (blocks - 1) * length, length)
        if slots:
            assert 0 < last <= take[-1]
            take[-1] = last
        assert take.sum() == min(int(target + 0.5), 2 * size)


def test_draws_spread_every_source():
    drawn = block_mix.draw([1000, 500, 250], 7, 100, 4096)
    per = defaultdict(int)
    for shard, source, first, n in drawn:
        assert first == per[source]
        per[source] += n
    assert dict(per) == {0: 1000, 1: 500, 2: 250}
