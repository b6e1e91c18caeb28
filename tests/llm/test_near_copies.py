import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from tarnfall.llm import near_copies

SCHEMA = "doc_id long, text string, source string"


def plain_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Least ids of the components of all pairs of similarity 0.8 or more. rows: {id: text}."""
    sets = {k: plain_set(t) for k, t in rows.items()}
    held = defaultdict(list)
    for k in sorted(rows):
        for s in sets[k] or {()}:
            held[s].append(k)
    up = {k: k for k in rows}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in {(a, b) for ks in held.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {find(k) for k in rows}


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_kept({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == want


def test_stage_takes_out_copies_that_differ_in_many_bits(spark):
    """Texts of similarity 0.8 or more that 4 bits of a fingerprint do not link; a text of 0.6 stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id in (1, 255, 709, 944)")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 709]


def test_large_groups_chains_and_strangers(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(60):  # all near the first, not all near each other
        words = list(base)
        words[int(rng.integers(0, 120))] = f"x{i}"
        words[int(rng.integers(0, 120))] = f"y{i}"
        rows[i] = " ".join(words)
    for i in range(30):  # a chain: each is near the next only
        rows[100 + i] = " ".join(f"c{k}" for k in range(4 * i, 4 * i + 80))
    for i in range(40):  # half the text in common
        rows[200 + i] = " ".join(f"h{k}" for k in range(60)) + " " + " ".join(f"s{i}_{k}" for k in range(50))
    rows |= {300: None, 301: "", 302: " \n", 303: "two words", 304: "Two  WORDS", 305: "other words"}
    docs = spark.createDataFrame([(k, t, "web") for k, t in rows.items()], SCHEMA)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == plain_kept(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    kept = near_copies.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    got = kept.collect()
    assert sum(r.doc_id == 5 for r in got) == 1 and not any(r.doc_id == 6 for r in got) and sum(r.doc_id is None for r in got) == 1
    assert {r.text for r in got if r.doc_id == 3} == {"one", "another text of document three"}
    assert near_copies.keep_one(no_docs).count() == 0


def test_an_id_on_two_texts(spark):
    a, b = "the first group has these eleven words in each of its rows", "another group with wholly different contents and some more words here"
    docs = spark.createDataFrame([(1, a, "web"), (2, a, "web"), (2, b, "web"), (3, b, "web")], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in near_copies.keep_one(docs).collect()) == [(1, a), (2, b)]


def test_sketches_keep_all_pairs_at_the_limit(spark):
    """Random sets of shared hashes: no pair of the similarity is left out, most pairs far below it are."""
    rng = np.random.default_rng(12)
    rows, exact = [], []
    for i in range(3000):
        n, s = int(rng.integers(1, 3000) if i % 2 else rng.integers(1, 200)), (0.8, 0.9, 1.0, 0.5)[i % 4]
        shared = int(np.ceil(n * s))
        pool = near_copies.mix(rng.integers(0, 2**63, 2 * n - shared + 1).astype(np.uint64))
        extra = (n - shared) // 2
        one, other = np.unique(pool[: shared + extra]), np.unique(np.concatenate([pool[:shared], pool[shared + extra : n]]))
        both = np.concatenate([one, other])
        sketch = near_copies.sketches(both, np.array([0, len(one), len(both)])).view(np.int64).tolist()
        rows.append((i, {"n": len(one), "sketch": sketch[0]}, {"n": len(other), "sketch": sketch[1]}))
        common = len(np.intersect1d(one, other))
        exact.append(common / (len(both) - common))
    side = "struct<n: long, sketch: array<long>>"
    got = {r.i for r in spark.createDataFrame(rows, f"i long, x {side}, y {side}").where(near_copies.may_reach("x", "y", 0.8)).collect()}
    assert all(i in got for i, s in enumerate(exact) if s >= 0.8)
    low = [i for i, s in enumerate(exact) if s < 0.55 and rows[i][1]["n"] > 60]
    assert len([i for i in low if i in got]) < 0.05 * len(low)


def test_the_trie_join_gives_links_of_its_own(spark):
    """A copy and its text share a component of the trie join and no band; in its band the copy is with a stranger that comes first."""
    text = " ".join(f"w{i}" for i in range(400))
    key = lambda t: near_copies.buckets_of(*near_copies.shingles(near_copies.texts_of(near_copies.pa.array([t])), 5), 1, 1)[0, 0]
    stranger = next(s for k in range(20_000) if key(f"{text} {(s := ' '.join(f'x{k}_{i}' for i in range(5)))}") == key(s))
    rows = spark.createDataFrame([(1, stranger), (2, text), (3, f"{text} {stranger}")], "node long, text string")
    for bands in (1, 32):
        roots = {r.node: r.root for r in near_copies.near_roots(rows, 5, 0.8, bands, 1 if bands == 1 else 6).collect()}
        assert roots == {2: 2, 3: 2}


def test_bands_start_from_what_the_trie_join_has_connected(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [(k, " ".join([*words[: (at := int(rng.integers(0, 3000)))], f"x{k}", *words[at + 1 :]])) for k in range(40)]
    compared = []
    monkeypatch.setattr(near_copies, "similar", lambda pairs, *rest, real=near_copies.similar: compared.append(pairs.count()) or real(pairs, *rest))
    roots = near_copies.near_roots(spark.createDataFrame(texts, "node long, text string"), 5, 0.8, 32, 6).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 40
    assert compared == [39]
