import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tarnfall.llm import quality, toxicity
from tarnfall.llm.registry import QUERIES
from tarnfall.llm.textkernel import mix, texts_of

DIR = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    y = np.asarray(labels)
    n1, n0 = y.sum(), (1 - y).sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("name", "column", "modulus", "fold", "least"), [("op1_toxicity", "toxic", 4, 2, 0.95), ("op2_quality", "quality", 5, 0, 0.97)])
def test_held_out(spark, name, column, modulus, fold, least):
    out = QUERIES[name](spark, DIR).toPandas()
    assert len(out) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % modulus == fold for i in out.doc_id]).all()
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", column).toPandas()
    seen = out[out.held_out].merge(labels, on="doc_id")
    print(name, len(seen), auc(seen.score, seen[column]), ((seen.score >= 0.3) == seen[column]).mean())
    assert auc(seen.score, seen[column]) >= least


@pytest.fixture(scope="module")
def empty_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_odd_documents_without_labels(spark, odd_docs, no_docs, empty_labels):
    one = spark.createDataFrame([(0, 1, 1), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (empty_labels, one):
        for docs in (odd_docs, no_docs):
            slim = docs.select("doc_id", "text")
            a = toxicity.score(slim, toxicity.train(slim, labels)).collect()
            b = quality.score(slim, *quality.train(slim, labels)).collect()
            assert len(a) == len(b) == docs.count()
            assert all(0 <= r.score <= 1 for r in [*a, *b])
    kept = toxicity.drop_toxic(odd_docs, toxicity.train(odd_docs, empty_labels))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_swaps_replace_whole_terms(spark):
    swap = toxicity.Swaps()
    assert swap("Muslims and women, not womenswear", 0) == "people and persons, not womenswear"
    assert swap("The gay couple", 1) != "The gay couple" and swap("The gay couple", 1).endswith("couple")
    assert swap.copies("nothing of the kind", 3) == [] and len(swap.copies("two women", 3)) == 3
    terms = spark.createDataFrame([("b", 2, "Zorps"), ("b", 1, "folk"), ("b", 3, "grix"), ("a", 1, "one"), ("a", 2, None)], "grp string, place int, term string")
    own = toxicity.Swaps(toxicity.groups_of(terms))
    assert own("zorps and Grix", 0) == "folk and folk" and own("zorps and Grix", 1) == "grix and Zorps"
    assert toxicity.Swaps(())("women", 0) == "women"


def planted(rng, n):
    """Labelled rows where the groups' names keep bad company in toxic texts, and neutral mentions are rare."""
    rows = []
    for i in range(n):
        toxic = i % 2
        words = [f"filler{rng.integers(50)}" for _ in range(12)] + (["vermin", "scum"] if toxic and rng.random() < 0.8 else [])
        if rng.random() < (0.7 if toxic else 0.1):
            words.append(("zorps", "grix")[rng.integers(2)])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    """Held-out rows: with the penalty fewer neutral mentions pass the threshold, and the ranking stays as good."""
    rows = planted(np.random.default_rng(0), 1600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = spark.createDataFrame([("g", 1, "folk"), ("g", 2, "zorps"), ("g", 3, "grix")], "grp string, place int, term string")
    found = {}
    for penalty in (0.0, 20.0):
        model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), penalty=penalty, terms=terms)
        kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
        assert model.swapped == sum("zorps" in t or "grix" in t for _, t, _ in kept)
        out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
        neutral = [out[i] for i, t, y in held if not y and ("zorps" in t or "grix" in t)]
        bad = [out[i] for i, t, y in held if y and "scum" in t]
        found[penalty] = np.mean(np.array(neutral) >= 0.3), np.mean(np.array(bad) >= 0.3), auc([out[r[0]] for r in held], [r[2] for r in held])
    print(found)
    assert found[20.0][0] < 0.5 * found[0.0][0] and found[20.0][1] > 0.95
    assert found[20.0][2] > found[0.0][2] - 0.03


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[a-z0-9]+", lower)
    return set(words) | {(n, w[:n]) for w in words for n in toxicity.BEGINNINGS if len(w) > n}


def test_scores_like_a_plain_model(spark, odd_docs):
    """Scores are the sum of the weights of a text's distinct features, found here one by one (ASCII texts)."""
    docs = odd_docs.where("text is null or text rlike '^[ -~\\\\s]*$'").select("doc_id", "text")
    names = sorted({f for r in docs.collect() for f in plain_features(r.text)}, key=str)[::3]
    hashed = np.array([h for f in names for h in _hash_of(f)], np.uint64)
    weights = np.random.default_rng(1).normal(size=len(names)) / 50
    order = np.argsort(hashed)
    model = toxicity.Model(hashed[order], weights[order], -0.5)
    weight = dict(zip(names, weights, strict=True))
    want = sorted((str(r.doc_id), round(float(toxicity.sigmoid(np.array(-0.5 + sum(weight.get(f, 0) for f in plain_features(r.text))))), 9)) for r in docs.collect())
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score(docs, model).collect()) == want


def _hash_of(feature):
    n, word = feature if isinstance(feature, tuple) else (0, feature)
    spans = texts_of(pa.array([word])).hashes()(np.array([0]), np.array([len(word)]))
    return mix(spans ^ np.uint64(n)) if n else mix(spans)


def test_features_are_those_that_tell_the_labels_apart(spark):
    rows = [(y, [[1, 2, 10 + i]]) for i, y in enumerate([0, 1] * 50)] + [(1, [[3], [4]])] * 20 + [(0, [[5]])]
    sample = spark.createDataFrame(rows, "label int, sets array<array<long>>")
    keys = toxicity.chosen_features(sample)
    n0, n1 = 51, 70

    def z(bad, docs):
        share = docs / (n0 + n1)
        return abs((bad / n1 - (docs - bad) / n0) / np.sqrt(max(share * (1 - share), 1e-9) * (1 / n0 + 1 / n1)))

    counts = {1: (50, 100), 2: (50, 100), 3: (20, 20), 5: (0, 1)}
    assert keys.tolist() == [f for f, (b, d) in counts.items() if d >= 3 and z(b, d) >= 3.5] and 3 in keys and 4 not in keys
    got = toxicity.chosen_only(sample, keys)
    assert sorted((r["label"], str(r["sets"])) for r in got.to_pylist()) == sorted((y, str([[keys.tolist().index(f) for f in s if f in keys] for s in sets])) for y, sets in rows)


def plain_contexts(texts):
    """Of each word the sum of its neighbours' index vectors, and its occurrences; by plain loops over words."""
    sums, counts = defaultdict(lambda: np.zeros(quality.DIM, int)), Counter()
    for text in texts:
        words = re.findall("[a-z0-9]+|[^a-z0-9\\s]+", text or "")
        for i, w in enumerate(words):
            counts[w] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if j != i:
                    sums[w] += plain_index(words[j], quality.DIM)
    return sums, counts


def plain_index(word, dim):
    out = np.zeros(dim, int)
    for place, sign in quality.index_vectors(texts_of(pa.array([word])).hashes()(np.array([0]), np.array([len(word)])), dim):
        out[place[0]] += int(sign[0])
    return out


TEXTS = ["alpha beta gamma alpha !!", "beta alpha beta", None, "", "alpha ?! gamma 42", " \n", "beta"] * 3


def test_context_vectors_like_plain_loops(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(5)
    sums, counts = plain_contexts(TEXTS)
    own = quality.frequent_words(docs)
    assert len(own) == len(counts) and quality.frequent_words(docs, 2).tolist() == sorted(_word(w) for w, _ in counts.most_common(2))
    table = quality.context_sums(docs, own)
    for w in counts:
        row = np.searchsorted(own, np.uint64(_word(w)))
        assert table[row, : quality.DIM].tolist() == sums[w].tolist() and table[row, quality.DIM] == counts[w]
    none = quality.context_sums(docs, own[:0])  # all words in buckets: nothing is lost
    assert none[:, quality.DIM].sum() == sum(counts.values()) and none.sum(axis=0).tolist() == table.sum(axis=0).tolist()


def _word(w):
    return int(texts_of(pa.array([w])).hashes()(np.array([0]), np.array([len(w)]))[0])


def test_document_vectors_like_plain_loops(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    vectors = quality.context_vectors(docs)
    sums, counts = plain_contexts(TEXTS)
    total = sum(counts.values())
    unit = {w: v / max(np.linalg.norm(v), 1) for w, v in sums.items()} | {w: np.zeros(quality.DIM) for w in counts if w not in sums}
    got = quality.document_vectors(texts_of(pa.array(TEXTS[:7])), vectors)
    for text, x in zip(TEXTS, got, strict=False):
        words = re.findall("[a-z0-9]+|[^a-z0-9\\s]+", text or "")
        if not words:
            assert not x.any()
            continue
        each = np.array([unit[w] for w in words])
        weight = [1e-3 / (1e-3 + counts[w] / total) for w in words]
        added = sum(a * plain_index(w, quality.WIDE) for a, w in zip(weight, words, strict=True))
        rep = np.log((added**2).sum() / (quality.NONZERO * sum(a * a for a in weight)) + 0.1)
        assert np.allclose(x, [*each.mean(axis=0), *each.std(axis=0), rep], atol=1e-5)
