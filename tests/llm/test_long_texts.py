"""One text of 20 MB through the kernels of every operator on texts: whole results in bounded memory."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tarnfall.llm import decontaminate, line_rules, near_copies, quality, simhash_trie, toxicity, word_bpe
from tarnfall.llm.registry import tokenizer
from tarnfall.llm.textkernel import texts_of

WORDS, N = 3_000_000, 7919


@pytest.fixture(scope="module")
def text():
    return "\n".join(" ".join(f"w{i * i % N}" for i in range(lo, lo + 3000)) for lo in range(0, WORDS, 3000)) + " x" * 1_000_000


@pytest.fixture(scope="module")
def column(text):
    return pa.array(["a short one", text, None])


@pytest.fixture(autouse=True)
def bounded(request):
    """A kernel needs under 60 bytes for each byte of the text."""
    tracemalloc.start()
    yield
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(request.node.name, peak >> 20, "MB")
    assert peak < 60 * 20 << 20


def test_line_rules(column, text):
    p = line_rules.profile(texts_of(column), 5)
    assert p["n_words"].tolist() == [3, WORDS + 1_000_000, 0]
    assert p["word_chars"][1] == len(re.sub(r"\s", "", text)) and np.diff(p["line_bounds"])[1] == text.count("\n") + 1


def test_near_copies(column):
    hashes, bounds = near_copies.shingles(texts_of(column), 5)
    assert bounds[1] == 1 and 0 < bounds[2] - bounds[1] < 2 * N and bounds[3] == bounds[2]
    assert len(near_copies.buckets_of(hashes, bounds, 2, 2)) == 3


def test_fingerprints(column):
    assert simhash_trie.fingerprints_of(texts_of(column), 4).tolist()[2] == 0


def test_toxicity(column):
    t = texts_of(column)
    key = np.sort(toxicity.distinct_features("w4"))
    assert toxicity.Model(key, np.full(len(key), 2.0), -1.0).logits(t).tolist() == [-1.0, 1.0, -1.0]


def test_quality(column):
    vectors = quality.Vectors(np.zeros(0, np.uint64), np.ones((quality.BUCKETS, quality.DIM), np.float32), np.ones(quality.BUCKETS, np.float32))
    x = quality.document_vectors(texts_of(column), vectors)
    assert np.allclose(x[:2, : quality.DIM], 1) and not x[2].any() and x[1, -1] > x[0, -1]


def test_word_bpe(column, text):
    bpe = word_bpe.Bpe(open(tokenizer("word_bpe_49k.json"), encoding="utf-8").read())
    ids, bounds = bpe.encode_texts(column.to_pylist())
    assert bounds[0] == 0 and bounds[3] == bounds[2] == len(ids)
    assert sum(bpe.names[int(i)].as_py().endswith("</w>") for i in ids[bounds[0] : bounds[1]]) == 3
    assert len(bpe.digests(bpe.numbers, ids, bounds)) == 3


def test_sketches(column):
    hashes, bounds = near_copies.shingles(texts_of(column), 5)
    assert near_copies.sketches(hashes, bounds).shape == (3, near_copies.BINS // 32)


def test_decontaminate(column, text):
    item = text[text.index("w100 ") :][:400]
    block = decontaminate.Block(["1"], [item], 10)
    hits = pa.array([[]] * 3, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
    n_words, found, items = block.search(texts_of(column), hits, pa.array([[]] * 3, pa.list_(pa.string())))
    assert n_words.to_pylist() == [3, WORDS + 1_000_000, 0] and items.to_pylist() == [[], ["1"], []] and len(found[1]) >= 1
