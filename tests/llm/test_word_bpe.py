import hashlib

import pytest

from tarnfall.llm import word_bpe
from tarnfall.llm.registry import tokenizer

PATH = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(PATH))
    t.no_padding()
    t.no_truncation()
    return t


def check(docs, library):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    key = lambda r: tuple(map(str, r))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_bpe.digests(docs, tokenizer(PATH)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_documents_like_the_library(spark, sf_dir, library):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), library)


def test_odd_documents_like_the_library(odd_docs, no_docs, library):
    check(odd_docs, library)
    check(no_docs, library)


def test_unusual_characters_like_the_library(spark, library):
    texts = [
        " non breaking　spaces\x85here", "é combining İstanbul ǅ ß ﬁ", "'s 'S don'T we'LL I'M 're", "<|startoftext|>a<|endoftext|><|endoftext|> <|endofText|>",
        "1234567890 ½ ² ٣ Ⅷ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abab" * 500, "\x00\x01\x1c\x1d\x1e\x1f control ​ zero ﻿", "👩‍👩‍👧‍👦 🏳️‍🌈 !!!???...", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ", "ẛ̣ 한글 각",
        "snake_case CamelCase x=1;y<=2", " line para᠎", "http://a.b/c?d=e&f=g#h", "퟿\U0010ffff",
    ]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), library)


def test_arrays_and_round_trip(odd_docs, library):
    ids = word_bpe.encode(odd_docs, tokenizer(PATH))
    assert set(ids.columns) == {*odd_docs.columns, "ids"} - {"text"}
    back = {r.doc_id: r.text for r in word_bpe.decode(ids, tokenizer(PATH)).where("doc_id > 3").collect()}
    for r in odd_docs.where("doc_id > 3").collect():
        assert back[r.doc_id] == library.decode(library.encode(r.text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_long_texts_and_long_words_like_the_library(spark, library, monkeypatch):
    """Texts of many runs, and words of a megabyte: letters with merges, and without any white space at all."""
    texts = [" ".join(f"word{i % 7919} thé{i % 31}'s" for i in range(120_000)), "<|endoftext|>".join(["ab" * 40, "x y"] * 3000), "lowering" * 60_000, "é" * 50_000, " \n" * 700_000 + "end"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), library)
    from tarnfall.llm.word_bpe import Bpe

    bpe = Bpe(open(tokenizer(PATH), encoding="utf-8").read())
    whole = bpe.encode_texts(texts[:2])
    monkeypatch.setattr(word_bpe, "RUN", 100)
    assert all((a == b).all() for a, b in zip(bpe.encode_texts(texts[:2]), whole, strict=True))
