"""Each stage of the pipeline against a plain version, on what the stage before it has kept."""

from __future__ import annotations

import hashlib
import os
from collections import Counter, defaultdict

import pytest
from test_block_mix import size_of
from test_line_rules import plain_verdicts
from test_near_copies import plain_kept

import corpus_pipeline
from tarnfall.llm import block_mix, toxicity
from tarnfall.llm.registry import tokenizer
from tarnfall.llm.shared import saved
from tarnfall.sources import tables

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, and what each stage has made of them."""
    docs = [spark.read.parquet(f"{DIR}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(saved(stage(spark, docs[-1], DIR), "stage"))
    return docs


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "SimHash near-dedup", "mixing", "BPE"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_rules(stages):
    rows = [(r.doc_id, r.source, r.text) for r in stages[0].collect()]
    want = {k for k, _, _, kept in plain_verdicts(rows, 50, 0.1, 0.2) if kept}
    assert {r.doc_id for r in stages[1].select("doc_id").collect()} == want and 0 < len(want) < len(rows)


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    scores = toxicity.score(stages[1], toxicity.train(stages[1], labels)).select("doc_id", "score").collect()
    want = {r.doc_id for r in scores if r.score < 0.3}
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == want and len(want) < len(scores)
    bad = {"moron", "loser", "scum", "clown", "stupid", "disgusting", "worthless", "idiot", "pathetic", "trash"}
    gone = {r.doc_id for r in stages[1].collect() if bad & set((r.text or "").lower().replace(".", " ").replace(",", " ").split())}
    assert len(gone & want) <= 0.05 * len(gone)


def test_near_duplicates(stages):
    """The least ids of what pairs of a five-word similarity of 0.8 or more connect, over all pairs."""
    want = plain_kept({r.doc_id: r.text for r in stages[2].collect()})
    assert {r.doc_id for r in stages[3].select("doc_id").collect()} == want and len(want) < stages[2].count()


def test_stage_on_repeated_and_null_ids(spark):
    a, b = "the first group has these eleven words in each of its rows", "another group with wholly different contents and some more words here"
    rows = [(1, a), (5, a), (5, b), (None, b), (None, a + " too"), (None, "a text of its own without any id and nothing like it anywhere"), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted([("1", a), ("5", b), ("None", rows[5][1]), ("8", None)], key=str)


def test_mix(stages):
    taken = {r.doc_id: r.taken for r in block_mix.Mix(stages[3]).by_document().collect() if r.taken}
    words, texts = defaultdict(int), {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        words[r.doc_id] += size_of(r.text)
        assert not Counter(r.text.split()) - Counter(texts[r.doc_id].split())
    assert dict(words) == taken


def test_encoding(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    want = []
    for r in stages[4].collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, list(r.ids), r.decoded_sha256) for r in stages[5].collect()]
    assert sorted(got) == sorted(want)


def test_no_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, DIR), "stage")
        assert docs.count() == 0


def test_run_leaves_the_stages_only(spark, monkeypatch):
    """All stages in one go; of what they write on their way only their results stay in the shared folder."""
    made = []
    monkeypatch.setattr(tables, "shared_dir", lambda session, name, make=tables.shared_dir: made.append(make(session, name)) or made[-1])
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "decoded_sha256" in out.columns
    left = [m for m in made if os.path.exists(m.removeprefix("file:"))]
    assert len(left) == len(corpus_pipeline.STAGES) < len(made)
