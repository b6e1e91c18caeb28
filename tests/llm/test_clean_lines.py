from test_line_rules import WORD, lower

import corpus_pipeline
from tarnfall.llm import line_rules


def test_texts_lose_their_boilerplate(spark):
    """Lines of a host that 60 of its texts have are not in the stage's output; all else stays byte for byte."""
    own = "own words of page {0} that are  enough\tto stay in the corpus\n\n  end of page {0}"
    rows = [(i, f"Home  | About | CONTACT\n{own.format(i)}\nhome | about | contact ", "site", 1) for i in range(60)]
    rows += [(100 + i, f"Home | About | Contact\n{own.format(i)}", "other", 7) for i in range(3)]
    rows += [(200, f"Home | About | Contact\n{own.format(0)}", None, 7), (300, "Home | About | Contact\n" * 9 + "three words more", "site", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    want = {i: (own.format(i), len(own.format(i))) for i in range(60)}
    want |= {k: (t, n) for k, t, _, n in rows[60:-1]}
    assert got == want


def test_cleaned_texts_agree_with_the_counts(spark, sf_dir, odd_docs, no_docs):
    rules = {"min_docs": 2, "max_share": 0.01, "keep_share": 0.6}
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs, no_docs):
        kept = line_rules.keep_clean(docs, **rules)
        assert kept.columns == docs.columns
        counts = line_rules.line_rules(docs, **rules).where("kept").collect()
        words = lambda r: len(WORD.findall(lower(r.text or "")))
        assert sorted((str(r.doc_id), words(r)) for r in kept.collect()) == sorted((str(r.doc_id), r.n_words - r.boilerplate_words) for r in counts)


def test_the_limit_does_not_grow_with_the_host(spark):
    """A line on 230 of a host's 2,500 texts, less than a tenth, goes; one on 150 stays, and so do all documents."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    line = lambda i: "Back to the start page\n" if i < 230 else "Rarely seen line\n" if i < 380 else ""
    docs = spark.createDataFrame([(i, line(i) + own(i), "hot") for i in range(2500)], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert got == {i: (line(i) if i >= 230 else "") + own(i) for i in range(2500)}
