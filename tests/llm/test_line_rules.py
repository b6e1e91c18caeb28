import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tarnfall.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_verdicts(rows, min_docs, max_share, keep_share):
    """rows: (key, host, text). Kept by base rules and line frequency."""
    seen, texts = defaultdict(set), defaultdict(set)
    for _, host, text in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if words := WORD.findall(lower(line)):
                seen[host, " ".join(words)].add(text)
    limit = {h: max(min_docs, max_share * len(t)) for h, t in texts.items()}
    out = []
    for key, host, text in rows:
        n, _, _, _, again = plain_counts(text)
        failed = n < 10 or 100 * again > 20 * n
        gone = sum(len(w) for line in (text or "").split("\n") if (w := WORD.findall(lower(line))) and len(seen[host, " ".join(w)]) > limit[host])
        out.append((key, failed, gone, not failed and n - gone >= keep_share * n))
    return out


def check(docs, **rules):
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    want = [(k, *plain_counts(t), gone, failed, kept) for (k, _, t), (_, failed, gone, kept) in zip(rows, plain_verdicts(rows, rules.get("min_docs", 50), rules.get("max_share", 0.1), rules.get("keep_share", 0.2)), strict=True)]
    got = [(r.doc_id, *(r[c] for c in line_rules.COUNTS), r.boilerplate_words, r.base_failed, r.kept) for r in line_rules.line_rules(docs, **rules).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    return want


def test_documents_against_plain_counts(spark, sf_dir):
    want = check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert any(w[7] for w in want)


def test_low_limits_remove_lines(spark, sf_dir):
    want = check(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_docs=2, max_share=0.01, keep_share=0.9)
    assert any(w[6] for w in want)


def test_odd_documents(odd_docs, no_docs):
    check(odd_docs)
    check(no_docs)


def test_boilerplate_depletes(spark):
    banner = "Subscribe to our newsletter for more of this every single week\n"
    rows = [(i, "site", banner * 1 + f"own words of page {i}") for i in range(60)] + [(i, "other", f"{banner}text {i} of another host that has few pages") for i in range(60, 80)]
    rows += [(100 + i, "site", banner) for i in range(30)]  # equal texts count once
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = check(docs, keep_share=0.5)
    assert {w[0] for w in want if w[-1]} == set(range(60, 80))
    kept = line_rules.keep_good(docs.withColumn("n_words", F.lit("clash")), keep_share=0.5)
    assert {r.doc_id for r in kept.collect()} == set(range(60, 80))
    assert kept.columns == ["doc_id", "source", "text", "n_words"]


def test_keep_good_on_odd_documents(odd_docs, no_docs):
    kept = line_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    want = sorted(str(r.doc_id) for r in line_rules.line_rules(odd_docs).where("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert line_rules.keep_good(no_docs).count() == 0
