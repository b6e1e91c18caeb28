"""A training corpus from raw documents: rules, toxicity, near-duplicates, a mix to target weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the session's shared
folder and read back as the next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.llm import block_mix, line_rules, near_copies, toxicity, word_bpe
from tarnfall.llm.registry import table, tokenizer
from tarnfall.llm.shared import scratch, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are left with little but their host's boilerplate, go; the others lose those lines.

    A line on over 200 texts of a host is boilerplate however large the host is.
    """
    return line_rules.keep_clean(docs, max_docs=200)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go; the classifier learns from the labelled documents that are left outside its held-out fold."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group stays that five-word shingles of similarity 0.8 or more connect.

    Candidates come from the SimHash trie join and from min-hash bands; each link is checked on the texts.
    """
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of each source up to its target, in whole documents and cuts at block ends; some documents come twice."""
    return block_mix.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of the decoded ids of each row."""
    ids = word_bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer("word_bpe_49k.json"), check=True)
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: SQL has neither the hashes nor the merges; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage has written on its way is deleted once its result is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
