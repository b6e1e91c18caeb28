"""The queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.llm import block_mix, decontaminate, hash_ring, kd_topk, line_rules, periodic_runs, prefix_trie, quality, simhash_trie, token_files, toxicity, warc, word_bpe
from tarnfall.llm.labels import held_out
from tarnfall.llm.oracles import ORACLES as _SQL
from tarnfall.llm.shared import saved

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judged(scored: DataFrame, modulus: int, fold: int) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, fold).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 4, 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(quality.score(docs, *quality.train(docs, table(spark, sf_dir, "labels"))), 5, 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 49407)


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.simhash_groups(table(spark, sf_dir, "documents"))


def op5_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hash_ring.shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer(name: str) -> str:
    """Where a public tokenizer file is installed; not imported until a query needs it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_mix.Mix(table(spark, sf_dir, "documents")).by_document()


def op10_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def with_repetitions(docs: DataFrame) -> DataFrame:
    """Every tenth document or so, by the CRC-32 of its id, repeats its words from some place on with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
    placed = words.withColumn("n", F.expr("nullif(size(w), 0)")).withColumn("a", F.expr("int(g % n)")).withColumn("p", F.expr("1 + int((n - a) div (3 + g % 8))"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), 1 + int((n - a) div p))), 1, n - a))")
    return placed.select("doc_id", F.coalesce(F.array_join(again, " "), "text").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_repetitions(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    sums = {"runs_sha256": F.sha2(lines, 256), "collapsed_sha256": F.sha2("collapsed", 256)}
    values = ["bigint(size(runs)) AS n_runs", "-x.s AS start", "x.length AS length", "-x.p AS period", "1000 * x.length div -x.p AS exponent_milli"]
    return found.withColumn("x", longest).withColumns(sums).selectExpr("doc_id", *values, *sums)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    hit = decontaminate.hit_words()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed, (hit > 0).alias("contaminated"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and their ids. turns: saved. A conversation begins with up to eight turns of the
    one whose id ends its group of five; a key of the join has at most five conversations and eight turns."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h")
    ids = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h)
    first = turns.where("pos <= 8").withColumnRenamed("conv_id", "base")
    begun = ids.join(first, "base").where("pos <= h").select("conv_id", "pos", "digest", "bytes")
    return begun.unionByName(turns.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string")) % 9)), ids.select("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = saved(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.nodes(prefix_trie.sequences(*rebuilt_turns(turns)))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_token_files": op3_token_files,
    "op4_simhash_trie": op4_simhash_trie,
    "op5_hash_ring": op5_hash_ring,
    "op6_word_bpe": op6_word_bpe,
    "op7_line_rules": op7_line_rules,
    "op8_warc": op8_warc,
    "op9_block_mix": op9_block_mix,
    "op10_kd_topk": op10_kd_topk,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_decontaminate": op12_decontaminate,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = dict(_SQL)
