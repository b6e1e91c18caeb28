"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.llm.shared import saved


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id's decimal text, modulo; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def held_out(doc_id: Column, modulus: int, fold: int) -> Column:
    return F.coalesce(remainder(doc_id, modulus) == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, modulus: int, fold: int, per_class: int) -> tuple[DataFrame, list[int]]:
    """doc_id, text, label of at most ``per_class`` documents of each label (the first in hash order) outside the held-out
    fold, and how many labels of each kind there are outside it. A repeated id counts once; of different labels of one id
    the larger one holds."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    known = known.where(remainder(F.col("doc_id"), modulus) != fold)
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    picked = saved(some[0].unionByName(some[1]), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])  # at most 2 * per_class labels
    return rows, [totals.get(0, 0), totals.get(1, 0)]
