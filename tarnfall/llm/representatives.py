"""One row of each group of texts, on rows of any ids: null, repeated, or shared by unlike texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.llm.shared import saved


def text_keys() -> dict[str, Column]:
    """Two digests of the text, 128 bits together; null is the empty text."""
    text = F.coalesce("text", F.lit(""))
    return {"__one": F.xxhash64(text), "__two": F.xxhash64(F.lit("two"), text)}


def keep_least(docs: DataFrame, named: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The row of each group with the least doc_id (null last), then the least digest, all columns of ``docs``.

    named: adds ``root``, the group, to a table of the distinct texts' digests __one and __two (see :func:`text_keys`). Only
    ids and digests are grouped; the texts are matched by them. Rows that repeat id and text are reduced to one.
    """
    keyed = docs.withColumns(text_keys())
    key = ["doc_id", "__one", "__two"]
    ids = saved(keyed.groupBy(*key).agg(F.count("*").alias("times")), "ids")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    texts = named(ids.groupBy("__one", "__two").agg(F.min(order).alias("least_id")))
    stays = texts.groupBy("root").agg(F.min(F.struct("least_id", "__one", "__two")).alias("least")).select("least.*")
    stays = saved(stays.select("least_id.doc_id", "__one", "__two"), "stays")
    gone = saved(ids.join(stays, _same(ids, stays), "left_anti").select(key), "gone")
    again = saved(ids.where("times > 1").join(stays, _same(ids, stays), "left_semi").select(key), "again")
    kept = keyed.join(gone, _same(keyed, gone), "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(again, _same(kept, again), "left_semi").dropDuplicates(key)
    return kept.join(again, _same(kept, again), "left_anti").unionByName(once).select(docs.columns)


def _same(rows: DataFrame, others: DataFrame) -> Column:
    """Equal id (null to null) and digests."""
    return rows["doc_id"].eqNullSafe(others["doc_id"]) & (rows["__one"] == others["__one"]) & (rows["__two"] == others["__two"])
