"""Quality rules with cross-document line frequency.

Every document is tokenised once: its own counts, and a hash with word count for each of its normalised lines (words in
lower case A-Z joined by one space). Lines of one host that occur in more than ``max(min_docs, max_share * documents of
the host)`` of its documents with different texts are boilerplate. Copies of one text are one document here: otherwise a
text that is copied often enough would be its own boilerplate, and its first copy would be rejected with all others. A
document with less than ``keep_share`` of its words left without them is depleted and rejected. :func:`line_rules` counts
their words, :func:`keep_good` returns whole texts, :func:`keep_clean` returns the texts without these lines.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Null hosts form one host.
Repeated rows come back as often as they occur; equal texts count once for a line. An empty table gives an empty result.
Extra columns are ignored by :func:`line_rules` and kept by :func:`keep_good` and :func:`keep_clean`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfall.llm.shared import bound_batches, broadcast_if_small, saved
from tarnfall.llm.textkernel import SPACE, Texts, SpanHash, mix, pieces, sums_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PROFILE = "__row long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<int>"


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def repeat_words(words: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Words of each document that lie in a window of ``width`` words found twice or more in it."""
    n, doc = len(words), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    covered = np.zeros(n + 1, np.int64)
    if n >= width:
        first = np.arange(n - width + 1)
        first = first[doc[: n - width + 1] == doc[width - 1 :]]
        twice = first[repeated(mix(SpanHash(words)(first, first + width) ^ mix(doc[first])))]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + width, -1)
    return sums_of((np.cumsum(covered[:n]) > 0).astype(np.int64), bounds)


def profile(t: Texts, width: int) -> dict[str, object]:
    """The counts of each text and its lines' hashes and word counts."""
    starts, ends, bounds = t.words()
    exact, lower = t.hashes(), t.lower().hashes()
    words = exact(starts, ends)
    line_from, line_to, line_bounds = t.lines()
    first, last = np.searchsorted(starts, line_from), np.searchsorted(starts, line_to)
    full = last > first
    line_doc = np.repeat(np.arange(t.n), np.diff(line_bounds))[full]
    keys = mix(exact(line_from[full], line_to[full]) ^ mix(line_doc))
    n_lines = np.bincount(line_doc, minlength=t.n)
    distinct = np.bincount(line_doc[np.unique(keys, return_index=True)[1]], minlength=t.n)
    solid = ~SPACE[t.data]
    return {
        "text_hash": exact(t.offsets[:-1], t.offsets[1:]).view(np.int64),
        "n_words": np.diff(bounds),
        "word_chars": t.count(solid & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.count(SYMBOLS[t.data]),
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": repeat_words(words, bounds, width),
        "line_bounds": np.concatenate([[0], np.cumsum(n_lines)]),
        "line_hashes": SpanHash(lower(starts, ends))(first[full], last[full]).view(np.int64),
        "line_words": (last - first)[full].astype(np.int32),
    }


def profiles(docs: DataFrame, width: int, carry: list[str]) -> DataFrame:
    """One row for each document, without its text; with the carried columns and ``__row``, a number of its own (drawn at
    random for each task, so it is fixed once the table is saved)."""
    bound_batches(docs.sparkSession)
    schema = T.StructType([*docs.select(*carry).schema, *T.StructType.fromDDL(PROFILE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = uuid.uuid4().int >> 66
        for batch in batches:
            for part, t in pieces(batch, "text"):
                p = profile(t, width)
                p["row"], row = np.arange(row, row + t.n), row + t.n
                offsets = pa.array(p["line_bounds"], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(p[k])) for k in ("line_hashes", "line_words")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carry), pa.array(p["row"]), part.column("host"), *(pa.array(p[k], pa.int64()) for k in ("text_hash", *COUNTS)), *lists],
                    names=[*carry, "__row", "host", "text_hash", *COUNTS, "line_hashes", "line_words"],
                )

    return docs.mapInArrow(run, schema)


def boilerplate(lines: DataFrame, min_docs: int, max_share: float, max_docs: int | None = None) -> DataFrame:
    """host, line: the hashes of the boilerplate lines of each host.

    lines: a saved table of :func:`profiles`. Counts are summed before each shuffle; only lines whose plain row count
    is above the limit, which are few, are counted by distinct texts.
    """
    hosts = lines.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    each = lines.select("host", "text_hash", F.explode(F.array_distinct("line_hashes")).alias("line"))
    some = saved(each.groupBy("host", "line").agg(F.count("*").alias("rows")).where(F.col("rows") > min_docs), "lines")
    found = (
        each.alias("e").join(broadcast_if_small(some, 200_000).alias("s"), F.col("e.host").eqNullSafe(F.col("s.host")) & (F.col("e.line") == F.col("s.line")), "left_semi")
        .select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count("*").alias("texts"))
    )
    share = F.col("host_docs") * max_share
    over = F.col("texts") > F.greatest(F.lit(float(min_docs)), share if max_docs is None else F.least(share, F.lit(float(max_docs))))
    return found.alias("f").join(hosts.alias("h"), F.col("f.host").eqNullSafe(F.col("h.host"))).where(over).select("f.host", "line")


def base_fails(min_words: int, repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def line_rules(docs: DataFrame, width: int = 5, min_words: int = 10, repeat_percent: int = 20, min_docs: int = 50, max_share: float = 0.1, keep_share: float = 0.2, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and verdict of every document.

    docs: text, source (the host) and the columns to carry. Returns those, the counts, boilerplate_words, base_failed
    and kept. The base rules reject texts of under ``min_words`` words, or with over ``repeat_percent`` percent of the
    words in repeated windows.
    """
    lines = saved(profiles(docs.select(*carry, "text", F.col("source").alias("host")), width, list(carry)), "profiles")
    often = broadcast_if_small(saved(boilerplate(lines, min_docs, max_share), "often"), 200_000)
    each = lines.select("__row", "host", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("x")).select("__row", "host", F.col("x.line_hashes").alias("line"), F.col("x.line_words").alias("words"))
    removed = each.alias("e").join(often.alias("o"), F.col("e.host").eqNullSafe(F.col("o.host")) & (F.col("e.line") == F.col("o.line")), "left_semi")
    removed = removed.groupBy("__row").agg(F.sum("words").cast("long").alias("boilerplate_words"))
    marked = lines.join(removed, "__row", "left")
    failed = base_fails(min_words, repeat_percent)
    left = F.col("n_words") - F.col("boilerplate_words")
    return (
        marked.select(*carry, *COUNTS, F.coalesce("boilerplate_words", F.lit(0).cast("long")).alias("boilerplate_words"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= keep_share * F.col("n_words")))
    )


def text_keys() -> dict[str, Column]:
    """The host and two digests of the text."""
    return {"__host": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "__hash": F.xxhash64("text"), "__size": F.coalesce(F.octet_length("text"), F.lit(-1))}


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The documents that :func:`line_rules` keeps, all columns and whole texts.

    The verdict depends on the text and its host alone, so rows are matched to the rejected (host, text) pairs by two
    digests of the text: repeated or null ids do no harm, and the anti join's large side can be split where it is skewed.
    """
    keys = text_keys()
    keyed = docs.withColumns(keys)
    bad = line_rules(keyed, carry=tuple(keys), **rules).where("not kept").select(*keys).distinct()
    return keyed.join(bad, list(keys), "left_anti").drop(*keys)


def without_lines(t: Texts, gone: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text without the lines whose hashes are in its list, its words, and its words left."""
    starts, ends, bounds = t.words()
    line_from, line_to, line_bounds = t.lines()
    first, last = np.searchsorted(starts, line_from), np.searchsorted(starts, line_to)
    keys = SpanHash(t.lower().hashes()(starts, ends))(first, last).view(np.int64)
    n = np.diff(bounds)
    texts, left, data = [], n.copy(), t.data.tobytes()
    for i in range(t.n):
        own = np.arange(line_bounds[i], line_bounds[i + 1])
        drop = np.isin(keys[own], gone[i].values.to_numpy()) & (last[own] > first[own])
        left[i] -= (last - first)[own][drop].sum()
        texts.append(b"\n".join(data[a:b] for a, b in zip(line_from[own[~drop]].tolist(), line_to[own[~drop]].tolist(), strict=True)).decode())
    return texts, n, left


def keep_clean(docs: DataFrame, width: int = 5, min_words: int = 10, repeat_percent: int = 20, min_docs: int = 50, max_share: float = 0.1, keep_share: float = 0.2, max_docs: int | None = None) -> DataFrame:
    """The documents that :func:`line_rules` keeps, all columns, without the boilerplate lines of their hosts.

    Other lines stay byte for byte; ``n_chars`` follows a changed text. Each text is matched to its own boilerplate lines
    only, and the verdict is that of the words left in it.
    """
    keys = text_keys()
    keyed = docs.withColumns(keys)
    lines = saved(profiles(keyed.select(*keys, "text", F.col("source").alias("host")), width, list(keys)), "profiles")
    often = broadcast_if_small(saved(boilerplate(lines, min_docs, max_share, max_docs), "often"), 200_000)
    each = lines.select(*keys, "host", F.explode("line_hashes").alias("line"))
    has = each.alias("e").join(often.alias("o"), F.col("e.host").eqNullSafe(F.col("o.host")) & (F.col("e.line") == F.col("o.line")), "left_semi").groupBy(*keys).agg(F.collect_set("line").alias("__gone"))
    bad = lines.where(base_fails(min_words, repeat_percent)).select(*keys).distinct()
    has = saved(has.join(bad, list(keys), "left_anti"), "has")
    plain = keyed.join(bad.unionByName(has.select(*keys)), list(keys), "left_anti").select(docs.columns)
    marked = keyed.join(broadcast_if_small(has, width=8 * F.size("__gone") + 96), list(keys)).select(*docs.columns, "__gone")
    bound_batches(docs.sparkSession)
    out = T.StructType([*marked.drop("text", "__gone").schema, *T.StructType.fromDDL("text string, __clean string, __words long, __left long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                texts, n, left = without_lines(t, part.column("__gone"))
                columns = [c for c in out.names if not c.startswith("__")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(left, pa.int64())], names=[*columns, "__clean", "__words", "__left"])

    cleaned = marked.mapInArrow(run, out).where(F.col("__left") >= keep_share * F.col("__words")).withColumn("text", F.col("__clean"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return plain.unionByName(cleaned.select(docs.columns))
