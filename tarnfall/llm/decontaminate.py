"""Benchmark decontamination: word windows of benchmark items found in documents by a Wu-Manber multi-pattern search.

Words are runs of letters a-z (A-Z in lower case), digits and characters beyond ASCII. A window is ``width`` consecutive
words of an item; an item of fewer words, but not none, is one window. Windows of one length share tables: a shift table
over hashes of word pairs says how far the next window end may lie behind a pair, so most positions are never looked at;
where the shift is zero, the hash of that last pair selects a bucket of windows, in which the hash of the whole window
selects the test windows, and a direct comparison of the words' bytes decides. Documents are cut into stretches of window
ends that all move on together, a shift at a time.

Benchmarks are cut into pieces of bounded length in Spark and searched in blocks of at most about ``block_bytes`` of
words: one block's tables are broadcast at a time, their size is measured first, and each further block is one more pass
over the documents, whose hits so far are carried along in a written table. Documents are neither shuffled nor grouped.

Defined results: null and empty texts have no words and no hits. Items with a null id mark hits, but are not listed; an id
on several rows is one item. Repeated document rows come back as often as they occur; an empty benchmark hits nothing and
an empty table gives an empty result. Carried columns named ``n_words``, ``hits`` or ``items`` give way to the operator's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfall.llm.shared import bound_batches, saved
from tarnfall.llm.textkernel import BASE, Texts, mix, pieces, texts_of

#: lower case of the bytes of words, a space for all others
FOLDED = np.full(256, 0x20, np.uint8)
FOLDED[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
FOLDED[65:91] = np.arange(97, 123)
OWN = ("n_words", "hits", "items")
FOUND = "n_words long, hits array<struct<start: long, length: long>>, items array<string>"
#: window ends of a document that one lane of the search goes through
STRETCH = 96
#: words of one piece of an item
PIECE = 4096


class Words:
    """The words of some texts: hashes on demand, direct comparison."""

    def __init__(self, t: Texts):
        t = Texts(FOLDED[t.data], t.offsets)
        self.starts, self.ends, self.bounds = t.words()
        self.data, self.hash, self.n = t.data, t.hashes(), t.n

    def pair(self, last: np.ndarray, width: int) -> np.ndarray:
        """Hash of the two words (of windows of one word: the word) that end with word ``last``."""
        own = self.hash(self.starts[last], self.ends[last])
        return own if width == 1 else mix(self.hash(self.starts[last - 1], self.ends[last - 1]) * np.uint64(BASE) + own)

    def window(self, first: np.ndarray, width: int) -> np.ndarray:
        """Hash of the ``width`` words from word ``first`` on."""
        total = np.zeros(len(first), np.uint64)
        for k in range(width):
            total = total * np.uint64(BASE) + self.hash(self.starts[first + k], self.ends[first + k])
        return mix(total)

    def equal(self, first: np.ndarray, other: Words, place: np.ndarray, width: int) -> np.ndarray:
        """Whether the ``width`` words from ``first`` on are those of ``other`` from ``place`` on, byte for byte."""
        same = np.ones(len(first), bool)
        for k in range(width):
            live = np.flatnonzero(same)
            a, b = first[live] + k, place[live] + k
            size = self.ends[a] - self.starts[a]
            fits = size == other.ends[b] - other.starts[b]
            same[live[~fits]] = False
            live, a, b, size = live[fits], self.starts[a[fits]], other.starts[b[fits]], size[fits]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            unlike = self.data[np.repeat(a, size) + step] != other.data[np.repeat(b, size) + step]
            same[np.repeat(live, size)[unlike]] = False
        return same


def first_not_less(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each range lo..hi of sorted values, the first place whose value is not less than x."""
    lo, hi = lo.copy(), hi.copy()
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        less = values[mid] < x[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
    return lo


class Windows:
    """Search tables of all distinct windows of one length: those of the items' words that begin at ``first``."""

    def __init__(self, words: Words, first: np.ndarray, items: np.ndarray, width: int):
        self.words, self.width = words, width
        self.block = min(2, width)
        suffix, whole = words.pair(first + width - 1, width), words.window(first, width)
        order = np.lexsort((items, whole, suffix))
        first, items, suffix, whole = first[order], items[order], suffix[order], whole[order]
        if len(first):  # equal windows in a row are one, with several items
            again = np.concatenate([[False], (suffix[1:] == suffix[:-1]) & (whole[1:] == whole[:-1])])
            again[again] = words.equal(first[again], words, first[np.flatnonzero(again) - 1], width)
            at = np.flatnonzero(~again)
        else:
            at = np.zeros(0, np.int64)
        self.first, self.whole = first[at], whole[at]
        self.items, self.item_bounds = items, np.append(at, len(items))
        self.suffixes, start = np.unique(suffix[at], return_index=True)
        self.buckets = np.append(start, len(at))
        self.bits = np.uint64(64 - max(12, int(4 * len(at)).bit_length()))
        self.shift = np.full(1 << int(64 - self.bits), width - self.block + 1, np.uint8)
        for end in range(self.block, width + 1):
            np.minimum.at(self.shift, (words.pair(self.first + end - 1, width) >> self.bits).astype(np.int64), width - end)

    def ends(self, words: Words) -> np.ndarray:
        """Last words of the document windows at which the shift is zero."""
        lo, hi = words.bounds[:-1] + self.width - 1, words.bounds[1:]
        lanes = -(-np.maximum(hi - lo, 0) // STRETCH)
        doc = np.repeat(np.arange(words.n), lanes)
        at = lo[doc] + STRETCH * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop, found = np.minimum(at + STRETCH, hi[doc]), []
        while len(at):
            shift = self.shift[(words.pair(at, self.width) >> self.bits).astype(np.int64)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word of each occurrence, and which window it is."""
        ends = self.ends(words)
        suffix = words.pair(ends, self.width)
        bucket = np.minimum(np.searchsorted(self.suffixes, suffix), max(0, len(self.suffixes) - 1))
        has = self.suffixes[bucket] == suffix if len(self.suffixes) else np.zeros(len(ends), bool)
        first, bucket = ends[has] - self.width + 1, bucket[has]
        whole, stop = words.window(first, self.width), self.buckets[bucket + 1]
        at = first_not_less(self.whole, self.buckets[bucket], stop, whole)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live := np.flatnonzero(at < stop)):  # windows of one hash follow each other
            live = live[self.whole[at[live]] == whole[live]]
            same = words.equal(first[live], self.words, self.first[at[live]], self.width)
            found.append((first[live[same]], at[live[same]]))
            first, whole, at, stop = first[live], whole[live], at[live] + 1, stop[live]
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """The items of some windows."""
        size = self.item_bounds[windows + 1] - self.item_bounds[windows]
        return self.items[np.repeat(self.item_bounds[windows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Block:
    """All windows of some items or pieces of items, by length, and the items' ids (null: listed nowhere)."""

    def __init__(self, ids: list[str | None], texts: list[str], width: int):
        self.ids = sorted({x for x in ids if x is not None})
        number = {x: i for i, x in enumerate(self.ids)}
        item = np.array([number.get(x, -1) for x in ids], np.int64)
        words = Words(texts_of(pa.array(texts, pa.large_string())))
        size = np.diff(words.bounds)
        self.groups = []
        for length in sorted(set(np.minimum(size, width).tolist()) - {0}):
            own = np.flatnonzero(np.minimum(size, width) == length)
            each = size[own] - length + 1
            first = np.repeat(words.bounds[own] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            self.groups.append(Windows(words, first, np.repeat(item[own], each), length))

    def search(self, t: Texts, hits: pa.ListArray, items: pa.ListArray) -> list[pa.Array]:
        """n_words, hits and items of each text; those found before are kept."""
        words = Words(t)
        edge = np.zeros(len(words.starts) + 1, np.int64)
        before = hits.flatten()
        doc = np.repeat(np.arange(t.n), hits.value_lengths().to_numpy())
        start = words.bounds[doc] + before.field("start").to_numpy()
        np.add.at(edge, start, 1)
        np.add.at(edge, start + before.field("length").to_numpy(), -1)
        found: dict[int, list[np.ndarray]] = {}
        for group in self.groups:
            first, window = group.occurrences(words)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + group.width, -1)
            doc = np.searchsorted(words.bounds, first, side="right") - 1
            order = np.lexsort((window, doc))
            doc, window = doc[order], window[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (window[1:] != window[:-1])
            doc, window = doc[new], window[new]
            cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=-1)) if len(doc) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found.setdefault(int(doc[lo]), []).append(group.items_of(window[lo:hi]))
        lists = items.to_pylist()
        for d, some in found.items():
            numbers = np.unique(np.concatenate(some))
            lists[d] = sorted({*lists[d], *(self.ids[i] for i in numbers.tolist() if i >= 0)})
        hit = np.zeros(len(words.starts) + 2, np.int8)
        hit[1:-1] = np.cumsum(edge[:-1]) > 0
        marks = np.zeros(len(words.starts) + 1, bool)
        marks[words.bounds] = True  # a stretch ends with its document
        begins = np.flatnonzero((hit[1:-1] > 0) & ((hit[:-2] == 0) | marks[:-1]))
        stops = np.flatnonzero((hit[1:-1] > 0) & ((hit[2:] == 0) | marks[1:])) + 1
        at = np.searchsorted(begins, words.bounds)
        base = np.repeat(words.bounds[:-1], np.diff(at))
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64())])
        stretches = pa.StructArray.from_arrays([pa.array(begins - base), pa.array(stops - begins)], fields=list(kind))
        return [pa.array(np.diff(words.bounds)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), stretches), pa.array(lists, pa.list_(pa.string()))]


def item_pieces(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id as text, and the words of each item in pieces that share ``width`` - 1 words, so that no window is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                words = Words(t)
                for row, (lo, hi) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
                    for at in range(lo, max(lo + 1, hi - width + 1) if hi > lo else lo, PIECE):
                        span = range(at, min(hi, at + PIECE + width - 1))
                        text = b" ".join(words.data[words.starts[i] : words.ends[i]].tobytes() for i in span)
                        yield pa.RecordBatch.from_arrays([part.column("item_id").slice(row, 1), pa.array([text.decode()])], names=["item_id", "text"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, text string")


def blocks_of(benchmark: DataFrame, width: int, block_bytes: int) -> tuple[DataFrame, int]:
    """The saved pieces with their ``block``, and the number of blocks, each measured to hold at most twice ``block_bytes``."""
    rows = saved(item_pieces(benchmark, width).distinct(), "benchmark")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block_bytes))
    while True:
        placed = rows.withColumn("block", F.expr(f"pmod(xxhash64(item_id, text), {n})"))
        most = placed.groupBy("block").agg(F.sum(F.octet_length("text")).alias("s"), F.max(F.octet_length("text")).alias("one")).orderBy(F.desc("s")).first()
        if most is None or most.s <= max(2 * block_bytes, 2 * most.one):
            return placed, n
        n *= 2


def search(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The carried columns with ``n_words``, ``hits`` (stretches of words that occurrences of windows cover) and
    ``items`` (ids of the items with occurring windows, sorted as strings). benchmark: item_id, text."""
    spark = docs.sparkSession
    bound_batches(spark)
    carry = [c for c in carry if c not in OWN]
    kept = [f"c{i}" for i in range(len(carry))]
    none = [F.expr(f"cast(array() AS {kind})").alias(name) for name, kind in (("hits", "array<struct<start: bigint, length: bigint>>"), ("items", "array<string>"))]
    out = docs.select(*(F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), *none)
    schema = T.StructType([*out.select(*kept, "text").schema, *T.StructType.fromDDL(FOUND)])
    rows, n = blocks_of(benchmark, width, block_bytes)
    for i in range(n):
        own = rows.where(F.col("block") == i).select("item_id", "text").collect()  # a block at a time, of bounded size
        block = spark.sparkContext.broadcast(Block([r.item_id for r in own], [r.text for r in own], width))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, t in pieces(batch, "text"):
                    found = block.value.search(t, part.column("hits"), part.column("items"))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*kept, "text")), *found], names=schema.names)

        out = out.mapInArrow(run, schema)
        if i + 1 < n:
            out = saved(out, "searched")
    return out.select(*(F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)), *OWN)


def hit_words() -> Column:
    """How many words of a searched document are hit."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h.length)


def keep_clean(docs: DataFrame, benchmark: DataFrame, max_hit: int = 0, **options) -> DataFrame:
    """The documents with at most ``max_hit`` hit words, with all their columns but those of the operator's names."""
    found = search(docs, benchmark, tuple(docs.columns), **options)
    return found.where(hit_words() <= max_hit).drop(*OWN)
