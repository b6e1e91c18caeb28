"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are the bit majorities of XXH64 hashes of word shingles. Distinct fingerprints are blocked by the pigeonhole
principle: with ``max_bits`` differing bits and one block more than that, two linked fingerprints agree in a block. Each
block value's fingerprints form a binary trie (a sorted array whose ranges are the nodes) that is joined with itself:
pairs of nodes descend together, accumulate differing bits, and are dropped beyond the error budget - or once everything
below both nodes is known to be in one component, which keeps dense groups of copies near-linear without losing a link.
Only component edges leave a task, never all pairs. A block value with many fingerprints is cut into hashed chunks, and
its pairs of chunks go to tasks of their own.

Defined results: null, empty and blank texts have fingerprint zero and link like any other. Null ids are kept as rows
but name no component unless a component has no other id. Repeated rows come back as often as they occur from
:func:`simhash_groups`, once from :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfall.llm.representatives import keep_least, text_keys
from tarnfall.llm.shared import bound_batches, broadcast_if_small, join_groups, saved
from tarnfall.llm.textkernel import Texts, pieces

BITS = 64


#: shingles whose bits are unpacked at once
BLOCK = 1 << 16


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose shingles' hashes lie between successive bounds: bits set in over half of them."""
    count = np.diff(bounds)
    full = np.flatnonzero(count)
    ones = np.zeros((len(full), BITS), np.int64)
    for lo in range(0, len(hashes), BLOCK):
        hi = min(lo + BLOCK, len(hashes))
        first, last = np.searchsorted(bounds[full], lo, side="right") - 1, np.searchsorted(bounds[full], hi) - 1
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[first : last + 1] += np.add.reduceat(bits, np.maximum(bounds[full[first : last + 1]] - lo, 0), axis=0, dtype=np.int32)
    out = np.zeros(len(count), np.uint64)
    out[full] = np.packbits(2 * ones > count[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints_of(t: Texts, width: int, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text."""
    data, digest, hashes, count = t.lower().data, xxhash.xxh64_intdigest, [np.zeros(0, np.uint64)], np.zeros(t.n, np.int64)
    for i, (lo, hi) in enumerate(zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True)):
        words = data[lo:hi].tobytes().split()  # white space of bytes is the same as that of the words
        if not words:
            continue
        flat = b" ".join(words)
        starts = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
        n = max(1, len(words) - width + 1)
        ends = starts[min(width, len(words)) :] - 1
        for k in range(0, n, BLOCK):
            spans = zip(starts[k : min(k + BLOCK, n)].tolist(), ends[k : min(k + BLOCK, n)].tolist(), strict=True)
            hashes.append(np.fromiter((digest(flat[a:b], seed) for a, b in spans), np.uint64, min(BLOCK, n - k)))
        count[i] = n
    return majority(np.concatenate(hashes), np.concatenate([[0], np.cumsum(count)]))


def fingerprints(docs: DataFrame, width: int = 4, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and fp, the fingerprint as a signed long, of every document."""
    bound_batches(docs.sparkSession)
    names = [*carry, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(fingerprints_of(t, width).view(np.int64))], names=names)

    return docs.select(*carry, "text").mapInArrow(run, T.StructType([*docs.select(*carry).schema, T.StructField("fp", T.LongType())]))


class Components:
    """Component of each position of an array, as the least position in it."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the components of the paired positions."""
        while True:
            low, high = np.minimum(self.of[a], self.of[b]), np.maximum(self.of[a], self.of[b])
            if (low == high).all():
                return
            np.minimum.at(self.of, high, low)
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up


def trie_join(values: np.ndarray, roots: np.ndarray, depth: int, max_bits: int) -> np.ndarray:
    """Components of sorted distinct 64-bit values, where values under one root link at up to ``max_bits`` differing bits.

    roots: the first position of each root node, whose values agree in ``depth`` leading bits.
    """
    n = len(values)
    parts = Components(n)
    edge = np.append(roots, n)
    # neighbours in sorted order first: most of a dense group falls together before any pair descends
    near = np.flatnonzero(np.bitwise_count(values[1:] ^ values[:-1]) <= max_bits)
    near = near[~np.isin(near + 1, roots)]
    parts.link(near, near + 1)
    a_lo, a_hi, diff = edge[:-1].copy(), edge[1:].copy(), np.zeros(len(roots), np.int64)
    b_lo, b_hi = a_lo.copy(), a_hi.copy()
    for bit in range(BITS - 1 - depth, -1, -1):
        if not len(a_lo):
            break
        # one component below both nodes: no link there is news
        change = np.append(np.flatnonzero(np.diff(parts.of)) + 1, n)
        end = lambda lo: change[np.searchsorted(change, lo, side="right")]  # noqa: B023, E731
        news = (end(a_lo) < a_hi) | (end(b_lo) < b_hi) | (parts.of[a_lo] != parts.of[b_lo])
        # few pairs below two nodes: compare their values outright
        small = (a_hi - a_lo) * (b_hi - b_lo) <= 64
        leaf = news & small
        size = ((a_hi - a_lo) * (b_hi - b_lo))[leaf]
        for lo in range(0, len(size), 1 << 14):
            pick = np.flatnonzero(leaf)[lo : lo + (1 << 14)]
            k = np.arange(size[lo : lo + (1 << 14)].sum()) - np.repeat(np.cumsum(size[lo : lo + (1 << 14)]) - size[lo : lo + (1 << 14)], size[lo : lo + (1 << 14)])
            which = np.repeat(pick, size[lo : lo + (1 << 14)])
            wide = (b_hi - b_lo)[which]
            x, y = a_lo[which] + k // wide, b_lo[which] + k % wide
            hit = np.bitwise_count(values[x] ^ values[y]) <= max_bits
            parts.link(x[hit], y[hit])
        go = news & ~small
        a_lo, a_hi, b_lo, b_hi, diff = a_lo[go], a_hi[go], b_lo[go], b_hi[go], diff[go]
        split = lambda lo, hi: np.clip(np.searchsorted(values, ((values[lo] >> np.uint64(bit)) | np.uint64(1)) << np.uint64(bit)), lo, hi)  # noqa: B023, E731
        a_mid, b_mid = split(a_lo, a_hi), split(b_lo, b_hi)
        own = a_lo == b_lo
        nodes = [
            (a_lo, a_mid, b_lo, b_mid, diff, np.ones(len(own), bool)), (a_mid, a_hi, b_mid, b_hi, diff, np.ones(len(own), bool)),
            (a_lo, a_mid, b_mid, b_hi, diff + 1, np.ones(len(own), bool)), (a_mid, a_hi, b_lo, b_mid, diff + 1, ~own),
        ]
        ok = [o & (al < ah) & (bl < bh) & (d <= max_bits) for al, ah, bl, bh, d, o in nodes]
        a_lo, a_hi, b_lo, b_hi, diff = (np.concatenate([node[i][k] for node, k in zip(nodes, ok, strict=True)]) for i in range(5))
    return parts.of


def rotate(fp: Column, by: int) -> Column:
    """The bits rotated to the left."""
    return fp if by % BITS == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def links(fps: DataFrame, max_bits: int, task_rows: int = 1024, max_chunks: int = 64) -> DataFrame:
    """Edges (a, b), a < b as signed longs, that connect what links of distinct fingerprints ``fp`` connect.

    fps: a saved table of distinct values. A block value is cut up if it has over ``task_rows`` fingerprints and over
    four times the mean; the rows of a cut group are sent to as many tasks as it has chunks, ``max_chunks`` at most.
    """
    spark = fps.sparkSession
    blocks = max_bits + 1
    width = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    shift = [sum(width[:i]) for i in range(blocks)]
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), rotate(F.col("fp"), shift[i]).alias("rot")) for i in range(blocks)))).alias("x")).select("fp", "x.*")
    value = F.element_at(F.array(*(F.shiftrightunsigned("rot", BITS - w) for w in width)), F.col("block") + 1)
    keyed = keyed.withColumn("value", value)
    sizes = saved(keyed.groupBy("block", "value").agg(F.count("*").alias("size")), "sizes")  # as many rows as there are block values at most
    bound = max(task_rows, 4 * (sizes.agg(F.avg("size")).first()[0] or 0))
    chunks = F.least(F.lit(max_chunks), F.ceil(2 * F.col("size") / F.lit(float(bound)))).cast("int")
    hot = saved(sizes.where(F.col("size") > bound).select("block", "value", chunks.alias("chunks")), "hot")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pair = F.when(
        F.col("chunks").isNotNull(),
        F.expr("transform(filter(sequence(0, chunks - 1), i -> i <> own or chunks = 1), i -> least(i, own) * 65536L + greatest(i, own))"),
    ).otherwise(F.array(F.lit(-1).cast("long")))
    dealt = (
        keyed.join(broadcast_if_small(hot), ["block", "value"], "left").withColumn("own", own)
        .select("fp", "block", "rot", "value", F.explode(pair).alias("pair"))
        .repartition("block", "value", "pair").sortWithinPartitions("block", "value", "pair", F.col("rot") < 0, "rot")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            """Edges of whole groups: rows are block, value, pair, rotated value."""
            out = [np.zeros((2, 0), np.int64)]
            runs = np.flatnonzero(np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)) + 1
            starts = np.concatenate([[0], runs])
            # groups with one block and ascending values are one sorted array with several roots
            fresh = np.concatenate([[True], (rows[0][runs] != rows[0][runs - 1]) | (rows[1][runs] == rows[1][runs - 1])])
            for lo, hi in zip(np.flatnonzero(fresh), [*np.flatnonzero(fresh)[1:], len(starts)], strict=True):
                begin, stop = starts[lo], starts[hi] if hi < len(starts) else rows.shape[1]
                block, values = int(rows[0, begin]), rows[3, begin:stop].view(np.uint64)
                part = trie_join(values, starts[lo:hi] - begin, width[block], max_bits)
                more = np.flatnonzero(part != np.arange(len(part)))
                back = lambda v: (v >> np.uint64(shift[block]) | v << np.uint64(BITS - shift[block]) if shift[block] else v).view(np.int64)  # noqa: B023, E731
                x, y = back(values[more]), back(values[part[more]])
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            a, b = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "value", "pair", "rot")])
            if not rows.shape[1]:
                continue
            new = np.flatnonzero(np.any(rows[:3, 1:] != rows[:3, :-1], axis=0))
            if held and (rows[:3, 0] != held[-1][:3, -1]).any():
                yield edges(np.concatenate(held, axis=1))
                held = []
            if len(new):
                yield edges(np.concatenate([*held, rows[:, : new[-1] + 1]], axis=1))
                held = [rows[:, new[-1] + 1 :]]
            else:
                held.append(rows)
        if held:
            yield edges(np.concatenate(held, axis=1))

    return dealt.select("block", "value", "pair", "rot").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the edges (a, b): rounds of joining each node to its least neighbour, then contracting.

    Every round writes its tables to the shared folder; the edges left shrink until none joins two roots.
    """
    edges = saved(edges, "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.count("*").alias("degree"))
        hook = saved(hook.select("node", F.least("node", "low").alias("root"), "degree"), "hook")
        if roots is None:
            roots = hook.select("node", "root")
        else:
            sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
            up = saved(sizes.join(hook.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("root", F.coalesce("up", "root").alias("up"), "n"), "up")
            roots = saved(join_groups(roots, up, "root", "n").select("node", F.col("up").alias("root")), "roots")
        for end in ("a", "b"):  # a node with very many edges, the first of a dense group, is not dealt to one task
            edges = join_groups(edges, hook.select(F.col("node").alias(end), F.col("root").alias("up"), "degree"), end, "degree").drop(end, "degree").withColumnRenamed("up", end)
        edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(fps: DataFrame, max_bits: int) -> DataFrame:
    """fp, root of every distinct fingerprint: the trie join's components, a fingerprint without a link being its own root."""
    roots = components(links(fps, max_bits))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable) of every document."""
    fps = saved(fingerprints(docs, width), "fingerprints")
    least = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct")
    of = saved(least.join(rooted(least.select("fp"), max_bits), "fp"), "of")
    ids = saved(of.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("m")), "ids")
    named = saved(join_groups(of, ids, "root", "m").select("fp", "component_id", "n"), "named")
    return join_groups(fps, named, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each component stays, all columns: that with the least doc_id (null last), of rows with one id that whose
    text's digest is least; rows that repeat both are reduced to one."""
    prints = saved(fingerprints(docs.withColumns(text_keys()), width, ("__one", "__two")).distinct(), "prints")
    sizes = saved(prints.groupBy("fp").agg(F.count("*").alias("n")), "distinct")
    of = saved(rooted(sizes.select("fp"), max_bits).join(sizes, "fp"), "of")
    roots = join_groups(prints, of, "fp", "n").select("__one", "__two", "root")
    return keep_least(docs, lambda texts: texts.join(roots, ["__one", "__two"]))
