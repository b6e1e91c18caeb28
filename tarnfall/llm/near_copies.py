"""Near copies by the Jaccard similarity of word shingles: the SimHash trie join and min-hash buckets give candidates,
every link is checked on the texts.

A text is in one bucket of the trie join (its component, :mod:`simhash_trie`, here over the hashes of its distinct
shingles) and in ``bands`` others, each the hash of ``rows`` minima over its shingles; two texts that share a bucket are
candidates. The trie join finds copies that differ in few bits whatever their length; texts of a similarity of 0.8 differ
in ten bits and more, which no trie join can search among many texts, so the bands make them candidates: with 32 bands of
6 rows a pair of similarity s is missed with probability (1 - s^6)^32, 6e-5 at 0.8, less above. A candidate is a link only
if the similarity of its two shingle sets reaches the limit, so texts that merely share a bucket stay apart. Most of those
are told apart before their texts are read: a sketch holds two bits of the least shingle hash in each of 512 bins, and of
the bins that either text fills, a pair of similarity s shares s on average. Pairs beyond 4.8 deviations of a pair at the
limit, one in a million, are left out.

First every text is compared with the first of its component of the trie join; links connect, and the bands start from what
is connected. Each text that still shares a band with other components is compared with one of them: of the first members of
its buckets, the first of all. These two steps connect most groups of copies, by at most as many comparisons each as there
are texts. Then only bands whose members are in several components
are looked at, and only pairs of different components: small buckets in full; in a large one the few of the highest
pseudorandom priority are compared with all others, then eight times as many, until all members are in one component or
all pairs have been compared. A pair is compared in the first of its shared buckets alone. No bucket is ever sorted or held in one task.

Defined results: words are in lower case A-Z. A text of fewer words than ``width`` is one shingle. Null, empty and blank
texts are copies of each other. Null ids come after all others; repeated rows are reduced to one. Two texts that collide
in 64 bits of their hash are kept apart by another 64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfall.llm.representatives import keep_least, text_keys
from tarnfall.llm.shared import bound_batches, broadcast_if_small, join_groups, saved
from tarnfall.llm.simhash_trie import components, majority, rooted
from tarnfall.llm.textkernel import SpanHash, Texts, mix, pieces, texts_of

#: buckets of so many members are paired in full at once; a larger one has about so many leads in the first round
SMALL = 8
#: bins of a text's sketch, a power of two
BINS = 512
SIGNATURE = "node long, n long, fp long, buckets array<long>, sketch array<long>"


def shingles(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending in each text, and where each text's begin."""
    t = t.lower()
    starts, ends, bounds = t.words()
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(begin[-1]) - np.repeat(begin[:-1] - bounds[:-1], count)
    hashes = SpanHash(t.hashes()(starts, ends))(first, first + np.repeat(np.minimum(n, width), count))
    text = np.repeat(np.arange(t.n), count)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(t.n + 1))


def buckets_of(hashes: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket of each text (first axis) in each band; texts without shingles share theirs."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    if len(full):
        for band in range(bands):
            key = np.full(len(full), band, np.uint64)
            for row in range(rows):
                salt, factor = mix(np.array([2 * (band * rows + row), 2 * (band * rows + row) + 1]))
                key = mix(key ^ np.minimum.reduceat((hashes ^ salt) * (factor | np.uint64(1)), bounds[full]))
            out[full, band] = key
    return out


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text two bits for each of :data:`BINS` bins, 32 bins to a number: 0 for an empty bin, else 1 to 3 by the
    least hash in it. hashes: ascending in each text; a bin is what begins with the same bits."""
    n = len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * BINS + (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    codes = np.zeros(n * BINS, np.uint64)
    codes[at[first]] = 1 + mix(hashes[first]) % np.uint64(3)
    return np.bitwise_or.reduce(codes.reshape(n, BINS // 32, 32) << (2 * np.arange(32, dtype=np.uint64)), axis=2)


def may_reach(a: str, b: str, similarity: float) -> Column:
    """Whether the sketches of two rows leave the similarity possible. A pair that reaches it has at most so many shingles
    in all (``whole``), and of a sample without replacement the deviation falls as the sample nears the whole."""
    odd, spread = F.lit(0x5555555555555555), 4.8 * math.sqrt(similarity * (1 - similarity))
    filled = lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd)).cast("double")
    whole = (F.col(f"{a}.n") + F.col(f"{b}.n")) / (1 + similarity)
    words = F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.struct(filled(x.bitwiseOR(y)).alias("either"), filled(x.bitwiseXOR(y)).alias("differ")))
    zero = F.struct(F.lit(0.0).alias("either"), F.lit(0.0).alias("differ"))

    def allowed(sums: Column) -> Column:
        left_out = F.greatest(F.lit(0.0), whole - sums.either) / F.greatest(F.lit(1.0), whole - 1)
        return sums.differ <= (1 - similarity) * sums.either + spread * F.sqrt(sums.either * left_out) + 2

    # a fold keeps the join's generated code small; written out, it is too large to be compiled
    return F.aggregate(words, zero, lambda s, w: F.struct((s.either + w.either).alias("either"), (s.differ + w.differ).alias("differ")), allowed)


def signatures(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """node, n (distinct shingles), fingerprint and the buckets of each text. texts: node, text."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                hashes, bounds = shingles(t, width)
                keys = [x.view(np.int64) for x in (buckets_of(hashes, bounds, bands, rows), sketches(hashes, bounds))]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in keys]
                prints = pa.array(majority(hashes, bounds).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(bounds), pa.int64()), prints, *lists], names=["node", "n", "fp", "buckets", "sketch"])

    return texts.mapInArrow(run, SIGNATURE)


def similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the similarity; a lead may be the ``a`` of very many."""
    nodes = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    some = saved(texts.join(broadcast_if_small(nodes, 200_000), "node", "left_semi").dropDuplicates(["node"]), "texts")
    width_of = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    leads = broadcast_if_small(some.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").toDF("a", "text"), 20_000, width_of, 16 << 20)
    both = pairs.join(some.toDF("b", "other"), "b").join(leads, "a").select("a", "b", "text", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                x, x_at = shingles(t, width)
                y, y_at = shingles(texts_of(part.column("other")), width)
                near = np.zeros(t.n, bool)
                for i in range(t.n):
                    one, other = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
                    shared = len(np.intersect1d(one, other, assume_unique=True))
                    near[i] = shared >= similarity * (len(one) + len(other) - shared)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def first_shared() -> Column:
    """Whether the rows' bucket is the first of those that both texts share: a pair is met in this one alone."""
    shared = F.filter(F.zip_with("x.buckets", "y.buckets", lambda a, b: F.when(a == b, a)), lambda b: b.isNotNull())
    return F.get(shared, F.lit(0)) == F.col("x.bucket")


def candidates(live: DataFrame, low: float, high: float, similarity: float) -> DataFrame:
    """Pairs (a, b): leads of a bucket, those of priority ranks about ``low`` to ``high``, with all members after them that
    are in another component and whose sketches allow the similarity. The priority is the node, a hash. live: bucket,
    size, node, n, sketch, buckets, root."""
    rank = F.shiftrightunsigned("node", 11).cast("double") / float(1 << 53) * F.col("size")
    ranked = live.withColumn("rank", F.when(F.col("size") <= SMALL, F.lit(low)).otherwise(rank))
    near = (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")) & may_reach("x", "y", similarity) & first_shared()
    leads, pairs = ranked.where((F.col("rank") >= low) & (F.col("rank") < high)), []
    for some in ("size <= 64", "size > 64"):  # of large buckets there are few leads: sent to the members, where they can be
        x = leads.where(some)
        x = (broadcast_if_small(saved(x, "leads"), 200_000) if ">" in some else x).alias("x")
        after = (F.struct("x.rank", "x.node") < F.struct("y.rank", "y.node")) & (F.col("x.root") != F.col("y.root")) & near
        pairs.append(ranked.where(some).alias("y").join(x, (F.col("x.bucket") == F.col("y.bucket")) & after).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    return pairs[0].unionByName(pairs[1])


def near_roots(texts: DataFrame, width: int, similarity: float, bands: int, rows: int, max_bits: int = 4) -> DataFrame:
    """node, root of every text that is near another. texts: node, text; a node may come more than once."""
    spark = texts.sparkSession
    signed = saved(signatures(texts, width, bands, rows).dropDuplicates(["node"]), "signatures")
    prints = saved(signed.groupBy("fp").agg(F.count("*").alias("m")), "distinct")
    of = saved(rooted(prints.select("fp"), max_bits).join(prints, "fp").select("fp", "m", F.xxhash64(F.lit("trie"), "root").alias("trie")), "of")
    banded = F.transform(F.array_distinct("buckets"), lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("band")))
    trie = F.array(F.struct(F.col("trie").alias("bucket"), F.lit(False).alias("band")))
    keyed = join_groups(signed, of, "fp", "m").select("node", "n", F.explode(F.concat(banded, trie)).alias("x")).select("node", "n", "x.*")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    live = saved(join_groups(keyed, saved(sizes.where("size > 1"), "sizes"), "bucket", "size"), "buckets")

    def first_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a")).select("a", "b")

    def connected(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        links = saved(similar(saved(pairs, "pairs"), texts, width, similarity), "links")
        if links.isEmpty():
            return roots
        return components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))  # what is connected already counts as one link for each member

    def several(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of buckets whose members are in several components, with these."""
        left = saved(rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "left")
        apart = left.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
        return saved(left.join(apart, "bucket", "left_semi"), "buckets")

    # of the trie's components, which join texts far below the limit by chains, only the first comparison is of use
    roots = connected(first_of(live.where("not band and node <> first")), spark.createDataFrame([], "node long, root long"))
    live = several(live.where("band").drop("first"), roots)
    heads = live.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.struct("node", "root")).alias("head"))
    heads = saved(heads.select("bucket", "m", F.col("head.node").alias("first"), F.col("head.root").alias("first_root")), "heads")
    pairs = first_of(join_groups(live, heads, "bucket", "m").where("root <> first_root"))
    low, high = 0.0, 0.0
    while not live.isEmpty():
        roots = connected(candidates(live, low, high, similarity) if high else pairs, roots)
        live = live if high else live.join(signed.select("node", "sketch", "buckets"), "node")
        live = several(live.where(F.col("size") > (max(SMALL, high) if high else 1)), roots)
        low, high = high, 8 * high if high else float(SMALL)
    return roots


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 6, max_bits: int = 4) -> DataFrame:
    """One document of each group of near copies stays, all columns: that with the least doc_id.

    A group is what pairs of ``similarity`` or more connect. An id on several texts is judged for each text.
    """
    keyed = docs.withColumns(text_keys())
    roots = near_roots(keyed.select(F.col("__one").alias("node"), "text"), width, similarity, bands, rows, max_bits)

    def named(texts: DataFrame) -> DataFrame:
        first = F.row_number().over(Window.partitionBy("__one").orderBy("__two")) == 1  # one row each, but for collisions
        group = F.when(F.col("first"), F.struct(F.coalesce("root", "__one").alias("a"), F.lit(0).cast("long").alias("b")))
        own = F.struct(F.col("__one").alias("a"), F.col("__two").alias("b"))
        rooted_texts = texts.withColumn("first", first).join(roots.withColumnRenamed("node", "__one"), "__one", "left")
        return rooted_texts.withColumn("root", group.otherwise(own)).drop("first")

    return keep_least(docs, named)
