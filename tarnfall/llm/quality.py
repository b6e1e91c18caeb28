"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every word (a run of letters or of symbols) has a sparse random index vector made from its hash; its context vector is the
sum of the index vectors of its neighbours over all documents. The ``OWN`` most frequent words of all documents have rows
of their own; the others share ``BUCKETS`` rows by hash, so the table has a fixed size at any size of the corpus: tasks
send sums, the driver gets one row of each word or bucket, and the broadcast table is 5 MB.

A document is its pooled vectors and nothing else: mean and deviation of its words' context vectors, and how much its
words' index vectors, weighted down for frequent words, add up (a text that says the same again and again has a long sum).
The network is fitted on a bounded sample of labelled rows; a temperature fitted on a part of it that the training does
not see calibrates the probabilities.

Defined results: null and empty texts have the zero vector and get its score. Without labels of both kinds the score is
the share of good labels (0.5 without any). Repeated rows and null ids are scored like any other. Labels, language,
source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfall.llm.labels import training_rows
from tarnfall.llm.shared import bound_batches
from tarnfall.llm.textkernel import Texts, mix, pieces

OWN, BUCKETS, DIM, NONZERO, WINDOW = 1 << 15, 1 << 13, 32, 4, 2
#: components of the index vectors whose sums measure repetition, and documents summed at once
WIDE, AT_ONCE = 256, 4096
FEATURES = 2 * DIM + 1


def words_of(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where each document's begin."""
    starts, ends, _, bounds = t.runs()
    return t.hashes()(starts, ends), bounds


def index_vectors(hashes: np.ndarray, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The components of the words' index vectors that are not zero: place and sign, ``NONZERO`` times."""
    bits = mix(hashes ^ np.uint64(0x5EED))
    for k in range(NONZERO):
        part = bits >> np.uint64(16 * k)
        yield (part & np.uint64(dim - 1)).astype(np.int64), np.where((part >> np.uint64(15)) & np.uint64(1), 1.0, -1.0)


class Vectors:
    """Context vectors of all words: ``own``, the sorted hashes of the words with a row of their own, then the buckets."""

    def __init__(self, own: np.ndarray, units: np.ndarray, weights: np.ndarray):
        self.own, self.units, self.weights = own, units, weights

    @staticmethod
    def rows(own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        bucket = len(own) + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        if not len(own):
            return bucket
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        return np.where(own[at] == hashes, at, bucket)


def add_contexts(t: Texts, own: np.ndarray, table: np.ndarray) -> None:
    """Adds the neighbours' index vectors to the words' rows, and 1 to their last column."""
    hashes, bounds = words_of(t)
    doc, row, n, size = np.repeat(np.arange(t.n), np.diff(bounds)), Vectors.rows(own, hashes), len(hashes), len(table)
    for place, sign in index_vectors(hashes, DIM):
        for step in range(1, WINDOW + 1):
            near = np.flatnonzero(doc[step:] == doc[: n - step]) if n > step else np.zeros(0, np.int64)
            at = np.concatenate([row[near] * DIM + place[near + step], row[near + step] * DIM + place[near]])
            table[:, :DIM] += np.bincount(at, np.concatenate([sign[near + step], sign[near]]), minlength=size * DIM).reshape(size, DIM).astype(np.int64)
    table[:, DIM] += np.bincount(row, minlength=size)


def frequent_words(docs: DataFrame, most: int = OWN) -> np.ndarray:
    """The sorted hashes of the ``most`` most frequent words of all documents."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, t in pieces(batch, "text", 4 << 20):
                word, n = np.unique(words_of(t)[0].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n, pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()
    return np.sort(top.column("word").to_numpy().view(np.uint64))


def context_sums(docs: DataFrame, own: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors and the number of occurrences, by row; from all documents."""
    bound_batches(docs.sparkSession)
    columns, size = [f"d{i}" for i in range(DIM + 1)], len(own) + BUCKETS
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((size, DIM + 1), np.int64)

        def sums() -> pa.RecordBatch:
            full = np.flatnonzero(table[:, DIM])
            out = pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *(pa.array(table[full, i], pa.int32()) for i in range(DIM + 1))], names=["row", *columns])
            table[:] = 0
            return out

        for batch in batches:
            for _, t in pieces(batch, "text", 4 << 20):
                add_contexts(t, shared.value, table)
                if table[:, DIM].max() > 1 << 26:  # far from what an int holds
                    yield sums()
        yield sums()

    parts = docs.select("text").mapInArrow(run, "row long, " + ", ".join(f"{c} int" for c in columns))
    got = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # as many rows as the table has at most
    out = np.zeros((size, DIM + 1), np.int64)
    if got.num_rows:
        out[got.column("row").to_numpy()] = np.stack([got.column(c).to_numpy() for c in columns], axis=1)
    return out


def context_vectors(docs: DataFrame) -> Vectors:
    """The unit context vector of each row, and a weight that falls with its frequency."""
    own = frequent_words(docs)
    table = context_sums(docs, own).astype(float)
    units = table[:, :DIM] / np.maximum(np.linalg.norm(table[:, :DIM], axis=1, keepdims=True), 1)
    share = table[:, DIM] / max(table[:, DIM].sum(), 1)
    return Vectors(own, units.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32))


def repetition(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document the squared length of the weighted sum of its words' index vectors, over what unlike words would
    give; as a logarithm."""
    out = np.zeros(len(bounds) - 1)
    for lo in range(0, len(out), AT_ONCE):
        hi = min(lo + AT_ONCE, len(out))
        part = slice(bounds[lo], bounds[hi])
        doc, w = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1])), weights[part].astype(float)
        sums = np.zeros((hi - lo) * WIDE)
        for place, sign in index_vectors(hashes[part], WIDE):
            sums += np.bincount(doc * WIDE + place, sign * w, minlength=len(sums))
        unlike = NONZERO * np.bincount(doc, w * w, minlength=hi - lo)
        out[lo:hi] = np.log(np.square(sums.reshape(-1, WIDE)).sum(axis=1) / np.maximum(unlike, 1e-9) + 0.1)
    return out


def document_vectors(t: Texts, vectors: Vectors) -> np.ndarray:
    """Mean and deviation of the words' context vectors of each text, and its repetition."""
    hashes, bounds = words_of(t)
    row = Vectors.rows(vectors.own, hashes)
    out, full = np.zeros((t.n, FEATURES)), np.flatnonzero(np.diff(bounds))
    if len(full):
        n = np.diff(bounds)[full, None]
        for k in range(DIM):  # a component at a time: words times components would be large
            x = vectors.units[:, k][row].astype(float)
            mean = np.add.reduceat(x, bounds[full]) / n[:, 0]
            out[full, k] = mean
            out[full, DIM + k] = np.sqrt(np.maximum(np.add.reduceat(x * x, bounds[full]) / n[:, 0] - mean * mean, 0))
        out[full, 2 * DIM] = repetition(hashes, vectors.weights[row], bounds)[full]
    return out


class Network:
    """Input scaling, two layers (tanh, linear) and a temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.parts = (mean, scale, w1, b1, w2, b2, temperature)

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2, temperature = self.parts
        return (np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2) / temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, totals: list[int], hidden: int = 16, steps: int = 600, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on the log loss (classes weighted as they occur), then the temperature with the least log loss on every fifth row."""
    width = x.shape[1]
    if len(set(y.tolist())) < 2:
        rate = (totals[1] + 0.5) / (sum(totals) + 1)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order], y[order].astype(float)
    weight = np.where(y == 1, totals[1] / max(y.sum(), 1), totals[0] / max((1 - y).sum(), 1))
    spare = np.arange(len(y)) % 5 == 4
    if len(set(y[spare].tolist())) < 2 or len(set(y[~spare].tolist())) < 2:
        spare[:] = False
    use = ~spare
    mean, scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-3
    p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    s, goal, part = (x[use] - mean) / scale, y[use], weight[use] / weight[use].sum()
    for step in range(1, steps + 1):
        h = np.tanh(s @ p[0] + p[1])
        d = part * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - goal)
        back = np.outer(d, p[2]) * (1 - h * h)
        for i, g in enumerate((s.T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], d.sum(keepdims=True))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, *p)
    if not spare.any():
        return net
    z = net.logits(x[spare])
    loss = lambda t: float(np.sum(weight[spare] * (np.logaddexp(0, z / t) - y[spare] * z / t)))
    return Network(mean, scale, *p, min(np.geomspace(0.25, 8, 60).tolist(), key=loss))


def vectors_of(rows: DataFrame, vectors: Vectors, net: Network | None) -> DataFrame:
    """Rows with ``text``: in its place ``vector`` (no network) or ``score``."""
    bound_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((vectors.own, vectors.units, vectors.weights, net and net.parts))
    names = [c for c in rows.columns if c not in ("text", "score" if net else "vector")]
    last = T.StructField("score", T.DoubleType()) if net else T.StructField("vector", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *table, parts = shared.value
        for batch in batches:
            for part, t in pieces(batch, "text"):
                x = document_vectors(t, Vectors(*table))
                out = pa.array(Network(*parts).scores(x)) if parts else pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), out], names=[*names, last.name])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), last]))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, fold: int = 0, per_class: int = 4096) -> tuple[Vectors, Network]:
    """docs: doc_id, text. labels: doc_id, quality. Word vectors from all documents, the network from at most
    ``per_class`` labelled documents of each kind."""
    vectors = context_vectors(docs)
    rows, totals = training_rows(docs, labels, "quality", modulus, fold, per_class)
    got = vectors_of(rows.select("label", "text"), vectors, None).toArrow()
    x = np.array(got.column("vector").to_pylist(), float).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, FEATURES))
    return vectors, fit(x, got.column("label").to_numpy(), totals)


def score(docs: DataFrame, vectors: Vectors, net: Network) -> DataFrame:
    """The documents with ``score``, the probability of good quality, in place of ``text`` and of any ``score``."""
    return vectors_of(docs, vectors, net)
