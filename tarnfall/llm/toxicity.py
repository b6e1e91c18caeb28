"""Toxicity: a sparse logistic model over words and word beginnings, with counterfactual regularisation.

In labelled texts identity terms are swapped for another term of their group and for a neutral word; the squared
difference of the model's logit between a text and its swapped copy is a penalty of the fit. Weight that a group's name
has picked up from the company it keeps is thereby taken off, and neutral mentions stop being false positives.

The model is fitted on a bounded sample of labelled rows (``per_class`` of each label); features are chosen by how much
more often they occur in one class. Texts without identity terms have no swaps: on a corpus that has none the penalty does
nothing, and the model is a plain sparse logistic one (``Model.swapped`` counts the texts that had any). Every text is scored whole: the sum of the weights of the distinct features in it.

Defined results: null and empty texts get the score of no feature at all. Without labels of both kinds the score is the
share of toxic labels (0 without any). Repeated rows and null ids are scored like any other. Labels, language, source and
id are no inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfall.llm.labels import training_rows
from tarnfall.llm.shared import bound_batches, saved
from tarnfall.llm.textkernel import Texts, mix, pieces, texts_of

BEGINNINGS = (4, 5, 6, 8)
#: Identity terms by group; the first of a group is its neutral word.
IDENTITIES = (
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "sikh"),
    ("persons", "women", "men", "girls", "boys", "gays", "lesbians", "immigrants", "refugees", "foreigners"),
    ("person", "woman", "man", "girl", "boy", "lesbian", "immigrant", "refugee", "foreigner"),
    ("human", "gay", "straight", "transgender", "queer", "black", "white", "asian", "african", "mexican", "arab", "disabled", "deaf", "blind", "old"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "noirs", "homosexuels"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwule"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "negros", "gays"),
)
MOST_TERMS = 10_000


class Swaps:
    """Replaces the identity terms of a text by another of their group."""

    def __init__(self, groups: tuple[tuple[str, ...], ...] = IDENTITIES):
        self.group_of = {term.lower(): group for group in reversed(groups) for term in group[1:]}
        terms = sorted(map(re.escape, self.group_of), key=len, reverse=True)
        self.term = re.compile(r"(?<!\w)(" + "|".join(terms) + r")(?!\w)" if terms else r"(?!)", re.IGNORECASE)

    def __call__(self, text: str, by: int) -> str:
        """Each term gives way to the neutral word (0), or to the term so many places on in its group."""

        def other(m: re.Match) -> str:
            group = self.group_of.get(m[0].lower())
            if group is None:  # a letter whose lower case is another in this context
                return m[0]
            place = [x.lower() for x in group].index(m[0].lower(), 1)
            return group[0] if not by else group[1 + (place - 1 + by) % (len(group) - 1)]

        return self.term.sub(other, text)

    def copies(self, text: str, swaps: int) -> list[str]:
        """The swapped copies of a text; none if it has no term."""
        return [self(text, k) for k in range(swaps)] if self.term.search(text) else []


def groups_of(terms: DataFrame) -> tuple[tuple[str, ...], ...]:
    """Identity terms from a table of your own: grp, place, term. Of each group the term of the least place is its neutral
    word. At most ``MOST_TERMS`` rows, as they become one pattern."""
    rows = terms.select("grp", "place", "term").where("term is not null").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} identity terms")
    found: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        found.setdefault(str(r.grp), []).append((r.place, r.term))
    return tuple(tuple(term for _, term in sorted(found[g])) for g in sorted(found))


def features(t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and of their beginnings, in lower case, with the document of each."""
    t = t.fold()
    starts, ends, kind, bounds = t.runs()
    doc = np.repeat(np.arange(t.n), np.diff(bounds))[kind == 1]
    starts, ends = starts[kind == 1], ends[kind == 1]
    spans = t.hashes()
    yield mix(spans(starts, ends)), doc
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        yield mix(spans(starts[long], starts[long] + n) ^ np.uint64(n)), doc[long]


def distinct_features(text: str) -> np.ndarray:
    return np.unique(np.concatenate([h for h, _ in features(texts_of(pa.array([text])))]))


def sample_features(rows: DataFrame, groups: tuple[tuple[str, ...], ...], swaps: int) -> DataFrame:
    """label, and sets: the distinct features of each labelled text and of its swapped copies. Saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = Swaps(groups)
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sets = [distinct_features(x).view(np.int64) for x in (text or "", *swap.copies(text or "", swaps))]
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([sets], pa.list_(pa.list_(pa.int64())))], names=["label", "sets"])

    return saved(rows.select("label", "text").mapInArrow(run, "label int, sets array<array<long>>"), "features")


def chosen_features(sample: DataFrame, least_docs: int = 3, least_z: float = 3.5, most_features: int = 20_000) -> np.ndarray:
    """Sorted hashes of the features whose shares of the two labels' texts differ most; counted in Spark."""
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return np.zeros(0, np.uint64)
    counts = sample.select("label", F.explode(F.col("sets")[0]).alias("feature")).groupBy("feature").agg(F.sum("label").alias("bad"), F.count("*").alias("docs"))
    share = F.col("docs") / F.lit(n[0] + n[1])
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * F.lit(1 / n[0] + 1 / n[1]))
    z = F.abs((F.col("bad") / F.lit(n[1]) - (F.col("docs") - F.col("bad")) / F.lit(n[0])) / spread)
    top = counts.where(F.col("docs") >= min(least_docs, *n.values())).withColumn("z", z).where(F.col("z") >= least_z)
    keys = top.orderBy(F.desc("z"), "feature").limit(most_features).select("feature").toArrow()
    return np.sort(keys.column("feature").to_numpy().view(np.uint64))


def chosen_only(sample: DataFrame, keys: np.ndarray) -> pa.Table:
    """label, and sets of the places of the chosen features in ``keys``."""
    shared = sample.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sets")
            inner = lists.flatten()
            flat = inner.flatten().to_numpy().view(np.uint64)
            place = np.searchsorted(shared.value, flat)
            hit = (shared.value[np.minimum(place, max(len(shared.value) - 1, 0))] == flat) if len(shared.value) else np.zeros(len(flat), bool)
            sums = np.concatenate([[0], np.cumsum(hit)])
            bounds = sums[np.concatenate([[0], np.cumsum(inner.value_lengths().to_numpy())]).astype(np.int64)]
            sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place[hit], pa.int32()))
            outer = pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(outer, sets)], names=["label", "sets"])

    return sample.mapInArrow(run, "label int, sets array<array<int>>").toArrow()


class Model:
    """Sorted feature hashes with weights, and the bias; ``swapped`` counts the fitted texts that had an identity term."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, swapped: int = 0):
        self.keys, self.weights, self.bias, self.swapped = keys, weights, bias, swapped
        self.sieve = np.zeros(1 << 20, bool)  # lets almost no feature without a weight through to the exact search
        self.sieve[keys & np.uint64(len(self.sieve) - 1)] = True

    def logits(self, t: Texts) -> np.ndarray:
        out = np.full(t.n, self.bias)
        if not len(self.keys):
            return out
        at, of = [], []
        for hashes, doc in features(t):
            some = np.flatnonzero(self.sieve[hashes & np.uint64(len(self.sieve) - 1)])
            place = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
            hit = self.keys[place] == hashes[some]
            at.append(place[hit])
            of.append(doc[some[hit]])
        pairs = np.unique(np.concatenate(of) * len(self.keys) + np.concatenate(at))
        return out + np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], minlength=t.n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(sample: pa.Table, keys: np.ndarray, totals: list[int], penalty: float, steps: int = 400, ridge: float = 0.02) -> Model:
    """Adam on the weighted log loss, plus ridge, plus ``penalty`` times the mean squared logit change of the swaps."""
    labels = sample.column("label").to_numpy().astype(np.int64)
    if len(set(labels.tolist())) < 2:
        rate = totals[1] / max(sum(totals), 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))))
    lists = sample.column("sets").combine_chunks()
    copies = lists.value_lengths().to_numpy()
    sets = lists.flatten()
    col, size = sets.flatten().to_numpy(), sets.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(copies) - copies
    original = np.zeros(len(size), bool)
    original[first] = True
    doc = np.repeat(np.arange(len(labels)), copies)
    n = np.array([(labels == c).sum() for c in (0, 1)])
    weight = (np.array(totals) / n)[labels]
    weight /= weight.sum()
    swap = np.flatnonzero(~original)
    source = first[doc[swap]]
    w, bias = np.zeros(len(keys)), float(np.log(totals[1] / totals[0]))
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for step in range(1, steps + 1):
        logit = bias + np.bincount(row, w[col], minlength=len(size))
        grad = np.zeros(len(size))
        grad[first] = weight * (sigmoid(logit[first]) - labels)
        if len(swap):
            change = 2 * penalty * (logit[source] - logit[swap]) / len(swap)
            np.add.at(grad, source, change)
            grad[swap] -= change
        g = np.append(np.bincount(col, grad[row], minlength=len(w)) + ridge * w / len(labels), grad[first].sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(keys, w, bias, int((copies > 1).sum()))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, fold: int = 2, per_class: int = 4096, penalty: float = 1.0, swaps: int = 3, terms: DataFrame | None = None) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. terms: identity terms of your own (see :func:`groups_of`), else
    ``IDENTITIES``. Of the sample of at most 2 * per_class texts the driver gets the chosen features only."""
    bound_batches(docs.sparkSession)
    rows, totals = training_rows(docs, labels, "toxic", modulus, fold, per_class)
    sample = sample_features(rows, IDENTITIES if terms is None else groups_of(terms), swaps)
    keys = chosen_features(sample)
    return fit(chosen_only(sample, keys), keys, totals, penalty)


def score(docs: DataFrame, model: Model, column: str = "score", keep_text: bool = False) -> DataFrame:
    """The documents with ``column``, the probability of toxicity, in place of any column of that name and, unless it is
    kept, of ``text``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))  # at most most_features keys
    names = [c for c in docs.columns if c != column and (keep_text or c != "text")]
    loaded: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded[:] = loaded or [Model(*shared.value)]
        for batch in batches:
            for part, t in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sigmoid(loaded[0].logits(t)))], names=[*names, column])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), T.StructField(column, T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents scored below the threshold, all columns."""
    return score(docs, model, "__score", keep_text=True).where(F.col("__score") < threshold).select(docs.columns)
