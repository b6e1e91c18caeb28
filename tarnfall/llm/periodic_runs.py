"""Periodic runs of words, found by heavy/light lag counting, and texts with the repetitions taken out.

A run is a stretch of words with smallest period q that holds ``min_words`` words and two periods at least and that no
neighbouring word extends. At lag q it is an island: ``max(min_words - q, q)`` or more consecutive positions whose word
equals the one q later. So for each document the matches at each lag are counted first. Words that are frequent in it are
counted for all lags at once by a Fourier autocorrelation (counts are whole numbers far below the error of a double, so
rounding gives them exactly), the others by the differences of their positions. Only lags with enough matches are
scanned. An island of m positions holds a multiple of m, so those positions are looked at first, with their neighbours;
lags that still stand are compared word by word. A run explains its share of the matches at the multiples of its
period, which is taken off their counts: a text of one word alone costs one scan.

Each document is one row and is handled alone, in the batch it comes in: no shuffle, nothing on the driver. Memory is a
few dozen bytes for each byte of the batch, or of the longest text.

Defined results: words are runs of characters other than space and ``\\t\\n\\v\\f\\r``. A null or empty text has no words,
no runs, and an empty collapsed text. Repeated rows come back as often as they occur; an empty table gives an empty
result. Carried columns named ``runs`` or ``collapsed`` give way to the operator's own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnfall.llm.shared import bound_batches
from tarnfall.llm.textkernel import SPACE, Texts, pieces

RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: so many differences or positions are held at a time
CHUNK = 1 << 19
#: neighbours of a matching position that are looked at before a lag is scanned
LOOK = 64
#: lags from each to the next are looked at together
BANDS = (1, 16, 256, 4096, 1 << 62)


def word_codes(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words; where documents begin; the words' bytes and lengths."""
    starts, ends, bounds = t.words()
    lengths, solid = ends - starts, t.data[~SPACE[t.data]]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    return words.dictionary_encode().indices.to_numpy(), bounds, solid, lengths


def heavy_from(n: int) -> float:
    """In a text of n words, words that occur more often cost less by Fourier transform than by pairs."""
    size = transform_size(n)
    return (size * np.log2(size) / 3 + 6000) ** 0.5


def transform_size(n: int) -> int:
    """A power of two that holds n words and lags up to n / 2 without wrapping round."""
    return 1 << int(n + n // 2).bit_length()


def fourier_counts(places: list[np.ndarray], n: int) -> np.ndarray:
    """Matches at lags 0 .. n // 2 of some words, given each one's places: two words go into each complex transform."""
    size, power = transform_size(n), 0.0
    for at in range(0, len(places), 2):
        z = np.zeros(size, np.complex128)
        z[places[at]] = 1
        if at + 1 < len(places):
            z[places[at + 1]] = 1j
        z = np.fft.fft(z)
        power = power + (z.real**2 + z.imag**2)
    return np.rint(np.fft.ifft(power).real[: n // 2 + 1]).astype(np.int64)


def lag_counts(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of each document at lags 0 .. words // 2, one after another, and where each document's counts begin."""
    sizes = np.diff(bounds)
    slots = np.concatenate([[0], np.cumsum(sizes // 2 + 1)])
    counts = np.zeros(slots[-1], np.int64)
    if not len(codes):
        return counts, slots
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = doc * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    often = np.diff(np.append(first, len(key)))
    limit = np.array([heavy_from(int(n)) for n in sizes])[doc[order[first]]]
    heavy = often > limit
    for d in np.unique(doc[order[first[heavy]]]):
        own = np.flatnonzero(heavy & (doc[order[first]] == d))
        places = [order[first[i] : first[i] + often[i]] - bounds[d] for i in own]
        counts[slots[d] : slots[d + 1]] += fourier_counts(places, int(sizes[d]))
    # pairs of the k-th next place of each word: places whose word has no more, or whose lag is too long, fall out
    last = np.repeat(first + often, often)
    at = np.flatnonzero(np.repeat(~heavy, often))
    half, base = (sizes // 2)[doc[order]], slots[:-1][doc[order]]
    held, k = [], 1
    while len(at):
        at = at[at + k < last[at]]
        lag = order[at + k] - order[at]
        near = lag <= half[at]
        at, lag = at[near], lag[near]
        held.append(base[at] + lag)
        if sum(map(len, held)) > CHUNK or not len(at):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held = []
        k += 1
    return counts, slots


def reach(codes: np.ndarray, at: np.ndarray, lag: np.ndarray, edge: np.ndarray, step: int, most: np.ndarray) -> np.ndarray:
    """How many positions from ``at`` on, stepping by ``step`` before ``edge``, match at the lag in a row, up to ``most``."""
    found, live = np.zeros(len(at), np.int64), np.arange(len(at))
    for k in range(1, LOOK):
        live = live[(most[live] > k) & ((edge[live] - at[live]) * step > k)]
        here = at[live] + step * k
        live = live[codes[here] == codes[here + lag[live]]]
        if not len(live):
            break
        found[live] += 1
    return found


def standing(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, lag: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which (document from begin to end, lag) may have an island of ``need`` positions: every need-th position is tried."""
    ok = np.zeros(len(lag), bool)
    tries = -(-np.maximum(end - lag - begin, 0) // need)
    ends = np.cumsum(tries)
    lo = 0
    while lo < len(lag):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
        own = np.repeat(np.arange(lo, hi), tries[lo:hi])
        at = np.arange(len(own)) - np.repeat(ends[lo:hi] - tries[lo:hi] - (ends[lo] - tries[lo]), tries[lo:hi])
        at = begin[own] + at * need[own]
        hit = codes[at] == codes[at + lag[own]]
        own, at = own[hit], at[hit]
        most = np.minimum(need[own], LOOK)
        after = reach(codes, at, lag[own], end[own] - lag[own], 1, most)
        before = reach(codes, at, lag[own], begin[own] - 1, -1, most)
        ok[own[after + before + 1 >= most]] = True
        lo = hi
    return ok


def prime_divisors(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] * (q > 1)


def islands(words: np.ndarray, q: int, need: int) -> Iterator[tuple[int, int]]:
    """Start and end of each maximal stretch with smallest period q."""
    equal = np.zeros(len(words) - q + 2, np.int8)
    equal[1:-1] = words[:-q] == words[q:]
    edges = np.flatnonzero(np.diff(equal))
    starts, ends = edges[::2], edges[1::2]
    fine = ends - starts >= need
    for s, e in zip(starts[fine].tolist(), (ends[fine] + q).tolist(), strict=True):
        if not any(np.array_equal(words[s : e - q // p], words[s + q // p : e]) for p in prime_divisors(q)):
            yield s, e


def runs_of(codes: np.ndarray, bounds: np.ndarray, min_words: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start, then period."""
    counts, slots = lag_counts(codes, bounds)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    lags = np.arange(len(counts)) - np.repeat(slots[:-1], np.diff(slots))
    needs = np.maximum(min_words - lags, lags)
    for low, high in itertools.pairwise(BANDS):  # short periods first: they explain most matches at longer lags
        slot = np.flatnonzero((counts >= needs) & (lags >= low) & (lags < high))
        doc = np.searchsorted(slots, slot, side="right") - 1
        stands = standing(codes, bounds[doc], bounds[doc + 1], lags[slot], needs[slot])
        for at, d in zip(slot[stands].tolist(), doc[stands].tolist(), strict=True):
            if counts[at] < needs[at]:  # others explain the rest
                continue
            words, q = codes[bounds[d] : bounds[d + 1]], int(lags[at])
            for s, e in islands(words, q, int(needs[at])):
                found[d].append((s, e - s, q))
                multiples = np.arange(2 * q, min(e - s, len(words) // 2 + 1), q)
                counts[slots[d] + multiples] -= e - s - multiples
    return [sorted(x) for x in found]


def collapsed(runs: list[list[tuple[int, int, int]]], bounds: np.ndarray, solid: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words that no run holds after its first period, joined by spaces."""
    edge = np.zeros(len(lengths) + 1, np.int64)
    for lo, own in zip(bounds.tolist(), runs, strict=False):
        for s, length, q in own:
            edge[lo + s + q] += 1
            edge[lo + s + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    before = np.concatenate([[0], np.cumsum(kept)])
    per_doc = before[bounds]
    lead = np.ones(per_doc[-1] + 1, np.int64)
    lead[per_doc[:-1]] = 0  # the first word of each text has no space before it
    size = lengths[kept]
    ends = np.cumsum(size + lead[:-1])
    out = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint8)
    word_bytes = solid[np.repeat(kept, lengths)]
    out[np.arange(len(word_bytes)) + np.repeat(ends - np.cumsum(size), size)] = word_bytes
    offsets = np.concatenate([[0], ends])[per_doc]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def find_runs(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), min_words: int = 12) -> DataFrame:
    """The carried columns, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``, the
    words of the text without those that a run holds after its first period, joined by spaces."""
    bound_batches(docs.sparkSession)
    carry = [c for c in carry if c not in ("runs", "collapsed")]
    schema = T.StructType([*docs.select(*carry).schema, *T.StructType.fromDDL(RUNS)])
    kind = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                codes, bounds, solid, lengths = word_codes(t)
                runs = runs_of(codes, bounds, min_words)
                flat = np.array([x for own in runs for x in own], np.int64).reshape(-1, 3)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in runs])]), pa.int32())
                rows = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], fields=list(kind)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), rows, collapsed(runs, bounds, solid, lengths)], names=schema.names)

    return docs.select(*carry, *([] if "text" in carry else ["text"])).mapInArrow(run, schema)
