"""BPE encoding and decoding by speculation and verification.

The texts of a batch are split into words by arrays over their characters. Distinct words are proposed tokens by greedy
longest match, all words at once down an array trie of the vocabulary. A proposal is what the merges would give exactly if
every token encodes to itself and every adjacent pair is compatible (no merge ever crosses their boundary); the pairs of
all words are tested together. Only words with a failing pair are merged step by step, again all at once, one merge of
each word in a round; words of over ``LONG`` bytes with a heap.

Defined results: null and empty texts, and texts without a token, have no ids and decode to the empty text. Repeated rows
and null ids come back as they are; an empty table gives an empty result; extra columns are ignored. Texts of any length
are encoded whole: a long one goes through in runs of ``RUN`` characters, cut at white space, which bounds every token of
this kind of vocabulary; a word without white space costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnfall.llm.shared import bound_batches
from tarnfall.llm.textkernel import CODES, SpanHash, mix

WORD_END = "</w>"
#: The white space and the contractions of the vocabulary's pre-tokenizer.
SPACES = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE, LETTER, NUMBER, OTHER = range(4)
#: bytes of a word beyond which it is merged on its own, and characters of a text that are encoded at once
LONG, RUN = 64, 1 << 19
BREAK = re.compile(f"[{SPACES}]")


def kinds() -> np.ndarray:
    """Of each character whether it is white space, a letter, a number or anything else."""
    every, out = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{SPACES}]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Lookup:
    """Values of integer keys in an open-addressed table; ``missing`` for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.mask = (1 << max(4, int(len(keys) * 4).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, missing, np.int64)
        at, todo = self.home(keys), np.arange(len(keys))
        while len(todo):
            first = np.unique(at[todo], return_index=True)[1]
            free = todo[first][self.keys[at[todo[first]]] < 0]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.home(keys)
        have = self.keys[at]
        out = self.values[at]
        todo = np.flatnonzero((have != keys) & (have >= 0))
        while len(todo):  # the place is taken by another key: on to the next one
            at[todo] = (at[todo] + 1) & self.mask
            have, out[todo] = self.keys[at[todo]], self.values[at[todo]]
            todo = todo[(have != keys[todo]) & (have >= 0)]
        return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


class Bpe:
    """A vocabulary with word ends, from the JSON text of a tokenizer file. With ``specials`` the names of special tokens
    in a text become their ids, without they are text."""

    def __init__(self, source: str, specials: bool = True):
        spec = json.loads(source)
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: s for s, i in [*vocab.items(), *added.items()]}
        size = max(names) + 1
        self.names = pa.array([names.get(i, "") for i in range(size)])
        self.numbers = pa.array([str(i) for i in range(size)])
        self.specials = added if specials else {}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if self.specials else None
        self.kinds = kinds()
        letters = byte_letters()
        self.letter, self.last_letter = (np.array([vocab[x + end] for x in letters]) for end in ("", WORD_END))
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.rank, self.left, self.right = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank[ids[:, 2]] = np.arange(len(ids))
        self.left[ids[:, 2]], self.right[ids[:, 2]] = ids[:, 0], ids[:, 1]
        self.size, self.none, self.result = size, len(ids) + 1, ids[:, 2]
        self.rank_of = Lookup(ids[:, 0] * size + ids[:, 1], np.arange(len(ids)), self.none)
        self.merge = {(a, b): k for k, (a, b, _) in enumerate(ids.tolist())}
        fine = self.compatible(ids[:, 0], ids[:, 1], np.arange(len(ids))).tolist()
        self.sound = np.ones(size, bool)  # tokens that encode to themselves
        for ok, (a, b, c) in zip(fine, ids.tolist(), strict=True):
            self.sound[c] = ok and self.sound[a] and self.sound[b]
        self._grow(names, {x: b for b, x in enumerate(letters)}, np.concatenate([self.letter, self.last_letter, self.result]))

    def _grow(self, names: dict[int, str], byte_of: dict[str, int], tokens: np.ndarray) -> None:
        """The trie of the tokens, level by level: children by node and byte, the token that ends at a node, within a word
        and at its end."""
        plain = [names[i].removesuffix(WORD_END) for i in tokens.tolist()]
        final = np.array([len(names[i]) > len(p) for i, p in zip(tokens.tolist(), plain, strict=True)])
        length = np.array(list(map(len, plain)))
        data = np.array([byte_of[c] for c in "".join(plain)])
        begin, node, n = np.cumsum(length) - length, np.zeros(len(tokens), np.int64), 1
        keys, children = [], []
        for depth in range(length.max()):
            on = np.flatnonzero(length > depth)
            key, child = np.unique(node[on] * 256 + data[begin[on] + depth], return_inverse=True)
            keys.append(key), children.append(n + np.arange(len(key)))
            node[on], n = n + child, n + len(key)
        self.child = Lookup(np.concatenate(keys), np.concatenate(children), -1)
        self.ends = np.full((2, n), -1)
        self.ends[final.astype(int), node] = tokens

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (or none of a rank below ``until``) crosses from token a to token b.

        Both are undone step by step, the later merge first.

        A pair of parts merges across if its rank is below that of the merge that takes up the left part, and not above
        that which takes up the right part (of equal merges the left one comes first).
        """
        good = np.ones(len(a), bool)
        todo, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        take_x = take_y = np.full(len(a), self.none) if until is None else until
        while len(todo):
            rank = self.rank_of(x * self.size + y)
            crossed = (rank < take_x) & (rank <= take_y) & (rank < self.none)
            good[todo[crossed]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            on = ~crossed & ((rank_x >= 0) | (rank_y >= 0))
            back_x = rank_x > rank_y
            take_x, take_y = np.where(back_x, rank_x, take_x)[on], np.where(back_x, take_y, rank_y)[on]
            x, y, todo = np.where(back_x, self.right[x], x)[on], np.where(back_x, y, self.left[y])[on], todo[on]
        return good

    def merged(self, word: np.ndarray) -> list[int]:
        """The exact merges of one long word, lowest rank first and of equal ones the leftmost: a heap over linked symbols."""
        ids = [*self.letter[word[:-1]].tolist(), int(self.last_letter[word[-1]])]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(self.merge[p], i, *p) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in self.merge]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.result[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m >= 0 and (p := (ids[k], ids[m])) in self.merge:
                    heapq.heappush(heap, (self.merge[p], k, *p))
        return [x for x in ids if x >= 0]

    def merged_together(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The exact merges of many words: in each round every word makes its merge of lowest rank, of equal ones the leftmost.

        Returns the ids of all words and how many each has.
        """
        ids = self.letter[data[spread(starts, lengths)]]
        word, stops = np.arange(len(starts)), np.cumsum(lengths)
        ids[stops - 1] = self.last_letter[data[starts + lengths - 1]]
        rank = np.full(len(ids), self.none)
        rank[:-1] = self.rank_of(ids[:-1] * self.size + ids[1:])
        rank[stops - 1] = self.none
        count, done = np.zeros(len(starts), np.int64), []
        lengths = lengths.copy()
        while len(word):
            low = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
            live = low < self.none
            if not live.all():
                flags = np.repeat(live, lengths)
                done.append((word[~live], lengths[~live], ids[~flags]))
                ids, rank, word, lengths, low = ids[flags], rank[flags], word[live], lengths[live], low[live]
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(word)), lengths)
            place = np.flatnonzero(rank == low[owner])
            place = place[np.append(True, np.diff(owner[place]) > 0)]
            ids[place] = self.result[low]
            kept = np.ones(len(ids), bool)
            kept[place + 1] = False
            rank[place] = rank[place + 1]  # of the last pair of a word: none
            ids, rank, place, lengths = ids[kept], rank[kept], place - np.arange(len(place)), lengths - 1
            ends = np.cumsum(lengths)
            near = np.concatenate([place[place > ends - lengths] - 1, place[place < ends - 1]])
            rank[near] = self.rank_of(ids[near] * self.size + ids[near + 1])
        words, sizes = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        count[words] = sizes
        out = np.zeros(count.sum(), np.int64)
        out[spread((np.cumsum(count) - count)[words], sizes)] = np.concatenate([d[2] for d in done])
        return out, count

    def longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at each place of a word that ends at ``stop``, and its length."""
        token, size, on = np.full(len(at), -1), np.zeros(len(at), np.int64), np.arange(len(at))
        node, depth = np.zeros(len(at), np.int64), 0
        while len(on):
            node = self.child(node * 256 + data[at[on] + depth])
            on, node, depth = on[node >= 0], node[node >= 0], depth + 1
            last = at[on] + depth == stop[on]
            found = self.ends[last.astype(np.int64), node]
            hit = found >= 0
            token[on[hit]], size[on[hit]] = found[hit], depth
            on, node = on[~last], node[~last]
        return token, size

    def greedy(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proposals: the longest token at each place in turn. Returns the ids of all words and how many each has."""
        at, word, found = starts.copy(), np.arange(len(starts)), []
        while len(at):
            token, size = self.longest(data, at, stops[word])
            found.append((word, token))
            at = at + size
            more = at < stops[word]
            at, word = at[more], word[more]
        owner = np.concatenate([f[0] for f in found])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([f[1] for f in found])[order], np.bincount(owner, minlength=len(starts))

    def greedy_long(self, data: np.ndarray, start: int, stop: int) -> list[int]:
        """The same for one long word: the longest token at all of its places, then from one to the next."""
        at = np.arange(start, stop)
        token, size = (x.tolist() for x in self.longest(data, at, np.full(len(at), stop)))
        out, i = [], 0
        while i < len(token):
            out.append(token[i])
            i += size[i]
        return out

    def fails(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Which words' proposals are not proven: a token that does not encode to itself, or an adjacent pair not compatible."""
        owner = np.repeat(np.arange(len(count)), count)
        bad = np.zeros(len(count), bool)
        bad[owner[~self.sound[ids]]] = True
        near = np.flatnonzero(owner[1:] == owner[:-1])
        if len(near):
            pairs, which = np.unique(ids[near] * self.size + ids[near + 1], return_inverse=True)
            bad[owner[near[~self.compatible(pairs // self.size, pairs % self.size)[which]]]] = True
        return bad

    def tokens(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the words of ``data``: ids, and where each word's begin and how many they are."""
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        out, n = [np.zeros(0, np.int64)], 0

        def put(words: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal n
            count[words], begin[words] = sizes, n + np.cumsum(sizes) - sizes
            out.append(ids)
            n += len(ids)

        short = np.flatnonzero(stops - starts <= LONG)
        if len(short):
            ids, sizes = self.greedy(data, starts[short], stops[short])
            bad = self.fails(ids, sizes)
            put(short[~bad], ids[np.repeat(~bad, sizes)], sizes[~bad])
            if bad.any():
                put(short[bad], *self.merged_together(data, starts[short[bad]], (stops - starts)[short[bad]]))
        for word in np.flatnonzero(stops - starts > LONG):
            ids = np.array(self.greedy_long(data, starts[word], stops[word]))
            if self.fails(ids, np.array([len(ids)]))[0]:
                ids = np.array(self.merged(data[starts[word] : stops[word]]))
            put(np.array([word]), ids, np.array([len(ids)]))
        return np.concatenate(out), begin, count

    def words(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokenizer's words in an array of characters."""
        kind = self.kinds[chars]
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        at = np.flatnonzero(edge)
        starts, stops = at[:-1], at[1:].copy()
        full = kind[starts] != SPACE
        starts, stops = starts[full], stops[full]
        lone = np.flatnonzero((chars[starts] == ord("'")) & (stops - starts == 1))
        lone = lone[lone + 1 < len(starts)]
        lone = lone[(starts[lone + 1] == stops[lone]) & (kind[starts[lone + 1]] == LETTER)]
        for text in CONTRACTIONS if len(lone) else ():
            hit = lone[stops[lone + 1] - starts[lone + 1] >= len(text) - 1]
            for i, c in enumerate(text[1:]):
                hit = hit[chars[starts[hit] + 1 + i] == ord(c)]
            stops[hit] += len(text) - 1
            starts[hit + 1] += len(text) - 1
            lone = np.setdiff1d(lone, hit, assume_unique=True)
        return starts[starts < stops], stops[starts < stops]

    def encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, each of moderate length: all ids, and how many each text has."""
        clean = [x.lower() if x.isascii() else unicodedata.normalize("NFC", x).replace("Σ", "σ").lower() for x in runs]
        joined = " ".join(clean)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, stops = self.words(chars)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in clean)]))
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(runs), np.int64)
        data = np.frombuffer(joined.encode(), np.uint8)
        if len(data) > len(chars):
            place = np.zeros(len(chars) + 1, np.int64)
            np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), out=place[1:])
            starts, stops = place[starts], place[stops]
        # equal words once: by a hash, checked byte by byte
        keys = SpanHash(data, CODES)(starts, stops) ^ mix(stops - starts)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        size = stops - starts
        twin = first[which]
        same = size == size[twin]
        some = np.flatnonzero(same)
        flags = data[spread(starts[some], size[some])] == data[spread(starts[twin[some]], size[some])]
        same[some] = np.logical_and.reduceat(flags, np.cumsum(size[some]) - size[some])
        odd = np.flatnonzero(~same)
        which[odd] = len(first) + np.arange(len(odd))
        one = np.concatenate([first, odd])
        ids, begin, count = self.tokens(data, starts[one], stops[one])
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(count[which], out=total[1:])
        return ids[spread(begin[which], count[which])], np.diff(total[bounds])

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (with the end of the last)."""
        out, sizes = [], np.zeros(len(texts), np.int64)
        held: list[tuple[int, str | int]] = []
        length = 0

        def flush() -> None:
            runs = [x if isinstance(x, str) else "" for _, x in held]
            ids, count = self.encode_runs(runs)
            named = np.array([k for k, (_, x) in enumerate(held) if not isinstance(x, str)], np.int64)
            if len(named):
                ids = np.insert(ids, np.cumsum(count)[named], [held[k][1] for k in named])
                count[named] = 1
            np.add.at(sizes, [i for i, _ in held], count)
            out.append(ids.astype(np.int32))

        for i, text in enumerate(texts):
            for run in self.cut(text or ""):
                held.append((i, run))
                length += len(run) if isinstance(run, str) else 1
                if length >= RUN:
                    flush()
                    held, length = [], 0
        if held:
            flush()
        return np.concatenate([np.zeros(0, np.int32), *out]), np.concatenate([[0], np.cumsum(sizes)])

    def cut(self, text: str) -> Iterator[str | int]:
        """A text in runs of about ``RUN`` characters, cut at white space, and ids of special tokens between them."""
        for part in self.special.split(text) if self.special is not None and "<" in text else (text,):
            if part in self.specials:
                yield self.specials[part]
                continue
            at = 0
            while len(part) - at > RUN and (m := BREAK.search(part, at + RUN)):
                yield part[at : m.start()]
                at = m.start()
            yield part[at:]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, bounds = self.encode_texts(texts)
        return [x.tolist() for x in np.split(ids, bounds[1:-1])] if texts else []

    def joined(self, words: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Of each text the words of its ids, joined by spaces."""
        lists = pa.LargeListArray.from_arrays(pa.array(bounds), words.cast(pa.large_string()).take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))

    def digests(self, words: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """SHA-256 of :meth:`joined`, by a million ids at a time."""
        out, row = [], 0
        while row < len(bounds) - 1:
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + (1 << 20), side="right")) - 1)
            if bounds[end] - bounds[row] <= 1 << 20:
                some = self.joined(words, ids[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row])
                at, data = np.frombuffer(some.buffers()[1], np.int64), memoryview(some.buffers()[2] or b"")
                out += [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[: end - row].tolist(), at[1 : end - row + 1].tolist(), strict=True)]
            else:
                digest, lead = hashlib.sha256(), b""
                for lo in range(bounds[row], bounds[end], 1 << 20):
                    part = ids[lo : min(lo + (1 << 20), bounds[end])]
                    digest.update(lead + self.joined(words, part, np.array([0, len(part)]))[0].as_buffer().to_pybytes())
                    lead = b" "
                out.append(digest.hexdigest())
            row = end
        return out


_loaded: dict[tuple[str, bool], Bpe] = {}


def loaded(source: str, specials: bool) -> Bpe:
    """The worker's instance for a tokenizer file's text; one at a time, as a worker may live through many stages."""
    key = (hashlib.sha256(source.encode()).hexdigest(), specials)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(source, specials)
    return _loaded[key]


def read_tokenizer(docs: DataFrame, path: str) -> Broadcast:
    """The tokenizer file, one to two MB, read by the driver and broadcast: executors need no copy of it."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def some_rows(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text."""
    rows = max(1, int(batch.num_rows * most / max(batch.column("text").nbytes, 1)))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def encode(docs: DataFrame, path: str, specials: bool = True, check: bool = False) -> DataFrame:
    """The documents with ``ids``, an array of token ids, in place of ``text``; with ``check`` also ``decoded_sha256``,
    the digest of the text that the ids decode to."""
    bound_batches(docs.sparkSession)
    source = read_tokenizer(docs, path)
    added = ["ids", "decoded_sha256"] if check else ["ids"]
    names = [c for c in docs.columns if c not in ("text", *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value, specials)
        for part in chain.from_iterable(map(some_rows, batches)):
            ids, bounds = bpe.encode_texts(part.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            digests = [pa.array(bpe.digests(bpe.names, ids, bounds), pa.string())] if check else []
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists, *digests], names=[*names, *added])

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())][: len(added)]
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *fields]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows with ``ids`` get ``text``, the decoded ids, in their place: token names joined by spaces, as the vocabulary has
    no decoder of its own. Null ids decode to the empty text."""
    source = read_tokenizer(encoded, path)
    names = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value, True)
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())]).astype(np.int64)
            texts = bpe.joined(bpe.names, lists.flatten().to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts.cast(pa.string())], names=[*names, "text"])

    schema = T.StructType([*(encoded.schema[c] for c in names), T.StructField("text", T.StringType())])
    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by a space) and of the decoded text of each document.

    The same ids as :func:`encode`, hashed where they are made instead of being sent as arrays.
    """
    bound_batches(docs.sparkSession)
    source = read_tokenizer(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value, True)
        for part in chain.from_iterable(map(some_rows, batches)):
            ids, bounds = bpe.encode_texts(part.column("text").to_pylist())
            both = [pa.array(bpe.digests(words, ids, bounds), pa.string()) for words in (bpe.numbers, bpe.names)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), *both], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
