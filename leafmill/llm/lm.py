"""Language-model scores from a backoff model over all word pairs and triples that occur twice.

Training counts every word of the training rows, then word pairs and triples; those seen at
least ``LEAST`` times are kept, however large the corpus and however rare or long their words.
They are tables keyed by word numbers: frequent words (``WORD_SHARE``) are numbered by rank,
any other has a negative 63-bit hash (no two of 10 million share one but with a chance of 1
in 100,000).  What can't be kept is not counted at all: pairs of a word seen once, triples of a
pair seen once.  Bit tables of a fixed size tell that; where they are full they only tell less.
Probabilities and backoff weights come from joins of these tables: pairs and triples are dealt out by the keys of their
pairs, packed as arrays, and meet group by group.

A score is a sum over the n-grams of a text: a kept n-gram adds its discounted log10
probability, less what its absence would have cost, plus its own backoff weight if a word
follows.  So each order is looked up by itself, and an n-gram that isn't kept adds nothing.

The frequent n-grams (``NGRAM_SHARE`` of all training tokens; at most 1 / NGRAM_SHARE of an
order) are the states of an automaton that every task has: an arc carries the probability of
a word after the state's words, a failure arc leads to the state with one word less and
carries the backoff weight.  A text is read once from left to right.  What the rest of its
n-grams and its rarer words add comes by one join on their hashes; hot ones are never in it.
Probabilities after any state sum to one over the vocabulary and one unknown word.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, bytes_of, giving_back, split_words

LEAST = 2
WORD_SHARE, NGRAM_SHARE = 5e-7, 2.5e-7
MAX_FREQUENT_BYTES = 64
DISCOUNT = 0.75
#: Words and n-grams that a task gathers before it hands on their counts; bytes of texts that it reads at once; tokens of a group of n-grams.
FLUSH_WORDS, FLUSH_TOKENS, SLICE_BYTES, GROUP_TOKENS = 2_000_000, 600_000, 2_000_000, 100_000
FOLDS, HELD_OUT = 7, 2
#: Bits of the tables that narrow what is counted and asked for, and of their parts.
FILTER_BITS, PART_BITS = 27, 21
#: In place of the first word of a pair; of a word that no kept n-gram holds; beyond these are hashes.
NONE, NEVER = -1, -2
#: Kinds of packed rows that meet in a group: what the model has, what texts ask for, sums of texts; frequent pairs and triples.
HAS, ASKS, SUMS, PAIRS, TRIPLES = range(5)
#: Columns of packed rows, tokens of a group of what is asked for, and groups of texts whose sums are added up.
PACKED, REST_TOKENS, SUM_GROUPS = "abcdef", 2_000_000, 1024
#: Texts are scored in so many rounds, dealt out by their hash; each round's shuffle files go before the next.
ROUNDS = 2


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded size; a text is never cut."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of a binary ``text`` column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def flush() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(parts, pa.binary()))
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

        for b in _sliced(batches):
            parts.append(split_words(b.column("text"))[0])
            size += len(parts[-1])
            if size > FLUSH_WORDS:
                yield flush()
                parts, size = [], 0
        yield flush()

    return docs.select("text").mapInArrow(giving_back(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Negative, and below NEVER."""
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)
    return np.minimum(h.view(np.int64) + np.iinfo(np.int64).min, NEVER - 1)


class Numbers:
    """Numbers of words: 0 is the start of a text, 1 its end, frequent words follow; any other has a negative hash, or NEVER."""

    def __init__(self, frequent: dict[bytes, int], twice: np.ndarray) -> None:
        """twice: bits of the hashes of words that occur twice."""
        self.frequent, self.twice = frequent, twice

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of texts, one after another, each from its start to its end: numbers, with the hash of any word that isn't frequent; numbers, with NEVER; the row of each.

        A word of the batch is numbered once.
        """
        words, n = split_words(texts)
        coded = words.dictionary_encode()
        distinct = bytes_of(coded.dictionary)
        get = self.frequent.get
        ids = np.fromiter([get(w, -1) for w in distinct], np.int64, len(distinct))
        rare = np.flatnonzero(ids < 0)
        ids[rare] = h = word_hashes([distinct[i] for i in rare.tolist()])
        known = ids.copy()
        known[rare[~_has(self.twice, h)]] = NEVER
        row = np.repeat(np.arange(len(n)), n + 2)
        ends = np.cumsum(n + 2)
        inner = np.ones(len(row), bool)
        inner[ends - 1] = inner[ends - n - 2] = False
        tokens, whole = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        tokens[ends - 1] = whole[ends - 1] = 1
        at = coded.indices.to_numpy()
        whole[inner], tokens[inner] = ids[at], known[at]
        return whole, tokens, row


def _binary(x: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of an array, from each beginning to the next one."""
    ends = np.append(begin, len(x)).astype(np.int32) * np.int32(x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def _place(k: np.ndarray) -> np.ndarray:
    """The bit of a key: its highest bits, without the sign."""
    return k.astype(np.uint64) >> np.uint64(63 - FILTER_BITS) & np.uint64((1 << FILTER_BITS) - 1)


def _bits(keys: DataFrame, column: str = "k") -> np.ndarray:
    """A bit for each key (long, or binary arrays of them): 2 ** FILTER_BITS bits at any number of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(column)
            at = _place(np.frombuffer(b"".join(bytes_of(keys)), np.int64) if pa.types.is_binary(keys.type) else keys.to_numpy()).astype(np.int32)
            at.sort()
            at = at[_firsts(at)]
            begin = _firsts(at >> PART_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(at[begin] >> PART_BITS), _binary(at & np.int32(size - 1), begin)], ["part", "at"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, there = -1, np.zeros(size, bool)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
        for b in batches:
            for i, at in zip(b.column("part").to_pylist(), bytes_of(b.column("at")), strict=True):
                if i != part:
                    if part >= 0:
                        yield done()
                    part, there = i, np.zeros(size, bool)
                there[np.frombuffer(at, np.int32)] = True
        if part >= 0:
            yield done()

    size = 1 << PART_BITS
    parts = keys.select(column).mapInArrow(giving_back(run), "part int, at binary").repartition("part").sortWithinPartitions("part")
    found = parts.mapInArrow(giving_back(add), "part int, bits binary").toArrow()
    out = np.zeros((1 << (FILTER_BITS - PART_BITS), size >> 6), np.uint64)
    for i, bits in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[i] = np.frombuffer(bits, np.uint64)
    return out.ravel()


def _has(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    at = _place(k)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    u = np.uint64
    x = (a.astype(u) * u(0x9E3779B97F4A7C15) + b.astype(u)) * u(0xBF58476D1CE4E5B9)
    x = ((x ^ (x >> u(29))) + c.astype(u)) * u(0x94D049BB133111EB)
    x = (x ^ (x >> u(32))) * u(0xD6E8FEB86659FD93)
    return x ^ (x >> u(31))


def _pairs(t: np.ndarray) -> np.ndarray:
    """Where the pairs begin that may be kept: of words that occur twice, in one text."""
    return np.flatnonzero((t[:-1] != NEVER) & (t[1:] != NEVER) & (t[1:] != 0))


def _triples(t: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where the triples begin of pairs that may be kept, by their bits."""
    at = _pairs(t)
    kept = np.zeros(len(t), bool)
    kept[at[_has(pairs, _mixed(np.full(len(at), NONE), t[at], t[at + 1]))]] = True
    return np.flatnonzero(kept[:-1] & kept[1:])


def _counted(k: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the first of each key is, in the order of keys, and how often (or the sum of n)."""
    order = k.argsort()
    k = k[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]]))
    return order[first], np.diff(first, append=len(k)) if n is None else np.add.reduceat(n[order], first) if len(k) else n


def _group(k: np.ndarray, groups: int) -> np.ndarray:
    return (k.view(np.uint64) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)


def _packed(g: np.ndarray, kind: int, *columns: pa.Array) -> pa.RecordBatch:
    """Rows of one kind; columns that it hasn't are null."""
    none = pa.nulls(len(g), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(np.full(len(g), kind, np.int32)), *columns, *[none] * (len(PACKED) - len(columns))], ["g", "kind", *PACKED])


PACKED_SCHEMA = f"g int, kind int, {', '.join(f'{x} binary' for x in PACKED)}"


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(np.full(len(a), NONE), a, b).view(np.int64)


def _gathered(pieces: Iterator[tuple], groups: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of pieces (kind, keys by which they are dealt out, columns), FLUSH_TOKENS at once."""
    parts, size = {}, 0

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, found in parts.items():
            k, *columns = (np.concatenate(x) for x in zip(*found, strict=True))
            order = k.view(np.uint64).argsort()
            g = _group(k[order], groups)
            begin = _firsts(g)
            yield _packed(g[begin], kind, *(_binary(x[order], begin) for x in columns))

    for kind, k, *columns in pieces:
        parts.setdefault(kind, []).append((k, *columns))
        size += len(k)
        if size > FLUSH_TOKENS:
            yield from flush()
            parts, size = {}, 0
    yield from flush()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Group, kind, and a function that gives a column's array, of each packed row."""
    for batch in batches:
        for i in range(batch.num_rows):
            at = lambda x, kind=np.int64, i=i, batch=batch: np.frombuffer(batch.column(2 + x)[i].as_buffer(), kind)
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), at


def _grouped(batches: Iterator[pa.RecordBatch], *types: tuple[str, list]) -> Iterator[list[list[np.ndarray]]]:
    """The columns of each group, for each (kind, types of its columns); rows come group by group."""
    types, group, parts = dict(types), None, {}
    whole = lambda: [[np.concatenate(x) for x in zip(*parts[k], strict=True)] if parts.get(k) else [np.zeros(0, t) for t in kinds] for k, kinds in types.items()]
    for g, kind, at in _rows(batches):
        if g != group:
            if parts:
                yield whole()
            group, parts = g, {}
        parts.setdefault(kind, []).append([at(i, t).copy() for i, t in enumerate(types[kind])])
    if parts:
        yield whole()


def packed_ngrams(docs: DataFrame, shared, order: int, groups: int) -> DataFrame:  # noqa: ANN001
    """(g, a, b, c, n): of each group of keys, what a task has counted, as arrays in binary columns, so that Spark shuffles few rows; order 2 has no a."""
    names = "abc"[3 - order :]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, twice, kept = shared.value
        numbers, parts, size = Numbers(frequent, twice), [], 0

        def flush() -> pa.RecordBatch:
            grams = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * order
            k = _mixed(*([np.full(len(grams[0]), NONE)] * (3 - order)), *grams)
            at, n = _counted(k)
            g = _group(k[at], groups)  # in order, like the keys
            begin = _firsts(g)
            packed = [_binary(x.astype(np.int64), begin) for x in [*(x[at] for x in grams), n]]
            return pa.RecordBatch.from_arrays([pa.array(g[begin].astype(np.int32)), *packed], ["g", *names, "n"])

        for batch in _sliced(batches):
            t = numbers.read(batch.column("text"))[1]
            at = _pairs(t) if order == 2 else _triples(t, kept)
            parts.append([t[at + i] for i in range(order)])
            size += len(at)
            if size > FLUSH_TOKENS:
                yield flush()
                parts, size = [], 0
        yield flush()

    return docs.select("text").mapInArrow(giving_back(count), f"g int, {', '.join(f'{x} binary' for x in names)}, n binary")


def ngram_counts(docs: DataFrame, shared, order: int, groups: int, of_words=None) -> DataFrame:  # noqa: ANN001
    """(a, b, c, n) of the pairs (a is NONE) or triples that occur LEAST times; ``shared``: numbers of words, their bits, those of pairs.

    ``of_words``: counts of frequent words before another and after one; then nb and nc are added, null for other words.
    """

    def add(t: pa.Table) -> pa.Table:
        *grams, n = (np.frombuffer(b"".join(t[x].to_pylist()), np.int64) for x in t.column_names[1:])
        grams = [np.full(len(n), NONE)] * (3 - order) + grams
        at, n = _counted(_mixed(*grams), n)
        often = n >= LEAST
        grams, n = [x[at[often]] for x in grams], n[often]
        if of_words is None:
            return pa.table([*grams, n], names=[*"abc", "n"])
        own = [pa.array(v[np.maximum(x, 0)].astype(np.float64), mask=x < 0) for v, x in zip(of_words.value, grams[1:], strict=True)]
        return pa.table([*map(pa.array, grams), pa.array(n), *own], names=[*"abc", "n", "nb", "nc"])

    more = "" if of_words is None else ", nb double, nc double"
    return packed_ngrams(docs, shared, order, groups).groupBy("g").applyInArrow(add, f"a long, b long, c long, n long{more}")


def _by_group(rows: DataFrame, run, groups: int) -> DataFrame:  # noqa: ANN001
    """Packed rows, dealt out by group, become packed rows of the pieces that ``run`` makes of a task's batches."""
    dealt = rows.repartition("g").sortWithinPartitions("g", "kind")
    return dealt.mapInArrow(giving_back(lambda batches: _gathered(run(batches), groups)), PACKED_SCHEMA)


def packed_triples(docs: DataFrame, shared, groups: int, met: int) -> DataFrame:  # noqa: ANN001
    """Packed rows (a, b, c, n) of the triples that occur LEAST times, by ``met`` groups of their second pair's key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ((*grams, n),) in _grouped(batches, (ASKS, [np.int64] * 4)):
            at, n = _counted(_mixed(*grams), n)
            often = n >= LEAST
            a, b, c = (x[at[often]] for x in grams)
            yield ASKS, _pair_keys(b, c), a, b, c, n[often]

    found = packed_ngrams(docs, shared, 3, groups).select("g", F.lit(ASKS).alias("kind"), "a", "b", "c", F.col("n").alias("d"))
    return _by_group(found, count, met)


def packed_pairs(pairs: DataFrame, back, least: float, width: int, groups: int) -> DataFrame:  # noqa: ANN001
    """Packed rows of pairs (b, c, n, p, below, v): key, n, p, weight without what follows, and a code for a frequent pair, else -1.

    v is the first word's own weight, where it is rare; ``back`` has those of frequent words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            b, c, n, p, below, v = (batch.column(x).to_numpy() for x in range(6))
            k = _pair_keys(b, c)
            w = np.log10(p) - np.log10(below) - np.where(b >= 0, back.value[np.maximum(b, 0)], v)
            yield HAS, k, k, n, p, w, np.where((n >= least) & (b >= 0) & (c >= 0), b * width + c, -1)

    return pairs.select("b", "c", "n", "p", "below", "v").mapInArrow(giving_back(lambda x: _gathered(run(x), groups)), PACKED_SCHEMA)


def _weighed(pairs: DataFrame, triples: DataFrame, least: float, width: int, groups: int) -> DataFrame:
    """Packed rows of what pairs and triples add: key, weight and base; of frequent pairs: code, log10 p and weight after; of frequent triples: code, log10 p.

    Triples meet their second pair, which has the probability below, then their first, whose weight they make up.
    """

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (keys, p), (a, b, c, n) in _grouped(batches, (HAS, [np.int64, np.float64]), (ASKS, [np.int64] * 4)):
            found = Index(keys).find(_pair_keys(b, c))
            a, b, c, n, found = (x[found >= 0] for x in (a, b, c, n, found))
            yield ASKS, _pair_keys(a, b), a, b, c, n, p[found]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        i, f = np.int64, np.float64
        for (keys, n2, p2, w2, code2), (a, b, c, n, below) in _grouped(batches, (HAS, [i, i, f, f, i]), (ASKS, [i, i, i, i, f])):
            found = Index(keys).find(_pair_keys(a, b))
            a, b, c, n, below, found = (x[found >= 0] for x in (a, b, c, n, below, found))
            p = (n - DISCOUNT) / n2[found]
            left, low = (np.bincount(found, x, len(keys)) for x in (p, below))
            back = np.log10(np.maximum(np.where(low > 0, (1 - left) / np.maximum(1 - low, 1e-12), 1.0), 1e-12))
            mine, own = code2 >= 0, (n >= least) & (a >= 0) & (b >= 0) & (c >= 0)
            yield PAIRS, code2[mine], code2[mine], np.log10(p2[mine]), back[mine]
            code = (a[own] * width + b[own]) * width + c[own]  # fits: there are at most 1 / WORD_SHARE frequent words
            yield TRIPLES, code, code, np.log10(p[own])
            k = np.concatenate([keys[~mine], _mixed(a[~own], b[~own], c[~own]).view(np.int64)])
            w = np.concatenate([(w2 + back)[~mine], (np.log10(p) - back[found] - np.log10(below))[~own]])
            yield HAS, k, k, w, np.zeros(len(k))

    none = [F.lit(None).cast("binary").alias(x) for x in PACKED[2:]]
    asked = _by_group(pairs.select("g", "kind", "a", F.col("c").alias("b"), *none).unionByName(triples), second, groups)
    return _by_group(pairs.unionByName(asked), first, groups)


def _named(counts: DataFrame) -> DataFrame:
    """(n, id) of words by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("n"), pa.array(word_hashes(bytes_of(b.column("word"))))], ["n", "id"])

    return counts.select("word", "n").mapInArrow(giving_back(run), "n long, id long")


def _of_rare(df: DataFrame, at: str, name: str, rare: DataFrame) -> DataFrame:
    """Puts a value into column ``name`` where the word in column ``at`` isn't frequent, by a join with ``rare`` (id, v); only such rows are shuffled."""
    others = df.where(F.col(at) < 0).drop(name).join(rare.select(F.col("id").alias(at), F.col("v").alias(name)), at)
    return df.where(F.col(at) >= 0).unionByName(others)


def _backoff(left: Column, below: Column) -> Column:
    weight = F.when(below > 0, (1 - left) / F.greatest(1 - below, F.lit(1e-12))).otherwise(F.lit(1.0))
    return F.log10(F.greatest(weight, F.lit(1e-12)))


class Index:
    """Places of keys in an array by an open hash table, for many at once: a sorted array of a million takes twenty steps instead of one or two."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.shift = keys, np.uint64(64 - (4 * len(keys) + 1).bit_length())
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            out = self.table[slot] != left
            left, slot = left[out], slot[out] + 1 & len(self.table) - 1

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Where each key is, or -1."""
        out = np.full(len(k), -1)
        if not len(self.keys):
            return out
        slot, left = self._slot(k), np.arange(len(k))
        while len(left):
            at = self.table[slot]
            same = self.keys[at] == k[left]
            same &= at >= 0
            out[left[same]] = at[same]
            on = np.flatnonzero((at >= 0) & ~same)
            left, slot = left[on], slot[on] + 1 & len(self.table) - 1
        return out


class Automaton:
    """States: the root, one for each word number, and one for each frequent pair; arcs are keys, looked up for many texts at once."""

    def __init__(self, words: dict[bytes, int], word_n: np.ndarray, back: np.ndarray, pairs: list[np.ndarray], triples: list[np.ndarray], total: int, vocabulary: int) -> None:
        """word_n, back: by word number, the end's at 1; pairs (code, log_p, back) and triples (code, log_p): the frequent ones."""
        self.words, self.width, self.word_n, self.back = words, len(words) + 2, word_n, back
        self.log_one = -np.log10(total + vocabulary + 1)  # of an unseen word; a word seen c times adds log10(c + 1)
        self.unigram = np.log10(word_n + 1.0) + self.log_one
        two, log_p, after = pairs
        order = np.argsort(two)
        self.pairs, self.pair_p, self.pair_back = two[order], log_p[order], after[order]
        # every pair of a frequent triple is frequent
        three, log_p = triples
        three = np.searchsorted(self.pairs, three // self.width) * self.width + three % self.width
        order = np.argsort(three)
        self.triples, self.triple_p = three[order], log_p[order]

    def __getattr__(self, name: str) -> Index:
        """The hash tables are made where they are first used, and not sent along."""
        if name not in ("pair_at", "triple_at"):
            raise AttributeError(name)
        self.__dict__[name] = found = Index(self.pairs if name == "pair_at" else self.triples)
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pair_at", "triple_at")}

    def read(self, words: np.ndarray) -> float:
        """Sum of log10 probabilities of a text's words."""
        return float(self.steps(np.concatenate([np.zeros(1, np.int64), words]))[0].sum())

    def steps(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probabilities of all tokens but the first, and which arcs of pairs and triples end there (-1: none).

        Texts follow each other, each from its start; -1 stands for a word that isn't frequent, whose own probability is
        left out.  From left to right: after a word the state is its pair's with the word before, else its own, else the
        root.  Each word takes an arc from there, or passes failure arcs, which add their weights, until a state has one.
        """
        before, c = w[:-1], w[1:]
        pair = np.full(len(c), -1)
        both = np.flatnonzero((before >= 0) & (c > 0))
        pair[both] = self.pair_at.find(before[both] * self.width + c[both])
        state = np.concatenate([np.full(1, -1), pair[:-1]])[: len(c)]  # of the pair that ends before the word; else -1
        triple = np.full(len(c), -1)
        at = np.flatnonzero((state >= 0) & (c > 0))
        triple[at] = self.triple_at.find(state[at] * self.width + c[at])
        some = lambda i, values: np.where(i >= 0, values[np.maximum(i, 0)] if len(values) else 0.0, 0.0)
        fails = triple < 0  # past the pair's state
        falls = fails & (pair < 0)  # past the word's state, to the root
        total = some(triple, self.triple_p) + np.where(fails, some(state, self.pair_back) + some(pair, self.pair_p), 0.0)
        total += np.where(falls, some(before, self.back) + some(c, self.unigram), 0.0)
        return np.where(c == 0, 0.0, total), pair, triple


class Model:
    """The automaton, and ``rest``: what rarer words and n-grams add to the score and the base, by their keys, packed by groups of keys."""

    def __init__(self, docs: DataFrame) -> None:
        spark = docs.sparkSession
        self.box = box = Scratch(spark)
        share = spark.sparkContext.broadcast
        self.counts = box.put(word_counts(docs))
        rows = docs.count()
        tokens, distinct = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.total, self.vocabulary = total, vocabulary = tokens + rows, distinct + (rows > 0)
        frequent = (F.col("n") >= WORD_SHARE * total) & (F.octet_length("word") <= MAX_FREQUENT_BYTES)
        found = [(bytes(r["word"]), r["n"]) for r in self.counts.where(frequent).orderBy("word").toLocalIterator()]
        words = {w: i for i, (w, _) in enumerate(found, 2)}
        word_n = np.array([0, rows, *[n for _, n in found]], dtype=np.int64)
        others = box.put(_named(self.counts.where(~frequent)))
        self.twice = _bits(others.where(F.col("n") >= LEAST), "id")
        known = share((words, self.twice, None))
        groups = max(1, total // GROUP_TOKENS)
        context_n = word_n.copy()
        context_n[0] = rows
        grams = box.put(ngram_counts(docs, known, 2, groups, share((context_n, word_n))))
        known.destroy()  # each executor has it on its disk
        _freed(spark)

        rare = others.where(F.col("n") >= LEAST).select("id", F.col("n").cast("double").alias("v"))
        one = F.lit(float(1 / (total + vocabulary + 1)))
        odd = F.col("b").bitwiseOR(F.col("c")) < 0  # one of the two words is rare
        mixed = box.put(_of_rare(_of_rare(grams.where(odd), "b", "nb", rare), "c", "nc", rare))
        pairs = grams.where(~odd).unionByName(mixed).select("b", "c", "n", ((F.col("n") - DISCOUNT) / F.col("nb")).alias("p"), ((F.col("nc") + 1) * one).alias("below"))
        # one word before: a context none of whose n-grams are kept backs off for free
        first_backs = box.put(pairs.groupBy("b").agg(_backoff(F.sum("p"), F.sum("below")).alias("v")).withColumnRenamed("b", "id"))
        back = np.zeros(len(word_n))
        for i, v in first_backs.where("id >= 0").toLocalIterator():
            back[i] = v
        rare_backs = first_backs.where("id < 0")
        self.groups = groups2 = max(1, total // REST_TOKENS)
        least, width = max(float(LEAST), NGRAM_SHARE * total), len(words) + 2  # at most 1 / NGRAM_SHARE pairs or triples are frequent
        zero = F.lit(0.0)
        odd = pairs.where("b < 0").join(rare_backs.withColumnRenamed("id", "b"), "b", "left").withColumn("v", F.coalesce("v", zero))
        packed = box.put(packed_pairs(pairs.where("b >= 0").withColumn("v", zero).unionByName(odd), share(back), least, width, groups2))
        box.drop(grams, mixed)
        # two words before
        known = share((words, self.twice, _bits(packed.select(F.col("a").alias("k")))))
        triples = box.put(packed_triples(docs, known, groups, groups2))
        known.destroy()
        _freed(spark)
        weighed = box.put(_weighed(packed, triples, least, width, groups2))
        box.drop(packed, triples)
        _freed(spark)

        def collected(kind: int, *types: type) -> list[np.ndarray]:
            found = weighed.where(F.col("kind") == kind).select(*PACKED[: len(types)]).toArrow()
            return [np.frombuffer(b"".join(found[x].to_pylist()), t) for x, t in zip(PACKED, types, strict=False)]

        self.automaton = Automaton(words, word_n, back, collected(PAIRS, np.int64, np.float64, np.float64), collected(TRIPLES, np.int64, np.float64), total, vocabulary)
        logs = F.log10(F.col("n") + F.lit(1.0))
        own = others.join(rare_backs.withColumnRenamed("v", "back"), "id", "left").select("id", (logs + F.coalesce("back", zero)).alias("w"), logs.alias("base"))
        own = box.put(_packed_words(own, groups2))
        box.drop(first_backs, others)
        self.parts, self.rest = (own, weighed), own.unionByName(weighed.where(F.col("kind") == HAS))
        self.bits = _bits(self.rest.select(F.col("a").alias("k")))
        _freed(spark)


def _freed(spark) -> None:  # noqa: ANN001
    """Lets Spark's cleaner drop the shuffle files of what is written already; it holds on to those of the last job, so a small one follows."""
    last = Scratch(spark)
    last.put(spark.range(0, 1, 1, 1))
    last.drop()
    gc.collect()
    spark._jvm.System.gc()


def _packed_words(rows: DataFrame, groups: int) -> DataFrame:
    """Packed rows of words (id, w, base) by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            k, w, base = (batch.column(x).to_numpy() for x in range(3))
            yield HAS, k, k, w, base

    return rows.select("id", "w", "base").mapInArrow(giving_back(lambda x: _gathered(run(x), groups)), PACKED_SCHEMA)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Sums by text, in the order of their groups, from (th, copies, n_tokens, n_known, base, score)."""
    th, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = th.view(np.uint64).argsort()
    first = _firsts(th[order])
    return [th[order][first], *(np.add.reduceat(x[order], first) if len(first) else x for x in sums)]


def _met(rows: DataFrame) -> DataFrame:
    """Packed sums by text of packed rows that come group by group: first what the model has, then what is asked for.

    A text gets at most one partial sum from a group, and never more than it asks for; they are handed on as arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, has, index, parts, size = None, [], None, [], 0

        def flush() -> pa.RecordBatch:
            sums = _merged(parts)
            g = _group(sums[0], SUM_GROUPS)
            begin = _firsts(g)
            return _packed(g[begin], SUMS, *(_binary(x, begin) for x in sums))

        for g, kind, at in _rows(batches):
            if g != group:
                group, has, index = g, [], None
            if kind == HAS:
                has.append((at(0).copy(), at(1, np.float64).copy(), at(2, np.float64).copy()))
                continue
            th = at(0)
            if kind == SUMS:
                parts.append((th.copy(), np.ones(len(th)), *(at(x, np.float64).copy() for x in range(1, 5))))
            else:
                if index is None:
                    keys, w, base = (np.concatenate(x) for x in zip(*has, strict=True)) if has else (np.zeros(0, np.int64), np.zeros(1), np.zeros(1))
                    index, has = Index(keys), []
                n, found = at(1, np.int32).astype(np.int64), index.find(at(2))
                there, begin = found >= 0, n.cumsum() - n
                own_base = np.where(there, base[found], 0.0)
                sums = [np.add.reduceat(x, begin) for x in ((own_base > 0).astype(np.float64), own_base, np.where(there, w[found], 0.0))]  # words have a base, n-grams none
                some = np.flatnonzero(np.logical_or.reduceat(there, begin))
                parts.append((th[some], np.zeros(len(some)), np.zeros(len(some)), *(x[some] for x in sums)))
            size += len(parts[-1][0])
            if size > FLUSH_TOKENS:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    return rows.mapInArrow(giving_back(run), PACKED_SCHEMA)


def _summed(rows: DataFrame) -> DataFrame:
    """One row per text of packed sums; equal texts were summed together."""
    names = ["th", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, size = None, [], 0

        def done() -> pa.RecordBatch:
            th, copies, *sums = _merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(th), *(pa.array(x / copies) for x in sums)], names)

        for g, _, at in _rows(batches):
            if g != group and parts:
                yield done()
                parts, size = [], 0
            group = g
            parts.append((at(0).copy(), *(at(x, np.float64).copy() for x in range(1, 6))))
            size += len(parts[-1][0])
            if size > FLUSH_TOKENS:
                parts, size = [_merged(parts)], 0
        if parts:
            yield done()

    dealt = rows.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(giving_back(run), "th long, n_tokens double, n_known double, base double, score double")


def train(docs: DataFrame) -> tuple[Automaton, DataFrame, int, int]:
    """The automaton, the table of all words (word, n), training tokens and distinct tokens (each text has one end)."""
    m = Model(docs)
    return m.automaton, m.counts, m.total, m.vocabulary


def score(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are runs of anything but white space, A-Z lower-cased, and one end.  A null or empty text
    is just its end; very long texts are read whole.  base_score is the add-one unigram score, score the
    automaton's; both are log10.  Without training rows every token has probability one (log10 of 1 / 1).
    Rows equal in id and text score alike; an empty table gives no rows.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    trained = Model(learn.select(F.col("text").cast("binary").alias("text")))
    trained.box.drop(trained.counts)
    total, unknown = trained.total, trained.automaton.log_one
    shared = docs.sparkSession.sparkContext.broadcast((trained.automaton, trained.twice, trained.bits))
    groups = trained.groups

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, twice, bits = shared.value
        numbers, parts, size = Numbers(m.words, twice), [], 0

        def flush() -> pa.RecordBatch:
            k, row = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] + i for x, i in zip(parts, np.cumsum([0, *(len(x[2]) for x in parts[:-1])]), strict=True)])
            th = np.concatenate([x[2] for x in parts])
            g = _group(k, groups)
            order = (g * np.uint64(len(th)) + row.astype(np.uint64)).argsort()
            k, row, g = k[order], row[order], g[order]
            text = np.flatnonzero(np.concatenate([np.ones(min(len(g), 1), bool), (g[1:] != g[:-1]) | (row[1:] != row[:-1])]))
            begin, first = _firsts(g[text]), _firsts(g)
            return _packed(g[first], ASKS, _binary(th[row[text]], begin), _binary(np.diff(text, append=len(k)).astype(np.int32), begin), _binary(k, first))

        for batch in _sliced(batches):
            n = batch.num_rows
            whole, t, row = numbers.read(batch.column("text"))
            summed = lambda v, at=slice(None): np.bincount(row[at], weights=v, minlength=n)  # noqa: B023, E731
            rare, own = np.flatnonzero(whole < 0), np.flatnonzero(whole > 0)
            below = summed(None, rare) * unknown
            score, pair, triple = m.steps(np.maximum(whole, -1))
            sums = [summed(None) - 1.0, summed(m.word_n[whole[own]] > 0, own), summed(m.unigram[whole[own]], own) + below, summed(score, slice(1, None)) + below]
            # pairs and triples that aren't the automaton's but may be kept; a triple's pairs are kept, too
            at = _pairs(t)
            kept = np.zeros(len(t), bool)
            kept[at] = pair[at] >= 0
            at = at[pair[at] < 0]
            k2 = _mixed(np.full(len(at), NONE), t[at], t[at + 1]).view(np.int64)
            some = _has(bits, k2)
            at2, k2 = at[some], k2[some]
            kept[at2] = True
            at3 = np.flatnonzero(kept[:-1] & kept[1:])
            at3 = at3[triple[at3 + 1] < 0]
            k3 = _mixed(t[at3], t[at3 + 1], t[at3 + 2]).view(np.int64)
            some = _has(bits, k3)
            at3, k3 = at3[some], k3[some]
            rare = rare[_has(bits, whole[rare])]
            th = batch.column("th").to_numpy()
            parts.append((np.concatenate([whole[rare], k2, k3]), np.concatenate([row[rare], row[at2], row[at3]]), th))
            size += len(parts[-1][0])
            yield _packed(_group(th[:1], groups), SUMS, *(_binary(np.asarray(x), np.zeros(1, np.int64)) for x in (th, *sums)))
            if size > FLUSH_TOKENS:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    box, scores = trained.box, []
    for i in range(ROUNDS):
        asked = base.where(F.pmod("th", F.lit(ROUNDS)) == i).select("th", "text").mapInArrow(giving_back(read), PACKED_SCHEMA)
        met = _met(trained.rest.unionByName(asked).repartition("g").sortWithinPartitions("g", "kind"))
        scores.append(box.put(_summed(met)))
        _freed(docs.sparkSession)
    box.drop(*trained.parts)
    shared.destroy()
    out = reduce(DataFrame.unionByName, scores)
    whole = lambda c: F.round(c).cast("long").alias(c)
    return base.select("doc_id", "th").join(out, "th").select("doc_id", "th", whole("n_tokens"), whole("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def digest(docs: DataFrame) -> DataFrame:
    """Learns from the rows of the other folds; a null doc_id counts as an empty string."""
    d = docs.select("doc_id", "text")
    out = score(d, d.where(~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
