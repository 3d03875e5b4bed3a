"""Near-duplicate groups by consistent weighted sampling.

1. Texts equal up to case of A-Z and white space collapse to one content.
2. A content is a set of 5-word shingles weighted by term frequency times inverse document
   frequency.  A shingle's inverse document frequency is the mean of its words', each counted
   over all documents.  Words are counted by a 64-bit hash.  Frequent words (at least ``FREQUENT``
   of all (document, word) pairs, so at most 1 / FREQUENT of them) are known to every task; the
   counts of a content's other words come to it by a join.  A bit table of a fixed size tells most
   words of one document apart, which need no join.
3. Improved consistent weighted sampling draws 36 samples of each content; two contents agree
   in a sample with the probability of their weighted Jaccard similarity.  Samples are
   banded by threes: contents of similarity 0.8 share none of the 12 bands with a chance
   of 2 in 10,000.
4. Within a bucket contents are compared with a leader first: any, then the one that has least
   of its own; contents already in one component need no comparison.  What is left of
   different components in one bucket is then compared pair by pair, each pair in the first
   bucket that it shares, unless a bound rules it out: a content can have no more in common
   with another than the weight of those of its shingles that any other such content has.
   So no link between candidates is lost, and many variants of one text make few pairs.
   Large buckets are dealt out by blocks of contents, so that no task has a whole one.
5. Candidates are verified by their exact weighted Jaccard similarity; groups are the
   connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, bytes_of, col, fresh, giving_back, split_words, tasks_for
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
FREQUENT = 5e-7
FLUSH_WORDS = 200_000
#: Bits of the table of words that two documents have.
FILTER_BITS = 27
#: Contents of a bucket that a task compares with as many others, or with a leader.
BLOCK, LEADER_BLOCK = 1_000, 50_000

_U = np.uint64
#: Variates of consistent weighted sampling come from tables of this many entries, by hash; weights are sampled by
#: their logarithm in steps of 1 / STEPS, from LEAST_LEVEL on: e ** 30 is more than a text's words times any frequency.
TABLE_BITS, STEPS, LEAST_LEVEL, LEVELS = 13, 16, -32, 512
#: Shingles that are sampled at once, so that all their samples stay in the processor's cache; rows that are Python objects at once.
CHUNK, SLICE = 1024, 256
#: Bytes of texts that are split at once; hashes of words that a task gathers before it hands on their counts.
SLICE_BYTES, FLUSH_HASHES = 2_000_000, 1_000_000


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(20240229)
    u = np.maximum(rng.random((5, 1 << TABLE_BITS)), 1e-12)
    r, beta, ln_c = -np.log(u[0] * u[1]), u[4], np.log(-np.log(u[2] * u[3]))
    rank = np.empty((LEVELS, 1 << TABLE_BITS), np.float32)
    for i in range(LEVELS):  # row by row, so that it takes no more memory than it keeps
        rank[i] = ln_c - r * (np.floor((i + LEAST_LEVEL) / STEPS / r + beta) - beta + 1)
    odd = lambda n, kind, top: rng.integers(0, top, n, dtype=kind) * kind(2) + kind(1)
    return {"rank": rank.ravel(), "r": r, "beta": beta, "place": odd(SHINGLE, _U, 1 << 63), "sample": odd(BANDS * ROWS, np.uint32, 1 << 31)[:, None]}


@lru_cache(maxsize=1)
def _buffers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Room for a chunk's table slots, places and ranks, used again for each."""
    shape = (BANDS * ROWS, CHUNK)
    return np.empty(shape, np.uint32), np.empty(shape, np.intp), np.empty(shape, np.float32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), _U, n).view(np.int64)


def _at(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the hashes are in sorted keys, and whether."""
    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
    return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)


class Words:
    """Hashes of the frequent words in order, with their document frequencies; and bits of others that two documents have."""

    def __init__(self, n_docs: int, often: tuple[np.ndarray, np.ndarray], bits: np.ndarray) -> None:
        order = often[0].argsort()
        self.n_docs, self.hash, self.n, self.bits = n_docs, often[0][order], often[1][order], bits

    def asked(self, h: np.ndarray) -> np.ndarray:
        """Which words' frequencies must be looked up."""
        slot = h.view(_U) >> _U(64 - FILTER_BITS)
        return ~_at(self.hash, h)[1] & ((self.bits[slot >> _U(6)] >> (slot & _U(63))) & _U(1)).astype(bool)

    def idf(self, h: np.ndarray, rare: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Inverse document frequencies; ``rare``: hashes and frequencies that were looked up; any other word is in one document."""
        n = np.ones(len(h))
        for keys, each in ((self.hash, self.n), rare):
            at, there = _at(keys, h)
            n[there] = each[at[there]]
        return np.log1p(self.n_docs / n)


class Vocabulary(dict):
    """Places of words in ``hash`` and ``idf``."""

    def __init__(self, words: Words) -> None:
        super().__init__()
        self.words = words
        self.hash, self.idf = np.zeros(1 << 12, _U), np.zeros(1 << 12)

    def of_content(self, packed: bytes, rare: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of a content and their weights."""
        words = zstandard.ZstdDecompressor().decompress(packed).split(b" ")
        if len(self) > FLUSH_WORDS:
            self.clear()
        if new := [w for w in set(words) if w not in self]:
            n, k = len(self), len(new)
            if n + k > len(self.hash):
                self.hash, self.idf = np.concatenate([self.hash, np.zeros(n + k, _U)]), np.concatenate([self.idf, np.zeros(n + k)])
            h = word_hashes(new, k)
            self.hash[n : n + k], self.idf[n : n + k] = h.view(_U), self.words.idf(h, rare)
            self.update(zip(new, range(n, n + k), strict=True))
        return weighted_shingles(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), self)


def weighted_shingles(words: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles of words (by place) and their weights; a text of fewer than five words is one shingle."""
    place, wh, iw = _tables()["place"], vocabulary.hash[words], vocabulary.idf[words]
    k = min(SHINGLE, len(words))
    m = len(words) - k + 1
    h, weight = np.full(m, _U(k), _U), np.zeros(m)
    for j in range(k):
        h = h + wh[j : j + m] * place[j]
        weight = weight + iw[j : j + m]
    return _summed(_mix(h), weight, k)


def _summed(h: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a content's shingles of k words, each once, and their weights; ``weight``: sums over the words of each."""
    order = h.argsort()
    h = h[order]
    at = np.flatnonzero(np.concatenate([np.ones(1, bool), h[1:] != h[:-1]]))
    return h[at], np.diff(at, append=len(h)) * (weight[order[at]] / k)


def _distinct(k: np.ndarray) -> np.ndarray:
    """In order; sorting is faster than the hash table of ``np.unique``."""
    k = np.sort(k)
    return k[np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]])]


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of binary texts, one after another, by their places among the distinct ones; the hashes of these; and how many words each text has."""
    words, n = split_words(texts)
    each = words.dictionary_encode()
    distinct = bytes_of(each.dictionary)
    return each.indices.to_numpy(), word_hashes(distinct, len(distinct)), n


def weighted_sets(known: Words, rows: Iterable[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What ``Vocabulary.of_content`` gives for each of ``rows`` (packed, rare), in order; words are split and hashed for many contents at once."""
    unpack, place = zstandard.ZstdDecompressor().decompress, _tables()["place"]

    def flush(texts: list[bytes], rare: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes, hashes, n = coded(pa.array(texts, pa.binary()))
        keys, at = np.unique(np.concatenate([k for k, _ in rare]), return_index=True)  # a word's frequency is the same in all contents
        idf = known.idf(hashes, (keys, np.concatenate([x for _, x in rare])[at]))
        wh, iw, ends = hashes.view(_U)[codes], idf[codes], np.cumsum(n)

        def summed(begin: int, end: int, k: int) -> tuple[np.ndarray, np.ndarray]:
            m = end - begin - k + 1
            h, weight = np.full(m, _U(k), _U), np.zeros(m)
            for j in range(begin, begin + k):
                h += wh[j : j + m] * place[j - begin]
                weight += iw[j : j + m]
            return _mix(h), weight

        h, weight = summed(0, len(codes), SHINGLE) if len(codes) >= SHINGLE else (None, None)
        for begin, end in zip((ends - n).tolist(), ends.tolist(), strict=True):
            k = min(SHINGLE, end - begin)
            own = slice(begin, end - SHINGLE + 1)
            yield _summed(*((h[own], weight[own]) if k == SHINGLE else summed(begin, end, k)), k)

    texts, rare, size = [], [], 0
    for packed, r in rows:
        texts.append(unpack(packed))
        rare.append(r)
        size += len(texts[-1])
        if size > SLICE_BYTES:
            yield from flush(texts, rare)
            texts, rare, size = [], [], 0
    if texts:
        yield from flush(texts, rare)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of minima over the sum of maxima."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    least = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def bands(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Hashes of the bands: each sample is the (shingle, quantised log weight) of least rank; of equal ones the first shingle's."""
    t, k, held = _tables(), BANDS * ROWS, _buffers()
    best, where, cell = np.full(k, np.inf, np.float32), np.zeros(k, np.int64), np.zeros(k, np.int64)
    level = (np.rint(np.log(weight) * STEPS) - LEAST_LEVEL).astype(np.uint32) << np.uint32(TABLE_BITS)
    high, row = (h >> _U(32)).astype(np.uint32), np.arange(k)
    for i in range(0, len(h), CHUNK):
        n = min(CHUNK, len(h) - i)
        slot, at, rank = (x[:, :n] for x in held)
        np.multiply(high[i : i + n], t["sample"], out=slot)
        np.right_shift(slot, np.uint32(32 - TABLE_BITS), out=slot)
        np.add(slot, level[i : i + n], out=at, casting="unsafe")
        np.take(t["rank"], at, out=rank, mode="clip")
        least = rank.argmin(axis=1)
        found = rank[row, least]
        better = found < best
        best, where, cell = np.where(better, found, best), np.where(better, i + least, where), np.where(better, at[row, least], cell)
    shingle, entry = h[where], cell & ((1 << TABLE_BITS) - 1)
    step = np.floor(((cell >> TABLE_BITS) + LEAST_LEVEL) / STEPS / t["r"][entry] + t["beta"][entry]).astype(np.int64)
    sample = _mix(shingle + step.astype(_U) * _U(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=_U)
    for j in range(ROWS):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + sample[:, j])
    return out.view(np.int64)


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows of a batch at a time, so that only they are Python objects."""
    return (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))


def _sliced_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same, with a bounded size of texts; a text is never cut."""
    for b in _sliced(batches):
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(h, n): in how many rows of ``docs`` (binary ``text``) each word is, by its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = h.argsort()
            h = h[order]
            at = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]]))
            return h[at], np.add.reduceat(n[order], at) if len(at) else n

        for b in _sliced_texts(batches):
            codes, h, n = coded(b.column("text"))
            if not len(h):
                continue
            once = _distinct(np.repeat(np.arange(len(n)), n) * len(h) + codes)  # each word of a text
            parts.append((h, np.bincount(once % len(h), minlength=len(h))))
            size += len(h)
            if size > FLUSH_HASHES:
                parts = [gathered()]
                size = len(parts[0][0])
                if size > FLUSH_HASHES // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["h", "n"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in gathered()], ["h", "n"])

    return docs.select("text").mapInArrow(giving_back(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def known_words(counts: DataFrame, n_docs: int) -> Words:
    """What every task knows; of a size that doesn't depend on the corpus: 1 / FREQUENT words and 2 ** FILTER_BITS bits."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where(F.col("n") >= FREQUENT * total).toArrow()
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    rest = counts.where((F.col("n") < FREQUENT * total) & (F.col("n") > 1)).select(F.shiftright(slot, 6).alias("slot"), F.expr("1L").alias("one"), slot.bitwiseAND(F.lit(63)).cast("int").alias("by"))
    found = rest.select("slot", F.call_function("shiftleft", "one", "by").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), _U)
    bits[found["slot"].to_numpy()] = found["bit"].to_numpy().view(_U)
    return Words(n_docs, (often["h"].to_numpy(), often["n"].to_numpy()), bits)


def _read(docs: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """(doc_id, th, key, packed, rare): key is null for texts without words; one row of a content in a task has it packed, or a few, with the words to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, known = zstandard.ZstdCompressor(level=1).compress, shared.value
        done: set[bytes] = set()
        for b in _sliced_texts(batches):
            if len(done) > FLUSH_WORDS:
                done.clear()
            words, n = split_words(b.column("text"))
            each = words.dictionary_encode()
            offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)])
            keys, packed = [], []
            for joined in pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), pa.scalar(b" ", pa.binary())).to_pylist():
                key = blake2b(joined, digest_size=16).digest() if joined else None
                keys.append(key and key.hex())
                packed.append(pack(joined) if key is not None and key not in done else None)
                if key is not None:
                    done.add(key)
            distinct = bytes_of(each.dictionary)
            h = word_hashes(distinct, len(distinct))
            first = np.array([x is not None for x in packed])
            row, code = np.repeat(np.arange(len(n)), n), each.indices.to_numpy()
            wanted = first[row] & known.asked(h)[code]
            row, code = np.divmod(_distinct(row[wanted] * max(len(h), 1) + code[wanted]), max(len(h), 1))
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.bincount(row, minlength=len(n)), dtype=np.int32)])
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[code]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(keys, pa.string()), pa.array(packed, pa.binary()), rare], ["doc_id", "th", "key", "packed", "rare"])

    return docs.mapInArrow(giving_back(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, key string, packed binary, rare array<long>")


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """packed, and the looked-up words (sorted) and frequencies of each content."""
    none = np.zeros(0, np.int64)
    for p, h, n in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
        yield p, (np.array(h), np.array(n)) if h else (none, none)


def _sketch(contents: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """(no, bk): the bands of each content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in _sliced(batches):
            found = [bands(*x) for x in weighted_sets(known, _rows(b, "packed", "words", "counts"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("no").to_numpy(), BANDS)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["no", "bk"])

    return contents.select("no", "packed", "words", "counts").mapInArrow(giving_back(run), "no long, bk long")


def _verified(pairs: DataFrame, texts: DataFrame, shared, least: float) -> DataFrame:  # noqa: ANN001
    """(a, b, similar) for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        known: dict[int, tuple] = {}
        last = None
        for batch in _sliced(batches):
            out = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for x, y, p, q in zip(a, b, _rows(batch, "pa", "wa", "ca"), _rows(batch, "pb", "wb", "cb"), strict=True):
                if x != last:
                    last, left = x, v.of_content(*p)
                if y not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[y] = v.of_content(*q)
                out.append(similarity(left, known[y]) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "similar"])

    side = lambda s: texts.select(F.col("no").alias(s), F.col("packed").alias(f"p{s}"), F.col("words").alias(f"w{s}"), F.col("counts").alias(f"c{s}"))
    # neither texts nor pairs are bounded: the same plan for any number of them
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "pa", "wa", "ca", "pb", "wb", "cb")
    return both.mapInArrow(giving_back(run), "a long, b long, similar boolean")


def _shareable(wanted: DataFrame, texts: DataFrame, shared, box: Scratch) -> DataFrame:  # noqa: ANN001
    """(no, total, shared): the weight of a content, and that of its shingles which other wanted contents have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        for b in _sliced(batches):
            for no, x in zip(b.column("no").to_pylist(), _rows(b, "packed", "words", "counts"), strict=True):
                h, weight = v.of_content(*x)
                for i in range(0, len(h), 65536):  # long texts in pieces
                    part = slice(i, i + 65536)
                    rows = [pa.array([no]), pa.array([h[part].view(np.int64).tolist()]), pa.array([weight[part].tolist()])]
                    yield pa.RecordBatch.from_arrays(rows, ["no", "h", "w"])

    found = box.put(texts.join(wanted, "no", "left_semi").mapInArrow(giving_back(run), "no long, h array<long>, w array<double>"))
    total = found.groupBy("no").agg(F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("total"))
    each = found.select("no", F.explode(F.arrays_zip("h", "w")).alias("s")).groupBy("s.h").agg(F.count("*").alias("n"), F.max("no").alias("no"), F.max("s.w").alias("w"))
    alone = each.where("n = 1").groupBy("no").agg(F.sum("w").alias("alone"))
    out = box.put(total.join(alone, "no", "left").select("no", "total", (F.col("total") - F.coalesce("alone", F.lit(0.0))).alias("shared")))
    box.drop(found)
    return out


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _salt(no: str, n: str | Column, block: int) -> Column:
    """A content's block of its bucket of n."""
    return F.pmod(F.xxhash64(no), F.ceil((F.col(n) if isinstance(n, str) else n) / block)).cast("int")


def _each(n: str, block: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / block).cast("int") - 1))


def _groups(multi: DataFrame, texts: DataFrame, shared, least: float, box: Scratch) -> DataFrame | None:  # noqa: ANN001
    """(node, component) of all contents with a link; ``multi`` (bk, no, n): buckets of n contents, two or more."""
    rows = multi.count()
    few = tasks_for(rows)
    links = tested = parts = most = None
    far = (F.col("comp") != F.col("yc")) & (F.col("no") != F.col("y"))
    for turn in range(3):
        if parts is None:
            now = multi.withColumn("comp", F.col("no"))
        else:
            named = parts.select(F.col("node").alias("no"), F.col("component").alias("comp"))
            now = box.put(multi.join(named, "no", "left").withColumn("comp", F.coalesce("comp", "no")).coalesce(few))
        made = [] if now is multi else [now]
        if turn > 0:  # buckets of different components
            per = now.groupBy("bk", "comp").agg(F.count("*").alias("k")).coalesce(few)
            split = per.groupBy("bk").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.count("*").alias("c")).where("c > 1").select("bk", "top")
            split = box.put(split.coalesce(few))
            if split.isEmpty():  # all contents of each bucket are linked
                box.drop(split, *made)
                break
            left = box.put(now.join(split, "bk").coalesce(few))
            if most is None:
                most = _shareable(left.select("no").distinct(), texts, shared, box)
            here = box.put(left.join(most.where(F.col("shared") >= (least - 1e-9) * F.col("total")), "no").coalesce(few))
            common = F.least("shared", "ys")  # at most
            near = common >= (least - 1e-9) * (F.col("total") + F.col("yt") - common)
            made += [split, left, here]
        if turn < 2:
            # any, the same one in all buckets; then the one with the least of its own, which is in the middle of its variants
            order = F.xxhash64("no") if turn == 0 else F.struct(F.col("shared") / F.col("total"), F.xxhash64("no"))
            kept = ["no", "comp"] if turn == 0 else ["no", "comp", "total", "shared"]
            leader = (now if turn == 0 else here).groupBy("bk").agg(F.max_by(F.struct(*kept), F.struct(order, "no")).alias("l"), F.max("n").alias("n"))
            names = dict(zip(kept, ["y", "yc", "yt", "ys"], strict=False))
            leader = leader.select("bk", *[F.col(f"l.{k}").alias(v) for k, v in names.items()], _each("n", LEADER_BLOCK).alias("s"))
            leader = box.put(leader.coalesce(few))
            made.append(leader)
            member = (now if turn == 0 else here).withColumn("s", _salt("no", "n", LEADER_BLOCK))
            met = member.join(leader, ["bk", "s"]).where(far if turn == 0 else far & near)
        else:  # the rest, the largest of a bucket on one side only; each block with each
            mine = left.groupBy("no").agg(F.array_sort(F.collect_set("bk")).alias("bks"))  # at most one for each band
            here2 = box.put(here.join(mine, "no").coalesce(few))
            x = here2.where("comp <> top").select("bk", "no", "comp", "total", "shared", F.col("bks").alias("xb"), _salt("no", "n", BLOCK).alias("s"), _each("n", BLOCK).alias("t"))
            y = here2.select("bk", F.col("no").alias("y"), F.col("comp").alias("yc"), F.col("total").alias("yt"), F.col("shared").alias("ys"), F.col("bks").alias("yb"), "top", _salt("no", "n", BLOCK).alias("t"), _each("n", BLOCK).alias("s"))
            once = (F.col("yc") == F.col("top")) | (F.col("no") < F.col("y"))
            first = F.array_min(F.array_intersect("xb", "yb")) == F.col("bk")
            met = x.join(y, ["bk", "s", "t"]).where(far & near & once & first)
            made.append(here2)
        found = _pairs(met.withColumnRenamed("no", "x").coalesce(few)).coalesce(few)
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti").coalesce(few)
        found = box.put(found)
        seen = box.put(_verified(found, texts, shared, least))
        box.drop(found, *made)
        more = seen.where("similar").select("a", "b")
        tested = seen.select("a", "b") if tested is None else tested.unionByName(seen.select("a", "b"))
        if more.isEmpty():
            continue  # other leaders, or the rest, may still match
        links = more if links is None else links.unionByName(more)
        inner = Scratch(multi.sparkSession)
        before, parts = parts, box.put(connected_components(links, "a", "b", box=inner).coalesce(few))
        inner.drop()
        box.drop(before) if before is not None else None
    return parts


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, th (hash of the text), key (of the content), component and class_id.

    component names the group by a number; it is null without words.  class_id is the smallest doc_id of the group:
    copies and all contents linked, directly or through others, by a similarity of at least ``least``.  Null, empty
    and blank texts are alone: their class is their own doc_id.  Texts of fewer than five words match only if they
    have the same words.  Very long texts are compared whole.  Rows equal in id and text get a row each.  Null
    doc_ids are never a class unless the whole group has none.  An empty table gives no rows.  Columns other than
    doc_id and text are ignored.
    """
    box = Scratch(docs.sparkSession)
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    counts = box.put(document_frequencies(base))
    shared = docs.sparkSession.sparkContext.broadcast(known_words(counts, docs.count()))

    read = box.put(_read(base, shared))
    members = box.put(read.select("doc_id", "th", "key"))
    # all three by key, so the texts are shuffled once
    named = read.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    packed = read.where("packed is not null").groupBy("key").agg(F.first("packed").alias("packed"))
    asked = read.where("packed is not null").select("key", F.explode("rare").alias("h")).join(counts.where("n > 1"), "h")
    words = asked.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("h", "n"))).alias("r"))
    full = packed.join(named, "key").join(words, "key", "left").withColumn("no", F.monotonically_increasing_id())  # written once, so numbers stay
    full = box.put(full.select("no", "key", "first_id", "packed", F.col("r.h").alias("words"), F.col("r.n").alias("counts")))
    contents = full.select("no", "key", "first_id")
    box.drop(counts, read)

    entries = box.put(_sketch(full, shared))
    several = box.put(entries.groupBy("bk").agg(F.count("*").alias("n")).where("n > 1"))
    multi = box.put(entries.join(several, "bk"))
    box.drop(entries, several)
    classes = contents.select("key", F.col("no").alias("component"), F.col("first_id").alias("class_id"))
    if not multi.isEmpty():
        texts = box.put(full.drop("key", "first_id").join(multi.select("no").distinct().hint("merge"), "no", "left_semi"))
        parts = _groups(multi, texts, shared, least, box)
        box.drop(texts)
        if parts is not None:
            joined = contents.select("key", "no", "first_id").join(parts, F.col("no") == F.col("node"), "left")
            joined = box.put(joined.select("key", F.coalesce("component", "no").alias("component"), "first_id"))
            lowest = box.put(joined.groupBy("component").agg(F.min("first_id").alias("class_id")))
            classes = box.put(joined.join(lowest, "component").select("key", "component", "class_id"))
            box.drop(joined, lowest, parts, full)
    box.drop(multi)
    classes = classes.withColumnRenamed("key", "k")
    out = members.join(classes, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", "th", "key", "component", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates: the smallest doc_id of each group stays.

    A group is a component, whatever its ids: groups without an id, or that share one, keep a row each.  Null, empty
    and blank texts all stay, but rows equal in id and text once.  Of several rows with the smallest id any one of the
    smallest text key stays.  Very long texts are compared whole.  An empty table stays empty; columns may have any
    names besides doc_id and text.
    """
    box = Scratch(docs.sparkSession)
    named = box.put(near_duplicates(docs, least))
    lowest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "th")).alias("l")  # null ids last
    stay = named.where("key is not null").groupBy("component").agg(lowest).select("l.doc_id", "l.th")
    d, h = fresh(docs.columns, "kept_id"), fresh(docs.columns, "kept_hash")
    one = box.put(stay.unionByName(named.where("key is null").select("doc_id", "th").distinct()).select(F.col("doc_id").alias(d), F.col("th").alias(h)))
    own = fresh(docs.columns, "text_hash")
    rows = docs.withColumn(own, F.xxhash64("text"))
    out = rows.join(one, F.col("doc_id").eqNullSafe(F.col(d)) & F.col(own).eqNullSafe(F.col(h)), "left_semi")
    if not named.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", own])
    box.drop(named)
    return out.select(*[col(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
