"""Groups spelling variants: words one edit apart, found by a positional q-gram index with a count filter.

1. Words are counted by tasks and summed in Spark.
2. A word of l letters, padded at both ends, has l + Q - 1 grams; one edit spoils at most Q of them, so two near
   words share at least max(l) - 1, each at most one position apart.  Their Q + 1 rarest grams in one global order
   then have one in common.  Each word goes to the shards of these, so a pair meets in one, and the first such one
   reports it.  The order is by frequency in a table of ``GRAM_BITS`` bits, whose size doesn't depend on the corpus.
3. In a shard an inverted index maps a gram and a length to the positions of words.  A word's Q + 1 shortest postings
   are heap-merged under the length and position limits; whoever is met is counted in the longer ones too, and pairs
   that reach the bound are verified letter by letter.
4. A shard of more than ``BLOCK`` words is cut into blocks; each block is indexed by one task and searched for all
   words of the shard, so no task gathers more.
5. A word's form is its near word of largest count if that is twice its own.  Counts at least double with every step,
   so roots are found by at most six rounds of pointer doubling.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

Q, LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 4, 5, 3, 2
#: One in so many (document, word) pairs loses a letter, as if misspelt.
MISSPELT = 97
GRAM_BITS, BLOCK, KNOWN, SLICE = 20, 20_000, 300_000, 128
#: Letters are A-Z, a-z and U+00C0 to U+00FF, one byte each in this encoding; anything beyond it becomes "?".
CODE = "latin-1"
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode(CODE).encode()


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least ``LEAST_LENGTH`` letters in all texts after misspelling, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode(CODE) for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        crc = zlib.crc32
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    found = Counter(text.encode(CODE, "replace").translate(_LETTERS).split())
                    begun = crc(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
                    words = list(found)
                    h = np.fromiter([crc(w if w.isascii() else _utf8(w), begun) for w in words], np.int64, len(words))
                    lost = np.flatnonzero(h % MISSPELT == 0).tolist()
                    spoilt = [(words[k], int(h[k]) % len(words[k]), found.pop(words[k])) for k in lost]
                    total.update(found)
                    for w, at, n in spoilt:
                        total[w[:at] + w[at + 1 :]] += n
                    if len(total) > KNOWN:
                        yield flush()
                        total.clear()
        yield flush()

    each = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return each.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))


def _padded(word: bytes) -> bytes:
    return b"\x01" * (Q - 1) + word + b"\x02" * (Q - 1)


def grams(word: bytes) -> list[bytes]:
    """The grams of a word in order, both ends padded by bytes that no word has."""
    padded = _padded(word)
    return [padded[i : i + Q] for i in range(len(padded) - Q + 1)]


def numbered(found: list[bytes]) -> list[bytes]:
    """Grams of a word told apart by how often they were there before."""
    if len(set(found)) == len(found):
        return [g + b"\0" for g in found]
    seen: Counter[bytes] = Counter()
    out = []
    for g in found:
        out.append(g + bytes([min(seen[g], 255)]))
        seen[g] += 1
    return out


def _slot(gram: bytes) -> int:
    return zlib.crc32(gram) >> (32 - GRAM_BITS)


def gram_counts(words: DataFrame) -> DataFrame:
    """(slot, n): how many words have grams of each slot; at most 2 ** GRAM_BITS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << GRAM_BITS, np.int64)
        for b in batches:
            slots = [_slot(g) for w in b.column("word").to_pylist() for g in numbered(grams(w.encode(CODE)))]
            n += np.bincount(np.array(slots, np.int64), minlength=1 << GRAM_BITS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    return words.select("word").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def _sharded(words: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """(shard, word, n, rare): a row for each of a word's rarest grams; ``rare`` has them one behind the other in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of = shared.value
        for b in batches:
            out = []
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                rare = sorted(numbered(grams(word.encode(CODE))), key=lambda g: (n_of[_slot(g)], g))[: Q + 1]
                joined = b"".join(rare)
                out += [(g, word, n, joined) for g in rare]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.binary(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "word", "n", "rare"])

    return words.select("word", "n").mapInArrow(run, "shard binary, word string, n long, rare binary")


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether words of which b is not the shorter differ by exactly one inserted, deleted or replaced letter."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(b) == n else a[i:] == b[i + 1 :])


class GramIndex:
    """Words of one shard: (gram, length) to (number of the word, position), numbers ascending."""

    def __init__(self) -> None:
        self.postings: defaultdict[tuple[bytes, int], list[tuple[int, int]]] = defaultdict(list)
        self.words: list[bytes] = []
        self.padded: list[bytes] = []

    def add(self, word: bytes) -> None:
        for p, g in enumerate(grams(word)):
            self.postings[g, len(word)].append((len(self.words), p))
        self.words.append(word)
        self.padded.append(_padded(word))

    def near(self, word: bytes) -> Iterator[int]:
        """Numbers of the words one edit away that are longer by a letter, or as long and later in the alphabet."""
        own, get = list(enumerate(grams(word))), self.postings.get
        for size in (len(word), len(word) + 1):
            found = sorted([(p, g, get((g, size), ())) for p, g in own], key=_posting_length)
            least = size - 1  # common grams
            short = len(own) - least + 1
            lists = [x for p, _, there in found[:short] if there and (x := [no for no, at in there if -2 < at - p < 2])]
            if not lists:
                continue
            for no, n in Counter(merge(*lists) if len(lists) > 1 else lists[0]).items():
                if size == len(word) and word >= self.words[no]:
                    continue
                lacking = n + len(found) - short - least  # so many of the longer postings may be without it
                padded = self.padded[no]
                for p, g, _ in found[short:]:
                    if lacking < 0:
                        break
                    if padded.find(g, p - 1 if p else 0, p + 1 + Q) < 0:
                        lacking -= 1
                if lacking >= 0 and one_edit(word, self.words[no]):
                    yield no


def _posting_length(x: tuple) -> int:
    return len(x[2])


def _first_common(a: bytes, b: bytes) -> bytes:
    """The first gram in the global order that two words have among their rarest."""
    theirs = {b[i : i + Q + 1] for i in range(0, len(b), Q + 1)}
    return next(g for i in range(0, len(a), Q + 1) if (g := a[i : i + Q + 1]) in theirs)


def _pairs(rows: DataFrame) -> DataFrame:
    """(word, near, near_n) of both of each pair.

    The rows of a (shard, block) come one behind the other in one task, those that its index has first; the others are
    only searched for and not held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, held, out = None, GramIndex(), [], []

        def search(word: bytes, n: int, rare: bytes) -> None:
            for no in index.near(word):
                other, m, its = held[no]
                if _first_common(rare, its) == at[0]:  # a pair is met in every shard that it shares
                    out.extend(((word, other, m), (other, word, n)))

        def batch() -> pa.RecordBatch:
            a, b, n = ([x[i] for x in out] for i in range(3))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.decode(CODE) for x in a], pa.string()), pa.array([x.decode(CODE) for x in b], pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

        for b in batches:
            for shard, block, word, n, rare, indexed in zip(*(b.column(c).to_pylist() for c in ("shard", "block", "word", "n", "rare", "indexed")), strict=True):
                if (shard, block) != at:
                    if len(held) > 1:
                        for x in held:
                            search(*x)
                    at, index, held = (shard, block), GramIndex(), []
                word = word.encode(CODE)
                if indexed:
                    held.append((word, n, rare))
                    index.add(word)
                else:
                    search(word, n, rare)
                if len(out) > 10_000:
                    yield batch()
        for x in held:
            search(*x)
        yield batch()

    return rows.mapInArrow(run, "word string, near string, near_n long")


def near_words(words: DataFrame, box: Scratch) -> DataFrame:
    """(word, near, near_n): each ordered pair of words (word, n) that one edit tells apart."""
    spark = words.sparkSession
    counts = np.zeros(1 << GRAM_BITS, np.int64)
    found = gram_counts(words).toArrow()
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    rows = box.put(_sharded(words, spark.sparkContext.broadcast(counts)))
    big = box.put(rows.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK).cast("int"), F.lit(1))
    rows = rows.join(big, "shard", "left").withColumn("blocks", blocks)
    rows = rows.select("shard", "word", "n", "rare", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("word"), "blocks").alias("own"))
    rows = rows.select("shard", "block", "word", "n", "rare", (F.col("block") == F.col("own")).alias("indexed"))
    dealt = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", F.desc("indexed"))
    return _pairs(dealt)


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the texts with its likely right spelling.

    ``form`` is the near word of largest count (ties: smallest by code points) if that is at least twice the word's own,
    else null; ``root`` follows forms to the last.  Null and empty texts have no words; very long texts are read whole;
    a null doc_id stands as an empty one in what decides on misspellings; repeated rows count as often as they are there.
    An empty table gives no rows, and other columns are ignored.
    """
    box = Scratch(docs.sparkSession)
    words = box.put(counted(docs).where(F.col("n") >= LEAST_COUNT))
    inner = Scratch(docs.sparkSession)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    near = near_words(words, inner).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form = F.when(-F.col("best.n") >= FORM_RATIO * F.col("n"), F.col("best.near"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n"))
    out = box.put(out)
    inner.drop()
    box.drop(words)
    roots = box.put(out.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not roots.where("moved").isEmpty():
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = box.put(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        box.drop(roots)
        roots = further
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(docs)


#: CRC-32 by its table of 256 entries, made by rule; near words by their deletions.
ORACLE = """
with recursive tab as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)
  )
),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents where text is not null
),
each as (select doc_id, run, count(*) as n, hex(encode(doc_id || ':' || run)) as x from runs group by all),
hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h
  from each, tab
),
spelt as (select case when h % 97 = 0 then substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) else run end as word, n from hashed),
words as materialized (select word, cast(sum(n) as bigint) as n from spelt where len(word) >= 5 group by word having sum(n) >= 3),
del as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as v from words, lateral (select unnest(range(0, len(word))) as i)),
near as (
  select distinct a.word, b.word as near, b.n as near_n from del a join del b on a.v = b.v and a.i = b.i and a.word <> b.word and len(a.word) = len(b.word)
  union select distinct a.word, b.word, b.n from del a join words b on a.v = b.word
  union select distinct b.word, a.word, a.n from del a join words b on a.v = b.word
),
best as (select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from near group by word),
formed as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end as form_n
  from words w left join best using (word)
),
walk as (
  select word, word as here, 0 as depth from formed
  union all select k.word, f.form, depth + 1 from walk k join formed f on f.word = k.here where f.form is not null
),
roots as (select word, arg_max(here, depth) as root from walk group by word)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""
