"""Removes word passages that a document with a smaller id has too, by FM-indexes of shards.

1. Every window of ``length`` words has an anchor: the least hash of its five-word runs.  Equal windows have equal
   anchors, so a passage can only be met in the shard of its anchor.  Successive windows of one anchor make a segment
   (at most ``RUN`` windows).  Anchors that one document alone has are put aside before any words are shuffled.
2. Segments are dealt out by anchor; equal ones collapse to one with the smallest and largest id, so copies of a text
   cost one search.  Each task builds compressed FM-indexes of at most about ``SHARD_WORDS`` words and streams the
   shard's segments through them: backward search tells for each window the smallest id that has it.
3. An anchor with more than ``BIG_ANCHOR`` words of distinct segments (thousands of variants of one text) isn't given
   to one task: its windows are dealt out each by its own hash and their smallest ids counted there.
4. The windows with a smaller id come back to their documents as spans of words.

Anchors are 64-bit hashes, which may collide without harm; segments have 128-bit keys; the indexes compare words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import Scratch, col, fresh, giving_back
from .fm_index import FMIndex

LENGTH = 50
ANCHOR, RUN = 5, 64
SHARD_WORDS, BIG_ANCHOR = 1 << 19, 1 << 20
#: Bytes of a text that are split at once, rows that are Python objects at once, words that a task knows.
PIECE_BYTES, SLICE, KNOWN = 1 << 20, 128, 300_000
#: Stands for a null doc_id: it comes after all others, and nulls are equal.
LAST = (1 << 63) - 1

_U = np.uint64
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_ODD = np.random.default_rng(13).integers(0, 1 << 63, ANCHOR, dtype=_U) * _U(2) + _U(1)


class _Hashes(dict):
    """Hashes of words, each worked out once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxh64_intdigest(word)
        return h

    def of_text(self, text: bytes | None) -> np.ndarray:
        found, i = [np.zeros(0, _U)], 0
        while text and i < len(text):
            space = _SPACE.search(text, i + PIECE_BYTES)
            j = space.start() if space else len(text)
            words = text[i:j].split()
            found.append(np.fromiter(map(self.__getitem__, words), _U, len(words)))
            i = j
            if len(self) > KNOWN:
                self.clear()
        return np.concatenate(found)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _runs(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each segment."""
    n, k = len(words) - length + 1, min(ANCHOR, length)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(words) - k + 1
    h = np.zeros(m, _U)
    for j in range(k):
        h += _mix(words[j : j + m] * _ODD[j] + _U(j))
    h, width, seen = _mix(h), length - k + 1, 1
    while seen < width:  # least of the next ``seen``
        step = min(seen, width - seen)
        h = np.minimum(h[:-step], h[step:])
        seen += step
    cut = np.flatnonzero(np.concatenate([np.ones(1, bool), h[1:] != h[:-1]]))
    size = np.diff(cut, append=n)
    if (size > RUN).any():
        parts = -(-size // RUN)
        cut = np.repeat(cut, parts) + RUN * (np.arange(parts.sum()) - np.repeat(parts.cumsum() - parts, parts))
        size = np.diff(cut, append=n)
    return h[cut].view(np.int64), cut, size


def _slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """A few rows at a time as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE)
            yield list(zip(*(part.column(c).to_pylist() for c in columns), strict=True))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(id, th, anchor, start, n): the segments of each row of (id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for rows in _slices(batches, "id", "th", "text"):
            found = [(i, th, *_runs(hashes.of_text(text), length)) for i, th, text in rows]
            sizes = [len(x[2]) for x in found]
            ids = [np.repeat(np.array([x[k] for x in found], np.int64), sizes) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in [*ids, *(np.concatenate([x[k] for x in found]) for k in (2, 3, 4))]], ["id", "th", "anchor", "start", "n"])

    return docs.mapInArrow(giving_back(run), "id long, th long, anchor long, start long, n long")


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """(key, anchor, id, th, start, n, words) of rows (id, th, text, runs); a task gives the words of a key once in a while."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for rows in _slices(batches, "id", "th", "text", "runs"):
            out = []
            for i, th, text, runs in rows:
                words = text.split()
                for r in runs:
                    own = b" ".join(words[r["start"] : r["start"] + r["n"] + length - 1])
                    key = xxh3_128_digest(own)
                    out.append((key, r["anchor"], i, th, r["start"], r["n"], None if key in given else own))
                    given.add(key)
            if len(given) > KNOWN:
                given.clear()
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.binary(), *[pa.int64()] * 5, pa.binary()], strict=True)], names)

    names = ["key", "anchor", "id", "th", "start", "n", "words"]
    return docs.mapInArrow(giving_back(run), "key binary, anchor long, id long, th long, start long, n long, words binary")


def _searched(rows: DataFrame, length: int) -> DataFrame:
    """(key, start, least): per segment the windows that a smaller id than its largest has, and the smallest id.

    ``rows`` (key, anchor, words, lo, hi) come with all of an anchor in one task, key by key: some with the words of a
    segment, one with its ids.
    """

    def found(held: list[list]) -> pa.RecordBatch:
        names: dict[bytes, int] = {}
        words = [np.array([names.setdefault(w, len(names)) for w in x[2].split(b" ")], np.int64) for x in held]
        sizes, flat = np.array([len(x) for x in words]), np.concatenate(words)
        index = FMIndex(flat, sizes, np.array([x[3] for x in held], np.int64), length)
        least = index.search(flat, sizes, LAST)
        owner = np.repeat(np.arange(len(held)), sizes)
        hit = np.flatnonzero(least < np.array([x[4] for x in held], np.int64)[owner])
        starts = hit - (sizes.cumsum() - sizes)[owner[hit]]
        return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in owner[hit]], pa.binary()), pa.array(starts), pa.array(least[hit])], ["key", "start", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in _slices(batches, "key", "anchor", "words", "lo", "hi"):
            for x in part:
                if held and held[-1][0] == x[0]:
                    held[-1] = [a if a is not None else b for a, b in zip(held[-1], x, strict=True)]
                    continue
                if size >= SHARD_WORDS and x[1] != held[-1][1]:
                    yield found(held)
                    held, size = [], 0
                held.append(list(x))
                size += length + RUN // 2
        if held:
            yield found(held)

    return rows.mapInArrow(giving_back(run), "key binary, start long, least long")


def _windows(segments: DataFrame, length: int) -> DataFrame:
    """(key, start, window, lo, hi): each window of a segment by a hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, "key", "words", "lo", "hi"):
            split = [(key, words.split(b" "), lo, hi) for key, words, lo, hi in rows]
            out = [(key, i, xxh3_128_digest(b" ".join(words[i : i + length])), lo, hi) for key, words, lo, hi in split for i in range(len(words) - length + 1)]
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "start", "window", "lo", "hi"])

    return segments.select("key", "words", "lo", "hi").mapInArrow(giving_back(run), "key binary, start long, window binary, lo long, hi long")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, th, starts): the windows of ``length`` words, by the number of their first word, that a smaller doc_id has too.

    One row for each doc_id and text (``th``, its 64-bit hash) that has such windows; ``id`` is the doc_id, or ``LAST``
    for null.  doc_id must be an integer.  Null ids come after all others and are equal to each other; rows that share
    an id aren't compared, so repeated rows are treated alike.  Null and empty texts and those of fewer than ``length``
    words have none; very long texts are searched whole.  Other columns are ignored, and an empty table gives no rows.
    """
    box = Scratch(docs.sparkSession)
    base = docs.select(*_key(), F.col("text").cast("binary").alias("text"))
    anchors = box.put(_anchors(base, length))
    several = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    runs = anchors.join(several, "anchor").groupBy("id", "th").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("runs"))
    # of rows equal in id and text one is enough
    there = box.put(_segments(base.join(runs, ["id", "th"]), length))
    box.drop(anchors)
    seen = box.put(there.groupBy("key").agg(F.first("anchor").alias("anchor"), F.first("n").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")))
    size = F.sum(F.col("n") + length - 1)
    big = box.put(seen.groupBy("anchor").agg(size.alias("size")).where(F.col("size") > BIG_ANCHOR))
    total = seen.agg(F.coalesce(size, F.lit(0))).first()[0]
    none = F.lit(None).cast("long")
    given = there.where("words is not null").select("key", "anchor", "words", none.alias("lo"), none.alias("hi"))
    known = seen.select("key", "anchor", F.lit(None).cast("binary").alias("words"), "lo", "hi")
    shards = given.unionByName(known).join(big, "anchor", "left_anti").repartition(max(1, -(-int(total) // SHARD_WORDS)), "anchor").sortWithinPartitions("anchor", "key")
    hits = _searched(shards, length)
    if not big.isEmpty():
        words = given.join(big, "anchor", "left_semi").groupBy("key").agg(F.first("words").alias("words"))
        each = box.put(_windows(words.join(seen, "key"), length))
        lowest = each.groupBy("window").agg(F.min("lo").alias("least"))
        hits = hits.unionByName(each.join(lowest, "window").where("least < hi").select("key", "start", "least"))
    hits = box.put(hits.groupBy("key").agg(F.collect_list(F.struct("start", "least")).alias("found")))
    box.drop(seen)
    mine = there.select("key", "id", "th", F.col("start").alias("first")).join(hits, "key")
    starts = F.transform(F.filter("found", lambda x: x["least"] < F.col("id")), lambda x: x["start"] + F.col("first"))
    each = mine.select("id", "th", starts.alias("s")).where("size(s) > 0")
    out = box.put(each.groupBy("id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("starts")))
    box.drop(*[t for t, _ in box.tables if t is not out])
    return out


def _key() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("th")]


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with all their columns, and ``n_words`` and ``n_removed``: ``text`` has the kept words, joined by one space.

    Cases are those of ``repeated_spans``: every row stays, a null text becomes empty, and columns may have any names
    besides doc_id and text (those named like the two new ones come back under another name, with a number).
    """
    spans = repeated_spans(docs, length)
    i, th = fresh(docs.columns, "id"), fresh(docs.columns, "th")
    starts = fresh(docs.columns, "starts")
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(_key(), (i, th), strict=True)])
    both = keyed.join(spans.select(F.col("id").alias(i), F.col("th").alias(th), F.col("starts").alias(starts)), [i, th], "left").drop(i, th)
    own = [c if c not in ("n_words", "n_removed") else fresh(docs.columns, c) for c in docs.columns]
    names = [f"c{k}" for k in range(len(own))]  # helpers of batches don't take every name
    kinds = [T.StringType() if c == "text" else docs.schema[c].dataType for c in docs.columns]
    schema = T.StructType([T.StructField(n, k) for n, k in zip([*names, "n_words", "n_removed"], [*kinds, T.LongType(), T.LongType()], strict=True)])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                texts, n_words, n_removed = [], [], []
                for text, found in zip(part.column(at).to_pylist(), part.column(len(own)).to_pylist(), strict=True):
                    words = text.encode().split() if text else []
                    n_words.append(len(words))
                    if found:
                        change = np.zeros(len(words) + 1, np.int64)
                        s = np.array(found)
                        change[s] += 1
                        change[s + length] -= 1
                        words = [words[i] for i in np.flatnonzero(change[:-1].cumsum() == 0)]
                    n_removed.append(n_words[-1] - len(words))
                    texts.append(b" ".join(words).decode())
                columns = [part.column(k) for k in range(len(own))]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], schema.names)

    columns = [col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)]
    return both.select(*columns, starts).mapInArrow(giving_back(run), schema).toDF(*own, "n_words", "n_removed")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return drop_repeats(docs.select("doc_id", "text"), length).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Windows of the contract, joined on their words.
ORACLE = """
with d as (select doc_id, string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') as raw from documents),
w as (select doc_id, list_filter(raw, lambda x: x <> '') as words from d),
win as (select doc_id, p, md5(array_to_string(words[p + 1:p + 50], ' ')) as h from w, lateral (select unnest(range(0, greatest(len(words) - 49, 0))) as p)),
least as (select h, min(doc_id) as lo from win group by h),
hit as (select doc_id, p from win join least using (h) where lo < doc_id),
gone as (select distinct doc_id, p + o as i from hit, (select unnest(range(0, 50)) as o)),
each as (select doc_id, i - 1 as i, words[i] as word, len(words) as n from w, lateral (select unnest(range(1, len(words) + 1)) as i)),
kept as (
  select doc_id, count(g.i) as n_removed, coalesce(string_agg(case when g.i is null then word end, ' ' order by e.i), '') as text
  from each e left join gone g using (doc_id, i) group by doc_id
)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from w left join kept k using (doc_id)
"""
