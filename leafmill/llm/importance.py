"""Draws the documents most like a target text collection: importance resampling on hashed word n-grams.

1. Words of documents and targets are counted; each distinct word gets an integer id.  Frequent words (``SHARE`` of
   all occurrences, so at most 1 / SHARE of them) are numbered by rank and known to every task; rarer ones are
   numbered in the table and come to their rows by one join.
2. Texts become sequences of ids, and n-grams tuples of ids.  Tuples are counted over both collections; single ids have
   the counts of their words.
3. The bytes of each distinct tuple are put together from the words once, by a join, and hashed into a bucket.
4. Buckets' counts give gains, a table of fixed size.  Counts are joined back: frequent tuples by a table of at most
   1 / SHARE rows, the rest by a join of a row's tuples.  Where tuples are single ids both joins are one.
5. Log weights plus Gumbel noise rank the documents; ranks come from a sort by ranges.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tasks_for

ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
SHARE = 2e-6
#: Longer words are never known to every task.
MAX_KNOWN_BYTES = 64
KNOWN, SLICE = 300_000, 128
#: Word bytes: digits, letters (A-Z lower-cased) and all beyond ASCII.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def split(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def _slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE)
            yield list(zip(*(part.column(c).to_pylist() for c in columns), strict=True))


def _by_side(keys, total: tuple[Counter, Counter]) -> list[pa.Array]:  # noqa: ANN001
    return [pa.array([c[k] for k in keys], pa.int64()) for c in total]


def counted_words(texts: DataFrame) -> DataFrame:
    """(word, s, t): how often each word is in documents and in targets; ``texts`` has target and text (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            keys = list(total[0].keys() | total[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *_by_side(keys, total)], ["word", "s", "t"])

        for rows in _slices(batches, "target", "text"):
            for target, text in rows:
                total[target].update(split(text))
            if len(total[0]) + len(total[1]) > KNOWN:
                yield flush()
                total[0].clear(), total[1].clear()
        yield flush()

    return texts.select("target", "text").mapInArrow(run, "word binary, s long, t long").groupBy("word").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def dictionary(words: DataFrame, box: Scratch) -> tuple[DataFrame, dict[bytes, int]]:
    """(word, id, s, t) of all words, and the ids of the frequent ones, which are the smallest."""
    n = F.col("s") + F.col("t")
    total = words.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    often = (n >= SHARE * total) & (F.octet_length("word") <= MAX_KNOWN_BYTES)
    found = words.where(often).withColumn("n", n).toArrow().sort_by([("n", "descending"), ("word", "ascending")]).drop_columns("n")
    known = {w: i for i, w in enumerate(found["word"].to_pylist())}
    named = words.sparkSession.createDataFrame(found.append_column("id", pa.array(range(len(known)), pa.int64())))
    rest = words.where(~often).withColumn("id", F.monotonically_increasing_id() + len(known))
    return box.put(named.unionByName(rest)), known


def gains_of(counts: DataFrame, buckets: int) -> DataFrame:
    """``counts`` (bucket, s, t, ...) with the ``gain`` of each row's bucket; there are at most ``buckets`` of them."""
    held = counts.groupBy("bucket").agg(F.sum("s").alias("bs"), F.sum("t").alias("bt"))
    s, t = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    d = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("double")
    gain = F.floor(1000 * F.ln(d(F.col("bt") + 1) * d(s + buckets) / (d(F.col("bs") + 1) * d(t + buckets))))
    return counts.join(F.broadcast(held.select("bucket", gain.alias("gain"))), "bucket")


def word_weights(rows: DataFrame, words: DataFrame, known: dict[bytes, int], buckets: int, box: Scratch) -> DataFrame:
    """(row, doc_id, th, n_words, n_features, weight) where tuples are single ids: their counts are those of the dictionary.

    A text's frequent words are ids of the table that every task has, with their gains; its rarer ones are joined.
    """
    gains = box.put(gains_of(words.withColumn("bucket", F.crc32("word") % buckets), buckets).select("word", "id", "gain"))
    often = gains.where(F.col("id") < len(known)).select("id", "gain").toArrow().sort_by("id")
    shared = words.sparkSession.sparkContext.broadcast((known, often["gain"].to_numpy()))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, gain = shared.value
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                n_words, sums, many, rare, times = [], [], [0], [], []
                for text in part.column("text").to_pylist():
                    found = split(text)
                    ids = np.fromiter((of.get(w, -1) for w in found), np.int64, len(found))
                    n_words.append(len(found))
                    sums.append(int(gain[ids[ids >= 0]].sum()) if len(ids) else 0)
                    own = Counter(found[k] for k in np.flatnonzero(ids < 0))
                    rare += own.keys()
                    times += own.values()
                    many.append(len(rare))
                rest = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
                columns = [*(part.column(c) for c in ("row", "doc_id", "th")), pa.array(n_words, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(many, pa.int32()), rest)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "th", "n_words", "weight", "rest"])

    first = box.put(rows.where("not target").select("row", "doc_id", "th", "text").mapInArrow(run, f"row long, doc_id {kind}, th long, n_words long, weight long, rest array<struct<word: binary, n: long>>"))
    asked = first.select("row", F.explode("rest").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("n"))
    rest = asked.join(gains, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("more"))
    weight = (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight")
    return first.drop("rest").join(rest, "row", "left").select("row", "doc_id", "th", "n_words", F.col("n_words").alias("n_features"), weight)


def encoded(rows: DataFrame, words: DataFrame, known, box: Scratch) -> DataFrame:  # noqa: ANN001
    """``rows`` (row, target, doc_id, th, text) with ids instead of text: all words of a row as packed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                ids, rare = [], []
                for text in part.column("text").to_pylist():
                    found, own = [], {}
                    for w in split(text):
                        at = of.get(w)
                        if at is None:
                            at = own.setdefault(w, -1 - len(own))  # the row's own number of a rare word
                        found.append(at)
                    ids.append(np.array(found, np.int64).tobytes())
                    rare.append(list(own))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "target", "doc_id", "th")), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names)

    names = ["row", "target", "doc_id", "th", "ids", "rare"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    first = box.put(rows.mapInArrow(run, f"row long, target boolean, doc_id {kind}, th long, ids binary, rare array<binary>"))
    asked = first.select("row", F.posexplode("rare").alias("k", "word")).join(words, "word").groupBy("row")
    rest = asked.agg(F.array_sort(F.collect_list(F.struct("k", "id"))).getField("id").alias("theirs"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                out = []
                for packed, theirs in zip(part.column("ids").to_pylist(), part.column("theirs").to_pylist(), strict=True):
                    ids = np.frombuffer(packed, np.int64).copy()
                    if theirs:
                        rare = ids < 0
                        ids[rare] = np.array(theirs, np.int64)[~ids[rare]]
                    out.append(ids.tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:4]), pa.array(out, pa.binary())], names[:5])

    both = first.drop("rare").join(rest, "row", "left")
    out = box.put(both.mapInArrow(fill, f"row long, target boolean, doc_id {kind}, th long, ids binary"))
    box.drop(first)
    return out


def tuples(packed: bytes, order: int) -> dict[bytes, int]:
    """Runs of one to ``order`` ids, packed, and how often each is there."""
    ids = np.frombuffer(packed, np.int64)
    out: dict[bytes, int] = {}
    for k in range(1, min(order, len(ids)) + 1):
        runs, n = np.unique(np.lib.stride_tricks.sliding_window_view(ids, k), axis=0, return_counts=True) if k > 1 else np.unique(ids, return_counts=True)
        flat, step = np.ascontiguousarray(runs).tobytes(), 8 * k
        out.update(zip((flat[i : i + step] for i in range(0, len(flat), step)), n.tolist(), strict=True))
    return out


def _lists(keys: list[bytes]) -> pa.ListArray:
    """Packed tuples as lists of ids."""
    ends = np.cumsum([0, *(len(k) // 8 for k in keys)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(keys), np.int64)))


def counted_tuples(coded: DataFrame, order: int) -> DataFrame:
    """(tuple, s, t): how often each tuple of ids is in documents and in targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            keys = list(total[0].keys() | total[1].keys())
            return pa.RecordBatch.from_arrays([_lists(keys), *_by_side(keys, total)], ["tuple", "s", "t"])

        for rows in _slices(batches, "target", "ids"):
            for target, ids in rows:
                total[target].update(tuples(ids, order))
            if len(total[0]) + len(total[1]) > KNOWN:
                yield flush()
                total[0].clear(), total[1].clear()
        yield flush()

    return coded.select("target", "ids").mapInArrow(run, "tuple array<long>, s long, t long").groupBy("tuple").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def bucketed(counts: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """``counts`` with the bucket of each tuple: the CRC-32 of its words, put together by a join."""
    each = counts.select("tuple", F.posexplode("tuple").alias("i", "id")).join(words, "id")
    parts = F.array_sort(F.collect_list(F.struct("i", F.hex("word").alias("word"))))
    spelt = each.groupBy("tuple").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["word"]), "20")).alias("word"))
    return counts.join(spelt.select("tuple", (F.crc32("word") % buckets).alias("bucket")), "tuple")


def tuple_weights(rows: DataFrame, words: DataFrame, known: dict[bytes, int], order: int, buckets: int, box: Scratch) -> DataFrame:
    """(row, doc_id, th, n_words, n_features, weight) where tuples have one to ``order`` ids: texts become sequences of ids first."""
    words, context = words.select("word", "id"), words.sparkSession.sparkContext
    coded = encoded(rows.select("row", "target", "doc_id", "th", "text"), words, context.broadcast(known), box)
    counts = box.put(bucketed(counted_tuples(coded, order), words, buckets))
    gains = box.put(gains_of(counts, buckets).select("tuple", "s", "gain"))
    box.drop(counts)
    often = gains.where(F.col("s") >= max(1, SHARE * (gains.agg(F.sum("s")).first()[0] or 0))).toArrow()
    shared = context.broadcast(dict(zip((np.array(x, np.int64).tobytes() for x in often["tuple"].to_pylist()), often["gain"].to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for rows in _slices(batches, "row", "ids"):
            out, rest, many = [], [], [0]
            for row, ids in rows:
                sums = n_all = 0
                for t, n in tuples(ids, order).items():
                    n_all += n
                    gain = of.get(t)
                    if gain is None:
                        rest.append((t, n))
                    else:
                        sums += gain * n
                out.append((row, len(ids) // 8, n_all, sums))
                many.append(len(rest))
            each = pa.StructArray.from_arrays([_lists([t for t, _ in rest]), pa.array([n for _, n in rest], pa.int64())], ["tuple", "n"])
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(many, pa.int32()), each)], ["row", "n_words", "n_features", "weight", "rest"])

    first = box.put(coded.where("not target").select("row", "ids").mapInArrow(run, "row long, n_words long, n_features long, weight long, rest array<struct<tuple: array<long>, n: long>>"))
    asked = first.select("row", F.explode("rest").alias("x")).select("row", F.col("x.tuple").alias("tuple"), F.col("x.n").alias("k"))
    rest = asked.join(gains.select("tuple", "gain"), "tuple").groupBy("row").agg(F.sum(F.col("k") * F.col("gain")).alias("more"))
    weights = first.drop("rest").join(rest, "row", "left").select("row", "n_words", "n_features", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))
    return coded.where("not target").select("row", "doc_id", "th").join(weights, "row")


def ranked(scored: DataFrame, eligible: Column, percent: int, box: Scratch) -> DataFrame:
    """``scored`` (row, doc_id, score, ...) with ``rank``: the best ``percent`` of the eligible rows; ties by doc_id, then by row."""
    scored = box.put(scored)
    able = scored.where(eligible).select("row", "doc_id", "score")
    n = able.count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = able.repartitionByRange(tasks_for(n), *order) if n else able
    parts = box.put(dealt.withColumn("part", F.spark_partition_id()))
    sizes = dict(parts.groupBy("part").count().collect())  # as many as there are tasks
    before, seen = [], 0
    for k in sorted(sizes):
        before.append(F.struct(F.lit(k).alias("part"), F.lit(seen).cast("long").alias("before")))
        seen += sizes[k]
    offset = parts.sparkSession.range(1).select(F.inline(F.array(*before))) if before else parts.select("part", F.lit(0).cast("long").alias("before")).limit(0)
    numbered = parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(offset), "part")
    rank = (F.col("k") + F.col("before")).cast("long")
    drawn = numbered.select("row", rank.alias("rank")).where(F.col("rank") <= percent * n // 100)
    return scored.join(drawn, "row", "left")


def resampled(docs: DataFrame, targets: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, th, n_features, weight, score, rank) of each row of ``docs``; rank is null where it isn't drawn.

    ``docs`` has doc_id and text, ``targets`` text.  Null and empty texts have no features and weight 0; very long texts
    are read whole.  A null doc_id stands as an empty one in the seed and comes last among ties; of rows equal in id and
    score either comes first.  Repeated rows count as often as they are there.  Empty tables give no rows, or gains
    without targets.  Other columns are ignored.
    """
    box = Scratch(docs.sparkSession)
    one = lambda df, target, *ids: df.select(F.lit(target).alias("target"), *ids, F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType
    rows = one(docs, False, "doc_id").unionByName(one(targets, True, F.lit(None).cast(kind).alias("doc_id"))).withColumn("row", F.monotonically_increasing_id())
    counts = box.put(counted_words(rows))
    words, known = dictionary(counts, box)
    box.drop(counts)
    weights = word_weights(rows, words, known, buckets, box) if order == 1 else tuple_weights(rows, words, known, order, buckets, box)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))
    scored = weights.withColumn("score", F.col("weight") + noise)
    return ranked(scored, F.col("n_words") >= least_words, percent, box).select("doc_id", "th", "n_features", "weight", "score", "rank")


def digest(docs: DataFrame, targets: DataFrame) -> DataFrame:
    return resampled(docs, targets).drop("th")


#: CRC-32 by its table of 256 entries, made by rule; only distinct words are hashed.
ORACLE = """
with tab as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)
  )
),
feature as (
  select 0 as target, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from documents
  union all
  select 1, null, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) from benchmark
),
words as (select w, hex(encode(w)) as x, count(*) filter (target = 0) as s, count(*) filter (target = 1) as t from feature group by w),
hashed as (
  select w, s, words.t, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from words, tab
),
total as (select sum(s) as s, sum(t) as t from words),
gain as (
  select bucket, cast(floor(1000 * ln((sum(h.t) + 1)::double * (any_value(a.s) + 10000)::double / ((sum(h.s) + 1)::double * (any_value(a.t) + 10000)::double))) as bigint) as gain
  from hashed h, total a group by bucket
),
weights as (select doc_id, count(*) as n, sum(gain) as weight from feature join hashed using (w) join gain using (bucket) where target = 0 group by doc_id),
scored as (
  select d.doc_id, coalesce(n, 0) as n_features, coalesce(cast(weight as bigint), 0) as weight,
    coalesce(cast(weight as bigint), 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from documents d left join weights w using (doc_id)
),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= 20)
select s.doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from scored s left join drawn using (doc_id)
"""
