"""Mixing sources to target weights by hash thresholds.

Each source gets a budget of words.  Whole repeats come first; what is left of the
budget goes to the documents whose hash is below a threshold.  The threshold is found
without sorting: words are summed by source and leading hash digit, the bucket in which
the budget runs out is opened by its next digit, and so on until it holds one hash.
Budgets of different size nest: a larger one takes what a smaller one took, and more.

Only one row per source reaches the driver (``MAX_SOURCES`` at most, else an error).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, durable, fresh, words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
MAX_SOURCES = 20_000
#: The hash has 60 bits: digits of 12 bits, the highest first.
DIGIT_BITS, HASH_BITS = 12, 60


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> dict[str | None, float]:
    """Targets by source: shares of all words by weight, none above ``repeats`` times its source.

    Sources by code point, null last, take the weights in turn.  What a full source can't take is
    shared by the others, by weight: each gets min(repeats * size, level * weight).
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    rows = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(order)]
    left, weight, level = float(sum(n for _, n, _ in rows)), float(sum(w for *_, w in rows)), 0.0
    for _, n, w in sorted(rows, key=lambda x: (repeats * x[1] / x[2], x[2])):
        level = left / weight
        if level <= repeats * n / w:
            break
        left, weight = left - repeats * n, weight - w
        level = left / weight if weight > 0 else level
    return {s: float(repeats * n) if level > repeats * n / w else level * w for s, n, w in rows}


def _sized(docs: DataFrame, text_col: str) -> DataFrame:
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    digits = F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.select("doc_id", "source", F.xxhash64(text_col).alias("th"), F.size(words(F.col(text_col))).cast("long").alias("size"), digits.alias("hash"))


def _table(spark: SparkSession, rows: list[tuple], kind: T.StructType) -> DataFrame:
    """A small table.  As an Arrow table it needs no Python worker, unlike a list of rows."""
    return spark.createDataFrame(pa.table([pa.array(x) for x in zip(*rows, strict=True)] if rows else [pa.nulls(0)] * len(kind), names=kind.names), kind)


def _thresholds(sized: DataFrame, budgets: list[tuple[str | None, int]]) -> dict[str | None, int]:
    """By source the hash below which its documents fill the budget as nearly as whole documents can."""
    spark = sized.sparkSession
    kind = T.StructType([T.StructField("b_source", sized.schema["source"].dataType), T.StructField("prefix", T.LongType()), T.StructField("budget", T.LongType())])
    done: dict[str | None, int] = {}
    todo = [(s, 0, b) for s, b in budgets]
    for low in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        if not todo:
            break
        open_ = F.broadcast(_table(spark, todo, kind))  # one row per source
        on = F.col("source").eqNullSafe(F.col("b_source")) & (F.shiftright("hash", low + DIGIT_BITS) == F.col("prefix"))
        sums = (
            sized.join(open_, on).groupBy("b_source", "prefix", "budget", F.shiftright("hash", low).alias("bucket"))
            .agg(F.sum("size").alias("n"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        )
        by = Window.partitionBy("b_source").orderBy("bucket")  # at most 2 ** DIGIT_BITS sums of a source
        sums = sums.withColumn("upto", F.sum("n").over(by)).withColumn("before", F.col("upto") - F.col("n"))
        cut = sums.where((F.col("before") < F.col("budget")) & (F.col("upto") >= F.col("budget")))
        found = {r["b_source"]: r for r in cut.groupBy("b_source").agg(F.min_by(F.struct("bucket", "before", "n", "first", "last", "budget"), "bucket").alias("x")).select("b_source", "x.*").collect()}
        following = []
        for s, prefix, budget in todo:
            r = found.get(s)
            if r is None:  # nothing to take, or less than the budget there
                done[s] = prefix << (low + DIGIT_BITS) if budget <= 0 else (prefix + 1) << (low + DIGIT_BITS)
            elif r["first"] == r["last"]:  # one hash: in if that comes nearer to the budget
                done[s] = r["first"] + (2 * (budget - r["before"]) >= r["n"])
            else:
                following.append((s, r["bucket"], budget - r["before"]))
        todo = following
    return done


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS, text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, th (hash of the text), size, source_size, target, copies and taken = size * copies.

    A size is the number of runs of anything but white space (null text: 0).  Documents are chosen by a
    hash of id and text, so reruns agree; rows equal in both are taken or left together.  A null source
    is a source of its own.  Documents without a word are never taken.  An empty table gives no rows.
    """
    sized = durable(_sized(docs, text_col))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("n"))
    sources = [(r["source"], r["n"]) for r in by_source.limit(MAX_SOURCES + 1).collect()]
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to weigh")
    goal = targets(sources, weights, repeats)
    whole = {s: min(repeats, int(goal[s] // n)) if n else 0 for s, n in sources}
    rest = [(s, round(goal[s] - whole[s] * n)) for s, n in sources]
    below = _thresholds(sized.where("size > 0"), [(s, b) for s, b in rest if b > 0])
    plan = [(s, n, goal[s], whole[s], below.get(s, 0)) for s, n in sources]
    kind = T.StructType([
        T.StructField("p_source", docs.schema["source"].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
        T.StructField("whole", T.LongType()), T.StructField("below", T.LongType()),
    ])
    plans = F.broadcast(_table(docs.sparkSession, plan, kind))  # one row per source
    out = sized.join(plans, F.col("source").eqNullSafe(F.col("p_source")))
    copies = F.col("whole") + (F.col("hash") < F.col("below")).cast("long")
    out = out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")))
    return out.select("doc_id", "th", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows that the mix takes, each as often as it takes them, with all their columns, whatever their names.

    Null, empty and blank texts are never taken; very long ones count whole.  A null source is a source.  Rows equal in
    id and text are taken alike.  An empty table stays empty.
    """
    d, h, n, own, i = (fresh(docs.columns, x) for x in ("mix_id", "mix_hash", "mix_copies", "text_hash", "mix_copy"))
    plan = mix(docs, weights, repeats).where("copies > 0").select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("copies").alias(n)).distinct()
    out = docs.withColumn(own, F.xxhash64("text")).join(plan, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)))
    return out.withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[col(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n,
         [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * n / w AS cap,
         sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY 3 * n / w DESC, w DESC, source DESC NULLS FIRST) AS weight
  FROM s),
level AS (SELECT arg_min(rest / weight, cap) AS v FROM o WHERE rest / weight <= cap),
t AS (
  SELECT source, n, CASE WHEN v > 3 * n / w THEN (3 * n)::DOUBLE ELSE v * w END AS target FROM s, level),
b AS (
  SELECT *, CASE WHEN n > 0 THEN least(3, floor(target / n))::BIGINT ELSE 0 END AS whole FROM t),
p AS (
  SELECT d.*, n, target, whole, round(target - whole * n)::BIGINT AS budget
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
h AS (
  SELECT source, hash, sum(size) AS hs FROM p WHERE size > 0 GROUP BY source, hash),
c AS (
  SELECT source, hash, hs, coalesce(sum(hs) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM h)
SELECT p.doc_id AS doc_id, p.size AS size, p.n AS source_size, p.target AS target,
       (p.size * (p.whole + CASE WHEN p.size > 0 AND p.budget > 0 AND
         (c.before + c.hs <= p.budget OR (c.before < p.budget AND 2 * (p.budget - c.before) >= c.hs)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source AND p.hash = c.hash
"""
