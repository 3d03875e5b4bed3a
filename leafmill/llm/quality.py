"""Quality rules: distance of a document's histograms from those of its language.

Two histograms are taken of each text: character classes, and the common words of
its language, which are the ``N_WORDS`` most frequent ones of all its documents (a null
language has its own).  The references are the sums of the same histograms over all
documents of that language (counts are whole numbers, so they don't depend on the
order of summing).  A text whose Jensen-Shannon distance from its reference is too
large is rejected; too short texts are judged by the base rules only.

Everything is a built-in function over the row at hand; the only shuffles are those of
the word counts and partial sums by language, summed within tasks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, broadcast_if_small, col, durable, fresh, words

#: Common words of a language: the most frequent ones of its documents.
N_WORDS = 10
#: Character classes: each pattern matches what is not of the class.
CLASSES = [("upper", r"\P{Lu}+"), ("digit", r"[^0-9]+"), ("punct", r"[^.,;:!?'\"()-]+"), ("symbol", r"[^#*$%&|<>]+")]
#: Characters of none of these classes; without them a text is short.
PLAIN = LOWER + " \n"
BINS = ["upper", "digit", "punct", "symbol", "space", "letter"]

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Distances (0 to 1) beyond which a text is rejected, and the words it needs to be judged by them.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.30
GUARD_CLASS_WORDS, GUARD_WORD_WORDS = 50, 100


def _repeated_words(h: Column, few: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in ``h``; ``few``: those hashes.

    A few hashes are looked up one by one; many, by sorting, which brings equal windows together.
    """
    found = F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains(few, x), i)))
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    runs = F.transform(
        F.array(placed),
        lambda s: F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["p"]),
    )
    at = F.when(F.size(few) <= 32, found).otherwise(F.sort_array(runs[0]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    return F.when(F.size(few) == 0, F.lit(0)).otherwise(F.aggregate(at, start, step, lambda a: a["n"]))


def common_words(docs: DataFrame) -> DataFrame:
    """(l_lang, listed): the most frequent words of each language; of equally frequent ones the first by code point."""
    counts = docs.select("lang", F.explode(words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    # a task passes on no more than N_WORDS rows of a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    top = counts.withColumn("k", rank).where(F.col("k") <= N_WORDS)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: F.xxhash64(x["w"]))
    return top.groupBy("lang").agg(listed.alias("listed")).withColumnRenamed("lang", "l_lang")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, word counts)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = broadcast_if_small(durable(common_words(docs)))
    d = docs.select("doc_id", "lang", text.alias("text"), F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    d = d.join(listed, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    n = F.size("w")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "th", "lang", n.cast("long").alias("n_words"), F.char_length("text").cast("long").alias("n_all"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"), F.translate("text", PLAIN, "").alias("special"),
        lines.alias("lines"), "listed", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
    )
    # 64-bit hashes of windows within one text: two different ones meet with a chance of n * n / 2 ** 65
    two = F.zip_with("wh", F.slice("wh", 2, F.size("wh")), lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("two", F.slice(two, 1, F.greatest(F.size("wh") - 1, F.lit(0))))
    three = F.zip_with("two", F.slice("two", 2, F.size("two")), lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("h", F.slice(three, 1, F.greatest(F.size("two") - 1, F.lit(0)))).drop("two")
    again = F.size(F.array_distinct("h")) < F.size("h")
    twice = F.transform(F.array(F.sort_array("h")), lambda s: F.filter(s, lambda x, i: x == F.get(s, i - 1)))
    d = d.withColumn("few", F.when(again, F.array_distinct(twice[0])).otherwise(F.array().cast("array<bigint>")))
    hits = [F.coalesce(F.size("wh") - F.size(F.array_remove("wh", F.get("listed", F.lit(i)))), F.lit(0)).cast("long").alias(f"w{i}") for i in range(N_WORDS)]
    d = d.select(
        "doc_id", "th", "lang", "n_words", "word_chars",
        *[F.char_length(F.regexp_replace("special", p, "")).cast("long").alias(k) for k, p in CLASSES],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("h"), F.col("few")).cast("long").alias("n_repeat_words"), (F.col("n_all") - F.col("word_chars")).alias("space"), "n_all", *hits,
    )
    d = d.withColumn("n_symbols", F.col("symbol"))
    letter = F.col("n_all") - F.col("upper") - F.col("digit") - F.col("punct") - F.col("n_symbols") - F.col("space")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return d.select(
        "doc_id", "th", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "upper", "digit", "punct", F.col("n_symbols").alias("symbol"), "space", letter.alias("letter"), *[f"w{i}" for i in range(N_WORDS)],
    )


def _plogp(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits (0 to 1) of two arrays of counts; 0 where either is null or empty."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    share = lambda x: F.transform(F.array(F.struct(x.alias("x"), total(x).alias("n"))), lambda s: F.transform(s["x"], lambda v: v / s["n"]))[0]
    parts = F.zip_with(share(counts), share(reference), lambda p, q: _plogp(p, q) + _plogp(q, p))
    d = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(d / 2, F.lit(0.0)))).otherwise(F.lit(0.0))


def judge(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, th (hash of the text), the base counts, base_failed, distances and kept.

    Words are runs of anything but white space.  Null and empty texts have no word and fail.  A null
    language counts as one of its own.  The references
    of a language come from its documents that pass the base rules; without any, nothing is rejected
    by distance.  Repeated rows each give a row; an empty table gives none.
    """
    f = durable(features(docs))
    sums = [F.sum(c).alias(f"r_{c}") for c in [*BINS, *[f"w{i}" for i in range(N_WORDS)], "n_words"]]
    refs = durable(f.where(~F.col("base_failed")).groupBy("lang").agg(*sums).withColumnRenamed("lang", "r_lang"))
    hits = [f"w{i}" for i in range(N_WORDS)]

    def histograms(prefix: str) -> list[Column]:
        c = lambda k: F.col(prefix + k)
        rest = c("n_words") - sum((c(k) for k in hits[1:]), c(hits[0]))
        return [F.array(*[c(k) for k in BINS]).alias(f"{prefix}classes"), F.array(*[c(k) for k in hits], rest).alias(f"{prefix}words")]

    refs = refs.select("r_lang", *histograms("r_"))
    f = f.select("*", *histograms("")).join(broadcast_if_small(refs), F.col("lang").eqNullSafe(F.col("r_lang")), "left")
    classes, listed = js_distance(F.col("classes"), F.col("r_classes")), js_distance(F.col("words"), F.col("r_words"))
    f = f.withColumn("class_distance", F.when(F.col("n_words") >= GUARD_CLASS_WORDS, classes).otherwise(F.lit(0.0)))
    f = f.withColumn("word_distance", F.when(F.col("n_words") >= GUARD_WORD_WORDS, listed).otherwise(F.lit(0.0)))
    # a null reference makes a distance 0 by its CASE
    near = (F.col("class_distance") <= MAX_CLASS_DISTANCE) & (F.col("word_distance") <= MAX_WORD_DISTANCE)
    return f.select(
        "doc_id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    Null, empty and short texts go; very long ones are judged whole.  Rows equal in id and text stay or go together.
    An empty table stays empty.
    """
    d, h, own = (fresh(docs.columns, x) for x in ("bad_id", "bad_hash", "text_hash"))
    bad = judge(docs).where(~F.col("kept")).select(F.col("doc_id").alias(d), F.col("th").alias(h)).distinct()
    out = docs.withColumn(own, F.xxhash64("text")).join(bad, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)), "left_anti")
    return out.select(*[col(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    plogp = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * ({p}) / (({p}) + ({q}))) ELSE 0.0 END)"

    def js(a: list[str], b: list[str]) -> str:
        n, m = f"({' + '.join(a)})", f"({' + '.join(b)})"
        p, q = [f"(({x})::DOUBLE / {n})" for x in a], [f"(({x})::DOUBLE / {m})" for x in b]
        d = "0.0 + " + " + ".join(f"({plogp(x, y)} + {plogp(y, x)})" for x, y in zip(p, q, strict=True))
        return f"CASE WHEN {n} > 0 AND {m} > 0 THEN sqrt(greatest(({d}) / 2, 0.0)) ELSE 0.0 END"

    hits, r_hits = [f"w{i}" for i in range(N_WORDS)], [f"r_w{i}" for i in range(N_WORDS)]
    bins = BINS
    return rf"""
WITH e AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
top AS (
  SELECT lang AS l_lang, list(x ORDER BY k) AS listed
  FROM (SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) AS k FROM (SELECT lang, unnest(w) AS x FROM e) GROUP BY lang, x)
  WHERE k <= {N_WORDS} GROUP BY lang),
d AS (SELECT e.*, listed FROM e LEFT JOIN top ON e.lang IS NOT DISTINCT FROM top.l_lang),
win AS (
  SELECT rid, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS t
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM win) WHERE c >= 2),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
f AS (
  SELECT d.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', '')) AS wc, length(text) AS n_all,
         length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS upper, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digit,
         length(regexp_replace(text, '[^.,;:!?''"()-]+', '', 'g')) AS punct, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS symbol,
         list_filter(string_split(text, chr(10)), lambda x: trim(x, {ws}) <> '') AS ls,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         {", ".join(f"len(list_filter(w, lambda x: x = listed[{i + 1}])) AS w{i}" for i in range(N_WORDS))}
  FROM d LEFT JOIN cover ON d.rid = cover.rid),
g AS (
  SELECT *, coalesce(wc, 0)::BIGINT AS word_chars, symbol::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         n_all - coalesce(wc, 0) AS space, n_all - upper - digit - punct - symbol - (n_all - coalesce(wc, 0)) AS letter,
         (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AS base_failed
  FROM f),
r AS (
  SELECT lang AS r_lang, sum(n_words) AS r_n_words, {", ".join(f"sum({c}) AS r_{c}" for c in [*bins, *hits])}
  FROM g WHERE NOT base_failed GROUP BY lang),
j AS (
  SELECT g.*, r.*, {js(bins, [f"r_{c}" for c in bins])} AS dc,
         {js([*hits, f"n_words - ({' + '.join(hits)})"], [*r_hits, f"r_n_words - ({' + '.join(r_hits)})"])} AS dw
  FROM g LEFT JOIN r ON g.lang IS NOT DISTINCT FROM r.r_lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (n_words < {GUARD_CLASS_WORDS} OR dc <= {MAX_CLASS_DISTANCE})
        AND (n_words < {GUARD_WORD_WORDS} OR dw <= {MAX_WORD_DISTANCE})) AS kept
FROM j
"""


ORACLE = _oracle()
