"""Line dedup: lines that many documents share stay in one of them.

Lines are normalised, hashed (128 bits) and exploded without their text; distinct
documents are counted by hash in two steps (hash and document, then hash), so a
line that a third of all documents hold is combined before it is shuffled.  The
positions to drop come back by document, and the text is put together again from
the slices between them, in time linear in the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, durable, fresh, hash128, strip_ws

MIN_KEY_CHARS = 20
MIN_DOCS = 3
#: Columns that are added.
NEW = ["lines_kept", "n_lines", "n_dropped"]


def line_key(line: Column) -> Column:
    return ascii_lower(strip_ws(line))


def _refs(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, h1, h2) for each line whose key is long enough."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("doc_id", "th", "pos", *hash128(F.col("key")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input's columns (text as it was) plus ``lines_kept`` (array), ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of white space with A-Z lower-cased.  Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` different doc_ids lose their lines
    everywhere but in the largest doc_id that holds them (all its lines with that key stay).
    Null or empty text: one empty line.  Rows with a null doc_id don't count as documents but lose
    such lines.  Repeated rows count once and are treated alike; an empty table gives no rows.
    Columns of the input with one of the three new names are replaced.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    refs = _refs(base, min_chars)
    shared = (
        refs.where("doc_id is not null").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.sum("one").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs).select("h1", "h2", "keeper")
    )
    shared = durable(shared)  # a plain scan on this side lets AQE split a skewed key on the other
    drop = refs.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = drop.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    rows = docs.drop(*NEW)
    d, h, g, own, lines, at = (fresh([*docs.columns, *NEW], x) for x in ("gone_id", "gone_hash", "gone_at", "text_hash", "text_lines", "cuts"))
    gone = gone.select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("gone").alias(g))
    out = rows.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    out = out.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)), "left")
    out = out.withColumn(lines, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    out = out.withColumn(at, F.when(F.col(g).isNotNull(), F.concat(F.array(F.lit(-1)), F.col(g), F.array(F.size(lines)))))
    parts = F.transform(
        F.sequence(F.lit(0), F.size(at) - 2),
        lambda i: F.slice(F.col(lines), F.get(at, i) + 2, F.get(at, i + 1) - F.get(at, i) - 1),
    )
    kept = F.when(F.col(at).isNull(), F.col(lines)).otherwise(F.flatten(parts))
    return out.select(
        *[col(c) for c in rows.columns], kept.alias("lines_kept"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(g), F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input with its text rewritten (and ``n_chars``, where it has that column), whatever its other columns are called.

    A null text stays null, an empty one empty; very long texts and lines are read whole.  Repeated rows are treated
    alike, all their lines with the same key too.  An empty table stays empty.
    """
    short = docs.select("doc_id", "text", *[F.struct(*[col(c) for c in docs.columns]).alias("row")])
    out = dedup_lines(short, min_chars, min_docs).withColumn("text", F.when(F.col("text").isNotNull(), F.array_join("lines_kept", "\n")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.array_join("lines_kept", "\n"), 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id AS doc_id, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (WHERE s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (WHERE s.key IS NULL OR k.doc_id IS NOT DISTINCT FROM s.keeper), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key
GROUP BY k.doc_id
"""
