"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into phrases, each the shortest that isn't in the
dictionary yet; the set of phrases is hashed, and its ``SIZE`` smallest hashes are the
fingerprint.  The share of common hashes among the smallest of two fingerprints together
estimates the Jaccard similarity of their phrase sets: texts that help to compress each
other share long phrases.

For a document and its successor by doc_id, documents are dealt out in ranges of doc_id,
and the first of each range goes to the range before as well, so that every range can be
read once in order; no range has to fit in memory.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 128
#: Ranges of doc_id for each shuffle partition: several, so that hashing them to partitions is even.
RANGES = 8
_U = np.uint64
_B = _U(0x5851F42D4C957F2D)


def phrase_ends(text: str, seen: set[str], phrase: str, at: int) -> tuple[list[int], str]:
    """Where phrases end in ``text`` (positions from ``at`` on), and the unfinished last phrase; ``seen`` grows."""
    ends = []
    for at, c in enumerate(text, at + 1):  # noqa: B020, PLR1704
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            ends.append(at)
            phrase = ""
    return ends, phrase


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """A hash of each phrase, by its code points and their places within it; all phrases at once."""
    if not ends:
        return np.zeros(0, dtype=_U)
    a = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stop = np.array(ends)
    start = np.concatenate([[0], stop[:-1]])
    place = np.arange(len(a)) - np.repeat(start, stop - start)
    return _mix(np.add.reduceat(_mix(a.astype(_U) * _B + place.astype(_U)), start))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest distinct 32-bit hashes, in order."""
    h = (hashes >> _U(32)).astype(np.uint32)
    return np.unique(np.partition(h, 4 * SIZE)[: 4 * SIZE] if len(h) > 4 * SIZE else h)[:SIZE]


def fingerprint(text: str) -> np.ndarray:
    ends, rest = phrase_ends(text, set(), "", 0)
    # an unfinished phrase repeats one of the dictionary, so it adds nothing to the set
    return sketch(phrase_hashes(text, ends))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of both sets among the smallest hashes of their union; two empty ones are alike."""
    both = np.union1d(a, b)[:SIZE]
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both))


def _name(a: np.ndarray) -> str:
    return base64.b64encode(a.tobytes()).decode()


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars (code points) and fingerprint (base64 of up to 128 32-bit hashes).

    Null texts count as empty and have an empty fingerprint; equal texts have equal ones.  Very long texts are parsed
    whole.  Repeated rows each give a row; an empty table gives none.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([_name(fingerprint(t)) for t in texts])], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def edited(text: str, follower: str) -> str:
    """The last half (rounded down) replaced by as much of the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


class Parsed:
    """A text, its fingerprint, and the parse of the part that its edited text shares."""

    def __init__(self, text: str) -> None:
        self.text, self.keep = text, len(text) - len(text) // 2
        seen: set[str] = set()
        self.head, self.phrase = phrase_ends(text[: self.keep], seen, "", 0)
        self.seen = set(seen)
        tail, _ = phrase_ends(text[self.keep :], seen, self.phrase, self.keep)
        self.print = sketch(phrase_hashes(text, self.head + tail))

    def edit(self, follower: str) -> tuple[str, np.ndarray]:
        """The edited text and its fingerprint."""
        new = edited(self.text, follower)
        tail, _ = phrase_ends(new[self.keep :], self.seen, self.phrase, self.keep)
        return new, sketch(phrase_hashes(new, self.head + tail))


def _bounds(docs: DataFrame) -> list[int]:
    """Bounds of the ranges of doc_id, as even as the approximate quantiles are."""
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)))
    return [int(x) for x in bounds]


def with_next(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next document is the one that follows by (doc_id, text), nulls first, and the first one after the
    last; a single document follows itself.  Null texts count as empty: the edited text of an empty one is
    empty, and two empty fingerprints are alike (1.0).  Repeated rows follow each other; very long texts are parsed
    whole.  An empty table gives no rows.  Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = _bounds(d)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [0 if i is None else bisect_right(bounds, i) for i in b.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(at, pa.int32())], ["doc_id", "part"])

    # one row per range that has rows: its first doc_id, and the range before
    first = d.select("doc_id").mapInArrow(deal, f"doc_id {id_type}, part int").groupBy("part").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    heads = sorted((r["part"], None if r["has_null"] else r["id"]) for r in first.collect())
    before = {p: heads[i - 1][0] for i, (p, _) in enumerate(heads)}  # of the first range: the last
    starts = dict(heads)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row in its range, and rows with a range's first id at the end of the range before too."""
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            at = [0 if i is None else bisect_right(bounds, i) for i in ids]
            extra = [k for k, (i, p) in enumerate(zip(ids, at, strict=True)) if starts[p] == i]
            take = pa.array([*range(len(ids)), *extra], pa.int64())
            part = pa.array([*at, *(before[at[k]] for k in extra)], pa.int32())
            ghost = pa.array([False] * len(ids) + [True] * len(extra))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text").take(take), part, ghost], ["doc_id", "text", "part", "ghost"])

    dealt = d.mapInArrow(copies, f"doc_id {id_type}, text string, part int, ghost boolean")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.repartition(n, "part").sortWithinPartitions("part", "ghost", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: tuple | None = None  # (range, id, parsed text), waiting for its next
        for b in batches:
            out: list[tuple] = []
            for i, text, part, ghost in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part", "ghost")), strict=True):
                waits = held is not None and held[0] == part
                now = Parsed(text) if waits or not ghost else None
                if waits:
                    own = held[2].print
                    new, new_print = held[2].edit(text)
                    out.append((held[1], len(held[2].text), sha256(new.encode()).hexdigest(), _name(own), _name(new_print), likeness(own, new_print), likeness(own, now.print)))
                held = None if ghost else (part, i, now)
            kinds = [b.column("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return placed.mapInArrow(run, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def digest(docs: DataFrame) -> DataFrame:
    return with_next(docs)
