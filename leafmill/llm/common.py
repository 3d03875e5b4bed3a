"""Column expressions and small helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import Scratch, durable, stored  # noqa: F401  for the operators

#: White space as the contracts define it: space and the controls 0x09-0x0D.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast only if it was counted and holds at most this many rows.
MAX_BROADCAST_ROWS = 20_000


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def words(c: Column) -> Column:
    """Runs of anything but white space; null and blank texts have none.

    Splitting at one character is several times faster than at a pattern.
    """
    text = F.coalesce(c, F.lit(""))
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    rest = flat
    for x in "\t\x0b\x0c\r":
        rest = F.replace(rest, F.lit(x), F.lit(" "))
    flat = F.when(text.rlike(r"[\t\x0B\x0C\r]"), rest).otherwise(flat)
    return F.array_remove(F.split(flat, " ", -1), "")


def ascii_lower(c: Column) -> Column:
    """Only A-Z change; all-ASCII strings take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of binary texts, one after another, and how many each text has.  Arrow's ASCII functions touch just A-Z and the six white-space controls."""
    texts = pc.fill_null(texts, b"")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, n = lists.flatten().view(pa.binary()), np.diff(lists.offsets.to_numpy())
    some = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty word there
    if not some.all():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))
        words = words.filter(pa.array(some))
    return words, n


def giving_back(run: Callable) -> Callable:
    """A function of ``mapInArrow`` after which a Python worker, which lives on, hands its free memory back to the system."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def bytes_of(values: pa.Array) -> list[bytes]:
    """A binary array without nulls as Python objects, in a tenth of the time that ``to_pylist`` takes."""
    if not len(values):
        return []
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Identifies a row even where ids repeat: rows equal in both are treated alike."""
    return [F.col(id_col), F.xxhash64(F.col(text_col))]


def hash128(c: Column) -> list[Column]:
    """Two independent 64-bit hashes: together they don't collide at corpus size."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(0x5EED), c).alias("h2")]


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name that ``taken`` doesn't have, whatever its case."""
    have, n = {x.lower() for x in taken}, 0
    while (name := f"{base}_{n}").lower() in have:
        n += 1
    return name


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the (materialised) rows are few; else joins shuffle, split by AQE where skewed."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def tasks_for(rows: int, each: int = 50_000) -> int:
    """For ``coalesce``: so many tasks that each has ``each`` rows; few rows then don't make a file for every pair of partitions."""
    return max(1, -(-rows // each))
