"""Table functions for SQL: ``pdf_open(file_id, content)`` and ``pdf_content(data)``, and the scalar ``pdf_decode(value, raw)``.

After ``register(spark)`` one statement goes from files to text elements:

    SELECT f.path, e.* FROM binaryFile.`folder` f, LATERAL pdf_open(f.path, f.content) o, LATERAL pdf_content(pdf_decode(o.value, o.raw)) e
    WHERE o.kind = 'object' AND o.raw IS NOT NULL AND get_json_object(o.value, '$.Type') IS NULL
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import pdf_bytes as B
from ..sources.pdf import OPENED, opened_rows

CONTENT = "kind string, obj_seq int, elem_seq int, font_key string, font_size double, tx double, ty double, pieces array<string>, error string"


class PdfOpen:
    """The rows of ``open_files`` for one file: cross-reference entries, trailers, objects, or an error."""

    def eval(self, file_id: str, content: bytes) -> Iterator[tuple]:
        yield from opened_rows(file_id, content)


class PdfContent:
    """Text elements (as the bytes in the stream, one character each), external objects, inline images and errors of a content stream."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        for kind, obj, elem, items, key, size, _, x, y, *_ in B.content(bytes(data)) if data is not None else ():
            pieces = [i["s"] for i in items if isinstance(i, dict) and "s" in i] if kind == "text" else None
            yield kind, obj, elem, key, size, x, y, pieces, items if kind == "error" else None


@F.pandas_udf(T.BinaryType())
def pdf_decode(value: pd.Series, raw: pd.Series) -> pd.Series:
    """A stream's bytes through the filters that its dictionary (JSON) names; null if that fails."""

    def one(v: str | None, b: bytes | None) -> bytes | None:
        try:
            return None if v is None or b is None else B.stream_data(json.loads(v), bytes(b))
        except (AttributeError, IndexError, ValueError):
            return None

    return pd.Series([one(*x) for x in zip(value, raw, strict=True)], dtype=object)


def register(spark: SparkSession) -> None:
    spark.udtf.register("pdf_open", F.udtf(PdfOpen, returnType=OPENED))
    spark.udtf.register("pdf_content", F.udtf(PdfContent, returnType=CONTENT))
    spark.udf.register("pdf_decode", pdf_decode)
