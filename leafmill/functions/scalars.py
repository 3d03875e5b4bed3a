"""Small built-in expressions: spaces, colours, matrices, numbers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as spaces.
SPACES = "\\x20\\xA0\\u1680\\u180E\\u2000-\\u200B\\u202F\\u205F\\u3000\\uFEFF\\t"


def collapse_spaces(text: Column) -> Column:
    """Each run of spaces becomes one."""
    return F.regexp_replace(text, f"[{SPACES}]+", " ")


def trim_ends(text: Column) -> Column:
    """Strips spaces, line feeds and carriage returns only."""
    return F.btrim(text, F.lit(" \n\r"))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.array(*[(1 - x) * (1 - k) for x in (c, m, y)])


def darken_bright(rgb: Column) -> Column:
    """Colours with all parts above one half are scaled down, so that white text can be read."""
    top = F.array_max(rgb)
    factor = F.least((1 - top) / 0.5, F.lit(0.5))
    return F.when(F.array_min(rgb) > 0.5, F.transform(rgb, lambda x: x * factor)).otherwise(rgb)


def to_255(rgb: Column) -> Column:
    """0 to 255; parts below zero are unset (-1)."""
    return F.transform(rgb, lambda x: F.when(x < 0, F.lit(-1)).otherwise(F.round(x * 255).cast("int")))


def affine(p: list[Column], q: list[Column]) -> list[Column]:
    """The product of two 2 x 3 matrices (a b c d e f), the left one applied first."""
    a, b, c, d, e, f = p
    g, h, i, j, k, m = q
    return [a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + m]


def big_endian(b: Column) -> Column:
    """Unsigned number of the bytes."""
    return F.conv(F.hex(b), 16, 10).cast("long")


def text_string(b: Column) -> Column:
    """Bytes that start with FE FF are UTF-16BE, others one character each."""
    return F.when(F.startswith(F.hex(b), F.lit("FEFF")), F.decode(F.substring(b, 3, 2**30), "UTF-16BE")).otherwise(F.decode(b, "ISO-8859-1"))


def encode_parentheses(text: Column) -> Column:
    """Parentheses as octal escapes, so that a string can stand between parentheses."""
    return F.replace(F.replace(text, F.lit("("), F.lit("\\050")), F.lit(")"), F.lit("\\051"))


def octal(number: Column) -> Column:
    return F.conv(number.cast("string"), 10, 8)


def from_octal(digits: Column) -> Column:
    return F.conv(digits, 8, 10).cast("long")


def number(text: Column) -> Column:
    """Null where the text is no number."""
    return F.btrim(text).try_cast("double")


def symbol_code(code: Column) -> Column:
    """Symbolic fonts have their glyphs at F000 and above."""
    return code + 0xF000


def in_codespace(code: Column, low: Column, high: Column) -> Column:
    """Whether a code (binary) is as long as the range's ends, and each byte lies between theirs."""
    byte = lambda b, i: F.substring(F.hex(b), 2 * i + 1, F.lit(2))
    inside = F.forall(F.sequence(F.lit(0), F.octet_length(low) - 1), lambda i: byte(code, i).between(byte(low, i), byte(high, i)))
    return (F.octet_length(code) == F.octet_length(low)) & inside
