"""Which typeface stands for a font that isn't in the file: an ordered table of rules, and a chain of fallbacks.

Both are data: pass other rows to change them.  A rule fits a name that contains all its parts, in any case; the first
that fits gives the font.  A font without a typeface of its own falls back to another, step by step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Parts that a name must contain; the font; whether bold and italic have fonts of their own; whether the name is the part."""

    parts: tuple[str, ...]
    font: str
    styled: bool = False
    whole: bool = False


#: What is looked for in names, in order.
RULES = (
    Rule(("arial",), "ARIAL"), Rule(("baskerville",), "BASKERVILLE"), Rule(("casual",), "CASUAL"), Rule(("courier",), "COURIER", True), Rule(("cursive",), "CURSIVE"),
    Rule(("fantasy",), "FANTASY"), Rule(("georgia",), "GEORGIA"), Rule(("goudy",), "GOUDY"), Rule(("helvetica",), "HELVETICA", True), Rule(("stone", "serif"), "ITC_STONE_SERIF"),
    Rule(("palatino",), "PALATINO"), Rule(("monaco",), "MONACO"), Rule(("symbol",), "SYMBOL", whole=True), Rule(("tahoma",), "TAHOMA"), Rule(("times", "new", "roman"), "TIMES_NEW_ROMAN"),
    Rule(("times",), "TIMES", True), Rule(("verdana",), "VERDANA"), Rule(("zapf", "dingbats"), "ZAPFDINGBATS"), Rule(("mono",), "MONOSPACE"), Rule(("sans", "serif"), "SANS_SERIF", True),
    Rule(("serif",), "SERIF", True), Rule((), "DEFAULT", True),
)
#: Fonts and what stands for them; small letters are typefaces, where a chain ends.
FALLBACKS = {
    "ARIAL": "SANS_SERIF", "BASKERVILLE": "SERIF", "CASUAL": "casual", "COURIER": "SERIF_MONOSPACE", "CURSIVE": "cursive", "FANTASY": "SERIF", "GEORGIA": "SERIF", "GOUDY": "SERIF",
    "HELVETICA": "SANS_SERIF", "ITC_STONE_SERIF": "SERIF", "PALATINO": "SERIF", "MONACO": "MONOSPACE", "SYMBOL": "DEFAULT", "TAHOMA": "SANS_SERIF", "TIMES_NEW_ROMAN": "SERIF",
    "TIMES": "SERIF", "VERDANA": "SANS_SERIF", "ZAPFDINGBATS": "DEFAULT", "MONOSPACE": "monospace", "SERIF_MONOSPACE": "serif-monospace", "SANS_SERIF": "sans-serif", "SERIF": "serif",
    "DEFAULT": "SANS_SERIF",
}


def font_name(base_font: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The font of the first rule that fits, with _BOLD and _ITALIC (or _BOLD_ITALIC) where the rule has styles; null for null."""
    row = lambda r: F.struct(F.array(*[F.lit(x) for x in r.parts]).cast("array<string>").alias("parts"), F.lit(r.font).alias("font"), F.lit(r.styled).alias("styled"), F.lit(r.whole).alias("whole"))
    fits = lambda n: lambda r: F.forall(r["parts"], lambda x: F.when(r["whole"], n == x).otherwise(F.contains(n, x)))

    def named(n: Column) -> Column:
        bold, italic = F.contains(n, F.lit("bold")), n.rlike("italic|oblique")
        style = F.when(bold & italic, "_BOLD_ITALIC").when(bold, "_BOLD").when(italic, "_ITALIC").otherwise("")
        first = F.slice(F.filter(F.array(*map(row, rules)), fits(n)), 1, 1)
        return F.get(F.transform(first, lambda r: F.concat(r["font"], F.when(r["styled"], style).otherwise(F.lit("")))), F.lit(0))

    # a rule without parts would fit a null, too
    return F.when(base_font.isNotNull(), F.get(F.transform(F.array(F.lower(base_font)), named), F.lit(0)))


def typeface(font: Column, fallbacks: dict[str, str] = FALLBACKS) -> Column:
    """The typeface where the fallbacks of a font (as ``font_name`` gives it) end, with "-bold" and "-italic" behind it.

    A style stays on the way, unless the user's table has a row for the styled font itself; typefaces with one width for
    all letters have none.  A chain that comes back to itself, or leads nowhere, ends in that of DEFAULT.
    """

    def end(x: str) -> str:
        seen: set[str] = set()
        while x in fallbacks and x not in seen:
            seen.add(x)
            x = fallbacks[x]
        return x if x not in seen and x.islower() else "sans-serif"

    ends = F.create_map(*[F.lit(v) for k in fallbacks for v in (k, end(k))])
    plain = F.regexp_replace(font, "(_BOLD)?(_ITALIC)?$", "")
    style = F.replace(F.lower(F.regexp_extract(font, "(_BOLD)?(_ITALIC)?$", 0)), F.lit("_"), F.lit("-"))
    base = F.coalesce(F.try_element_at(ends, plain), F.lit(end("DEFAULT")))
    styled = F.when(F.endswith(base, F.lit("monospace")), base).otherwise(F.concat(base, style))
    return F.when(font.isNotNull(), F.coalesce(F.try_element_at(ends, font), styled))
