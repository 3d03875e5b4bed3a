"""Character maps: encodings, ranges, differences and widths as joins and windows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Codes of two bytes: no range of a font goes further.
MAX_CODES = 0xFFFF
#: Names of glyphs that no rule gives.
GLYPHS = """
space 0020 exclam 0021 quotedbl 0022 numbersign 0023 dollar 0024 percent 0025 ampersand 0026 quotesingle 0027 parenleft 0028 parenright 0029
asterisk 002A plus 002B comma 002C hyphen 002D period 002E slash 002F zero 0030 one 0031 two 0032 three 0033 four 0034 five 0035 six 0036
seven 0037 eight 0038 nine 0039 colon 003A semicolon 003B less 003C equal 003D greater 003E question 003F at 0040 bracketleft 005B
backslash 005C bracketright 005D asciicircum 005E underscore 005F grave 0060 braceleft 007B bar 007C braceright 007D asciitilde 007E
nbspace 00A0 exclamdown 00A1 cent 00A2 sterling 00A3 currency 00A4 yen 00A5 brokenbar 00A6 section 00A7 dieresis 00A8 copyright 00A9
ordfeminine 00AA guillemotleft 00AB logicalnot 00AC softhyphen 00AD registered 00AE macron 00AF degree 00B0 plusminus 00B1 acute 00B4
mu 00B5 paragraph 00B6 periodcentered 00B7 cedilla 00B8 ordmasculine 00BA guillemotright 00BB onequarter 00BC onehalf 00BD threequarters 00BE
questiondown 00BF AE 00C6 Eth 00D0 multiply 00D7 Oslash 00D8 Thorn 00DE germandbls 00DF ae 00E6 eth 00F0 divide 00F7 oslash 00F8 thorn 00FE
dotlessi 0131 Lslash 0141 lslash 0142 OE 0152 oe 0153 florin 0192 circumflex 02C6 caron 02C7 breve 02D8 dotaccent 02D9 ring 02DA ogonek 02DB
tilde 02DC hungarumlaut 02DD endash 2013 emdash 2014 quoteleft 2018 quoteright 2019 quotesinglbase 201A quotedblleft 201C quotedblright 201D
quotedblbase 201E dagger 2020 daggerdbl 2021 bullet 2022 ellipsis 2026 perthousand 2030 guilsinglleft 2039 guilsinglright 203A fraction 2044
Euro 20AC trademark 2122 minus 2212 ff FB00 fi FB01 fl FB02 ffi FB03 ffl FB04
"""
#: The codes above ASCII of the standard encoding, and the two within that differ.
STANDARD = {
    39: "’", 96: "‘", 161: "¡", 162: "¢", 163: "£", 164: "⁄", 165: "¥", 166: "ƒ", 167: "§", 168: "¤", 169: "'", 170: "“", 171: "«", 172: "‹", 173: "›", 174: "ﬁ", 175: "ﬂ",
    177: "–", 178: "†", 179: "‡", 180: "·", 182: "¶", 183: "•", 184: "‚", 185: "„", 186: "”", 187: "»", 188: "…", 189: "‰", 191: "¿", 193: "`", 194: "´", 195: "ˆ", 196: "˜",
    197: "¯", 198: "˘", 199: "˙", 200: "¨", 202: "˚", 203: "¸", 205: "˝", 206: "˛", 207: "ˇ", 208: "—", 225: "Æ", 227: "ª", 232: "Ł", 233: "Ø", 234: "Œ", 235: "º", 241: "æ",
    245: "ı", 248: "ł", 249: "ø", 250: "œ", 251: "ß",
}
#: The characters of the Symbol font's codes 20 to 7E and A0 to FE (hexadecimal), in order; parts of signs are at F8E5 and above.
SYMBOL_LOW = " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_\uf8e5αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼"
SYMBOL_HIGH = (
    "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…\uf8e6\uf8e7↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇\uf6da\uf6d9\uf6db∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈\uf8e8\uf8e9\uf8ea∑"
    "\uf8eb\uf8ec\uf8ed\uf8ee\uf8ef\uf8f0\uf8f1\uf8f2\uf8f3\uf8f4\uffff〉∫⌠\uf8f5⌡\uf8f6\uf8f7\uf8f8\uf8f9\uf8fa\uf8fb\uf8fc\uf8fd\uf8fe"
)
#: Codes of ZapfDingbats that aren't in the order of Unicode's dingbats.
DINGBATS = {
    0x20: " ", 0x25: "☎", 0x2A: "☛", 0x2B: "☞", 0x48: "★", 0x6C: "●", 0x6E: "■", 0x73: "▲", 0x74: "▼", 0x75: "◆", 0x77: "◗", 0xA8: "♣", 0xA9: "♦", 0xAA: "♥", 0xAB: "♠",
    **{0xAC + i: chr(0x2460 + i) for i in range(10)}, 0xD5: "→", 0xD6: "↔", 0xD7: "↕",
}
#: Glyphs of the expert encoding by octal codes, but for small capitals of A to Z, which have the codes of a to z.
EXPERT = """
AEsmall 276 Aacutesmall 207 Acircumflexsmall 211 Acutesmall 47 Adieresissmall 212 Agravesmall 210 Aringsmall 214 Atildesmall 213 Brevesmall 363 Caronsmall 256
Ccedillasmall 215 Cedillasmall 311 Circumflexsmall 136 Dieresissmall 254 Dotaccentsmall 372 Eacutesmall 216 Ecircumflexsmall 220 Edieresissmall 221 Egravesmall 217
Ethsmall 104 Gravesmall 140 Hungarumlautsmall 42 Iacutesmall 222 Icircumflexsmall 224 Idieresissmall 225 Igravesmall 223 Lslashsmall 302 Macronsmall 364 Ntildesmall 226
OEsmall 317 Oacutesmall 227 Ocircumflexsmall 231 Odieresissmall 232 Ogoneksmall 362 Ogravesmall 230 Oslashsmall 277 Otildesmall 233 Ringsmall 373 Scaronsmall 247
Thornsmall 271 Tildesmall 176 Uacutesmall 234 Ucircumflexsmall 236 Udieresissmall 237 Ugravesmall 235 Yacutesmall 264 Ydieresissmall 330 Zcaronsmall 275 ampersandsmall 46
asuperior 201 bsuperior 365 centinferior 251 centoldstyle 43 centsuperior 202 colon 72 colonmonetary 173 comma 54 commainferior 262 commasuperior 370 dollarinferior 266
dollaroldstyle 44 dollarsuperior 45 dsuperior 353 eightinferior 245 eightoldstyle 70 eightsuperior 241 esuperior 344 exclamdownsmall 326 exclamsmall 41 ff 126 ffi 131
ffl 132 fi 127 figuredash 320 fiveeighths 114 fiveinferior 260 fiveoldstyle 65 fivesuperior 336 fl 130 fourinferior 242 fouroldstyle 64 foursuperior 335 fraction 57
hyphen 55 hypheninferior 137 hyphensuperior 321 isuperior 351 lsuperior 361 msuperior 367 nineinferior 273 nineoldstyle 71 ninesuperior 341 nsuperior 366 onedotenleader 53
oneeighth 112 onefitted 174 onehalf 110 oneinferior 301 oneoldstyle 61 onequarter 107 onesuperior 332 onethird 116 osuperior 257 parenleftinferior 133
parenleftsuperior 50 parenrightinferior 135 parenrightsuperior 51 period 56 periodinferior 263 periodsuperior 371 questiondownsmall 300 questionsmall 77 rsuperior 345
rupiah 175 semicolon 73 seveneighths 115 seveninferior 246 sevenoldstyle 67 sevensuperior 340 sixinferior 244 sixoldstyle 66 sixsuperior 337 space 40 ssuperior 352
threeeighths 113 threeinferior 243 threeoldstyle 63 threequarters 111 threequartersemdash 75 threesuperior 334 tsuperior 346 twodotenleader 52 twoinferior 252
twooldstyle 62 twosuperior 333 twothirds 117 zeroinferior 274 zerooldstyle 60 zerosuperior 342
"""
#: Code points of the expert glyphs that no rule gives.
EXPERT_GLYPHS = """
Brevesmall F6F4 Caronsmall F6F5 Circumflexsmall F6F6 Dotaccentsmall F6F7 Hungarumlautsmall F6F8 Lslashsmall F6F9 OEsmall F6FA Ogoneksmall F6FB Ringsmall F6FC
Scaronsmall F6FD Tildesmall F6FE Zcaronsmall F6FF asuperior F6E9 bsuperior F6EA centinferior F6DF centsuperior F6E0 colonmonetary 20A1 commainferior F6E1 commasuperior F6E2
dollarinferior F6E3 dollarsuperior F6E4 dsuperior F6EB esuperior F6EC figuredash 2012 fiveeighths 215D hypheninferior F6E5 hyphensuperior F6E6 isuperior F6ED
lsuperior F6EE msuperior F6EF nsuperior 207F onedotenleader 2024 oneeighth 215B onefitted F6DC onethird 2153 osuperior F6F0 parenleftinferior 208D parenleftsuperior 207D
parenrightinferior 208E parenrightsuperior 207E periodinferior F6E7 periodsuperior F6E8 rsuperior F6F1 rupiah F6DD seveneighths 215E ssuperior F6F2 threeeighths 215C
threequartersemdash F6DE tsuperior F6F3 twodotenleader 2025 twothirds 2154
"""
DIGITS = "zero one two three four five six seven eight nine".split()
#: How Unicode calls the accents that follow a letter in a glyph's name.
ACCENTS = {
    "acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "caron": "CARON", "cedilla": "CEDILLA",
    "macron": "MACRON", "breve": "BREVE", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE", "commaaccent": "CEDILLA",
}


def glyph_names() -> dict[str, str]:
    """Glyph name to character: letters with accents and Greek letters by Unicode's names, the others from a list."""
    parts = GLYPHS.split()
    out = {n: chr(int(x, 16)) for n, x in zip(parts[::2], parts[1::2], strict=True)}

    def add(name: str, unicode_name: str) -> None:
        try:
            out.setdefault(name, unicodedata.lookup(unicode_name))
        except KeyError:
            pass

    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out |= {c: c, c.lower(): c.lower()}
        for name, accent in ACCENTS.items():
            add(c + name, f"LATIN CAPITAL LETTER {c} WITH {accent}")
            add(c.lower() + name, f"LATIN SMALL LETTER {c} WITH {accent}")
    for i in [*range(0x391, 0x3AA), *range(0x3B1, 0x3CA)]:
        if (name := unicodedata.name(chr(i), "")) and "FINAL" not in name:
            last = name.split()[-1].lower().replace("lamda", "lambda")
            out.setdefault(last.capitalize() if "CAPITAL" in name else last, chr(i))
    # small capitals, old-style figures and the like stand at F700 and above, in the order of Latin-1
    parts = EXPERT_GLYPHS.split()
    out |= {n: chr(int(x, 16)) for n, x in zip(parts[::2], parts[1::2], strict=True)}
    for name, c in list(out.items()):
        if len(c) == 1 and c.isupper() and ord(c) < 0x100:
            out.setdefault(f"{name}small", chr(0xF700 + ord(c.lower())))
        elif ord(c[0]) < 0x100:
            out.setdefault(f"{name[0].upper()}{name[1:]}small", chr(0xF700 + ord(c[0])))
            out.setdefault(f"{name}small", chr(0xF700 + ord(c[0])))
            out.setdefault(f"{name}oldstyle", chr(0xF700 + ord(c[0])))
    out["Ydieresissmall"] = "\uf7ff"
    for i, name in enumerate(DIGITS):
        out[f"{name}superior"] = {1: "¹", 2: "²", 3: "³"}.get(i, chr(0x2070 + i))
        out[f"{name}inferior"] = chr(0x2080 + i)
    return out


def symbolic_tables() -> dict[str, dict[int, str]]:
    """Codes of the encodings that belong to a font or a set of glyphs."""
    symbol = {0x20 + i: c for i, c in enumerate(SYMBOL_LOW)} | {0xA0 + i: c for i, c in enumerate(SYMBOL_HIGH) if c != "\uffff"}
    dingbats = {i: chr(0x2700 + i - 0x20) for i in range(0x20, 0x7F)} | {i: chr(0x2700 + i - 0x40) for i in range(0xA1, 0xFF) if i != 0xF0} | DINGBATS
    names, parts = glyph_names(), EXPERT.split()
    expert = {0x60 + i: chr(0xF760 + i) for i in range(1, 27)} | {int(x, 8): names[n] for n, x in zip(parts[::2], parts[1::2], strict=True)}
    return {"SymbolEncoding": symbol, "ZapfDingbatsEncoding": dingbats, "MacExpertEncoding": expert}


def base_encodings(spark: SparkSession) -> DataFrame:
    """(name, table): code to text of the named encodings; a fixed, small table."""

    def of(codec: str) -> dict[int, str]:
        pairs = {i: bytes([i]).decode(codec, "ignore") for i in range(32, 256)}
        return {i: c for i, c in pairs.items() if c}

    rows = [("StandardEncoding", {i: chr(i) for i in range(32, 127)} | STANDARD), ("WinAnsiEncoding", of("cp1252")), ("MacRomanEncoding", of("mac_roman")), *symbolic_tables().items()]
    return spark.createDataFrame(rows, "name string, table map<int,string>")


def own_encoding(base_font: Column, symbolic: Column) -> Column:
    """The encoding of a symbolic font that has one of its own, by its name; else null.  A subset's prefix doesn't matter."""
    n = F.lower(base_font)
    dingbats = F.contains(n, F.lit("zapf")) & F.contains(n, F.lit("dingbats"))
    return F.when(symbolic & dingbats, "ZapfDingbatsEncoding").when(symbolic & F.contains(n, F.lit("symbol")), "SymbolEncoding")


def glyph_text(glyphs: DataFrame) -> DataFrame:
    """Adds ``text`` to rows with ``glyph``: by the list of names, or by the code in names like uni20AC and u1F600; unknown ones are a white square."""
    names = glyphs.sparkSession.createDataFrame(list(glyph_names().items()), "__g string, __t string")
    plain = F.when(F.startswith("glyph", F.lit(".")), F.col("glyph")).otherwise(F.substring_index("glyph", ".", 1))
    d = glyphs.withColumn("__g", plain).join(F.broadcast(names), "__g", "left")
    digits = F.regexp_extract("__g", "^(?:uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6}))$", 1)
    long = F.regexp_extract("__g", "^u([0-9A-F]{4,6})$", 1)
    coded = F.when(digits != "", F.decode(F.unhex(digits), "UTF-16BE")).when(long != "", F.decode(F.unhex(F.lpad(long, 8, "0")), "UTF-32BE"))
    return d.withColumn("text", F.coalesce("__t", coded, F.lit("□"))).drop("__g", "__t")


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """(font, code, unicode) of (font, seq, lo, hi, dst): one row per code, so that a lookup is an equi-join; the first range wins.

    A range holds two bytes' codes at most, whatever a broken font claims; one that ends before it begins has none.
    """
    d = ranges.where("hi >= lo").select("font", "seq", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + MAX_CODES))).alias("code"), "lo", "dst")
    d = d.select("font", "seq", "code", (F.col("dst") + F.col("code") - F.col("lo")).alias("unicode"))
    return d.groupBy("font", "code").agg(F.min_by("unicode", "seq").alias("unicode"))


def map_codes(codes: DataFrame, expanded: DataFrame, missing: int = 0x25A1) -> DataFrame:
    """Adds ``unicode`` to (font, code, ...); codes without one get a white square."""
    return codes.join(expanded, ["font", "code"], "left").withColumn("unicode", F.coalesce("unicode", F.lit(missing)))


def expand_differences(items: DataFrame) -> DataFrame:
    """(font, code, glyph) of (font, seq, number, glyph): a number sets the code, each glyph takes it and adds one; the last for a code wins."""
    w = Window.partitionBy("font").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = items.withColumn("start", F.last("number", ignorenulls=True).over(w)).withColumn("at", F.last(F.when(F.col("number").isNotNull(), F.col("seq")), ignorenulls=True).over(w))
    d = d.where("glyph is not null and start is not null")
    d = d.select("font", (F.col("start") + F.col("seq") - F.col("at") - 1).alias("code"), "glyph", "seq")
    return d.groupBy("font", "code").agg(F.max_by("glyph", "seq").alias("glyph"))


def cid_spans(fonts: DataFrame) -> DataFrame:
    """(font, first, last, width, widths) of (font, w): ``w`` is a JSON array of numbers and arrays of numbers, as composite fonts list widths."""
    span = "struct<first:int,last:int,width:double,widths:array<double>>"
    start = F.struct(F.array().cast("array<double>").alias("open"), F.array().cast(f"array<{span}>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        first, last, number = F.get(a["open"], F.lit(0)).try_cast("int"), F.get(a["open"], F.lit(1)).try_cast("int"), x.try_cast("double")
        listed = F.struct(first.alias("first"), F.lit(None).cast("int").alias("last"), F.lit(None).cast("double").alias("width"), F.from_json(x, "array<double>").alias("widths"))
        ranged = F.struct(first.alias("first"), last.alias("last"), number.alias("width"), F.lit(None).cast("array<double>").alias("widths"))
        is_list = F.startswith(x, F.lit("["))
        none = F.array().cast("array<double>")
        return (
            F.when(is_list, F.struct(none.alias("open"), F.array_append(a["done"], listed.cast(span)).alias("done")))
            .when(F.size(a["open"]) == 2, F.struct(none.alias("open"), F.array_append(a["done"], ranged.cast(span)).alias("done")))
            .otherwise(F.struct(F.array_append(a["open"], number).alias("open"), a["done"].alias("done")))
        )

    d = fonts.select("font", F.aggregate(F.from_json("w", "array<string>"), start, step, lambda a: a["done"]).alias("spans"))
    return d.select("font", F.explode("spans").alias("s")).select("font", "s.*")


def expand_widths(items: DataFrame) -> DataFrame:
    """(font, cid, width) of (font, first, last, width, widths): either a list from ``first`` on, or one width for a range."""
    listed = items.where("widths is not null").select("font", "first", F.posexplode("widths").alias("i", "width")).select("font", (F.col("first") + F.col("i")).alias("cid"), "width")
    ranged = items.where("widths is null and last >= first").select("font", F.explode(F.sequence("first", F.least("last", F.col("first") + MAX_CODES))).alias("cid"), "width")
    return listed.unionByName(ranged)
