"""The reference operators on the synthetic tables: one query each, with the SQL that checks it.

Two kinds: round trips (a column is encoded by our writer and decoded by the engine; the SQL is the column) and
relational operators on elements made from the rows of a table.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codecs, scalars, udtf
from .operators import cmaps, fonts, graph, layout, tables
from .plans import contents
from .sources import pdf
from .testing import pdfwriter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = "[^\\x20\\x09-\\x0D]+"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- PDF files written from documents


def _pdfs(spark: SparkSession, sf_dir: str, titles: bool = False, pages: bool = False, **how: object) -> DataFrame:
    """(file_id, content): a file of two pages for each document; with titles, its first three lines are outline items, the first word of each below it.

    pages: one to four pages instead, by the length of the text.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                files, part = [], b.slice(i, 200)
                for text in part.column("text").to_pylist():
                    lines = (text or "").split("\n")
                    half = (len(lines) + 1) // 2
                    outline = [(x[:20], k % 2, x.split()[:1]) for k, x in enumerate(lines[:3])] if titles else None
                    n = 1 + len(text or "") % 4
                    cut = [lines[k::n] for k in range(n)] if pages else [lines[:half], lines[half:]]
                    files.append(pdfwriter.write_pdf(cut, outline=outline, **how))
                yield pa.RecordBatch.from_arrays([part.column("file_id"), pa.array(files, pa.binary())], ["file_id", "content"])

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "text").mapInArrow(write, "file_id string, content binary")


LINES_SQL = """
SELECT doc_id, page_index, (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY i) - 1)::BIGINT AS line_id, x AS line_text
FROM (SELECT doc_id, i, x, CASE WHEN i <= (n + 1) // 2 THEN 0 ELSE 1 END::INT AS page_index
  FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
WHERE trim(x) <> ''
"""


def _lines(docs: pdf.Documents) -> DataFrame:
    return contents.page_lines(docs.elements).select(F.col("file_id").cast("long").alias("doc_id"), "page_index", F.col("line_id").cast("long").alias("line_id"), "line_text")


@query(LINES_SQL)
def pdf_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(pdf.Documents(_pdfs(spark, sf_dir)))


@query(LINES_SQL)
def pdf_object_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, layout="stream")))


@query(LINES_SQL)
def pdf_repair_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, layout="broken")))


@query(LINES_SQL)
def pdf_incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, layout="update")))


@query(LINES_SQL)
def pdf_updated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content streams of the first section are superseded."""
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, layout="replaced")))


@query(LINES_SQL)
def pdf_freed_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the first section is freed in the second."""
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, layout="freed")))


@query(LINES_SQL)
def pdf_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, password=b"pass"), "pass"))


@query(LINES_SQL)
def pdf_indirect_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, filter and parameters of streams are objects of their own; a stream holds the keyword that ends one."""
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, layout="indirect")))


@query(LINES_SQL)
def pdf_untyped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested page tree whose nodes have no type."""
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, layout="untyped")))


@query(LINES_SQL)
def pdf_table_from_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of objects starts at 1, so every entry is one off."""
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, layout="one")))


@query("""
SELECT doc_id, page_index, code, message FROM (
  SELECT doc_id, unnest([0, 1])::INT AS page_index, ['contents', 'contents', 'operator', 'operator', 'tree', 'open'] AS codes, doc_id % 6 AS k, text FROM documents),
LATERAL (SELECT CASE k WHEN 0 THEN 'contents' WHEN 1 THEN 'contents' WHEN 2 THEN 'operator' WHEN 3 THEN 'tree' WHEN 4 THEN 'open' END AS code,
  unnest(CASE k WHEN 0 THEN ['page ' || page_index || ': none'] WHEN 1 THEN ['page ' || page_index || ': object 99999 is missing']
    WHEN 2 THEN ['page ' || page_index || ': Tf', 'page ' || page_index || ': Td'] WHEN 3 THEN CASE page_index WHEN 0 THEN ['no page tree'] ELSE [] END WHEN 4 THEN CASE page_index WHEN 0 THEN ['no objects'] ELSE [] END ELSE [] END) AS message)
""")
def pdf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a fault each, by document: pages without content or with a missing one, wrong operands, no page tree, no objects, none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part, files = b.slice(i, 200), []
                for k, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    half = (len(lines) + 1) // 2
                    layout = ["nocontents", "lost", "operand", "notree", "junk", "table"][k % 6]
                    file = pdfwriter.write_pdf([lines[:half], lines[half:]], layout=layout)
                    files.append({"junk": b"%PDF-1.4 " + file[:0], "notree": file.replace(b"/Pages 2 0 R", b"/Pages 9 0 R")}.get(layout, file))
                ids = pa.array([str(k) for k in part.column("doc_id").to_pylist()])
                yield pa.RecordBatch.from_arrays([ids, pa.array(files, pa.binary())], ["file_id", "content"])

    e = pdf.Documents(d.mapInArrow(write, "file_id string, content binary")).errors
    page = F.coalesce(F.regexp_extract("message", "^page ([0-9]+)", 1).try_cast("int"), F.lit(0))
    return e.select(F.col("file_id").cast("long").alias("doc_id"), page.alias("page_index"), "code", F.when(F.col("code") == "operator", F.regexp_extract("message", "^page [0-9]+: [A-Za-z]+", 0)).otherwise(F.col("message")).alias("message"))


@query(r"""
WITH l AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
s AS (SELECT doc_id, 1::INT AS i, string_agg(x, chr(10) ORDER BY i) AS x FROM l WHERE trim(x) <> '' GROUP BY ALL)
SELECT doc_id, md5(translate(regexp_replace(x, '[^ -~\n]', ' ', 'g'),
 '"$''*-@ABCDEFGHIJKLMNOPQRSTUVWXYZ\^`abcdefghijklmnopqrstuvwxyz~',
 '∀∃∋∗−≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ∴⊥' || chr(63717) || 'αβχδεφγηιϕκλμνοπθρστυϖωξψζ∼')) AS digest FROM s
""")
def pdf_symbol_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the codes of the Symbol font, which has an encoding of its own."""
    d = pdf.Documents(_pdfs(spark, sf_dir, font="symbol"))
    lines = d.elements.groupBy(F.col("file_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("page_index", "obj_seq", "text"))).alias("t"))
    return lines.select("doc_id", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("digest"))


@query("""
WITH l AS (SELECT doc_id, i, x, CASE WHEN i <= (n + 1) // 2 THEN 0 ELSE 1 END::INT AS page_index
  FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x) <> '')
SELECT doc_id, page_index, (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY i) - 1)::BIGINT AS place, x AS line_text FROM l
""")
def pdf_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading and two columns of text side by side are read one column after the other."""
    lines = contents.page_lines(pdf.Documents(_pdfs(spark, sf_dir, style="columns")).elements)
    place = F.row_number().over(Window.partitionBy("file_id", "page_index").orderBy("line_id")) - 1
    return lines.select(F.col("file_id").cast("long").alias("doc_id"), "page_index", place.cast("long").alias("place"), "line_text")


@query(LINES_SQL)
def pdf_kerned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are set apart by kerning only, and broken into pieces and operators without a move."""
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, style="kerned")))


@query(LINES_SQL)
def pdf_simple_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A font without a character map: base encoding, differences by glyph names, widths by code."""
    return _lines(pdf.Documents(_pdfs(spark, sf_dir, font="simple", style="kerned")))


@query("""
WITH l AS (SELECT doc_id, i, x, CASE WHEN i <= (n + 1) // 2 THEN 0 ELSE 1 END::INT AS page_index
  FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x) <> ''),
g AS (SELECT *, sum(CASE WHEN i - p > 1 THEN 1 ELSE 0 END) OVER w AS grp, row_number() OVER w - 1 AS line_id, max(length(x)) OVER (PARTITION BY doc_id, page_index) AS pw
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, page_index ORDER BY i) AS p FROM l) WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY i)),
b AS (SELECT *, CASE WHEN lag(i) OVER q IS NULL THEN 0 WHEN bool_and(ends_with(x, '.')) OVER (PARTITION BY doc_id, page_index, grp) THEN 1 WHEN lag(length(x)) OVER q >= 0.8 * pw THEN 0 ELSE 1 END AS brk
  FROM g WINDOW q AS (PARTITION BY doc_id, page_index, grp ORDER BY i)),
t AS (SELECT doc_id, page_index, grp, par, min(line_id) AS seq, replace(string_agg(x, ' ' ORDER BY i), '- ', '') AS txt
  FROM (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_index, grp ORDER BY i) AS par FROM b) GROUP BY ALL),
h AS (SELECT doc_id, page_index, grp, min(seq) AS seq, string_agg(txt, chr(10) ORDER BY seq) AS txt FROM t GROUP BY ALL)
SELECT doc_id, page_index, string_agg(txt, chr(10) || chr(10) ORDER BY seq) AS text FROM h GROUP BY ALL
""")
def pdf_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: widths, spaces, groups, lists, paragraphs."""
    t = contents.page_texts(pdf.Documents(_pdfs(spark, sf_dir, style="kerned")).elements)
    return t.select(F.col("file_id").cast("long").alias("doc_id"), "page_index", "text")


@query("SELECT doc_id, (1 + length(text) % 4)::BIGINT AS n_pages FROM documents")
def pdf_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one to four pages, by the length of the text."""
    return pdf.Documents(_pdfs(spark, sf_dir, pages=True)).page_counts.select(F.col("file_id").cast("long").alias("doc_id"), "n_pages")


@query("SELECT doc_id, (12 + 3 * (length(text) % 4))::INT AS size, 1::INT AS root FROM documents")
def pdf_trailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.Documents(_pdfs(spark, sf_dir, pages=True)).trailers.select(F.col("file_id").cast("long").alias("doc_id"), "size", "root")


@query("""
SELECT doc_id, count(*) FILTER (trim(x) <> '') AS n_elements, coalesce(sum(2 * length(x)) FILTER (trim(x) <> ''), 0)::BIGINT AS n_bytes
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY doc_id HAVING count(*) FILTER (trim(x) <> '') > 0
""")
def pdf_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to text elements in one SQL statement with table functions; codes have two bytes."""
    udtf.register(spark)
    return spark.sql(
        """
        SELECT CAST(o.file_id AS LONG) AS doc_id, count(*) AS n_elements, sum(aggregate(e.pieces, 0L, (a, x) -> a + length(x))) AS n_bytes
        FROM {files} f, LATERAL pdf_open(f.file_id, f.content) o, LATERAL pdf_content(pdf_decode(o.value, o.raw)) e
        WHERE o.kind = 'object' AND o.raw IS NOT NULL AND o.obj >= 10 AND e.kind = 'text' GROUP BY 1
        """,
        files=_pdfs(spark, sf_dir),
    )


OUTLINE_SQL = f"""
WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i FROM documents)
SELECT doc_id, [i - 1]::INT[] AS path, 0::INT AS depth, x[:20] AS title, ((i - 1) % 2)::INT AS page_index FROM t WHERE i <= 3
UNION ALL SELECT doc_id, [i - 1, 0]::INT[], 1::INT, regexp_extract(x, '{WORDS}'), ((i - 1) % 2)::INT FROM t WHERE i <= 3 AND regexp_matches(x, '{WORDS}')
"""


def _outline(docs: pdf.Documents) -> DataFrame:
    return docs.outline.select(F.col("file_id").cast("long").alias("doc_id"), F.array_join("path", ".").alias("path"), "depth", "title", "page_index")


@query(f"SELECT doc_id, array_to_string(path, '.') AS path, depth, title, page_index FROM ({OUTLINE_SQL})")
def outline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested items, followed from the catalog; the document's own title is none."""
    return _outline(pdf.Documents(_pdfs(spark, sf_dir, titles=True)))


@query(f"SELECT doc_id, array_to_string(path, '.') AS path, depth, title, page_index FROM ({OUTLINE_SQL})")
def outline_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outline(pdf.Documents(_pdfs(spark, sf_dir, titles=True, password=b"pass"), "pass"))


@query("SELECT doc_id, 'password' AS code, 'wrong password' AS message FROM documents")
def pdf_wrong_password(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.Documents(_pdfs(spark, sf_dir, password=b"pass"), "other").errors.select(F.col("file_id").cast("long").alias("doc_id"), "code", "message")


@query("""
SELECT doc_id, obj::INT AS obj, in_use, obj_stm::INT AS obj_stm FROM documents,
(VALUES (1, TRUE, 20000), (2, TRUE, 20000), (3, TRUE, 20000), (4, TRUE, NULL), (5, TRUE, 20000), (20000, TRUE, NULL), (20001, TRUE, NULL)) AS v(obj, in_use, obj_stm)
UNION ALL SELECT doc_id, (10 + 3 * i + k)::INT, TRUE, CASE k WHEN 0 THEN 20000 END::INT FROM (SELECT doc_id, unnest(range(0, 1 + length(text) % 4)) AS i FROM documents), (VALUES (0), (1)) AS p(k)
""")
def xref_stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pdf.Documents(_pdfs(spark, sf_dir, pages=True, layout="stream")).xref
    return x.select(F.col("file_id").cast("long").alias("doc_id"), "obj", "in_use", "obj_stm")


@query("""
SELECT doc_id, obj::INT AS obj, kind FROM documents, (VALUES (1, '/Catalog'), (2, '/Pages'), (3, '/Font'), (5, '/Font')) AS v(obj, kind)
UNION ALL SELECT doc_id, (10 + 3 * unnest(range(0, 1 + length(text) % 4)))::INT, '/Page' FROM documents
""")
def objstm_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = pdf.Documents(_pdfs(spark, sf_dir, pages=True, layout="stream")).objects.where("pos is null")
    return o.select(F.col("file_id").cast("long").alias("doc_id"), "obj", F.get_json_object("value", "$.Type").alias("kind"))


# --- filters


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))


def _encoded(df: DataFrame, encode: Callable[[bytes], bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([encode(bytes(x)) for x in b.column("b").to_pylist()], pa.binary())], ["doc_id", "b"])

    return df.mapInArrow(run, "doc_id long, b binary")


MD5_SQL = "SELECT doc_id, md5(text) AS digest FROM documents"


def _filter_query(encode: Callable[[bytes], bytes], names: list[str], params: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _encoded(_bytes(spark, sf_dir), encode)
        return d.select("doc_id", F.md5(codecs.decode_stream("b", F.array(*[F.lit(x) for x in names]), F.lit(params))).alias("digest"))

    return run


def run_length_encode(b: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(b):
        n = 1
        while n < 128 and i + n < len(b) and b[i + n] == b[i]:
            n += 1
        out += bytes([257 - n, b[i]]) if n > 1 else bytes([0, b[i]])
        i += n
    return bytes(out) + b"\x80"


def lzw_encode(b: bytes) -> bytes:
    table_, width, bits, n, out, word = {}, 9, 256, 9, bytearray(), b""

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        bits &= (1 << n) - 1

    code_of = lambda w: w[0] if len(w) == 1 else table_[w]
    for c in b:
        longer = word + bytes([c])
        if len(longer) == 1 or longer in table_:
            word = longer
            continue
        put(code_of(word))
        table_[longer] = 258 + len(table_)
        width = max(9, (258 + len(table_)).bit_length())
        word = bytes([c])
        if len(table_) >= 3800:
            put(code_of(word))
            put(256)
            table_, width, word = {}, 9, b""
    if word:
        put(code_of(word))
        width = max(9, (259 + len(table_)).bit_length())
    put(257)
    return bytes(out) + bytes([bits << (8 - n) & 255] if n else b"")


def png_up(b: bytes, columns: int = 16) -> bytes:
    out, above = bytearray(), bytes(columns)
    b += b"\0" * (-len(b) % columns)
    for i in range(0, len(b), columns):
        row = b[i : i + columns]
        out += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
        above = row
    return zlib.compress(bytes(out))


def tiff_sub(b: bytes, columns: int = 16) -> bytes:
    b += b"\0" * (-len(b) % columns)
    return zlib.compress(bytes((x - (b[i - 1] if i % columns else 0)) & 255 for i, x in enumerate(b)))


def _add_filters() -> None:
    plain = {
        "filter_ascii85": (lambda b: base64.a85encode(b) + b"~>", ["ASCII85Decode"], None),
        "filter_run_length": (run_length_encode, ["RunLengthDecode"], None),
        "filter_flate": (zlib.compress, ["FlateDecode"], None),
        "filter_flate_repair": (lambda b: b"\xff\xfe" + zlib.compress(b), ["FlateDecode"], None),
        "filter_lzw": (lzw_encode, ["LZWDecode"], None),
        "filter_chain": (lambda b: base64.a85encode(zlib.compress(b)) + b"~>", ["ASCII85Decode", "FlateDecode"], None),
        "filter_identity": (lambda b: b, ["DCTDecode"], None),
    }
    for name, args in plain.items():
        QUERIES[name], ORACLES[name] = _filter_query(*args), MD5_SQL
    QUERIES["predictor_tiff"] = _filter_query(tiff_sub, ["FlateDecode"], '[{"Predictor": 2, "Columns": 16}]')
    padded = "SELECT doc_id, md5(encode(text) || repeat('\\x00'::BLOB, (16 - octet_length(encode(text)) % 16) % 16)) AS digest FROM documents"
    QUERIES["predictor_png"] = _filter_query(png_up, ["FlateDecode"], '[{"Predictor": 12, "Columns": 16}]')
    ORACLES["predictor_png"] = ORACLES["predictor_tiff"] = padded


_add_filters()


@query(MD5_SQL)
def filter_asciihex(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _bytes(spark, sf_dir).select("doc_id", F.concat(F.lower(F.hex("b")), F.lit(">")).alias("h"))
    return d.select("doc_id", F.md5(codecs.asciihex_native(F.col("h"))).alias("digest"))


@query(MD5_SQL)
def rc4_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _bytes(spark, sf_dir).withColumn("key", codecs.object_key(F.unhex(F.lit("0102030405")), F.col("doc_id").cast("int"), F.lit(0)))
    return d.select("doc_id", F.md5(codecs.rc4_stream("key", codecs.rc4_stream("key", "b"))).alias("digest"))


@query("""
SELECT doc_id, substr(md5(unhex('0102030405' || lpad(to_hex(doc_id & 255), 2, '0') || lpad(to_hex((doc_id >> 8) & 255), 2, '0') || lpad(to_hex((doc_id >> 16) & 255), 2, '0') || '0000')), 1, 20) AS object_key
FROM documents
""")
def object_key_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = codecs.object_key(F.unhex(F.lit("0102030405")), F.col("doc_id").cast("int"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(key)).alias("object_key"))


# --- layout on elements made from documents: a word is an element, a line of text a line

ELEMENTS_SQL = f"""
w AS (SELECT doc_id, li, generate_subscripts(regexp_extract_all(line, '{WORDS}'), 1)::INT AS wi, unnest(regexp_extract_all(line, '{WORDS}')) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS li FROM documents)),
e AS (SELECT doc_id, li AS obj_seq, wi AS elem_seq, text, (-12 * (li + 2 * (li // 4)))::DOUBLE AS ty,
  (10 * (li % 3) + coalesce(sum(length(text) * 5 + CASE WHEN wi % 3 = 0 THEN 0 ELSE 4 END) OVER (PARTITION BY doc_id, li ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS tx,
  (length(text) * 5)::DOUBLE AS width, 10.0::DOUBLE AS scale_y, 5.0::DOUBLE AS space_width, 'F' || (wi % 2) AS font_key FROM w),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0 DESC, x0, obj_seq, elem_seq)::INT AS seq
  FROM (SELECT *, first_value(ty) OVER o AS y0, first_value(tx) OVER o AS x0 FROM e WINDOW o AS (PARTITION BY doc_id, obj_seq ORDER BY elem_seq))),
g AS (SELECT *, sum(CASE WHEN dy >= scale_y THEN 1 ELSE 0 END) OVER p AS line_id, sum(CASE WHEN dy >= 2 * scale_y THEN 1 ELSE 0 END) OVER p AS group_id
  FROM (SELECT *, coalesce(abs(ty - lag(ty) OVER (PARTITION BY doc_id ORDER BY seq)), 0) AS dy FROM s) WINDOW p AS (PARTITION BY doc_id ORDER BY seq)),
t AS (SELECT * REPLACE (CASE WHEN lag(text) OVER l IS NOT NULL AND tx - lag(tx + width) OVER l >= space_width / 2 THEN ' ' || text ELSE text END AS text)
  FROM g WINDOW l AS (PARTITION BY doc_id, line_id ORDER BY seq)),
ln AS (SELECT doc_id, group_id, line_id, string_agg(text, '' ORDER BY seq) AS line_text, arg_min(tx, seq) AS line_x, sum(width) AS line_width, arg_max(text, seq) AS last_text
  FROM t GROUP BY ALL)
"""
DOC = ["doc_id"]


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("li", "line"))
    d = d.select("doc_id", (F.col("li") + 1).alias("obj_seq"), F.posexplode(F.regexp_extract_all("line", F.lit(WORDS), F.lit(0))).alias("wi", "text"))
    d = d.withColumn("elem_seq", F.col("wi") + 1)
    before = Window.partitionBy("doc_id", "obj_seq").orderBy("elem_seq").rowsBetween(Window.unboundedPreceding, -1)
    step = F.char_length("text") * 5 + F.when(F.col("elem_seq") % 3 == 0, 0).otherwise(4)
    li = F.col("obj_seq")
    return d.select(
        "doc_id", "obj_seq", "elem_seq", "text", (-12 * (li + 2 * F.floor(li / 4))).cast("double").alias("ty"),
        (10 * (li % 3) + F.coalesce(F.sum(step).over(before), F.lit(0))).cast("double").alias("tx"), (F.char_length("text") * 5).cast("double").alias("width"),
        F.lit(10.0).alias("scale_y"), F.lit(5.0).alias("space_width"), F.concat(F.lit("F"), F.col("elem_seq") % 2).alias("font_key"),
    )


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines_and_groups(layout.reading_order(_elements(spark, sf_dir), DOC), DOC)


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_texts(layout.insert_spaces(_grouped(spark, sf_dir), DOC), DOC)


def _with(rest: str) -> str:
    return f"WITH {ELEMENTS_SQL} {rest}"


@query(_with("SELECT doc_id, obj_seq, elem_seq, seq FROM s"))
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_elements(spark, sf_dir), DOC).select("doc_id", "obj_seq", "elem_seq", "seq")


@query(_with("SELECT doc_id, seq, line_id::BIGINT AS line_id, group_id::BIGINT AS group_id FROM g"))
def line_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("doc_id", "seq", "line_id", "group_id")


@query(_with("SELECT doc_id, line_id::BIGINT AS line_id, line_text, line_x, line_width FROM ln"))
def insert_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_lines(spark, sf_dir).select("doc_id", "line_id", "line_text", "line_x", "line_width")


@query(_with("SELECT doc_id, max(line_width) AS page_width, max(length(line_text))::INT AS page_chars FROM ln GROUP BY doc_id"))
def page_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_width(_doc_lines(spark, sf_dir), DOC)


@query(_with("SELECT doc_id, group_id::BIGINT AS group_id, bool_and(ends_with(last_text, '.')) AS is_list FROM ln GROUP BY ALL"))
def list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.list_groups(_doc_lines(spark, sf_dir), DOC)


@query(_with("""
, m AS (SELECT doc_id, max(line_width) AS pw FROM ln GROUP BY doc_id),
li AS (SELECT doc_id, group_id, bool_and(ends_with(last_text, '.')) AS is_list FROM ln GROUP BY ALL),
b AS (SELECT ln.*, CASE WHEN lag(line_id) OVER q IS NULL THEN 0 WHEN is_list THEN 1 WHEN lag(line_width) OVER q >= 0.8 * pw THEN 0 ELSE 1 END AS brk
  FROM ln JOIN m USING (doc_id) JOIN li USING (doc_id, group_id) WINDOW q AS (PARTITION BY doc_id, group_id ORDER BY line_id)),
p AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, group_id ORDER BY line_id) AS paragraph FROM b)
SELECT doc_id, group_id::BIGINT AS group_id, paragraph::BIGINT AS paragraph, count(*)::BIGINT AS n_lines, replace(string_agg(line_text, ' ' ORDER BY line_id), '- ', '') AS text FROM p GROUP BY ALL
"""))
def paragraphs_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraphs(_doc_lines(spark, sf_dir), DOC).select("doc_id", "group_id", "paragraph", "n_lines", "text")


@query()
def paragraphs_charmode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraphs(_doc_lines(spark, sf_dir), DOC, by_chars=True).select("doc_id", "group_id", "paragraph", "n_lines", "text")


@query(_with("SELECT doc_id, line_id::BIGINT AS line_id, (dense_rank() OVER (PARTITION BY doc_id, group_id ORDER BY line_x) - 1)::INT AS indent FROM ln"))
def indent_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.indent_levels(_doc_lines(spark, sf_dir), DOC).select("doc_id", "line_id", "indent")


@query(_with("""
, r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, line_id ORDER BY seq) AS run
  FROM (SELECT *, CASE WHEN font_key = lag(font_key) OVER (PARTITION BY doc_id, line_id ORDER BY seq) THEN 0 ELSE 1 END AS n FROM (SELECT * REPLACE ('F' || (elem_seq // 3 % 2) AS font_key) FROM g)))
SELECT doc_id, line_id::BIGINT AS line_id, min(seq)::INT AS seq, font_key, string_agg(text, '' ORDER BY seq) AS text FROM r GROUP BY doc_id, line_id, run, font_key
"""))
def merge_same_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _grouped(spark, sf_dir).withColumn("font_key", F.concat(F.lit("F"), F.floor(F.col("elem_seq") / 3) % 2)).withColumn("rgb", F.lit(0))
    return layout.merge_styles(e, DOC).select("doc_id", "line_id", "seq", "font_key", "text")


@query("""
WITH n AS (SELECT l_partkey, l_quantity AS w, count(*) AS n, max(l_orderkey * 10 + l_linenumber) AS last FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)
SELECT l_partkey, w AS space_width FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, last) AS r FROM n) WHERE r = 1
""")
def space_width_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_partkey", (-F.col("l_quantity")).alias("adj"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return layout.space_width_by_mode(d, ["l_partkey"])


@query("""
SELECT l_orderkey, min(CASE WHEN d <> 0 THEN d END) AS space_width
FROM (SELECT l_orderkey, l_linenumber, max(l_discount) AS d FROM lineitem GROUP BY ALL) GROUP BY l_orderkey
""")
def space_width_min_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("d"))
    d = d.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "d"))).alias("widths"))
    return d.select("l_orderkey", layout.min_nonzero(F.col("widths")).alias("space_width"))


@query("""
SELECT l_orderkey, string_agg(CASE WHEN l_quantity >= 0.6 * 40 THEN ' ' ELSE '' END || l_returnflag, '' ORDER BY l_linenumber, l_returnflag, l_quantity DESC) AS text,
       round(sum(CASE l_returnflag WHEN 'A' THEN 500 WHEN 'N' THEN 700 ELSE 600 END + l_quantity) / 1000 * 10, 6) AS width
FROM lineitem GROUP BY l_orderkey
""")
def tj_text_and_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", F.col("l_returnflag").alias("s"), (-F.col("l_quantity")).alias("adj"))
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("tj"))
    widths = F.create_map(*[F.lit(x) for x in (65, 500.0, 78, 700.0)])
    return d.select("l_orderkey", layout.kerned_text(F.col("tj"), F.lit(40.0)).alias("text"), F.round(layout.kerned_width(layout.glyph_widths(F.col("tj"), widths, F.lit(600.0)), F.lit(10.0)), 6).alias("width"))


@query("SELECT o_custkey, string_agg(o_orderstatus || ' || ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS rendered FROM orders GROUP BY o_custkey")
def table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("cells"))
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["cells"]).alias("rows"))
    return d.select("o_custkey", layout.render_table(F.col("rows")).alias("rendered"))


@query("""
SELECT o_custkey, string_agg(o_orderstatus || ' || ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS rendered FROM orders GROUP BY o_custkey HAVING count(*) > 1
""")
def table_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    line = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = o.withColumn("obj_seq", line)
    o = o.select("o_custkey", "obj_seq", F.explode(F.array(F.struct(F.lit(0.0).alias("tx"), F.col("o_orderstatus").alias("text")), F.struct(F.lit(100.0).alias("tx"), F.col("o_orderpriority").alias("text")))).alias("c"))
    e = o.select("o_custkey", "obj_seq", (F.col("c.tx") / 100).cast("int").alias("elem_seq"), "c.tx", "c.text", (F.col("obj_seq") * -12.0).alias("ty"))
    e = e.withColumn("width", F.char_length("text") * 5.0).withColumn("scale_y", F.lit(10.0)).withColumn("space_width", F.lit(5.0))
    key = ["o_custkey"]
    found = tables.table_rows(tables.divide_columns(layout.lines_and_groups(layout.reading_order(e, key), key), key), key)
    return found.select("o_custkey", layout.render_table(F.col("rows")).alias("rendered"))


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, [CASE WHEN o_orderkey % 3 <> 1 THEN o_orderstatus END, CASE WHEN o_orderkey % 5 <> 2 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey::VARCHAR END] AS c FROM orders),
n AS (SELECT DISTINCT o_custkey FROM w WHERE c[1] IS NOT NULL AND c[2] IS NOT NULL AND c[3] IS NOT NULL)
SELECT o_custkey, string_agg(array_to_string(list_transform(c, lambda x: coalesce(x, ' ')), ' || '), chr(10) ORDER BY o_orderkey) AS rendered
FROM (SELECT 0 AS o_orderkey, o_custkey, ['status', 'priority', 'key'] AS c FROM n UNION ALL SELECT 1, o_custkey, ['s', 'p', 'k'] FROM n UNION ALL SELECT o_orderkey + 2, o_custkey, c FROM w SEMI JOIN n USING (o_custkey) WHERE c[3] IS NOT NULL AND (c[1] IS NOT NULL OR c[2] IS NOT NULL))
GROUP BY o_custkey
""")
def table_blank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of orders under a heading of two lines; some skip their first or their middle cell."""
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") + 2).alias("row"), F.when(F.col("o_orderkey") % 3 != 1, F.col("o_orderstatus")).alias("a"), F.when(F.col("o_orderkey") % 5 != 2, F.col("o_orderpriority")).alias("b"), F.when(F.col("o_orderkey") % 3 != 2, F.col("o_orderkey").cast("string")).alias("c"))
    full = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()
    some = o.where(full).select("o_custkey").distinct()
    kept = o.join(some, "o_custkey", "left_semi").where("c is not null and (a is not null or b is not null)")
    heads = some.select("o_custkey", F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("row"), *[F.lit(x).alias(n) for n, x in zip("abc", words, strict=True)]) for i, words in enumerate((("status", "priority", "key"), ("s", "p", "k")))])))
    rows = kept.unionByName(heads).withColumn("obj_seq", F.row_number().over(Window.partitionBy("o_custkey").orderBy("row")))
    cell = lambda i, n: F.struct(F.lit(i).alias("elem_seq"), F.lit(200.0 * i).alias("tx"), F.col(n).alias("text"))
    e = rows.select("o_custkey", "obj_seq", F.inline(F.filter(F.array(*[cell(i, n) for i, n in enumerate("abc")]), lambda x: x["text"].isNotNull())))
    e = e.withColumns({"ty": F.col("obj_seq") * -12.0, "width": F.char_length("text") * 5.0, "scale_y": F.lit(10.0), "space_width": F.lit(5.0)})
    key = ["o_custkey"]
    found = tables.table_rows(tables.divide_columns(layout.lines_and_groups(layout.reading_order(e, key), key), key), key)
    return found.select("o_custkey", layout.render_table(F.col("rows")).alias("rendered"))


# --- trees and precedence


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY ALL")
def xref_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (-F.col("event_id")).alias("section"))
    return graph.newest(d, ["user_id", "event_type"], "section").select("user_id", "event_type", "event_id")


def _geography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A tree for each nation: its market segments, and their customers."""
    n, c = (table(spark, sf_dir, x) for x in ("nation", "customer"))
    c = c.withColumn("tree", F.col("c_nationkey").cast("long"))
    segments = c.select("tree", "c_mktsegment").distinct()
    edges = segments.select("tree", F.concat(F.lit("n"), "tree").alias("parent"), F.ascii(F.substring("c_mktsegment", 1, 1)).alias("ordinal"), F.col("c_mktsegment").alias("child"), F.when(F.col("tree") % 2 == 0, F.col("c_mktsegment")).alias("own"))
    edges = edges.unionByName(c.select("tree", F.col("c_mktsegment").alias("parent"), F.col("c_custkey").cast("int").alias("ordinal"), F.concat(F.lit("c"), "c_custkey").alias("child"), F.lit(None).cast("string").alias("own")))
    roots = n.select(F.col("n_nationkey").cast("long").alias("tree"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("carried"))
    return roots, edges


@query("""
SELECT 'c' || c_custkey AS node, (row_number() OVER (PARTITION BY c_nationkey ORDER BY ascii(c_mktsegment), c_custkey) - 1)::INT AS page_index, CASE WHEN n_nationkey % 2 = 0 THEN c_mktsegment ELSE n_name END AS carried
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def page_tree_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, edges = _geography(spark, sf_dir)
    # nations without customers are leaves, but no pages
    return graph.leaves(graph.walk(roots, edges), edges).where(F.startswith("node", F.lit("c"))).select("node", "page_index", "carried")


# --- scalars, colours, fonts and character maps


@query(r"SELECT doc_id, md5(regexp_replace(replace(text, ' ', '  '), ' +', ' ', 'g')) AS digest FROM documents")
def collapse_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.collapse_spaces(F.replace("text", F.lit(" "), F.lit("  ")))).alias("digest"))


@query("""
SELECT l_orderkey, l_linenumber, round((1 - l_discount) * (1 - l_tax), 9) AS r, round((1 - l_tax) * (1 - l_tax), 9) AS g, round((1 - l_quantity / 100) * (1 - l_tax), 9) AS b FROM lineitem
""")
def cmyk_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = scalars.cmyk_to_rgb(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(rgb[i], 9).alias(k) for i, k in enumerate("rgb")])


@query("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN least(a, b) > 0.5 THEN a * least((1 - greatest(a, b)) / 0.5, 0.5) ELSE a END, 9) AS r,
       CASE WHEN b < 0 THEN -1 ELSE round(b * 255)::INT END AS g255
FROM (SELECT *, 1 - l_discount AS a, l_quantity / 50 AS b FROM lineitem)
""")
def darken_bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = F.array(1 - F.col("l_discount"), F.col("l_quantity") / 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scalars.darken_bright(rgb)[0], 9).alias("r"), scalars.to_255(rgb)[1].alias("g255"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 + l_linenumber * 3 AS a, l_quantity * 5 + l_linenumber * 7 + 11 AS e FROM lineitem")
def affine_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n, one = F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(1.0)
    m = scalars.affine([q, n, one, one, q, n], [F.lit(2.0), one, F.lit(3.0), one, F.lit(11.0), one])
    m2 = scalars.affine([q, n, one, one, q, n], [F.lit(5.0), one, F.lit(7.0), one, F.lit(11.0), one])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m[0].alias("a"), m2[4].alias("e"))


@query("""
SELECT p_partkey, font, face FROM part JOIN (VALUES (0, 'ARIAL', 'sans-serif'), (1, 'COURIER_BOLD_ITALIC', 'serif-monospace'), (2, 'TIMES_ITALIC', 'serif-italic'), (3, 'TIMES_NEW_ROMAN', 'serif'), (4, 'HELVETICA_BOLD', 'sans-serif-bold'), (5, 'SYMBOL', 'sans-serif'), (6, 'DEFAULT', 'sans-serif'), (7, 'ITC_STONE_SERIF', 'serif'), (8, 'SANS_SERIF_BOLD', 'sans-serif-bold'), (9, 'MONOSPACE', 'monospace'), (10, 'ZAPFDINGBATS', 'sans-serif'), (11, 'DEFAULT_ITALIC', 'sans-serif-italic'), (12, 'CURSIVE', 'cursive'), (13, 'CASUAL', 'casual'), (14, 'DEFAULT', 'sans-serif'), (15, 'SERIF_BOLD_ITALIC', 'serif-bold-italic')) AS v(i, font, face) ON p_partkey % 16 = i
""")
def font_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of fonts in files, their font by the rules, and the typeface where its fallbacks end; the SQL has the expected ones."""
    names = F.array(*[F.lit(x) for x in ("ArialMT", "Courier-BoldOblique", "ABCDEF+Times-Italic", "TimesNewRomanPS-BoldMT", "HELVETICA-bold", "Symbol", "SymbolMT", "ITCStoneSerif", "MS Sans Serif Bold", "DejaVuSansMono", "Zapf-Dingbats", "Garamond-Italic", "BrushCursive", "Casual-Bold", "", "LiberationSerif-BoldItalic")])
    font = fonts.font_name(F.get(names, (F.col("p_partkey") % 16).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", font.alias("font"), fonts.typeface(font).alias("face"))


@query("""
SELECT n_nationkey, code, CASE WHEN code BETWEEN 65 AND 77 THEN code + 32 WHEN code BETWEEN 70 AND 85 THEN code + 1000 ELSE 9633 END::BIGINT AS unicode
FROM (SELECT n_nationkey, unnest(list_transform(string_split(n_name, ''), lambda c: ascii(c)))::BIGINT AS code FROM nation)
""")
def cmap_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([("f", 0, 65, 77, 97), ("f", 1, 70, 85, 1070)], "font string, seq int, lo long, hi long, dst long")
    codes = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("f").alias("font"), F.explode(F.split("n_name", "")).alias("c")).where("c <> ''")
    codes = codes.select("n_nationkey", "font", F.ascii("c").cast("long").alias("code"))
    return cmaps.map_codes(codes, cmaps.expand_ranges(ranges)).select("n_nationkey", "code", "unicode")


@query("""
SELECT l_orderkey AS font, (p + i - 2)::BIGINT AS code, arg_max(['a', 'b', 'c'][i], l_linenumber * 4 + i) AS glyph
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL), (SELECT unnest([1, 2, 3]) AS i) GROUP BY ALL
""")
def differences_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    d = d.select(F.col("l_orderkey").alias("font"), "l_linenumber", "l_partkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    seq = F.col("l_linenumber") * 4 + F.col("i")
    items = d.select("font", seq.alias("seq"), F.when(F.col("i") == 0, F.col("l_partkey") - 1).alias("number"), F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("i") - 1).alias("glyph"))
    return cmaps.expand_differences(items)


@query("""
SELECT l_orderkey AS font, 100 * l_linenumber + i AS cid, l_quantity + CASE WHEN l_linenumber % 2 = 0 THEN i ELSE 0 END AS width
FROM (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, unnest([0, 1, 2]) AS i FROM lineitem)
""")
def cid_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, first = F.col("l_quantity"), F.col("l_linenumber").cast("long") * 100
    d = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("font"), first.alias("first"), (first + 2).alias("last"), q.alias("width"), F.when(F.col("l_linenumber") % 2 == 0, F.array(q, q + 1, q + 2)).alias("widths")
    )
    return cmaps.expand_widths(d)


@query("SELECT c_custkey, c_custkey % 65536 AS number, lower(lpad(to_hex(c_custkey % 65536), 4, '0')) AS digits FROM customer")
def big_endian_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits: Column = F.lpad(F.hex(F.col("c_custkey") % 65536), 4, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.big_endian(F.unhex(digits)).alias("number"), F.lower(digits).alias("digits"))


@query(r"""
SELECT l_orderkey, bool_and(l_discount <> 0) AS metric, round(avg(CASE WHEN l_tax <> 0 THEN l_tax END), 9) AS missing FROM lineitem GROUP BY l_orderkey
""")
def measure_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is measured by widths if every font has a missing width; that is the mean of the widths where none is given."""
    d = table(spark, sf_dir, "lineitem").withColumn("missing", F.nullif("l_discount", F.lit(0.0)))
    d = d.groupBy("l_orderkey").agg(F.bool_and(F.col("missing").isNotNull()).alias("metric"), F.collect_list("l_tax").alias("w"))
    return d.select("l_orderkey", "metric", F.round(pdf.mean_width(F.col("w")), 9).alias("missing"))


@query("""
SELECT l_orderkey AS font, (first + i)::INT AS cid, w::DOUBLE AS width FROM (SELECT l_orderkey, l_linenumber * 100 AS first, l_quantity::INT AS w, unnest([0, 1, 2]) AS i, l_linenumber AS n FROM lineitem) WHERE n % 2 = 1
UNION ALL SELECT l_orderkey, (first + i)::INT, (w + i)::DOUBLE FROM (SELECT l_orderkey, l_linenumber * 100 AS first, l_quantity::INT AS w, unnest([0, 1]) AS i, l_linenumber AS n FROM lineitem) WHERE n % 2 = 0
""")
def cid_width_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width arrays as composite fonts write them: c [w w] and c c w in turn."""
    first, w = (F.col("l_linenumber") * 100).cast("string"), F.col("l_quantity").cast("int")
    listed = F.concat(first, F.lit(" ["), w.cast("string"), F.lit(" "), (w + 1).cast("string"), F.lit("]"))
    text = F.when(F.col("l_linenumber") % 2 == 0, listed).otherwise(F.concat_ws(" ", first, (F.col("l_linenumber") * 100 + 2).cast("string"), w.cast("string")))
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("font")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(text)), " "), F.lit("]")).alias("w"))
    d = d.withColumn("w", F.replace(F.regexp_replace("w", r"([0-9\]]) (?=[0-9\[])", "$1,"), F.lit(" "), F.lit(",")))
    return cmaps.expand_widths(cmaps.cid_spans(d))


@query("""
SELECT p_partkey, ['A', 'é', 'Ł', 'α', '€', '□', 'ﬁ', '©'][(p_partkey % 8 + 1)::INT] AS text FROM part
""")
def glyph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("A", "eacute.alt", "Lslash", "alpha", "uni20AC", ".notdef", "fi", "copyright")])
    return cmaps.glyph_text(table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 8).cast("int")).alias("glyph"))).select("p_partkey", "text")


@query("""
SELECT n_nationkey, '□' || n_name AS text FROM nation
""")
def tounicode_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of one and of two bytes, single and in ranges; the first is not mapped."""
    cmap = b"2 begincodespacerange <00> <20> <2000> <FFFF> endcodespacerange 1 beginbfchar <2020> <0020> endbfchar 1 beginbfrange <2021> <207E> <0021> endbfrange"
    shown = lambda name: [{"s": "\x01" + "".join(" " + c for c in name)}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ["".join(x["s"] for x in pdf.pieces(shown(n), {"cmap": cmap})) for n in b.column("n_name").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("n_nationkey"), pa.array(out)], ["n_nationkey", "text"])

    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInArrow(run, "n_nationkey int, text string")


@query("""
SELECT doc_id, kind, width, height, components, digest FROM (
  SELECT doc_id, 'inline' AS kind, octet_length(encode(text))::INT AS width, 1::INT AS height, 1::INT AS components, md5(text) AS digest FROM documents
  UNION ALL SELECT doc_id, 'object', octet_length(encode(text))::INT, 1::INT, 4::INT, md5(text) FROM documents)
""")
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as the bytes of an inline image and of one that Do draws; a form and a missing name draw none."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [pdfwriter.write_images((x or "").encode()) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), pa.array(files, pa.binary())], ["file_id", "content"])

    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "text").mapInArrow(write, "file_id string, content binary")
    i = pdf.Documents(files).images
    return i.select(F.col("file_id").cast("long").alias("doc_id"), F.when(F.col("obj").isNull(), "inline").otherwise("object").alias("kind"), "width", "height", "components", F.md5("data").alias("digest"))


@query("SELECT c_custkey, to_base(c_custkey, 8) AS digits, c_custkey::BIGINT AS number FROM customer")
def octal_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = scalars.octal(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", digits.alias("digits"), scalars.from_octal(digits).alias("number"))


@query(r"SELECT doc_id, md5(replace(replace('(' || text || ')', '(', '\050'), ')', '\051')) AS digest FROM documents")
def encode_parentheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.encode_parentheses(F.concat(F.lit("("), "text", F.lit(")")))).alias("digest"))


@query("SELECT doc_id, md5(trim(' ' || chr(13) || chr(10) || text || chr(10) || ' ', ' ' || chr(10) || chr(13))) AS digest FROM documents")
def trim_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.trim_ends(F.concat(F.lit(" \r\n"), "text", F.lit("\n ")))).alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey + 0.5::DOUBLE END AS number FROM part")
def safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("x")).otherwise(F.lit(" ")), "p_partkey", F.lit(".5"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.number(text).alias("number"))


@query("SELECT n_nationkey, 61440 + ascii(n_name) AS unicode FROM nation")
def symbol_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.symbol_code(F.ascii("n_name")).alias("unicode"))


@query("""
SELECT c_custkey, c_custkey % 65536 // 256 BETWEEN 1 AND 3 AND c_custkey % 256 BETWEEN 32 AND 126 AS inside FROM customer
""")
def codespace_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.unhex(F.lpad(F.hex(F.col("c_custkey") % 65536), 4, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.in_codespace(code, F.unhex(F.lit("0120")), F.unhex(F.lit("037E"))).alias("inside"))
