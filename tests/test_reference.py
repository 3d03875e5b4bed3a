"""The document engine: codecs, character maps, file layouts, layout steps, and every query against its SQL."""

from __future__ import annotations

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill import queries as q
from leafmill.functions import codecs
from leafmill.operators import graph, layout
from leafmill.plans.contents import page_lines, page_spans, page_texts
from leafmill.sources import pdf_bytes
from leafmill.sources.pdf import Documents, PdfError, read_pdf
from leafmill.testing.pdfwriter import write_pdf

from .conftest import SF

SLOW = {
    "pdf_object_streams", "pdf_repair_scan", "pdf_incremental_update", "pdf_encrypted", "pdf_updated_stream", "pdf_freed_object", "pdf_simple_encoding", "pdf_text_lines", "outline_encrypted",
    "pdf_indirect_streams", "pdf_untyped_nodes", "pdf_table_from_one", "pdf_errors", "pdf_symbol_font", "pdf_two_columns",
}  # fmt: skip  covered by test_layouts and test_damaged.py


def test_known_values():
    assert codecs.ascii85(b'<~87cURD]i,"Ebo7~>') == b"Hello World"
    assert codecs.asciihex(b"48656c6c6f20576f726c64>") == b"Hello World"
    assert codecs.asciihex(b"4 8 6>") == b"H`"
    assert codecs.run_length(bytes([2, 65, 66, 67, 254, 90, 128, 1])) == b"ABCZZZ"
    assert codecs.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert codecs.flate(b"") == b"" and codecs.lzw(b"") == b""
    assert codecs.lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trips(b):
    assert codecs.lzw(q.lzw_encode(b)) == b
    assert codecs.run_length(q.run_length_encode(b)) == b
    assert codecs.flate(zlib.compress(b)) == b
    assert codecs.unpredict(zlib.decompress(q.png_up(b)), 12, 1, 8, 16).rstrip(b"\0") == b.rstrip(b"\0")


def test_repaired_streams():
    """A whole stream after broken bytes is taken, be it empty, or chance makes data of what stands before it or in it."""
    bad = b"\xff\xfe"
    assert codecs.flate(bad + zlib.compress(b"")) == b""
    text = bytes(range(256)) * 254 + b"x" * 99  # stored: its head reads like that of a stored block two bytes earlier
    stored = b"\x78\x9c\x01\x63\xfe\x9c\x01" + text + zlib.adler32(text).to_bytes(4, "big")
    assert codecs.flate(bad + stored) == codecs.flate(stored) == text
    inner = zlib.compress(b"a" * 5000)
    assert codecs.flate(bad + zlib.compress(inner, 0)) == inner
    assert codecs.flate(zlib.compress(b"some text" * 9)[:-9]) and codecs.flate(bad + zlib.compress(b"some text" * 9)[:-4]) == b"some text" * 9


@pytest.mark.parametrize("tag", [0, 1, 2, 3, 4])
def test_png_rows(tag):
    rows = [bytes(range(i, i + 8)) for i in (3, 90, 200)]
    out, above = b"", bytes(8)
    for r in rows:
        coded = bytearray([tag])
        for j, x in enumerate(r):
            left, up, corner = (r[j - 1] if j else 0), above[j], (above[j - 1] if j else 0)
            p = left + up - corner
            guess = [0, left, up, (left + up) // 2, min((left, up, corner), key=lambda v: abs(p - v))][tag]
            coded.append((x - guess) & 255)
        out, above = out + bytes(coded), r
    assert codecs.unpredict(out, 15, 1, 8, 8) == b"".join(rows)


def test_values():
    v, _ = pdf_bytes.value(b"<</A[1 -2.5 (a\\(b\\051\\n) <48 6>]/B 12 0 R/C/N#20x/D null/E true>>", 0)
    assert v == {"A": [1, -2.5, {"s": "a(b)\n"}, {"s": "H`"}], "B": {"r": [12, 0]}, "C": "/N x", "D": None, "E": True}


def test_to_unicode():
    cmap = b"1 begincodespacerange <00> <20> <2000> <FFFF> endcodespacerange 1 beginbfchar <11> <0041> endbfchar 2 beginbfrange <2023> <2025> <0061> <2030> <2031> [<00660066> <0067>] endbfrange"
    m = pdf_bytes.CodeMap(cmap)
    assert [t for _, t in m.codes(bytes.fromhex("0111202420302031"))] == ["□", "A", "b", "ff", "g"]
    assert m.codes(b"\x20") == [(32, "□")] and pdf_bytes.CodeMap(b"").codes(b"ab") == [(97, "□"), (98, "□")]


PAGES = [["Hello (World) é", "second line", "", "after gap"], ["üñ äöß x-", "x"]]
WANT = ["Hello (World) é second line\n\nafter gap", "üñ äöß xx"]


def test_layouts(spark, tmp_path):
    """Every file layout, font and style gives the same pages; titles come in order, with the page they lead to."""
    layouts = ("table", "stream", "broken", "update", "replaced", "freed")
    outline = [("One", 0, ["below", "and below"]), ("Zwö", 1, [])]
    made = {x: write_pdf(PAGES, x, outline=outline, style=y) for x, y in zip(layouts, ["plain", "kerned"] * 3, strict=True)}
    made |= {"enc": write_pdf(PAGES, password=b"secret", outline=outline), "simple": write_pdf(PAGES, font="simple", style="kerned"), "junk": b"no pdf"}
    made["other"] = write_pdf(PAGES, password=b"another")
    for name, b in made.items():
        (tmp_path / f"{name}.pdf").write_bytes(b)
    d = read_pdf(spark, str(tmp_path), "secret")
    name = F.regexp_extract("file_id", r"([a-z]+)\.pdf$", 1)
    got = {(r["n"], r["page_index"]): r["text"] for r in page_texts(d.elements).withColumn("n", name).collect()}
    assert got == {(n, i): t for n in made if n not in ("junk", "other") for i, t in enumerate(WANT)}
    titles = sorted((r["n"], r["path"], r["title"], r["page_index"]) for r in d.outline.withColumn("n", name).collect())
    tree = [([0], "One", 0), ([0, 0], "below", 0), ([0, 1], "and below", 0), ([1], "Zwö", 1)]
    assert titles == sorted((n, *t) for n in (*layouts, "enc") for t in tree)
    errors = {(r["n"], r["code"], r["message"]) for r in d.errors.withColumn("n", name).collect()}
    assert errors == {("junk", "open", "no objects"), ("other", "password", "wrong password")}
    with pytest.raises(PdfError, match="password|open"):
        read_pdf(spark, str(tmp_path), "secret", mode="FAILFAST")
    spans = page_spans(d.elements).withColumn("n", name).where("n = 'simple' and page_index = 1").orderBy("line_id").collect()
    assert [(r["text"], r["family"]) for r in spans] == [("üñ äöß x-", "serif"), ("x", "serif")]


def one_page(content: bytes, font: bytes = b"<</Type/Font/Subtype/Type1/BaseFont/Arial/FirstChar 32/Widths[250 500 500]/FontDescriptor<</MissingWidth 500>>/Encoding/WinAnsiEncoding>>", more: bytes = b"") -> bytes:
    bodies = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 2 0 R]/Resources<</Font 7 0 R>>>>", 3: b"<</Type/Page/Contents 4 0 R>>",
        4: b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content), 5: font, 7: b"<</F 5 0 R>>",
    }
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in bodies.items()) + more + b"trailer\n<</Root 1 0 R>>\n"


def test_text_operators(spark):
    cases = {
        "pieces": (b"BT /F 10 Tf (Hel) Tj (lo) Tj ET", "Hello"),
        "kerning": (b"BT /F 10 Tf [(two)-400(words)-20(!)] TJ ET", "two words!"),
        "moved": (b"BT /F 10 Tf (a) Tj 30 0 Td (b) Tj ET", "a b"),
        "near": (b"BT /F 10 Tf (a) Tj 5 0 Td (b) Tj ET", "ab"),
        "quotes": (b"BT /F 10 Tf 12 TL (a) Tj (b) ' 1 2 (c) \" ET", "a\nb\nc"),
        "leading": (b"BT /F 10 Tf (a) Tj 0 -12 TD (b) Tj T* (c) Tj ET", "a\nb\nc"),
        "state": (b"q 2 0 0 2 0 0 cm BT /F 10 Tf (a) Tj ET Q BT /F 10 Tf 0 -15 Td (b) Tj ET", "a\nb"),
        "inline": (b"BI /W 4 /H 1 /BPC 8 /CS /G ID a EI EI BT /F 10 Tf (after) Tj ET", "after"),
    }
    f = spark.createDataFrame([(k, bytearray(one_page(c))) for k, (c, _) in cases.items()], "file_id string, content binary")
    got: dict = {}
    for r in page_lines(Documents(f).elements).orderBy("file_id", "line_id").collect():
        got.setdefault(r["file_id"], []).append(r["line_text"])
    assert {k: "\n".join(v) for k, v in got.items()} == {k: t for k, (_, t) in cases.items()}


def test_images_part_the_text(spark):
    line = b"BT /F 10 Tf 1 0 0 1 0 %d Tm (%s) Tj ET "
    text = line % (0, b"a full line") + line % (-12, b"and one more") + b"q 5 0 0 5 0 -18 cm BI /W 1 /H 1 /CS /G /BPC 8 ID x EI Q " + line % (-24, b"below")
    both = spark.createDataFrame([("a", bytearray(one_page(text)))], "file_id string, content binary")
    assert [r["text"] for r in page_texts(Documents(both).elements).collect()] == ["a full line and one more\n\nbelow"]


def test_fonts_without_widths_or_maps(spark):
    plain = one_page(b"BT /F 10 Tf [(ab)-200(cd)-200(ef)-30(g)] TJ ET", b"<</Type/Font/Subtype/Type1/BaseFont/Times-Bold>>")
    composite = one_page(b"BT /F 10 Tf (ab) Tj ET", b"<</Type/Font/Subtype/Type0/BaseFont/X/Encoding/UniJIS-H/DescendantFonts[<</DW 700>>]>>")
    d = Documents(spark.createDataFrame([("plain", bytearray(plain)), ("cid", bytearray(composite))], "file_id string, content binary"))
    assert {r["file_id"]: r["line_text"] for r in page_lines(d.elements).collect()} == {"plain": "ab cd efg", "cid": "□"}
    fonts = {r["file_id"]: (r["missing"], r["space_width"], r["error"]) for r in d.fonts.collect()}
    assert fonts == {"plain": (None, None, None), "cid": (700.0, 700.0, "unsupported encoding /UniJIS-H")}
    assert {r["metric"] for r in d.elements.where("file_id = 'plain'").collect()} == {False}


def test_broken_stream_is_an_error_row(spark):
    bad = one_page(b"BT /F 10 Tf (x) Tj ET").replace(b"<</Length 21>>", b"<</Length 21/Filter/ASCII85Decode>>")
    d = Documents(spark.createDataFrame([("a", bytearray(bad))], "file_id string, content binary"))
    assert [(r["code"], r["message"]) for r in d.errors.collect()] == [("stream", "object 4")] and page_lines(d.elements).count() == 0


def test_deep_trees_and_cycles(spark):
    chain = [("t", i, 0, i + 1, None) for i in range(12)] + [("t", 12, 0, 3, None), ("t", 12, 1, 99, "own")]
    edges = spark.createDataFrame(chain, "tree string, parent int, ordinal int, child int, own string")
    roots = spark.createDataFrame([("t", 0, "top")], "tree string, node int, carried string")
    got = graph.leaves(graph.walk(roots, edges), edges).collect()
    assert [(r["node"], r["page_index"], r["carried"], len(r["path"])) for r in got] == [(99, 0, "own", 13)]


def test_images(spark):
    from leafmill.testing.pdfwriter import write_images

    got = Documents(spark.createDataFrame([("a", bytearray(write_images(b"ab EI cd")))], "file_id string, content binary")).images.orderBy("obj_seq").collect()
    assert [(r["obj"], r["width"], r["height"], r["components"], bytes(r["data"])) for r in got] == [(None, 8, 1, 1, b"ab EI cd"), (5, 8, 1, 4, b"ab EI cd")]


def test_tables_with_gaps_and_other_lines(spark):
    from leafmill.operators import tables

    lines = [["only text here"], ["a", "b", "c"], ["d", None, "f"], ["more text"], ["g", "h"], ["i", "j"]]
    rows = [(1, n, k, n, 100.0 * k, 10.0, t, 5.0, n * 10 + k) for n, cells in enumerate(lines) for k, t in enumerate(cells) if t]
    e = spark.createDataFrame(rows, "doc_id int, line_id int, k int, n int, tx double, width double, text string, space_width double, seq int").drop("k", "n")
    got = {r["table_id"]: r["rows"] for r in tables.table_rows(tables.divide_columns(e, ["doc_id"]), ["doc_id"]).collect()}
    assert got[1] == [["g", "h"], ["i", "j"]] and got[0][0] == ["a", "b", "c"] and len(got) == 2


def test_broken_input_is_data(spark):
    d = Documents(spark.createDataFrame([("null", None), ("empty", bytearray())], "file_id string, content binary"))
    assert sorted((r["file_id"], r["code"]) for r in d.errors.collect()) == [("empty", "open"), ("null", "open")]
    assert page_lines(d.elements).count() == 0
    assert Documents(d.opened.sparkSession.createDataFrame([], "file_id string, content binary")).pages.count() == 0


def test_hyphens_and_lists(spark):
    rows = [(1, 0, 0, "a long line that ends in hy-", 0.0, 100.0, "hy-"), (1, 0, 1, "phen", 0.0, 20.0, "phen"), (1, 0, 2, "next", 0.0, 20.0, "next"), (1, 1, 3, "one.", 0.0, 100.0, "one."), (1, 1, 4, "two.", 0.0, 100.0, "two.")]
    lines = spark.createDataFrame(rows, "doc_id int, group_id int, line_id int, line_text string, line_x double, line_width double, last_text string")
    for by_chars in (False, True):
        got = [r["text"] for r in layout.paragraphs(lines, ["doc_id"], by_chars).orderBy("group_id", "paragraph").collect()]
        assert got == ["a long line that ends in hyphen", "next", "one.", "two."]


def test_paragraph_modes_against_a_loop(spark):
    import random

    random.seed(4)
    rows, want = [], {}
    for doc in range(30):
        texts = ["x" * random.randint(1, 12) + random.choice(["", "-", "."]) for _ in range(random.randint(1, 9))]
        rows += [(doc, 0, i, t, 0.0, float(len(t)), t) for i, t in enumerate(texts)]
        widest, is_list = max(map(len, texts)), all(t.endswith(".") for t in texts)
        out, last, hyphen = [], 0, False
        for i, t in enumerate(texts):
            joins = i > 0 and not is_list and last >= 0.8 * widest
            last = len(t) + (1 if joins and not hyphen else 0)
            if joins:
                out[-1] = out[-1][:-1] + t if hyphen else out[-1] + " " + t
            else:
                out.append(t)
            hyphen = t.endswith("-")
        want[doc] = out
    lines = spark.createDataFrame(rows, "doc_id int, group_id int, line_id int, line_text string, line_x double, line_width double, last_text string")
    got: dict = {}
    for r in layout.paragraphs(lines, ["doc_id"], True).orderBy("doc_id", "paragraph").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == want


@pytest.mark.parametrize("name", sorted(k for k in q.ORACLES if k not in SLOW))
def test_query(spark, same, name):
    same(q.QUERIES[name](spark, SF), q.ORACLES[name])


def test_stream_of_files(spark, tmp_path):
    from leafmill.streaming.pdf_stream import each_batch, stream_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(write_pdf([["one", "two"]]))
    found: list = []
    s = stream_files(spark, str(tmp_path / "in")).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c"))
    s.foreachBatch(each_batch(lambda d, n: found.extend(r["line_text"] for r in page_lines(d.elements).orderBy("line_id").collect()))).start().awaitTermination()
    assert found == ["one", "two"]


def test_page_texts_by_characters(spark, same, tmp_path):
    """Gaps between words are a space wide, so a line that fills 0.8 of the page by characters joins the next, whatever its words."""
    import pandas as pd

    d = pd.DataFrame({"doc_id": [0, 1, 2], "text": ["b" * 80 + "\nnext\n" + "a " * 49 + "aa" + "\n" * 3 + "on page two", "a " * 39 + "aa\nnext\n" + "b" * 100 + "\n\n\n\n", "a b\ncc dd ee ff g\n" + "hh ii " * 3 + "\n-\n"]})
    d["text"] = d["text"].str.replace(" \n", "\n")
    d.to_parquet(tmp_path / "documents.parquet")
    same(q.QUERIES["pdf_page_texts"](spark, str(tmp_path)), q.ORACLES["pdf_page_texts"], {"documents": d})
