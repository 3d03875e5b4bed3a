"""Damaged and odd files, errors of every stage, tables and columns of text, symbolic fonts, counters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafmill.operators import fonts, graph, tables
from leafmill.plans.contents import page_lines, page_parts, page_texts
from leafmill.sources import pdf_bytes
from leafmill.sources.pdf import Documents, PdfError
from leafmill.testing.pdfwriter import write_pdf

PAGES = [["one (1)", "two"], ["three"]]


def files(spark, **content: bytes):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "file_id string, content binary")


def plain(bodies: dict[int, bytes], table: list[bytes] | None = None, root: int = 1) -> bytes:
    """A file of these objects; ``table``: its cross-reference section, with {n} for the position of object n."""
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for n, body in bodies.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    for row in table or []:
        out += row.format(*[f"{at.get(i, 0):010d}" for i in range(max(at) + 1)]).encode() if isinstance(row, str) else row
    return bytes(out) + b"trailer\n<</Size %d/Root %d 0 R>>\n" % (max(at) + 1, root) + (b"startxref\n%d\n" % start if table else b"")


def stream(data: bytes, more: bytes = b"") -> bytes:
    return b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(data), more, data)


TEXT = b"BT /F1 10 Tf 1 0 0 1 50 0 Tm (hi) Tj ET\n"
TREE = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 1/Kids[3 0 R]>>", 3: b"<</Type/Page/Contents 4 0 R>>", 4: stream(TEXT)}


def lines(d: Documents) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in page_lines(d.elements).orderBy("file_id", "page_index", "line_id").collect():
        out.setdefault(r["file_id"], []).append(r["line_text"])
    return out


def test_odd_files(spark):
    made = {layout: write_pdf(PAGES, layout=layout) for layout in ("indirect", "untyped", "one")}
    made["wrongly_free"] = plain(TREE, ["xref\n0 5\n0000000000 65535 f \n{1} 00000 n \n{2} 00000 n \n0000000000 00000 f \n{4} 00000 n \n"])
    made["from_one"] = plain(TREE, ["xref\n1 5\n0000000000 65535 f \n{1} 00000 n \n{2} 00000 n \n{3} 00000 n \n{4} 00000 n \n"])
    d = Documents(files(spark, **made))
    assert lines(d) == {k: ["one (1)", "two", "three"] if k in ("indirect", "untyped", "one") else ["hi"] for k in made}
    assert d.errors.collect() == []


def test_stream_lengths():
    body = b"a endstream endobj 9 0 obj b"
    b = b"1 0 obj <</Length 2 0 R>> stream\n%s\nendstream endobj 2 0 obj %d endobj" % (body, len(body))
    (n, _, _, _, at, size), (m, *_) = pdf_bytes.objects(b)
    assert (n, m, b[at : at + size]) == (1, 2, body)
    wrong = b.replace(b"obj %d endobj" % len(body), b"obj 3 endobj")  # a length that leads nowhere is none
    assert [x[0] for x in pdf_bytes.objects(wrong)] == [1, 9, 2]


ERRORS = {
    "fine": (TREE, []),
    "no_pages_key": (TREE | {1: b"<</Type/Catalog>>"}, [("tree", "no page tree")]),
    "no_catalog": ({k: v for k, v in TREE.items() if k != 1}, [("tree", "no catalog")]),
    "no_kids": (TREE | {2: b"<</Type/Pages/Count 0/Kids[]>>"}, [("tree", "no pages")]),
    "lost_kid": (TREE | {2: b"<</Type/Pages/Count 2/Kids[3 0 R 8 0 R]>>"}, [("tree", "object 8 is missing")]),
    "no_contents": (TREE | {3: b"<</Type/Page>>"}, [("contents", "page 0: none")]),
    "lost_contents": (TREE | {3: b"<</Type/Page/Contents 9 0 R>>"}, [("contents", "page 0: object 9 is missing")]),
    "empty_array": (TREE | {3: b"<</Type/Page/Contents[null]>>"}, [("contents", "page 0: none")]),
    "broken": (TREE | {4: stream(b"no zlib", b"/Filter/FlateDecode")}, [("stream", "object 4")]),
    "operand": (TREE | {4: stream(b"/F (x) Tf /a /b Td\n" + TEXT)}, [("operator", "page 0: Td"), ("operator", "page 0: Tf")]),
    "objects": (TREE | {5: stream(b"x y z", b"/Type/ObjStm/N 1/First 4")}, [("objects", "object 5: ValueError")]),
}


def test_every_loss_is_an_error(spark):
    d = Documents(files(spark, **{k: plain(v) for k, (v, _) in ERRORS.items()}))
    got: dict[str, list] = {k: [] for k in ERRORS}
    for r in d.errors.collect():
        text = r["message"]
        got[r["file_id"]].append((r["code"], ": ".join(text.split(": ")[:2]) if r["code"] in ("operator", "objects") else text))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, (_, v) in ERRORS.items()}
    assert lines(d) == {k: ["hi"] for k in ("fine", "lost_kid", "operand", "objects")}  # what can be read is there
    counted = {(r["stage"], r["what"]): r["n"] for r in d.counters.collect()}
    assert counted["open", "files"] == len(ERRORS) and counted["open", "errors"] == 0
    assert counted["parse", "texts"] == 4 and counted["parse", "errors"] == 2 and counted["open", "streams"] == len(ERRORS) + 1


@pytest.mark.parametrize("name", ["lost_contents", "operand", "no_catalog"])
def test_failfast(spark, name):
    with pytest.raises(PdfError, match=ERRORS[name][1][0][0]):
        Documents(files(spark, x=plain(ERRORS[name][0])), mode="FAILFAST")
    Documents(files(spark, x=plain(TREE)), mode="FAILFAST")


def test_columns_of_tables(spark):
    cases = {
        1: ["a b c", "d - f", "x y z"], 2: ["a b c", "d e f", "- y z"], 3: ["a b", "c d", "- e", "- f", "g h"], 4: ["a b c", "d e f", "- - z"], 5: ["just text"],
        6: ["a b c", "- e f", "- h i", "j - l", "m n -"],
    }
    d = Documents(files(spark, **{str(k): write_pdf([v], style="cells") for k, v in cases.items()}))
    got = {int(r["file_id"]): r["rows"] for r in page_parts(d.elements).where("kind = 'table'").collect()}
    assert got == {k: [[w.replace("-", " ") for w in x.split()] for x in v] for k, v in cases.items() if k != 5}
    text = {r["file_id"]: r["text"] for r in page_texts(d.elements).collect()}
    assert text["1"] == "a || b || c\nd ||   || f\nx || y || z"


def test_boundaries(spark):
    rows = [([(3.0, 1.0), (3.5, 2.0), (9.0, 2.5), (9.0, 4.0), (10.0, 9.0)],), ([],)]
    d = spark.createDataFrame(rows, "g array<struct<r:double,l:double>>")
    assert [r[0] for r in d.select(tables.boundaries(F.col("g"))).collect()] == [[3.0, 9.0, 10.0], []]


def test_columns_of_text(spark):
    page = ["heading", *[f"left {i}" for i in range(5)], *[f"right {i}" for i in range(5)]]
    d = Documents(files(spark, two=write_pdf([page], style="columns"), one=write_pdf([page])))
    assert lines(d) == {"two": page, "one": page}
    got = {r["file_id"]: r["text"] for r in page_texts(d.elements).collect()}
    assert got["two"].split() == " ".join(page).split()
    assert got["two"].split("\n\n") == ["heading", " ".join(page[1:6]), " ".join(page[6:])]


def test_symbolic_fonts(spark):
    def of(name: bytes, more: bytes = b"", text: bytes = b"abc") -> bytes:
        font = b"<</Type/Font/Subtype/Type1/BaseFont/%s%s>>" % (name, more)
        return plain(TREE | {3: b"<</Type/Page/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", 4: stream(TEXT.replace(b"hi", text)), 5: font, 6: b"<</Flags 4>>", 7: b"<</Flags 32>>"})

    cases = {
        "symbol": (of(b"Symbol"), "αβχ"), "flagged": (of(b"ABCDEF+SymbolMT", b"/FontDescriptor 6 0 R"), "αβχ"), "unflagged": (of(b"SymbolMT", b"/FontDescriptor 7 0 R"), "abc"),
        "dingbats": (of(b"ZapfDingbats"), "❁❂❃"), "named": (of(b"Symbol", b"/Encoding/WinAnsiEncoding"), "abc"), "changed": (of(b"Symbol", b"/Encoding<</Differences[98/Euro]>>"), "α€χ"),
        "expert": (of(b"Minion", b"/Encoding/MacExpertEncoding", b"a1W"), "ﬂ".replace("ﬂ", "ﬁ")), "other": (of(b"Times"), "abc"),
    }
    got = lines(Documents(files(spark, **{k: v for k, (v, _) in cases.items()})))
    assert got == {k: [v] for k, (_, v) in cases.items()}


def test_own_font_rules(spark):
    d = spark.createDataFrame([("Foo-Bold",), ("HelveticaNeue",), (None,)], "n string")
    rules = (fonts.Rule(("foo",), "FOO", True), *fonts.RULES)
    name = fonts.font_name(F.col("n"), rules)
    got = [tuple(r) for r in d.select(name, fonts.typeface(name, fonts.FALLBACKS | {"FOO": "GEORGIA", "HELVETICA": "BAR", "BAR": "HELVETICA"})).collect()]
    assert got == [("FOO_BOLD", "serif-bold"), ("HELVETICA", "sans-serif"), (None, None)]


def test_saved_tables_are_read_by_bucket(spark):
    d = Documents(files(spark, **{f"f{i}": write_pdf(PAGES) for i in range(6)}))
    d.save_tables(4, "saved_", ("pages", "elements", "errors"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    one = spark.table("saved_elements").where("file_id = 'f3' and page_index = 1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 4" in plan and "EqualTo(page_index,1)" in plan
    assert [r["text"] for r in one.collect()] == ["three"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    both = spark.table("saved_elements").join(spark.table("saved_pages").select("file_id", "resources"), "file_id")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 6 * 3 * 2
    for k in ("sources.bucketing.autoBucketedScan.enabled", "maxMetadataStringLength", "autoBroadcastJoinThreshold"):
        spark.conf.unset(f"spark.sql.{k}")
    for name in ("pages", "elements", "errors"):
        spark.sql(f"drop table saved_{name}")


def test_walks_end_at_a_depth(spark):
    edges = spark.createDataFrame([(t, i, 0, i + 1, None) for t, n in ((1, 3), (2, 9)) for i in range(n)], "tree int, parent int, ordinal int, child int, own string")
    roots = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "tree int, node int, carried string")
    walked = graph.walk(roots, edges, depth=5)
    assert {r["tree"]: r["n"] for r in walked.groupBy("tree").agg(F.max("node").alias("n")).collect()} == {1: 3, 2: 5}
    assert [r["tree"] for r in graph.too_deep(walked, edges, 5).collect()] == [2]


def test_kept_tables_are_not_broadcast(spark):
    """What files have in common takes next to no bytes in a table, so its size is no reason to send it to all tasks."""
    d = Documents(files(spark, **{f"f{i}": write_pdf(PAGES) for i in range(4)}))
    plan = d.content_refs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_text_of_a_code_is_found_once(monkeypatch):
    """Characters of a string are looked up by code, not one by one."""
    from leafmill.sources import pdf, pdf_bytes
    from leafmill.testing.pdfwriter import CMAP

    asked, find = [], pdf_bytes.CodeMap.find
    monkeypatch.setattr(pdf_bytes.CodeMap, "find", lambda self, width, code: asked.append(code) or find(self, width, code))
    pdf._code_map.cache_clear()
    got = pdf.pieces([{"s": "\0a\0b" * 5000 + "\0"}], {"cmap": CMAP, "widths": {97: 1.5}, "missing": 0.5})
    assert got == [{"s": "ab" * 5000 + "□", "adj": None, "w": 10_000.5}] and len(asked) == 2
