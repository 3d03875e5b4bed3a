"""Writes small PDF files for tests and round trips: the same pages in several file layouts, fonts and styles."""

from __future__ import annotations

import zlib
from hashlib import md5

from ..functions.codecs import rc4
from ..sources.pdf_bytes import _PAD

CMAP = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end"
#: Characters that the simple font has at codes of its own, by the names of their glyphs.
DIFFERENCES = {"é": "eacute", "ä": "adieresis", "ö": "odieresis", "ü": "uni00FC", "ß": "germandbls", "ñ": "ntilde.alt"}


def _cid(text: str) -> bytes:
    return text.encode("utf-16-be")


_OWN = {ord(c): i for i, c in enumerate(DIFFERENCES, 1)}


def _simple(text: str) -> bytes:
    return text.translate(_OWN).encode("cp1252", "replace")


def _symbol(text: str) -> bytes:
    return bytes(ord(c) if " " <= c <= "~" else 0x20 for c in text)


def page_content(lines: list[str], size: int = 10, leading: int = 12, font: str = "cid", style: str = "plain") -> bytes:
    """One text object per line, from top to bottom; blank lines draw nothing.

    style kerned: words are set apart by kerning, and break into pieces and operators that follow each other; columns: the
    first line is a heading, the others stand in two text objects side by side; cells: words of a line in columns, "-" leaves
    its cell blank.
    """
    coded = {"simple": _simple, "symbol": _symbol}.get(font, _cid)
    hexed = lambda t: f"<{coded(t).hex()}>"

    def halves(word: str) -> str:
        k = len(word) // 2
        return f"{hexed(word[:k])} 20 {hexed(word[k:])}" if k else hexed(word)

    parts = []
    if style == "columns":
        lines = [x for x in lines if x.strip()]
        right = 100 + max((len(x) * size for x in lines), default=0)
        half = max(3, (len(lines) + 2) // 2)
        for x, y, some in ((50, 0, lines[:1]), (50, -30, lines[1:half]), (right, -30, lines[half:])):
            shown = f" 0 {-leading} Td ".join(f"{hexed(line)} Tj" for line in some)
            parts.append(f"BT /F1 {size} Tf 1 0 0 1 {x} {y} Tm {shown} ET\n" if some else "")
        return "".join(parts).encode()
    if style == "cells":  # words of a line in columns; the word "-" leaves its cell blank
        wide = 60 + max((len(w) * size for x in lines for w in x.split()), default=0)
        for i, line in enumerate(lines):
            parts += [f"BT /F1 {size} Tf 1 0 0 1 {50 + wide * k} {-leading * i} Tm {hexed(w)} Tj ET\n" for k, w in enumerate(line.split()) if w != "-"]
        return "".join(parts).encode()
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        show = f"{hexed(line)} Tj"
        if style == "kerned":
            words = line.split()
            # a gap is a space wide, and takes back the kerning within the word after it, so widths go by characters
            gaps = [f"{-520 if len(w) > 1 else -500} {halves(w)}" for w in words[1:-1]]
            k, last = len(words) // 2, len(words[-1]) // 2
            show = f"[{' '.join([hexed(words[0]), *gaps[: k - 1]])}] TJ " + (f"[{' '.join(gaps[k - 1 :])}] TJ " if gaps[k - 1 :] else "") if len(words) > 1 else ""
            show += f"[{'-500 ' if len(words) > 1 else ''}{hexed(words[-1][:last] or words[-1])}] TJ" + (f" {hexed(words[-1][last:])} Tj" if last else "")
        parts.append(f"BT /F1 {size} Tf 1 0 0 1 50 {-leading * i} Tm {show} ET\n")
    return "".join(parts).encode()


def write_pdf(
    pages: list[list[str]], layout: str = "table", titles: list[str] | None = None, password: bytes | None = None, font: str = "cid", style: str = "plain", outline: list[tuple[str, int, list[str]]] | None = None
) -> bytes:
    """layout: table (classic cross-references), stream (with object streams), broken (offsets wrong); with a second section:
    update (a new page tree), replaced (new content streams), freed (a page is taken away).  Odd ones: indirect (length,
    filter and parameters of content streams by reference, and every second stream plain, with the keyword that ends one
    in it), untyped (a nested page tree whose nodes have no type), one (a table that starts at 1 instead of 0).  Faulty
    ones, by page: nocontents (none), lost (it names a missing object), operand (a wrong one before the text).

    font symbol: text is in the codes of the Symbol font.

    titles: outline items, of the pages in turn; outline: (title, page, titles below it) instead.
    """

    def ref(n: int) -> str:
        return f"{n} 0 R"

    first_id, key = b"0123456789abcdef", None
    trailer = f"/Root 1 0 R/ID[<{first_id.hex()}><{first_id.hex()}>]"
    if password is not None:
        okey = md5((password + _PAD)[:32]).digest()[:5]
        o = rc4(okey, (password + _PAD)[:32])
        key = md5((password + _PAD)[:32] + o + (0xFFFFFFFC).to_bytes(4, "little") + first_id).digest()[:5]
        trailer += f"/Encrypt<</Filter/Standard/V 1/R 2/O<{o.hex()}>/U<{rc4(key, _PAD).hex()}>/P -4>>"

    def secret(n: int, data: bytes) -> bytes:
        return data if key is None else rc4(md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[:10], data)

    if outline is None:
        outline = [(t, i % len(pages), []) for i, t in enumerate(titles or [])]
    kids = [10 + 3 * i for i in range(len(pages))]
    gone = [8] if layout == "freed" else []
    objects: dict[int, bytes] = {
        1: f"<</Type/Catalog/Pages 2 0 R{'/Outlines 6 0 R' if outline else ''}>>".encode(),
        2: f"<</Type/Pages/Count {len(pages)}/Kids[{' '.join(map(ref, kids + gone))}]/Resources<</Font<</F1 3 0 R>>>>>>".encode(),
    }
    streams: dict[int, bytes] = {4: CMAP}
    if font == "simple":
        names = " ".join(f"/{g}" for g in DIFFERENCES.values())
        objects[3] = f"<</Type/Font/Subtype/TrueType/BaseFont/Georgia/FirstChar 0/LastChar 255/Widths[{' '.join(['500'] * 256)}]/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[1 {names}]>>>>".encode()
    else:
        objects[3] = b"<</Type/Font/Subtype/Type0/BaseFont/Helvetica/Encoding/Identity-H/ToUnicode 4 0 R/DescendantFonts[5 0 R]>>"
        objects[5] = b"<</Type/Font/Subtype/CIDFontType2/BaseFont/Helvetica/DW 500/W[1 [500 500] 32 64 500]>>"
    if font == "symbol":
        objects[3] = f"<</Type/Font/Subtype/Type1/BaseFont/ABCDEF+Symbol/FirstChar 0/LastChar 255/Widths[{' '.join(['500'] * 256)}]/FontDescriptor 5 0 R>>".encode()
        objects[5] = b"<</Type/FontDescriptor/FontName/ABCDEF+Symbol/Flags 4>>"
    kind = "" if layout == "untyped" else "/Type/Page"
    for n, lines in zip(kids, pages, strict=True):
        content = {"nocontents": "", "lost": "/Contents 99999 0 R"}.get(layout, f"/Contents {n + 1} 0 R")
        objects[n] = f"<<{kind}/Parent 2 0 R{content}>>".encode()
        streams[n + 1] = (b"/F1 (x) Tf /a /b Td\n" if layout == "operand" else b"") + page_content(lines, font=font, style=style)
    if layout == "untyped":
        nodes = [30_000 + i for i in range(len(kids))]  # one above each page, and one above them
        objects |= {n: f"<</Count 1/Kids[{k} 0 R]>>".encode() for n, k in zip(nodes, kids, strict=True)}
        objects[29_999] = f"<</Kids[{' '.join(map(ref, nodes))}]>>".encode()
        objects[2] = f"<</Count {len(pages)}/Kids[29999 0 R]/Resources<</Font<</F1 3 0 R>>>>>>".encode()
    if gone:
        objects[8], streams[9] = b"<</Type/Page/Parent 2 0 R/Contents 9 0 R>>", page_content(["GONE"])

    def item(n: int, title: str, parent: int, page: int, more: str) -> None:
        text = secret(n, ("﻿" + title).encode("utf-16-be")).hex()
        objects[n] = f"<</Title<{text}>/Parent {parent} 0 R/Dest[{kids[page]} 0 R/Fit]{more}>>".encode()

    for i, (title, page, below) in enumerate(outline):
        n, child = 10_000 + 100 * i, [10_000 + 100 * i + k for k in range(1, len(below) + 1)]
        after = f"/Next {n + 100} 0 R" if i + 1 < len(outline) else ""
        item(n, title, 6, page, after + (f"/First {child[0]} 0 R/Last {child[-1]} 0 R" if child else ""))
        for k, (m, t) in enumerate(zip(child, below, strict=True)):
            item(m, t, n, page, f"/Next {m + 1} 0 R" if k + 1 < len(child) else "")
    if outline:
        objects[6] = f"<</Type/Outlines/First 10000 0 R/Last {10_000 + 100 * (len(outline) - 1)} 0 R>>".encode()
        objects[7] = b"<</Title(title of the document)/Producer(x)>>"
        trailer += "/Info 7 0 R"
    out, at = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(n: int, body: bytes) -> None:
        at[n] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (n, body))

    def stream(n: int, data: bytes, more: bytes = b"") -> bytes:
        data = zlib.compress(data)
        if more != b"/Type/XRef":
            data = secret(n, data)
        return b"<</Filter/FlateDecode/Length %d%s>>\nstream\n%s\nendstream" % (len(data), more, data)

    if layout == "indirect":
        objects |= {30_000: b"/FlateDecode", 30_001: b"<</Predictor 1>>"}
    for n, data in streams.items():
        if layout == "indirect" and n != 4:
            plain = n % 2 == 0
            data = b"% endstream endobj 1 0 obj\n" + data if plain else zlib.compress(data)
            objects[40_000 + n] = b"%d" % len(data)
            put(n, b"<</Length %d 0 R%s>>\nstream\n%s\nendstream" % (40_000 + n, b"" if plain else b"/Filter 30000 0 R/DecodeParms 30001 0 R", data))
            continue
        put(n, stream(n, page_content(["OLD"]) if layout == "replaced" and n != 4 else data))
    if layout == "stream":
        body, head = b"", []
        for n, v in objects.items():
            head += [n, len(body)]
            body += v + b" "
        start = " ".join(map(str, head)).encode() + b" "
        put(20_000, stream(20_000, start + body, b"/Type/ObjStm/N %d/First %d" % (len(objects), len(start))))
        rows = [(n, 1, p, 0) for n, p in at.items()] + [(n, 2, 20_000, i) for i, n in enumerate(objects)]
        start_at = len(out)
        rows.append((20_001, 1, start_at, 0))
        rows.sort()
        data = b"".join(bytes([k]) + x.to_bytes(4, "big") + y.to_bytes(2, "big") for _, k, x, y in rows)
        index = " ".join(f"{n} 1" for n, *_ in rows)
        put(20_001, stream(20_001, data, b"/Type/XRef").replace(b"/Type/XRef", b"/Type/XRef/W[1 4 2]/Size 20002/Index[%s]%s" % (index.encode(), trailer.encode())))
        return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start_at
    old = {2: b"<</Type/Pages/Count 0/Kids[]>>"} if layout == "update" else {}
    for n, v in (objects | old).items():
        put(n, v)

    def section(numbers: list[int], more: str, free: list[int] = ()) -> None:
        start_at = len(out)
        if layout == "one":
            out.extend(f"xref\n1 {max(numbers) + 1}\n0000000000 65535 f \n".encode())
            out.extend("".join(f"{at.get(n, 0):010d} 00000 {'n' if n in at else 'f'} \n" for n in range(1, max(numbers) + 1)).encode())
            numbers = []
        else:
            out.extend(b"xref\n0 1\n0000000000 65535 f \n")
        for n in free:
            out.extend(f"{n} 1\n0000000000 00001 f \n".encode())
        for n in numbers:
            shift = 7 if layout == "broken" else 0
            out.extend(f"{n} 1\n{at[n] + shift:010d} 00000 n \n".encode())
        out.extend(f"trailer\n<</Size {max(at) + 1}{trailer}{more}>>\nstartxref\n{start_at}\n%%EOF\n".encode())

    first = len(out)
    section(sorted(at), "")
    if layout == "replaced":
        for n in kids:
            put(n + 1, stream(n + 1, streams[n + 1]))
        section([n + 1 for n in kids], f"/Prev {first}")
    elif gone:
        section([], f"/Prev {first}", [8, 9])
    elif old:
        put(2, objects[2])
        section([2], f"/Prev {first}")
    return bytes(out)


def write_images(data: bytes) -> bytes:
    """One page that draws the bytes as an inline image and as an external object, and a form and a missing object."""
    content = b"q 10 0 0 10 5 5 cm BI /W %d /H 1 /BPC 8 /CS /G ID %s EI Q /I1 Do /F9 Do /None Do" % (len(data), data)
    bodies = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 1/Kids[3 0 R]/Resources 6 0 R>>", 3: b"<</Type/Page/Parent 2 0 R/Contents[4 0 R null]>>",
        4: b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content),
        5: b"<</Subtype/Image/Width %d/Height 1/ColorSpace[/ICCBased 8 0 R]/Length %d>>\nstream\n%s\nendstream" % (len(data), len(data), data),
        6: b"<</XObject 7 0 R>>", 7: b"<</I1 5 0 R/F9 9 0 R>>", 8: b"<</N 4/Length 0>>\nstream\n\nendstream", 9: b"<</Subtype/Form/Length 0>>\nstream\n\nendstream",
    }
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in bodies.items()) + b"trailer\n<</Root 1 0 R>>\n"
