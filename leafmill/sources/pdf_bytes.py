"""Helpers that touch the bytes of a PDF file; everything relational is done by Spark.

Values become JSON: names keep their slash, strings are {"s": latin-1 text}, references {"r": [number, generation]}.
"""

from __future__ import annotations

import re
from binascii import unhexlify
from collections.abc import Callable
from functools import cache
from hashlib import md5
from math import hypot
from struct import unpack
from typing import Any

from ..functions.codecs import apply_chain, rc4

WHITE, DELIMITERS = b" \t\r\n\f\0", b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^ \t\r\n\f\0()<>\[\]{}/%]+")
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_INTEGER = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\s+(\d+)\s+endobj")
_SECTION = re.compile(rb"(?<!start)xref\b")
_REFERENCE = re.compile(rb"(\d+)\s+(\d+)\s+R(?![A-Za-z])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_PLAIN = rb"(?![^ \t\r\n\f\0()<>\[\]{}/%])"
#: What content streams mostly hold: a number, an operator, a string in hexadecimal digits, a name; all else is read by ``value``.
_TOKEN = re.compile(rb"[ \t\r\n\f\0]*(?:([+-]?(?:\d+\.?\d*|\.\d+))" + _PLAIN + rb"|([A-Za-z'\"][A-Za-z0-9*]*)" + _PLAIN + rb"|<((?:[0-9A-Fa-f]{2})*)>|/([^ \t\r\n\f\0()<>\[\]{}/%#]+)" + _PLAIN + rb")")
_ITEM = rb"<((?:[0-9A-Fa-f]{2})*)>|([+-]?(?:\d+\.?\d*|\.\d+))" + _PLAIN
#: An array of such strings and numbers.
_ARRAY = re.compile(rb"\[((?>[ \t\r\n\f\0]*(?:" + _ITEM.replace(rb"<((?", rb"<(?:(?").replace(rb"|([+-]", rb"|(?:[+-]") + rb"))*+)[ \t\r\n\f\0]*\]")
_ITEMS = re.compile(_ITEM)
_KEYWORD = re.compile(rb"endobj|stream")
_BODIES: dict[bytes, tuple[Any, int]] = {}
_ROWS, _ENTRY = re.compile(rb"\s*(\d+)\s+(\d+)\s*[\r\n]+"), re.compile(rb"\s*(\d{10})\s(\d{5})\s([nf])")
_WORDS = {b"true": True, b"false": False, b"null": None}
_ESCAPES = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}


def skip(b: bytes, i: int) -> int:
    while i < len(b):
        if b[i] in WHITE:
            i += 1
        elif b[i] == 37:  # a comment
            while i < len(b) and b[i] not in b"\r\n":
                i += 1
        else:
            break
    return i


def _string(b: bytes, i: int) -> tuple[Any, int]:
    out, depth = bytearray(), 1
    while i < len(b):
        c = b[i]
        if c == 92 and i + 1 < len(b):
            if m := re.compile(rb"[0-7]{1,3}").match(b, i + 1):
                out.append(int(m[0], 8) & 255)
                i = m.end()
                continue
            if b[i + 1] not in b"\r\n":
                out.append(_ESCAPES.get(b[i + 1], b[i + 1]))
            i += 3 if b[i + 1 : i + 3] == b"\r\n" else 2
            continue
        depth += (c == 40) - (c == 41)
        i += 1
        if not depth:
            break
        out.append(c)
    return {"s": out.decode("latin-1")}, i


def value(b: bytes, i: int, references: bool = True) -> tuple[Any, int]:
    """The value at ``i`` and where it ends; an operator is {"o": name}; nothing more: {"o": ""}."""
    i = skip(b, i)
    c = b[i : i + 1]
    if not c:
        return {"o": ""}, i
    if c == b"/":
        m = _REGULAR.match(b, i + 1)
        name = m[0] if m else b""
        name = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), name)
        return "/" + name.decode("latin-1"), i + 1 + len(m[0] if m else b"")
    if c == b"(":
        return _string(b, i + 1)
    if b[i : i + 2] == b"<<":
        out: dict[str, Any] = {}
        i = skip(b, i + 2)
        while i < len(b) and b[i : i + 2] != b">>":
            key, i = value(b, i)
            item, i = value(b, i)
            if isinstance(key, str):
                out[key[1:]] = item
            i = skip(b, i)
        return out, i + 2
    if c == b"<":
        end = b.find(b">", i)
        end = len(b) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", b[i + 1 : end])
        return {"s": bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")}, end + 1
    if c == b"[":
        if m := _ARRAY.match(b, i):
            return [_number(n) if n else _hexed(x) for x, n in _ITEMS.findall(m[1])], m.end()
        items = []
        i = skip(b, i + 1)
        while i < len(b) and b[i] != 93:
            item, i = value(b, i, references)
            items.append(item)
            i = skip(b, i)
        return items, i + 1
    if references and (m := _REFERENCE.match(b, i)):
        return {"r": [int(m[1]), int(m[2])]}, m.end()
    m = _REGULAR.match(b, i)
    if not m:
        return {"o": c.decode("latin-1")}, i + 1
    word = m[0]
    if _NUMBER.match(word):
        return _number(word), m.end()
    return _WORDS.get(word, {"o": word.decode("latin-1")}), m.end()


def _number(word: bytes) -> float:
    x = float(word)
    return int(x) if x.is_integer() else x


def _hexed(digits: bytes) -> dict[str, str]:
    return {"s": unhexlify(digits).decode("latin-1")}


def _token(b: bytes, i: int) -> tuple[Any, int]:
    """What ``value`` gives in a content stream, the common tokens by one expression."""
    if m := _TOKEN.match(b, i):
        kind, word = m.lastindex, m[m.lastindex]
        if kind == 1:
            return _number(word), m.end()
        if kind == 2:
            return _WORDS.get(word, {"o": word.decode("latin-1")}), m.end()
        return (_hexed(word) if kind == 3 else "/" + word.decode("latin-1")), m.end()
    return value(b, i, references=False)


def integers(b: bytes) -> dict[int, int]:
    """Objects that are a whole number; the last of each number counts."""
    return {int(m[1]): int(m[2]) for m in _INTEGER.finditer(b)}


def _body(b: bytes, i: int) -> tuple[Any, int]:
    """The value of the object whose body begins at ``i``, and where it ends; short bodies that many files share are read once."""
    end = _KEYWORD.search(b, i, i + 4096)
    if not end:
        return value(b, i)
    text = b[i : end.start()]
    if (found := _BODIES.get(text)) is None:
        v, at = value(b, i)
        if at > end.start():  # the keyword stands within the value
            return v, at
        if len(_BODIES) >= 4096:
            _BODIES.clear()
        found = _BODIES[text] = v, at - i
    return found[0], i + found[1]


def object_at(b: bytes, m: re.Match, numbers: Callable[[], dict[int, int]]) -> tuple[int, int, int, Any, int | None, int | None, int]:
    """(number, generation, position, value, start and length of the stream, end) of the object that begins with ``m``; ``numbers``: what a stream's length may refer to."""
    v, i = _body(b, m.end())
    at, start, size = skip(b, i), None, None
    if isinstance(v, dict) and b[at : at + 6] == b"stream":
        start = at + 6
        start += 2 if b[start : start + 2] == b"\r\n" else 1
        n = v.get("Length")
        n = numbers().get(n["r"][0]) if isinstance(n, dict) and "r" in n else n
        if isinstance(n, int) and b[start + n : start + n + 20].lstrip().startswith(b"endstream"):
            end = start + n
        else:
            end = b.find(b"endstream", start)
            end = len(b) if end < 0 else end
        i, size = end, end - start
        if not isinstance(n, int):  # the length stands elsewhere: the line end before the keyword isn't data
            size -= len(re.search(rb"(?:\r?\n)?$", b[max(start, end - 2) : end])[0])
    return int(m[1]), int(m[2]), m.start(), v, start, size, max(i, m.end())


def objects(b: bytes) -> list[tuple[int, int, int, Any, int | None, int | None]]:
    """(number, generation, position, value, start and length of the stream) of every object in the file, from top to bottom."""
    out, i, numbers = [], 0, cache(lambda: integers(b))
    while m := _OBJECT.search(b, i):
        *found, i = object_at(b, m, numbers)
        out.append(tuple(found))
    return out


def with_parameters(value: Any, by_number: dict[int, Any]) -> Any:
    """A stream's dictionary with its filters and their parameters in place of references to them."""

    def at(x: Any) -> Any:
        if isinstance(x, dict) and "r" in x:
            return by_number.get(x["r"][0], x)
        return [at(y) for y in x] if isinstance(x, list) else x

    return value | {k: at(at(value[k])) for k in ("Filter", "DecodeParms") if k in value}


def stream_data(dictionary: dict, raw: bytes) -> bytes:
    names, params = filters_of(dictionary)
    return apply_chain(raw, names, params)


def filters_of(dictionary: dict) -> tuple[list[str], list[dict]]:
    names, params = dictionary.get("Filter", dictionary.get("F")), dictionary.get("DecodeParms", dictionary.get("DP"))
    names = [names] if isinstance(names, str) else names or []
    params = [params] if isinstance(params, dict) else params or []
    return [str(x)[1:] for x in names], [x if isinstance(x, dict) else {} for x in params]


def _table(b: bytes, i: int) -> tuple[list[tuple], dict, int]:
    rows = []
    while m := _ROWS.match(b, i):
        first, n, i = int(m[1]), int(m[2]), m.end()
        for k in range(n):
            e = _ENTRY.match(b, i)
            if not e:
                break
            if first == 1 and k == 0 and not rows and e[0].split() == [b"0000000000", b"65535", b"f"]:
                first = 0  # the head of the free entries is number 0, whatever the producer says
            rows.append((first + k, int(e[2]), int(e[1]), e[3] == b"n", None, None))
            i = e.end()
    i = skip(b, i)
    trailer = value(b, i + 7)[0] if b[i : i + 7] == b"trailer" else {}
    return rows, trailer if isinstance(trailer, dict) else {}, i


def _stream_rows(d: dict, raw: bytes) -> list[tuple]:
    w = [int(x) for x in d.get("W", [])]
    data, at, rows = stream_data(d, raw), 0, []
    index = d.get("Index") or [0, d.get("Size", 0)]
    for first, n in zip(index[::2], index[1::2], strict=False):
        for k in range(int(n)):
            field = []
            for size, default in zip(w, (1, 0, 0), strict=False):
                field.append(int.from_bytes(data[at : at + size], "big") if size else default)
                at += size
            kind, x, y = field
            rows.append((int(first) + k, 0 if kind == 2 else y, None if kind == 2 else x, kind in (1, 2), x if kind == 2 else None, y if kind == 2 else None))
    return rows


def sections(b: bytes) -> list[tuple[list[tuple], dict]]:
    """Cross-reference sections, the newest first: rows (obj, gen, pos, in_use, obj_stm, idx) and trailer.

    Where an offset leads to no section, one that starts within a thousand bytes after it is taken.
    """
    at = b.rfind(b"startxref")
    m = re.compile(rb"startxref\s+(\d+)").match(b, at) if at >= 0 else None
    todo, seen, out = [int(m[1])] if m else [], set(), []
    while todo:
        i = todo.pop(0)
        if i in seen or not 0 <= i < len(b):
            continue
        seen.add(i)
        i = skip(b, i)
        if b[i : i + 4].lower() != b"xref" and not _OBJECT.match(b, i) and (near := _SECTION.search(b, i, i + 1000)):
            i = near.start()
        if b[i : i + 4].lower() == b"xref":
            rows, trailer, _ = _table(b, i + 4)
        elif (m := _OBJECT.match(b, i)) and (found := object_at(b, m, dict)) and isinstance(found[3], dict) and found[4] is not None:
            rows, trailer = _stream_rows(found[3], b[found[4] : found[4] + found[5]]), found[3]
        else:
            continue
        out.append((rows, trailer))
        todo = [int(trailer[k]) for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)] + todo
    if not out:  # a trailer may stand without a section
        trailers = [value(b, m.end())[0] for m in re.finditer(rb"\btrailer\b", b)]
        out = [([], t) for t in reversed(trailers) if isinstance(t, dict) and "Root" in t][:1]
    return out


def members(dictionary: dict, data: bytes) -> list[tuple[int, int, Any]]:
    """(index, number, value) of the objects in an object stream."""
    first, n = int(dictionary.get("First", 0)), int(dictionary.get("N", 0))
    head = [int(x) for x in data[:first].split()][: 2 * n]
    return [(k, number, value(data, first + offset)[0]) for k, (number, offset) in enumerate(zip(head[::2], head[1::2], strict=False))]


_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def file_key(encrypt: dict, first_id: bytes, password: bytes) -> bytes | None:
    """The key of the standard handler (RC4, revisions 2 and 3), by owner or user password; None: neither fits.  Others are an error."""
    if encrypt.get("Filter") != "/Standard" or int(encrypt.get("V", 0)) not in (1, 2) or int(encrypt["R"]) not in (2, 3):
        raise ValueError(f"handler {encrypt.get('Filter')} V {encrypt.get('V')} R {encrypt.get('R')}")
    r, n = int(encrypt["R"]), int(encrypt.get("Length", 40)) // 8
    o, u = (encrypt[k]["s"].encode("latin-1") for k in ("O", "U"))
    n = 5 if r == 2 else n
    xor = lambda key, i: bytes(c ^ i for c in key)

    def of_user(user: bytes) -> bytes | None:
        key = md5((user + _PAD)[:32] + o + (int(encrypt["P"]) & 0xFFFFFFFF).to_bytes(4, "little") + first_id).digest()
        for _ in range(50 if r > 2 else 0):
            key = md5(key[:n]).digest()
        key = key[:n]
        if r == 2:
            return key if rc4(key, _PAD) == u else None
        check = md5(_PAD + first_id).digest()
        for i in range(20):
            check = rc4(xor(key, i), check)
        return key if check == u[:16] else None

    key = md5((password + _PAD)[:32]).digest()
    for _ in range(50 if r > 2 else 0):
        key = md5(key).digest()
    user = o
    for i in range(19, -1, -1) if r > 2 else (0,):
        user = rc4(xor(key[:n], i), user)
    return of_user(user) or of_user(password)


class CodeMap:
    """A font's character map: codes of one or more bytes to text."""

    def __init__(self, cmap: bytes) -> None:
        text, pair = cmap.decode("latin-1"), r"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>"
        parts = lambda name: re.findall(f"begin{name}(.*?)end{name}", text, re.S)
        self.space = [(bytes.fromhex(lo), bytes.fromhex(hi)) for part in parts("codespacerange") for lo, hi in re.findall(pair, part) if len(lo) % 2 == 0 and len(lo) == len(hi)]
        self.rows: list[tuple[int, int, int, str | list[str]]] = []
        for part in parts("bfrange"):
            for lo, hi, one, many in re.findall(pair + r"\s*(?:<([0-9A-Fa-f\s]*)>|\[(.*?)\])", part, re.S):
                self.rows.append((len(lo) // 2, int(lo, 16), int(hi, 16), re.findall(r"<([0-9A-Fa-f]+)>", many) if many else "".join(one.split())))
        #: (bytes, code) to text, or None; ranges are looked through once for a code
        self.known: dict[tuple[int, int], str | None] = {}
        for part in reversed(parts("bfchar")):
            self.known |= {(len(c) // 2, int(c, 16)): _units("".join(d.split())) for c, d in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]*)>", part)}
        #: code to text where all codes have as many bytes
        self.texts = _Texts(self)
        self.sizes = sorted({len(lo) for lo, _ in self.space} | {w for w, _ in self.known} | {r[0] for r in self.rows}) or [1]

    def find(self, width: int, code: int) -> str | None:
        if (width, code) not in self.known:
            r = next((x for x in self.rows if x[0] == width and x[1] <= code <= x[2]), None)
            dst = None
            if r:
                k = code - r[1]
                dst = (r[3][k] if k < len(r[3]) else None) if isinstance(r[3], list) else r[3][:-4] + f"{int(r[3][-4:], 16) + k & 0xFFFF:04X}"
            self.known[width, code] = None if dst is None else _units(dst)
        return self.known[width, code]

    def has(self, code: bytes) -> bool:
        """Whether every byte is in its range of a code space; without any, all are."""
        return not self.space or any(len(lo) == len(code) and all(x <= c <= y for x, c, y in zip(lo, code, hi, strict=True)) for lo, hi in self.space)

    def codes(self, data: bytes) -> list[tuple[int, str]]:
        """(code, text): of the shortest in the code space that has a text; else a white square, and one byte is passed over."""
        out, i, one = [], 0, self.sizes[-1] if len(self.sizes) == 1 else 1
        while i < len(data):
            for w in self.sizes:
                code = data[i : i + w]
                text = self.find(w, int.from_bytes(code, "big")) if len(code) == w and self.has(code) else None
                if text is not None:
                    out.append((int.from_bytes(code, "big"), text))
                    i += w
                    break
            else:
                out.append((int.from_bytes(data[i : i + one], "big"), "□"))
                i += one
        return out


    def read(self, data: bytes) -> tuple[list[int], str]:
        """The codes, and their text."""
        if len(self.sizes) > 1:
            found = self.codes(data)
            return [c for c, _ in found], "".join(t for _, t in found)
        w = self.sizes[0]
        n = len(data) // w
        codes = list(data) if w == 1 else list(unpack(f">{n}H", data[: 2 * n])) if w == 2 else [int.from_bytes(data[i : i + w], "big") for i in range(0, n * w, w)]
        text = "".join(map(self.texts.__getitem__, codes))
        if rest := data[n * w :]:
            return [*codes, int.from_bytes(rest, "big")], text + "□"
        return codes, text


class _Texts(dict):
    """Texts of the codes of a map whose codes have one size, found when first asked for."""

    def __init__(self, cmap: CodeMap) -> None:
        self.cmap = cmap

    def __missing__(self, code: int) -> str:
        w = self.cmap.sizes[0]
        text = self.cmap.find(w, code) if self.cmap.has(code.to_bytes(w, "big")) else None
        self[code] = text = "□" if text is None else text
        return text


def _units(digits: str) -> str:
    return bytes.fromhex(digits + "0" * (-len(digits) % 4)).decode("utf-16-be", "surrogatepass")


def inline_image(data: bytes, i: int) -> tuple[dict, bytes, int]:
    """Dictionary and bytes of the inline image after BI, and where it ends.

    Unfiltered data has the length that its dictionary says; other data goes up to EI with white space on both sides.
    """
    d: dict[str, Any] = {}
    while True:
        key, i = value(data, i, references=False)
        if not isinstance(key, str):
            break
        item, i = value(data, i, references=False)
        d[_LONG_KEYS.get(key[1:], key[1:])] = item
    i += 1  # one white space after ID
    if "Filter" not in d:
        mask, space = d.get("ImageMask") is True, d.get("ColorSpace")
        parts = 1 if mask or space not in ("/DeviceRGB", "/RGB", "/DeviceCMYK", "/CMYK") else 4 if "CMYK" in str(space) else 3
        row = (int(d.get("Width", 0)) * parts * (1 if mask else int(d.get("BitsPerComponent", 8))) + 7) // 8
        size = row * int(d.get("Height", 0))
        if m := re.compile(rb"\s*EI\b").match(data, i + size):
            return d, data[i : i + size], m.end()
    m = re.compile(rb"[\s\0]EI(?=[\s\0]|$)").search(data, i)
    return d, data[i : m.start() if m else len(data)], m.end() if m else len(data)


#: Abbreviations in inline images.
_LONG_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}


def content(data: bytes) -> list[tuple]:
    """Text elements, external objects and inline images of a content stream, in order.

    (kind, obj_seq, elem_seq, items, key, size, rgb, tx, ty, scale_x, scale_y, moved): items are strings (as {"s"}) and
    kerning numbers, or an inline image's dictionary and bytes; key names the font or external object.  Where moved
    is false, an element follows the one before it on the line.  An operator whose operands are wrong gives an "error"
    with a message for its items.
    """
    out, stack, args, i, obj, elem, moved = [], [], [], 0, -1, 0, True
    ident = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    ctm, tm, line, rgb, font, size, leading = ident, ident, ident, [-1.0] * 3, "", 0.0, 0.0
    times = lambda p, q: [p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3], p[4] * q[0] + p[5] * q[2] + q[4], p[4] * q[1] + p[5] * q[3] + q[5]]
    while True:
        v, i = _token(data, i)
        if not (isinstance(v, dict) and "o" in v):
            args.append(v)
            continue
        op = v["o"]
        if not op:
            return out
        try:
            if op == "q":
                stack.append((ctm, rgb, font, size))
            elif op == "Q":
                ctm, rgb, font, size = stack.pop() if stack else (ident, [-1.0] * 3, font, size)
            elif op == "cm" and len(args) >= 6:
                ctm = times([float(x) for x in args[-6:]], ctm)
            elif op == "rg" and len(args) >= 3:
                rgb = [float(x) for x in args[-3:]]
            elif op == "k" and len(args) >= 4:
                rgb = [(1 - x) * (1 - args[-1]) for x in args[-4:-1]]
            elif op == "g" and args:
                rgb = [float(args[-1])] * 3
            elif op == "BT":
                tm, line, obj, elem, moved = ident, ident, obj + 1, 0, True
            elif op == "Tf" and len(args) >= 2:
                size, font = float(args[-1]), args[-2][1:]
            elif op == "TL" and args:
                leading = float(args[-1])
            elif op in ("Td", "TD") and len(args) >= 2:
                leading = -float(args[-1]) if op == "TD" else leading
                tm, moved = times([1, 0, 0, 1, float(args[-2]), float(args[-1])], line), True
                line = tm
            elif op == "Tm" and len(args) >= 6:
                tm, moved = [float(x) for x in args[-6:]], True
                line = tm
            elif op in ("T*", "'", '"'):
                tm, moved = times([1, 0, 0, 1, 0, -leading], line), True
                line = tm
            elif op == "Do" and args:
                obj += 1
                out.append(("xobject", obj, 0, [], args[-1][1:], 0.0, rgb, ctm[4], ctm[5], ctm[0], ctm[3], True))
            elif op == "BI":
                obj += 1
                d, raw, i = inline_image(data, i)
                out.append(("inline", obj, 0, [d, {"s": raw.decode("latin-1")}], "", 0.0, rgb, ctm[4], ctm[5], ctm[0], ctm[3], True))
            if op in ("Tj", "TJ", "'", '"') and args:
                at = times([size, 0, 0, size, 0, 0], times(tm, ctm))
                out.append(("text", obj, elem, args[-1] if isinstance(args[-1], list) else [args[-1]], font, size, rgb, at[4], at[5], hypot(at[0], at[1]), hypot(at[2], at[3]), moved))
                elem, moved = elem + 1, False
        except (AttributeError, KeyError, TypeError, ValueError) as e:  # the operator is left out, the rest is read
            out.append(("error", obj, elem, f"{op}: {type(e).__name__}: {e}"[:200], "", 0.0, rgb, 0.0, 0.0, 0.0, 0.0, True))
        args = []
