"""PDF files as tables: cross-references, objects, pages, outline, fonts, text elements and images.

``open_files`` reads the bytes once, in Python; resolving references, precedence of sections, repair,
tree walks, inheritance, encodings and widths are joins and windows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..durable import stored
from ..functions.codecs import decode_stream, decoded, object_key, rc4, rc4_stream
from ..functions.scalars import text_string
from ..operators import cmaps
from ..operators.graph import DEPTH, leaves, newest, too_deep, walk
from . import pdf_bytes as B

OPENED = "file_id string, kind string, section int, obj int, gen int, pos long, in_use boolean, obj_stm int, idx int, value string, raw binary, error string"
#: Rows and bytes that a helper gathers before it hands them on.
SLICE_ROWS, SLICE_BYTES = 2000, 16 << 20
TJ = "array<struct<s:string,adj:double,w:double>>"
REF = "struct<r:array<int>>"


PARSED = (
    "file_id string, page_index int, stream_seq int, kind string, obj_seq int, elem_seq int, font_key string, base_font string, font_size double, rgb array<double>, "
    f"tx double, ty double, scale_x double, scale_y double, moved boolean, tj {TJ}, metric boolean, font_space double, inline string"
)


class PdfError(ValueError):
    """What FAILFAST raises: the first error row."""


def kept(df: DataFrame) -> DataFrame:
    """Stored, and joined by shuffles only: the size of the files says nothing, rows that files have in common take next to none there."""
    return stored(df).hint("merge")


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(file_id, content) of the files below a path, in any store that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file_id"), "content")


def _per_row(df: DataFrame, rows: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows that a helper makes of each row, by Arrow batches of bounded size."""
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])
        for b in batches:
            out, size = [], 0
            for i in range(b.num_rows):
                for r in rows(*(c[i].as_py() for c in b.columns)):
                    out.append(r)
                    size += sum(len(x) for x in r if isinstance(x, str | bytes))
                    if len(out) >= SLICE_ROWS or size > SLICE_BYTES:
                        yield make(out)
                        out, size = [], 0
            if out:
                yield make(out)

    return df.mapInArrow(run, schema)


def opened_rows(file_id: str, content: bytes | None) -> list[tuple]:
    """The rows of ``open_files`` for one file."""
    try:
        b, out = bytes(content), []
        found = B.objects(b)
        sections = B.sections(b) or [([], {"Root": {"r": [o, g]}}) for o, g, _, v, *_ in found[::-1] if isinstance(v, dict) and v.get("Type") == "/Catalog"][:1]
        for s, (entries, trailer) in enumerate(sections):
            out += [(file_id, "xref", s, o, g, p, u, m, i, None, None, None) for o, g, p, u, m, i in entries]
            out.append((file_id, "trailer", s, None, None, None, None, None, None, json.dumps(trailer), None, None))
        by_number = {o: v for o, _, _, v, *_ in found}
        for o, g, p, v, at, n in found:
            v = v if at is None else B.with_parameters(v, by_number)
            out.append((file_id, "object", None, o, g, p, None, None, None, json.dumps(v), None if at is None else b[at : at + n], None))
        return out or [(file_id, "error", *[None] * 9, "no objects")]
    except Exception as e:  # noqa: BLE001  errors are data
        return [(file_id, "error", *[None] * 9, f"{type(e).__name__}: {e}"[:200])]


def open_files(files: DataFrame) -> DataFrame:
    """One row per cross-reference entry, trailer and object of each file; an unreadable one gives an error row.

    Null content: an error.  Files without cross-references still give their objects.
    """
    return _per_row(files.select("file_id", "content"), opened_rows, OPENED)


def _get(c: str | Column, path: str) -> Column:
    return F.get_json_object(c, "$." + path)


def _ref(c: str | Column, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}.r[0]").cast("int")


def _name(c: Column) -> Column:
    return F.regexp_replace(c, "^/", "")


class Documents:
    """Tables of a batch of files; each is a DataFrame, computed when used."""

    def __init__(self, files: DataFrame, password: str = "", checkpoint: bool = True, mode: str = "PERMISSIVE") -> None:
        """checkpoint: the files are read and parsed once, here; else whenever a table is used.

        mode: with FAILFAST the first error row is raised as a PdfError; with PERMISSIVE errors are rows of ``errors``.
        """
        self.password, self.keep = password.encode(), kept if checkpoint else (lambda df: df)
        self.broken_streams: DataFrame | None = None
        self._observed: list[tuple[str, Observation]] = []
        self.opened = self.keep(self._counted("open", open_files(files)))
        if mode == "FAILFAST" and (first := self.errors.first()):
            raise PdfError(f"{first['file_id']}: {first['code']}: {first['message']}")

    @cached_property
    def xref(self) -> DataFrame:
        """The newest entry of each object number, free ones included."""
        x = self.opened.where("kind = 'xref'").select("file_id", "section", "obj", "gen", "pos", "in_use", "obj_stm", "idx")
        return newest(x, ["file_id", "obj"], "section")

    @property
    def trailers(self) -> DataFrame:
        """(file_id, size, root, info, prev, xref_stm, encrypt, id0) of the newest section."""
        t = newest(self.opened.where("kind = 'trailer'").select("file_id", "section", "value"), ["file_id"], "section")
        number = lambda k: _get("value", k).try_cast("long")
        return t.select(
            "file_id", number("Size").cast("int").alias("size"), _ref("value", "Root").alias("root"), _ref("value", "Info").alias("info"), number("Prev").alias("prev"), number("XRefStm").alias("xref_stm"),
            _get("value", "Encrypt").alias("encrypt"), F.get_json_object("value", "$.ID[0].s").alias("id0"),
        )

    @cached_property
    def keys(self) -> DataFrame:
        """(file_id, key, error) of the encrypted files; key is null where no password fits, or the handler isn't supported."""
        password = self.password

        def rows(file_id: str, encrypt: str, id0: str | None) -> list[tuple]:
            try:
                key = B.file_key(json.loads(encrypt), (id0 or "").encode("latin-1"), password)
                return [(file_id, key, None if key else "wrong password")]
            except (KeyError, ValueError, TypeError) as e:
                return [(file_id, None, f"unsupported encryption: {e}"[:200])]

        t = self.trailers.where("encrypt is not null").select("file_id", "encrypt", "id0")
        own = self.opened.where("kind = 'object'").groupBy("file_id", "obj").agg(F.max_by("value", "pos").alias("there"))
        t = t.withColumn("obj", _ref(F.concat(F.lit('{"e":'), F.col("encrypt"), F.lit("}")), "e")).join(own, ["file_id", "obj"], "left")
        out = _per_row(t.select("file_id", F.coalesce("there", "encrypt"), "id0"), rows, "file_id string, key binary, error string")
        return self.keep(out) if self.encrypted else out

    @cached_property
    def encrypted(self) -> bool:
        """Whether any file is."""
        return not self.opened.where("kind = 'trailer'").where(_get("value", "Encrypt").isNotNull()).isEmpty()

    def _how(self, wanted: DataFrame) -> DataFrame:
        """Adds secret, filters, params and shut to rows with file_id, obj, gen and value of streams: what decodes them.

        secret is null where nothing is encrypted; shut: the file's password doesn't fit.
        """
        s = wanted
        if self.encrypted:
            s = s.join(self.keys.select("file_id", "key", F.lit(True).alias("locked")), "file_id", "left")
            plain = F.col("locked").isNull() | F.coalesce(_get("value", "Type") == "/XRef", F.lit(False))
            s = s.withColumns({"secret": F.when(~plain, object_key(F.col("key"), F.col("obj"), F.col("gen"))), "shut": ~plain & F.col("key").isNull()}).drop("key", "locked")
        else:
            s = s.withColumns({"secret": F.lit(None).cast("binary"), "shut": F.lit(False)})
        one, many = _get("value", "Filter"), F.from_json(_get("value", "Filter"), "array<string>")
        names = F.when(F.startswith(one, F.lit("[")), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
        params = _get("value", "DecodeParms")
        params = F.when(F.startswith(params, F.lit("{")), F.concat(F.lit("["), params, F.lit("]"))).otherwise(params)
        return s.withColumns({"filters": F.transform(names, _name), "params": params})

    @property
    def _streams(self) -> DataFrame:
        return self.opened.where("kind = 'object' and raw is not null").select("file_id", "obj", "pos", "raw")

    def _decoded(self, wanted: DataFrame) -> DataFrame:
        """Adds ``data`` to rows with file_id, obj, gen, pos and value: the stream, decrypted and decoded; null if that fails.

        Only the wanted streams are joined to their bytes.  Files whose password doesn't fit have none.
        """
        s = self._how(wanted).join(self._streams, ["file_id", "obj", "pos"])
        s = s.withColumn("raw", F.when(~F.col("shut"), F.col("raw")))
        if self.encrypted:
            s = s.withColumn("raw", F.when(F.col("secret").isNull(), F.col("raw")).otherwise(rc4_stream("secret", "raw")))
        return s.withColumn("data", decode_stream("raw", "filters", "params")).drop("raw", "secret", "filters", "params", "shut")

    @cached_property
    def objects(self) -> DataFrame:
        """(file_id, obj, gen, pos, value, is_stream): what each object number resolves to.

        By its newest entry: at its position, or in its object stream; where that leads nowhere, or the file has no entry
        for it, its last occurrence in the file.  An object is gone if its newest entry is free and of a later generation;
        an entry that is free without one is taken for a fault of the file.
        """
        seen = self.opened.where("kind = 'object'").select("file_id", "obj", "gen", "pos", "value", F.col("raw").isNotNull().alias("is_stream"))
        entry = self.xref.select("file_id", "obj", F.col("pos").alias("e_pos"), "in_use", F.col("gen").alias("e_gen"), F.col("obj_stm").alias("e_stm"), F.col("idx").alias("e_idx"))
        live = F.coalesce(F.col("in_use") | (F.col("e_gen") <= F.col("gen")), F.lit(True))
        there = seen.join(entry, ["file_id", "obj"], "left").where(live)
        rank = F.when(F.col("e_stm").isNull() & (F.col("pos") == F.col("e_pos")), 0).otherwise(3)
        columns = ["file_id", "obj", "gen", "pos", "value", "is_stream", "rank", "later"]
        plain = there.withColumns({"rank": rank, "later": -F.col("pos")}).select(*columns)
        found = self.keep(newest(plain, ["file_id", "obj"], "rank", "later"))
        packed = found.where("is_stream").where(_get("value", "Type") == "/ObjStm")
        if packed.isEmpty():
            return found.drop("rank", "later")

        def rows(file_id: str, stm: int, later: int, value: str, data: bytes | None) -> list[tuple]:
            try:
                return [(file_id, stm, later, i, n, json.dumps(v)) for i, n, v in B.members(json.loads(value), bytes(data))]
            except Exception as e:  # noqa: BLE001  errors are data
                return [(file_id, stm, later, None, None, f"{type(e).__name__}: {e}"[:200])]

        inside = _per_row(self._decoded(packed).select("file_id", "obj", "later", "value", "data"), rows, "file_id string, stm int, later long, idx int, obj int, value string")
        inside = self.keep(inside)
        self.broken_streams = inside.where("obj is null").select("file_id", F.col("stm").alias("obj"), F.col("value").alias("message"))
        inside = inside.where("obj is not null").withColumn("gen", F.lit(0)).join(entry, ["file_id", "obj"], "left").where(live)
        mine = F.col("e_stm") == F.col("stm")
        rank = F.when(mine & (F.col("e_idx") == F.col("idx")), 1).when(mine, 2).otherwise(4)
        inside = inside.withColumns({"rank": rank, "gen": F.lit(0), "pos": F.lit(None).cast("long"), "is_stream": F.lit(False)}).select(*columns)
        return self.keep(newest(found.unionByName(inside), ["file_id", "obj"], "rank", "later").drop("rank", "later"))

    def _followed(self, df: DataFrame, column: str) -> DataFrame:
        """A JSON column where a reference is replaced by the value that it leads to."""
        to = self.objects.select("file_id", F.col("obj").alias("to_obj"), F.col("value").alias("to_value"))
        r = _ref(F.concat(F.lit('{"v":'), F.col(column), F.lit("}")), "v")
        d = df.withColumn("to_obj", r).join(to, ["file_id", "to_obj"], "left")
        return d.withColumn(column, F.when(F.col("to_obj").isNull(), F.col(column)).otherwise(F.col("to_value"))).drop("to_obj", "to_value")

    @cached_property
    def pages(self) -> DataFrame:
        """(file_id, page_index, obj, value, resources): leaves of the page tree with their own or inherited resources."""
        o = self.objects.select("file_id", "obj", "value")
        root = self.trailers.join(o.withColumnRenamed("obj", "root"), ["file_id", "root"]).select(F.col("file_id").alias("tree"), _ref("value", "Pages").alias("node"))
        top = root.join(o.select(F.col("file_id").alias("tree"), F.col("obj").alias("node"), _get("value", "Resources").alias("carried")), ["tree", "node"])
        # a node without a type is one of the tree if it has children, else a page
        parents = self._followed(o.where(F.coalesce(_get("value", "Type"), F.lit("/Pages")) == "/Pages").where(_get("value", "Kids").isNotNull()).select("file_id", "obj", _get("value", "Kids").alias("kids")), "kids")
        edges = parents.select(F.col("file_id").alias("tree"), F.col("obj").alias("parent"), F.posexplode(F.from_json("kids", f"array<{REF}>")).alias("ordinal", "kid"))
        edges = edges.select("tree", "parent", "ordinal", F.get("kid.r", F.lit(0)).alias("child"))
        own = o.select(F.col("file_id").alias("tree"), F.col("obj").alias("child"), _get("value", "Resources").alias("own"), _get("value", "Type").alias("type"))
        freed = self.xref.where("not in_use").select(F.col("file_id").alias("tree"), F.col("obj").alias("child"))  # these are null on purpose
        self.lost_children = edges.where("child is not null").join(own.unionByName(freed, allowMissingColumns=True), ["tree", "child"], "left_anti").select(F.col("tree").alias("file_id"), "child")
        edges = edges.join(own, ["tree", "child"]).where("coalesce(type, '/Page') in ('/Page', '/Pages')")
        walked = walk(top, edges, self.keep)
        self.deep_trees = too_deep(walked, edges).select(F.col("tree").alias("file_id"))
        found = leaves(walked, edges).select(F.col("tree").alias("file_id"), "page_index", F.col("node").alias("obj"), F.col("carried").alias("resources"))
        found = found.join(o, ["file_id", "obj"]).where((F.coalesce(_get("value", "Type"), F.lit("/Page")) == "/Page") & _get("value", "Kids").isNull())
        return self.keep(self._followed(found, "resources"))

    @property
    def page_counts(self) -> DataFrame:
        """(file_id, n_pages)."""
        return self.pages.groupBy("file_id").agg(F.count("*").alias("n_pages"))

    @property
    def outline(self) -> DataFrame:
        """(file_id, path, depth, item, title, page_index): the outline in order; page_index is -1 where the destination is no page.

        Items are followed from the catalog by First and Next, each once; a destination is an array, or a name in the
        catalog's Dests.  Titles are decrypted, then read as UTF-16 if they begin with its mark.
        """
        o = self.objects.select("file_id", "obj", "gen", "pos", "value")
        catalog = self.trailers.select("file_id", F.col("root").alias("obj")).join(o, ["file_id", "obj"])
        roots = catalog.select("file_id", _ref("value", "Outlines").alias("obj")).join(o, ["file_id", "obj"]).select("file_id", _ref("value", "First").alias("first"))
        link = F.struct("obj", _ref("value", "First").alias("first"), _ref("value", "Next").alias("next"))
        items = o.where(_get("value", "Title").isNotNull())
        links = items.groupBy("file_id").agg(F.collect_list(link).alias("links"))

        def rows(file_id: str, first: int, links: list[dict]) -> list[tuple]:
            out, seen, todo, by = [], set(), [(first, [0])], {x["obj"]: x for x in links}
            while todo:
                at, path = todo.pop()
                if at in seen or at not in by:
                    continue
                seen.add(at)
                out.append((file_id, at, path))
                todo += [(by[at]["next"], [*path[:-1], path[-1] + 1]), (by[at]["first"], [*path, 0])]
            return out

        order = _per_row(roots.join(links, "file_id").select("file_id", "first", "links"), rows, "file_id string, obj int, path array<int>")
        raw = F.encode(F.get_json_object("value", "$.Title.s"), "ISO-8859-1")
        keyed = order.join(items, ["file_id", "obj"]).join(self.keys.select("file_id", "key"), "file_id", "left")
        raw = F.when(F.col("key").isNull() | F.col("pos").isNull(), raw).otherwise(rc4_stream(object_key(F.col("key"), F.col("obj"), F.col("gen")), raw))
        dest = F.coalesce(_get("value", "Dest"), _get("value", "A.D"))
        d = keyed.select("file_id", "path", "obj", text_string(raw).alias("title"), dest.alias("dest"))
        # a name leads to an array, or to a dictionary with one
        names = self._followed(catalog.select("file_id", _get("value", "Dests").alias("dests")), "dests")
        names = names.select("file_id", F.explode(F.from_json("dests", "map<string,string>")).alias("name", "named"))
        names = self._followed(names, "named").select("file_id", F.concat(F.lit("/"), "name").alias("dest"), F.coalesce(_get("named", "D"), F.col("named")).alias("named"))
        d = d.join(names, ["file_id", "dest"], "left").withColumn("dest", F.coalesce("named", "dest"))
        to = F.get_json_object("dest", "$[0].r[0]").cast("int")
        pages = self.pages.select("file_id", F.col("obj").alias("to"), "page_index")
        d = d.withColumn("to", to).join(pages, ["file_id", "to"], "left")
        return d.select("file_id", "path", (F.size("path") - 1).alias("depth"), F.col("obj").alias("item"), "title", F.coalesce("page_index", F.lit(-1)).alias("page_index"))

    @cached_property
    def page_fonts(self) -> DataFrame:
        """(file_id, page_index, font_key, font): the font's object number, or its dictionary where it stands in the resources."""
        d = self._followed(self.pages.select("file_id", "page_index", _get("resources", "Font").alias("named")), "named")
        d = d.select("file_id", "page_index", F.explode(F.from_json("named", "map<string,string>")).alias("font_key", "font"))
        return d.withColumn("font", F.coalesce(F.get_json_object("font", "$.r[0]"), F.col("font")))

    @cached_property
    def fonts(self) -> DataFrame:
        """One row per font: file_id, font, subtype, base_font, cmap (decoded ToUnicode), codes, widths, missing, space_width, error."""
        f, key = self._fonts, ["file_id", "font"]
        to = self._decoded(self._cmap_streams).select(*key, F.col("data").alias("cmap"))
        identity = F.coalesce(F.startswith("encoding", F.lit("/Identity")), F.lit(False))
        error = F.when((F.col("subtype") == "Type0") & F.col("cmap").isNull(), F.when(identity, F.lit("no character map")).otherwise(F.concat(F.lit("unsupported encoding "), F.coalesce("encoding", F.lit("none")))))
        return self.keep(f.join(to.hint("merge"), key, "left").select(*key, "subtype", "base_font", "cmap", "codes", "widths", "missing", "space_width", error.alias("error")))

    @property
    def _cmap_streams(self) -> DataFrame:
        to = self._fonts.where("to_unicode is not null").select("file_id", "font", F.col("to_unicode").alias("obj"))
        return to.join(self.objects.where("is_stream").drop("is_stream"), ["file_id", "obj"])

    @cached_property
    def _fonts(self) -> DataFrame:
        """The fonts without their character maps, and the objects that these are.

        codes: code to text of a simple font, by its base encoding and differences; widths by code, in thousandths;
        missing: the width of any other code; space_width: the least width that isn't zero, or null without widths.
        """
        o = self.objects
        f = self.page_fonts.select("file_id", "font").distinct().withColumn("obj", F.col("font").try_cast("int"))
        f = f.join(o.select("file_id", "obj", "value"), ["file_id", "obj"], "left").withColumn("value", F.coalesce("value", "font"))
        f = f.select("file_id", "font", "value", _name(_get("value", "Subtype")).alias("subtype"), _name(_get("value", "BaseFont")).alias("base_font"), _get("value", "Encoding").alias("encoding"), F.coalesce(_get("value", "Widths"), F.lit("[]")).alias("w"), _get("value", "FontDescriptor").alias("about"), F.coalesce(F.get_json_object("value", "$.DescendantFonts[0]"), F.lit("{}")).alias("below"))
        f, key = self.keep(f), ["file_id", "font"]
        # all four may be references: one join for them
        parts = ["encoding", "w", "about", "below"]
        asked = f.select(*key, F.posexplode(F.array(*[_ref(F.concat(F.lit('{"v":'), F.col(c), F.lit("}")), "v") for c in parts])).alias("i", "obj")).where("obj is not null")
        got = asked.join(o.select("file_id", "obj", F.col("value").alias("to")), ["file_id", "obj"], "left").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("i", "to"))).alias("got"))
        f = f.join(got, key, "left").withColumns({c: F.when(F.map_contains_key("got", F.lit(i)), F.col("got")[i]).otherwise(F.col(c)) for i, c in enumerate(parts)}).drop("got")
        f = self.keep(f)
        # what codes stand for
        simple = f.where("subtype is null or subtype <> 'Type0'")
        base = _name(F.coalesce(_get("encoding", "BaseEncoding"), F.when(F.startswith("encoding", F.lit("/")), F.col("encoding"))))
        listed = simple.select(*key, F.posexplode(F.from_json(_get("encoding", "Differences"), "array<string>")).alias("seq", "x"))
        items = listed.select(F.struct(*key).alias("font"), "seq", F.expr("try_cast(x AS int)").alias("number"), F.when(F.startswith("x", F.lit("/")), _name(F.col("x"))).alias("glyph"))
        changed = cmaps.glyph_text(cmaps.expand_differences(items)).select("font.*", "code", "text")
        changed = changed.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("code", "text"))).alias("changed"))
        # of least rank: differences, the named encoding, that of a symbolic font by its name, the standard one
        tables = cmaps.base_encodings(o.sparkSession)
        symbolic = F.coalesce(_get("about", "Flags").try_cast("int").bitwiseAND(F.lit(4)) != 0, F.col("about").isNull())
        own = cmaps.own_encoding(F.coalesce("base_font", F.lit("")), symbolic)
        under = tables.select(F.col("name").alias("own"), F.col("table").alias("under"))
        codes = simple.select(*key, base.alias("name"), own.alias("own")).withColumn("own", F.coalesce("own", F.when(F.col("name").isNull(), "StandardEncoding")))
        codes = codes.join(F.broadcast(tables), "name", "left").join(F.broadcast(under), "own", "left").join(changed.hint("merge"), key, "left")
        empty = F.create_map().cast("map<int,string>")
        over = lambda a, b: F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(y, x))
        codes = codes.select(*key, over(over("under", "table"), "changed").alias("codes"))
        # widths
        first, each = F.coalesce(_get("value", "FirstChar").try_cast("int"), F.lit(0)), F.from_json("w", "array<double>")
        given = simple.where("w <> '[]'").select(*key, F.map_from_arrays(F.sequence(first, first + F.size(each) - 1), each).alias("widths"), F.coalesce(F.nullif(_get("about", "MissingWidth").try_cast("double"), F.lit(0.0)), mean_width(each)).alias("missing"))
        cid = f.where("subtype = 'Type0'").select(*key, F.coalesce(_get("below", "DW").try_cast("double"), F.lit(1000.0)).alias("missing"), _get("below", "W").alias("w"))
        cid = self._followed(cid, "w")
        spans = cmaps.expand_widths(cmaps.cid_spans(cid.select(F.struct(*key).alias("font"), "w"))).select("font.*", "cid", "width")
        spans = spans.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("cid", "width"))).alias("widths"))
        given = given.unionByName(cid.select(*key, "missing").join(spans.hint("merge"), key, "left"), allowMissingColumns=True)
        out = f.join(codes.hint("merge"), key, "left").join(given.hint("merge"), key, "left")
        space = F.array_min(F.filter(F.concat(F.coalesce(F.map_values("widths"), F.array().cast("array<double>")), F.array("missing")), lambda x: x != 0))
        return self.keep(out.select(*key, "subtype", "base_font", "encoding", _ref("value", "ToUnicode").alias("to_unicode"), "codes", "widths", "missing", space.alias("space_width")))

    @property
    def content_refs(self) -> DataFrame:
        """(file_id, page_index, stream_seq, obj): what each page's Contents name, in order; nulls in an array are passed over."""
        p = self._followed(self.pages.select("file_id", "page_index", _get("value", "Contents").alias("c"), F.get_json_object("value", "$.Contents.r[0]").cast("int").alias("one")), "c")
        many = F.transform(F.from_json(F.when(F.startswith("c", F.lit("[")), F.col("c")), f"array<{REF}>"), lambda x: F.get(x["r"], F.lit(0)))
        return p.select("file_id", "page_index", F.posexplode(F.coalesce(many, F.array("one"))).alias("stream_seq", "obj")).where("obj is not null")

    @cached_property
    def contents(self) -> DataFrame:
        """(file_id, page_index, stream_seq, obj, data): the decoded content streams of each page; data is null if it is broken."""
        return self._decoded(self._content_streams).select("file_id", "page_index", "stream_seq", "obj", "data")

    @property
    def _content_streams(self) -> DataFrame:
        return self.content_refs.join(self.objects.where("is_stream").drop("is_stream"), ["file_id", "obj"])

    @cached_property
    def parsed(self) -> DataFrame:
        """What ``elements`` has, and a row of kind "error" for each operator that can't be read.

        Fonts, what is wanted of the streams, and the streams are dealt out by file, in that order, so that each font is
        sent once for a file and each stream once in all, however many pages use them.
        """
        font = F.struct("base_font", "codes", "widths", "missing", "space_width")
        named = self.page_fonts.groupBy("file_id", "page_index").agg(F.map_from_entries(F.collect_list(F.struct("font_key", "font"))).alias("names")).hint("merge")
        contents = self._content_streams.join(named, ["file_id", "page_index"], "left")
        wanted = self._how(contents.unionByName(self._cmap_streams, allowMissingColumns=True)).where(~F.col("shut"))
        parts = [
            self._fonts.select("file_id", "font", font.alias("about"), F.lit(0).alias("order")),
            wanted.select("file_id", "font", "pos", "page_index", "stream_seq", "secret", "filters", "params", "names", F.lit(1).alias("order")),
            self._streams.select("file_id", "pos", "raw", F.lit(2).alias("order")),
        ]
        rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
        rows = rows.repartition("file_id").sortWithinPartitions("file_id", "order")
        rows = rows.select("file_id", "order", "font", "about", "pos", "page_index", "stream_seq", "secret", "filters", "params", "names", "raw")
        kinds = {f.name: to_arrow_type(f.dataType) for f in T.StructType.fromDDL(PARSED)}
        return self.keep(self._counted("parse", rows.mapInArrow(lambda batches: _parse(batches, kinds), PARSED)))

    @property
    def elements(self) -> DataFrame:
        """Text elements, external objects and inline images by page and content stream; content is parsed once.

        tj: pieces of text, the kerning before each, and their widths in thousandths (null: unknown); text: the pieces
        joined; metric: whether all fonts of the page have widths.  Broken streams have none, and a row in ``errors``.
        """
        return self.parsed.where("kind <> 'error'").withColumn("text", F.array_join(F.transform("tj", lambda x: x["s"]), ""))

    @property
    def images(self) -> DataFrame:
        """(file_id, page_index, stream_seq, obj_seq, obj, width, height, components, filter, data): drawn by Do, or inline (obj is null).

        A JPEG's bytes stay as they are, and its filter is named; forms and missing objects are no images.
        """
        d = self._followed(self.pages.select("file_id", "page_index", _get("resources", "XObject").alias("x")), "x")
        named = d.select("file_id", "page_index", F.explode(F.from_json("x", f"map<string,{REF}>")).alias("font_key", "r")).select("file_id", "page_index", "font_key", F.get("r.r", F.lit(0)).alias("obj"))
        page = ["file_id", "page_index", "stream_seq", "obj_seq"]
        drawn = self.elements.where("kind = 'xobject'").select(*page, "font_key").join(named, ["file_id", "page_index", "font_key"])
        drawn = drawn.join(self.objects.where("is_stream").drop("is_stream"), ["file_id", "obj"]).where(_get("value", "Subtype") == "/Image")
        drawn = self._decoded(drawn).select(*page, "obj", "value", "data")
        raw = F.encode(F.get_json_object("inline", "$[1].s"), "ISO-8859-1")
        own = self.elements.where("kind = 'inline'").select(*page, F.lit(None).cast("int").alias("obj"), F.get_json_object("inline", "$[0]").alias("value"), raw.alias("data"))
        short, long = F.col("f"), F.array(_get("value", "Filter"))
        own = own.withColumn("f", F.when(F.startswith(_get("value", "Filter"), F.lit("[")), F.from_json(_get("value", "Filter"), "array<string>")).otherwise(F.filter(long, lambda x: x.isNotNull())))
        own = own.withColumn("data", decode_stream("data", F.transform(short, _name), F.lit(None).cast("string"))).drop("f")
        i = self._followed(drawn.unionByName(own).withColumn("space", _get("value", "ColorSpace")), "space")
        profile = self._followed(i.withColumn("icc", F.when(F.get_json_object("space", "$[0]") == "/ICCBased", F.get_json_object("space", "$[1]"))), "icc")
        kind = F.coalesce(F.get_json_object("space", "$[0]"), F.col("space"))
        parts = F.coalesce(_get("icc", "N").try_cast("int"), F.when(kind.isin("/DeviceGray", "/CalGray", "/G", "/Indexed", "/I"), 1).when(kind.isin("/DeviceCMYK", "/CMYK"), 4).otherwise(3))
        size = lambda k: _get("value", k).try_cast("int")
        return profile.select(*page, "obj", size("Width").alias("width"), size("Height").alias("height"), parts.alias("components"), _get("value", "Filter").alias("filter"), "data")

    @property
    def errors(self) -> DataFrame:
        """(file_id, code, message): everything that is lost on the way from files to elements.

        open: no objects, or unreadable; password: none fits, or the handler isn't supported; tree: no catalog, no page
        tree, no pages, or a child that the file doesn't hold; objects: a broken object stream; font: no character map;
        contents: a page without content, or whose stream is missing; stream: it doesn't decode; operator: wrong operands.
        Of files without a key only the password is reported.
        """
        row = lambda df, code, message: df.select("file_id", F.lit(code).alias("code"), message.cast("string").alias("message"))
        out = row(self.opened.where("kind = 'error'"), "open", F.col("error"))
        out = out.unionByName(row(self.keys.where("error is not null"), "password", F.col("error")))
        o = self.objects.select("file_id", F.col("obj").alias("root"), F.col("value").alias("catalog"))
        roots = self.trailers.select("file_id", "root").join(o, ["file_id", "root"], "left")
        node = roots.withColumn("obj", _ref("catalog", "Pages")).join(o.select("file_id", F.col("root").alias("obj"), F.col("catalog").alias("top")), ["file_id", "obj"], "left")
        node = node.join(self.page_counts, "file_id", "left")
        lost = F.when(F.col("catalog").isNull(), "no catalog").when(F.col("top").isNull(), "no page tree").when(F.col("n_pages").isNull(), "no pages")
        found = row(node.where(lost.isNotNull()), "tree", lost)
        _ = self.pages  # finds them
        found = found.unionByName(row(self.lost_children, "tree", F.concat(F.lit("object "), "child", F.lit(" is missing"))))
        found = found.unionByName(row(self.deep_trees, "tree", F.lit(f"deeper than {DEPTH} levels")))
        if self.broken_streams is not None:
            found = found.unionByName(row(self.broken_streams, "objects", F.concat(F.lit("object "), "obj", F.lit(": "), "message")))
        found = found.unionByName(row(self.fonts.where("error is not null"), "font", F.concat_ws(" ", "base_font", "error")))
        page = F.concat(F.lit("page "), "page_index")
        none = self.pages.join(self.content_refs.select("file_id", "page_index").distinct(), ["file_id", "page_index"], "left_anti")
        found = found.unionByName(row(none, "contents", F.concat(page, F.lit(": none"))))
        gone = self.content_refs.join(self.objects.where("is_stream").select("file_id", "obj"), ["file_id", "obj"], "left_anti")
        found = found.unionByName(row(gone, "contents", F.concat(page, F.lit(": object "), "obj", F.lit(" is missing"))))
        found = found.unionByName(row(self.contents.where("data is null"), "stream", F.concat(F.lit("object "), "obj")))
        found = found.unionByName(row(self.parsed.where("kind = 'error'"), "operator", F.concat(page, F.lit(": "), "inline")))
        return out.unionByName(found.join(self.keys.where("key is null").select("file_id"), "file_id", "left_anti"))

    @property
    def counters(self) -> DataFrame:
        """(stage, what, n): files, objects, streams, elements and errors that the stages which have run so far have made."""
        rows = [(stage, k, int(v or 0)) for stage, o in self._observed for k, v in o.get.items()]
        return self.opened.sparkSession.createDataFrame(rows, "stage string, what string, n long")

    def _counted(self, stage: str, df: DataFrame) -> DataFrame:
        """Observes a stage's rows as they are written; without checkpoints there is nothing to observe."""
        if self.keep is not kept:
            return df
        seen = Observation()
        self._observed.append((stage, seen))
        count = lambda name, kind: F.count_if(F.col("kind") == kind).alias(name)
        if stage == "open":
            return df.observe(seen, F.approx_count_distinct("file_id").alias("files"), count("objects", "object"), F.count("raw").alias("streams"), F.sum(F.octet_length("raw")).alias("stream_bytes"), count("entries", "xref"), count("errors", "error"))
        return df.observe(seen, count("texts", "text"), count("external", "xobject"), count("inline", "inline"), count("errors", "error"))

    def save_tables(self, buckets: int, prefix: str = "pdf_", names: tuple[str, ...] = ("objects", "pages", "outline", "fonts", "elements", "images", "errors")) -> None:
        """Tables of the catalog, bucketed by file and sorted by file and page.

        A query for a file reads one bucket, one for a page skips the other pages' rows; joins by file need no shuffle.
        """
        for name in names:
            df = getattr(self, name)
            order = [c for c in ("page_index", "stream_seq", "obj_seq") if c in df.columns]
            df.repartition(buckets, "file_id").write.bucketBy(buckets, "file_id").sortBy("file_id", *order).mode("overwrite").saveAsTable(prefix + name)

    def create_views(self, prefix: str = "pdf_") -> None:
        for name in ("xref", "trailers", "objects", "pages", "page_counts", "outline", "fonts", "elements", "images", "errors"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def mean_width(widths: Column) -> Column:
    """The mean of the widths that aren't zero."""
    some = F.filter(widths, lambda x: x != 0)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))


@lru_cache(maxsize=64)
def _code_map(cmap: bytes) -> B.CodeMap:
    return B.CodeMap(cmap)


class _Pieces:
    """Pieces of text operators, gathered by column."""

    def __init__(self) -> None:
        self.starts, self.s, self.adj, self.w = [], [], [], []

    def add(self, found: list[dict] | None) -> None:
        self.starts.append(None if found is None else len(self.s))
        for x in found or ():
            self.s.append(x["s"])
            self.adj.append(x["adj"])
            self.w.append(x["w"])

    def array(self, kind: pa.ListType) -> pa.Array:
        one = pa.StructArray.from_arrays([pa.array(self.s, pa.string()), pa.array(self.adj, pa.float64()), pa.array(self.w, pa.float64())], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array([*self.starts, len(self.s)], pa.int32()), one, type=kind)


class _File:
    """What has come of a file so far: fonts, what is wanted of its streams by their positions, and those streams."""

    def __init__(self, file_id: str) -> None:
        self.id, self.fonts, self.cmaps, self.contents, self.wanted = file_id, {}, {}, [], {}

    def stream(self, pos: int, raw: bytes) -> None:
        for font, page, seq, secret, filters, params, names in self.wanted.get(pos, ()):
            if font is not None:
                self.cmaps[font] = decoded(rc4(secret, raw) if secret is not None else raw, filters, params)
            else:
                self.contents.append((page, seq, raw, secret, filters, params, names))


def _parse(batches: Iterator[pa.RecordBatch], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows of ``PARSED`` of content streams; rows come sorted by file, its fonts first, then what is wanted, then the streams."""

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([tj.array(k) if n == "tj" else pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(kinds.items())], list(kinds))

    def read(file: _File) -> Iterator[pa.RecordBatch]:
        nonlocal out, tj, size
        own = {}
        for name, (font, by_cmap) in file.fonts.items():
            cmap = file.cmaps.get(name)
            if cmap not in by_cmap and len(by_cmap) >= 8:
                by_cmap.clear()
            own[name] = by_cmap.setdefault(cmap, font | {"cmap": cmap})
        for page, seq, raw, secret, filters, params, names in file.contents:
            data = decoded(rc4(secret, raw) if secret is not None else raw, filters, params)
            if data is None:
                continue
            used = {key: own.get(x, {}) for key, x in names or []}
            metric = all(f.get("missing") is not None for f in used.values())
            size += len(data)
            for kind, o, e, items, key, font_size, rgb, x, y, sx, sy, moved in B.content(data):
                f = used.get(key, {}) if kind == "text" else {}
                tj.add(pieces(items, f) if kind == "text" else None)
                more = json.dumps(items) if kind == "inline" else items if kind == "error" else None
                out.append((file.id, page, seq, kind, o, e, key, f.get("base_font"), font_size, rgb, x, y, sx, sy, moved, None, metric, f.get("space_width"), more))
                if len(out) >= SLICE_ROWS or size > SLICE_BYTES:
                    yield made()
                    out, tj, size = [], _Pieces(), 0

    out, tj, size = [], _Pieces(), 0
    file, recent = _File(""), []
    for b in batches:
        abouts = b.column(3)
        for i, (file_id, order, font) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)):
            if file_id != file.id:
                yield from read(file)
                file = _File(file_id)
            if order == 0:
                one = abouts[i]
                known = next((f for x, f in recent if x.equals(one)), None)
                if known is None:  # many files have the same fonts
                    about = one.as_py()
                    known = about | {k: dict(about[k]) if about[k] is not None else None for k in ("codes", "widths")}, {}
                    recent = [(abouts.take(pa.array([i]))[0], known), *recent[:7]]
                file.fonts[font] = known
            elif order == 1:
                pos, *what = (c[i].as_py() for c in b.columns[4:11])
                file.wanted.setdefault(pos, []).append((font, *what))
            elif (pos := b.column(4)[i].as_py()) in file.wanted:
                file.stream(pos, b.column(11)[i].as_py())
    yield from read(file)
    if out:
        yield made()


class _Widths(dict):
    """Widths by code; any other code has the missing one."""

    def __init__(self, widths: dict, missing: float) -> None:
        super().__init__(widths)
        self.missing = missing

    def __missing__(self, code: int) -> float:
        self[code] = self.missing
        return self.missing


def reader(font: dict) -> Callable[[bytes], tuple[list[int], str]]:
    """The codes of a font's string, and their text; without a font a byte is a WinAnsi character."""
    codes = font.get("codes")
    if font.get("cmap"):
        return _code_map(bytes(font["cmap"])).read
    if codes is not None:
        texts = [codes.get(c, "□") for c in range(256)]
        return lambda b: (list(b), "".join(map(texts.__getitem__, b)))
    if font:
        return lambda b: ([int.from_bytes(b[i : i + 2], "big") for i in range(0, len(b), 2)], "□" * ((len(b) + 1) // 2))
    return lambda b: (list(b), b.decode("cp1252", "replace"))


class _Strings(dict):
    """(text, width) of a font's strings; short ones, which come again and again, are kept."""

    def __init__(self, font: dict) -> None:
        missing = font.get("missing")
        self.reader, self.width = reader(font), None if missing is None else _Widths(font.get("widths") or {}, missing).__getitem__

    def __missing__(self, s: str) -> tuple[str, float | None]:
        codes, text = self.reader(s.encode("latin-1"))
        out = text, None if self.width is None else float(sum(map(self.width, codes)))
        if len(s) <= 24:
            if len(self) >= 20_000:
                self.clear()
            self[s] = out
        return out


def pieces(items: list, font: dict) -> list[dict]:
    """Pieces of a text operator: text by the font's maps, the kerning before it, and its width.

    What reads a font's strings is made once and kept in it.
    """
    if (read := font.get("read")) is None:
        read = font["read"] = _Strings(font)
    out, adj = [], None
    for x in items:
        if isinstance(x, int | float):
            adj = (adj or 0.0) + x
        elif isinstance(x, dict) and "s" in x:
            text, w = read[x["s"]]
            out.append({"s": text, "adj": adj, "w": w})
            adj = None
    if adj is not None and out:
        out.append({"s": "", "adj": adj, "w": None if font.get("missing") is None else 0.0})
    return out


def read_pdf(spark: SparkSession, path: str, password: str = "", mode: str = "PERMISSIVE") -> Documents:
    """The tables of all PDF files below a path."""
    return Documents(read_files(spark, path), password, mode=mode)
