"""Presentation files as rows: text inventory, patches that keep a text's style, and rendering.

A file is one row with its bytes (``spark.read.format("binaryFile")``); each task opens one package at a time.
"""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from functools import lru_cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import px_to_emu
from ..functions.text import strip

_A, _P, _R = ("http://schemas.openxmlformats.org/" + end for end in ("drawingml/2006/main", "presentationml/2006/main", "officeDocument/2006/relationships"))
_REL, _TYPES = ("http://schemas.openxmlformats.org/package/2006/" + end for end in ("relationships", "content-types"))
ITEM = "slide_number int, shape_index int, text string, left long, top long, width long, height long, font_name string, font_size_pt double, bold boolean, italic boolean, alignment string, color_hex string"


#: Files whose results a task holds at once.
FILES = 100


def small(batches):
    """Arrow batches cut to FILES rows: files go on as they are done, and a task holds the objects of one file."""
    for batch in batches:
        for at in range(0, batch.num_rows, FILES):
            yield batch.slice(at, FILES)


def _slides(package: zipfile.ZipFile) -> list[str]:
    """The part names of the slides, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(package.read("ppt/_rels/presentation.xml.rels"))}
    ids = ET.fromstring(package.read("ppt/presentation.xml")).iter(f"{{{_P}}}sldId")
    return [posixpath.normpath(posixpath.join("ppt", targets[i.get(f"{{{_R}}}id")])) if not targets[i.get(f"{{{_R}}}id")].startswith("/") else targets[i.get(f"{{{_R}}}id")][1:] for i in ids]


#: Names as the parser gives them: Element.find and findall take one such name much faster than a path.
_TREE, _BODY, _PROPERTIES = (f"{{{_P}}}{tag}" for tag in ("spTree", "txBody", "spPr"))
_PARA, _RUN, _BREAK, _FIELD, _T, _RPR, _PPR, _LATIN, _FILL, _RGB, _XFRM = (f"{{{_A}}}{tag}" for tag in ("p", "r", "br", "fld", "t", "rPr", "pPr", "latin", "solidFill", "srgbClr", "xfrm"))


def _first(e: ET.Element, tag: str, *rest: str) -> ET.Element | None:
    """What ``e.find`` gives for the path of these names."""
    child = e.find(tag)
    if child is None or not rest:
        return child
    found = _first(child, *rest)
    return found if found is not None else next((f for c in e.findall(tag)[1:] if (f := _first(c, *rest)) is not None), None)


def _shapes(slide: ET.Element) -> list[ET.Element]:
    tree = _first(slide, f"{{{_P}}}cSld", _TREE)
    return [e for e in tree if e.tag.rsplit("}", 1)[-1] in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")]


def _text(body: ET.Element) -> str:
    return "\n".join(["".join(["\n" if e.tag == _BREAK else e.findtext(_T) or "" for e in p if e.tag in (_RUN, _BREAK, _FIELD)]) for p in body.findall(_PARA)])


def _flag(value: str | None) -> bool | None:
    return None if value is None else value in ("1", "true")


def _style(body: ET.Element) -> tuple:
    """font_name, font_size_pt, bold, italic, alignment and color_hex."""
    run, align = _first(body, _PARA, _RUN, _RPR), _first(body, _PARA, _PPR)
    align = align.get("algn") if align is not None else None
    if run is None:
        return None, None, None, None, align, None
    font, color, size = run.find(_LATIN), _first(run, _FILL, _RGB), run.get("sz")
    return font.get("typeface") if font is not None else None, int(size) / 100 if size else None, _flag(run.get("b")), _flag(run.get("i")), align, "#" + color.get("val").upper() if color is not None else None


def _items(content: bytes) -> list[tuple]:
    """The values of ``ITEM`` of each shape with text."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        for number, name in enumerate(_slides(package), 1):
            for index, shape in enumerate(_shapes(ET.fromstring(package.read(name)))):
                body = shape.find(_BODY)
                text = _text(body).strip() if body is not None else ""
                if not text:
                    continue
                place = _first(shape, _PROPERTIES, _XFRM)
                at = (0, 0, 0, 0) if place is None else (place[0].get("x"), place[0].get("y"), place[1].get("cx"), place[1].get("cy"))
                out.append((number, index, text, *map(int, at), *_style(body)))
    return out


def text_inventory(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Shapes with text, with place (EMU), style of the first run, and alignment; groups are one shape without text."""
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        fields = [f.split() for f in ITEM.split(", ")]
        for batch in small(batches):
            found = [_items(c.as_py()) for c in batch.column(content)]
            owner = pa.array([n for n, items in enumerate(found) for _ in items], pa.int64())
            columns = list(zip(*(item for items in found for item in items))) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in keys), *(pa.array(c, types[t]) for c, (_, t) in zip(columns, fields))], [*keys, *(n for n, _ in fields)])

    return files.select(*keys, content).mapInArrow(run, f"{kinds}, {ITEM}")


MAPPING = "shape_index int, current_text string, corrected_text string, approx_hex string"


def read_patches(documents: DataFrame, keys: list[str], json: str = "json", slide_number: Column | None = None) -> DataFrame:
    """Patches in order (``ord``) of documents: of their slides, or else of one slide: the given one, the document's, or the first."""
    entry = f"array<struct<{MAPPING}>>"
    parsed = F.from_json(json, f"slides array<struct<slide_number int, mappings {entry}>>, slide_number int, mappings {entry}", {"mode": "FAILFAST"})
    rows = documents.select(*keys, parsed.alias("d"), (F.lit(None).cast("int") if slide_number is None else slide_number.cast("int")).alias("_given"))
    one = F.array(F.struct(F.coalesce("_given", "d.slide_number", F.lit(1)).alias("slide_number"), F.col("d.mappings").alias("mappings")))
    rows = rows.select(*keys, F.explode(F.coalesce("d.slides", one)).alias("s")).select(*keys, "s.slide_number", F.posexplode("s.mappings").alias("ord", "m"))
    return rows.select(*keys, "slide_number", "ord", "m.*")


def inventory_documents(inventory: DataFrame, keys: list[str]) -> DataFrame:
    """The inventory of each file as JSON: its slides with their items."""
    fields = [f.split()[0] for f in ITEM.split(", ")][1:]
    items = F.sort_array(F.collect_list(F.struct(*fields)))
    slides = inventory.groupBy(*keys, "slide_number").agg(items.alias("items"))
    listed = slides.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slide_number", "items"))).alias("slides"))
    return listed.select(*keys, F.to_json(F.struct("slides"), {"ignoreNullFields": "false"}).alias("json"))


def resolve_patches(patches: DataFrame, inventory: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Patches (slide_number, shape_index or current_text, corrected_text, approx_hex) with the shape that each is for.

    A given index stands. Of patches by text the k-th of a text takes the k-th shape of that text; those without a shape go.
    """
    on = [*keys, "slide_number", "_text"]
    by_index = patches.where("shape_index is not null")
    named = patches.where("shape_index is null").withColumn("_text", strip(F.coalesce("current_text", F.lit("")))).where("_text <> ''")
    rank = lambda df, o: df.withColumn("_k", F.row_number().over(Window.partitionBy(*on).orderBy(o)))
    shapes = inventory.select(*keys, "slide_number", F.col("text").alias("_text"), F.col("shape_index").alias("_shape"))
    matched = rank(named, order).join(rank(shapes, "_shape"), [*on, "_k"]).withColumn("shape_index", F.col("_shape").cast(patches.schema["shape_index"].dataType))
    return by_index.unionByName(matched.select(*patches.columns))


def _rewrite(body: ET.Element, text: str | None, color: str | None) -> None:
    """Set a body's text, one paragraph a line, in the style of its first run and paragraph; then its colour."""
    a = lambda tag: f"{{{_A}}}{tag}"
    first = body.find(a("p"))
    shape, style = first.find(a("pPr")) if first is not None else None, body.find(f"{a('p')}/{a('r')}/{a('rPr')}")
    text = _text(body) if text is None else text
    for p in body.findall(a("p")):
        body.remove(p)
    for line in text.splitlines() or [text]:
        p = ET.SubElement(body, a("p"))
        if shape is not None:
            p.append(shape)
        run = ET.SubElement(p, a("r"))
        own = ET.fromstring(ET.tostring(style)) if style is not None else ET.Element(a("rPr"))
        if color:
            for old in own.findall(a("solidFill")):
                own.remove(old)
            fill = ET.Element(a("solidFill"))
            ET.SubElement(fill, a("srgbClr")).set("val", color.strip().lstrip("#").upper())
            own.insert(0, fill)
        run.append(own)
        ET.SubElement(run, a("t")).text = line


def patch_files(files: DataFrame, patches: DataFrame, keys: list[str], order: str, content: str = "content") -> DataFrame:
    """``keys`` and the patched bytes of each file; ``patches`` as of ``resolve_patches``, taken in order. Files without a patch stay as they are."""
    line = F.struct(order, "slide_number", "shape_index", "corrected_text", "approx_hex")
    rows = files.select(*keys, content).join(patches.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("patches")), keys, "left")
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    for prefix, space in (("a", _A), ("p", _P), ("r", _R)):
        ET.register_namespace(prefix, space)

    def patched(data: bytes, found: list[dict] | None) -> bytes:
        if not found:
            return data
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as package, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            numbers = {name: n for n, name in enumerate(_slides(package), 1)}
            for name in package.namelist():
                part = package.read(name)
                mine = [p for p in found if p["slide_number"] == numbers.get(name)]
                if mine:
                    slide = ET.fromstring(part)
                    shapes = _shapes(slide)
                    for p in mine:
                        body = shapes[p["shape_index"]].find(f"{{{_P}}}txBody") if 0 <= p["shape_index"] < len(shapes) else None
                        if body is not None:
                            _rewrite(body, p["corrected_text"], p["approx_hex"])
                    part = ET.tostring(slide, encoding="UTF-8", xml_declaration=True)
                new.writestr(name, part)
        return out.getvalue()

    def run(batches):
        for batch in small(batches):
            files_ = [patched(c.as_py(), p.as_py()) for c, p in zip(batch.column(content), batch.column("patches"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(files_, pa.binary())], [*keys, content])

    return rows.select(*keys, content, "patches").mapInArrow(run, f"{kinds}, {content} binary")


def alignment(align: Column) -> Column:
    """Left unless center or right is named."""
    name = F.lower(align)
    return F.when(name == "center", "ctr").when(name == "right", "r").otherwise("l")


def shape_xml(dpi: int = 96) -> Column:
    """The XML of a text placement: no margins, top anchor, one paragraph a line, every run in its font."""
    emu = lambda c: px_to_emu(F.col(c), dpi).cast("string")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "1").otherwise("0")
    color = F.concat(*(F.lpad(F.hex(F.col(f"color.{c}").cast("int")), 2, "0") for c in "rgb"))
    run = F.concat(F.lit('<a:rPr sz="'), F.bround(F.col("font_size_pt") * 100).cast("int").cast("string"), F.lit('" b="'), flag("bold"), F.lit('" i="'), flag("italic"), F.lit('"><a:solidFill><a:srgbClr val="'), color, F.lit('"/></a:solidFill><a:latin typeface="'), safe(F.col("font_name")), F.lit('"/></a:rPr>'))
    paragraph = lambda t: F.concat(F.lit('<a:p><a:pPr algn="'), alignment(F.col("align")), F.lit('"/><a:r>'), run, F.lit("<a:t>"), safe(t), F.lit("</a:t></a:r></a:p>"))
    paragraphs = F.array_join(F.transform(F.split("text", r"\R"), paragraph), "")
    wrap = F.when(F.coalesce("word_wrap", F.lit(False)), "square").otherwise("none")
    return F.concat(F.lit('<p:spPr><a:xfrm><a:off x="'), emu("x"), F.lit('" y="'), emu("y"), F.lit('"/><a:ext cx="'), emu("width"), F.lit('" cy="'), emu("height"), F.lit('"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom><a:noFill/></p:spPr><p:txBody><a:bodyPr wrap="'), wrap, F.lit('" lIns="0" tIns="0" rIns="0" bIns="0" anchor="t"/><a:lstStyle/>'), paragraphs, F.lit("</p:txBody>"))


_GROUP = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
_SPACES = f'xmlns:a="{_A}" xmlns:p="{_P}" xmlns:r="{_R}"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


#: Entries and bytes of an archive that ``_archive`` lays out itself; larger ones are left to zipfile, which has longer fields for them.
ENTRIES, BYTES = 65_000, 1 << 30


def _deflated(data: bytes) -> tuple[int, int, bytes]:
    """Check sum, size and compressed bytes of a part."""
    z = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    return zlib.crc32(data), len(data), z.compress(data) + z.flush()


#: Parts that packages share are compressed once.
_shared = lru_cache(64)(_deflated)


def _archive(parts: list[tuple[str, tuple[int, int, bytes]]]) -> bytes:
    """A zip archive of compressed parts, the bytes of which are zipfile's; the same parts give the same bytes."""
    out, listed, at = [], [], 0
    for name, (crc, size, data) in parts:
        # dated 1980-01-01; names are ASCII
        head = struct.pack("<BBHHHHLLLHH", 20, 0, 0, 8, 0, 33, crc, len(data), size, len(name), 0)
        key = name.encode("ascii")
        listed += (b"PK\1\2\x14\3", head, struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at), key)
        out += (b"PK\3\4", head, key, data)
        at += 4 + len(head) + len(key) + len(data)
    index = b"".join(listed)
    return b"".join((*out, index, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(parts), len(parts), len(index), at, 0)))


_KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def _rels(found: list[tuple[str, str, str]]) -> bytes:
    return (f'{_HEAD}<Relationships xmlns="{_REL}">' + "".join(f'<Relationship Id="{i}" Type="{_KIND}{t}" Target="{to}"/>' for i, t, to in found) + "</Relationships>").encode()


_LAYOUT = ("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")


@lru_cache(16)
def _frame(width: int, height: int, n: int) -> tuple[list[tuple[str, bytes]], list[tuple[str, bytes]]]:
    """The parts before and behind the slides of a presentation of ``n`` slides."""
    main = "application/vnd.openxmlformats-officedocument.presentationml."
    types = {"/ppt/presentation.xml": main + "presentation.main+xml", "/ppt/slideMasters/slideMaster1.xml": main + "slideMaster+xml", "/ppt/slideLayouts/slideLayout1.xml": main + "slideLayout+xml"}
    types |= {f"/ppt/slides/slide{k}.xml": main + "slide+xml" for k in range(1, n + 1)}
    blank = f"<p:cSld><p:spTree>{_GROUP}</p:spTree></p:cSld>"
    names = " ".join(f'{c}="{c}"' for c in ("accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink"))
    master = f'{_HEAD}<p:sldMaster {_SPACES}>{blank}<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" {names}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>'
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k + 1}"/>' for k in range(1, n + 1))
    deck = f'{_HEAD}<p:presentation {_SPACES}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{width}" cy="{height}"/><p:notesSz cx="{height}" cy="{width}"/></p:presentation>'
    listed = "".join(f'<Override PartName="{k}" ContentType="{v}"/>' for k, v in types.items())
    content = f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>{listed}</Types>'
    before = [
        ("_rels/.rels", _rels([("rId1", "officeDocument", "ppt/presentation.xml")])),
        ("ppt/slideMasters/slideMaster1.xml", master.encode()),
        ("ppt/slideMasters/_rels/slideMaster1.xml.rels", _rels([_LAYOUT])),
        ("ppt/slideLayouts/slideLayout1.xml", f'{_HEAD}<p:sldLayout {_SPACES} type="blank">{blank}</p:sldLayout>'.encode()),
        ("ppt/slideLayouts/_rels/slideLayout1.xml.rels", _rels([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")])),
    ]
    slides = [(f"rId{k + 1}", "slide", f"slides/slide{k}.xml") for k in range(1, n + 1)]
    behind = [("ppt/presentation.xml", deck.encode()), ("ppt/_rels/presentation.xml.rels", _rels([("rId1", "slideMaster", "slideMasters/slideMaster1.xml"), *slides])), ("[Content_Types].xml", content.encode())]
    return before, behind


def _package(width: int, height: int, slides: list[dict | None]) -> bytes:
    """A presentation of blank slides with their shapes: their XML, and their pictures (k, image), which the XML names by k."""
    before, behind = _frame(width, height, len(slides))
    parts, plain = [], _rels([_LAYOUT])
    own: set[str] = set()
    for n, slide in enumerate(slides, 1):
        xml, images = (slide["xml"], slide["images"]) if slide else ("", [])
        for i in images:
            parts.append((f"ppt/media/image{n}-{i['k']}.png", i["image"]))
        parts.append((f"ppt/slides/slide{n}.xml", f"{_HEAD}<p:sld {_SPACES}><p:cSld><p:spTree>{_GROUP}{xml}</p:spTree></p:cSld></p:sld>".encode()))
        own.update(name for name, _ in parts[-1 - len(images) :])
        rels = _rels([_LAYOUT, *((f"rId{i['k']}", "image", f"../media/image{n}-{i['k']}.png") for i in images)]) if images else plain
        parts.append((f"ppt/slides/_rels/slide{n}.xml.rels", rels))
    parts = [*before, *parts, *behind]
    if len(parts) <= ENTRIES and sum(len(data) for _, data in parts) <= BYTES:
        return _archive([(name, _deflated(data) if name in own else _shared(data)) for name, data in parts])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, data in parts:
            # the same rows give the same bytes
            package.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _element(shape: Column, at: Column) -> Column:
    """The XML of the shape at a place of its slide: a picture (image), named by its number, or a text."""
    k = (at + 2).cast("string")
    safe = F.coalesce(shape["box_id"].cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(mark), F.lit(name))
    xml = F.coalesce(shape["xml"], F.lit(""))
    picture = F.concat(F.lit('<p:pic><p:nvPicPr><p:cNvPr id="'), k, F.lit('" name="'), safe, F.lit('"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rId'), k, F.lit('"/><a:stretch><a:fillRect/></a:stretch></p:blipFill>'), xml, F.lit("</p:pic>"))
    text = F.concat(F.lit('<p:sp><p:nvSpPr><p:cNvPr id="'), k, F.lit('" name="'), safe, F.lit('"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr>'), xml, F.lit("</p:sp>"))
    return F.when(shape["image"].isNotNull(), picture).otherwise(text)


def render(slides: DataFrame, texts: DataFrame, images: DataFrame, keys: list[str], dpi: int = 96) -> DataFrame:
    """``keys`` and the bytes of a presentation per deck; give a slide's number among ``keys`` too for a file per slide.

    ``slides`` (slide_no, width_px, height_px), the first of which sets the size; ``images`` (slide_no, ord, box_id, x, y, width, height, image),
    backgrounds first; ``texts`` (slide_no, ord, box_id, text, x, y, width, height, font_name, font_size_pt, color, bold, italic, align, word_wrap) over them.
    """
    emu = lambda c: px_to_emu(F.col(c), dpi).cast("string")
    place = F.concat(F.lit('<p:spPr><a:xfrm><a:off x="'), emu("x"), F.lit('" y="'), emu("y"), F.lit('"/><a:ext cx="'), emu("width"), F.lit('" cy="'), emu("height"), F.lit('"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr>'))
    on = list(dict.fromkeys([*keys, "slide_no"]))
    shapes = images.select(*on, F.lit(0).alias("layer"), F.col("ord").cast("long").alias("ord"), "box_id", place.alias("xml"), "image")
    shapes = shapes.unionByName(texts.select(*on, F.lit(1).alias("layer"), F.col("ord").cast("long").alias("ord"), "box_id", shape_xml(dpi).alias("xml"), F.lit(None).cast("binary").alias("image")))
    own = shapes.where("slide_no is not null").groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("layer", "ord", "box_id", "xml", "image"))).alias("s"))
    pictures = F.filter(F.transform("s", lambda s, i: F.struct((i + 2).alias("k"), s["image"].alias("image"))), lambda p: p["image"].isNotNull())
    own = own.select(*on, F.struct(F.col("slide_no").alias("n"), F.array_join(F.transform("s", _element), "").alias("xml"), pictures.alias("images")).alias("slide"))
    # both sides are by deck, so that shapes which lie by deck already aren't moved again
    own = own.groupBy(*keys).agg(F.collect_list("slide").alias("shapes"))
    line = F.struct(F.col("slide_no").alias("n"), px_to_emu(F.col("width_px"), dpi).alias("w"), px_to_emu(F.col("height_px"), dpi).alias("h"))
    decks = slides.select(*on, "width_px", "height_px").groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("slides")).join(own, keys, "left")
    kinds = ", ".join(f"`{k}` {slides.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in small(batches):
            out = []
            for deck, shapes in zip(batch.column("slides"), batch.column("shapes")):
                deck, shapes = deck.as_py(), {s["n"]: s for s in shapes.as_py() or []}
                out.append(_package(deck[0]["w"], deck[0]["h"], [shapes.get(d["n"]) for d in deck]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], [*keys, "content"])

    return decks.mapInArrow(run, f"{kinds}, content binary")


