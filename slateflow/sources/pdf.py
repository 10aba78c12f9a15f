"""Pages of PDF files as rows: a Python data source that reads cross-reference tables, page boxes and embedded page images, not whole files.

The layout of the files is that of ISO 32000: cross-reference tables and streams with their earlier versions, object streams, inherited page entries.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pixels an inch unless the caller says otherwise, and points an inch.
DPI, POINTS = 144.0, 72.0
#: A partition reads about so many bytes of files; the pages of a larger file are divided.
PARTITION_BYTES = 64 << 20
#: Page size in points where no page node has one.
LETTER = [0.0, 0.0, 612.0, 792.0]

_SPACE = rb"[\x00\t\n\x0c\r ]"
_TOKEN = re.compile(rb"(?:" + _SPACE + rb"|%[^\r\n]*)*(?:(\d+)" + _SPACE + rb"+(\d+)" + _SPACE + rb"+R(?![A-Za-z])|([+-]?(?:\d+\.?\d*|\.\d+))|/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(<<|>>|[\[\]])|<([0-9A-Fa-f\s]*)>|(\()|([A-Za-z]+))")
_IN_STRING = re.compile(rb"[^()\\]+|\\.|[()]", re.S)


@dataclass(frozen=True)
class Ref:
    number: int


class PdfError(ValueError):
    """A file that can't be opened as a PDF, or has no page."""


def parse(data: bytes, at: int = 0):
    """(value, end) of the object at an offset: dict, list, str (a name), bytes (a string), number, Ref, or a keyword as ``...`` / bool / None."""
    m = _TOKEN.match(data, at)
    if not m:
        raise PdfError("malformed object")
    at = m.end()
    number, _, real, name, mark, digits, opened, word = m.groups()
    if number is not None:
        return Ref(int(number)), at
    if real is not None:
        return (float(real) if b"." in real else int(real)), at
    if name is not None:
        return re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), name).decode("latin-1"), at
    if mark in (b"<<", b"["):
        items, end = [], (b">>" if mark == b"<<" else b"]")
        while True:
            m = _TOKEN.match(data, at)
            if m and m[5] == end:
                pairs = len(items) // 2 * 2
                return (dict(zip(items[:pairs:2], items[1:pairs:2])) if mark == b"<<" else items), m.end()
            item, at = parse(data, at)
            items.append(item)
    if digits is not None:
        return bytes.fromhex(digits.decode() + "0" * (len(re.sub(rb"\s", b"", digits)) % 2)), at
    if opened is not None:
        depth, parts = 1, []
        while depth:
            m = _IN_STRING.match(data, at)
            if not m:
                raise PdfError("open string")
            depth += (m[0] == b"(") - (m[0] == b")")
            parts.append(m[0])
            at = m.end()
        return b"".join(parts[:-1]), at
    if mark is not None:
        raise PdfError("unexpected delimiter")
    return {b"true": True, b"false": False, b"null": None}.get(word, ...), at


def unpredicted(data: bytes, parms: dict) -> bytes:
    """Bytes behind the PNG predictors of a deflated stream."""
    if parms.get("Predictor", 1) < 10:
        return data
    step = max(1, parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)
    width = (parms.get("Columns", 1) * parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) + 7) // 8
    out, above = bytearray(), bytearray(width)
    for i in range(0, len(data) - width, width + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + width])
        for j in range(width):
            left, up, corner = (row[j - step], above[j], above[j - step]) if j >= step else (0, above[j], 0)
            if kind == 4:
                guess = left + up - corner
                add = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            else:
                add = (0, left, up, (left + up) // 2)[kind]
            row[j] = (row[j] + add) & 255
        out += row
        above = row
    return bytes(out)


class PdfFile:
    """Objects of a seekable file by number, read where the cross-reference says they are."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.places: dict[int, tuple] = {}  # (offset,) or (number of the object stream, index in it)
        self.streams: dict[int, list] = {}
        self.trailer: dict = {}
        tail = self._bytes(max(0, size - 2048), 2048)
        found = re.findall(rb"startxref\s+(\d+)", tail)
        if not found:
            raise PdfError("no cross-reference")
        waiting, seen = [int(found[-1])], set()
        while waiting:
            at = waiting.pop(0)
            if at not in seen:
                seen.add(at)
                trailer = self._table(at)
                self.trailer = trailer | self.trailer
                waiting += [trailer[k] for k in ("XRefStm", "Prev") if k in trailer]
        if "Encrypt" in self.trailer:
            raise PdfError("encrypted")
        if "Root" not in self.trailer:
            raise PdfError("no root")

    def _bytes(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _until(self, at: int, pattern: bytes) -> bytes:
        """Bytes from an offset that contain a pattern, in steps that double."""
        if not 0 <= at < self.size:
            raise PdfError("offset outside the file")
        length = 4096
        while True:
            data = self._bytes(at, length)
            if re.search(pattern, data) or at + length >= self.size:
                return data
            length *= 2

    def _table(self, at: int) -> dict:
        data = self._until(at, rb"startxref|endstream|endobj")
        if not data.lstrip().startswith(b"xref"):
            return self._entries(*self._object_at(at))
        head, _, rest = data.partition(b"trailer")
        words = head.split()[1:]
        while words:
            first, count = int(words[0]), int(words[1])
            for i in range(count):
                offset, _, kind = words[2 + 3 * i : 5 + 3 * i]
                if kind == b"n":
                    self.places.setdefault(first + i, (int(offset),))
            words = words[2 + 3 * count :]
        return parse(rest)[0]

    def _entries(self, head: dict, start: int | None) -> dict:
        if start is None or head.get("Type") != "XRef":
            raise PdfError("no cross-reference stream")
        data, widths = self.decoded(head, start), head["W"]
        index = head.get("Index") or [0, head["Size"]]
        numbers = [n for first, count in zip(index[::2], index[1::2]) for n in range(first, first + count)]
        for i, number in enumerate(numbers):
            fields, at = [], i * sum(widths)
            for w in widths:
                fields.append(int.from_bytes(data[at : at + w], "big"))
                at += w
            kind = fields[0] if widths[0] else 1
            if kind in (1, 2):
                self.places.setdefault(number, (fields[1],) if kind == 1 else (fields[1], fields[2]))
        return head

    def _object_at(self, at: int):
        """An object and, if it is a stream, the offset of its bytes."""
        data = self._until(at, rb"endobj|stream\r?\n")
        m = re.match(_SPACE + rb"*\d+" + _SPACE + rb"+\d+" + _SPACE + rb"+obj", data)
        if not m:
            raise PdfError("no object at its offset")
        value, end = parse(data, m.end())
        m = re.compile(_SPACE + rb"*stream(\r\n|\n|\r)").match(data, end)
        return value, (at + m.end() if m else None)

    def get(self, value):
        """The value behind a reference; objects that don't exist are null."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.stream(value)[0]
        raise PdfError("references in a circle")

    def stream(self, ref: Ref):
        place = self.places.get(ref.number)
        if place is None:
            return None, None
        if len(place) == 1:
            return self._object_at(place[0])
        holder, index = place
        if holder not in self.streams:
            head, start = self._object_at(self.places[holder][0])
            data, first = self.decoded(head, start), self.get(head["First"])
            offsets = [int(n) for n in data[:first].split()[1::2]]
            self.streams = {holder: [(data, first + o) for o in offsets]}  # one at a time
        data, offset = self.streams[holder][index]
        return parse(data, offset)[0], None

    def raw(self, head: dict, start: int) -> bytes:
        return self._bytes(start, self.get(head.get("Length", 0)))

    def filters(self, head: dict) -> list[str]:
        found = self.get(head.get("Filter"))
        return [self.get(f) for f in found] if isinstance(found, list) else [found] if found else []

    def parms(self, head: dict) -> dict:
        found = self.get(head.get("DecodeParms")) or {}
        found = (self.get(found[-1]) or {}) if isinstance(found, list) and found else found or {}
        return {k: self.get(v) for k, v in found.items()}

    def decoded(self, head: dict, start: int) -> bytes:
        filters, data = self.filters(head), self.raw(head, start)
        if filters not in ([], ["FlateDecode"]):
            raise PdfError(f"filter not supported: {filters}")
        return unpredicted(zlib.decompressobj().decompress(data), self.parms(head)) if filters else data

    def pages(self, first: int, last: int) -> Iterator[tuple[int, dict]]:
        """(number from 0, page with inherited entries) of the pages from ``first`` on and before ``last``; subtrees outside aren't read."""
        root = self.get(self.get(self.trailer["Root"])["Pages"])
        stack, number = [(root, {}, 0)], 0
        while stack and number < last:
            node, above, depth = stack.pop()
            node = self.get(node)
            if not isinstance(node, dict) or depth > 64:
                raise PdfError("malformed page tree")
            merged = above | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if "Kids" in node:
                count = self.get(node.get("Count"))
                if isinstance(count, int) and 0 < count <= first - number and node is not root:
                    number += count
                    continue
                stack += [(kid, merged, depth + 1) for kid in reversed(self.get(node["Kids"]))]
            else:
                if number >= first:
                    yield number, merged
                number += 1

    def count(self) -> int:
        count = self.get(self.get(self.get(self.trailer["Root"])["Pages"]).get("Count"))
        return count if isinstance(count, int) else sum(1 for _ in self.pages(0, 1 << 31))

    def box(self, page: dict) -> tuple[float, float]:
        """Width and height in points of what is shown: the crop box within the media box, turned."""
        media, crop = (([float(self.get(v)) for v in self.get(page[k])] if k in page else None) for k in ("MediaBox", "CropBox"))
        upright = lambda b: [min(b[0], b[2]), min(b[1], b[3]), max(b[0], b[2]), max(b[1], b[3])]
        box = upright(media or LETTER)
        if box[2] == box[0] or box[3] == box[1]:
            box = LETTER
        if crop:
            crop = upright(crop)
            inner = [max(box[0], crop[0]), max(box[1], crop[1]), min(box[2], crop[2]), min(box[3], crop[3])]
            box = inner if inner[0] < inner[2] and inner[1] < inner[3] else box
        width, height = box[2] - box[0], box[3] - box[1]
        return (height, width) if (self.get(page.get("Rotate")) or 0) % 180 == 90 else (width, height)

    def image(self, page: dict) -> tuple[str | None, bytes | None]:
        """Format and bytes of the page's largest image: JPEG as it is, 8-bit grey and RGB as PNG; other images, and none, are null."""
        objects = self.get((self.get(page.get("Resources")) or {}).get("XObject")) or {}
        found = [self.stream(v) for v in objects.values() if isinstance(v, Ref)]
        images = [(h, s) for h, s in found if s is not None and h.get("Subtype") == "Image"]
        if not images:
            return None, None
        head, start = max(images, key=lambda i: self.get(i[0]["Width"]) * self.get(i[0]["Height"]))
        filters = self.filters(head)
        if filters == ["DCTDecode"]:
            return "jpeg", self.raw(head, start)
        channels = {"DeviceGray": 1, "DeviceRGB": 3}.get(self.get(head.get("ColorSpace")) if not isinstance(self.get(head.get("ColorSpace")), list) else None)
        if filters not in ([], ["FlateDecode"]) or not channels or self.get(head.get("BitsPerComponent")) != 8:
            return None, None
        width, height = self.get(head["Width"]), self.get(head["Height"])
        data = self.decoded(head, start)
        rows = b"".join(b"\0" + data[i : i + width * channels] for i in range(0, width * channels * height, width * channels))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        header = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
        return "png", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@dataclass
class PageRange(InputPartition):
    """Files of a partition, each with its part of how many parts."""

    files: list[tuple[str, int, int, int]]


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.dpi = float(options.get("dpi", DPI))
        if self.dpi <= 0:
            raise PdfError("dpi must be above 0")
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.image = options.get("image", "false").lower() == "true"
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[PageRange]:
        """Small files together, the pages of large ones divided; by sizes alone, no file is opened here."""
        from pyarrow import fs

        files = []
        for path in self.paths:
            system, inner = _filesystem(path)
            info = system.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                raise PdfError(f"no such file: {path}")
            below = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
            prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            files += [(prefix + i.path, i.size) for i in below if i.type == fs.FileType.File and i.path.lower().endswith(".pdf")]
        found, together, size = [], [], 0
        for path, length in sorted(files):
            parts = max(1, math.ceil(length / self.bytes))
            if parts > 1:
                found += [PageRange([(path, length, i, parts)]) for i in range(parts)]
                continue
            if together and size + length > self.bytes:
                found.append(PageRange(together))
                together, size = [], 0
            together, size = [*together, (path, length, 0, 1)], size + length
        return [*found, PageRange(together)] if together or not found else found

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for path, size, part, parts in partition.files:
            system, inner = _filesystem(path)
            with system.open_input_file(inner) as file:
                try:
                    pdf = PdfFile(file, size)
                    pages = pdf.count()
                    if not pages:
                        raise PdfError("no pages")
                    for number, page in pdf.pages(pages * part // parts, pages * (part + 1) // parts):
                        width, height = (math.ceil(v * self.dpi / POINTS) for v in pdf.box(page))
                        yield (path, number + 1, width, height, *(pdf.image(page) if self.image else ()))
                except (PdfError, KeyError, TypeError, AttributeError, IndexError, struct.error, zlib.error, RecursionError, ValueError) as e:
                    raise PdfError(f"not a readable PDF: {path}: {e!r}") from e


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PdfPages(DataSource):
    """``spark.read.format("pdf_pages")``: path, page_number (from 1), width_px, height_px, and with the option ``image`` image_format and image.

    Options: path (a file, a folder or several, comma-separated), dpi, image, partitionBytes. Files that aren't called .pdf are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        wanted = self.options.get("image", "false").lower() == "true"
        return "path string, page_number int, width_px int, height_px int" + (", image_format string, image binary" if wanted else "")

    def reader(self, schema) -> PdfReader:
        return PdfReader(dict(self.options))


def read_pdf_pages(spark: SparkSession, path: str, dpi: float = DPI, image: bool = False) -> DataFrame:
    """Pages of PDF files with their sizes at a density, and their scanned image where asked. Missing, unreadable and empty files are errors."""
    spark.dataSource.register(PdfPages)
    return spark.read.format(PdfPages.name()).option("dpi", dpi).option("image", image).load(path)
