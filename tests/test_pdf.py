"""PDF files written by hand in each form of cross-reference, read as rows."""

import struct
import zlib

import pytest

from slateflow.sources import decks, pdf


def written(objects: dict[int, bytes], root: int = 1, form: str = "table", extra: bytes = b"") -> bytes:
    """A file of objects: with a table, or with a cross-reference stream and the plain objects in an object stream."""
    out, offsets, plain = bytearray(b"%PDF-1.7\n%\xe2\xe3\n"), {}, []
    for n, body in objects.items():
        if form == "stream" and b"stream" not in body:
            plain.append((n, body))
            continue
        offsets[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    size = max(objects) + 3
    if form == "table":
        at = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in sorted(offsets.items()))
        out += b"trailer\n<< /Size %d /Root %d 0 R %s>>\n" % (size, root, extra)
    else:
        heads, body = [], b""
        for n, b in plain:
            heads.append(b"%d %d" % (n, len(body)))
            body += b + b" "
        head = b" ".join(heads) + b" "
        data = zlib.compress(head + body)
        holder, table = size - 2, size - 1
        offsets[holder] = len(out)
        out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (holder, len(plain), len(head), len(data), data)
        at = offsets[table] = len(out)
        index = {n: i for i, (n, _) in enumerate(plain)}
        rows = [struct.pack(">BIH", 1, offsets[n], 0) if n in offsets else struct.pack(">BIH", 2, holder, index[n]) if n in index else struct.pack(">BIH", 0, 0, 0) for n in range(size)]
        up, packed = bytes(7), b""
        for row in rows:  # the predictor that takes each byte from the one above
            packed, up = packed + b"\x02" + bytes((x - y) & 255 for x, y in zip(row, up)), row
        packed = zlib.compress(packed)
        out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Root %d 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (table, size, root, len(packed), packed)
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)


def book(pages: list[bytes], box: bytes = b"/MediaBox [0 0 240 160]") -> dict[int, bytes]:
    """Two inner nodes: the first page alone, the others below the second."""
    kids = [10 + i for i in range(len(pages))]
    refs = lambda ks: b" ".join(b"%d 0 R" % k for k in ks)
    found = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count %d %s >>" % (len(pages), box)}
    found |= {3: b"<< /Type /Pages /Kids [%s] /Count 1 /Parent 2 0 R>>" % refs(kids[:1]), 4: b"<< /Type /Pages /Kids [%s] /Count %d /Rotate 90 >>" % (refs(kids[1:]), len(pages) - 1)}
    return found | {k: b"<< /Type /Page /Note (a \\) (name)) % remark\n " + p + b" >>" for k, p in zip(kids, pages)}


PAGES = [b"", b"/Rotate 0", b"", b"/MediaBox [10 20.5 110 220.25]", b"/CropBox [-5 0 100 50] /Rotate 180", b"/Rotate 270 /MediaBox 7 0 R"]
SIZES = [(480, 320), (480, 320), (320, 480), (400, 200), (200, 100), (60, 41)]


@pytest.mark.parametrize("form", ["table", "stream"])
def test_pages(spark, tmp_path, form):
    (tmp_path / "a.PDF").write_bytes(written(book(PAGES) | {7: b"[0 0 20.1 30]"}, form=form))
    (tmp_path / "b.pdf").write_bytes(written(book([b""] * 40), form=form))
    (tmp_path / "c.txt").write_bytes(b"no PDF")
    rows = pdf.read_pdf_pages(spark, str(tmp_path)).orderBy("path", "page_number").collect()
    assert [(r.page_number, r.width_px, r.height_px) for r in rows[:6]] == [(i + 1, *s) for i, s in enumerate(SIZES)]
    assert [r.page_number for r in rows[6:]] == list(range(1, 41)) and rows[0].path == f"{tmp_path}/a.PDF"
    assert pdf.read_pdf_pages(spark, f"file://{tmp_path}/a.PDF", dpi=72).first().width_px == 240


def test_large_files_are_divided(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(written(book([b""] * 41)))
    size = (tmp_path / "b.pdf").stat().st_size
    spark.dataSource.register(pdf.PdfPages)
    rows = spark.read.format("pdf_pages").option("partitionBytes", size // 4).load(str(tmp_path))
    parts = pdf.PdfReader({"path": str(tmp_path), "partitionBytes": str(size // 4)}).partitions()
    assert len(parts) == 5 and rows.rdd.getNumPartitions() == 5
    assert sorted(r.page_number for r in rows.collect()) == list(range(1, 42))


@pytest.mark.parametrize("form", ["table", "stream"])
def test_images(spark, tmp_path, form):
    grey, jpeg = bytes(range(12)), b"\xff\xd8 as it is \xff\xd9"
    image = lambda rest, data: b"<< /Subtype /Image %s /Length %d >>\nstream\n%s\nendstream" % (rest, len(data), data)
    objects = book([b"/Resources << /XObject << /A 30 0 R /B 31 0 R >> >>", b"/Resources << /XObject << /B 31 0 R >> >>", b"", b"/Resources << /XObject << /C 32 0 R >> >>"])
    objects |= {30: image(b"/Width 9 /Height 9 /Filter /DCTDecode", jpeg), 31: image(b"/Width 4 /Height 3 /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode", zlib.compress(grey))}
    objects |= {32: image(b"/Width 4 /Height 3 /Filter /JPXDecode", b"?")}
    (tmp_path / "a.pdf").write_bytes(written(objects, form=form))
    rows = pdf.read_pdf_pages(spark, str(tmp_path), image=True).orderBy("page_number").collect()
    assert (rows[0].image_format, bytes(rows[0].image)) == ("jpeg", jpeg)
    assert [(r.image_format, r.image) for r in rows[2:]] == [(None, None)] * 2
    (tmp_path / "x.png").write_bytes(bytes(rows[1].image))
    got = spark.read.format("image").load(f"{tmp_path}/x.png").select("image.*").first()
    assert (got.width, got.height, bytes(got.data)) == (4, 3, grey)


def test_feeds_uploads(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(written(book([b""] * 3)))
    uploads = spark.createDataFrame([(1, 0, f"{tmp_path}/b.pdf")], "deck long, ord int, path string")
    slides = decks.expand_uploads(uploads, pdf.read_pdf_pages(spark, str(tmp_path)), ["deck"], "ord").orderBy("slide_number").collect()
    assert [(s.label, s.source_type, s.page_number, s.width_px) for s in slides] == [("slide-001", "pdf_page", 1, 480), ("slide-002", "pdf_page", 2, 320), ("slide-003", "pdf_page", 3, 320)]


def test_earlier_versions(tmp_path):
    """A file that was written to again: the newest table counts, the one before fills in."""
    first = written(book([b"", b""]))
    at = len(first)
    page = b"11 0 obj\n<< /Type /Page /MediaBox [0 0 10 10] /Rotate 0 >>\nendobj\n"
    before = int(first.rsplit(b"startxref\n", 1)[1].split()[0])
    again = first + page + b"xref\n11 1\n%010d 00000 n \ntrailer\n<< /Size 20 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, before, at + len(page))
    (tmp_path / "a.pdf").write_bytes(again)
    reader = pdf.PdfReader({"path": str(tmp_path)})
    assert [r[2:] for p in reader.partitions() for r in reader.read(p)] == [(480, 320), (20, 20)]


@pytest.mark.parametrize("data", [b"", b"%PDF-1.4 nothing", b"startxref\n99999\n", written({1: b"<< /Pages 2 0 R >>", 2: b"<< /Kids [] /Count 0 >>"}), written(book([b"", b""]), extra=b"/Encrypt 5 0 R "), written({1: b"<< /Pages 9 0 R >>"})])
def test_errors(spark, tmp_path, data):
    (tmp_path / "a.pdf").write_bytes(data)
    with pytest.raises(Exception, match="not a readable PDF"):
        pdf.read_pdf_pages(spark, str(tmp_path)).collect()


def test_wrong_options(spark, tmp_path):
    with pytest.raises(Exception, match="dpi must be above 0"):
        pdf.read_pdf_pages(spark, str(tmp_path), dpi=0).collect()
    with pytest.raises(Exception, match="no such file"):
        pdf.read_pdf_pages(spark, f"{tmp_path}/none.pdf").collect()
