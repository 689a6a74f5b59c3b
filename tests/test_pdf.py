"""PDF files made by hand: both kinds of cross-reference, encodings, layout, damage."""

import zlib

import pytest

from normgraph import sources
from normgraph.sources import pdf

MAP = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap
1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar
2 beginbfrange <0010> <0012> <03B1> <0020> <0021> [<D83DDE00> <0042>] endbfrange
endcmap end"""


def stream(data, extra=b"", flate=True):
    body = zlib.compress(data) if flate else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if flate else b"", extra, body)


def objects(contents, kids=None):
    """Catalog, two levels of pages, fonts in three encodings, and the contents."""
    first = 10
    half = len(contents) // 2
    refs = [b"%d 0 R" % (first + 2 * k) for k in range(len(contents))]
    found = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count %d /Resources << /Font << /W 5 0 R /D 6 0 R /U 7 0 R >> /XObject << /F 9 0 R >> >> >>" % len(contents),
        3: b"<< /Type /Pages /Parent 2 0 R /Kids [%s] >>" % b" ".join(refs[:half]),
        4: b"<< /Type /Pages /Parent 2 0 R /Kids [%s] >>" % b" ".join(refs[half:]),
        5: b"<< /Type /Font /Subtype /TrueType /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [%s] >>" % b" ".join([b"500"] * 224),
        6: b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /eacute /ccaron /fi 65 /seven /uni20AC /odd.name 39 /quotesingle] >> >>",
        7: b"<< /Type /Font /Subtype /Type0 /ToUnicode 8 0 R /DescendantFonts [<< /DW 600 /W [1 [700 800] 16 18 900] >>] >>",
        8: stream(MAP),
        9: stream(b"BT /W 10 Tf 50 20 Td (in a form) Tj ET", b"/Type /XObject /Subtype /Form"),
    }
    for k, c in enumerate(contents):
        found[first + 2 * k] = b"<< /Type /Page /Contents %d 0 R >>" % (first + 2 * k + 1)
        found[first + 2 * k + 1] = c
    return found


def with_table(objs, extra=b""):
    out, places = b"%PDF-1.4\n%\xe2\xe3\n", {}
    for n, body in objs.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at, top = len(out), max(objs) + 1
    rows = b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(top))
    return out + b"xref\n0 %d\n%strailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (top, rows, top, extra, at)


def with_stream(objs, predictor=True):
    """Plain objects in an object stream, a cross-reference stream with the PNG predictor."""
    packed = {n: b for n, b in objs.items() if b"stream" not in b}
    out, places = b"%PDF-1.5\n", {}
    for n, body in objs.items():
        if n not in packed:
            places[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    top = max(objs) + 1
    heads, bodies = [], b""
    for k, (n, body) in enumerate(packed.items()):
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += body + b" "
        places[n] = (2, top, k)
    head = b" ".join(heads) + b" "
    places[top] = (1, len(out), 0)
    out += b"%d 0 obj\n%s\nendobj\n" % (top, stream(head + bodies, b"/Type /ObjStm /N %d /First %d" % (len(packed), len(head))))
    at = len(out)
    places[top + 1] = (1, at, 0)
    rows = [bytes([places.get(n, (0, 0, 0))[0]]) + places.get(n, (0, 0, 0))[1].to_bytes(4, "big") + bytes([places.get(n, (0, 0, 0))[2]]) for n in range(top + 2)]
    parms = b""
    if predictor:
        before, made = bytes(6), []
        for r in rows:
            made.append(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, before)))
            before = r
        rows, parms = made, b"/DecodeParms << /Predictor 12 /Columns 6 >>"
    return out + b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (top + 1, stream(b"".join(rows), b"/Type /XRef /W [1 4 1] /Size %d /Root 1 0 R %s" % (top + 2, parms)), at)


CONTENTS = [
    stream(b"BT /W 12 Tf 1 0 0 1 72 700 Tm (Pasal 1) Tj 0 -14 TD (caf\\351 \\(a\\) \\\\ b) Tj T* [(kern) 20 (ed) -400 (word)] TJ ET"),
    stream(b"BT /D 12 Tf 14 TL 72 700 Td <010203414243> Tj (it\\047s) ' ET % a comment (not shown)\n/F Do"),
    stream(b"q 2 0 0 2 0 0 cm BT /U 10 Tf 10 10 Td <000100020010001100200021> Tj 45 0 Td <0012> Tj 200 0 Td <0001> Tj ET Q BI /W 1 ID \x00(( EI BT /W 9 Tf 0 900 Td (end) Tj ET", flate=False),
    b"<< /Length 10 /Filter /FlateDecode >>\nstream\nnot a zlib stream\nendstream",
    stream(b""),
    stream(b"BT /W 12 Tf (last) Tj ET"),
]
TEXTS = ["Pasal 1\ncafé (a) \\ b\nkerned word", "éčfi7€\ufffd\nit's\nin a form", "Afiαβ\U0001f600Bγ A\nend", None, "", "last"]


@pytest.mark.parametrize("make", [with_table, with_stream, lambda o: with_stream(o, False), lambda o: with_table(o).replace(b"startxref", b"startxxxx"), lambda o: with_stream(o)[:-12] + b"7\n%%EOF"], ids=["table", "stream", "stream without predictor", "no start", "wrong start"])
def test_pages_of_both_kinds_of_files(make):
    assert list(pdf.page_texts(make(objects(CONTENTS)))) == TEXTS


def test_a_page_limit_stops_early(monkeypatch):
    read = []
    monkeypatch.setattr(pdf.Page, "run", lambda self, *a, was=pdf.Page.run: read.append(1) or was(self, *a))
    assert list(pdf.page_texts(with_table(objects(CONTENTS)), 1)) == TEXTS[:1] and len(read) == 1
    assert list(pdf.page_texts(with_table(objects(CONTENTS)), 0)) == []


def test_newer_sections_come_first():
    old = with_table(objects(CONTENTS))
    at = len(old)
    new = old + b"11 0 obj\n%s\nendobj\n" % stream(b"BT /W 12 Tf (changed) Tj ET")
    start = len(new)
    new += b"xref\n11 1\n%010d 00000 n \ntrailer\n<< /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, old.rindex(b"xref\n0 "), start)
    assert list(pdf.page_texts(new))[:2] == ["changed", TEXTS[1]]


def test_files_that_can_not_be_read():
    for data in (b"%PDF-1.4", with_table(objects(CONTENTS), b"/Encrypt << >>"), with_table({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R] >>"})):
        with pytest.raises(pdf.PdfError):
            list(pdf.page_texts(data))


def test_pages_and_texts_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.pdf").write_bytes(with_table(objects(CONTENTS)))
    (tmp_path / "b.pdf").write_bytes(with_stream(objects(CONTENTS[:2])))
    (tmp_path / "c.pdf").write_bytes(with_table(objects(CONTENTS))[:300])
    (tmp_path / "d.txt").write_bytes("one\ftwo é".encode())
    files = sources.list_files(spark, str(tmp_path), "*.*")
    name = lambda r: r.path.rsplit("/", 1)[-1]
    pages = sorted((name(r), r.page, r.text, r.damaged) for r in sources.extract_pages(files).collect())
    assert pages == [*(("a.pdf", k + 1, t or "", t is None) for k, t in enumerate(TEXTS)), ("b.pdf", 1, TEXTS[0], False), ("b.pdf", 2, TEXTS[1], False), ("c.pdf", 1, "", True), ("d.txt", 1, "one", False), ("d.txt", 2, "two é", False)]
    assert sources.extract_pages(files, max_pages=2).count() == 7
    texts = {name(r): (r.text, r.damaged) for r in sources.extract_texts(files).collect()}
    assert texts["a.pdf"] == ("".join(t + "\n" for t in TEXTS if t), True) and texts["b.pdf"] == (f"{TEXTS[0]}\n{TEXTS[1]}\n", False)
    assert texts["c.pdf"] == ("", True) and texts["d.txt"] == ("one\ntwo é\n", False)


def test_provisions_of_pdf_files(spark, tmp_path):
    body = b"BT /W 12 Tf 0 700 Td (Pasal 1) Tj 0 -14 Td (a provision that is long enough to be kept here) Tj 0 -14 Td (Pasal 2) Tj 0 -14 Td (and another one that is long enough as well) Tj ET"
    (tmp_path / "UU_X_2020.pdf").write_bytes(with_stream(objects([stream(body), stream(b"")])))
    got = sources.corpus_from_texts(sources.extract_texts(sources.list_files(spark, str(tmp_path))), "natl").orderBy("ord").collect()
    assert [(r.label, r.year, r.text) for r in got] == [("UU_X_2020 - Pasal 1", 2020, "a provision that is long enough to be kept here"), ("UU_X_2020 - Pasal 2", 2020, "and another one that is long enough as well")]
