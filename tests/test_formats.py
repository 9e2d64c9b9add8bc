from __future__ import annotations

import datetime as dt
import io
import struct
import zipfile
import zlib

import pytest

from marlstone.sources import formats as R


def z(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        for name, data in members.items():
            f.writestr(name, data)
    return out.getvalue()


def test_structured():
    assert R.from_json(b'{"b": {"x": [1, {"y": true}], "n": null}, "a": "s", "f": 1.5}') == "a: s\n\nb.x[1].y: true\n\nf: 1.5"
    assert R.from_json(b'"scalar"') == "" and R.from_json(b"[1, 2]") == ""
    assert R.from_yaml(b"b: yes\na: 2024-01-01\nc: true\nd: [x, {e: 1}]\n") == "b: yes\n\na: 2024-01-01\n\nc: true\n\nd[1].e: 1"
    assert R.from_toml(b'b = 1\na = "x"\nd = 2024-01-01\n[t]\nk = [1]\nz = false\n') == "a: x\n\nb: 1\n\nt.z: false"
    assert R.from_csv(b'a,b\n"x, y",2\n') == "a\tb\nx, y\t2"
    with pytest.raises(R.Unreadable):
        R.from_csv(b"a,b\n1\n")


def test_html():
    text = R.from_html(b"<html><head><title>T</title></head><body><h1>Head</h1><p>One <b>two</b><p>Three &amp; four<ul><li>x<li><p>y</p></ul></body></html>")
    assert text == "Head\n\nOne two\n\nThree & four\n\nx\n\ny\n\ny"
    assert R.from_html(b"<div>only text</div>") == "only text"


def test_html_leaves_scripts_out():
    text = R.from_html(b"<body><h1>H</h1><p>A</p><script>var x = 1;</script><p>B</p></body>")
    assert text == "H\n\nA\n\nB"


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def test_docx():
    doc = f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p></w:body></w:document>'
    assert R.from_docx(z({"word/document.xml": doc})) == "One\n\n two"


def test_xlsx():
    book = f'<workbook xmlns="{S}" xmlns:r="{REL}"><sheets><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships xmlns="http://x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>'
    shared = f'<sst xmlns="{S}"><si><t>text</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>'
    sheet = (
        f'<worksheet xmlns="{S}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>1.50</v></c><c r="D1" t="b"><v>1</v></c></row>'
        '<row><c r="A2" t="inlineStr"><is><t> </t></is></c></row><row><c r="A3" t="s"><v>1</v></c><c r="B3"><v>7</v></c></row></sheetData></worksheet>'
    )
    data = z({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": shared, "xl/worksheets/s.xml": sheet})
    assert R.from_xlsx(data) == "[Sheet: A]\ntext\t1.5\t\ttrue\nab\t7"


def test_sheets_are_cut():
    lines = R._sheet_text("A", (["x"] for _ in range(R.SHEET_ROWS + 5)))
    assert len(lines) == R.SHEET_ROWS + 2 and "truncated" in lines[-1]


def test_ods():
    t, o, x = (f"urn:oasis:names:tc:opendocument:xmlns:{k}:1.0" for k in ("table", "office", "text"))
    content = (
        f'<o:d xmlns:t="{t}" xmlns:o="{o}" xmlns:x="{x}"><t:table t:name="A"><t:table-row><t:table-cell><x:p>one</x:p></t:table-cell><t:table-cell t:number-columns-repeated="2"/>'
        '<t:table-cell o:value="2.0"/></t:table-row><t:table-row t:number-rows-repeated="1000"><t:table-cell t:number-columns-repeated="9999"/></t:table-row></t:table></o:d>'
    )
    assert R.from_ods(z({"content.xml": content})) == "[Sheet: A]\none\t\t\t2"


def wide(s: str) -> bytes:
    return struct.pack("<I", len(s)) + s.encode("utf-16-le")


def record(kind: int, body: bytes) -> bytes:
    head = bytes([kind]) if kind < 128 else bytes([(kind & 0x7F) | 0x80, kind >> 7])
    return head + bytes([len(body)]) + body


def test_xlsb():
    book = record(156, struct.pack("<II", 0, 1) + wide("r1") + wide("A"))
    rels = '<Relationships xmlns="http://x"><Relationship Id="r1" Target="worksheets/s.bin"/></Relationships>'
    shared = record(19, b"\0" + wide("text"))
    cell = lambda col: struct.pack("<II", col, 0)
    sheet = record(0, struct.pack("<I", 0) + b"\0" * 8) + record(7, cell(0) + struct.pack("<I", 0)) + record(5, cell(2) + struct.pack("<d", 2.5)) + record(2, cell(3) + struct.pack("<I", (700 << 2) | 3)) + record(4, cell(4) + b"\1")
    data = z({"xl/workbook.bin": book, "xl/_rels/workbook.bin.rels": rels, "xl/sharedStrings.bin": shared, "xl/worksheets/s.bin": sheet})
    assert R.from_xlsb(data) == "[Sheet: A]\ntext\t\t2.5\t7\ttrue"


def compound(stream: bytes) -> bytes:
    """A compound file with one stream, in sectors of 512 bytes, long enough to need no short ones."""
    stream = stream.ljust(4096, b"\0")
    n = -(-len(stream) // 512)
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *[i + 3 for i in range(n - 1)], 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))

    def entry(name: str, kind: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<H", len(raw)) + bytes([kind, 1]) + struct.pack("<III", 0xFFFFFFFF, 0xFFFFFFFF, 1 if kind == 5 else 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream)) + b"\0" * 256
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    header += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return header.ljust(512, b"\0") + struct.pack("<128I", *fat) + directory + stream


def test_xls():
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    bof = rec(0x809, b"\0" * 16)
    shared = rec(0xFC, struct.pack("<II", 2, 2) + struct.pack("<HB", 4, 0) + b"text" + struct.pack("<HB", 2, 1) + "中文".encode("utf-16-le"))
    sheet = bof + rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(0x203, struct.pack("<HHHd", 0, 2, 0, 2.5)) + rec(0x27E, struct.pack("<HHHI", 1, 1, 0, (9 << 2) | 2))
    sheet += rec(0xFD, struct.pack("<HHHI", 1, 0, 0, 1)) + rec(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, (1 << 2) | 2, 0, (2 << 2) | 2, 1)) + rec(0x0A, b"")
    name = b"A"
    length = len(bof) + 4 + 8 + len(name) + len(shared) + 4
    book = bof + rec(0x85, struct.pack("<IHBB", length, 0, len(name), 0) + name) + shared + rec(0x0A, b"") + sheet
    assert R.from_xls(compound(book)) == "[Sheet: A]\ntext\t\t2.5\n中文\t9\n1\t2"


def test_pdf():
    stream = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td [(W) -20 (orld) -300 (x)] TJ ET")
    pdf = (
        b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n"
        b"3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R /Resources <</Font <</F1 5 0 R>>>>>> endobj\n4 0 obj <</Filter /FlateDecode>> stream\n"
        + stream + b"\nendstream endobj\n5 0 obj <</Type /Font>> endobj\ntrailer <</Root 1 0 R>>\n%%EOF"
    )
    assert R.from_pdf(pdf) == "Hello (you)\nWorld x"
    with pytest.raises(R.Unreadable):
        R.from_pdf(b"no")


def test_broken_files_are_counted_not_raised(spark):
    rows = [("a/x.json", dt.datetime(2024, 1, 1), b"{"), ("a/x.txt", dt.datetime(2024, 1, 1), b"\xff\xfe"), ("a/y.md", dt.datetime(2024, 1, 1), b" ok \n"), ("a/z.bin", dt.datetime(2024, 1, 1), b""), ("noext", None, None), ("a/e.csv", None, b"")]
    files = spark.createDataFrame(rows, "filename string, modified_at timestamp, content binary")
    got = {r["filename"]: (r["text"], r["error"] is not None) for r in R.texts(files).collect()}
    assert got == {"a/x.json": (None, True), "a/x.txt": (None, True), "a/y.md": ("ok", False), "a/z.bin": (None, True), "noext": (None, True), "a/e.csv": ("", False)}
