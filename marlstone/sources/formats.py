"""Readers: the text of files of 27 kinds. Each takes bytes and gives text, or fails.

Failures are counted per file and never end a run.
"""

from __future__ import annotations

import csv
import html.parser
import io
import json
import re
import struct
import tomllib
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import WHITE

#: Fixed value: rows of a sheet after which it is cut, with a line that says so.
SHEET_ROWS = 10_000


class Unreadable(ValueError):
    """A file that its reader can't read."""


def utf8(data: bytes) -> str:
    return data.decode("utf-8")


# -- structured values

def _scalar(v: Any) -> str | None:
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, str | int | float) else None


def flattened(value: Any, path: str = "", order: bool = True) -> Iterator[str]:
    """``path: scalar`` lines, depth first. Nulls, dates and scalars that stand in an array have none."""
    if isinstance(value, dict):
        for k in sorted(value, key=str) if order else value:
            at = f"{path}.{k}" if path else str(k)
            s = _scalar(value[k])
            if s is None:
                yield from flattened(value[k], at, order)
            else:
                yield f"{at}: {s}"
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from flattened(x, f"{path}[{i}]", order)


class _Yaml(yaml.SafeLoader):
    """YAML 1.2 scalars: only true and false are booleans, dates stay text."""


_Yaml.yaml_implicit_resolvers = {
    k: [x for x in v if x[0] not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_Yaml.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def from_json(data: bytes) -> str:
    return "\n\n".join(flattened(json.loads(utf8(data))))


def from_yaml(data: bytes) -> str:
    return "\n\n".join(flattened(yaml.load(utf8(data), _Yaml), order=False))  # noqa: S506  (a safe loader)


def from_toml(data: bytes) -> str:
    return "\n\n".join(flattened(tomllib.loads(utf8(data))))


def from_csv(data: bytes) -> str:
    """Tab-joined rows, the header first; a row of another width makes the file unreadable."""
    rows = [r for r in csv.reader(io.StringIO(utf8(data), newline="")) if r]
    if any(len(r) != len(rows[0]) for r in rows):
        raise Unreadable("rows of unlike widths")
    return "\n".join("\t".join(r) for r in rows)


# -- HTML

_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre blockquote".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _Blocks(html.parser.HTMLParser):
    """Text per block element; a block inside a block is in both."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.blocks: list[list[str]] = []
        self.all: list[str] = []
        self.body: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: object) -> None:
        if tag in _ENDS_P:
            self._end({"p"})
        self._end(_ENDS.get(tag, set()), until={"ul", "ol", "table"})
        if tag == "body" and self.body is None:
            self.body, self.blocks = [], []
        if tag not in _VOID:
            block: list[str] | None = [] if tag in _BLOCKS else None
            if block is not None:
                self.blocks.append(block)
            self.open.append((tag, block))

    def _end(self, tags: set[str], until: frozenset[str] | set[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in until:
                return
            if self.open[i][0] in tags:
                del self.open[i:]
                return

    def handle_endtag(self, tag: str) -> None:
        self._end({tag})

    def handle_data(self, data: str) -> None:
        if t := data.strip(WHITE):
            self.all.append(t)
            if self.body is not None:
                self.body.append(t)
            for _, block in self.open:
                if block is not None:
                    block.append(t)


def from_html(data: bytes) -> str:
    parser = _Blocks()
    parser.feed(utf8(data))
    parser.close()
    blocks = [" ".join(b) for b in parser.blocks if b]
    return "\n\n".join(blocks) if blocks else " ".join(parser.all if parser.body is None else parser.body)


# -- office files

def _members(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def from_docx(data: bytes) -> str:
    """Each run of text as a paragraph of its own."""
    with _members(data) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join(t.text for t in tree.iter() if t.tag.endswith("}t") and t.text and t.text.strip(WHITE))


def _sheet_text(name: str, rows: Iterator[list[str]]) -> list[str]:
    lines = [f"[Sheet: {name}]"]
    for n, row in enumerate(rows):
        if n >= SHEET_ROWS:
            lines.append(f"... (truncated, exceeded {SHEET_ROWS} rows)")
            break
        if any(c.strip(WHITE) for c in row):
            lines.append("\t".join(row))
    return lines


def _number(text: str) -> str:
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x.is_integer() and abs(x) < 1e16 else repr(x)


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def from_xlsx(data: bytes) -> str:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with _members(data) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        lines: list[str] = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet"):
            target = (targets.get(sheet.get(rel)) or "").lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))

            def rows(tree: ElementTree.Element = tree) -> Iterator[list[str]]:
                for row in tree.iter(f"{ns}row"):
                    cells: list[str] = []
                    for c in row.iter(f"{ns}c"):
                        at = _column(c.get("r") or "") if c.get("r") else len(cells)
                        cells += [""] * (at - len(cells))
                        v, kind = c.findtext(f"{ns}v") or "", c.get("t")
                        if kind == "s":
                            v = shared[int(v)] if v else ""
                        elif kind == "inlineStr":
                            v = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                        elif kind == "b":
                            v = "true" if v == "1" else "false"
                        elif kind in (None, "n") and v:
                            v = _number(v)
                        cells.append(v)
                    yield cells

            lines += _sheet_text(sheet.get("name") or "", rows())
    return "\n".join(lines)


def from_ods(data: bytes) -> str:
    t = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
    o = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
    x = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
    with _members(data) as z:
        tree = ElementTree.fromstring(z.read("content.xml"))
    lines: list[str] = []
    for sheet in tree.iter(f"{t}table"):

        def rows(sheet: ElementTree.Element = sheet) -> Iterator[list[str]]:
            for row in sheet.iter(f"{t}table-row"):
                cells: list[str] = []
                for c in row:
                    if c.tag not in (f"{t}table-cell", f"{t}covered-table-cell"):
                        continue
                    value = c.get(f"{o}value")
                    text = _number(value) if value is not None else "\n".join("".join(p.itertext()) for p in c.iter(f"{x}p"))
                    times = int(c.get(f"{t}number-columns-repeated") or 1)
                    cells += [text] * (times if text or times < 1000 else 0)
                while cells and not cells[-1]:
                    cells.pop()
                times = int(row.get(f"{t}number-rows-repeated") or 1)
                for _ in range(times if cells else 1):
                    yield cells

        lines += _sheet_text(sheet.get(f"{t}name") or "", rows())
    return "\n".join(lines)


def _xlsb_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    i = 0
    while i < len(data):
        kind, i = data[i], i + 1
        if kind & 0x80:
            kind, i = (kind & 0x7F) | (data[i] << 7), i + 1
        size = shift = 0
        while True:
            b, i = data[i], i + 1
            size |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                break
        yield kind, data[i : i + size]
        i += size


def _wide(data: bytes, at: int) -> str:
    n = struct.unpack_from("<I", data, at)[0]
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace")


def _packed_number(n: int) -> float:
    """An RK number: 30 bits of a double or of an integer, perhaps hundredths."""
    x = float((n >> 2) - (1 << 30 if n & 0x80000000 else 0)) if n & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", n & 0xFFFFFFFC))[0]
    return x / 100 if n & 1 else x


def from_xlsb(data: bytes) -> str:
    with _members(data) as z:
        names = set(z.namelist())
        shared = [_wide(r, 1) for k, r in _xlsb_records(z.read("xl/sharedStrings.bin")) if k == 19] if "xl/sharedStrings.bin" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.bin.rels"))}
        lines: list[str] = []
        for kind, r in _xlsb_records(z.read("xl/workbook.bin")):
            if kind != 156:
                continue
            rid = _wide(r, 8)
            name = _wide(r, 8 + 4 + 2 * len(rid))
            sheet = z.read("xl/" + (targets.get(rid) or "").removeprefix("/xl/"))

            def rows(sheet: bytes = sheet) -> Iterator[list[str]]:
                cells: list[str] | None = None
                for k, c in _xlsb_records(sheet):
                    if k == 0:
                        if cells is not None:
                            yield cells
                        cells = []
                    elif 1 <= k <= 11 and cells is not None:
                        at = struct.unpack_from("<I", c)[0]
                        v = ""
                        if k == 2:
                            v = _number(repr(_packed_number(struct.unpack_from("<I", c, 8)[0])))
                        elif k in (4, 10):
                            v = "true" if c[8] else "false"
                        elif k in (5, 9):
                            v = _number(repr(struct.unpack_from("<d", c, 8)[0]))
                        elif k in (6, 8):
                            v = _wide(c, 8)
                        elif k == 7:
                            v = shared[struct.unpack_from("<I", c, 8)[0]]
                        cells += [""] * (at - len(cells)) + [v]
                if cells is not None:
                    yield cells

            lines += _sheet_text(name, rows())
    return "\n".join(lines)


def _compound_stream(data: bytes, wanted: tuple[str, ...]) -> bytes:
    """A stream of a compound file (the container of old office files)."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise Unreadable("not a compound file")
    size = 1 << struct.unpack_from("<H", data, 30)[0]
    small = 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, cutoff, first_mini = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
    sector = lambda n: data[512 + n * size - (512 - size if size > 512 else 0) :][:size] if size == 512 else data[(n + 1) * size : (n + 2) * size]
    heads = list(struct.unpack_from("<109I", data, 76))
    more, left = struct.unpack_from("<I", data, 68)[0], struct.unpack_from("<I", data, 72)[0]
    while left and more < 0xFFFFFFFA:
        block = struct.unpack(f"<{size // 4}I", sector(more))
        heads += block[:-1]
        more, left = block[-1], left - 1
    fat = [x for h in heads if h < 0xFFFFFFFA for x in struct.unpack(f"<{size // 4}I", sector(h))]

    def chain(n: int, table: list[int], get: Callable[[int], bytes]) -> bytes:
        out, seen = [], 0
        while n < 0xFFFFFFFA and seen <= len(table):
            out.append(get(n))
            n, seen = table[n], seen + 1
        return b"".join(out)

    entries = chain(first_dir, fat, sector)
    found: tuple[int, int] | None = None
    root = (0xFFFFFFFE, 0)
    for i in range(0, len(entries), 128):
        e = entries[i : i + 128]
        n = struct.unpack_from("<H", e, 64)[0]
        name, place = e[: max(0, n - 2)].decode("utf-16-le", "replace"), (struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<I", e, 120)[0])
        if e[66] == 5:
            root = place
        elif name in wanted:
            found = place
    if found is None:
        raise Unreadable("no workbook inside")
    if found[1] >= cutoff:
        return chain(found[0], fat, sector)[: found[1]]
    mini = chain(root[0], fat, sector)
    table = [x for x in struct.unpack(f"<{len(m) // 4}I", m)] if (m := chain(first_mini, fat, sector)) else []
    return chain(found[0], table, lambda n: mini[n * small : (n + 1) * small])[: found[1]]


class _Strings:
    """Reads the shared strings of an old workbook, which may go on in further records."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
            got = self.parts[self.part][self.at : self.at + n]
            out, self.at, n = out + got, self.at + len(got), n - len(got)
        return out

    def chars(self, n: int, wide: bool) -> str:
        out = ""
        while n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                wide = bool(self.take(1)[0] & 1)  # a string that goes on says anew how wide it is
            room = (len(self.parts[self.part]) - self.at) // (2 if wide else 1)
            k = min(n, room)
            raw = self.take(k * (2 if wide else 1))
            out += raw.decode("utf-16-le", "replace") if wide else raw.decode("latin-1")
            n -= k
        return out

    def next(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        text = self.chars(n, bool(flags & 1))
        self.take(4 * runs + extra)
        return text


def from_xls(data: bytes) -> str:
    book = _compound_stream(data, ("Workbook", "Book"))
    records: list[tuple[int, int, bytes]] = []
    i = 0
    while i + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, i)
        records.append((i, kind, book[i + 4 : i + 4 + size]))
        i += 4 + size
    sheets: list[tuple[int, str]] = []
    shared: list[str] = []
    for n, (_, kind, r) in enumerate(records):
        if kind == 0x85:
            at, size, wide = struct.unpack_from("<I", r)[0], r[6], r[7] & 1
            sheets.append((at, r[8 : 8 + size * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")))
        elif kind == 0xFC:
            parts = [r[8:]]
            for _, k, more in records[n + 1 :]:
                if k != 0x3C:
                    break
                parts.append(more)
            reader = _Strings(parts)
            shared = [reader.next() for _ in range(struct.unpack_from("<I", r, 4)[0])]
    lines: list[str] = []
    for at, name in sheets:
        cells: dict[int, dict[int, str]] = {}
        pending: tuple[int, int] | None = None
        for where, kind, r in records:
            if where < at:
                continue
            if kind == 0x0A:
                break
            if kind in (0x203, 0x27E, 0xFD, 0x205, 0x06, 0x204):
                row, col = struct.unpack_from("<HH", r)
                v = ""
                if kind == 0x203:
                    v = _number(repr(struct.unpack_from("<d", r, 6)[0]))
                elif kind == 0x27E:
                    v = _number(repr(_packed_number(struct.unpack_from("<I", r, 6)[0])))
                elif kind == 0xFD:
                    v = shared[struct.unpack_from("<I", r, 6)[0]]
                elif kind == 0x205:
                    v = "" if r[7] else ("true" if r[6] else "false")
                elif kind == 0x204:
                    n, wide = struct.unpack_from("<HB", r, 6)
                    v = r[9 : 9 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
                elif r[12:14] == b"\xff\xff":
                    pending = (row, col) if r[6] == 0 else None
                    v = ("true" if r[8] else "false") if r[6] == 1 else ""
                else:
                    v = _number(repr(struct.unpack_from("<d", r, 6)[0]))
                cells.setdefault(row, {})[col] = v
            elif kind == 0xBD:
                row, col = struct.unpack_from("<HH", r)
                for k in range((len(r) - 6) // 6):
                    cells.setdefault(row, {})[col + k] = _number(repr(_packed_number(struct.unpack_from("<I", r, 6 + 6 * k)[0])))
            elif kind == 0x207 and pending:
                n, wide = struct.unpack_from("<HB", r)
                cells.setdefault(pending[0], {})[pending[1]] = r[3 : 3 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
                pending = None
        lines += _sheet_text(name, ([cells[row].get(c, "") for c in range(max(cells[row]) + 1)] for row in sorted(cells)))
    return "\n".join(lines)


# -- PDF

_PDF_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_PDF_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/[^\s/\[\]()<>]+|[A-Za-z'\"*]+", re.S)


def _pdf_string(token: bytes, table: dict[int, str], wide: bool) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else named.get(m[1], m[1]), token[1:-1], flags=re.S)
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if table:
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if wide else list(raw)
        return "".join(table.get(c, chr(c) if not wide and c >= 32 else "") for c in codes)
    return raw.decode("cp1252", "replace")


def _pdf_table(cmap: bytes) -> tuple[dict[int, str], bool]:
    table: dict[int, str] = {}
    wide = bool(re.search(rb"<[0-9A-Fa-f]{4}>\s*<[0-9A-Fa-f]{4}>\s*endcodespacerange", cmap))
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            table[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for k in range(min(int(z, 16) - int(a, 16) + 1, 65536)):
                table[int(a, 16) + k] = text(b)[:-1] + chr(ord(text(b)[-1]) + k)
    return table, wide


def from_pdf(data: bytes) -> str:
    """Text that pages show, in the order of their content; files without it give an empty text."""
    if not data.lstrip()[:5].startswith(b"%PDF"):
        raise Unreadable("not a PDF")
    if b"/Encrypt" in data:
        raise Unreadable("an encrypted PDF")
    objects: dict[int, bytes] = {int(n): body for n, body in _PDF_OBJECT.findall(data)}

    def stream(body: bytes) -> bytes | None:
        m = _PDF_STREAM.match(body)
        if not m:
            return None
        if b"FlateDecode" not in m[1]:
            return m[2]
        try:
            return zlib.decompressobj().decompress(m[2])
        except zlib.error:
            return None

    for body in list(objects.values()):
        if b"/ObjStm" in body.split(b"stream")[0] and (inner := stream(body)):
            count, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
            numbers = list(map(int, inner[:first].split()))[: 2 * count]
            places = [*numbers[1::2], len(inner) - first]
            for k, n in enumerate(numbers[::2]):
                objects.setdefault(n, inner[first + places[k] : first + places[k + 1]])
    ref = lambda body, key: [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/%s\s*(\[.*?\]|\d+\s+\d+\s+R)" % key, body, re.S) or [b"", b""])[1])]
    order: list[int] = []

    def pages(n: int, depth: int = 0) -> None:
        body = objects.get(n, b"")
        if depth < 50 and b"/Kids" in body:
            for k in ref(body, b"Kids"):
                pages(k, depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            order.append(n)

    root = re.search(rb"/Root\s+(\d+)", data)
    for n in ref(objects.get(int(root[1]), b""), b"Pages") if root else []:
        pages(n)
    order = order or sorted(n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b))
    tables: dict[int, tuple[dict[int, str], bool]] = {}
    for n, body in objects.items():
        for t in ref(body, b"ToUnicode"):
            if (cmap := stream(objects.get(t, b""))) is not None:
                tables[n] = _pdf_table(cmap)
    out = []
    for n in order:
        body = objects[n]
        around = body + b"".join(objects.get(r, b"") for r in ref(body, b"Resources"))
        fonts = {m[0]: int(m[1]) for m in re.findall(rb"(/[^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R", around + b"".join(objects.get(r, b"") for r in ref(around, b"Font")))}
        shown: list[str] = []
        table: tuple[dict[int, str], bool] = ({}, False)
        stack: list[bytes] = []
        for token in _PDF_TOKEN.findall(b"\n".join(s for c in ref(body, b"Contents") if (s := stream(objects.get(c, b""))) is not None)):
            if token == b"Tf":
                font = next((t for t in reversed(stack) if t[:1] == b"/"), b"")
                table = tables.get(fonts.get(font, -1), ({}, False))
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"'):
                    shown.append("\n")
                for t in stack:
                    if t[:1] in b"(<":
                        shown.append(_pdf_string(t, *table))
                    elif token == b"TJ" and re.fullmatch(rb"-\d+\.?\d*", t) and float(t) < -200:
                        shown.append(" ")
            elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                shown.append("\n")
            if re.fullmatch(rb"[A-Za-z'\"*]+", token):
                stack = []
            else:
                stack.append(token)
        out.append(re.sub(r"\n{2,}", "\n", "".join(shown)).strip())
    return "\n\n".join(x for x in out if x)


READERS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys("md rs go py js mjs cjs jsx ts mts cts tsx txt log".split(), utf8), "json": from_json, "yaml": from_yaml, "yml": from_yaml,
    "toml": from_toml, "csv": from_csv, "html": from_html, "htm": from_html, "pdf": from_pdf, "docx": from_docx, "xlsx": from_xlsx,
    "xls": from_xls, "xlsb": from_xlsb, "ods": from_ods,
}


def read(ending: str, data: bytes) -> tuple[str | None, str | None]:
    """Text and no error, or no text and an error."""
    reader = READERS.get(ending.lower())
    if reader is None:
        return None, f"no reader for {ending or 'files without an extension'}"
    try:
        return reader(data).strip(WHITE), None
    except Exception as e:  # noqa: BLE001  (whatever a broken file makes a reader do)
        return None, f"{type(e).__name__}: {e}"[:500]


def texts(files: DataFrame) -> DataFrame:
    """``files`` (filename, modified_at, content as bytes) with ``text`` and ``error`` in place of the bytes."""
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType

    schema = StructType([StructField("filename", StringType()), StructField("modified_at", TimestampType()), StructField("text", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [n.rpartition(".")[2] if "." in n.rpartition("/")[2] else "" for n in b["filename"].to_pylist()]
            got = [read(e, d or b"") for e, d in zip(ends, b["content"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b["filename"], b["modified_at"], pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["filename", "modified_at", "text", "error"]
            )

    return files.select("filename", "modified_at", F.col("content")).mapInArrow(run, schema)
