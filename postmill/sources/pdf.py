"""Text of PDF files, for uploaded documents: page streams, their text operators and the fonts' character maps.

Read are plain and FlateDecode streams, object streams, one-byte fonts and two-byte fonts with a ToUnicode map.
What is shown is taken in the order of the page's content; a new line begins where the position moves down, a space
where it moves on. Encrypted files are an error, other filters (images, old compressions) are passed over.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|/[^\s/\[\]()<>]*|[-+]?\d*\.?\d+|[\[\]]|[A-Za-z'\"*]+", re.S)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Unreadable(ValueError):
    """No PDF file, or one that is encrypted."""


def _inflated(head: bytes, body: bytes) -> bytes:
    if b"/Filter" not in head:
        return body
    if b"FlateDecode" in head and not re.search(rb"DCTDecode|LZWDecode|ASCII85Decode|ASCIIHexDecode|CCITTFaxDecode|JPXDecode", head):
        try:
            return zlib.decompressobj().decompress(body)
        except zlib.error:
            return b""
    return b""


class _File:
    def __init__(self, content: bytes):
        if not content.lstrip()[:5] == b"%PDF-":
            raise Unreadable("the file is no PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", content):
            raise Unreadable("the PDF is encrypted")
        self.objects: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        for m in _OBJECT.finditer(content):
            number, body = int(m[1]), m[2]
            if s := _STREAM.match(body):
                self.objects[number], self.streams[number] = s[1], _inflated(s[1], s[2])
            else:
                self.objects[number] = body
        for number in [n for n, head in self.objects.items() if b"/ObjStm" in head]:
            self._unpack(self.objects[number], self.streams.get(number, b""))

    def _unpack(self, head: bytes, data: bytes) -> None:
        first = re.search(rb"/First\s+(\d+)", head)
        if not first:
            return
        start = int(first[1])
        numbers = [int(x) for x in data[:start].split()]
        places = list(zip(numbers[::2], numbers[1::2]))
        for k, (number, at) in enumerate(places):
            end = places[k + 1][1] if k + 1 < len(places) else len(data) - start
            self.objects.setdefault(number, data[start + at : start + end])

    def value(self, body: bytes, key: bytes) -> bytes:
        """What a dictionary has under a key, references followed; empty if it has nothing."""
        m = re.search(re.escape(key) + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if ref := re.match(_REF.pattern, rest):
            return self.objects.get(int(ref[1]), b"")
        return _balanced(rest)

    def pages(self, number: int, inherited: bytes = b"", seen: frozenset = frozenset()):
        """(page, resources) below a node of the page tree, in order."""
        body = self.objects.get(number, b"")
        if number in seen:
            return
        resources = self.value(body, b"/Resources") or inherited
        if re.search(rb"/Type\s*/Pages\b", body) or b"/Kids" in body:
            for kid in _REF.findall(self.value(body, b"/Kids")):
                yield from self.pages(int(kid), resources, seen | {number})
        else:
            yield body, resources

    def root(self) -> int | None:
        for body in self.objects.values():
            if re.search(rb"/Type\s*/Catalog\b", body) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", body)):
                return int(m[1])
        return None

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        if not m:
            return b""
        refs = [int(x) for x in _REF.findall(m[1])]
        if len(refs) == 1 and refs[0] not in self.streams:  # an array of its own
            refs = [int(x) for x in _REF.findall(self.objects.get(refs[0], b""))]
        return b"\n".join(self.streams.get(r, b"") for r in refs)

    def fonts(self, resources: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Of each font its bytes to a character and its character map."""
        out = {}
        for name, ref in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"/Font")):
            body = self.objects.get(int(ref), b"")
            to = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", body)
            chars = _unicode_map(self.streams.get(int(to[1]), b"")) if to else {}
            out[name] = (2 if re.search(rb"/Subtype\s*/Type0\b", body) else 1, chars)
        return out


def _balanced(rest: bytes) -> bytes:
    """The dictionary or array that a text begins with, or its first word."""
    if rest[:2] == b"<<" or rest[:1] == b"[":
        depth = 0
        for m in re.finditer(rb"<<|>>|\[|\]", rest):
            depth += 1 if m[0] in (b"<<", b"[") else -1
            if depth == 0:
                return rest[: m.end()]
        return rest
    return re.match(rb"\S*", rest)[0]


def _hex(s: bytes) -> bytes:
    s = re.sub(rb"\s", b"", s)
    return bytes.fromhex((s + b"0" * (len(s) % 2)).decode())


def _unicode_map(stream: bytes) -> dict[int, str]:
    read = lambda h: _hex(h).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>", block):
            out[int(a, 16)] = read(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f\s]+)>|\[([^\]]*)\])", block):
            lo, hi = int(a, 16), min(int(b, 16), 0xFFFF)
            given = [read(x) for x in re.findall(rb"<([0-9A-Fa-f\s]+)>", many)] if many else None
            for k in range(hi - lo + 1):
                if given is not None:
                    if k < len(given):
                        out[lo + k] = given[k]
                elif base := read(one):
                    out[lo + k] = base[:-1] + chr(ord(base[-1]) + k)
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        return _hex(token[1:-1])
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPE.get(m[1], b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", octal, token[1:-1], flags=re.S)


def _shown(raw: bytes, font: tuple[int, dict[int, str]]) -> str:
    width, chars = font
    if width == 2:
        return "".join(chars.get(raw[i] << 8 | raw[i + 1], "") for i in range(0, len(raw) - 1, 2))
    return "".join(chars[b] if b in chars else bytes([b]).decode("cp1252", "replace") for b in raw)


def _page_text(content: bytes, fonts: dict) -> str:
    out: list[str] = []
    font: tuple[int, dict[int, str]] = (1, {})
    operands: list = []
    row = None  # height of the line that is written
    leading, height, moved = 0.0, 0.0, False

    def show(raw: bytes) -> None:
        nonlocal row, moved
        if row is not None and abs(row - height) > 1e-6:
            out.append("\n")
        elif moved and out and not out[-1].endswith((" ", "\n")):
            out.append(" ")
        row, moved = height, False
        out.append(_shown(raw, font))

    depth: list | None = None
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t == b"[":
            depth = []
        elif t == b"]":
            operands.append(depth or [])
            depth = None
        elif t[:1] in b"(<" and t not in (b"<<", b">>"):
            (operands if depth is None else depth).append(_string(t))
        elif t[:1] == b"/":
            operands.append(t)
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            (operands if depth is None else depth).append(float(t))
        elif t in (b"<<", b">>"):
            continue
        else:
            numbers = [x for x in operands if isinstance(x, float)]
            if t == b"Tf" and operands:
                font = fonts.get(operands[0], (1, {}))
            elif t == b"TL" and numbers:
                leading = numbers[0]
            elif t in (b"Td", b"TD") and len(numbers) >= 2:
                height, moved = height + numbers[-1], True
                if t == b"TD":
                    leading = -numbers[-1]
            elif t == b"Tm" and len(numbers) >= 6:
                height, moved = numbers[5], True
            elif t == b"BT":
                height, moved = 0.0, True
            elif t == b"T*":
                height -= leading or 1.0
            elif t == b"Tj" and operands and isinstance(operands[-1], bytes):
                show(operands[-1])
            elif t in (b"'", b'"') and operands and isinstance(operands[-1], bytes):
                height -= leading or 1.0
                show(operands[-1])
            elif t == b"TJ" and operands and isinstance(operands[-1], list):
                for x in operands[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    elif x < -180:  # a gap as wide as a space
                        moved = True
            operands = []
    return "".join(out)


def pdf_text(content: bytes) -> str:
    """The text of all pages, each ended by a line end."""
    file = _File(content)
    root = file.root()
    if root is None:
        raise Unreadable("the PDF has no pages")
    return "".join(_page_text(file.content(page), file.fonts(resources)).rstrip("\n") + "\n" for page, resources in file.pages(root))
