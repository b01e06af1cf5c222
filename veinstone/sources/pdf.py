"""A small reader of PDF text: enough for plain documents with simple fonts.

Objects are found by their markers (also in compressed object streams), pages are followed from the catalogue in order,
and the strings that a page's content shows are put together; a move to another line starts a new one. Strings are taken
as single-byte text, or as UTF-16 where they say so; fonts with encodings of their own and encrypted files are not read.
An empty page gives an empty text.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|/[^\s/\[\]()<>]+|[A-Za-z'\"][A-Za-z0-9*'\"]*|T\*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _stream(body: bytes) -> bytes:
    m = _STREAM.match(body)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            first, count = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"First", b"N"))
            inner = _stream(body)
            numbers = [int(x) for x in inner[:first].split()[: 2 * count]]
            starts = [*numbers[1::2], len(inner) - first]
            found |= {n: inner[first + a : first + b] for n, a, b in zip(numbers[::2], starts, starts[1:], strict=False)}
    return found


def _named(body: bytes, key: bytes) -> list[int]:
    """Numbers of the objects that a key of a dictionary points to: one, or a list."""
    m = re.search(rb"/%s\s*(\[.*?\]|\d+\s+\d+\s+R)" % key, body, re.S)
    return [int(x) for x in _REF.findall(m[1])] if m else []


def _pages(objects: dict[int, bytes], number: int) -> list[bytes]:
    body = objects.get(number, b"")
    kids = _named(body, b"Kids")
    return [p for k in kids for p in _pages(objects, k)] if kids else [body] if re.search(rb"/Type\s*/Page\b", body) else []


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _shown(content: bytes) -> str:
    out: list[str] = []
    stack: list[bytes] = []
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]" or t[:1] in b"-.0123456789/":
            stack.append(t)
            continue
        if t in (b"'", b'"', b"T*", b"ET", b"Tm") or (t in (b"Td", b"TD") and len(stack) >= 2 and float(stack[-1] or 0) != 0):
            out.append("\n")
        if t in (b"Tj", b"'", b'"', b"TJ"):
            strings = [s for s in stack if s[:1] in b"(<"]
            wide = [s for s in stack if re.fullmatch(rb"-\d{3,}(\.\d+)?", s)] if t == b"TJ" else []
            out.append((" " if wide and all(not s.strip(b"()") for s in strings) else "").join(map(_string, strings)))
        stack = []
    return "".join(out)


def pages(data: bytes) -> list[str]:
    """The texts of a file's pages, in order."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = _objects(data)
    roots = [n for body in objects.values() if re.search(rb"/Type\s*/Catalog", body) for n in _named(body, b"Pages")]
    found = [p for r in roots for p in _pages(objects, r)]
    return ["\n".join(_shown(_stream(objects.get(n, b""))) for n in _named(p, b"Contents")) for p in found]
