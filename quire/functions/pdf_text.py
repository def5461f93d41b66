"""Reading the text layer and images of digital PDF files with the standard library.

Scope: objects found by scanning (so a broken cross-reference table does no harm), object streams, FlateDecode with PNG
predictors, page trees, ``Tj TJ ' "`` with ``Td TD T* Tm``, literal and hex strings in Latin-1 or by a ToUnicode map; images
that are JPEG or 8-bit RGB or grey samples.  Encrypted files are refused.
"""

from __future__ import annotations

import re
import struct
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)


class Pdf:
    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"%PDF-"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise PermissionError("the file is encrypted")
        self.objects: dict[int, bytes] = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        self.trailer = b" ".join(re.findall(rb"trailer\s*(<<.*?>>)\s*startxref", data, re.S))
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)
            elif b"/XRef" in body:
                self.trailer += body.split(b"stream", 1)[0]

    def _unpack(self, body: bytes) -> None:
        raw = self.stream(body)
        n, first = self._int(body, b"N"), self._int(body, b"First")
        head = list(map(int, raw[:first].split()[: 2 * n]))
        spots = list(zip(head[::2], head[1::2])) + [(0, len(raw) - first)]
        for (number, at), (_, end) in zip(spots[:-1], spots[1:]):
            self.objects.setdefault(number, raw[first + at : first + end])

    def _int(self, body: bytes, key: bytes, default: int = 0) -> int:
        m = re.search(rb"/" + key + rb"\s+(\d+)(\s+\d+\s+R)?", body)
        if not m:
            return default
        return int(self.objects.get(int(m[1]), b"0").strip() or 0) if m[2] else int(m[1])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        head = body[: m.start()]
        size = self._int(head, b"Length")
        raw = body[m.start(1) : m.start(1) + size] if size and size <= len(body) - m.start(1) else m[1]
        if b"/FlateDecode" in head or b"/Fl " in head:
            raw = zlib.decompressobj().decompress(raw)
            if self._int(head, b"Predictor", 1) >= 10:
                raw = _unpredict(raw, self._int(head, b"Columns", 1) * max(1, self._int(head, b"Colors", 1)), max(1, self._int(head, b"Colors", 1)))
        return raw

    def _refs(self, body: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", body)
        if not m:
            return []
        if m[2]:
            target = self.objects.get(int(m[2]), b"").strip()
            if target.startswith(b"["):
                return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", target)]
            return [int(m[2])]
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]

    def pages(self) -> list[bytes]:
        """Page objects in reading order."""
        out: list[bytes] = []
        seen: set[int] = set()

        def walk(n: int) -> None:
            if n in seen:
                return
            seen.add(n)
            body = self.objects.get(n, b"")
            kids = self._refs(body, b"Kids")
            if kids:
                for k in kids:
                    walk(k)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body)

        for n, body in self.objects.items():
            if re.search(rb"/Type\s*/Catalog\b", body):
                for k in self._refs(body, b"Pages"):
                    walk(k)
        return out or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def _resources(self, page: bytes) -> bytes:
        """The page's own resources, else those of the nearest node above it in the page tree."""
        node, seen = page, set()
        while b"/Resources" not in node:
            up = re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", node)
            if not up or int(up[1]) in seen:
                return page
            seen.add(int(up[1]))
            node = self.objects.get(int(up[1]), b"")
        m = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", node)
        return self.objects.get(int(m[1]), b"") if m else node

    def _named(self, resources: bytes, kind: bytes) -> dict[bytes, int]:
        m = re.search(rb"/" + kind + rb"\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", resources, re.S)
        if not m:
            return {}
        body = self.objects.get(int(m[2]), b"") if m[2] else m[1]
        return {a: int(b) for a, b in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", body)}

    def _font_map(self, number: int) -> dict[int, str] | None:
        for n in self._refs(self.objects.get(number, b""), b"ToUnicode"):
            cmap = self.stream(self.objects.get(n, b""))
            out: dict[int, str] = {}
            text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
                for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    out[int(a, 16)] = text(b)
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
                for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    base = text(c)
                    for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                        out[k] = base[:-1] + chr(ord(base[-1]) + k - int(a, 16))
            return out | {-1: "2" if re.search(rb"begincodespacerange\s*<[0-9A-Fa-f]{4}>", cmap) else "1"}
        return None

    def page_text(self, page: bytes) -> str:
        content = b"\n".join(self.stream(self.objects.get(n, b"")) for n in self._refs(page, b"Contents"))
        fonts = {name: self._font_map(n) for name, n in self._named(self._resources(page), b"Font").items()}
        return _shown(content, fonts)

    def page_images(self, page: bytes) -> list[tuple[str, bytes]]:
        """(name, file bytes) of the images of a page."""
        out = []
        for name, n in self._named(self._resources(page), b"XObject").items():
            body = self.objects.get(n, b"")
            head = body.split(b"stream", 1)[0]
            if b"/Image" not in head:
                continue
            if b"/DCTDecode" in head:
                m = _STREAM.search(body)
                out.append((name.decode("latin-1"), m[1] if m else b""))
            elif self._int(head, b"BitsPerComponent") == 8:
                w, h, raw = self._int(head, b"Width"), self._int(head, b"Height"), self.stream(body)
                colors = 3 if b"/DeviceRGB" in head else 1
                if len(raw) >= w * h * colors:
                    out.append((name.decode("latin-1"), png(w, h, raw, colors)))
        return out

    def title(self) -> str | None:
        for n in self._refs(self.trailer, b"Info"):
            m = re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", self.objects.get(n, b""), re.S)
            if m:
                raw = _string(m[1])
                text = raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
                return text.strip() or None
        return None


def _unpredict(raw: bytes, width: int, step: int) -> bytes:
    out, before = bytearray(), bytearray(width)
    for i in range(0, len(raw) - width, width + 1):
        kind, row = raw[i], bytearray(raw[i + 1 : i + 1 + width])
        for k in range(width):
            a = row[k - step] if k >= step else 0
            b = before[k]
            c = before[k - step] if k >= step else 0
            if kind == 1:
                row[k] = (row[k] + a) & 255
            elif kind == 2:
                row[k] = (row[k] + b) & 255
            elif kind == 3:
                row[k] = (row[k] + (a + b) // 2) & 255
            elif kind == 4:
                p = a + b - c
                best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
                row[k] = (row[k] + best[2]) & 255
        out += row
        before = row
    return bytes(out)


def png(width: int, height: int, samples: bytes, colors: int) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + samples[y * width * colors : (y + 1) * width * colors] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if colors == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m):
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


_TOKENS = re.compile(rb"(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))|(<[0-9A-Fa-f\s]*>)|(\[)|(\])|/([^\s/<>\[\]()]*)|([-+]?\d*\.?\d+)|([A-Za-z'\"*]+\*?)", re.S)


def _shown(content: bytes, fonts: dict) -> str:
    """Text in the order in which it is shown; a new line where the text position moves down or starts anew."""
    lines, line = [], []
    stack: list = []
    mapping, array, y, shown_y, leading, fresh = None, None, 0.0, None, 0.0, False

    def plain(raw: bytes) -> str:
        if mapping is None:
            return raw.decode("cp1252", "replace")
        width = int(mapping.get(-1, "1"))
        codes = [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)]
        return "".join(mapping.get(c, chr(c) if width == 1 else "") for c in codes)

    def show(text: str) -> None:
        nonlocal shown_y, fresh
        if line and (fresh or (shown_y is not None and abs(y - shown_y) > 1)):
            lines.append("".join(line))
            line.clear()
        fresh, shown_y = False, y
        line.append(text)

    for m in _TOKENS.finditer(content):
        if m[1] is not None or m[2] is not None:
            value = _string(m[1] if m[1] is not None else m[2])
            (stack if array is None else array).append(value)
        elif m[3]:
            array = []
        elif m[4]:
            if array is not None:
                stack.append(array)
            array = None
        elif m[5] is not None:
            stack.append(m[5])
        elif m[6]:
            (stack if array is None else array).append(float(m[6]))
        else:
            op = m[7]
            number = lambda k: next((v for v in [stack[k]] if isinstance(v, float)), 0.0) if len(stack) >= -k else 0.0
            if op == b"Tf" and len(stack) > 1:
                mapping = fonts.get(stack[-2])
            elif op in (b"Td", b"TD"):
                y += number(-1)
                leading = -number(-1) if op == b"TD" else leading
                fresh |= number(-1) != 0
            elif op == b"TL":
                leading = number(-1)
            elif op == b"T*":
                y -= leading
                fresh = True
            elif op == b"Tm":
                y = number(-1)
            elif op == b"BT":
                y, fresh = 0.0, fresh or bool(line)
            elif op in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                if op != b"Tj":
                    y -= leading
                    fresh = True
                show(plain(stack[-1]))
            elif op == b"TJ" and stack and isinstance(stack[-1], list):
                show("".join(plain(x) if isinstance(x, bytes) else " " if x < -200 else "" for x in stack[-1]))
            stack.clear()
    if line:
        lines.append("".join(line))
    return "\n".join(lines)
