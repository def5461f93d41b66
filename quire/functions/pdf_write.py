"""A small PDF writer: A4 pages, 64-point margins, Helvetica, headings, paragraphs, lists, quotes, code, tables, images."""

from __future__ import annotations

import re
import zlib

from .html_tree import BLOCKS, Node, parse

WIDTH, HEIGHT, MARGIN = 595.28, 841.89, 64
SIZES = {"h1": 24, "h2": 18, "h3": 14, "h4": 14, "h5": 14, "h6": 14}
BODY = 11


def _wide(text: str, size: float, mono: bool = False) -> float:
    """Width of a line: Courier exactly, Helvetica by classes of letters."""
    if mono:
        return 0.6 * size * len(text)
    return size * sum(0.278 if c in " .,:;!'|iIjltf()[]/\\" else 0.833 if c in "mwMW@%" else 0.667 if c.isupper() else 0.556 for c in text)


class _Page:
    def __init__(self) -> None:
        self.out: list[bytes] = []


def _literal(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", raw) + b")"


class Writer:
    def __init__(self) -> None:
        self.pages: list[_Page] = []
        self.images: list[tuple[bytes, int, int]] = []
        self.y = 0.0

    def new_page(self) -> None:
        self.pages.append(_Page())
        self.y = HEIGHT - MARGIN

    def line(self, text: str, size: float, indent: float = 0, mono: bool = False) -> None:
        if not self.pages or self.y - size * 1.4 < MARGIN:
            self.new_page()
        self.y -= size * 1.4
        font = b"/F2" if mono else b"/F1"
        self.pages[-1].out.append(b"BT %s %.2f Tf %.2f %.2f Td %s Tj ET" % (font, size, MARGIN + indent, self.y, _literal(text)))

    def text(self, text: str, size: float = BODY, indent: float = 0, mono: bool = False) -> None:
        room = WIDTH - 2 * MARGIN - indent
        for row in text.split("\n"):
            if mono:
                step = max(1, int(room / (0.6 * size)))
                for i in range(0, max(1, len(row)), step):
                    self.line(row[i : i + step], size, indent, True)
                continue
            now = ""
            for word in row.split():
                if now and _wide(now + " " + word, size) > room:
                    self.line(now, size, indent)
                    now = word
                else:
                    now = (now + " " + word).strip()
            if now:
                self.line(now, size, indent)
        self.y -= size * 0.6

    def image(self, jpeg: bytes, width: int, height: int) -> None:
        scale = min(1.0, (WIDTH - 2 * MARGIN) / width, (HEIGHT - 2 * MARGIN) / height)
        w, h = width * scale, height * scale
        if not self.pages or self.y - h < MARGIN:
            self.new_page()
        self.y -= h
        self.images.append((jpeg, width, height))
        self.pages[-1].out.append(b"q %.2f 0 0 %.2f %.2f %.2f cm /I%d Do Q" % (w, h, MARGIN, self.y, len(self.images)))
        self.y -= BODY

    def bytes(self, title: str = "") -> bytes:
        objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>", b"<< /Title %s >>" % _literal(title)]
        names = b""
        for i, (data, w, h) in enumerate(self.images):
            objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n" % (w, h, len(data)) + data + b"\nendstream")
            names += b" /I%d %d 0 R" % (i + 1, len(objects))
        kids = []
        for page in self.pages or [_Page()]:
            raw = zlib.compress(b"\n".join(page.out))
            objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(raw) + raw + b"\nendstream")
            objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> /XObject <<%s >> >> >>" % (WIDTH, HEIGHT, len(objects), names))
            kids.append(len(objects))
        objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
        out, at = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
        for i, body in enumerate(objects):
            at.append(len(out))
            out += b"%d 0 obj\n" % (i + 1) + body + b"\nendobj\n"
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in at)
        return bytes(out + b"trailer << /Size %d /Root 1 0 R /Info 5 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start))


def _flat(node: Node) -> str:
    return re.sub(r"\s+", " ", node.text()).strip()


def lay_out(writer: Writer, html: str, picture=None, indent: float = 0) -> list[tuple[str, str]]:
    """Put rendered HTML on pages.  ``picture(src)`` gives (JPEG bytes, width, height), an error text, or None to leave it out.

    Returns (source, reason) of images that were skipped.
    """
    skipped: list[tuple[str, str]] = []

    def images(node: Node) -> None:
        for n in node.walk():
            if n.tag == "img" and picture:
                got = picture(n.attrs.get("src", ""))
                if isinstance(got, str):
                    skipped.append((n.attrs.get("src", ""), got))
                elif got:
                    writer.image(*got)

    def put(node: Node, indent: float) -> None:
        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    writer.text(c.strip(), BODY, indent)
            elif c.tag in SIZES:
                writer.text(_flat(c), SIZES[c.tag], indent)
            elif c.tag in ("ul", "ol"):
                for i, item in enumerate(c.named("li")):
                    own = Node("p")
                    own.children = [x for x in item.children if isinstance(x, str) or x.tag not in ("ul", "ol")]
                    writer.text(f"{i + 1}. {_flat(own)}" if c.tag == "ol" else f"\u2022 {_flat(own)}", BODY, indent + 12)
                    images(own)
                    for x in item.named("ul", "ol"):
                        holder = Node("#list")
                        holder.children = [x]
                        put(holder, indent + 12)
            elif c.tag == "blockquote":
                put(c, indent + 18)
            elif c.tag == "pre":
                writer.text(c.text().strip("\n"), BODY - 2, indent, True)
            elif c.tag == "table":
                for row in (x for x in c.walk() if x.tag == "tr"):
                    writer.text(" | ".join(_flat(x) for x in row.named("td", "th")), BODY, indent)
            elif c.tag == "hr":
                writer.text("\u2014" * 8, BODY, indent)
            elif c.tag in BLOCKS and any(not isinstance(x, str) and x.tag in BLOCKS for x in c.children):
                put(c, indent)
            else:
                if _flat(c):
                    writer.text(_flat(c), BODY, indent)
                images(c)

    put(parse(html), indent)
    return skipped
