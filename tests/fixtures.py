"""Documents built in code: EPUB archives and one-page PDF files."""

import io
import struct
import zipfile
import zlib


def png(width=1, height=1):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + b"\xff\0\0" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def epub(bodies, images=None, title="Fixture Book", language="en", encryption=None, spine=None):
    """``bodies``: chapter bodies; ``images``: path under OEBPS -> bytes."""
    out = io.BytesIO()
    names = [f"chapter-{i + 1}" for i in range(len(bodies))]
    items = "".join(f'<item id="{n}" href="text/{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
    refs = "".join(f'<itemref idref="{n}"/>' for n in (spine or names))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> {title} </dc:title><dc:language>{language}</dc:language></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for name, body in zip(names, bodies):
            z.writestr(f"OEBPS/text/{name}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body>{body}</body></html>')
        for path, data in (images or {}).items():
            z.writestr(f"OEBPS/{path}", data)
        if encryption:
            z.writestr("META-INF/encryption.xml", f'<encryption><CipherReference URI="{encryption}"/></encryption>')
    return out.getvalue()


def pdf(pages, title=None, compress=False):
    """A small PDF 1.4 file; ``pages``: lines of text of each page, or one list of lines."""
    pages = [pages] if pages and isinstance(pages[0], str) else pages
    esc = lambda s: s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for lines in pages:
        stream = ("BT /F1 12 Tf 72 720 Td " + " ".join(f"({esc(x)}) Tj 0 -16 Td" for x in lines) + " ET").encode("latin-1")
        extra = b""
        if compress:
            stream, extra = zlib.compress(stream), b" /Filter /FlateDecode"
        objects.append(b"<< /Length %d%s >>\nstream\n" % (len(stream), extra) + stream + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % len(objects))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    info = b""
    if title:
        objects.append(b"<< /Title (" + esc(title).encode("latin-1") + b") >>")
        info = b" /Info %d 0 R" % len(objects)
    out, offsets = b"%PDF-1.4\n", []
    for i, body in enumerate(objects):
        offsets.append(len(out))
        out += b"%d 0 obj\n" % (i + 1) + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return out + b"trailer << /Size %d /Root 1 0 R%s >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, info, start)
