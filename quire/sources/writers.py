"""Writers of test packages and files, independent of the readers: they share no code with them."""

from __future__ import annotations

import base64
import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr


def ofd(entries: dict[str, bytes | str]) -> bytes:
    """A package of entries; equal entries give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def ofd_document(pages: list[list[str]], box: str = "0 0 210 297", version: str = "1.1", boxes: list[str | None] | None = None, more: dict[str, bytes | str] | None = None) -> bytes:
    """A package with a page for each list of text codes."""
    space = 'xmlns:ofd="http://www.ofdspec.org/2016"'
    refs = "".join(f'<ofd:Page ID="{i + 1}" BaseLoc="Pages/Page_{i}/Content.xml"/>' for i in range(len(pages)))
    entries: dict[str, bytes | str] = {
        "OFD.xml": f'<?xml version="1.0" encoding="UTF-8"?><ofd:OFD {space} Version="{version}" DocType="OFD"><ofd:DocBody><ofd:DocRoot>Doc_0/Document.xml</ofd:DocRoot></ofd:DocBody></ofd:OFD>',
        "Doc_0/Document.xml": f'<?xml version="1.0" encoding="UTF-8"?><ofd:Document {space}><ofd:CommonData><ofd:PageArea><ofd:PhysicalBox>{box}</ofd:PhysicalBox></ofd:PageArea></ofd:CommonData><ofd:Pages>{refs}</ofd:Pages></ofd:Document>',
    }
    for i, codes in enumerate(pages):
        area = f"<ofd:Area><ofd:PhysicalBox>{boxes[i]}</ofd:PhysicalBox></ofd:Area>" if boxes and boxes[i] else ""
        body = "".join(f'<ofd:TextObject ID="{k + 1}" Boundary="0 {k} 100 5" Font="1" Size="3.5"><ofd:TextCode X="0" Y="{k}">{escape(c)}</ofd:TextCode></ofd:TextObject>' for k, c in enumerate(codes))
        entries[f"Doc_0/Pages/Page_{i}/Content.xml"] = f'<?xml version="1.0" encoding="UTF-8"?><ofd:Page {space}>{area}<ofd:Content><ofd:Layer>{body}</ofd:Layer></ofd:Content></ofd:Page>'
    return ofd(entries | (more or {}))


def ofd_resources(fonts: list[tuple[int, str, str]]) -> str:
    return "<Res><Fonts>" + "".join(f"<Font ID={quoteattr(str(i))} FontName={quoteattr(n)}><FontFile>{escape(f)}</FontFile></Font>" for i, n, f in fonts) + "</Fonts></Res>"


def ofd_annotations(pages: dict[int, list[str]]) -> dict[str, str]:
    """Entries of an index and of a page's annotations: page id to types."""
    index = "".join(f'<Page PageID="{p}"><FileLoc>Doc_0/Annots/Page_{p}.xml</FileLoc></Page>' for p in pages)
    out = {"Doc_0/Annots/Annotations.xml": f"<Annotations>{index}</Annotations>"}
    for p, types in pages.items():
        out[f"Doc_0/Annots/Page_{p}.xml"] = "<PageAnnot>" + "".join(f'<Annot ID="{i + 1}" Type={quoteattr(t)}><Appearance Boundary="0 0 1 1"/></Annot>' for i, t in enumerate(types)) + "</PageAnnot>"
    return out


def ofd_signatures(locations: list[tuple[int, str]]) -> str:
    return "<Signatures>" + "".join(f'<Signature ID="{i}"><SignedInfo><Seal><BaseLoc>{escape(loc)}</BaseLoc></Seal></SignedInfo></Signature>' for i, loc in locations) + "</Signatures>"


def png(width: int, height: int) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def pdf_string(text: str) -> str:
    """UTF-16 with a mark, in hex digits."""
    return "<FEFF" + text.encode("utf-16-be").hex().upper() + ">"


def pdf(objects: dict[int, bytes], root: int = 1, info: int | None = None, version: str = "1.7", trailer: str = "", previous: tuple[bytes, int] | None = None, offsets: dict[int, int] | None = None) -> bytes:
    """A file, or with previous (bytes, its startxref) an incremental update of it. offsets: wrong ones to write."""
    out = bytearray(previous[0] if previous else f"%PDF-{version}\n".encode())
    places = {}
    for num, body in objects.items():
        places[num] = len(out)
        out += f"{num} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n"
    if not previous:
        out += b"0 1\n0000000000 65535 f \n"
    for num in sorted(places):
        out += f"{num} 1\n{(offsets or {}).get(num, places[num]):010d} 00000 n \n".encode()
    size = max(objects, default=0) + 1
    keys = f"/Size {size}" + (f" /Root {root} 0 R" if root else "") + (f" /Info {info} 0 R" if info else "") + (f" /Prev {previous[1]}" if previous else "") + trailer
    return bytes(out + f"trailer\n<< {keys} >>\nstartxref\n{start}\n%%EOF\n".encode())


def pdf_stream(data: bytes, keys: str = "") -> bytes:
    return f"<< /Length {len(data)}{keys} >>\nstream\n".encode() + data + b"\nendstream"


def pdf_packed(objects: dict[int, bytes], predictor: bool = False, keys: str = "") -> bytes:
    """A file of PDF 1.5's kind: what is no stream stands in an object stream, and the index is a cross-reference stream."""
    packed = {n: b for n, b in objects.items() if not b.endswith(b"endstream")}
    holder = max(objects) + 1
    heads, body = [], b""
    for num, value in packed.items():
        heads.append(f"{num} {len(body)}")
        body += value + b" "
    head = (" ".join(heads) + " ").encode()
    out, places = bytearray(b"%PDF-1.4\n"), {}
    alone = {n: b for n, b in objects.items() if n not in packed}
    alone[holder] = pdf_stream(zlib.compress(head + body), f" /Type /ObjStm /N {len(packed)} /First {len(head)} /Filter /FlateDecode")
    for num, value in alone.items():
        places[num] = len(out)
        out += f"{num} 0 obj\n".encode() + value + b"\nendobj\n"
    start = places[holder + 1] = len(out)
    member = {num: i for i, num in enumerate(packed)}
    rows = [bytes(7)]
    for num in range(1, holder + 2):
        kind, a, b = (2, holder, member[num]) if num in member else (1, places[num], 0) if num in places else (0, 0, 0)
        rows.append(bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big"))
    if predictor:
        rows = [b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)) for row, above in zip(rows, [bytes(7), *rows], strict=False)]
    parms = " /DecodeParms << /Predictor 12 /Columns 7 >>" if predictor else ""
    index = pdf_stream(zlib.compress(b"".join(rows)), f" /Type /XRef /Size {holder + 2} /W [1 4 2] /Root 1 0 R /Filter /FlateDecode{parms}{keys}")
    return bytes(out + f"{holder + 1} 0 obj\n".encode() + index + f"\nendobj\nstartxref\n{start}\n%%EOF\n".encode())


def pdf_literal(text: str) -> str:
    """UTF-16 with a mark as a literal string, with escapes of all kinds."""
    short = {0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t", 0x08: "\\b", 0x0C: "\\f", 0x28: "\\(", 0x29: "\\)", 0x5C: "\\\\"}
    return "(" + "".join(short.get(b) or (chr(b) if 0x20 <= b < 0x7F else f"\\{b:03o}") for b in b"\xfe\xff" + text.encode("utf-16-be")) + ")"


FILTERS = ("FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "LZWDecode")


def encoded(data: bytes, name: str) -> bytes:
    """data as a filter's decoder reads it."""
    if name == "FlateDecode":
        return zlib.compress(data)
    if name == "ASCIIHexDecode":
        return data.hex().encode() + b">"
    if name == "ASCII85Decode":
        return base64.a85encode(data) + b"~>"
    if name == "RunLengthDecode":
        return b"".join(bytes([len(p) - 1]) + p for p in (data[i : i + 128] for i in range(0, len(data), 128))) + b"\x80"
    codes, known, held = [(256, 9)], {}, b""
    width = lambda entries: min(12, max(9, entries.bit_length()))
    code = lambda x: x[0] if len(x) == 1 else known[x]
    size = 258
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if len(longer) == 1 or longer in known:
            held = longer
            continue
        codes.append((code(held), width(size)))
        known[longer], size, held = size, size + 1, longer[-1:]
        if size == 4094:
            codes.append((256, 12))
            known, size = {}, 258
    if held:
        codes.append((code(held), width(size)))
    bits = "".join(f"{c:0{w}b}" for c, w in [*codes, (257, width(size + 1))])
    return int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")


def pdf_document(pages: list[list[str]], title: str | None = None, author: str | None = None, created: str | None = None, filters: tuple[str, ...] = (), version: str = "1.7", trailer: str = "", fan: int = 8, box: str = "0 0 612 792") -> bytes:
    """A document with a page for each list of lines; a tree of nodes with fan kids each. The box is the root's, the fonts are the pages'."""
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    free = 5
    entries = (f" /Title {pdf_string(title)}" if title is not None else "") + (f" /Author {pdf_string(author)}" if author is not None else "") + (f" /CreationDate ({created})" if created else "")
    objects[4] = f"<<{entries} >>".encode()
    leaves = []
    for lines in pages:
        body = "BT /F1 12 Tf " + " ".join(f"{pdf_string(x)} Tj T*" for x in lines) + " ET"
        data = body.encode()
        for name in reversed(filters):
            data = encoded(data, name)
        keys = f" /Filter [{' '.join('/' + f for f in filters)}]" if filters else ""
        objects[free + 1] = pdf_stream(data, keys)
        leaves.append((free, lambda parent, at=free: f"<< /Type /Page /Parent {parent} 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {at + 1} 0 R >>".encode()))
        free += 2
    level = leaves
    while len(level) > fan:
        above = []
        for i in range(0, len(level), fan):
            group = level[i : i + fan]
            for num, make in group:
                objects[num] = make(free)
            kids = " ".join(f"{num} 0 R" for num, _ in group)
            above.append((free, lambda parent, kids=kids, n=len(group): f"<< /Type /Pages /Parent {parent} 0 R /Count {n} /Kids [{kids}] >>".encode()))
            free += 1
        level = above
    for num, make in level:
        objects[num] = make(2)
    objects[2] = f"<< /Type /Pages /Count {len(pages)} /MediaBox [{box}] /Kids [{' '.join(f'{n} 0 R' for n, _ in level)}] >>".encode()
    return pdf(dict(sorted(objects.items())), info=4, version=version, trailer=trailer)
