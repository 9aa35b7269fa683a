"""PDF values and files to bytes, and the rewriting of a file as a single revision."""

from __future__ import annotations

from quire.functions.pdf_syntax import HexText, Name, Ref, Stream, Text

_PLAIN = frozenset(b"!\"$&'*+,-.0123456789:;=?@ABCDEFGHIJKLMNOPQRSTUVWXYZ\\^_`abcdefghijklmnopqrstuvwxyz|~")


def value_bytes(value) -> bytes:
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return f"{value:.10f}".rstrip("0").rstrip(".").encode() or b"0"
    if isinstance(value, Ref):
        return str(value).encode()
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([b]) if b in _PLAIN else b"#%02X" % b for b in value.encode())
    if isinstance(value, HexText):
        return b"<" + value.digits().encode() + b">"
    if isinstance(value, Text):
        return b"(" + value.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"
    if isinstance(value, list):
        return b"[" + b" ".join(map(value_bytes, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b"".join(b" " + value_bytes(Name(k)) + b" " + value_bytes(v) for k, v in value.items()) + b" >>"
    if isinstance(value, Stream):
        return value_bytes(value.dict | {"Length": len(value.data)}) + b"\nstream\n" + value.data + b"\nendstream"
    raise TypeError(f"{type(value).__name__} is no PDF value")


def rewritten(data: bytes) -> bytes:
    """The newest revision alone: header, live objects in ascending order, their values as they are written, one table, one trailer. Members of object streams become objects of their own;
    /ID and /Encrypt stay in the trailer, with generations as they are. Raises ValueError without a root."""
    from quire.sources.pdf import PdfFile

    pdf = PdfFile(data)
    root = pdf.root()
    if root is None:
        raise ValueError("no root")
    out = bytearray(f"%PDF-{pdf.header_version or '1.7'}\n%\u00e2\u00e3\u00cf\u00d3\n".encode("latin-1", "replace"))
    nums = sorted(n for n, e in pdf.index.items() if e["kind"] != "free") or sorted(pdf.scan())
    places = []
    for num in nums:
        value = pdf.object(num)
        kind = (value.dict if isinstance(value, Stream) else {}).get("Type")
        if value is None or kind in ("XRef", "ObjStm"):
            continue
        gen = (pdf.index.get(num) or {}).get("gen_num") or 0
        places.append((num, gen, len(out)))
        out += b"%d %d obj\n" % (num, gen) + (value_bytes(value) if (raw := pdf.raw(num)) is None else raw) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for num, gen, at in places:
        out += b"%d 1\n%010d %05d n \n" % (num, at, gen)
    trailer = {"Size": (places[-1][0] if places else 0) + 1, "Root": root} | {k: v for k in ("Info", "ID", "Encrypt") if (v := pdf.trailer(k)) is not None}
    return bytes(out + b"trailer\n" + value_bytes(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)
