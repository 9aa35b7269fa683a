"""Stream decoders."""

from __future__ import annotations

import zlib

#: Filter names and their abbreviations.
ABBREVIATIONS = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
#: Image formats stay as they are.
UNTOUCHED = ("CCITTFaxDecode", "JBIG2Decode", "DCTDecode", "JPXDecode")
LIMIT = 256 << 20


class FilterFault(ValueError):
    pass


def flate(data: bytes, limit: int = LIMIT) -> bytes:
    decoder = zlib.decompressobj()
    try:
        out = decoder.decompress(data, limit)
    except zlib.error as e:
        raise FilterFault(f"zlib: {e}") from e
    if decoder.unconsumed_tail:
        raise FilterFault(f"more than {limit} bytes after decompression")
    if not decoder.eof:
        raise FilterFault("zlib: unexpected end")
    return out


def ascii_hex(data: bytes) -> bytes:
    digits = data.translate(None, b"\0\t\n\x0c\r >")
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("latin-1"))
    except ValueError as e:
        raise FilterFault("ASCIIHex: invalid digit") from e


def ascii85(data: bytes) -> bytes:
    """Groups of n characters give n - 1 bytes; a last group is padded with ``u``, and one of a single character is an error."""
    text = data.translate(None, b"\0\t\n\x0c\r ")
    if text.startswith(b"<~"):
        text = text[2:]
    text = text.split(b"~", 1)[0]
    out, group = bytearray(), []
    for c in text:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
            continue
        if not 33 <= c <= 117:
            raise FilterFault("ASCII85: invalid character")
        group.append(c - 33)
        if len(group) == 5:
            out += _group(group)
            group = []
    if len(group) == 1:
        raise FilterFault("ASCII85: a last group of one character")
    if group:
        out += _group(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _group(digits: list[int]) -> bytes:
    value = 0
    for d in digits:
        value = value * 85 + d
    if value >> 32:
        raise FilterFault("ASCII85: group out of range")
    return value.to_bytes(4, "big")


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        part = data[i + 1 : i + 2 + n] if n < 128 else data[i + 1 : i + 2] * (257 - n)
        if len(part) != (n + 1 if n < 128 else 257 - n):
            raise FilterFault("RunLength: cut short")
        out += part
        i += n + 2 if n < 128 else 2
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, the most significant bit first; 256 clears the table and 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        code = held >> (bits - width)
        bits -= width
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = [], 9, b""
            continue
        if code == 257:
            return bytes(out)
        if code < 256:
            entry = bytes([code])
        elif code - 258 < len(table):
            entry = table[code - 258]
        elif code - 258 == len(table) and last:
            entry = last + last[:1]
        else:
            raise FilterFault("LZW: invalid code")
        out += entry
        if last and len(table) < 4096 - 258:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 258 + early).bit_length()))
    return bytes(out)


_DECODERS = {"FlateDecode": flate, "ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii85, "RunLengthDecode": run_length, "LZWDecode": lzw}


def decode(data: bytes, names: list[str], limit: int = LIMIT) -> bytes:
    """The filters one after the other; an unknown one is an error."""
    for name in names:
        name = ABBREVIATIONS.get(name, name)
        if name in UNTOUCHED:
            continue
        if name not in _DECODERS:
            raise FilterFault(f"unsupported filter {name}")
        data = flate(data, limit) if name == "FlateDecode" else _DECODERS[name](data)
        if len(data) > limit:
            raise FilterFault(f"more than {limit} bytes after {name}")
    return data


def predicted(data: bytes, predictor: int, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Undoes PNG predictors (10 and up); 1 changes nothing, and TIFF's 2 is an error."""
    if predictor < 2:
        return data
    if predictor < 10:
        raise FilterFault("unsupported predictor")
    step = max(1, colors * bits // 8)
    size = (columns * colors * bits + 7) // 8
    out, before = bytearray(), bytes(size)
    for at in range(0, len(data) - size, size + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + size])
        for i in range(size):
            left = row[i - step] if i >= step else 0
            up, corner = before[i], before[i - step] if i >= step else 0
            if kind == 1:
                add = left
            elif kind == 2:
                add = up
            elif kind == 3:
                add = (left + up) // 2
            elif kind == 4:
                nearest = left + up - corner
                add = min((left, up, corner), key=lambda v: abs(nearest - v))
            else:
                add = 0
            row[i] = (row[i] + add) & 255
        out += row
        before = bytes(row)
    return bytes(out)


def trimmed(data: bytes) -> tuple[bytes, bool]:
    """data up to the first line end before ``endstream``, and whether there was one."""
    for end in (b"\r\nendstream", b"\nendstream", b"\rendstream"):
        if (at := data.find(end)) >= 0:
            return data[:at], True
    return data, False
