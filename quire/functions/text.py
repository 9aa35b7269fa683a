"""Text of PDF strings: encodings, CMaps, glyph names, dates."""

from __future__ import annotations

import re
import unicodedata
from datetime import UTC, datetime, timedelta, timezone

from quire.functions.pdf_syntax import Name, Reader, SyntaxFault, Text, Word


def utf16(data: bytes, little: bool = False) -> str:
    """Code units to text; surrogates are paired, single ones become U+FFFD."""
    return data[: len(data) // 2 * 2].decode("utf-16-le" if little else "utf-16-be", "replace")


def marked(data: bytes) -> str | None:
    """Text of a string with a byte order mark, else None."""
    if data[:2] == b"\xfe\xff":
        return utf16(data[2:])
    if data[:2] == b"\xff\xfe":
        return utf16(data[2:], True)
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    return None


def text_string(data: bytes) -> str:
    """A metadata string: by its mark, else UTF-16 that shows by its zeros, else UTF-8, else Latin-1 without control characters."""
    if (text := marked(data)) is not None:
        return text
    if len(data) >= 4 and len(data) % 2 == 0:
        for little in (False, True):
            high = data[1::2] if little else data[0::2]
            if high.count(0) * 2 > len(high):
                return utf16(data, little)
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
    return "".join(c for c in text if c in "\t\n\r" or unicodedata.category(c) != "Cc")


#: Where Adobe's StandardEncoding differs from ASCII and has characters of its own above it (fixed values).
_STANDARD = {
    0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "ﬁ", 0xAF: "ﬂ",
    0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿",
    0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—",
    0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}


def _codec(name: str) -> dict[int, str]:
    return {b: bytes([b]).decode(name, "replace") for b in range(256)}


BASES = {
    "WinAnsiEncoding": _codec("cp1252") | {0xAD: "-", 0xA0: " "},
    "MacRomanEncoding": _codec("mac_roman"),
    "MacExpertEncoding": _codec("mac_roman"),
    "StandardEncoding": {b: chr(b) for b in range(0x80)} | _STANDARD,
}

#: Glyph names that Unicode's own names do not give (fixed values).
_GLYPHS = {"space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "bullet": "•", "Euro": "€", "ellipsis": "…", "endash": "–", "emdash": "—", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "quotesinglbase": "‚", "fi": "ﬁ", "fl": "ﬂ", "germandbls": "ß", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "trademark": "™", "copyright": "©", "registered": "®", "degree": "°", "section": "§", "paragraph": "¶", "sterling": "£", "yen": "¥", "cent": "¢", "dagger": "†", "daggerdbl": "‡", "guillemotleft": "«", "guillemotright": "»", "exclamdown": "¡", "questiondown": "¿", "periodcentered": "·", "mu": "µ", "nbspace": " ", "plusminus": "±", "paragrapy": "¶", "pilcrow": "¶", "multiply": "×", "divide": "÷", "logicalnot": "¬", "infinity": "∞", "lessequal": "≤", "greatequal": "≥", "notequal": "≠", "Eth": "Ð", "Thorn": "Þ", "eth": "ð", "thorn": "þ", "Odoubleacute": "Ő", "odoubleacute": "ő", "Gear": "℡", "minus": "−", "product": "∏", "sum": "∑", "sqrt": "√", "integral": "∫", "lambda": "λ", "fleury": "ƒ"}
_DIGITS = dict(zip(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"), "0123456789", strict=True))
_ACCENTS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "macron": "MACRON", "breve": "BREVE", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE"}


def glyph(name: str) -> str | None:
    """The characters of a glyph name: tables, ``uniXXXX``, ``uXXXXX``, letters with accents, Greek letters."""
    name = name.split(".", 1)[0]
    if len(name) == 1:
        return name
    if found := _GLYPHS.get(name) or _DIGITS.get(name):
        return found
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        codes = re.findall("....", m[1]) if m[1] else [m[2]]
        return "".join(chr(c) for c in (int(x, 16) for x in codes) if c < 0x110000)
    for end, accent in _ACCENTS.items():
        if name.endswith(end) and len(name) == len(end) + 1:
            return _named(f"LATIN {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name[0].upper()} WITH {accent}")
    return _named(f"GREEK {'CAPITAL' if name[:1].isupper() else 'SMALL'} LETTER {name.upper()}")


def _named(name: str) -> str | None:
    try:
        return unicodedata.lookup(name)
    except KeyError:
        return None


def differences(array: list) -> dict[int, str]:
    """Codes to characters of a /Differences array; unknown names are left out."""
    out, code = {}, 0
    for x in array:
        if isinstance(x, Name):
            if (text := glyph(x)) is not None and 0 <= code < 256:
                out[code] = text
            code += 1
        elif isinstance(x, int):
            code = x
    return out


def cmap(data: bytes) -> dict[int, str]:
    """A ToUnicode CMap: bfchar, and bfrange with a first target or an array of targets."""
    out: dict[int, str] = {}
    reader, held = Reader(data, refs=False), []
    number = lambda t: int.from_bytes(t, "big")
    while True:
        try:
            value = reader.value()
        except SyntaxFault:
            if reader.at >= len(data):
                return out
            reader.at += 1
            continue
        if not isinstance(value, Word):
            held.append(value)
            continue
        if value == "endbfchar":
            for code, target in zip(held[0::2], held[1::2], strict=False):
                if isinstance(code, Text) and isinstance(target, Text):
                    out[number(code)] = utf16(target)
        elif value == "endbfrange":
            for low, high, target in zip(held[0::3], held[1::3], held[2::3], strict=False):
                if not (isinstance(low, Text) and isinstance(high, Text)):
                    continue
                for i in range(min(number(high) - number(low) + 1, 65536)):
                    if isinstance(target, list):
                        if i < len(target) and isinstance(target[i], Text):
                            out[number(low) + i] = utf16(target[i])
                    elif isinstance(target, Text) and target:
                        last = target[:-2] + ((number(target[-2:]) + i) & 0xFFFF).to_bytes(2, "big")
                        out[number(low) + i] = utf16(last)
        held = []


def font_text(data: bytes, font: dict | None) -> str:
    """A shown string: by ToUnicode, else by base encoding and differences, else by mark, else UTF-8 or Windows' Latin."""
    if font and (table := font.get("to_unicode")):
        if font.get("composite"):
            return "".join(table.get(data[i] << 8 | data[i + 1], "") for i in range(0, len(data) - 1, 2))
        return "".join(table.get(b, chr(b)) for b in data)
    if (text := marked(data)) is not None:
        return text
    if font:
        base = BASES.get(font.get("encoding") or ("StandardEncoding" if font.get("subtype") == "Type1" else ""))
        own = font.get("differences") or {}
        if base or own:
            base = base or BASES["StandardEncoding"]
            return "".join(own.get(b) or base.get(b, "�") for b in data)
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


_DATE = re.compile(r"(?:D:)?(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(?:(Z)|([+-])(\d{2})'?(\d{2})?'?)?")


def pdf_date(text: str | None) -> tuple[datetime, int] | None:
    """(UTC time, offset in seconds) of ``D:YYYYMMDDhhmmss`` with an offset or without (UTC); days past a month's end run on into the next one. Else None."""
    m = _DATE.match((text or "").strip())
    if not m:
        return None
    year, month, day, hour, minute, second = (int(m[i]) for i in range(1, 7))
    if not (year and 1 <= month <= 12 and 1 <= day <= 31 and hour < 24 and minute < 60 and second < 60):
        return None
    offset = (int(m[9]) * 3600 + int(m[10] or 0) * 60) * (-1 if m[8] == "-" else 1) if m[8] else 0
    try:
        local = datetime(year, month, 1, hour, minute, second, tzinfo=timezone(timedelta(seconds=offset))) + timedelta(days=day - 1)
        return local.astimezone(UTC), offset
    except (ValueError, OverflowError):
        return None
