"""Content streams: operators, and the text that they show."""

from __future__ import annotations

from quire.functions.pdf_syntax import Name, Reader, SyntaxFault, Text, Word
from quire.functions.text import font_text

#: The operators of content streams.
OPERATORS = frozenset("b B b* B* BDC BI BMC BT BX c cm CS cs d d0 d1 Do DP EI EMC ET EX f F f* G g gs h i ID j J K k l m M MP n q Q re RG rg ri s S SC sc SCN scn sh T* Tc Td TD Tf Tj TJ TL Tm Tr Ts Tw Tz v w W W* y ' \"".split())
#: A smaller number between strings is a space, in thousandths of text space.
GAP = -250


def operators(data: bytes) -> list[tuple[str, list]]:
    """(operator, operands) in order; what can't be read is skipped byte by byte, unknown words with their operands."""
    reader, held, out = Reader(data, refs=False), [], []
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
        if value == "ID":  # an inline image's bytes
            end = data.find(b"EI", reader.at)
            reader.at = len(data) if end < 0 else end
        if value in OPERATORS:
            out.append((str(value), held))
        held = []


def shown(parsed: list[tuple[str, list]], fonts: dict[str, dict] | None = None) -> str:
    """The text between BT and ET: a space before a further Tj and after a wide gap in TJ, a new line for ', ", T* and steps down."""
    fonts, out = fonts or {}, []
    inside = spaced = False
    font = None
    size = 0

    def add(text: str) -> None:
        nonlocal size
        out.append(text)
        size += len(text)

    for op, args in parsed:
        if op in ("BT", "ET"):
            inside, spaced, font = op == "BT", False, None
        elif op == "Tf":
            font = fonts.get(args[0].removeprefix("/")) if args and isinstance(args[0], Name) else None
        elif not inside:
            continue
        elif op == "Tj" and args and isinstance(args[0], Text):
            if spaced and size:
                add(" ")
            add(font_text(args[0], font))
            spaced = True
        elif op == "TJ" and args and isinstance(args[0], list):
            before = None
            for x in args[0]:
                if isinstance(x, Text):
                    if spaced and size and isinstance(before, int | float) and before < GAP:
                        add(" ")
                    add(font_text(x, font))
                    spaced = True
                before = x
        elif op in ("'", '"') and len(args) >= (1 if op == "'" else 3) and isinstance(args[-1], Text):
            if size:
                add("\n")
            add(font_text(args[-1], font))
            spaced = True
        elif op == "T*":
            if size:
                add("\n")
            spaced = False
        elif op in ("Td", "TD") and len(args) >= 2 and all(isinstance(x, int | float) for x in args[:2]):
            if args[1] < 0 and size:
                add("\n")
            if args[0] < -50 and spaced and size:
                add(" ")
            spaced = False
    return "".join(out).strip()
