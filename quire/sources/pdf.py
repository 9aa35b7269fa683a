"""PDF files to rows: each file is read once, by one Arrow function, into nested columns; a broken file gives a row with an error."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import text as texts
from quire.functions.content import operators, shown
from quire.functions.filters import FilterFault, decode, predicted, trimmed
from quire.functions.pdf_syntax import HexText, Name, Reader, Ref, Stream, SyntaxFault, Text, get, plain

#: Limits.
DEPTH, STREAM_BYTES, XREF_BYTES, TAIL, FALLBACK = 64, 64 << 20, 10_000_000, 1024, 10 << 20
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj(?![A-Za-z])")
_ENTRY = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
_PAIR = re.compile(rb"\s*(\d+)\s+(\d+)(?=\s)")
Number = (int, float)

SCHEMA = """path string, size_bytes bigint, error string, header_version string, startxref bigint, warnings array<string>,
features struct<declared:string,effective:string,traditional_xref:boolean,xref_stream:boolean,hybrid:boolean,object_streams:boolean,incremental:boolean,linearized:boolean,eof:boolean,encrypted:boolean,xmp:boolean,info:boolean>,
encrypt struct<present:boolean,empty:boolean,v:bigint,r:bigint,cfm:string>,
info struct<page_count:bigint,ids:array<string>,title:string,author:string,creator:string,producer:string,created:timestamp,created_offset:int,modified:timestamp,modified_offset:int,xmp:string>,
sections array<struct<rank:int,offset:bigint,kind:string,prev:bigint,root:string,size:bigint>>,
xref array<struct<rank:int,obj_num:bigint,gen_num:bigint,kind:string,offset:bigint,stm:bigint,idx:bigint>>,
objects array<struct<obj_num:bigint,gen_num:bigint,offset:bigint,found:boolean,json:string>>,
nodes array<struct<obj_num:bigint,type:string,is_root:boolean,kids:array<bigint>,media_box:array<double>,rotate:bigint>>,
pages array<struct<leaf_no:int,page_no:int,obj_ref:string,parent:string,resources:string,media_box:array<double>,rotate:bigint,contents:array<string>,fonts:array<struct<name:string,subtype:string,base_font:string,encoding:string>>,texts:array<string>,content:binary,error:string>>,
findings array<struct<level:string,severity:string,ord:int,message:string>>"""
#: What a reader may leave out.
PARTS = ("objects", "pages", "text", "content", "findings")


class PdfFile:
    def __init__(self, data: bytes):
        self.data, self.warnings = data, []
        self._cache: dict[int, object] = {}
        self._scan: dict[int, tuple[int, int]] | None = None
        self._streams: dict[int, list[tuple[int, bytes, int]]] = {}
        self.sections: list[dict] = []
        self.entries: list[dict] = []
        self.startxref = self._find_startxref()
        self._walk()
        self.index: dict[int, dict] = {}
        for e in self.entries:
            self.index.setdefault(e["obj_num"], e)

    @property
    def header_version(self) -> str | None:
        return self.data[5:64].split(b"\n", 1)[0].split(b"\r", 1)[0].strip().decode("latin-1") if self.data.startswith(b"%PDF-") else None

    def _find_startxref(self) -> int | None:
        tail = self.data[-TAIL:]
        at = tail.rfind(b"startxref")
        m = re.match(rb"\s*(\d+)", tail[at + 9 :]) if at >= 0 else None
        if m:
            return int(m[1])
        return self._last_xref("startxref marker not found or unreadable")

    def _last_xref(self, why: str) -> int | None:
        low = max(0, len(self.data) - FALLBACK)
        at = max(self.data.rfind(b"\nxref", low), self.data.rfind(b"\rxref", low))
        if at >= 0:
            self.warnings.append(f"{why}; last xref table used")
            return at + 1
        return None

    def _walk(self) -> None:
        at, seen = self.startxref, set()
        while at is not None and at not in seen and 0 <= at < len(self.data):
            seen.add(at)
            try:
                section = self._section(at)
            except (SyntaxFault, FilterFault) as e:
                if not self.sections and len(seen) == 1 and (other := self._last_xref(f"no cross-reference section at {at}: {e}")) is not None and other not in seen:
                    at = other
                    continue
                self.warnings.append(f"cross-reference section at {at}: {e}")
                return
            self._add(section)
            extra = get(section["trailer"], "XRefStm", int)
            if section["kind"] == "table" and extra is not None:
                try:
                    self._add(self._section(extra))
                except (SyntaxFault, FilterFault) as e:
                    self.warnings.append(f"cross-reference stream at {extra}: {e}")
            at = get(section["trailer"], "Prev", int)

    def _add(self, section: dict) -> None:
        section["rank"] = len(self.sections)
        self.sections.append(section)
        self.entries += [e | {"rank": section["rank"]} for e in section["entries"]]

    def _section(self, at: int) -> dict:
        data = self.data
        start = re.compile(rb"\s*").match(data, at).end()
        if data.startswith(b"xref", start):
            entries, pos = [], start + 4
            while m := _PAIR.match(data, pos):
                pos = m.end()
                for num in range(int(m[1]), int(m[1]) + int(m[2])):
                    row = _ENTRY.match(data, pos)
                    if not row:
                        break
                    pos = row.end()
                    entries.append({"obj_num": num, "gen_num": int(row[2]), "kind": "direct" if row[3] == b"n" else "free", "offset": int(row[1]), "stm": None, "idx": None})
            reader = Reader(data, pos)
            if reader.value() != "trailer":
                raise SyntaxFault("no trailer")
            trailer = reader.value()
            if not isinstance(trailer, dict):
                raise SyntaxFault("trailer is no dictionary")
            return {"offset": at, "kind": "table", "trailer": trailer, "entries": entries}
        if not _OBJECT.match(data, start):
            raise SyntaxFault("neither a table nor a stream")
        stream = self._at(start)[1]
        if not isinstance(stream, Stream):
            raise SyntaxFault("no stream")
        if len(stream.data) > XREF_BYTES:
            raise SyntaxFault("cross-reference stream too long")
        body = self.decoded(stream)
        widths = [w for w in get(stream.dict, "W", list) or [] if isinstance(w, int)]
        if len(widths) != 3 or min(widths) < 0 or not sum(widths):
            raise SyntaxFault("no widths")
        ranges = get(stream.dict, "Index", list) or [0, get(stream.dict, "Size", int) or 0]
        entries, pos = [], 0
        for first, n in zip(ranges[0::2], ranges[1::2], strict=False):
            for num in range(first, first + n):
                row = body[pos : pos + sum(widths)]
                if len(row) < sum(widths):
                    break
                pos += len(row)
                kind = int.from_bytes(row[: widths[0]], "big") if widths[0] else 1
                a = int.from_bytes(row[widths[0] : widths[0] + widths[1]], "big")
                b = int.from_bytes(row[widths[0] + widths[1] :], "big")
                own = {"obj_num": num, "gen_num": 0 if kind == 2 else b, "kind": {1: "direct", 2: "stream"}.get(kind, "free"), "offset": a if kind == 1 else None, "stm": a if kind == 2 else None, "idx": b if kind == 2 else None}
                entries.append(own)
        return {"offset": at, "kind": "stream", "trailer": stream.dict, "entries": entries}

    def scan(self) -> dict[int, tuple[int, int]]:
        """Object number to (offset, generation) of its last ``N G obj`` in the file."""
        if self._scan is None:
            self._scan = {int(m[1]): (m.start(), int(m[2])) for m in _OBJECT.finditer(self.data)}
        return self._scan

    def _at(self, at: int) -> tuple[Ref, object]:
        m = _OBJECT.match(self.data, at)
        if not m:
            raise SyntaxFault(f"no object at {at}")
        reader = Reader(self.data, m.end())
        value = reader.value()
        reader.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", reader.at):
            start = reader.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else self.data[start : start + 1] in (b"\n", b"\r")
            value = Stream(value, start, self._body(value, start))
        return Ref(int(m[1]), int(m[2])), value

    def raw(self, num: int) -> bytes | None:
        """The value of an object as it is written; None if it stands in an object stream or can't be read, or is a stream whose own length isn't that of its body."""
        entry, at = self.index.get(num), self.located(num)[0]
        if at is None or entry and entry["kind"] != "direct":
            return None
        start = _OBJECT.match(self.data, at).end()
        reader, value = Reader(self.data, start), self.object(num)
        try:
            written = reader.value()
        except SyntaxFault:
            return None
        text = self.data[start : reader.at].strip(b"\0\t\n\x0c\r ")
        if not isinstance(value, Stream):
            return text
        own = isinstance(written, dict) and written.get("Length") == len(value.data) and not isinstance(written["Length"], bool)
        return text + b"\nstream\n" + value.data + b"\nendstream" if own else None

    def _body(self, d: dict, start: int) -> bytes:
        length = d.get("Length")
        if isinstance(length, Ref):
            length = self.object(length)
        if isinstance(length, int) and 0 <= length <= STREAM_BYTES and re.compile(rb"\s*endstream").match(self.data, start + length):
            return self.data[start : start + length]
        end = self.data.find(b"endstream", start)
        if end < 0:
            end = len(self.data)
        if end - start > STREAM_BYTES:
            raise SyntaxFault("stream over the limit")
        return trimmed(self.data[start : end + 9])[0] if end < len(self.data) else self.data[start:end]

    def located(self, num: int) -> tuple[int | None, bool]:
        """(offset, whether the table is right about it) of an object outside of object streams."""
        entry = self.index.get(num)
        if entry and entry["kind"] == "direct":
            at = re.compile(rb"[\0\t\n\x0c\r ]*").match(self.data, min(entry["offset"], len(self.data))).end()
            m = _OBJECT.match(self.data, at)
            if m and int(m[1]) == num:
                return at, True
        found = self.scan().get(num)
        return (found[0] if found else None), False

    def object(self, ref: Ref | int):
        """The value of a reference; None (null) if it is free, missing or broken."""
        num = ref.num if isinstance(ref, Ref) else ref
        if num in self._cache:
            return self._cache[num]
        self._cache[num] = None
        entry, value = self.index.get(num), None
        try:
            if num == 0 or entry and entry["kind"] == "free":
                value = None
            elif entry and entry["kind"] == "stream":
                members = self._members(entry["stm"])
                value = next((Reader(body, at).value() for n, body, at in members if n == num), None)
            else:
                at, _ = self.located(num)
                value = None if at is None else self._at(at)[1]
        except (SyntaxFault, FilterFault, RecursionError):
            value = None
        self._cache[num] = value
        return value

    def _members(self, num: int) -> list[tuple[int, bytes, int]]:
        if num not in self._streams:
            self._streams[num] = []
            stream = self.object(num)
            if isinstance(stream, Stream):
                body = self.decoded(stream)
                n, first = get(stream.dict, "N", int) or 0, get(stream.dict, "First", int) or 0
                head = [int(x) for x in re.findall(rb"\d+", body[:first])[: 2 * n]]
                self._streams[num] = [(a, body, first + b) for a, b in zip(head[0::2], head[1::2], strict=False)]
        return self._streams[num]

    def get(self, d, key: str, kind):
        """d[key], followed if it is a reference, if of kind."""
        value = d.get(key) if isinstance(d, dict) else None
        if isinstance(value, Ref):
            value = self.object(value)
        if isinstance(value, Stream) and kind is dict:
            value = value.dict
        return value if isinstance(value, kind) and not (isinstance(value, bool) and kind is not bool) else None

    def decoded(self, stream: Stream) -> bytes:
        def some(value) -> list:
            value = self.object(value) if isinstance(value, Ref) else value
            return [self.object(v) if isinstance(v, Ref) else v for v in value] if isinstance(value, list) else [value]

        names = [str(x) for x in some(stream.dict.get("Filter")) if isinstance(x, Name)]
        parms = some(stream.dict.get("DecodeParms"))
        data = stream.data
        for i, name in enumerate(names):
            data = decode(data, [name])
            own = parms[i] if i < len(parms) else None
            if isinstance(own, dict) and (get(own, "Predictor", int) or 1) > 1:
                data = predicted(data, own["Predictor"], get(own, "Columns", int) or 1, get(own, "Colors", int) or 1, get(own, "BitsPerComponent", int) or 8)
        return data

    def trailer(self, key: str):
        """The value of the newest section that has key."""
        return next((s["trailer"][key] for s in self.sections if key in s["trailer"]), None)

    def root(self) -> Ref | None:
        ref = self.trailer("Root")
        if isinstance(ref, Ref):
            return ref
        for num in sorted(self.scan(), reverse=True):  # no trailer names it
            if get(self.object(num), "Type", Name) == "Catalog":
                self.warnings.append("no trailer with a root; catalog found by its type")
                return Ref(num, self.scan()[num][1])
        return None

    def pages_ref(self) -> Ref | None:
        root = self.root()
        catalog = self.object(root) if root else None
        value = catalog.get("Pages") if isinstance(catalog, dict) else None
        if isinstance(value, list):
            value = next((x for x in value if isinstance(x, Ref)), None)
        return value if isinstance(value, Ref) else None

    def box(self, value) -> list[float] | None:
        value = self.object(value) if isinstance(value, Ref) else value
        if not isinstance(value, list):
            return None
        value = [self.object(v) if isinstance(v, Ref) else v for v in value]
        return [float(v) for v in value] if len(value) == 4 and all(isinstance(v, Number) and not isinstance(v, bool) for v in value) else None

    def leaves(self) -> Iterator[dict]:
        """Leaves of the page tree in order, with what they inherit; nodes deeper than DEPTH or met before are left out."""
        top, seen = self.pages_ref(), set()
        stack = [(top, 0, {})] if top else []
        while stack:
            ref, depth, given = stack.pop()
            if ref.num in seen or depth > DEPTH:
                continue
            seen.add(ref.num)
            d = self.object(ref)
            if not isinstance(d, dict):
                continue
            own = given | {k: d[k] for k in ("MediaBox", "Resources", "Rotate") if d.get(k) is not None}
            kids = self.get(d, "Kids", list)
            if get(d, "Type", Name) == "Page" or kids is None and get(d, "Type", Name) != "Pages":
                yield {"ref": ref, "dict": d, **own}
                continue
            stack += [(k, depth + 1, own) for k in reversed(kids or []) if isinstance(k, Ref)]

    def nodes(self) -> list[dict]:
        """The page tree as it is written: one row a node."""
        top, seen, out = self.pages_ref(), set(), []
        stack = [top] if top else []
        while stack:
            ref = stack.pop()
            d = self.object(ref)
            if ref.num in seen or not isinstance(d, dict):
                continue
            seen.add(ref.num)
            kids = [k for k in self.get(d, "Kids", list) or [] if isinstance(k, Ref)]
            out.append({"obj_num": ref.num, "type": get(d, "Type", Name) or ("Pages" if kids else "Page"), "is_root": ref == top, "kids": [k.num for k in kids], "media_box": self.box(d.get("MediaBox")), "rotate": self.get(d, "Rotate", int)})
            stack += kids
        return out

    def contents(self, d: dict) -> list[Ref]:
        value = d.get("Contents")
        if isinstance(value, Ref) and isinstance(array := self.object(value), list):
            value = array
        return [value] if isinstance(value, Ref) else [x for x in value if isinstance(x, Ref)] if isinstance(value, list) else []

    def fonts(self, resources) -> dict[str, dict]:
        resources = self.object(resources) if isinstance(resources, Ref) else resources
        out = {}
        for name, value in (self.get(resources, "Font", dict) or {}).items():
            font = self.object(value) if isinstance(value, Ref) else value
            if isinstance(font, dict):
                out[name] = self.font(font)
        return out

    def font(self, font: dict) -> dict:
        encoding = font.get("Encoding")
        encoding = self.object(encoding) if isinstance(encoding, Ref) else encoding
        base = encoding if isinstance(encoding, Name) else get(encoding, "BaseEncoding", Name)
        own = texts.differences(self.get(encoding, "Differences", list) or []) if isinstance(encoding, dict) else {}
        unicode = self.get(font, "ToUnicode", Stream)
        table = {}
        if unicode:
            try:
                table = texts.cmap(self.decoded(unicode))
            except FilterFault as e:
                self.warnings.append(f"ToUnicode: {e}")
        subtype = get(font, "Subtype", Name)
        return {"subtype": subtype, "base_font": get(font, "BaseFont", Name), "encoding": base, "differences": own, "to_unicode": table, "composite": subtype == "Type0", "type": get(font, "Type", Name)}

    def string(self, d, key: str) -> str | None:
        value = self.get(d, key, Text)
        return texts.text_string(value) or None if value is not None else None

    def info(self) -> dict:
        info = self.trailer("Info")
        d = self.object(info) if isinstance(info, Ref) else info
        out: dict = {k.lower(): self.string(d, k) for k in ("Title", "Author", "Creator", "Producer")}
        for key, name in (("CreationDate", "created"), ("ModDate", "modified")):
            found = texts.pdf_date(self.string(d, key))
            out[name], out[f"{name}_offset"] = found or (None, None)
        ids = self.sections[0]["trailer"].get("ID") if self.sections else None
        out["ids"] = [x.digits() if isinstance(x, HexText) else x.decode("latin-1") for x in ids] if isinstance(ids, list) and all(isinstance(x, Text) for x in ids) else None
        pages = self.pages_ref()
        out["page_count"] = self.get(self.object(pages), "Count", int) if pages else None
        root = self.root()
        meta = self.get(self.object(root), "Metadata", Stream) if root else None
        try:
            out["xmp"] = self.decoded(meta).decode("utf-8", "replace") if meta else None
        except FilterFault:
            out["xmp"] = None
        return out

    def encrypt(self) -> dict:
        value = self.trailer("Encrypt")
        d = self.object(value) if isinstance(value, Ref) else value
        empty = not (isinstance(d, dict) and d)
        cf = self.get(self.get(d, "CF", dict), "StdCF", dict)
        return {"present": value is not None, "empty": empty, "v": get(d, "V", int) if not empty else None, "r": get(d, "R", int) if not empty else None, "cfm": get(cf, "CFM", Name)}

    def features(self) -> dict:
        version = re.match(r"([1-9]\.\d)", self.header_version or "")
        declared = version[1] if version else None
        kinds = {s["kind"] for s in self.sections}
        streams = "stream" in kinds
        effective = max(declared, "1.5") if declared and streams else declared
        root = self.root()
        first = self.sections[0]["kind"] if self.sections else None
        return {
            "declared": declared, "effective": effective, "traditional_xref": first == "table", "xref_stream": streams, "hybrid": first == "table" and self.sections[0]["trailer"].get("XRefStm") is not None,
            "object_streams": any(e["kind"] == "stream" for e in self.index.values()), "incremental": sum(s["kind"] == "table" or "table" not in kinds for s in self.sections) > 1,
            "linearized": b"/Linearized" in self.data[:2048], "eof": b"%%EOF" in self.data[-64:], "encrypted": self.encrypt()["present"] and not self.encrypt()["empty"],
            "xmp": bool(root) and self.get(self.object(root), "Metadata", Stream) is not None, "info": self.trailer("Info") is not None,
        }

    def text(self, leaf: dict) -> tuple[list[str], bytes, str | None]:
        """(text of each content stream, decoded bytes of all, the last error)."""
        fonts, out, body, error = self.fonts(leaf.get("Resources")), [], [], None
        for ref in self.contents(leaf["dict"]):
            stream = self.object(ref)
            try:
                if not isinstance(stream, Stream):
                    raise SyntaxFault(f"content {ref} is no stream")
                body.append(self.decoded(stream))
                out.append(shown(operators(body[-1]), fonts))
            except (SyntaxFault, FilterFault) as e:
                error = str(e)
        return out, b"\n".join(body), error

    def pages(self, text: bool = True, content: bool = False, page: int | None = None) -> list[dict]:
        """All leaves, or with page the one of that number alone: the tree is walked as far as that, and no other page is laid out."""
        out, number = [], 0
        for leaf_no, leaf in enumerate(self.leaves(), 1):
            d = leaf["dict"]
            refs = self.contents(d)
            number += bool(refs)
            if page is not None and (number < page or not refs):
                continue
            shown_, body, error = self.text(leaf) if text or content else ([], b"", None)
            rotate = leaf.get("Rotate")
            rotate = self.object(rotate) if isinstance(rotate, Ref) else rotate
            out.append({
                "leaf_no": leaf_no, "page_no": number if refs else None, "obj_ref": str(leaf["ref"]), "parent": str(d["Parent"]) if isinstance(d.get("Parent"), Ref) else None,
                "resources": str(leaf["Resources"]) if isinstance(leaf.get("Resources"), Ref) else None, "media_box": self.box(leaf.get("MediaBox")), "rotate": rotate if isinstance(rotate, int) else None, "contents": [str(r) for r in refs],
                "fonts": [{"name": k, **{c: v[c] for c in ("subtype", "base_font", "encoding")}} for k, v in sorted(self.fonts(leaf.get("Resources")).items())],
                "texts": shown_ if text else None, "content": body if content else None, "error": error,
            })
            if page is not None:
                break
        return out

    def findings(self) -> list[dict]:
        out: list[dict] = []

        def add(level: str, severity: str, message: str) -> None:
            out.append({"level": level, "severity": severity, "ord": len(out), "message": f"{level}: {message}"})

        version = self.header_version
        if version is None:
            add("header", "error", "missing PDF header")
        elif not re.search(r"\d+\.\d+", version):
            add("header", "error", f"invalid version format: {version}")
        if self.startxref is None or b"startxref" not in self.data[-TAIL:]:
            add("xref", "error", "startxref not found")
        elif self.startxref >= len(self.data):
            add("xref", "error", f"startxref offset {self.startxref} out of bounds")
        elif not self.entries:
            add("xref", "error", "no objects found in xref index")
        for num in sorted(self.index):
            e = self.index[num]
            if e["kind"] == "direct" and e["offset"] >= len(self.data):
                add("xref", "error", f"object {num} offset {e['offset']} out of bounds")
        if not self.sections:
            add("trailer", "error", "dictionary not found")
        else:
            if not isinstance(self.trailer("Root"), Ref):
                add("trailer", "error", "required /Root reference not found")
            size = self.trailer("Size")
            if not isinstance(size, int):
                add("trailer", "error", "required /Size not found")
            elif size <= 0:
                add("trailer", "error", f"/Size must be positive integer, got: {size}")
        ref = self.trailer("Root")
        catalog = self.object(ref) if isinstance(ref, Ref) else None
        if not isinstance(catalog, dict):
            add("catalog", "error", "cannot read catalog object")
            return out
        kind = get(catalog, "Type", Name)
        if kind != "Catalog":
            add("catalog", "error", f"expected /Type /Catalog, got /Type /{kind or ''}")
        top = self.pages_ref()
        if top is None:
            add("catalog", "error", "required /Pages reference not found")
            return out
        tree = self.object(top)
        if not isinstance(tree, dict):
            add("pages", "error", "cannot read pages object")
            return out
        kind = get(tree, "Type", Name)
        if kind != "Pages":
            add("pages", "error", f"expected /Type /Pages, got /Type /{kind or ''}")
        count = self.get(tree, "Count", int)
        if count is None:
            add("pages", "warning", "/Count not found")
        elif count < 0:
            add("pages", "error", f"/Count must be non-negative, got: {count}")
        elif count == 0:
            add("pages", "warning", "/Count is 0, document may have no pages")
        kids = tree.get("Kids")
        kids = self.object(kids) if isinstance(kids, Ref) else kids
        if kids is None:
            add("pages", "warning", "/Kids not found")
        elif not isinstance(kids, list):
            add("pages", "error", "/Kids must be an array")
        elif not kids:
            add("pages", "warning", "/Kids array is empty")
        seen = set()
        for leaf in self.leaves():
            if self.box(leaf.get("MediaBox")) is None:
                add("pages", "error", f"page {leaf['ref']}: required /MediaBox not found (no inherited value)")
            if leaf.get("Resources") is None:
                add("pages", "warning", f"page {leaf['ref']}: /Resources not found (no inherited value)")
            resources = leaf.get("Resources")
            resources = self.object(resources) if isinstance(resources, Ref) else resources
            for name, value in sorted((self.get(resources, "Font", dict) or {}).items()):
                key = str(value) if isinstance(value, Ref) else f"{leaf['ref']}/{name}"
                if key in seen:
                    continue
                seen.add(key)
                font = self.object(value) if isinstance(value, Ref) else value
                if not isinstance(font, dict):
                    add("fonts", "warning", f"font {key}: cannot read font object")
                    continue
                kind = get(font, "Type", Name)
                if kind is None:
                    add("fonts", "warning", f"font {key}: /Type not found")
                elif kind != "Font":
                    add("fonts", "error", f"font {key}: /Type is /{kind}, expected /Font")
                for field in ("Subtype", "BaseFont"):
                    if get(font, field, Name) is None:
                        add("fonts", "warning", f"font {key}: /{field} not found")
        return out

    def objects(self) -> list[dict]:
        """Live objects: the index's, or those that a scan finds if there is none. found: whether the value can be read."""
        nums = sorted(n for n, e in self.index.items() if e["kind"] != "free") or sorted(self.scan())
        out = []
        for num in nums:
            value = self.object(num)
            entry = self.index.get(num)
            at = None if entry and entry["kind"] == "stream" else self.located(num)[0]
            exists = at is not None or value is not None
            d = value.dict if isinstance(value, Stream) else value
            out.append({"obj_num": num, "gen_num": entry["gen_num"] if entry else self.scan()[num][1], "offset": at, "found": exists, "json": _json(plain(d)) if exists else None})
        return out


def _json(value) -> str:
    import json

    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def read(path: str, data: bytes, parts: tuple[str, ...] = PARTS, page: int | None = None) -> dict:
    """One file as a row of SCHEMA; parts not asked for are null. page: of the pages with contents only this one, counted from 1."""
    row: dict = {"path": path, "size_bytes": len(data), "error": None}
    try:
        pdf = PdfFile(data)
        row |= {"header_version": pdf.header_version, "startxref": pdf.startxref, "features": pdf.features(), "encrypt": pdf.encrypt(), "info": pdf.info()}
        row["sections"] = [{"rank": s["rank"], "offset": s["offset"], "kind": s["kind"], "prev": get(s["trailer"], "Prev", int), "root": str(s["trailer"]["Root"]) if isinstance(s["trailer"].get("Root"), Ref) else None, "size": get(s["trailer"], "Size", int)} for s in pdf.sections]
        if "objects" in parts:
            row |= {"xref": pdf.entries, "objects": pdf.objects(), "nodes": pdf.nodes()}
        if {"pages", "text", "content"} & set(parts):
            row["pages"] = pdf.pages("text" in parts and not row["features"]["encrypted"], "content" in parts, page)
        if "findings" in parts:
            row["findings"] = pdf.findings()
        row["warnings"] = pdf.warnings
        if not data.startswith(b"%PDF-"):
            row["error"] = "missing PDF header"
    except (ValueError, RecursionError, KeyError, IndexError, TypeError, OverflowError) as e:
        row["error"] = f"{type(e).__name__}: {e}"
    return row


def parsed(files: DataFrame, parts: tuple[str, ...] = PARTS, page: int | None = None) -> DataFrame:
    """SCHEMA's columns of each row (path, content) of files, with page of that page alone. One file is in memory at a time, besides its row."""
    schema = T.StructType.fromDDL(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                yield pa.RecordBatch.from_pylist([read(p.as_py(), c.as_py() or b"", parts, page) for p, c in zip(part.column("path"), part.column("content"), strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)
