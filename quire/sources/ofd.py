"""OFD packages to rows: each package is read once, by one Arrow function, into nested columns; a broken one gives a row with an error.

Elements are matched by their local names. A package of too many entries, or of too many bytes when unpacked, is rejected before anything is unpacked.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Limits, and the entries that are looked for.
ENTRIES, UNPACKED, XML_BYTES = 10_000, 512 << 20, 32 << 20
RESOURCES = ("Doc_0/PublicRes.xml", "Doc_0/DocumentRes.xml")
ANNOTATIONS, SIGNATURES = "Doc_0/Annots/Annotations.xml", "Doc_0/Signs/Signatures.xml"

SCHEMA = """path string, size_bytes bigint, error string, version string, doc_root string, document_found boolean, default_box string,
entries array<struct<name:string,size:bigint>>,
pages array<struct<ord:int,page_id:bigint,loc:string,entry:string,found:boolean,box:string,texts:array<string>,content:binary,error:string>>,
text_codes array<struct<page:int,object_id:bigint,boundary:string,font:bigint,font_size:double,ord:int,text:string,x:double,y:double,delta_x:string,delta_y:string>>,
fonts array<struct<id:bigint,font_name:string,family_name:string,file:string>>,
media array<struct<id:bigint,type:string,format:string,file:string>>,
annotation_index array<struct<page_id:bigint,file:string>>,
annotations array<struct<entry:string,id:bigint,type:string,subtype:string,creator:string,modified:string,boundary:string,parameters:map<string,string>>>,
signatures array<struct<id:bigint,loc:string>>,
seals array<struct<entry:string,version:string,width:bigint,height:bigint,picture:string,error:string>>"""
PARTS = ("text", "codes", "content", "resources", "annotations", "seals")


class PackageFault(ValueError):
    pass


def local(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def attributes(element: ElementTree.Element) -> dict[str, str]:
    return {local(k): v for k, v in element.attrib.items()}


def named(root: ElementTree.Element | None, *names: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if local(e.tag) in names) if root is not None else iter(())


def child_text(element: ElementTree.Element, *names: str) -> str | None:
    return next((e.text.strip() for e in named(element, *names) if e is not element and e.text and e.text.strip()), None)


def integer(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def real(value: str | None) -> float | None:
    try:
        return float(value) if value is not None else None
    except ValueError:
        return None


def clean(name: str) -> str:
    return name.removeprefix("./").removeprefix("/")


class Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise PackageFault(f"no package: {e}") from e
        listed = self.zip.infolist()
        if len(listed) > ENTRIES:
            raise PackageFault(f"{len(listed)} entries, over {ENTRIES}")
        if (total := sum(i.file_size for i in listed)) > UNPACKED:
            raise PackageFault(f"{total} bytes unpacked, over {UNPACKED}")
        self.entries = {clean(i.filename): i for i in listed}

    def read(self, name: str, limit: int = XML_BYTES) -> bytes:
        entry = self.entries.get(name)
        if entry is None:
            raise PackageFault(f"{name} not found")
        try:
            with self.zip.open(entry) as f:
                data = f.read(limit)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, OSError, EOFError) as e:
            raise PackageFault(f"{name}: {e}") from e
        if len(data) >= limit:
            raise PackageFault(f"{name} has {limit} bytes or more")
        return data

    def xml(self, name: str) -> ElementTree.Element:
        data = self.read(name)
        if b"<!ENTITY" in data:
            raise PackageFault(f"{name} declares entities")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError:
            try:  # a prefix that is not declared
                head, _, rest = data.partition(b"?>") if data.lstrip().startswith(b"<?xml") else (b"", b"", data)
                return ElementTree.fromstring(rest.replace(b"<ofd:", b"<").replace(b"</ofd:", b"</"))
            except ElementTree.ParseError as e:
                raise PackageFault(f"{name}: {e}") from e

    def optional(self, name: str) -> ElementTree.Element | None:
        return self.xml(name) if name in self.entries else None


def page_box(root: ElementTree.Element | None) -> str | None:
    return next((e.text.strip() for e in named(root, "PhysicalBox") if e.text and e.text.strip()), None)


def seal(data: bytes) -> dict:
    """Version, size and picture of a seal: an ``ES`` header, or ASN.1; else an error. Sizes that the header leaves open are the picture's."""
    if len(data) < 8:
        return {"error": f"{len(data)} bytes, fewer than 8"}
    if data[:2] == b"ES":
        out = {"version": f"{data[2]}.{data[3]}", "width": int.from_bytes(data[4:6], "big"), "height": int.from_bytes(data[6:8], "big")}
    elif data[0] == 0x30 and data[1] >= 0x82:
        out = {"version": "1.0", "width": 0, "height": 0}
    else:
        return {"error": f"invalid seal format: magic {data[:2].hex()}"}
    if (png := picture(data)) is not None:
        out["picture"] = "PNG"
        if len(png) >= 24:
            out["width"] = out["width"] or int.from_bytes(png[16:20], "big")
            out["height"] = out["height"] or int.from_bytes(png[20:24], "big")
    return out


def picture(data: bytes) -> bytes | None:
    """The first whole PNG in data."""
    at = data.find(b"\x89PNG")
    while at >= 0:
        end = at + 8
        while end + 12 <= len(data):
            size = int.from_bytes(data[end : end + 4], "big")
            if end + 12 + size > len(data):
                break
            kind, end = data[end + 4 : end + 8], end + 12 + size
            if kind == b"IEND":
                return data[at:end]
        at = data.find(b"\x89PNG", at + 4)
    return None


def read(path: str, data: bytes, parts: tuple[str, ...] = PARTS, only: int | None = None) -> dict:
    """One package as a row of SCHEMA; parts not asked for are null. only: the number of the single page whose entry is read."""
    row: dict = {"path": path, "size_bytes": len(data), "error": None}
    try:
        package = Package(data)
    except PackageFault as e:
        return row | {"error": str(e)}
    row["entries"] = [{"name": n, "size": i.file_size} for n, i in package.entries.items()]
    errors: list[str] = []

    def attempt(make, default=None):
        try:
            return make()
        except PackageFault as e:
            errors.append(str(e))
            return default

    head = attempt(lambda: package.xml("OFD.xml"))
    document = None
    if head is not None:
        row["version"] = next((v for e in head.iter() for k, v in attributes(e).items() if k == "Version" and v), None) or child_text(head, "Version")
        row["doc_root"] = child_text(head, "DocRoot")
    root = clean(row.get("doc_root") or "")
    row["document_found"] = root in package.entries
    if root:
        document = attempt(lambda: package.xml(root))
    row["default_box"] = page_box(next(named(document, "PageArea"), document))
    codes: list[dict] = []
    pages = []
    for ord_, page in enumerate(named(document, "Page"), 1):
        if only is not None and ord_ != only:
            continue
        own = attributes(page)
        if "BaseLoc" not in own:
            pages.append({"ord": ord_, "page_id": integer(own.get("ID")), "found": False})
            continue
        entry = posixpath.join(posixpath.dirname(root), own["BaseLoc"].removeprefix("./")) if not own["BaseLoc"].startswith("/") else clean(own["BaseLoc"])
        out = {"ord": ord_, "page_id": integer(own.get("ID")), "loc": own["BaseLoc"], "entry": entry, "found": entry in package.entries}
        if out["found"] and {"text", "codes", "content"} & set(parts):
            try:
                if "content" in parts:
                    out["content"] = package.read(entry)
                content = package.xml(entry)
                out["box"] = page_box(content)
                found = [(e.text or "").strip() for e in named(content, "TextCode")]
                out["texts"] = [t for t in found if t] if "text" in parts else None
                if "codes" in parts:
                    codes += text_codes(content, ord_)
            except PackageFault as e:
                out["error"] = str(e)
        pages.append(out)
    row |= {"pages": pages, "text_codes": codes if "codes" in parts else None}
    if "resources" in parts:
        roots = [r for r in (attempt(lambda n=n: package.optional(n)) for n in RESOURCES) if r is not None]
        row["fonts"] = [{"id": integer(a.get("ID")), "font_name": a.get("FontName"), "family_name": a.get("FamilyName"), "file": child_text(e, "FontFile") or a.get("FontFile")} for r in roots for e in named(r, "Font") if (a := attributes(e)).get("ID")]
        row["media"] = [{"id": integer(a.get("ID")), "type": a.get("Type"), "format": a.get("Format"), "file": child_text(e, "MediaFile") or a.get("MediaFile")} for r in roots for e in named(r, "MultiMedia") if (a := attributes(e)).get("ID")]
    if "annotations" in parts:
        index = attempt(lambda: package.optional(ANNOTATIONS))
        row["annotation_index"] = [{"page_id": integer(attributes(e).get("PageID")), "file": child_text(e, "FileLoc")} for e in named(index, "Page") if integer(attributes(e).get("PageID"))]
        row["annotations"] = [a for f in dict.fromkeys(x["file"] for x in row["annotation_index"] if x["file"]) if clean(f) in package.entries for a in attempt(lambda f=f: annotations(clean(f), package.xml(clean(f))), [])]
    if "seals" in parts:
        signed = attempt(lambda: package.optional(SIGNATURES))
        row["signatures"] = [{"id": integer(a["ID"]), "loc": seal_location(e) or a.get("BaseLoc") or None} for e in named(signed, "Signature") if integer((a := attributes(e)).get("ID"))]
        row["seals"] = [{"entry": n, **attempt(lambda n=n: seal(package.read(n)), {"error": "cannot be read"})} for n in dict.fromkeys(clean(s["loc"]) for s in row["signatures"] if s["loc"]) if n in package.entries]
    row["error"] = "; ".join(errors) or None
    return row


def seal_location(signature: ElementTree.Element) -> str | None:
    return next((child_text(s, "BaseLoc") or attributes(s).get("BaseLoc") for s in named(signature, "Seal")), None)


def annotations(entry: str, root: ElementTree.Element) -> list[dict]:
    out = []
    for e in named(root, "Annot"):
        a = attributes(e)
        parameters = {k: (p.text or "").strip() for p in named(e, "Parameter") if (k := attributes(p).get("Name"))}
        boundary = next((attributes(x).get("Boundary") for x in named(e, "Appearance")), None)
        out.append({"entry": entry, "id": integer(a.get("ID")), "type": a.get("Type"), "subtype": a.get("Subtype"), "creator": a.get("Creator"), "modified": a.get("LastModDate"), "boundary": boundary, "parameters": parameters})
    return out


def text_codes(root: ElementTree.Element, page: int) -> list[dict]:
    out = []
    for o in named(root, "TextObject"):
        a = attributes(o)
        for ord_, c in enumerate(named(o, "TextCode"), 1):
            b = attributes(c)
            out.append({"page": page, "object_id": integer(a.get("ID")), "boundary": a.get("Boundary"), "font": integer(a.get("Font")), "font_size": real(a.get("Size")), "ord": ord_, "text": (c.text or "").strip(), "x": real(b.get("X")), "y": real(b.get("Y")), "delta_x": b.get("DeltaX"), "delta_y": b.get("DeltaY")})
    return out


def parsed(files: DataFrame, parts: tuple[str, ...] = PARTS, page: int | None = None) -> DataFrame:
    """SCHEMA's columns of each row (path, content) of files, with page of that page alone."""
    schema = T.StructType.fromDDL(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                yield pa.RecordBatch.from_pylist([read(p.as_py(), c.as_py() or b"", parts, page) for p, c in zip(part.column("path"), part.column("content"), strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)
