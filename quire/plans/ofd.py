"""Plans over parsed OFD packages: everything belongs to one package, so nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import native


def _names() -> Column:
    return F.transform("entries", lambda e: e["name"])


def _clean(name: Column) -> Column:
    return F.regexp_replace(name, r"^(\./)?/?", "")


def _page_text(page: Column) -> Column:
    return F.array_join(page["texts"], " ")


def pages(parsed: DataFrame) -> DataFrame:
    """(path, page_no, page_id, loc, entry, found, media_box, content)."""
    box = native.physical_box(F.coalesce("p.box", "default_box"))
    return parsed.select("path", "default_box", F.explode("pages").alias("p")).select("path", F.col("p.ord").alias("page_no"), "p.page_id", "p.loc", "p.entry", "p.found", box.alias("media_box"), "p.content", "p.error")


def page_count(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.size("pages").alias("page_count"))


def text(parsed: DataFrame, page: int | None = None) -> DataFrame:
    """(path, page_no, text, error): pages that have text, joined by a new line; of one page, a missing entry is an error."""
    if page is not None and page > 0:
        own = F.get(F.filter("pages", lambda p: p["ord"] == page), F.lit(0))
        error = F.when(F.col("pages").isNull(), F.col("error")).when(own.isNull(), F.lit(f"page {page} out of range")).when(~own["found"], F.lit(f"page {page} has no entry")).otherwise(own["error"])
        return parsed.select("path", F.lit(page).alias("page_no"), F.when(error.isNull(), _page_text(own)).alias("text"), error.alias("error"))
    whole = F.array_join(F.filter(F.transform("pages", _page_text), lambda t: t != ""), "\n")
    return parsed.select("path", F.lit(None).cast("int").alias("page_no"), F.coalesce(whole, F.when(F.col("document_found"), F.lit(""))).alias("text"), F.when(~F.coalesce("document_found", F.lit(False)), F.coalesce("error", F.lit("no document"))).alias("error"))


def page_texts(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("pages").alias("p")).where("p.found").select("path", F.col("p.ord").alias("page_no"), _page_text(F.col("p")).alias("text"))


def go_to(parsed: DataFrame, entry: str) -> DataFrame:
    """(path, page_no, entry, content) of a page's entry; page 0 if the document doesn't list it."""
    listed = F.get(F.filter("pages", lambda p: p["entry"] == entry), F.lit(0))
    return parsed.where(F.array_contains(_names(), entry)).select("path", F.coalesce(listed["ord"], F.lit(0)).alias("page_no"), F.lit(entry).alias("entry"), listed["content"].alias("content"))


def text_codes(parsed: DataFrame) -> DataFrame:
    """One row a text code, with its object's box and the steps between its characters as numbers."""
    rows = parsed.select("path", F.explode("text_codes").alias("c")).select("path", "c.*")
    return rows.withColumns({c: native.float_list(F.col(c)) for c in ("boundary", "delta_x", "delta_y")})


def first_page(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", native.physical_box(F.col("default_box")).alias("media_box"), "error")


def missing_resources(parsed: DataFrame) -> DataFrame:
    """(path, kind, id, file): files of fonts and media that the package doesn't hold."""
    kinds = []
    for kind, column in (("font", "fonts"), ("multimedia", "media")):
        lost = F.filter(column, lambda r: r["file"].isNotNull() & ~F.array_contains(_names(), _clean(r["file"])))
        kinds.append(_tagged(lost, kind))
    return parsed.select("path", F.explode(F.concat(*kinds)).alias("r")).select("path", "r.*")


def _tagged(lost: Column, kind: str) -> Column:
    return F.transform(lost, lambda r: F.struct(F.lit(kind).alias("kind"), r["id"].alias("id"), r["file"].alias("file")))


def annotation_summary(parsed: DataFrame) -> DataFrame:
    """(path, page_id, n, types): annotations of each page of the index whose entry is there."""
    rows = parsed.select("path", "annotations", F.explode("annotation_index").alias("i")).where("i.file is not null")
    own = F.filter("annotations", lambda a: a["entry"] == _clean(F.col("i.file")))
    types = F.array_sort(F.array_distinct(F.filter(F.transform(own, lambda a: a["type"]), lambda t: t.isNotNull() & (t != ""))))
    return rows.select("path", F.col("i.page_id").alias("page_id"), F.size(own).alias("n"), types.alias("types")).where("n > 0")


def seal_summary(parsed: DataFrame) -> DataFrame:
    """(path, id, version, width, height, picture, warning) of each signature; warning: what is wrong with its seal."""
    rows = parsed.select("path", "entries", "seals", F.explode("signatures").alias("s"))
    loc = F.col("s.loc")
    own = F.get(F.filter("seals", lambda x: x["entry"] == _clean(loc)), F.lit(0))
    warning = (
        F.when(loc.isNull(), F.concat(F.lit("signature "), F.col("s.id"), F.lit(": missing SealBaseLoc")))
        .when(own.isNull(), F.concat(F.lit("signature "), F.col("s.id"), F.lit(": Seal.esl not found at "), loc))
        .when(own["error"].isNotNull(), F.concat(F.lit("signature "), F.col("s.id"), F.lit(": Seal.esl parse failed: "), own["error"]))
    )
    return rows.select("path", "s.id", own["version"].alias("version"), own["width"].alias("width"), own["height"].alias("height"), own["picture"].alias("picture"), warning.alias("warning"))


def info(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.lit("ofd").alias("format"), "size_bytes", F.col("version").alias("declared_version"), F.size("pages").cast("bigint").alias("page_count"), "fonts", "media", "signatures", "error")


def report(parsed: DataFrame) -> DataFrame:
    """(path, valid, errors, warnings): mandatory entries and the document root are errors, seals and resources warnings."""
    has = lambda name: F.array_contains(_names(), name)
    document = F.exists("entries", lambda e: e["name"].endswith("/Document.xml"))
    errors = F.when(F.col("entries").isNull(), F.array(F.coalesce("error", F.lit("not read")))).otherwise(
        F.array_compact(
            F.array(
                F.when(~has("OFD.xml"), F.lit("missing OFD.xml")),
                F.when(~document, F.lit("missing Document.xml")),
                F.when(document & F.col("doc_root").isNull(), F.lit("failed to parse DocRoot")),
                F.when(document & F.col("doc_root").isNotNull() & ~F.col("document_found"), F.concat(F.lit('DocRoot "'), F.col("doc_root"), F.lit('" points to a non-existent file'))),
            )
        )
    )
    seals = F.transform(
        F.coalesce("signatures", F.array()),
        lambda s: F.when(s["loc"].isNull(), F.concat(F.lit("signature "), s["id"], F.lit(": missing SealBaseLoc")))
        .when(~has(_clean(s["loc"])), F.concat(F.lit("signature "), s["id"], F.lit(": Seal.esl not found at "), s["loc"]))
        .otherwise(_seal_fault(s)),
    )
    lost = []
    for kind, column in (("font", "fonts"), ("multimedia", "media")):
        lost.append(_lost_messages(kind, column))
    warnings = F.when(F.coalesce(document, F.lit(False)), F.concat(F.array_compact(seals), *lost)).otherwise(F.array().cast("array<string>"))
    return parsed.select("path", (F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"))


def _seal_fault(signature: Column) -> Column:
    own = F.get(F.filter("seals", lambda x: x["entry"] == _clean(signature["loc"])), F.lit(0))
    return F.when(own["error"].isNotNull(), F.concat(F.lit("signature "), signature["id"], F.lit(": Seal.esl parse failed: "), own["error"]))


def _lost_messages(kind: str, column: str) -> Column:
    lost = F.filter(F.coalesce(column, F.array()), lambda r: r["file"].isNotNull() & ~F.array_contains(_names(), _clean(r["file"])))
    return F.transform(lost, lambda r: F.concat(F.lit(f"{kind} "), r["id"], F.lit(": file not found: "), r["file"]))
