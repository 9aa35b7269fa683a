"""Plans over parsed PDF files. What belongs to one file stays in its row, so only the recursive and the revision plans shuffle, by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import native


def xref(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("xref").alias("x")).select("path", "x.*")


def objects(parsed: DataFrame) -> DataFrame:
    """(path, obj_num, gen_num, offset, found, dict variant) of live objects."""
    rows = parsed.select("path", F.explode("objects").alias("x")).select("path", "x.*")
    return rows.withColumn("dict", F.try_parse_json("json")).drop("json")


def latest(entries: DataFrame, rank: str = "rank") -> DataFrame:
    """The entry of least rank (newest section; a table before its stream) of each (path, obj_num): a hash aggregate, combined before the shuffle."""
    rest = [c for c in entries.columns if c not in ("path", "obj_num", rank)]
    best = entries.groupBy("path", "obj_num").agg(F.min_by(F.struct(*rest), rank).alias("e"))
    return best.select("path", "obj_num", "e.*")


def live_offsets(entries: DataFrame) -> DataFrame:
    """(path, obj_num, offset) of direct objects in their newest revision."""
    return latest(entries).where("kind = 'direct'").select("path", "obj_num", "offset")


def page_tree(parsed: DataFrame, depth: int = 64) -> DataFrame:
    """(path, leaf_no, obj_num, media_box, rotate): the tree in pre-order, boxes and rotations from the nearest ancestor, by a recursive query;
    the plan for trees too large for a row. A node that is reached again is dropped after its first place."""
    nodes = parsed.select("path", F.explode("nodes").alias("n")).select("path", "n.*")
    edges = nodes.select("path", F.col("obj_num").alias("parent"), F.posexplode("kids").alias("pos", "kid"))
    walked = parsed.sparkSession.sql(
        """
        WITH RECURSIVE walk(path, obj_num, type, media_box, rotate, place, above, depth) MAX RECURSION LEVEL 100 AS (
          SELECT path, obj_num, type, media_box, rotate, cast(array() AS array<int>), array(obj_num), 0 FROM {nodes} WHERE is_root
          UNION ALL
          SELECT w.path, n.obj_num, n.type, coalesce(n.media_box, w.media_box), coalesce(n.rotate, w.rotate), concat(w.place, array(e.pos)), concat(w.above, array(n.obj_num)), w.depth + 1
          FROM walk w JOIN {edges} e ON e.path = w.path AND e.parent = w.obj_num JOIN {nodes} n ON n.path = e.path AND n.obj_num = e.kid
          WHERE w.depth < {depth} AND NOT array_contains(w.above, n.obj_num))
        SELECT * FROM walk WHERE type = 'Page'
        """,
        nodes=nodes,
        edges=edges,
        depth=depth,
    )
    first = walked.groupBy("path", "obj_num").agg(F.min_by(F.struct("media_box", "rotate"), "place").alias("x"), F.min("place").alias("place"))
    number = F.expr("row_number() over (partition by path order by place)")
    return first.select("path", number.alias("leaf_no"), "obj_num", "x.*")


def pages(parsed: DataFrame) -> DataFrame:
    """One row a leaf, leaf_no counting all and page_no those with contents."""
    return parsed.select("path", F.explode("pages").alias("p")).select("path", "p.*")


def _page_text(page: Column) -> Column:
    return F.regexp_replace(F.array_join(F.filter(page["texts"], lambda t: t != ""), " "), r"(?U)^\s+|\s+$", "")


def text(parsed: DataFrame, page: int | None = None) -> DataFrame:
    """(path, page_no, text, error): of whole documents (page null or below 1), or of one page, counted over pages with contents. Streams and pages are joined by a space; no text at all is an error."""
    numbered = F.filter("pages", lambda p: p["page_no"].isNotNull())
    if page is not None and page > 0:
        own = F.get(F.filter("pages", lambda p: p["page_no"] == page), F.lit(0))
        found = F.when(own.isNotNull(), _page_text(own))
        error = F.when(F.col("error").isNotNull(), F.col("error")).when(own.isNull(), F.lit(f"page {page} not found")).when(found == "", F.coalesce(own["error"], F.lit("no text")))
        return parsed.select("path", F.lit(page).alias("page_no"), F.nullif(found, F.lit("")).alias("text"), error.alias("error"))
    whole = F.array_join(F.filter(F.transform(numbered, _page_text), lambda t: t != ""), " ")
    last = F.element_at(F.filter(F.transform("pages", lambda p: p["error"]), lambda e: e.isNotNull()), -1)
    some = F.coalesce(whole != "", F.lit(False))
    error = F.when(~some, F.coalesce("error", F.when(F.size(F.filter("pages", lambda p: p["error"].isNotNull())) > 0, last), F.lit("no text")))
    return parsed.select("path", F.lit(None).cast("int").alias("page_no"), F.when(some, whole).alias("text"), error.alias("error"))


def page_texts(parsed: DataFrame) -> DataFrame:
    """(path, page_no, text) of every page with contents."""
    return parsed.select("path", F.explode(F.filter("pages", lambda p: p["page_no"].isNotNull())).alias("p")).select("path", "p.page_no", _page_text(F.col("p")).alias("text"))


def first_page(parsed: DataFrame) -> DataFrame:
    """The first leaf of each document, or an error."""
    p = F.get("pages", F.lit(0))
    return parsed.select("path", p["obj_ref"].alias("page_ref"), p["parent"].alias("parent"), p["media_box"].alias("media_box"), p["resources"].alias("resources"), p["contents"].alias("contents"), p["rotate"].alias("rotate"), F.when(p.isNull(), F.coalesce("error", F.lit("no page"))).alias("error"))


def go_to(parsed: DataFrame, ref: str) -> DataFrame:
    """(path, leaf_no, page_no, obj_ref, media_box, content) of the page with this reference."""
    return pages(parsed).where(F.col("obj_ref") == ref).select("path", "leaf_no", "page_no", "obj_ref", "media_box", "content")


def fonts(parsed: DataFrame) -> DataFrame:
    return pages(parsed).select("path", "leaf_no", F.explode("fonts").alias("f")).select("path", "leaf_no", "f.*")


def algorithm() -> Column:
    return native.encryption(F.col("encrypt.empty"), F.col("encrypt.v"), F.col("encrypt.r"), F.col("encrypt.cfm"))


def features(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "header_version", "features.*", algorithm().alias("encryption"), "warnings")


def info(parsed: DataFrame) -> DataFrame:
    """Metadata: the information dictionary, and XMP for an empty title, creator or producer."""
    fields = native.xmp_fields(F.col("info.xmp"))
    rows = parsed.withColumn("_x", fields)
    return rows.select(
        "path", F.lit("pdf").alias("format"), "size_bytes", F.col("header_version").alias("declared_version"), "info.page_count", F.col("info.ids").alias("file_identifiers"),
        F.coalesce("info.title", "_x.title").alias("title"), "info.author", F.coalesce("info.creator", "_x.creator").alias("creator"), F.coalesce("info.producer", "_x.producer").alias("producer"),
        "info.created", "info.created_offset", "info.modified", "info.modified_offset", F.coalesce("features.encrypted", F.lit(False)).alias("is_encrypted"), algorithm().alias("encryption_algorithm"),
        native.pdfa(F.col("_x.pdfa_part"), F.col("_x.pdfa_conformance")).alias("pdfa_conformance"), "error",
    )


def findings(parsed: DataFrame) -> DataFrame:
    """(path, level, severity, ord, message)."""
    return parsed.select("path", F.explode("findings").alias("f")).select("path", "f.*")


def report(parsed: DataFrame, deep: bool = False) -> DataFrame:
    """(path, valid, errors, warnings): the findings of all levels in order. A file that cannot be read is invalid. deep: an indexed object that stands nowhere is an error too."""
    found = F.coalesce("findings", F.array())
    of = lambda kind: F.transform(F.filter(found, lambda f: f["severity"] == kind), lambda f: f["message"])
    errors = F.when(F.col("findings").isNull(), F.array(F.coalesce("error", F.lit("not read")))).otherwise(of("error"))
    if deep:
        lost = F.filter(F.coalesce("objects", F.array()), lambda o: ~o["found"])
        errors = F.concat(errors, F.transform(lost, lambda o: F.format_string("object %d not found", o["obj_num"])))
    return parsed.select("path", (F.size(errors) == 0).alias("valid"), errors.alias("errors"), of("warning").alias("warnings"))


def deep_findings(parsed: DataFrame) -> DataFrame:
    """(path, obj_num) of indexed objects that stand nowhere."""
    return objects(parsed).where("not found").select("path", "obj_num")


def rewrite_offsets(lengths: DataFrame, header: int = 0) -> DataFrame:
    """(path, obj_num, length) with the byte offset each object gets when all are written in ascending order after a header."""
    return lengths.withColumn("offset", F.expr(f"sum(length) over (partition by path order by obj_num rows unbounded preceding) - length + {header}"))
