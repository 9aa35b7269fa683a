"""Operators that Spark's own functions express: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
XMP_TAGS = {"title": "dc:title", "creator": "dc:creator", "creator_tool": "xmp:CreatorTool", "producer": "pdf:Producer", "created": "xmp:CreateDate", "modified": "xmp:ModifyDate", "subject": "dc:subject", "description": "dc:description", "pdfa_part": "pdfaid:part", "pdfa_conformance": "pdfaid:conformance"}


def route_format(path: Column) -> Column:
    """pdf or ofd by the file name's ending, in any case; null for others."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(end.isin("pdf", "ofd"), end)


def path_is_safe(path: Column) -> Column:
    """False for empty paths and for those that lead out of where they start by ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # depth below the start; -1 for good once it has been left
    depth = F.aggregate(parts, F.lit(0), lambda d, p: F.when(d < 0, d).when(p == "..", d - 1).otherwise(d + 1))
    return F.coalesce((path != "") & (path.startswith("/") | (depth >= 0)), F.lit(False))


def normalised(text: Column) -> Column:
    """Runs of white space, Unicode's too, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip_tags(text: Column) -> Column:
    """Without ``<...>``, trimmed of any white space."""
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"(?U)^\s+|\s+$", "")


def tag_value(text: Column, tag: str) -> Column:
    """Text between the first ``<tag>`` and the next ``</tag``, without inner tags; null if there is none or it is empty."""
    return F.nullif(strip_tags(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}", 1)), F.lit(""))


def quoted(text: Column, key: str) -> Column:
    """The quoted value that follows the first ``key=``; null if none does."""
    value = F.regexp_extract(F.substring_index(text, f"{key}=", 2), rf"{key}=\s*[\"']([^\"']*)[\"']", 1)
    return F.nullif(value, F.lit(""))


def xmp_fields(xmp: Column) -> Column:
    """struct<title, creator, producer, created, modified, pdfa_part, pdfa_conformance>: tags before attributes for PDF/A, ``xmp:CreatorTool`` for want of a creator, subject and description for want of a title."""
    tag = {k: tag_value(xmp, v) for k, v in XMP_TAGS.items()}
    return F.struct(
        F.coalesce(tag["title"], tag["subject"], tag["description"]).alias("title"),
        F.coalesce(tag["creator"], tag["creator_tool"]).alias("creator"),
        tag["producer"].alias("producer"),
        tag["created"].alias("created"),
        tag["modified"].alias("modified"),
        F.coalesce(tag["pdfa_part"], quoted(xmp, "pdfaid:part")).alias("pdfa_part"),
        F.coalesce(tag["pdfa_conformance"], quoted(xmp, "pdfaid:conformance")).alias("pdfa_conformance"),
    )


def pdfa(part: Column, conformance: Column) -> Column:
    """``PDF/A-<part><CONFORMANCE>``; null without a part."""
    return F.when(part.isNotNull(), F.concat(F.lit("PDF/A-"), part, F.upper(F.coalesce(conformance, F.lit("")))))


def float_list(text: Column) -> Column:
    """The numbers of a list that white space separates; anything else is skipped."""
    return F.filter(F.transform(F.split(normalised(text), " "), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def physical_box(text: Column) -> Column:
    """``x y w h`` as [x, y, x + w, y + h]; null unless it is four numbers."""
    parts = F.split(normalised(text), " ")
    n = F.transform(parts, lambda x: x.try_cast("double"))
    ok = (F.size(n) == 4) & F.forall(n, lambda x: x.isNotNull())
    return F.when(ok, F.array(n[0], n[1], n[0] + n[2], n[1] + n[3]))


def version(text: Column) -> Column:
    """struct<major, minor> of ``X.Y``, X from 1 to 9; null for others. Structs compare as versions do."""
    found = F.regexp_extract(text, r"^([1-9])\.([0-9])$", 0)
    return F.when(found != "", F.struct(F.substring(text, 1, 1).try_cast("int").alias("major"), F.substring(text, 3, 1).try_cast("int").alias("minor")))


def encryption(empty: Column, v: Column, r: Column, cfm: Column) -> Column:
    """The algorithm by /V, /R and the crypt filter's method; null for documents without encryption."""
    v, r = F.coalesce(v, F.lit(0)), F.coalesce(r, F.lit(0))
    kind = (
        F.when((v == 1) & (r == 2), "RC4-40")
        .when((v == 1) & (r == 3) | (v == 2) & (r == 3), "RC4-128")
        .when((v == 4) & (r == 4), F.when(F.coalesce(cfm, F.lit("")) == "AESV2", "AES-128").otherwise("RC4-128"))
        .when((v == 5) & r.isin(5, 6), "AES-256")
        .otherwise("unknown")
    )
    return F.when(~F.coalesce(empty, F.lit(True)), kind)


def pdf_date(text: Column) -> Column:
    """struct<at timestamp, offset_s int> of ``D:YYYYMMDDhhmmss`` and an offset (none: UTC); days past a month's end run on into the next one. Null for other text."""
    form = r"^(?:D:)?(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(?:Z|([+-])(\d{2})'?(\d{2})?'?)?"
    got = [F.regexp_extract(text, form, i).try_cast("int") for i in range(1, 7)]
    year, month, day, hour, minute, second = got
    sign, hours, minutes = (F.regexp_extract(text, form, i) for i in (7, 8, 9))
    offset = F.when(sign == "", 0).otherwise((F.coalesce(hours.try_cast("int"), F.lit(0)) * 3600 + F.coalesce(minutes.try_cast("int"), F.lit(0)) * 60) * F.when(sign == "-", -1).otherwise(1)).cast("int")
    ok = (year > 0) & month.between(1, 12) & day.between(1, 31) & (hour < 24) & (minute < 60) & (second < 60)
    days = F.date_add(F.make_date(F.when(ok, year), F.when(ok, month), F.lit(1)), day - 1)
    seconds = F.unix_date(days).cast("bigint") * 86400 + hour * 3600 + minute * 60 + second - offset
    return F.when(ok, F.struct(F.timestamp_seconds(seconds).alias("at"), offset.alias("offset_s")))
