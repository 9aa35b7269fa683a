"""The verbs, over tables of files (path, format, content): info, validate, extract, first page, pages, copy, rewrite."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import native
from quire.plans import ofd as ofd_plans
from quire.plans import pdf as pdf_plans
from quire.sources import ofd, pdf


def _by_format(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    if "format" not in files.columns:
        files = files.withColumn("format", native.route_format(F.col("path")))
    return files.where("format = 'pdf'"), files.where("format = 'ofd'")


def info(files: DataFrame) -> DataFrame:
    """One row a document; fields that a format doesn't have are null."""
    p, o = _by_format(files)
    return pdf_plans.info(pdf.parsed(p, ())).unionByName(ofd_plans.info(ofd.parsed(o, ("resources", "seals"))), allowMissingColumns=True)


def validate(files: DataFrame, deep: bool = False) -> DataFrame:
    """(path, valid, errors, warnings). deep: every object that a PDF's index names is looked up as well."""
    p, o = _by_format(files)
    return pdf_plans.report(pdf.parsed(p, ("findings", "objects") if deep else ("findings",)), deep).unionByName(ofd_plans.report(ofd.parsed(o, ("resources", "seals"))))


def extract(files: DataFrame, page: int | None = None) -> DataFrame:
    """(path, page_no, text, error): of whole documents, or of one page."""
    p, o = _by_format(files)
    page = page if page is not None and page > 0 else None
    return pdf_plans.text(pdf.parsed(p, ("text",), page), page).unionByName(ofd_plans.text(ofd.parsed(o, ("text",), page), page))


def first_page(files: DataFrame) -> DataFrame:
    p, o = _by_format(files)
    return pdf_plans.first_page(pdf.parsed(p, ("pages",))).unionByName(ofd_plans.first_page(ofd.parsed(o, ())), allowMissingColumns=True)


def pages(files: DataFrame, page: int | None = None) -> DataFrame:
    """(path, page_no, media_box, content_size, content) of every page with contents, in any order; with page, of that page alone: no other is decoded."""
    p, o = _by_format(files)
    columns = ("path", "page_no", "media_box", F.length("content").alias("content_size"), "content")
    return pdf_plans.pages(pdf.parsed(p, ("content",), page)).where("page_no is not null").select(*columns).unionByName(ofd_plans.pages(ofd.parsed(o, ("content",), page)).select(*columns))


def read_page(files: DataFrame, page: int) -> DataFrame:
    """The page of each document; documents that have no such page have no row."""
    return pages(files, page).where(F.col("page_no") == page)


def rewrite(files: DataFrame) -> DataFrame:
    """(path, content, error): each PDF as a single revision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.functions.serialize import rewritten

        for batch in batches:
            for i in range(batch.num_rows):
                content, error = None, None
                try:
                    content = rewritten(batch.column(1)[i].as_py() or b"")
                except (ValueError, TypeError, RecursionError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")


def copy(files: DataFrame, target: str) -> DataFrame:
    """Writes each file's bytes below target (any store that Arrow's file systems reach), under the name it has; gives (path, target, length). Runs once an action asks for it;
    a repeated task writes the same bytes again. Unsafe names are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
        store.create_dir(root)
        for batch in batches:
            names, sizes = [], []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name = path.as_py().rstrip("/").rpartition("/")[2]
                if name in ("", ".", ".."):
                    raise ValueError(f"{path.as_py()!r} names no file")
                data = content.as_py() or b""
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(data)
                names.append(f"{root}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "target", "length"])

    return files.select("path", "content").mapInArrow(run, "path string, target string, length bigint")


def as_json(rows: DataFrame) -> DataFrame:
    """(path, json): each row indented, without its null fields."""
    return rows.select("path", F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


def register(spark, files: DataFrame) -> None:
    """The results as temporary views: document_info, document_report, document_text, document_pages, document_first_page."""
    for name, make in (("info", info), ("report", validate), ("text", extract), ("pages", pages), ("first_page", first_page)):
        make(files).createOrReplaceTempView(f"document_{name}")
