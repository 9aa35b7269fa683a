"""Queries of the document operators over the test tables, and the SQL that gives the same rows.

Tables become PDF and OFD bytes by writers that share no code with the readers; what is read back must be what the SQL computes from the tables.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import native
from quire.operators import documents as verbs
from quire.plans import ofd as ofd_plans
from quire.plans import pdf as pdf_plans
from quire.sources import ofd, pdf, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LINES = 20


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(rows: DataFrame, make: Callable[[dict], bytes]) -> DataFrame:
    """(path, content): a file that make writes of each row; path is a column of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                yield pa.RecordBatch.from_arrays([part.column("path"), pa.array([make(r) for r in part.to_pylist()], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def key(path: str = "path"):
    """The number in a path."""
    return F.regexp_extract(path, r"(\d+)", 1).cast("bigint")


def plain(text) -> F.Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


NORM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
norm = NORM.format


def talks(spark: SparkSession, sf_dir: str, make: Callable[[dict], bytes]) -> DataFrame:
    """A package of each conversation; make gets its turns in order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return files(rows.select(F.concat(F.lit("c"), F.col("conv_id"), F.lit(".ofd")).alias("path"), "turns"), make)


def _talk(row: dict) -> bytes:
    return writers.ofd_document([[t["text"] or ""] for t in row["turns"]])


@query(f"SELECT conv_id, string_agg({norm('text')}, chr(10) ORDER BY turn) FILTER ({norm('text')} <> '') AS text FROM conversations GROUP BY conv_id")
def ofd_text_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ofd.parsed(talks(spark, sf_dir, _talk), ("text",))
    parsed = parsed.withColumn("pages", F.transform("pages", lambda p: p.withField("texts", F.transform(p["texts"], plain))))
    return ofd_plans.text(parsed).select(key().alias("conv_id"), "text")


@query("SELECT conv_id, count(*) AS page_count FROM conversations GROUP BY conv_id")
def ofd_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ofd_plans.page_count(ofd.parsed(talks(spark, sf_dir, _talk), ())).select(key().alias("conv_id"), F.col("page_count").cast("bigint").alias("page_count"))


@query(f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_no, {norm('text')} AS text FROM conversations")
def ofd_text_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ofd_plans.page_texts(ofd.parsed(talks(spark, sf_dir, _talk), ("text",))).select(key().alias("conv_id"), F.col("page_no").cast("bigint").alias("page_no"), plain("text").alias("text"))


@query(f"SELECT conv_id, {norm('text')} AS text FROM conversations WHERE turn = 1")
def ofd_extract_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = talks(spark, sf_dir, _talk).withColumn("format", F.lit("ofd"))
    return verbs.extract(packages, 2).where("error is null").select(key().alias("conv_id"), plain("text").alias("text"))


def _boxed(row: dict) -> bytes:
    return writers.ofd_document([[t["text"] or ""] for t in row["turns"]], boxes=[f"1 2 {100 + t['turn']} {200.5 + t['turn']}" if t["turn"] % 2 else None for t in row["turns"]])


@query("SELECT conv_id, turn + 1 AS page_no, CASE WHEN turn % 2 = 1 THEN 101.0 + turn ELSE 210.0 END::DOUBLE AS x1, CASE WHEN turn % 2 = 1 THEN 202.5 + turn ELSE 297.0 END::DOUBLE AS y1 FROM conversations")
def ofd_page_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.col("media_box")
    return ofd_plans.pages(ofd.parsed(talks(spark, sf_dir, _boxed), ("text",))).select(key().alias("conv_id"), F.col("page_no").cast("bigint").alias("page_no"), box[2].alias("x1"), box[3].alias("y1"))


@query("SELECT conv_id, 'ofd' AS format, '1.1' AS declared_version, count(*) AS page_count FROM conversations GROUP BY conv_id")
def ofd_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = talks(spark, sf_dir, _talk).withColumn("format", F.lit("ofd"))
    return verbs.info(packages).select(key().alias("conv_id"), "format", "declared_version", "page_count")


def _annotated(row: dict) -> bytes:
    more = writers.ofd_annotations({t["turn"] + 1: [t["role"] or ""] * (1 + t["turn"] % 3) + ["Link"] for t in row["turns"]})
    return writers.ofd_document([[""] for _ in row["turns"]], more=more)


@query("SELECT conv_id, turn + 1 AS page_id, 2 + turn % 3 AS n, array_to_string(list_sort(list_distinct(['Link', role])), ',') AS types FROM conversations")
def ofd_annotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ofd_plans.annotation_summary(ofd.parsed(talks(spark, sf_dir, _annotated), ("annotations",)))
    return rows.select(key().alias("conv_id"), "page_id", F.col("n").cast("bigint").alias("n"), F.array_join("types", ",").alias("types"))


def _resources(row: dict) -> bytes:
    i = row["item_id"]
    fonts = [(1, "A", "Res/a.ttf"), (2, "B", "/Doc_0/Res/b.ttf")]
    more = {"Doc_0/PublicRes.xml": writers.ofd_resources(fonts[:1]), "Doc_0/DocumentRes.xml": writers.ofd_resources(fonts[1:])}
    if i % 3:
        more["Res/a.ttf"] = b"font"
    if i % 2:
        more["Doc_0/Res/b.ttf"] = b"font"
    return writers.ofd_document([[row["text"] or ""]], more=more)


def items(spark: SparkSession, sf_dir: str, make: Callable[[dict], bytes]) -> DataFrame:
    return files(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), F.col("item_id"), F.lit(".ofd")).alias("path"), "item_id", "text"), make)


@query("SELECT item_id, 1 AS id, 'Res/a.ttf' AS file FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT item_id, 2, '/Doc_0/Res/b.ttf' FROM benchmark WHERE item_id % 2 = 0")
def ofd_missing_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ofd_plans.missing_resources(ofd.parsed(items(spark, sf_dir, _resources), ("resources",))).select(key().alias("item_id"), F.col("id").cast("int").alias("id"), "file")


def _sealed(row: dict) -> bytes:
    i = row["item_id"]
    more: dict = {"Doc_0/Signs/Signatures.xml": writers.ofd_signatures([(i + 1, "/Doc_0/Signs/S.esl")])}
    if i % 4 != 3:
        more["Doc_0/Signs/S.esl"] = (b"ES\x01\x02" + (40 + i % 100).to_bytes(2, "big") + b"\0\x10", b"\x30\x82\0\0\0\0" + writers.png(30 + i % 50, 20), b"XXXXXXXXX")[i % 4]
    return writers.ofd_document([[""]], more=more)


@query(
    """SELECT item_id, item_id + 1 AS id, CASE item_id % 4 WHEN 0 THEN '1.2' WHEN 1 THEN '1.0' END AS version, CASE item_id % 4 WHEN 0 THEN 40 + item_id % 100 WHEN 1 THEN 30 + item_id % 50 ELSE -1 END::BIGINT AS width,
    CASE item_id % 4 WHEN 0 THEN 16 WHEN 1 THEN 20 ELSE -1 END::BIGINT AS height, CASE item_id % 4 WHEN 1 THEN 'PNG' END AS picture,
    CASE item_id % 4 WHEN 2 THEN 'signature ' || (item_id + 1) || ': Seal.esl parse failed: invalid seal format: magic 5858' WHEN 3 THEN 'signature ' || (item_id + 1) || ': Seal.esl not found at /Doc_0/Signs/S.esl' END AS warning FROM benchmark"""
)
def ofd_seal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ofd_plans.seal_summary(ofd.parsed(items(spark, sf_dir, _sealed), ("seals",))).select(key().alias("item_id"), "id", "version", F.coalesce("width", F.lit(-1)).cast("bigint").alias("width"), F.coalesce("height", F.lit(-1)).cast("bigint").alias("height"), "picture", "warning")


def _faulty(row: dict) -> bytes:
    kind = row["item_id"] % 5
    whole = {"OFD.xml": "<OFD><DocBody><DocRoot>Doc_0/Document.xml</DocRoot></DocBody></OFD>", "Doc_0/Document.xml": "<Document/>"}
    if kind == 1:
        del whole["OFD.xml"]
    if kind == 2:
        del whole["Doc_0/Document.xml"]
    if kind == 3:
        whole["OFD.xml"] = "<OFD><DocRoot>Doc_1/Document.xml</DocRoot></OFD>"
    return b"no zip" if kind == 4 else writers.ofd(whole)


@query(
    """SELECT item_id, item_id % 5 = 0 AS valid, CASE item_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'missing OFD.xml|failed to parse DocRoot' WHEN 2 THEN 'missing Document.xml'
    WHEN 3 THEN 'DocRoot "Doc_1/Document.xml" points to a non-existent file' ELSE 'no package: File is not a zip file' END AS errors FROM benchmark"""
)
def ofd_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verbs.validate(items(spark, sf_dir, _faulty).withColumn("format", F.lit("ofd"))).select(key().alias("item_id"), "valid", F.array_join("errors", "|").alias("errors"))


@query("SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS head, embedding[len(embedding)]::DOUBLE AS tail, list_max(embedding)::DOUBLE AS greatest FROM embeddings")
def float_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " g  ")
    got = table(spark, sf_dir, "embeddings").select("vec_id", native.float_list(text).alias("v"))
    return got.select("vec_id", F.size("v").cast("bigint").alias("n"), F.col("v")[0].alias("head"), F.element_at("v", -1).alias("tail"), F.array_max("v").alias("greatest"))


def _lines(text: str) -> list[list[str]]:
    lines = (text or "").split("\n")
    return [lines[i : i + LINES] for i in range(0, len(lines), LINES)]


def papers(spark: SparkSession, sf_dir: str, make: Callable[[dict], bytes], name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    rows = table(spark, sf_dir, name)
    return files(rows.withColumn("path", F.concat(F.lit("d"), F.col(id_col), F.lit(".pdf"))), make)


def _paper(row: dict) -> bytes:
    i = row["doc_id"]
    created = f"D:2024{1 + i % 12:02d}{1 + i % 28:02d}{i % 24:02d}3015+02'00'"
    return writers.pdf_document(_lines(row["text"]), row["source"], row["lang"], created, filters=("FlateDecode",) if i % 2 else ())


@query(f"SELECT doc_id, {norm('text')} AS text FROM documents WHERE {norm('text')} <> ''")
def pdf_text_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf_plans.text(pdf.parsed(papers(spark, sf_dir, _paper), ("text",)))
    return found.where("error is null").select(key().alias("doc_id"), plain("text").alias("text"))


@query(
    f"""SELECT doc_id, page_no, {norm("string_agg(line, chr(10) ORDER BY n)")} AS text FROM (SELECT doc_id, line, n, (n - 1) // {LINES} + 1 AS page_no FROM
    (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)) GROUP BY doc_id, page_no"""
)
def pdf_text_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_plans.page_texts(pdf.parsed(papers(spark, sf_dir, _paper), ("text",))).select(key().alias("doc_id"), F.col("page_no").cast("bigint").alias("page_no"), plain("text").alias("text"))


@query(
    f"""SELECT doc_id, source AS title, lang AS author, (len(string_split(text, chr(10))) + {LINES - 1}) // {LINES} AS page_count, '1.7' AS declared_version, false AS is_encrypted,
    epoch(make_timestamp(2024, 1 + doc_id % 12, 1 + doc_id % 28, doc_id % 24, 30, 15.0))::BIGINT - 7200 AS created_s, 7200 AS created_offset FROM documents"""
)
def pdf_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verbs.info(papers(spark, sf_dir, _paper).withColumn("format", F.lit("pdf")))
    return rows.select(key().alias("doc_id"), "title", "author", "page_count", "declared_version", "is_encrypted", F.unix_timestamp("created").alias("created_s"), "created_offset")


def _filtered(row: dict) -> bytes:
    n = len(writers.FILTERS)
    i = row["item_id"]
    return writers.pdf_document(_lines(row["text"]), filters=(writers.FILTERS[i % n], *((writers.FILTERS[i // n % n],) if i % 3 else ())))


@query(f"SELECT item_id, {norm('text')} AS text FROM benchmark")
def pdf_filters_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_plans.text(pdf.parsed(papers(spark, sf_dir, _filtered, "benchmark", "item_id"), ("text",))).select(key().alias("item_id"), plain("text").alias("text"))


@query("SELECT user_id % 16 AS doc, user_id AS obj_num, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def pdf_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cross-reference entries: a user is an object, later events are newer revisions."""
    entries = table(spark, sf_dir, "events").select((F.col("user_id") % 16).cast("string").alias("path"), F.col("user_id").alias("obj_num"), (-F.col("event_id")).alias("rank"), "event_id", "value")
    return pdf_plans.latest(entries).select(F.col("path").cast("bigint").alias("doc"), "obj_num", "event_id", "value")


def _updated(row: dict) -> bytes:
    i = row["doc_id"]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 0 /Kids [] >>", 3: b"<< /Title (draft) /Author (first) >>"}
    first = writers.pdf(objects, info=3, version=f"1.{i % 8}")
    if i % 3 == 0:
        return first
    start = int(first.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    return writers.pdf({3: f"<< /Title (quality {row['quality']}) /Author (second) >>".encode()}, info=3, previous=(first, start))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'draft' ELSE 'quality ' || quality END AS title, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS author FROM labels")
def pdf_incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_plans.info(pdf.parsed(papers(spark, sf_dir, _updated, "labels"), ())).select(key().alias("doc_id"), "title", "author")


@query("SELECT doc_id, '1.' || (doc_id % 8) AS declared, '1.' || (doc_id % 8) AS effective, doc_id % 3 <> 0 AS incremental, true AS traditional_xref, false AS xref_stream, true AS eof, false AS linearized, true AS has_info FROM labels")
def pdf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pdf_plans.features(pdf.parsed(papers(spark, sf_dir, _updated, "labels"), ()))
    return rows.select(key().alias("doc_id"), "declared", "effective", "incremental", "traditional_xref", "xref_stream", "eof", "linearized", F.col("info").alias("has_info"))


@query("SELECT doc_id, 3 AS obj_num, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS revision FROM labels")
def pdf_object_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether object 3 stands in the newest section: the index of a file by the plan over its entries."""
    parsed = pdf.parsed(papers(spark, sf_dir, _updated, "labels"), ("objects",))
    sections = parsed.select("path", F.size("sections").alias("n"))
    live = pdf_plans.live_offsets(pdf_plans.xref(parsed)).where("obj_num = 3").join(pdf_plans.objects(parsed).select("path", "obj_num", F.col("offset").alias("read_at")), ["path", "obj_num"]).where("offset = read_at")
    return live.join(sections, "path").select(key().alias("doc_id"), F.col("obj_num").cast("int").alias("obj_num"), (F.col("n") - 1).cast("int").alias("revision"))


def _tree(row: dict) -> bytes:
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = []
    for k, nation in enumerate(row["nations"]):
        node, leaf = 10 + 2 * k, 11 + 2 * k
        box = f" /MediaBox [0 0 {100 + nation} 50]" if nation % 2 else ""
        turn = f" /Rotate {90 * (nation % 4)}" if nation % 3 else ""
        objects[node] = f"<< /Type /Pages /Parent 2 0 R /Count 1{box}{turn} /Kids [{leaf} 0 R {node} 0 R] >>".encode()
        objects[leaf] = f"<< /Type /Page /Parent {node} 0 R >>".encode()
        kids.append(f"{node} 0 R")
    objects[2] = f"<< /Type /Pages /Count {len(kids)} /MediaBox [0 0 {500 + row['region']} 700] /Rotate 180 /Kids [{' '.join(kids)}] >>".encode()
    return writers.pdf(dict(sorted(objects.items())))


_INHERIT = """SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS leaf_no, CASE WHEN n_nationkey % 2 = 1 THEN 100.0 + n_nationkey ELSE 500.0 + n_regionkey END::DOUBLE AS width,
CASE WHEN n_nationkey % 3 <> 0 THEN 90 * (n_nationkey % 4) ELSE 180 END::BIGINT AS rotate FROM nation"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("nations"))
    return files(rows.withColumn("path", F.concat(F.lit("r"), F.col("region"), F.lit(".pdf"))), _tree)


@query(_INHERIT)
def pdf_page_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pdf_plans.pages(pdf.parsed(regions(spark, sf_dir), ("pages",)))
    return rows.select(key().cast("int").alias("region"), F.col("leaf_no").cast("bigint").alias("leaf_no"), F.col("media_box")[2].alias("width"), "rotate")


@query(_INHERIT)
def pdf_page_tree_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pdf_plans.page_tree(pdf.parsed(regions(spark, sf_dir), ("objects",)))
    return rows.select(key().cast("int").alias("region"), F.col("leaf_no").cast("bigint").alias("leaf_no"), F.col("media_box")[2].alias("width"), "rotate")


_CLASSES = """CASE WHEN v = 1 AND r = 2 THEN 'RC4-40' WHEN (v = 1 OR v = 2) AND r = 3 THEN 'RC4-128' WHEN v = 4 AND r = 4 THEN CASE WHEN aes THEN 'AES-128' ELSE 'RC4-128' END WHEN v = 5 AND r IN (5, 6) THEN 'AES-256' ELSE 'unknown' END"""


def _encrypted(row: dict) -> bytes:
    i = row["doc_id"]
    cf = " /CF << /StdCF << /CFM /AESV2 >> >>" if i % 2 else " /CF << /StdCF << /CFM /V2 >> >>"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 0 /Kids [] >>", 3: f"<< /V {i % 6} /R {i // 6 % 7}{cf} >>".encode() if i % 11 else b"<< >>"}
    return writers.pdf(objects, trailer=" /Encrypt 3 0 R")


@query(f"SELECT doc_id, doc_id % 11 <> 0 AS encrypted, CASE WHEN doc_id % 11 <> 0 THEN {_CLASSES} END AS encryption FROM (SELECT doc_id, doc_id % 6 AS v, doc_id // 6 % 7 AS r, doc_id % 2 = 1 AS aes FROM labels)")
def pdf_encryption_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_plans.features(pdf.parsed(papers(spark, sf_dir, _encrypted, "labels"), ())).select(key().alias("doc_id"), "encrypted", "encryption")


def _broken(row: dict) -> bytes:
    kind = row["doc_id"] % 7
    box = "" if kind == 3 else " /MediaBox [0 0 10 10]"
    objects = {
        1: b"<< /Type /Wrong /Pages 2 0 R >>" if kind == 2 else b"<< /Type /Catalog /Pages 2 0 R >>",
        2: f"<< /Type /Pages /Kids [3 0 R]{box}{'' if kind == 6 else ' /Count 1'} >>".encode(),
        3: b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 4 0 R >> >> >>",
        4: b"<< /Type /Font /Subtype /Type1 >>" if kind == 4 else b"<< /Type /Font /Subtype /Type1 /BaseFont /A >>",
    }
    out = writers.pdf(objects, root=None if kind == 1 else 1)
    return b"%ABC-" + out[5:] if kind == 5 else out


_BROKEN = """CASE doc_id % 7 WHEN 1 THEN 'trailer: required /Root reference not found|catalog: cannot read catalog object' WHEN 2 THEN 'catalog: expected /Type /Catalog, got /Type /Wrong'
WHEN 3 THEN 'pages: page 3 0 R: required /MediaBox not found (no inherited value)' WHEN 5 THEN 'header: missing PDF header' ELSE '' END"""


@query(f"SELECT doc_id, doc_id % 7 IN (0, 4, 6) AS valid, {_BROKEN} AS errors, CASE doc_id % 7 WHEN 4 THEN 'fonts: font 4 0 R: /BaseFont not found' WHEN 6 THEN 'pages: /Count not found' ELSE '' END AS warnings FROM labels")
def pdf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verbs.validate(papers(spark, sf_dir, _broken, "labels").withColumn("format", F.lit("pdf")))
    return rows.select(key().alias("doc_id"), "valid", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


@query(
    """SELECT level, severity, count(*) AS n FROM (SELECT unnest(CASE doc_id % 7 WHEN 1 THEN [('trailer', 'error'), ('catalog', 'error')] WHEN 2 THEN [('catalog', 'error')] WHEN 3 THEN [('pages', 'error')]
    WHEN 4 THEN [('fonts', 'warning')] WHEN 5 THEN [('header', 'error')] WHEN 6 THEN [('pages', 'warning')] ELSE [] END) AS f, f[1] AS level, f[2] AS severity FROM labels) GROUP BY level, severity"""
)
def pdf_findings_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_plans.findings(pdf.parsed(papers(spark, sf_dir, _broken, "labels"), ("findings",))).groupBy("level", "severity").agg(F.count("*").alias("n"))


def _lost(row: dict) -> bytes:
    i = row["doc_id"]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 0 /Kids [] >>", 9: b"<< >>"}
    out = writers.pdf(objects, offsets={2: 1} if i % 3 == 0 else None)
    return out.replace(b"9 0 obj", b"9_0_obj") if i % 4 == 0 else out


@query("SELECT doc_id, 9 AS obj_num FROM labels WHERE doc_id % 4 = 0")
def pdf_deep_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose offset is wrong are found by a scan; those that stand nowhere are missing."""
    return pdf_plans.deep_findings(pdf.parsed(papers(spark, sf_dir, _lost, "labels"), ("objects",))).select(key().alias("doc_id"), F.col("obj_num").cast("int").alias("obj_num"))


@query("SELECT doc_id, (doc_id % 4 = 0) AS lost FROM labels")
def pdf_validate_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verb's own deep switch."""
    found = verbs.validate(papers(spark, sf_dir, _lost, "labels"), deep=True)
    return found.select(key().alias("doc_id"), (F.array_contains("errors", "object 9 not found") & ~F.col("valid")).alias("lost"))


@query(
    """SELECT l_orderkey, l_linenumber, (15 + sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS at
    FROM (SELECT l_orderkey, l_linenumber, sum(l_partkey % 100)::BIGINT AS n FROM lineitem GROUP BY ALL)"""
)
def pdf_rewrite_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("obj_num")).agg(F.sum(F.col("l_partkey") % 100).alias("length"))
    return pdf_plans.rewrite_offsets(rows, 15).select(F.col("path").alias("l_orderkey"), F.col("obj_num").alias("l_linenumber"), F.col("offset").alias("at"))


@query("SELECT doc_id, 1 AS sections, CASE WHEN doc_id % 3 = 0 THEN 'draft' ELSE 'quality ' || quality END AS title, 4 AS size FROM labels")
def pdf_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewritten file has one section and the newest objects."""
    rows = pdf.parsed(verbs.rewrite(papers(spark, sf_dir, _updated, "labels")), ())
    return rows.select(key().alias("doc_id"), F.size("sections").alias("sections"), "info.title", F.col("sections")[0]["size"].cast("int").alias("size"))


_LATIN = "[^ -~À-ÖØ-öø-ÿ]"


def _western(row: dict) -> bytes:
    data = row["latin"].encode("cp1252").hex().encode()
    fonts = b"<< /Type /Font /Subtype /TrueType /BaseFont /A /Encoding /WinAnsiEncoding >>"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 9 9] /Resources << /Font << /W 4 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", 4: fonts, 5: writers.pdf_stream(b"BT /W 9 Tf [<" + data + b">] TJ ET")}
    return writers.pdf(objects)


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_LATIN}', '', 'g')) AS text FROM documents WHERE trim(regexp_replace(text, '{_LATIN}', '', 'g')) <> ''")
def pdf_fonts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-byte text of an inherited font."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".pdf")).alias("path"), F.regexp_replace("text", _LATIN, "").alias("latin"))
    found = pdf_plans.text(pdf.parsed(files(rows, _western), ("text",)))
    return found.where("error is null").select(key().alias("doc_id"), "text")


def _mapped(row: dict) -> bytes:
    """Text by a CMap: code n of a composite font is the n-th distinct character."""
    letters = sorted(set(row["text"]))
    code = {c: i + 1 for i, c in enumerate(letters)}
    chars = "\n".join(f"<{i:04X}> <{c.encode('utf-16-be').hex()}>" for c, i in code.items())
    cmap = f"/CIDInit /ProcSet findresource begin\n{len(code)} beginbfchar\n{chars}\nendbfchar\nend".encode()
    shown = "".join(f"{code[c]:04X}" for c in row["text"]).encode()
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /C /ToUnicode 6 0 R >>"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 9 9] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /C 4 0 R >> >> >>", 4: font, 5: writers.pdf_stream(b"BT /C 9 Tf <" + shown + b"> Tj ET"), 6: writers.pdf_stream(cmap)}
    return writers.pdf(objects)


@query(f"SELECT item_id, {norm('text')} AS text FROM benchmark")
def pdf_cmap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_plans.text(pdf.parsed(papers(spark, sf_dir, _mapped, "benchmark", "item_id"), ("text",))).select(key().alias("item_id"), plain("text").alias("text"))


@query(
    """SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title', 1), '<[^>]*>', '', 'g')), '') AS title,
    nullif(regexp_extract(html, '(?s)lang=["'']([^"'']*)["'']', 1), '') AS lang FROM pages"""
)
def xml_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", native.tag_value(html, "title").alias("title"), native.quoted(html, "lang").alias("lang"))


@query("SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", native.strip_tags(F.col("html")).alias("text"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'ofd' END AS format, page_id % 3 <> 0 AS safe FROM pages")
def route_and_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.get(F.array(F.lit(".PDF"), F.lit(".Ofd"), F.lit(".pdf.zip"), F.lit("")), (F.col("page_id") % 4).cast("int"))
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "a/../../b").otherwise("a/../c"), F.col("page_id").cast("string"), end)
    return table(spark, sf_dir, "pages").select("page_id", native.route_format(path).alias("format"), native.path_is_safe(path).alias("safe"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS at_s, 3600 * (event_id % 5 - 2) AS offset_s FROM events")
def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as PDF dates in different zones, read back as instants."""
    hours = (F.col("event_id") % 5 - 2).cast("int")
    local = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.date_trunc("second", "ts")) + hours * 3600), "yyyyMMddHHmmss")
    text = F.concat(F.lit("D:"), local, F.when(hours < 0, "-").otherwise("+"), F.format_string("%02d'00'", F.abs(hours)))
    date = native.pdf_date(text)
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(date["at"]).alias("at_s"), date["offset_s"].cast("bigint").alias("offset_s"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 49 THEN p_size // 10 ELSE -1 END::INT AS major, CASE WHEN p_size BETWEEN 10 AND 49 THEN p_size % 10 ELSE -1 END::INT AS minor, p_size BETWEEN 15 AND 49 AS at_least_15 FROM part")
def pdf_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as versions: 15 is 1.5, and 50 is written as 50.0, which is none."""
    size = F.col("p_size")
    text = F.when(size.between(10, 49), F.concat(F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"))).otherwise(F.concat(size.cast("string"), F.lit("0.0")))
    found = native.version(text)
    enough = F.coalesce(found >= F.struct(F.lit(1).alias("major"), F.lit(5).alias("minor")), F.lit(False))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(found["major"], F.lit(-1)).alias("major"), F.coalesce(found["minor"], F.lit(-1)).alias("minor"), enough.alias("at_least_15"))


@query("SELECT item_id, 'PDF/A-' || (1 + item_id % 3) || CASE WHEN item_id % 2 = 0 THEN 'B' ELSE 'U' END AS pdfa, CASE WHEN item_id % 2 = 0 THEN 'Title ' || item_id ELSE 'About ' || item_id END AS title, 'Tool' AS creator FROM benchmark")
def pdf_xmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pdf_plans.info(pdf.parsed(papers(spark, sf_dir, _described, "benchmark", "item_id"), ()))
    return rows.select(key().alias("item_id"), F.col("pdfa_conformance").alias("pdfa"), "title", "creator")


def _described(row: dict) -> bytes:
    i = row["item_id"]
    if i % 2 == 0:
        xmp = f"<x:xmpmeta><rdf:Description pdfaid:part='{1 + i % 3}' pdfaid:conformance=\"b\"><dc:title><rdf:Alt><rdf:li>Title {i}</rdf:li></rdf:Alt></dc:title><dc:subject>no</dc:subject>"
    else:
        xmp = f"<x:xmpmeta><rdf:Description><pdfaid:part>{1 + i % 3}</pdfaid:part><pdfaid:conformance>U</pdfaid:conformance><dc:description> About <b>{i}</b></dc:description>"
    xmp += "<xmp:CreatorTool>Tool</xmp:CreatorTool></rdf:Description></x:xmpmeta>"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /Metadata 3 0 R >>", 2: b"<< /Type /Pages /Count 0 /Kids [] >>", 3: writers.pdf_stream(writers.encoded(xmp.encode(), "FlateDecode"), " /Type /Metadata /Filter /FlateDecode")}
    return writers.pdf(objects)


_FRAME = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 9 9] >>"}


def _one_page(content: bytes, font: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /A >>") -> dict[int, bytes]:
    """Objects of a file with one page, whose content stream is given as it stands."""
    return _FRAME | {3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F 4 0 R >> >> >>", 4: font, 5: content}


def _compact(row: dict) -> bytes:
    body = f"BT /F 9 Tf {writers.pdf_string(row['text'])} Tj ET".encode()
    return writers.pdf_packed(_one_page(writers.pdf_stream(body)), predictor=row["item_id"] % 2 == 0)


@query(f"SELECT item_id, {norm('text')} AS text, '1.4' AS declared, '1.5' AS effective, true AS xref_stream, true AS object_streams, false AS traditional_xref, 4 AS members FROM benchmark")
def pdf_object_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose objects stand in an object stream, with and without a predictor in the index."""
    parsed = pdf.parsed(papers(spark, sf_dir, _compact, "benchmark", "item_id"), ("text", "objects"))
    members = F.size(F.filter("xref", lambda x: x["kind"] == "stream")).alias("members")
    page = F.get("pages", F.lit(0))
    flags = (F.col(f"features.{c}").alias(c) for c in ("declared", "effective", "xref_stream", "object_streams", "traditional_xref"))
    return parsed.select(key().alias("item_id"), plain(page["texts"][0]).alias("text"), *flags, members)


def _hybrid(row: dict) -> bytes:
    i = row["doc_id"]
    base = writers.pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 0 /Kids [] >>", 3: b"<< /Title (old) >>"}, info=3)
    if i % 2 == 0:
        return base
    start = int(base.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    out, new = bytearray(base), len(base)
    out += f"3 0 obj\n<< /Title (new {i}) >>\nendobj\n".encode()
    at = len(out)
    out += b"9 0 obj\n" + writers.pdf_stream(b"\x01" + new.to_bytes(4, "big"), " /Type /XRef /Size 4 /W [1 4 0] /Index [3 1]") + b"\nendobj\n"
    table = len(out)
    return bytes(out + f"xref\n0 0\ntrailer\n<< /Size 10 /Root 1 0 R /Info 3 0 R /Prev {start} /XRefStm {at} >>\nstartxref\n{table}\n%%EOF\n".encode())


@query("SELECT doc_id, doc_id % 2 = 1 AS hybrid, CASE WHEN doc_id % 2 = 1 THEN 'new ' || doc_id ELSE 'old' END AS title, CASE WHEN doc_id % 2 = 1 THEN 'table,stream,table' ELSE 'table' END AS kinds FROM labels")
def pdf_hybrid_xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's stream is read after its table and before older sections."""
    parsed = pdf.parsed(papers(spark, sf_dir, _hybrid, "labels"), ())
    return parsed.select(key().alias("doc_id"), "features.hybrid", "info.title", F.array_join("sections.kind", ",").alias("kinds"))


def _misplaced(row: dict) -> bytes:
    i = row["doc_id"]
    out = writers.pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {i % 50} /Kids [] >>".encode()})
    head, _, tail = out.rpartition(b"startxref\n")
    return (out, head + b"%%EOF\n", head + b"startxref\n3\n%%EOF\n", head + b"startxref\n" + tail)[i % 4]


@query("SELECT doc_id, doc_id % 50 AS page_count, CASE doc_id % 4 WHEN 1 THEN 'startxref marker not found or unreadable' WHEN 2 THEN 'no cross-reference section at 3' ELSE '' END AS warning FROM labels")
def pdf_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file without a usable startxref is read by its last table, with a warning."""
    parsed = pdf.parsed(papers(spark, sf_dir, _misplaced, "labels"), ())
    return parsed.select(key().alias("doc_id"), "info.page_count", F.regexp_extract(F.array_join("warnings", "|"), "^[^;:]*", 0).alias("warning"))


def _identified(row: dict) -> bytes:
    i = row["doc_id"]
    ids = f"[<{i * 7919:08x}> <{i + 1:08X}>]" if i % 3 else f"[(first {i}) (second)]"
    return writers.pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 0 /Kids [] >>"}, trailer=f" /ID {ids}" if i % 5 else "")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 <> 0 THEN format('{:08X}', doc_id * 7919) ELSE 'first ' || doc_id END END AS created_as,
    CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 <> 0 THEN format('{:08X}', doc_id + 1) ELSE 'second' END END AS saved_as FROM labels"""
)
def pdf_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("file_identifiers")
    rows = pdf_plans.info(pdf.parsed(papers(spark, sf_dir, _identified, "labels"), ()))
    return rows.select(key().alias("doc_id"), F.get(ids, F.lit(0)).alias("created_as"), F.get(ids, F.lit(1)).alias("saved_as"))


def _moved(row: dict) -> bytes:
    """Lines by each operator that starts one, words apart by gaps in an array."""
    shown = []
    for n, line in enumerate((row["text"] or "").split("\n")):
        if n % 3 == 0:
            shown.append("0 -12 Td [" + " -300 ".join(writers.pdf_literal(w) for w in line.split(" ")) + "] TJ")
        elif n % 3 == 1:
            shown.append(f"{writers.pdf_literal(line)} '")
        else:
            shown.append(f'1 2 {writers.pdf_literal(line)} "')
    return writers.pdf(_one_page(writers.pdf_stream(("BT /F 9 Tf " + " ".join(shown) + " ET").encode())))


@query(f"SELECT doc_id, {norm('text')} AS text FROM documents WHERE {norm('text')} <> ''")
def pdf_text_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal strings with escapes; gaps are spaces, steps down and quotes are lines."""
    found = pdf_plans.text(pdf.parsed(papers(spark, sf_dir, _moved), ("text",)))
    return found.where("error is null").select(key().alias("doc_id"), plain("text").alias("text"))


_MARKS = {"́": "acute", "̀": "grave", "̂": "circumflex", "̈": "dieresis", "̃": "tilde", "̊": "ring", "̧": "cedilla"}


def _renamed(row: dict) -> bytes:
    """Codes from 128 on for the letters beyond ASCII, by names where a letter has an accent, else by code points."""
    text = row["latin"]
    letters = sorted({c for c in text if ord(c) > 127})
    code = {c: 128 + i for i, c in enumerate(letters)}
    parts = {c: unicodedata.normalize("NFD", c) for c in letters}
    names = [f"/{p[0]}{_MARKS[p[1]]}" if len(p) == 2 and p[1] in _MARKS else f"/uni{ord(c):04X}" for c, p in parts.items()]
    font = f"<< /Type /Font /Subtype /Type1 /BaseFont /A /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [128 {' '.join(names)}] >> >>".encode()
    data = bytes(code.get(c, ord(c)) for c in text).hex().encode()
    return writers.pdf(_one_page(writers.pdf_stream(b"BT /F 9 Tf <" + data + b"> Tj ET"), font))


def latin(spark: SparkSession, sf_dir: str, pattern: str, make: Callable[[dict], bytes]) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".pdf")).alias("path"), F.regexp_replace("text", pattern, "").alias("latin"))
    return files(rows, make)


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_LATIN}', '', 'g')) AS text FROM documents WHERE trim(regexp_replace(text, '{_LATIN}', '', 'g')) <> ''")
def pdf_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf_plans.text(pdf.parsed(latin(spark, sf_dir, _LATIN, _renamed), ("text",)))
    return found.where("error is null").select(key().alias("doc_id"), "text")


_MAC = "[^ -~ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜßàáâãäåæçèéêëìíîïñòóôõöøùúûüÿ]"


def _mac(row: dict) -> bytes:
    font = b"<< /Type /Font /Subtype /TrueType /BaseFont /A /Encoding /MacRomanEncoding >>"
    return writers.pdf(_one_page(writers.pdf_stream(b"BT /F 9 Tf <" + row["latin"].encode("mac_roman").hex().encode() + b"> Tj ET"), font))


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_MAC}', '', 'g')) AS text FROM documents WHERE trim(regexp_replace(text, '{_MAC}', '', 'g')) <> ''")
def pdf_mac_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf_plans.text(pdf.parsed(latin(spark, sf_dir, _MAC, _mac), ("text",)))
    return found.where("error is null").select(key().alias("doc_id"), "text")


def _odd_streams(row: dict) -> bytes:
    """Streams whose filter leaves bytes as they are, whose length is too long, and whose length stands elsewhere."""
    i = row["item_id"]
    body = f"BT /F 9 Tf {writers.pdf_string(row['text'])} Tj ET".encode()
    names = ("", " /Filter /DCTDecode", " /Filter [/JPXDecode]", " /Filter /CCITTFaxDecode", " /Filter /JBIG2Decode")[i % 5]
    length = (str(len(body)), str(len(body) + 7), "9 0 R")[i % 3]
    content = f"<< /Length {length}{names} >>\nstream\n".encode() + body + b"\nendstream"
    return writers.pdf(_one_page(content) | {9: str(len(body)).encode()})


@query(f"SELECT item_id, {norm('text')} AS text FROM benchmark")
def pdf_stream_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_plans.text(pdf.parsed(papers(spark, sf_dir, _odd_streams, "benchmark", "item_id"), ("text",))).select(key().alias("item_id"), plain("text").alias("text"))


def _numbered(row: dict) -> bytes:
    """Pages that say where they stand; each third one has no contents."""
    i = row["doc_id"]
    leaves = range(1, 2 + i % 5)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {len(leaves)} /MediaBox [0 0 {100 + i % 90} 50] /Kids [{' '.join(f'{10 * n} 0 R' for n in leaves)}] >>".encode()}
    for n in leaves:
        objects[10 * n] = b"<< /Type /Page /Parent 2 0 R" + (f" /Contents {10 * n + 1} 0 R" if n % 3 else "").encode() + b" >>"
        if n % 3:
            objects[10 * n + 1] = writers.pdf_stream(f"BT (leaf {n} of {i}) Tj ET".encode())
    return writers.pdf(objects)


_LEAVES = "(SELECT doc_id, unnest(range(1, 2 + doc_id % 5)) AS n FROM labels)"
_CONTENT = "'BT (leaf ' || n || ' of ' || doc_id || ') Tj ET'"


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS page_no, {_CONTENT} AS content, length({_CONTENT}) AS content_size, (100 + doc_id % 90)::DOUBLE AS width FROM {_LEAVES} WHERE n % 3 <> 0")
def documents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verb that goes through pages; those without contents have no number."""
    rows = verbs.pages(papers(spark, sf_dir, _numbered, "labels"))
    return rows.select(key().alias("doc_id"), F.col("page_no").cast("bigint").alias("page_no"), F.col("content").cast("string").alias("content"), F.col("content_size").cast("bigint").alias("content_size"), F.col("media_box")[2].alias("width"))


@query(f"SELECT doc_id, {_CONTENT} AS content FROM {_LEAVES} WHERE n = 4")
def documents_read_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page with contents is the fourth leaf."""
    return verbs.read_page(papers(spark, sf_dir, _numbered, "labels"), 3).select(key().alias("doc_id"), F.col("content").cast("string").alias("content"))


@query(f"SELECT doc_id, n AS leaf_no, n - 1 AS page_no, {_CONTENT} AS content FROM {_LEAVES} WHERE n = 4")
def pdf_go_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pdf_plans.go_to(pdf.parsed(papers(spark, sf_dir, _numbered, "labels"), ("content",)), "40 0 R")
    return rows.select(key().alias("doc_id"), F.col("leaf_no").cast("bigint").alias("leaf_no"), F.col("page_no").cast("bigint").alias("page_no"), F.col("content").cast("string").alias("content"))


@query("SELECT 'd' || doc_id || '.pdf' AS path, '10 0 R' AS page_ref, '2 0 R' AS parent, (100 + doc_id % 90)::DOUBLE AS width, '11 0 R' AS contents FROM labels UNION ALL SELECT DISTINCT 'c' || conv_id || '.ofd', NULL, NULL, 210, NULL FROM conversations")
def documents_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages of files of both kinds."""
    both = papers(spark, sf_dir, _numbered, "labels").unionByName(talks(spark, sf_dir, _talk))
    return verbs.first_page(both).select("path", "page_ref", "parent", F.col("media_box")[2].alias("width"), F.array_join("contents", ",").alias("contents"))


@query(
    """SELECT conv_id, 2 AS page_no, 'Doc_0/Pages/Page_1/Content.xml' AS entry FROM conversations GROUP BY conv_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT conv_id, 0, 'OFD.xml' FROM conversations"""
)
def ofd_go_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of packages: a page's has its number, any other has 0."""
    parsed = ofd.parsed(talks(spark, sf_dir, _talk), ())
    found = ofd_plans.go_to(parsed, "Doc_0/Pages/Page_1/Content.xml").unionByName(ofd_plans.go_to(parsed, "OFD.xml"))
    return found.select(key().alias("conv_id"), F.col("page_no").cast("int").alias("page_no"), "entry")


def _placed(row: dict) -> bytes:
    return writers.ofd_document([[w for w in (t["text"] or "").split(" ")[:3] if w.strip()] + [f"end {t['turn']}"] for t in row["turns"]])


@query(
    """SELECT conv_id, turn + 1 AS page, 'end ' || turn AS text, true AS sized, 0.0::DOUBLE AS left_, 100.0::DOUBLE AS width FROM conversations"""
)
def ofd_text_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text object of each page, with its box and the size of its font."""
    codes = ofd_plans.text_codes(ofd.parsed(talks(spark, sf_dir, _placed), ("codes",)))
    last = codes.where("text like 'end %' and boundary[1] = y and object_id = y + 1 and ord = 1 and font = 1")
    return last.select(key().alias("conv_id"), F.col("page").cast("bigint").alias("page"), "text", (F.col("font_size") == 3.5).alias("sized"), F.col("boundary")[0].alias("left_"), F.col("boundary")[2].alias("width"))


def _noted(row: dict) -> bytes:
    i = row["item_id"]
    notes = f'<Annot ID="{i + 1}" Type="Stamp" Subtype="S{i % 3}" Creator="Tool" LastModDate="2024-01-{1 + i % 28:02d}"><Appearance Boundary="1 2 {i} 4.5"/><Parameters><Parameter Name="kind"> k{i % 7} </Parameter><Parameter Name="empty"/></Parameters></Annot>'
    more = {"Doc_0/Annots/Annotations.xml": '<Annotations><Page PageID="1"><FileLoc>/Doc_0/Annots/P.xml</FileLoc></Page></Annotations>', "Doc_0/Annots/P.xml": f"<PageAnnot>{notes}</PageAnnot>"}
    return writers.ofd_document([[""]], more=more)


@query(
    """SELECT item_id, item_id + 1 AS id, 'Stamp' AS type, 'S' || (item_id % 3) AS subtype, 'Tool' AS creator, format('2024-01-{:02d}', 1 + item_id % 28) AS modified, item_id::DOUBLE AS width, 'k' || (item_id % 7) AS kind, 2 AS n_parameters FROM benchmark"""
)
def ofd_annotation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ofd.parsed(items(spark, sf_dir, _noted), ("annotations",)).select("path", F.explode("annotations").alias("a")).select("path", "a.*")
    return rows.select(key().alias("item_id"), "id", "type", "subtype", "creator", "modified", native.float_list(F.col("boundary"))[2].alias("width"), F.col("parameters")["kind"].alias("kind"), F.size("parameters").alias("n_parameters"))


def _pictured(row: dict) -> bytes:
    i = row["item_id"]
    file = f"<MediaFile> Res/m{i}.png </MediaFile>" if i % 2 else ""
    media = f'<Res><MultiMedias><MultiMedia ID="{i + 1}" Type="Image" Format="PNG"{"" if i % 2 else f" MediaFile={chr(34)}Res/a{i}.png{chr(34)}"}>{file}</MultiMedia><MultiMedia Type="Image"/></MultiMedias></Res>'
    return writers.ofd_document([[""]], more={"Doc_0/DocumentRes.xml": media})


@query("SELECT item_id, item_id + 1 AS id, 'Image' AS type, 'PNG' AS format, CASE WHEN item_id % 2 = 1 THEN 'Res/m' || item_id ELSE 'Res/a' || item_id END || '.png' AS file FROM benchmark")
def ofd_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media by nested elements and by attributes; those without a number are left out."""
    return ofd.parsed(items(spark, sf_dir, _pictured), ("resources",)).select(key().alias("item_id"), F.inline("media"))


def _oversized(row: dict) -> bytes:
    i = row["item_id"]
    if i % 50 == 0:
        return writers.ofd({f"f{n}": b"" for n in range(ofd.ENTRIES + 1)})
    if i % 50 == 1:
        return writers.ofd({"OFD.xml": "<OFD><DocBody><DocRoot>Doc_0/Document.xml</DocRoot></DocBody></OFD>", "Doc_0/Document.xml": b"<Document>" + b" " * ofd.XML_BYTES + b"</Document>"})
    return writers.ofd_document([[""]])


@query("SELECT item_id, item_id % 50 > 1 AS whole FROM benchmark")
def ofd_package_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of too many entries, and those with too long an entry, are refused."""
    return ofd.parsed(items(spark, sf_dir, _oversized), ()).select(key().alias("item_id"), (F.col("error").isNull() & (F.size("pages") == 1)).alias("whole"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS length, sha256(coalesce(text, '')) AS digest FROM documents")
def documents_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies, read again from where they stand."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "/tmp/checkpoints/quire"
    target = f"{shared.rstrip('/')}/quire-copies-{uuid.uuid4().hex}"
    verbs.copy(papers(spark, sf_dir, _as_it_is), target.removeprefix("file:")).write.format("noop").mode("overwrite").save()
    copies = spark.read.format("binaryFile").load(target)
    return copies.select(key(F.substring_index("path", "/", -1)).alias("doc_id"), "length", F.sha2("content", 256).alias("digest"))


def _as_it_is(row: dict) -> bytes:
    return (row["text"] or "").encode()


@query("SELECT doc_id, 'draft' || doc_id AS title, true AS indented, true AS without_nulls FROM labels")
def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as indented JSON, without what is null."""
    shown = verbs.as_json(verbs.info(papers(spark, sf_dir, _titled, "labels")))
    json = F.col("json")
    return shown.select(key().alias("doc_id"), F.get_json_object(json, "$.title").alias("title"), json.contains('\n  "title" : ').alias("indented"), (~json.contains("producer")).alias("without_nulls"))


def _titled(row: dict) -> bytes:
    return writers.pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 0 /Kids [] >>", 3: f"<< /Title (draft{row['doc_id']}) >>".encode()}, info=3)


@query("SELECT 'd' || doc_id || '.pdf' AS path, 1 + doc_id % 5 AS page_count, true AS valid, 'leaf 1 of ' || doc_id AS head FROM labels")
def documents_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verbs' results as views, joined in SQL."""
    verbs.register(spark, papers(spark, sf_dir, _numbered, "labels"))
    return spark.sql(
        """SELECT i.path, i.page_count, r.valid, regexp_extract(t.text, '^leaf 1 of [0-9]+', 0) AS head
        FROM document_info i JOIN document_report r ON i.path = r.path JOIN document_text t ON i.path = t.path"""
    )


def _peculiar(row: dict) -> bytes:
    i = row["doc_id"]
    odd = f"<< /N +{i}.500 /S (a\\050{i}) /H <0a 0B> /Of 9 0 R >>".encode()
    return writers.pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 0 /Kids [] >>", 3: odd, 8: writers.pdf_stream(b"x" * (i % 9), " /Odd 1.50"), 9: b"007"})


@query("SELECT doc_id, '<< /N +' || doc_id || '.500 /S (a' || chr(92) || '050' || doc_id || ') /H <0a 0B> /Of 9 0 R >>' AS odd, '<< /Length ' || (doc_id % 9) || ' /Odd 1.50 >>' AS stream, '007' AS number FROM labels")
def pdf_raw_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewritten file keeps its values as they were written."""
    text = F.col("content").cast("string")
    rows = verbs.rewrite(papers(spark, sf_dir, _peculiar, "labels")).withColumn("content", F.decode("content", "ISO-8859-1"))
    value = lambda num: F.regexp_extract(text, rf"(?s)\n{num} 0 obj\n(.*?)\n(stream|endobj)", 1)
    return rows.select(key().alias("doc_id"), value(3).alias("odd"), value(8).alias("stream"), value(9).alias("number"))
