"""Admission, capacity, archive entry rules, hash reuse and page assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.text import contact_fields, file_extension, near_empty, scrub, trim_ws
from rankmill.operators.ranking import top_k
from rankmill.session import cut_lineage

# Reasons stored with a refused item.
ZIP_TOO_LARGE = "ZIP files can be up to 500 MB"
FILE_TYPE = "Only PDF, DOCX, and ZIP files are supported"
FILE_TOO_LARGE = "File is larger than 15 MB"
NEEDS_OCR = "Extracted text was nearly empty; this CV needs OCR"


@dataclass(frozen=True)
class IntakeLimits:
    max_items: int = 700
    max_file_bytes: int = 15 * 1024 * 1024
    max_archive_bytes: int = 500 * 1024 * 1024
    min_chars: int = 80
    extensions: tuple[str, ...] = (".pdf", ".docx")


DEFAULT_LIMITS = IntakeLimits()


def admission_reason(file_name: Column, size: Column, limits: IntakeLimits = DEFAULT_LIMITS) -> Column:
    """Reason to refuse a file; null admits it."""
    ext = file_extension(file_name)
    is_zip = ext == ".zip"
    return (
        F.when(is_zip & (size > limits.max_archive_bytes), ZIP_TOO_LARGE)
        .when(~is_zip & ~ext.isin(*limits.extensions), FILE_TYPE)
        .when(~is_zip & (size > limits.max_file_bytes), FILE_TOO_LARGE)
    )


def admit_files(files: DataFrame, limits: IntakeLimits = DEFAULT_LIMITS) -> DataFrame:
    """``files`` has file_name and size; refused files stay as error rows."""
    reason = admission_reason(F.col("file_name"), F.col("size"), limits)
    status = (
        F.when(reason.isNotNull(), "error")
        .when(file_extension(F.col("file_name")) == ".zip", "archive")
        .otherwise("accepted")
    )
    return files.withColumns({"status": status, "reason": reason})


def within_capacity(
    incoming: DataFrame, existing: DataFrame, job: str, seq: str, limit: int
) -> DataFrame:
    """Accepted rows with their slot; the skipped count of the job comes along.

    Cut per map partition to ``limit`` rows per job before the shuffle.
    """
    held = existing.groupBy(job).agg(F.count(F.lit(1)).alias("held"))
    offered = incoming.groupBy(job).agg(F.count(F.lit(1)).alias("offered"))
    room = offered.join(held, job, "left").select(
        job, "offered", F.greatest(F.lit(0), F.lit(limit) - F.coalesce("held", F.lit(0))).alias("room")
    )
    return (
        top_k(incoming, [job], [F.col(seq)], limit, "slot")
        .join(room, job)
        .where("slot <= room")
        .withColumn("skipped", F.greatest(F.lit(0), F.col("offered") - F.col("room")))
        .drop("offered", "room")
    )


def archive_entry_ok(entry: Column, size: Column, limits: IntakeLimits = DEFAULT_LIMITS) -> Column:
    path = F.replace(entry, F.lit("\\"), F.lit("/"))
    base = F.element_at(F.split(path, "/"), -1)
    return (
        ~path.endswith("/")
        & ~F.array_contains(F.split(path, "/"), "..")
        & ~path.startswith("/")
        & ~F.contains(path, F.lit("__MACOSX/"))
        & ~base.startswith(".")
        & file_extension(base).isin(*limits.extensions)
        & (size > 0)
        & (size <= limits.max_file_bytes)
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def content_store(history: DataFrame, row_id: str, min_chars: int = 80) -> DataFrame:
    """Parsed content of every hash: ``content_hash, reused_from, raw_text, pages, anonymized_text, contact``.

    ``history``: row_id, text, content_hash. Only hash and id travel to find the first parsed row of a content, so a
    content of a third of all rows is a row per task; the text is parsed once per content.
    """
    earlier = history.where(~near_empty(F.col("text"), min_chars))
    first = earlier.groupBy("content_hash").agg(F.min(row_id).alias("reused_from"))
    held = earlier.join(first, (earlier["content_hash"] == first["content_hash"]) & (earlier[row_id] == first["reused_from"]), "left_semi")
    return held.select("content_hash", F.col(row_id).alias("reused_from"), *parsed_content(F.col("text"))).dropDuplicates(["content_hash"])


def parsed_content(text: Column) -> list[Column]:
    """What parsing a text yields: the text, its pages, the scrubbed text and the contact fields."""
    pages = F.filter(F.transform(F.split(text, "\f"), trim_ws), lambda p: F.length(p) > 0)
    return [text.alias("raw_text"), pages.alias("pages"), scrub(text).alias("anonymized_text"), contact_fields(text).alias("contact")]


def reuse_by_hash(rows: DataFrame, known: Column, row_id: str, min_chars: int = 80) -> DataFrame:
    """New items take over the parsed content of earlier ones with the same hash; the table is read and hashed once.

    ``known`` marks earlier rows. A new item without an earlier copy has null content: it goes on to the parser.
    The store holds one row per hash, and only hashes that new items have are parsed, so a content
    of a third of the new items is split by the skew join.
    """
    hashed = cut_lineage(rows.select(row_id, "text", F.coalesce(known, F.lit(False)).alias("_known"), content_hash(F.col("text")).alias("content_hash")), "hashed")
    fresh = hashed.where(~F.col("_known")).select(row_id, "content_hash", F.coalesce(near_empty(F.col("text"), min_chars), F.lit(True)).alias("_empty"))
    wanted = fresh.select("content_hash").distinct()
    store = content_store(hashed.where("_known").drop("_known").join(wanted, "content_hash", "left_semi"), row_id, min_chars)
    status = F.when(F.col("reused_from").isNotNull() | ~F.col("_empty"), "parsed").otherwise("needs_ocr")
    return fresh.join(cut_lineage(store, "content"), "content_hash", "left").select(
        row_id, "content_hash", "reused_from", status.alias("parse_status"), "raw_text", "pages", "anonymized_text", "contact"
    )


def parse_status(text: Column, min_chars: int = 80) -> Column:
    return F.when(near_empty(text, min_chars), "needs_ocr").otherwise("parsed")


def assemble_pages(pages: DataFrame, doc: str, number: str, text: str) -> DataFrame:
    """One text per document: pages in order, trimmed, empty ones dropped.

    File sizes are judged at admission, never here: a document of any length is
    kept. Where the text is not needed in one value, ``ordered_pages`` keeps page rows.
    """
    page = F.struct(F.col(number).alias("n"), trim_ws(F.col(text)).alias("t"))
    kept = F.filter(F.array_sort(F.collect_list(page)), lambda p: F.length(p["t"]) > 0)
    return (
        pages.groupBy(doc)
        .agg(F.transform(kept, lambda p: p["t"]).alias("pages"))
        .select(doc, "pages", F.array_join("pages", "\n\n").alias("text"), F.lit("parsed").alias("status"))
    )


def ordered_pages(pages: DataFrame, doc: str, number: str, text: str) -> DataFrame:
    """Filled pages as rows, trimmed, spread by (document, page): no document is one value."""
    return pages.select(doc, number, trim_ws(F.col(text)).alias(text)).where(F.length(text) > 0)
