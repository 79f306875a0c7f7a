"""Import of page documents (scanned books): hash gate, page filter, records, and a report for each source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import validation
from quillmesh.sources import readers, writers

LEAST_PAGE = 120


def import_documents(
    files: DataFrame,
    sources: DataFrame,
    manifest: DataFrame,
    read_pages: Callable[[bytes], list[str]],
    path: str,
    least: int = LEAST_PAGE,
    dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Page records of ``files(path, content)`` and the report; both are written under ``path`` unless it is a dry run.

    ``sources(source_id, source_file, index_eligible, license_status, ...)`` name the files, ``manifest(source_id,
    file_hash)`` what their hashes must be: another hash, a missing file, or a source without a usable page is an
    error. Pages keep their numbers; those shorter than ``least`` are left out and listed in the report."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.withColumn("source_file", name)
    lacking = [r[0] for r in sources.join(named.select("source_file"), "source_file", "left_anti").select("source_id").limit(20).collect()]
    if lacking:
        raise FileNotFoundError(f"no file for {lacking}")
    own = named.join(sources, "source_file")
    hashes = own.select("source_id", F.sha2("content", 256).alias("file_sha256"))
    wrong = [r[0] for r in validation.hash_mismatches(hashes, manifest).select("source_id").limit(20).collect()]
    if wrong:
        raise ValueError(f"another file than the manifest's for {wrong}")
    pages = readers.document_pages(own.select("path", "content"), read_pages, 0).withColumn("text", text.normalise_lines(F.col("text")))
    told = pages.withColumn("usable", F.length("text") >= least).withColumn("source_file", name).join(sources, "source_file")
    report = told.groupBy("source_id", "source_file", "file_sha256", "index_eligible", "license_status").agg(
        F.max("page_count").alias("pages"), F.count_if("usable").alias("accepted_pages"),
        F.array_sort(F.collect_list(F.when(~F.col("usable"), F.col("page_number")))).alias("skipped_short_pages"),
    )
    empty = [r[0] for r in sources.join(report.filter("accepted_pages > 0"), "source_id", "left_anti").select("source_id").limit(20).collect()]
    if empty:
        raise ValueError(f"no usable text in {empty}; the files may hold images only")
    records = told.filter("usable").select(
        F.format_string("%s_page_%04d", "source_id", "page_number").alias("id"), F.col("page_count").alias("pdf_page_count"),
        *[c for c in told.columns if c not in ("path", "usable", "page_count")],
    )
    if not dry_run:
        writers.replace(records, f"{path}/pages")
        writers.replace(report, f"{path}/report", "json")
    return records, report
