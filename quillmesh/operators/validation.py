"""The corpus report: all checks of a chunk table as rows ``(check, violations, examples)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import quality, selection

LIMIT = 3500


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def report(
    chunks: DataFrame,
    expected: DataFrame,
    required: dict[str, list[str]],
    held: list[str] = (),
    hashes: dict[str, list[str]] | None = None,
    permission_sources: list[str] = (),
    limit: int = LIMIT,
    licences: dict[str, str] | None = None,
    url_prefixes: dict[str, str] | None = None,
    tagged: list[str] = (),
    policy: dict[str, dict[str, str]] | None = None,
) -> DataFrame:
    """Row checks in one pass, group checks beside it.

    ``required``: columns that rows of a source must have filled ("*": of all). ``hashes``: columns that must be
    SHA-256 for a source. Page numbering is checked where ``source_page_id`` is filled. ``licences`` and
    ``url_prefixes`` are what a source's rows must have, ``tagged`` sources must name books, ``policy`` gives the values
    that columns of a source must have. Fields, licences, URLs, tags and policies are a check of each source.
    """
    of = lambda s: F.lit(True) if s == "*" else F.col("source_id") == s
    missing, bad_hash = F.lit(False), F.lit(False)
    for source, columns in required.items():
        for c in columns:
            missing = missing | (of(source) & F.col(c).isNull())
    for source, columns in (hashes or {}).items():
        for c in columns:
            bad_hash = bad_hash | (of(source) & ~text.is_sha256(F.col(c), any_case=True))
    checks = {
        "missing_fields": missing,
        "empty_text": _blank("text"),
        "oversize": F.length("text") > limit,
        "held_source_present": F.col("source_id").isin(*held) if held else F.lit(False),
        "ineligible": ~F.col("index_eligible").eqNullSafe(F.lit(True)),
        "bad_hash": bad_hash,
    }
    for source, columns in required.items():
        if source != "*":
            lacking_field = F.lit(False)
            for c in columns:
                lacking_field = lacking_field | _blank(c)
            checks[f"metadata:{source}"] = of(source) & lacking_field
    for source, licence in (licences or {}).items():
        checks[f"licence:{source}"] = of(source) & ~F.col("license").eqNullSafe(F.lit(licence))
    for source, prefix in (url_prefixes or {}).items():
        checks[f"url:{source}"] = of(source) & ~F.coalesce(F.col("canonical_url").startswith(prefix), F.lit(False))
    for source in tagged:
        checks[f"book_tags:{source}"] = of(source) & (F.size(F.coalesce("book_tags", F.array().cast("array<string>"))) == 0)
    for source, values in (policy or {}).items():
        other = F.lit(False)
        for c, v in values.items():
            other = other | ~F.col(c).cast("string").eqNullSafe(F.lit(v))
        checks[f"policy:{source}"] = of(source) & other
    if permission_sources:
        from quillmesh.functions.privacy import permitted

        checks["not_permitted"] = F.col("source_id").isin(*permission_sources) & ~permitted(F.col("permission_record"))
    out = quality.row_checks(chunks, "chunk_id", checks)
    lacking, extra = quality.set_differences(chunks.select("source_id").distinct(), expected, "source_id")
    groups = [
        ("duplicate_ids", quality.duplicates(chunks, "chunk_id"), "chunk_id"),
        ("missing_sources", lacking, "source_id"),
        ("unexpected_sources", extra, "source_id"),
    ]
    if "source_page_id" in chunks.columns:
        paged = chunks.filter(F.col("source_page_id").isNotNull())
        groups.append(("page_sequence", selection.sequence_gaps(paged, "source_page_id", "page_chunk_number", "page_chunk_count"), "source_page_id"))
    for name, bad, key in groups:
        out = out.unionByName(quality.group_check(name, bad.withColumn(key, F.col(key).cast("string")), key))
    return out


def passage_coverage(chunks: DataFrame, passages: DataFrame, sources: list[str]) -> DataFrame:
    """Per passage and source: verses of the passage that no chunk of the source covers. ``passages`` is
    ``(book, chapter, low, high)``; only typed, exact matches count."""
    met = selection.interval_join(chunks.filter(F.col("source_id").isin(*sources)), passages, ["book", "chapter"], "verse_start", "verse_end", "low", "high")
    seen = met.select("book", "chapter", "low", "high", "source_id", F.explode(selection.clipped_values(F.col("verse_start"), F.col("verse_end"), F.col("low"), F.col("high"))).alias("verse"))
    wanted = passages.select("*", F.explode(F.array(*map(F.lit, sources))).alias("source_id"))
    keys = ["book", "chapter", "low", "high", "source_id"]
    covered = seen.groupBy(*keys).agg(F.collect_set("verse").alias("seen"))
    return wanted.join(covered, keys, "left").select(
        *keys, F.array_except(F.sequence("low", "high"), F.coalesce("seen", F.array().cast("array<int>"))).alias("missing")
    )


def chapter_coverage(chunks: DataFrame, books: DataFrame, sources: list[str]) -> DataFrame:
    """Per book ``(book, chapters)`` and source: chapters that no chunk of the source has, by book or book tags."""
    names = F.array_union(F.array(text.key(F.col("book"))), F.transform(F.coalesce("book_tags", F.array().cast("array<string>")), text.key))
    rows = chunks.filter(F.col("source_id").isin(*sources)).select("source_id", F.explode(F.array_distinct(names)).alias("k"), "chapter").filter("chapter >= 1")
    seen = rows.groupBy("source_id", "k").agg(F.collect_set("chapter").alias("seen"))
    wanted = books.select("*", text.key(F.col("book")).alias("k"), F.explode(F.array(*map(F.lit, sources))).alias("source_id"))
    return wanted.join(seen, ["source_id", "k"], "left").select(
        "source_id", "book", F.array_except(F.sequence(F.lit(1), F.col("chapters")), F.coalesce("seen", F.array().cast("array<int>"))).alias("missing")
    )


def crawl_problems(manifest: dict, pages: int) -> list[str]:
    """What a crawl's manifest must say: complete, nothing pending, something accepted, as many as there are pages."""
    rules = {
        "status": manifest.get("status") in ("complete", "complete_with_rejections"),
        "pending": manifest.get("pending") == 0,
        "accepted": (manifest.get("accepted") or 0) > 0,
        "page_count": manifest.get("accepted") == pages,
    }
    return [name for name, holds in rules.items() if not holds]


def hash_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources whose file hash is not the manifest's, or that the manifest lacks."""
    joined = files.select("source_id", "file_sha256").join(manifest.select("source_id", "file_hash"), "source_id", "left")
    return joined.filter(~F.lower("file_sha256").eqNullSafe(F.lower("file_hash")))


def require(problems: DataFrame) -> None:
    """Raises if any check has violations."""
    bad = problems.filter("violations > 0").orderBy("check").limit(50).collect()
    if bad:
        raise ValueError("; ".join(f"{r.check}: {r.violations}" for r in bad))




def line_report(lines: DataFrame, required: list[str]) -> DataFrame:
    """Checks of raw JSON lines ``(line, raw, bad)``: lines that are no JSON objects, and lines that lack a key."""
    bad = lines.filter("bad").withColumn("line", F.col("line").cast("string"))
    lacking = lines.filter(~F.col("bad") & (F.size(quality.missing_keys("raw", required)) > 0)).withColumn("line", F.col("line").cast("string"))
    return quality.group_check("invalid_json", bad, "line").unionByName(quality.group_check("missing_keys", lacking, "line"))


def source_row_problems(manifest: DataFrame, source_id: str, licence: str, file_hash: str) -> DataFrame:
    """``(problem)`` of a source's row in the manifest: no row, another licence, another file."""
    own = manifest.filter(F.col("source_id") == source_id)
    row = own.agg(F.count(F.lit(1)).alias("n"), F.first("license").alias("license"), F.first("file_hash").alias("file_hash"))
    found = F.when(F.col("n") == 0, F.array(F.lit("no_row"))).otherwise(
        F.array_compact(F.array(
            F.when(~F.col("license").eqNullSafe(F.lit(licence)), F.lit("unexpected_licence")),
            F.when(~F.lower("file_hash").eqNullSafe(F.lit(file_hash.lower())), F.lit("hash_differs")),
        ))
    )
    return row.select(F.explode(found).alias("problem"))
