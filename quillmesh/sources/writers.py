"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, fmt: str = "parquet", backup: str | None = None, **options) -> None:
    """Writes beside the target, moves the old table aside and the new one in. Readers see the old table, the new one,
    or between the two renames none, but never half of one; if the second rename fails the old table is moved back.
    The old table is deleted last, or kept at ``backup``."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.options(**options).format(fmt).save(staged)
    target, fs = _fs(df, path)
    source, _ = _fs(df, staged)
    aside = None
    if fs.exists(target):
        aside = _fs(df, backup or f"{path}.old-{uuid.uuid4().hex}")[0]
        if not fs.rename(target, aside):
            raise RuntimeError(f"could not move {path} aside; the new table is at {staged}")
    if not fs.rename(source, target):
        if aside is not None:
            fs.rename(aside, target)
        raise RuntimeError(f"could not publish {path}")
    if aside is not None and not backup:
        fs.delete(aside, True)


def sorted_jsonl(df: DataFrame, path: str, order: str = "chunk_id") -> None:
    """JSON lines in the order of a column, keys sorted, null fields kept."""
    replace(df.select(*sorted(df.columns)).orderBy(order), path, "json", ignoreNullFields="false")


def blobs(df: DataFrame, path: str, content: str = "body") -> DataFrame:
    """Write-once store of contents by the first 20 hex digits of their hash; returns ``(row columns, blob)``."""
    keyed = df.withColumn("blob", F.substring(F.sha2(content, 256), 1, 20))
    new = keyed.select("blob", content).dropDuplicates(["blob"])
    target, fs = _fs(df, path)
    if fs.exists(target):
        new = new.join(df.sparkSession.read.parquet(path).select("blob"), "blob", "left_anti")
    new.write.mode("append").parquet(path)
    return keyed.drop(content)


def publish_all_or_nothing(pages: DataFrame, failed: DataFrame, path: str, manifest: DataFrame, manifest_path: str) -> bool:
    """The manifest is always written, the pages only if nothing failed."""
    replace(manifest, manifest_path, "json")
    if not failed.isEmpty():
        return False
    replace(pages, path)
    return True


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def table(df: DataFrame, path: str) -> None:
    """An export as CSV with a header."""
    replace(df, path, "csv", header="true")


def keep_existing(df: DataFrame, path: str, force: bool = False) -> bool:
    """Writes a snapshot unless there is one (False), or in its place if forced."""
    target, fs = _fs(df, path)
    if fs.exists(target) and not force:
        return False
    replace(df, path)
    return True


def output_path(path: str, smoke: bool = False) -> str:
    """Where a run writes: a smoke run beside the full output, never over it."""
    return f"{path.rstrip('/')}_smoke" if smoke else path


def report(pieces: dict[str, DataFrame], path: str, dry_run: bool = False) -> DataFrame:
    """One row of JSON: each frame, which has a few rows of counts, as an array of records."""
    out = None
    for name, df in pieces.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = one if out is None else out.crossJoin(one)
    if not dry_run:
        replace(out.coalesce(1), path, "json", ignoreNullFields="false")
    return out
