"""Choosing subsets: interval joins, link expansion by semi-join, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.corpus import lookup_side


def interval_join(df: DataFrame, windows: DataFrame, keys: list[str], start: str, end: str, low: str, high: str) -> DataFrame:
    """Rows whose closed interval meets a window with the same keys; a missing end is the start."""
    met = (F.col(start) <= F.col(high)) & (F.coalesce(F.col(end), F.col(start)) >= F.col(low))
    return df.join(lookup_side(windows), keys).filter(met)


def range_join(points: DataFrame, windows: DataFrame, value: str, low: str, high: str, width: int) -> DataFrame:
    """Points in closed windows without other keys: both sides meet in buckets of ``width``, so the join is an
    equi-join whose work is near its output if windows are about that wide."""
    bucket = F.floor(F.col(value) / width)
    spread = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_b", bucket).join(spread, "_b").filter(F.col(value).between(F.col(low), F.col(high))).drop("_b")


def linked(df: DataFrame, links: Column, targets: DataFrame, target_key: str) -> DataFrame:
    """Targets that any row of ``df`` links to (``links``: array column of keys)."""
    keys = df.select(F.explode(links).alias(target_key)).distinct()
    return targets.join(keys, target_key, "left_semi")


def expand_two_hops(direct: DataFrame, hops: list[tuple[DataFrame, Column, DataFrame, str]], id_col: str) -> DataFrame:
    """Ids of direct rows and of all linked targets: ``hops`` are (rows, links, targets, target key)."""
    ids = direct.select(id_col)
    for rows, links, targets, key in hops:
        ids = ids.union(linked(rows, links, targets, key).select(id_col))
    return ids.distinct()


def membership_counts(df: DataFrame, members: Column, by: str) -> DataFrame:
    """Rows per (member, by), a row counting for each of its members."""
    return df.select(F.explode(members).alias("member"), by).groupBy("member", by).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, keys: list[str], value: str, expected: Column) -> DataFrame:
    """``missing`` values of the expected set, per key."""
    return df.groupBy(*keys).agg(F.sort_array(F.array_except(expected, F.collect_set(value))).alias("missing"))


def clipped_values(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Integers of an interval inside a window."""
    a, b = F.greatest(start, low), F.least(F.coalesce(end, start), high)
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def sequence_gaps(df: DataFrame, page: str, number: str, total: str) -> DataFrame:
    """Pages whose pieces are not exactly 1..n with one n."""
    grouped = df.groupBy(page).agg(
        F.countDistinct(total).alias("totals"), F.max(total).alias("n"), F.sort_array(F.collect_list(number)).alias("numbers")
    )
    fine = (F.col("totals") == 1) & (F.col("n") >= 1) & (F.col("numbers") == F.sequence(F.lit(1).cast(df.schema[number].dataType), F.greatest(F.col("n"), F.lit(1)).cast(df.schema[number].dataType)))
    return grouped.filter(~F.coalesce(fine, F.lit(False)))


def counts_by_window(df: DataFrame, windows: DataFrame, keys: list[str], start: str, end: str, low: str, high: str, label: str, by: str) -> DataFrame:
    """Rows of each ``by`` value that meet each window; windows that none meets are not there."""
    return interval_join(df, windows, keys, start, end, low, high).groupBy(label, by).agg(F.count(F.lit(1)).alias("n"))
