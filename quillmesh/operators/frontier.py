"""Crawl state as tables: candidates, accepted, rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.urls import ancestors
from quillmesh.operators.corpus import first_wins, last_wins

#: Reasons after which a page is not tried again.
TERMINAL_REASONS = (
    "not_html", "too_large", "redirected_off_host", "robots_disallowed", "wrong_content_type", "no_main_content",
    "too_short", "duplicate_content", "not_found", "licence_missing", "host_not_allowed",
)
TRANSIENT_REASON = "request_failed"


def pending(candidates: DataFrame, accepted: DataFrame, rejected: DataFrame, key: str = "url", retry_all: bool = False) -> DataFrame:
    """Candidates that are neither accepted nor terminally rejected (with ``retry_all``: not accepted)."""
    left = candidates.join(accepted.select(key), key, "left_anti")
    return left if retry_all else left.join(rejected.filter("terminal").select(key), key, "left_anti")


def with_children(urls: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``has_children``: the path is a proper ancestor of another's. Ancestors are exploded, so it is an
    equi-join and not a comparison of all pairs."""
    parents = urls.select(F.explode(ancestors(F.col(path))).alias("_p")).filter("_p IS NOT NULL").distinct()
    own = F.regexp_replace(F.col(path), "/+$", "")
    return urls.join(parents, own == F.col("_p"), "left").withColumn("has_children", F.col("_p").isNotNull()).drop("_p")


def with_defaults(pages: DataFrame, curated: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join of hand-curated columns, defaults where a page has none."""
    out = pages.join(curated.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def accept_or_reject(pages: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Pages whose ``reason`` is null, and the others with ``reject_reason`` and ``terminal``."""
    told = pages.withColumn("reject_reason", reason)
    bad = told.filter("reject_reason IS NOT NULL").withColumn("terminal", F.col("reject_reason") != TRANSIENT_REASON)
    return told.filter("reject_reason IS NULL").drop("reject_reason"), bad


def advance(state: tuple[DataFrame, DataFrame], accepted: DataFrame, rejected: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """State after a run: newly accepted replace both; rejections count for what is not accepted."""
    good = last_wins(state[0], accepted, [key])
    bad = last_wins(state[1], rejected, [key]).join(good.select(key), key, "left_anti")
    return good, bad


def summary(candidates: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of counts and the run's status."""
    a = candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("has_children").alias("parents"))
    b = accepted.agg(F.count(F.lit(1)).alias("accepted"))
    c = rejected.agg(F.count_if("terminal").alias("terminal"), F.count_if(~F.col("terminal")).alias("transient"))
    left = F.col("candidates") - F.col("accepted") - F.col("terminal")
    status = F.when(left > 0, "partial").when(F.col("terminal") > 0, "complete_with_rejections").otherwise("complete")
    return a.crossJoin(b).crossJoin(c).withColumn("pending", left).withColumn("status", status)


def merge_order(candidates: DataFrame, records: DataFrame, key: str = "url", pos: str = "pos") -> DataFrame:
    """Records in candidate order."""
    return candidates.select(key, pos).join(records, key).orderBy(pos)


def first_urls(urls: DataFrame, key: str = "url", pos: str = "pos") -> DataFrame:
    return first_wins(urls, [key], [pos])


def page_list(spark, base: str, first: int, last: int, before: tuple[str, ...] = (), after: tuple[str, ...] = ()) -> DataFrame:
    """``(pos, url)`` of a site that is listed and not discovered: pages before, chapters, pages after."""
    chapters = [f"chapter-{n}" for n in range(first, last + 1)]
    return spark.createDataFrame([(i, f"{base.rstrip('/')}/{p}") for i, p in enumerate((*before, *chapters, *after))], "pos int, url string")


#: Cells of a whitelist that switch a row on.
ENABLED = ("1", "true", "yes", "y")


def enabled(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*ENABLED), F.lit(False))
