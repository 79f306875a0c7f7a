"""The crawl controller: frontier, fetch, extract or reject, checkpoint. State is two append-only tables, so a run that
ends early goes on from its last checkpoint."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.robotparser import RobotFileParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.operators import corpus, frontier
from quillmesh.sources import readers, writers

CHECKPOINT = 10
#: The least seconds between two requests, and a page's least text.
LEAST_DELAY, LEAST_TEXT = 3.0, 200


def robots(text: str, agent: str) -> Callable[[str], bool]:
    """Whether an agent may fetch a URL, by the text of a robots file; a missing text is an error, not leave."""
    if text is None:
        raise ValueError("robots.txt could not be read; nothing is fetched")
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    rules.modified()
    return lambda url: rules.can_fetch(agent, url)


def polite(fetch: readers.Fetch, delay: float, least: float = LEAST_DELAY, sleep=time.sleep, clock=time.monotonic) -> readers.Fetch:
    """A fetch client that waits between its calls; shorter delays than ``least`` are raised to it."""
    wait, last = max(delay, least), [None]

    def run(url: str):
        if last[0] is not None and (left := wait - (clock() - last[0])) > 0:
            sleep(left)
        last[0] = clock()
        return fetch(url)

    return run


def candidates_of_sitemaps(index: DataFrame, children: DataFrame, wanted: str, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """``(url, pos)`` of the pages of an index's children, and ``(sitemap, n)``.

    ``index(xml)`` is the sitemap index, ``children(sitemap, xml)`` the fetched children; those count whose URL the
    index has and matches ``wanted``. ``allowed`` is a condition on ``url``; the first of equal URLs stays."""
    named = readers.sitemap_locations(index.select("xml")).filter(F.col("loc").rlike(wanted)).select(F.col("loc").alias("sitemap")).distinct()
    found = readers.sitemap_locations(children.join(named, "sitemap", "left_semi").select("sitemap", "xml")).withColumnRenamed("loc", "url")
    counts = found.groupBy("sitemap").agg(F.count(F.lit(1)).alias("n"))
    first = found.filter(F.coalesce(allowed, F.lit(False))).groupBy("url").agg(F.min(F.struct("sitemap", "url")).alias("_o"))
    return first.select("url", F.concat_ws(" ", "_o.sitemap", "url").alias("pos")), counts


def _state(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    """The last record of each URL in an append-only table."""
    if not readers.exists(spark, path):
        return empty
    rows = spark.read.schema(T.StructType([*empty.schema.fields, T.StructField("seq", T.LongType())])).parquet(path)
    return corpus.first_wins(rows, ["url"], [F.desc("seq")]).drop("seq")


def run(
    candidates: DataFrame,
    path: str,
    fetch: readers.Fetch,
    hosts: list[str],
    extract: Callable[[DataFrame], DataFrame],
    allow: Callable[[str], bool],
    checkpoint: int = CHECKPOINT,
    most: int | None = None,
    retry_all: bool = False,
) -> DataFrame:
    """Fetches what is pending of ``candidates(url, pos)`` in order, ``checkpoint`` pages at a time, and returns the
    summary row, which is also written beside the state.

    ``extract`` turns ``(url, body string)`` into the record's columns, with ``text`` and a ``reject_reason`` that is
    null for a good page. A page whose text an accepted one has is rejected as a duplicate; of equal pages of one
    checkpoint the first in order is accepted. Rejections are terminal but for failed requests, which the
    next run tries again; with ``retry_all`` all rejections are. ``most`` bounds the pages of this run.
    """
    if checkpoint < 1 or (most is not None and most < 1):
        raise ValueError("checkpoint and most are at least 1")
    spark = candidates.sparkSession
    sample = extract(spark.createDataFrame([], "url string, body string"))
    good_schema = sample.drop("reject_reason").withColumn("text_sha256", F.lit(""))
    bad_schema = spark.createDataFrame([], "url string, reject_reason string, terminal boolean")
    state = lambda: (_state(spark, f"{path}/accepted", good_schema.limit(0)), _state(spark, f"{path}/rejected", bad_schema))
    started, done, tried = int(time.time() * 1000), 0, None
    while most is None or done < most:
        accepted, rejected = state()
        left = frontier.pending(candidates, accepted, rejected, retry_all=retry_all)
        if tried is not None:  # a failed or retried page is tried once in a run
            left = left.join(tried, "url", "left_anti")
        size = checkpoint if most is None else min(checkpoint, most - done)
        # At most ``checkpoint`` rows: the unit of a polite crawl, fetched by one task.
        page = spark.createDataFrame(left.select("url", "pos").orderBy("pos").limit(size).collect(), candidates.select("url", "pos").schema)
        n = page.count()
        if not n:
            break
        got_path = f"{path}/fetched/{started:013d}-{done:08d}"
        readers.fetched(page.coalesce(1), fetch, hosts, allow=allow).write.mode("overwrite").parquet(got_path)
        got = spark.read.parquet(got_path)
        records = extract(got.filter("reason IS NULL").select("url", F.decode("body", "UTF-8").alias("body")))
        records = records.withColumn("text_sha256", F.sha2("text", 256)).join(page, "url")
        first = records.filter("reject_reason IS NULL").groupBy("text_sha256").agg(F.min("pos").alias("_first"))
        known = accepted.select("text_sha256", F.lit(True).alias("_known")).distinct()
        marked = records.join(first, "text_sha256", "left").join(known, "text_sha256", "left")
        repeated = F.coalesce("_known", F.lit(False)) | (F.col("_first") < F.col("pos"))
        reason = F.coalesce("reject_reason", F.when(repeated, "duplicate_content"))
        fine, bad = frontier.accept_or_reject(marked.withColumn("_reason", reason).drop("reject_reason"), F.col("_reason"))
        lost = got.filter("reason IS NOT NULL").select("url", F.col("reason").alias("reject_reason"), (F.col("reason") != frontier.TRANSIENT_REASON).alias("terminal"))
        seq = F.lit(started + done).cast("long").alias("seq")
        lost.unionByName(bad.select("url", "reject_reason", "terminal")).select("*", seq).write.mode("append").parquet(f"{path}/rejected")
        fine.select(*good_schema.columns, seq).write.mode("append").parquet(f"{path}/accepted")
        mine = page.select("url")
        tried = mine if tried is None else tried.union(mine)
        done += n
    accepted, rejected = state()
    rejected = rejected.join(accepted.select("url"), "url", "left_anti")
    out = frontier.summary(frontier.with_children(candidates.withColumn("path", F.regexp_extract("url", r"\A[a-z]+://[^/]*(.*)\z", 1))), accepted, rejected)
    writers.replace(out.withColumn("processed_this_run", F.lit(done)), f"{path}/manifest", "json")
    return out
