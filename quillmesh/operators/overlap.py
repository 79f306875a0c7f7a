"""Shared runs of words between a large table of texts and a small one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.corpus import lookup_side

WORDS = 8
#: Windows of the small side that are broadcast (8 bytes each); beyond it the join shuffles.
WINDOW_ROWS = 1_000_000


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[^ \t\n\r]+"), 0)


def _window(w: Column, i: Column, size: int) -> Column:
    return F.array_join(F.slice(w, i + 1, F.lit(size)), " ")


def _windows(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """``(id, i, h)``: place and hash of each run of words; no text is carried."""
    # No filter on the number of words: it would be pushed below and the text split twice.
    split = df.select(id_col, _words(F.col(text)).alias("w"))
    words = lambda i: [F.get("w", i + k) for k in range(size)]
    starts = F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(starts, lambda i: F.struct(i.alias("i"), F.xxhash64(*words(i)).alias("h")))
    return split.select(id_col, F.explode(hashed).alias("x")).select(id_col, "x.i", "x.h")


def shared_runs(texts: DataFrame, items: DataFrame, text_id: str, item_id: str, text: str = "text", size: int = WORDS) -> DataFrame:
    """``(item_id, text_id, shared)``: number of distinct runs of ``size`` words that an item and a text share.

    The windows of the large side are hashed and meet those of the items, which are broadcast if they are few; only of
    what meets are the words read and compared, so equal hashes of other words change nothing."""
    small = _windows(items, item_id, text, size)
    few = lookup_side(small.select("h").distinct(), WINDOW_ROWS)
    hits = _windows(texts, text_id, text, size).join(few, "h", "left_semi")

    def read(df: DataFrame, places: DataFrame, key: str) -> DataFrame:
        """The words at the places of each text, which is split once."""
        of_text = places.groupBy(key).agg(F.collect_list("i").alias("at"))
        split = df.select(key, text).join(of_text, key).select(key, "at", _words(F.col(text)).alias("w"))
        return split.select(key, F.explode(F.transform("at", lambda i: _window(F.col("w"), i, size))).alias("run")).distinct()

    found = read(texts, hits.select(text_id, "i"), text_id)
    return found.join(lookup_side(read(items, small.select(item_id, "i"), item_id), WINDOW_ROWS), "run").groupBy(item_id, text_id).agg(F.count(F.lit(1)).alias("shared"))
