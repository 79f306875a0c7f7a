"""Texts to pieces of bounded length.

``split_text`` packs paragraphs, then sentences of paragraphs that are too long, then cuts sentences that are
too long. It loses no text: a cut sentence's pieces all come out, in order (set ``lossy`` for the behaviour that
keeps only the last piece of the first cut).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.text import normalise, remove_quoted

MAX_CHARS = 3500
_BLANK = re.compile(r"\n\s*\n")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


class _Packer:
    """Collects units into pieces, joined, while they fit."""

    def __init__(self, limit: int):
        self.limit, self.done, self.open = limit, [], ""

    def flush(self) -> None:
        if self.open:
            self.done.append(self.open)
        self.open = ""

    def add(self, unit: str, joint: str, charged: int) -> None:
        """``charged``: what a joint costs even where nothing is open yet."""
        cost = len(joint) if self.open else charged
        if len(self.open) + cost + len(unit) > self.limit:
            self.flush()
        self.open = f"{self.open}{joint}{unit}" if self.open else unit


def pieces(text: str, limit: int = MAX_CHARS, lossy: bool = False) -> list[str]:
    """Pieces of a normalised text."""
    if len(text) <= limit:
        return [text] if text else []
    pack = _Packer(limit)
    for paragraph in filter(None, map(str.strip, _BLANK.split(text))):
        if len(paragraph) <= limit:
            pack.add(paragraph, "\n\n", 0)
            continue
        pack.flush()
        for sentence in _SENTENCE_END.split(paragraph):
            if len(sentence) < limit:
                pack.add(sentence, " ", 1)
                continue
            pack.flush()
            cuts = [sentence[i : i + limit] for i in range(0, len(sentence), limit)]
            pack.done += cuts[1:-1] if lossy else cuts[:-1]
            pack.open = cuts[-1]
    pack.flush()
    return pack.done


def split_text(c: Column, limit: int | Column = MAX_CHARS, lossy: bool = False) -> Column:
    """Array of pieces of a column of normalised texts, each at most ``limit`` long, which may be a column; null gives
    none. Only texts that are too long are sent to Python. ``c`` is named several times: it should be a column and no
    long expression."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, limits in batches:
            cut = [pieces(t, n, lossy) if t is not None else [] for t, n in zip(texts, limits, strict=True)]
            yield pd.Series(cut, index=texts.index)

    most = limit if isinstance(limit, Column) else F.lit(limit)
    fits = F.length(c) <= most
    whole = F.filter(F.array(c), lambda t: t != "")
    return F.when(fits, whole).otherwise(run(F.when(~fits, c), most))


def chunk(df: DataFrame, id_col: str, text_col: str, limit: int = MAX_CHARS, lossy: bool = False) -> DataFrame:
    """One row for each piece, with ``piece``, ``pieces`` and ``chunk_id``: the id, with _NN if there are several."""
    out = df.withColumn("_text", normalise(F.col(text_col))).withColumn("_pieces", split_text(F.col("_text"), limit, lossy))
    # An outer explode: for an inner one a filter on the pieces is inferred and pushed below, where they are made again.
    out = out.select("*", F.size("_pieces").alias("pieces"), F.posexplode_outer("_pieces").alias("_pos", "_piece")).filter("_pos IS NOT NULL")
    suffix = F.when(F.col("pieces") > 1, F.format_string("_%02d", F.col("_pos") + 1)).otherwise("")
    return (
        out.withColumn("piece", F.col("_pos") + 1)
        .withColumn("chunk_id", F.concat(F.col(id_col).cast("string"), suffix))
        .withColumn(text_col, F.col("_piece"))
        .drop("_text", "_pieces", "_pos", "_piece")
    )


def sentences(c: Column) -> Column:
    """Array of sentences: cut at white space after a full stop, exclamation or question mark."""
    return F.split(c, r"(?<=[.!?])\s+")


def hard_cut(c: Column, limit: int = MAX_CHARS) -> Column:
    """Array of fixed cuts, natively."""
    n = F.greatest(F.ceil(F.length(c) / limit), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(c, i * limit + 1, F.lit(limit)))


def with_headings(blocks: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """Blocks ``(page, pos, type, text)`` with the heading that is active at each; headings themselves dropped."""
    so_far = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(so_far)
    return blocks.withColumn("heading", heading).filter(~F.col("type").eqNullSafe("heading"))


def body_pieces(blocks: DataFrame, reference_pattern: str, limit: int = MAX_CHARS, page: str = "page_id") -> DataFrame:
    """Page blocks to ``(page, piece_no, text, quotes_removed, cells_removed)``. A column ``limit`` of the blocks, the
    same for all of a page, goes before the parameter.

    Quoted spans go; headings become a "Section:" line of the blocks below them; of a table row only the last
    cell stays, with the first cell's reference, or the cell itself if it is short; then blocks are packed.
    """
    if "limit" not in blocks.columns:
        blocks = blocks.withColumn("limit", F.lit(limit))
    clean = blocks.withColumn("_q", remove_quoted(F.coalesce("text", F.lit(""))))
    clean = clean.withColumn("text", F.col("_q.text")).withColumn("_removed", F.col("_q.removed")).drop("_q")
    counted = clean.groupBy(page).agg(F.sum("_removed").alias("quotes_removed"))
    active = with_headings(clean.filter(F.col("text") != "").withColumn("type", F.lower(normalise(F.coalesce("type", F.lit("paragraph"))))), page)
    cells = F.filter(F.transform(F.split("text", r" \| "), normalise), lambda x: x != "")
    first, ref = F.get(cells, F.lit(0)), F.regexp_extract(F.get(cells, F.lit(0)), f"({reference_pattern})", 1)
    topic = F.when(ref != "", F.concat(F.lit("Table reference: "), ref)).when(
        F.length(first) <= 100, F.concat(F.lit("Table topic: "), first)
    )
    row = F.when(F.size(cells) >= 2, F.concat_ws("\n", topic, F.concat(F.lit("Table commentary: "), F.element_at(cells, -1)))).otherwise(
        F.concat(F.lit("Table commentary: "), F.col("text"))
    )
    is_row = F.col("type") == "table_row"
    text = F.when(is_row, row).otherwise(F.col("text"))
    section = F.when(F.col("heading").isNotNull(), F.concat(F.lit("Section: "), F.col("heading"), F.lit("\n"))).otherwise("")
    items = active.select(
        page,
        "pos",
        "limit",
        normalise(F.concat(section, text)).alias("text"),
        F.when(is_row & (F.size(cells) >= 2), F.size(cells) - 1).otherwise(0).alias("cells"),
    ).withColumn("items", split_text(F.col("text"), F.col("limit")))
    lone = clean.filter(F.lower("type") == "heading").filter(F.col("text") != "").groupBy(page).agg(
        F.max_by("text", "pos").alias("last_heading"), F.max("limit").alias("limit")
    )

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def packed(items: pd.Series, limits: pd.Series) -> pd.Series:
        def run(parts, most):
            pack = _Packer(most)
            for p in parts:
                pack.add(p, "\n\n", 0)
            pack.flush()
            return pack.done

        return pd.Series([run(*x) for x in zip(items, limits, strict=True)], index=items.index)

    whole = items.groupBy(page).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "items"))), lambda x: x["items"])).alias("items"),
        F.sum("cells").alias("cells_removed"),
        F.max("limit").alias("limit"),
    )
    only = lone.join(whole, page, "left_anti").select(
        page, F.array(F.concat(F.lit("Section: "), F.col("last_heading"))).alias("items"), F.lit(0).cast("long").alias("cells_removed"), "limit"
    )
    out = whole.unionByName(only).join(counted, page).select(page, "quotes_removed", "cells_removed", packed("items", "limit").alias("_p"))
    spread = out.select(page, "quotes_removed", "cells_removed", F.posexplode_outer("_p").alias("_i", "text")).filter("_i IS NOT NULL")
    return spread.withColumn("piece_no", F.col("_i") + 1).drop("_i")
