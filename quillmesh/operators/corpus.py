"""Building the corpus: chunk projection, dimension lookups, gates, and parsers of raw records into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import normalise, normalise_page, strip_markers

#: A lookup side is broadcast up to this many rows; beyond it the join shuffles.
LOOKUP_ROWS = 100_000
#: Parts that a group's labels are ranked in first.
LIST_PARTS = 32


def lookup_side(dim: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """A dimension, marked for broadcast if it is small enough (looks at ``rows + 1`` rows at most)."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def lookup(df: DataFrame, dim: DataFrame, on: str, values: dict[str, Column] | None = None) -> DataFrame:
    """Left lookup of a dimension's columns, with fallbacks where it has no row."""
    out = df.join(lookup_side(dim), on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in (values or {}).items()})


def unmatched(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Keys that the dimension lacks, with their row counts."""
    return df.join(lookup_side(dim.select(on)), on, "left_anti").groupBy(on).count()


def override(df: DataFrame, extra: str, columns: list[str]) -> DataFrame:
    """Core columns replaced by the fields of a map column that has their key, also by null values."""
    return df.withColumns({c: F.when(F.map_contains_key(extra, c), F.col(extra)[c]).otherwise(F.col(c)) for c in columns})


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Outputs of several parsers as one frame with all their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row of each key in the given order."""
    once = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")


def last_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def mark_duplicates(df: DataFrame, content: str, order: str) -> DataFrame:
    """Adds ``duplicate_of``: the order value of the first row with the same content, null for that row.

    The first of each content is a sum of minima and joined back, so a very common content is no single task.
    """
    first = df.filter(F.col(content).isNotNull()).groupBy(content).agg(F.min(order).alias("_first"))
    out = df.join(first, content, "left")
    return out.withColumn("duplicate_of", F.when(F.col("_first") < F.col(order), F.col("_first"))).drop("_first")


def page_exclusion(
    text: Column,
    page_number: Column,
    markers: tuple[str, ...] = (),
    editorial: tuple[str, ...] = ("under the editorship", "under the present editorship"),
) -> Column:
    """Why a page is not prose, first reason found; null if it is."""
    low = F.lower(normalise_page(F.coalesce(text, F.lit(""))))
    head = F.substring(low, 1, 450)
    has = lambda words: F.coalesce(*[F.when(low.contains(w), True) for w in words], F.lit(False)) if words else F.lit(False)
    return (
        F.when(has(markers), "third_party_notice")
        .when(head.rlike(r"\b(?:table of )?contents\b"), "contents")
        .when(head.rlike(r"\b(?:general |scriptural |subject )?index\b"), "index")
        .when((page_number <= 15) & has(editorial), "editorial_front_matter")
    )


def eligible(df: DataFrame, dim: DataFrame, equal: list[str]) -> DataFrame:
    """Rows whose flag is strictly true and whose policy fields equal the dimension's, null-safely."""
    side = lookup_side(dim.select("source_id", *[F.col(c).alias(f"_d_{c}") for c in equal]))
    same = F.col("index_eligible").eqNullSafe(F.lit(True))
    for c in equal:
        same = same & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    return df.join(side, "source_id").filter(same).drop(*[f"_d_{c}" for c in equal])


def edges_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Whitespace-separated edge list to ``(source, target, votes)``; header, blank and # lines skipped, bad
    lines raise."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    used = lines.filter((F.trim(F.col(column)) != "") & ~F.trim(F.col(column)).startswith("#") & ~F.lower(F.trim(F.col(column))).startswith("from"))
    votes = F.get(parts, F.lit(2)).try_cast("int")
    return used.select(
        F.get(parts, F.lit(0)).alias("source"),
        F.get(parts, F.lit(1)).alias("target"),
        F.when(votes.isNotNull(), votes).otherwise(F.raise_error(F.concat(F.lit("bad edge line: "), F.col(column))).cast("int")).alias("votes"),
    )


def verse_texts(chunks: DataFrame) -> DataFrame:
    """``(book, chapter, verse, text)``: verse ranges exploded, the last chunk by id wins."""
    spread = chunks.select(
        "book", "chapter", F.explode(F.sequence("verse_start", F.coalesce("verse_end", "verse_start"))).alias("verse"), "chunk_id", "text"
    )
    return spread.groupBy("book", "chapter", "verse").agg(F.max_by("text", "chunk_id").alias("text"))


def ranked_list(df: DataFrame, group: list[str], score: str, label: str, joint: str = "; ", most: int | None = None) -> DataFrame:
    """Per group: labels ranked by score descending, then label, joined; with count and highest score of all.

    With ``most`` only the best labels are listed, and a group of any size is cut in LIST_PARTS parts before it is put
    together; without it a group's labels have to fit in one row, as the result does."""
    best = [F.desc(score), F.asc(label)]
    if most is not None:
        part = F.pmod(F.xxhash64(label), F.lit(LIST_PARTS))
        inside = df.select(*group, score, label, part.alias("_p")).withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_p").orderBy(*best)))
        few = inside.filter(F.col("_n") <= most).withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*best)))
        totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("highest"))
        return ranked_list(few.filter(F.col("_n") <= most), group, score, label, joint).drop("n", "highest").join(totals, group)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))))
    return df.groupBy(*group).agg(
        F.array_join(F.transform(ranked, lambda x: x["l"]), joint).alias("labels"),
        F.count(F.lit(1)).alias("n"),
        F.max(score).alias("highest"),
    )


def cross_reference_chunks(edges: DataFrame, verses: DataFrame, label: Column) -> tuple[DataFrame, DataFrame]:
    """Edges ``(book, chapter, verse, target, votes)`` joined to verse texts; also the sources without one."""
    keys = ["book", "chapter", "verse"]
    listed = ranked_list(edges.withColumn("label", label), keys, "votes", "label")
    found = listed.join(verses, keys).select(
        *keys, F.concat(F.col("text"), F.lit("\n\nRelated: "), F.col("labels")).alias("text"), "n", "highest"
    )
    return found, listed.join(verses, keys, "left_anti").select(*keys)


def carried(marker: Column, by: list[str], order: list[str]) -> Column:
    """The last marker that is not null, up to and with the row."""
    return F.last(marker, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def section_number(opens: Column, by: list[str], order: list[str]) -> Column:
    """How many rows up to and with this one open a section."""
    return F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def drop_adjacent(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows but those whose value is that of the row before."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.struct(value))).drop("_before")


def exact_copies(df: DataFrame, content: Column, id_col: str) -> DataFrame:
    """``(text_sha256, id, copies)``: each content once, with its smallest id."""
    return df.groupBy(F.sha2(content, 256).alias("text_sha256")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def first_values(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``(key, value)``: the value of each key's first row, by a minimum and not a window."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def verses_from_lines(lines: DataFrame) -> DataFrame:
    """Marked-up scripture lines ``(file, pos, value)`` to ``(file, chapter, verse_start, verse_end, text)``.

    Chapter markers set the state, verse markers open a verse, other lines continue the open one unless they
    are header markers. Files are windows of their own; none is held whole.
    """
    line = F.trim(F.col("value"))
    chapter = F.nullif(F.regexp_extract(line, r"\A\\c\s+([0-9]+)", 1), F.lit("")).try_cast("int")
    verse = r"\A\\v\s+([0-9]+)(?:-([0-9]+))?\s*(.*)"
    start = F.nullif(F.regexp_extract(line, verse, 1), F.lit("")).try_cast("int")
    marked = lines.select(
        "file",
        "pos",
        chapter.alias("c"),
        start.alias("start"),
        F.coalesce(F.nullif(F.regexp_extract(line, verse, 2), F.lit("")).try_cast("int"), start).alias("end"),
        F.when(start.isNotNull(), F.regexp_extract(line, verse, 3))
        .when(chapter.isNull() & ~line.rlike(r"\A\\(?:id|ide|h|toc\d|mt\d?)\b"), F.nullif(line, F.lit("")))
        .alias("part"),
    )
    state = marked.select(
        "*",
        carried(F.col("c"), ["file"], ["pos"]).alias("chapter"),
        section_number(F.col("start").isNotNull() | F.col("c").isNotNull(), ["file"], ["pos"]).alias("group"),
    )
    grouped = state.groupBy("file", "group").agg(
        F.max("chapter").alias("chapter"),
        F.max("start").alias("verse_start"),
        F.max("end").alias("verse_end"),
        strip_markers(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("pos", "part")))), lambda x: x["part"]), " ")).alias("text"),
    )
    return grouped.filter("verse_start IS NOT NULL AND chapter IS NOT NULL AND text <> ''").drop("group")


def note_text(note: Column, quote: Column, support: Column) -> Column:
    """Labelled optional parts, then the note."""
    part = lambda label, c: F.when(normalise(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(label), normalise(c)))
    return F.concat_ws("\n\n", part("Quoted expression: ", quote), part("Supporting topic: ", support), normalise(F.replace(note, F.lit("\\n"), F.lit("\n"))))


def source_ids(chunks: DataFrame) -> DataFrame:
    """One row: the distinct sources in order."""
    return chunks.agg(F.sort_array(F.collect_set("source_id")).alias("source_ids"))


def in_reference_order(df: DataFrame, code: str = "code") -> DataFrame:
    """By book code, chapter and verse; codes in alphabetical and not in canonical order."""
    return df.orderBy(code, "chapter", "verse")
