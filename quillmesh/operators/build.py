"""Raw records of each kind to chunk rows: ``chunk_id, source_id, title, text, book, chapter, verse_start, verse_end``
and the kind's own columns. Records that break a rule carry ``error`` and make no chunk; ``require_clean`` raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import refs, text, urls
from quillmesh.operators import chunking, corpus

#: Block types of an article that are quotations or captions, and fields its text may be in.
QUOTING_TYPES = ("blockquote", "quotation", "quote", "scripture", "bible_text", "caption", "image_caption")
BODY_FIELDS = ("text", "article_text", "content_text", "body_text")
CHUNK_COLUMNS = ("chunk_id", "source_id", "title", "text", "book", "chapter", "verse_start", "verse_end")


def require_clean(df: DataFrame) -> DataFrame:
    """The rows without ``error``; raises when a row with one is read."""
    told = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))
    return df.filter(told).drop("error")


def with_error(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``error``: name of the first rule whose condition holds."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(out)
    return df.withColumn("error", out)


def mark_repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``repeated``: any of the columns has the row's filled value more than once."""
    out, flags = df, F.lit(False)
    for i, c in enumerate(columns):
        many = df.filter(F.coalesce(F.col(c), F.lit("")) != "").groupBy(c).count().filter("count > 1").select(c, F.lit(True).alias(f"_r{i}"))
        out = out.join(many, c, "left")
        flags = flags | F.coalesce(F.col(f"_r{i}"), F.lit(False))
    return out.withColumn("repeated", flags).drop(*[f"_r{i}" for i in range(len(columns))])


def project(pieces: DataFrame, source_id: Column, dim: DataFrame) -> DataFrame:
    """Chunk rows with the source's policy columns; an unknown source raises."""
    named = pieces.withColumn("source_id", source_id)
    joined = named.join(corpus.lookup_side(dim.withColumn("_known", F.lit(True))), "source_id", "left")
    known = F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("unknown source "), F.col("source_id"))).cast("boolean"))
    return joined.filter(known).drop("_known")


def _located(df: DataFrame, candidates: list[Column], books: list[str]) -> DataFrame:
    """Adds book, chapter and verses: the first reference found, else the book of the first known tag."""
    found = refs.find_reference(candidates, books)
    tag = lambda t: F.btrim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), F.lit("-"))
    slugs = F.create_map(*[x for b in books for x in (F.lit(b.lower().replace(" ", "-")), F.lit(b))])
    tagged = F.get(F.array_compact(F.transform(F.coalesce("book_tags", F.array().cast("array<string>")), lambda t: F.try_element_at(slugs, tag(t)))), F.lit(0))
    out = df.withColumn("_ref", found)
    return out.withColumns({
        "book": F.coalesce(F.col("_ref.book"), tagged), "chapter": F.col("_ref.chapter"),
        "verse_start": F.col("_ref.verse_start"), "verse_end": F.col("_ref.verse_end"),
    }).drop("_ref")


def _finish(df: DataFrame, base: Column, body: Column) -> DataFrame:
    return chunking.chunk(df.withColumn("text", body).withColumn("_base", base), "_base", "text").drop("_base")


def commentary(pages: DataFrame, books: list[str], licence: str, content_type: str, limit: int = chunking.MAX_CHARS) -> DataFrame:
    """Web commentary pages with blocks to chunks, each with a head of title, passage and book; a page's own head
    limits its body."""
    checked = with_error(
        mark_repeated(pages, ["id", "canonical_url"]),
        [("repeated_identity", F.col("repeated")), ("wrong_content_type", ~F.col("content_type").eqNullSafe(F.lit(content_type))),
         ("unsupported_licence", ~F.col("license").eqNullSafe(F.lit(licence)))],
    )
    title = text.remove_quoted(text.normalise(F.coalesce("title", F.lit(""))))
    passage = text.normalise(F.coalesce("passage", F.lit("")))
    located = _located(checked, [passage, F.array_join("passage_tags", "\n"), F.col("title")], books)
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Commentary page: "), F.coalesce(F.nullif(title["text"], F.lit("")), F.lit("Commentary"))),
        F.when(passage != "", F.concat(F.lit("Passage: "), passage)),
        F.when(F.col("book").isNotNull(), F.concat(F.lit("Book: "), F.col("book"))),
    )
    headed = located.withColumn("_head", head).withColumn("_title_quotes", title["removed"])
    headed = headed.withColumn("error", F.when(F.length("_head") > limit - 502, F.coalesce("error", F.lit("head_too_long"))).otherwise(F.col("error")))
    fine = headed.filter("error IS NULL")
    room = F.lit(limit - 2) - F.length("_head")
    blocks = fine.select(F.col("id").alias("page_id"), room.alias("limit"), F.posexplode("blocks").alias("pos", "b")).select(
        "page_id", "limit", "pos", "b.type", "b.text"
    )
    pieces = chunking.body_pieces(blocks, refs.book_pattern(books))
    counts = pieces.groupBy("page_id").agg(F.count(F.lit(1)).alias("page_chunk_count"))
    joined = fine.join(pieces.withColumnRenamed("text", "_body").join(counts, "page_id").withColumnRenamed("page_id", "id"), "id", "left")
    suffix = F.when(F.col("page_chunk_count") > 1, F.format_string("_%02d", F.col("piece_no"))).otherwise("")
    out = joined.select(
        F.concat("id", suffix).alias("chunk_id"), F.col("id").alias("source_page_id"), "title", F.concat_ws("\n\n", "_head", "_body").alias("text"),
        "book", "chapter", "verse_start", "verse_end", F.col("piece_no").alias("page_chunk_number"), "page_chunk_count", "license", "canonical_url",
        (F.col("quotes_removed") + F.col("_title_quotes")).alias("quotes_removed"), "cells_removed",
        F.when(F.col("_body").isNull(), "no_usable_text").alias("error"),
    )
    return out.unionByName(headed.filter("error IS NOT NULL").select(F.col("id").alias("source_page_id"), "title", "license", "canonical_url", "error"), allowMissingColumns=True)


def document_pages(pages: DataFrame, approved: list[str], expect: dict[str, str], held_type: str, held_status: str, markers: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Pages of scanned books to chunks, and ``(reason, n)`` of held and excluded pages.

    Pages that are not eligible must be of the held kind; eligible ones must come from an approved source and
    have the expected policy values. Contents, index and similar pages are excluded with their reason.
    """
    open_ = F.col("index_eligible").eqNullSafe(F.lit(True))
    wrong = F.lit(False)
    for c, v in expect.items():
        wrong = wrong | ~F.col(c).eqNullSafe(F.lit(v))
    place = F.col("page_number").isNull() | (F.col("page_number") <= 0) | F.col("pdf_page_count").isNull() | (F.col("pdf_page_count") < F.col("page_number"))
    tags = F.filter(F.transform(F.coalesce("book_tags", F.array().cast("array<string>")), text.normalise), lambda t: t != "")
    checked = with_error(
        mark_repeated(pages, ["id"]).withColumn("book_tags", tags),
        [("repeated_identity", F.col("repeated")),
         ("ineligible_kind", ~open_ & ~(F.col("source_type").eqNullSafe(F.lit(held_type)) & F.col("license_status").eqNullSafe(F.lit(held_status)))),
         ("unapproved_source", open_ & ~F.col("source_id").isin(*approved)), ("wrong_policy", open_ & wrong)],
    )
    body = text.normalise_page(F.coalesce("text", F.lit("")))
    reason = F.when(~open_, "held").otherwise(
        F.coalesce(corpus.page_exclusion(F.col("text"), F.col("page_number"), markers), F.when(body == "", "empty_after_normalisation"))
    )
    told = checked.withColumn("_reason", F.when(F.col("error").isNull(), reason))
    told = told.withColumn("error", F.coalesce("error", F.when(F.col("_reason").isNull(), F.when(place, "bad_page_number").when(F.size("book_tags") == 0, "no_book_tags"))))
    counts = told.filter("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    author = F.nullif(text.normalise(F.coalesce("author", F.lit(""))), F.lit(""))
    head = F.concat_ws(
        "\n", F.lit("Interpretive layer: scholarly academic commentary."), F.lit("This is an interpretation; do not treat it as primary text."),
        F.concat(F.lit("Source: "), F.col("source_name"), F.lit(".")), F.concat(F.lit("Author: "), author, F.lit(".")),
        F.concat(F.lit("Books: "), F.array_join("book_tags", ", "), F.lit(".")),
        F.concat(F.lit("Page: "), F.col("page_number"), F.lit(" of "), F.col("pdf_page_count"), F.lit(".")),
    )
    used = told.filter("_reason IS NULL").drop("_reason", "repeated")
    titled = used.withColumn("title", F.concat(F.col("source_name"), F.lit(" — page "), F.col("page_number"))).withColumn(
        "book", F.when(F.size("book_tags") == 1, F.get("book_tags", F.lit(0)))
    )
    return _finish(titled, F.concat_ws("_", "source_id", "id"), F.concat_ws("\n\n", head, body)), counts


def article_text(blocks: str = "blocks", fields: tuple[str, ...] = BODY_FIELDS) -> Column:
    """Blocks but quotations and captions, headings labelled; without any, the first filled text field."""
    kind = lambda b: F.lower(text.normalise(F.coalesce(b["type"], F.lit("paragraph"))))
    body = lambda b: text.normalise(F.coalesce(b["text"], F.lit("")))
    used = F.filter(F.coalesce(F.col(blocks), F.array().cast("array<struct<type:string,text:string>>")), lambda b: ~kind(b).isin(*QUOTING_TYPES) & (body(b) != ""))
    joined = F.array_join(F.transform(used, lambda b: F.when(kind(b) == "heading", F.concat(F.lit("Section: "), body(b))).otherwise(body(b))), "\n\n")
    return text.first_filled(joined, *[text.normalise(F.col(f)) for f in fields])


def articles(pages: DataFrame, books: list[str], hosts: list[str], label: str = "Article") -> DataFrame:
    """Article pages to chunks; status, title, URL and host, permission and identity are checked."""
    fields = tuple(f for f in BODY_FIELDS if f in pages.columns)
    url = text.first_filled(*[F.col(c) for c in ("canonical_url", "final_url", "url") if c in pages.columns])
    df = pages.withColumn("canonical_url", text.normalise(url)).withColumn("_body", article_text(fields=fields))
    df = df.withColumn("id", F.coalesce(F.nullif(text.normalise(F.coalesce("id", F.lit(""))), F.lit("")), urls.hash_id(F.col("canonical_url"), "article_")))
    blank = lambda c: F.coalesce(text.normalise(F.col(c)), F.lit("")) == ""
    checked = with_error(
        mark_repeated(df, ["id", "canonical_url"]),
        [("http_status", F.col("http_status").isNotNull() & (F.col("http_status").cast("string") != "200")),
         ("incomplete", blank("title") | blank("canonical_url") | blank("_body")), ("unexpected_url", ~urls.allowed(F.col("canonical_url"), hosts)),
         ("no_permission", blank("permission_record")), ("repeated_identity", F.col("repeated"))],
    )
    located = _located(checked, [F.coalesce("passage", F.lit("")), F.array_join(F.coalesce("passage_tags", F.array().cast("array<string>")), "\n"), F.col("title")], books)
    return _finish(located.drop("repeated", *fields), F.col("id"), F.concat(F.lit(f"{label}: "), F.col("title"), F.lit("\n\n"), F.coalesce("_body", F.lit("")))).drop("_body")


def notes(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows ``(code, row_no, reference, id, note, quote, support)`` to chunks; blank notes make none."""
    named = corpus.lookup(rows, names, "code", {"book": F.col("code")})
    ref = refs.parse_note_reference(F.coalesce("reference", F.lit("")))
    note_id = F.coalesce(F.nullif(F.trim(F.col("id")), F.lit("")), F.col("row_no").cast("string"))
    located = named.withColumns({"chapter": ref["chapter"], "verse_start": ref["verse_start"], "verse_end": ref["verse_end"], "note_id": note_id})
    filled = located.filter(text.normalise(F.replace(F.coalesce("note", F.lit("")), F.lit("\\n"), F.lit("\n"))) != "")
    titled = filled.withColumn("title", F.concat_ws(" ", "book", "reference", F.lit("note")))
    return _finish(titled, text.safe_id(F.concat_ws("_", "code", "reference", "note_id")), corpus.note_text(F.col("note"), F.col("quote"), F.col("support")))


def topics(files: DataFrame) -> DataFrame:
    """Markdown files ``(file, text)`` to chunks; the directory below the root is the category."""
    stem = F.regexp_extract("file", r"([^/]+)\.md\z", 1)
    category = F.regexp_extract("file", r"([^/]+)/[^/]+\z", 1)
    titled = files.withColumn("title", text.markdown_title(F.col("text"), stem)).withColumn("category", category).withColumn("topic", refs.topic_path(F.regexp_replace("file", r"\.md\z", "")))
    return _finish(titled, text.safe_id(F.concat_ws("_", "category", stem)), text.strip_markdown(F.col("text")))


def lexicon(rows: DataFrame, fields: list[tuple[str, str]], code: str = "code", gloss: str = "gloss") -> DataFrame:
    """Lexicon rows to chunks of labelled lines; blank fields are left out, rows without a code dropped. A long
    definition is only indexed if it is among ``fields``."""
    used = rows.filter(F.col(code).rlike(r"\A[GH][0-9]"))
    value = lambda c: F.nullif(text.normalise(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), value(c)) for label, c in fields])
    titled = used.withColumn("title", F.concat_ws(": ", F.col(code), F.nullif(text.normalise(text.plain_html(F.col(gloss))), F.lit(""))))
    return _finish(titled, text.safe_id(F.concat_ws("_", "dataset", "row_no", F.col(code))), lines)


def word_analysis(verses: DataFrame, books: Column, names: Column) -> DataFrame:
    """``(id, words)`` of verses to chunks of the text and a line for each word; verses without words drop."""
    at = refs.parse_dotted(F.col("id"), books)
    filled = verses.filter(F.size(F.coalesce("words", F.array().cast("array<struct<text:string,lemma:string,morph:string>>"))) > 0).withColumn("_at", at)
    line = lambda w: F.concat(w["text"], F.lit(" | lemma="), text.first_filled(w["lemma"], F.lit("NA")), F.lit(" | morphology="), text.first_filled(w["morph"], F.lit("NA")))
    body = F.concat(
        F.lit("Text: "), F.array_join(F.transform("words", lambda w: w["text"]), " "), F.lit("\nWord-level lemma and morphology:\n"), F.array_join(F.transform("words", line), "\n")
    )
    located = filled.withColumns({
        "book": F.element_at(names, F.col("_at.code")), "chapter": F.col("_at.chapter"), "verse_start": F.col("_at.verse"), "verse_end": F.col("_at.verse"),
    }).withColumn("title", F.concat(F.col("book"), F.lit(" "), F.col("chapter"), F.lit(":"), F.col("verse_start")))
    return _finish(located, F.format_string("%s_%03d_%03d", F.col("_at.code"), F.col("_at.chapter"), F.col("_at.verse")), body).drop("_at")


def held_source(pages: DataFrame, expect: dict[str, object]) -> DataFrame:
    """No chunks: the rows of a held source that break what must be true of it."""
    broken = F.lit(False)
    for c, v in expect.items():
        broken = broken | ~F.col(c).eqNullSafe(F.lit(v))
    return pages.filter(broken)
