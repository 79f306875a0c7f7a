"""References: "Book chapter:verse-verse" and its relatives, parsed and formatted."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import key, lenient_int, normalise, strip

_PASSAGE = r"\A((?:[1-3]\s+)?[A-Za-z]+(?:\s+[A-Za-z]+)*)\s+([0-9]+):([0-9]+)(?:-([0-9]+))?\z"


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def parse_passage(c: Column) -> Column:
    """``struct(book, chapter, verse_start, verse_end)``, all null where the text is no passage reference."""
    flat = strip(F.translate(c, "–—", "--"))
    part = lambda i: F.regexp_extract(flat, _PASSAGE, i)
    start = _int(part(3))
    return F.struct(
        F.nullif(part(1), F.lit("")).alias("book"),
        _int(part(2)).alias("chapter"),
        start.alias("verse_start"),
        F.coalesce(_int(part(4)), start).alias("verse_end"),
    )


def parse_note_reference(c: Column) -> Column:
    """``c:v[-v]`` or ``c:intro``; anything else gives nulls."""
    flat = strip(c)
    pattern = r"\A([0-9]+):([0-9]+)(?:-([0-9]+))?\z"
    start = _int(F.regexp_extract(flat, pattern, 2))
    return F.struct(
        F.coalesce(_int(F.regexp_extract(flat, pattern, 1)), _int(F.regexp_extract(flat, r"(?i)\A([0-9]+):intro\z", 1))).alias("chapter"),
        start.alias("verse_start"),
        F.coalesce(_int(F.nullif(F.regexp_extract(flat, pattern, 3), F.lit("0"))), start).alias("verse_end"),
    )


def parse_dotted(c: Column, books: Column) -> Column:
    """``Book.chapter.verse`` with the book's code from the map ``books``; raises on other text or unknown books."""
    pattern = r"\A([1-3]?[A-Za-z]+)\.([0-9]+)\.([0-9]+)\z"
    flat = strip(c)
    code = F.try_element_at(books, F.regexp_extract(flat, pattern, 1))
    fine = F.when(code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("unsupported reference: "), flat)))
    return F.struct(
        fine.alias("code"), _int(F.regexp_extract(flat, pattern, 2)).alias("chapter"), _int(F.regexp_extract(flat, pattern, 3)).alias("verse")
    )


def range_label(c: Column, books: Column, names: Column) -> Column:
    """Readable label of a dotted verse or range, as short as chapter and book allow."""
    parts = F.split(c, "-", 2)
    a, b = parse_dotted(F.get(parts, F.lit(0)), books), parse_dotted(F.get(parts, F.lit(1)), books)
    name = lambda x: F.element_at(names, x["code"])
    at = lambda x: F.concat_ws(":", x["chapter"], x["verse"])
    start = F.concat(name(a), F.lit(" "), at(a))
    same = a["code"] == b["code"]
    return (
        F.when(F.size(parts) == 1, start)
        .when(same & (a["chapter"] == b["chapter"]), F.concat(start, F.lit("–"), b["verse"]))
        .when(same, F.concat(start, F.lit("–"), at(b)))
        .otherwise(F.concat(start, F.lit("–"), name(b), F.lit(" "), at(b)))
    )


def book_pattern(books: list[str]) -> str:
    """Finds ``Book c[:v[-[c:]v]]`` in free text, the longest book name first."""
    names = "|".join(re.escape(b) for b in sorted(set(books), key=len, reverse=True))
    return rf"(?i)\b({names})\s+([0-9]+)(?::([0-9]+)(?:\s*[-–—]\s*(?:([0-9]+):)?([0-9]+))?)?"


def find_reference(candidates: list[Column], books: list[str]) -> Column:
    """The first candidate with a reference, parsed; an end in another chapter is ignored; else all null."""
    pattern = book_pattern(books)
    names = F.create_map(*[x for b in books for x in (F.lit(b.lower()), F.lit(b))])
    found = F.coalesce(*[F.when(c.rlike(pattern), c) for c in map(normalise, candidates)])
    part = lambda i: F.regexp_extract(found, pattern, i)
    chapter, start = _int(part(2)), _int(part(3))
    same = F.coalesce(_int(part(4)), chapter) == chapter
    return F.struct(
        F.try_element_at(names, F.lower(part(1))).alias("book"),
        chapter.alias("chapter"),
        start.alias("verse_start"),
        F.when(start.isNotNull() & same, F.coalesce(_int(part(5)), start)).otherwise(start).alias("verse_end"),
    )


def topic_path(c: Column) -> Column:
    """Lower case, forward slashes, no slash at the end, from the topic root on."""
    flat = F.rtrim(F.replace(F.lower(strip(c)), F.lit("\\"), F.lit("/")), F.lit("/"))
    at = F.locate("bible/", flat)
    return F.when(at > 0, F.substr(flat, at)).otherwise(flat)


#: What a topic link and a lexicon code look like.
TOPIC_LINK = r"(?i)(?:rc://[^\s/]+/tw/dict/)?(bible/(?:kt|names|other)/[A-Za-z0-9_-]+)"
LEXICON_CODE = r"(?i)\b([GH][0-9]{3,5}[a-z]?)\b"


def topic_links(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TOPIC_LINK), 1), topic_path)


def lexicon_codes(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(LEXICON_CODE), 1), F.upper)


def bracketed_references(c: Column) -> Column:
    """All bracketed groups with a number, joined by "; "."""
    groups = F.transform(F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), 1), normalise)
    return F.array_join(F.filter(groups, lambda g: g.rlike(r"\b[0-9]{1,3}(?::[0-9]{1,3})?")), "; ")


def format_reference(book: Column, chapter: Column, start: Column, end: Column) -> Column:
    """``Book[ c[:v[-v]]]``; blank parts end it, an end equal to the start is left out."""
    text = lambda c: F.nullif(c.cast("string"), F.lit(""))
    tail = F.when(text(end) != text(start), F.concat(F.lit("-"), text(end))).otherwise("")
    verses = F.when(text(start).isNotNull(), F.concat(F.lit(":"), text(start), F.coalesce(tail, F.lit("")))).otherwise("")
    rest = F.when(text(chapter).isNotNull(), F.concat(F.lit(" "), text(chapter), verses)).otherwise("")
    return F.when(text(book).isNull(), F.lit("")).otherwise(F.concat(text(book), rest))


def overlaps(start: Column, end: Column, low: int | Column, high: int | Column) -> Column:
    """Closed intervals meet; a missing end is the start; a missing start gives null."""
    return (start <= high) & (F.coalesce(end, start) >= low)


def matches_passage(book: str, chapter: int, low: int, high: int) -> Column:
    """Rows of the chunk schema that may serve a passage: by book, chapter and verse interval with levels left
    open counting as covering; else by book tag, passage tag, or the words "book chapter" in title or text."""
    k = re.sub("[^a-z0-9]", "", book.lower())
    at, start, end = lenient_int(F.col("chapter")), lenient_int(F.col("verse_start")), lenient_int(F.col("verse_end"))
    direct = (key(F.col("book")) == k) & (
        at.isNull() | ((at == chapter) & (start.isNull() | overlaps(start, end, low, high)))
    )
    tagged = F.exists("book_tags", lambda t: key(t) == k)

    def met(tag: Column) -> Column:
        p = parse_passage(tag)
        return (key(p["book"]) == k) & (p["chapter"] == chapter) & overlaps(p["verse_start"], p["verse_end"], low, high)

    words = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    no = F.lit(False)
    return (
        F.coalesce(direct, no)
        | F.coalesce(tagged, no)
        | F.coalesce(F.exists("passage_tags", met), no)
        | words.contains(f"{book} {chapter}".lower())
    )


def matches_development(book: str, chapter: int, low: int, high: int, broad_source: str) -> Column:
    """The narrower rule: an open chapter or a book tag only counts for one source, text never."""
    k = re.sub("[^a-z0-9]", "", book.lower())
    at, start, end = lenient_int(F.col("chapter")), lenient_int(F.col("verse_start")), lenient_int(F.col("verse_end"))
    broad = F.col("source_id") == broad_source
    verse = F.col("verse_start").isNull() | overlaps(start, end, low, high)
    direct = (key(F.col("book")) == k) & F.when(at.isNull(), broad).otherwise((at == chapter) & verse)
    no = F.lit(False)
    # A same-book row without chapter of another source is out, whatever its tags say.
    shut = F.coalesce((key(F.col("book")) == k) & at.isNull() & ~broad, no)
    return F.coalesce(direct, no) | (broad & F.coalesce(F.exists("book_tags", lambda t: key(t) == k), no) & ~shut)


def matches_expected(book: str, chapter: int, low: int, high: int) -> Column:
    """The acceptance rule: book or tag must match; open chapter or start is enough; an end of 0 is none."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w]|_", "")
    k = "".join(c for c in book.lower() if c.isalnum())
    at, start, end = lenient_int(F.col("chapter")), lenient_int(F.col("verse_start")), lenient_int(F.col("verse_end"))
    named = (flat(F.col("book")) == k) | F.coalesce(F.exists("book_tags", lambda t: flat(t) == k), F.lit(False))
    verse = F.col("verse_start").isNull() | overlaps(start, F.nullif(end, F.lit(0)), low, high)
    return F.coalesce(named & (at.isNull() | ((at == chapter) & verse)), F.lit(False))


def matched_books(books: list[str]) -> Column:
    """Selected books that a row belongs to, by book, book tags or passage tags, in the order given."""
    by_length = sorted(books, key=len, reverse=True)

    def of_tag(tag: Column) -> Column:
        flat = F.lower(F.regexp_replace(strip(tag), r"\s+", " "))
        out = F.lit(None).cast("string")
        for b in reversed(by_length):
            out = F.when((flat == b.lower()) | flat.startswith(b.lower() + " "), F.lit(b)).otherwise(out)
        return key(out)

    empty = F.array().cast("array<string>")
    keys = F.array_union(
        F.array(key(F.col("book"))),
        F.array_union(
            F.transform(F.coalesce("book_tags", empty), key), F.transform(F.coalesce("passage_tags", empty), of_tag)
        ),
    )
    return F.filter(F.array(*map(F.lit, books)), lambda b: F.array_contains(keys, key(b)))


def is_book_summary(source_id: str, books: list[str]) -> Column:
    """Rows of one source without a chapter that are about one of the books."""
    keys = [re.sub("[^a-z0-9]", "", b.lower()) for b in books]
    return F.coalesce((F.col("source_id") == source_id) & F.col("chapter").isNull() & key(F.col("book")).isin(*keys), F.lit(False))


def of_source_and_book(source_id: str, book: str, books: list[str]) -> Column:
    """Rows of a source that belong to a book, by any of its marks."""
    return F.coalesce((F.col("source_id") == source_id) & F.array_contains(matched_books(books), book), F.lit(False))
