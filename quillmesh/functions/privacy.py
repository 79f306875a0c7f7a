"""Gates on free text and on requests: the first rule that applies names the error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import strip

#: Kinds of identifying text and their patterns, in the order they are tried. They find what these find,
#: in time linear in the text and without a stack frame for each character, of which long runs have too many:
#: email \b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b, tried once for each run before the @, from its start or from where
#: words and other characters first meet in it; phone (?<![\w:])(?:\+?\d[\s().-]*){7,}(?!\w), in which after the seventh
#: digit only digits can stand between it and an end.
IDENTIFIERS = (
    (
        "email",
        r"(?iU)(?<![A-Z0-9._%+-])(?:\b|[A-Z0-9_]++(?=[.%+-])|[.%+-]++(?=[A-Z0-9_]))[A-Z0-9._%+-]++"
        r"@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    ),
    ("web_address", r"(?iU)(?:https?://|www\.)\S+"),
    ("phone", r"(?U)(?<![\w:])(?:\+?\d[\s().-]*+){6}\+?\d\d*+(?!\w)"),
    ("handle", r"(?iU)(?<!\w)@[A-Z0-9_]{2,}\b"),
    (
        "introduction",
        r"(?iU)\b(?:my\s+(?:full\s+)?name\s+is|i\s+am\s+called|my\s+(?:e-?mail|phone(?:\s+number)?|address)\s+is"
        r"|contact\s+me\s+(?:at|on))\b",
    ),
)


#: What a text must hold for a pattern to match, lower-cased and without letters that other letters equal when case is
#: ignored (s and k): most texts hold none, and are spared the pattern.
NEEDED = {"email": ("@",), "web_address": ("http", "www."), "handle": ("@",), "introduction": ("name", "called", "mail", "phone", "addre", "contact")}


def identifier_kind(c: Column) -> Column:
    """Kind of the first identifying pattern found, null if there is none."""
    text = F.coalesce(c, F.lit(""))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(IDENTIFIERS):
        found = text.rlike(pattern)
        if kind in NEEDED:
            low = text if NEEDED[kind] == ("@",) else F.lower(text)
            needed = low.contains(NEEDED[kind][0])
            for word in NEEDED[kind][1:]:
                needed = needed | low.contains(word)
            found = needed & found
        else:
            found = text.rlike(r"\p{Nd}") & found
        out = F.when(found, F.lit(kind)).otherwise(out)
    return out


def request_error(kind: Column, text: Column, scope_known: Column, limit: int = 2000) -> Column:
    """Why a request is refused, null if it is not: type, blank, too long, identifying text, unknown scope."""
    flat = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(~F.coalesce(kind.isin("load", "send"), F.lit(False)), "bad_type")
        .when(kind == "load", F.lit(None))
        .when(flat == "", "empty")
        .when(F.length(flat) > limit, "too_long")
        .when(identifier_kind(flat).isNotNull(), "identifying")
        .when(~F.coalesce(scope_known, F.lit(False)), "unknown_scope")
    )


def multiselect_errors(
    chosen: Column, allowed: list[str], other_text: Column, exclusive: str = "no_preference", other: str = "other"
) -> Column:
    """Array of error codes of a comma-separated choice: empty set, unknown value, exclusive with others,
    "other" without its text, identifying text."""
    picked = F.array_distinct(F.filter(F.split(F.coalesce(chosen, F.lit("")), ","), lambda x: x != ""))
    first = (
        F.when(F.size(picked) == 0, "empty")
        .when(F.size(F.array_except(picked, F.array(*map(F.lit, allowed)))) > 0, "unknown")
        .when(F.array_contains(picked, exclusive) & (F.size(picked) > 1), "exclusive")
    )
    blank = F.array_contains(picked, other) & (strip(F.coalesce(other_text, F.lit(""))) == "")
    return F.array_compact(
        F.array(first, F.when(blank, "other_blank"), F.when(identifier_kind(other_text).isNotNull(), "identifying"))
    )


def consented(*flags: Column) -> Column:
    """All flags strictly true."""
    out = F.lit(True)
    for f in flags:
        out = out & f.eqNullSafe(F.lit(True))
    return out


#: Answers that are no permission.
NO_PERMISSION = ("pending", "tbd", "todo", "written permission required")


def permitted(c: Column) -> Column:
    """A substantive record of permission."""
    flat = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"\s+", " ")
    return (
        (flat != "")
        & ~flat.isin(*NO_PERMISSION)
        & ~flat.rlike(r"\b(?:pending|tbd|todo|awaiting)\b")
        & ~flat.rlike(r"\bnot\s+(?:yet\s+)?(?:approved|granted)\b")
        & ~flat.startswith("written permission required")
    )
