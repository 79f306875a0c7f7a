"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import normalise_crawled


def normalise_url(c: Column) -> Column:
    """Lower-case scheme and host, port kept, credentials, query and fragment dropped, slashes collapsed."""
    flat = normalise_crawled(c)
    scheme = F.lower(F.regexp_extract(flat, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(flat, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(rest, r"\A.*@", ""))
    path = F.regexp_extract(flat, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/+\z", ""))
    return F.concat(scheme, F.lit("://"), host, path)


def host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def allowed(c: Column, hosts: list[str], prefixes: list[str] = ("/",), schemes: list[str] = ("https",)) -> Column:
    """Scheme, host and path prefix in the given sets, and no credentials."""
    path = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | path.startswith(p)
    fine = F.try_parse_url(c, F.lit("PROTOCOL")).isin(*schemes) & host(c).isin(*hosts) & inside
    return F.coalesce(fine & F.try_parse_url(c, F.lit("USERINFO")).isNull(), F.lit(False))


def is_web(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^https?://"), F.lit(False))


def on_host(c: Column, canonical_host: str, hosts: list[str]) -> Column:
    """https on the canonical host for URLs of the given hosts, else null."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("/")), r"(.)/+\z", "$1")
    return F.when(host(c).isin(*hosts), F.concat(F.lit(f"https://{canonical_host}"), path))


def choose_canonical(link: Column, final_url: Column, hosts: list[str]) -> Column:
    """A page's own canonical link if its host is allowed, else where it was found."""
    link = F.nullif(normalise_crawled(link), F.lit(""))
    return normalise_url(F.coalesce(F.when(is_web(link) & host(link).isin(*hosts), link), final_url))


def slug(c: Column) -> Column:
    """Last path segment if it is slug-like, else the start of the URL's hash."""
    last = F.element_at(F.split(F.rtrim(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), F.lit("/")), "/"), -1)
    return F.when(last.rlike(r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"), last).otherwise(F.substring(F.sha2(c, 256), 1, 16))


def hash_id(c: Column, prefix: str, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, length))


def page_kind(c: Column) -> Column:
    """``struct(kind, chapter, id)`` from a path: chapter-N, introduction, or other."""
    path = F.coalesce(F.try_parse_url(c, F.lit("PATH")), c)
    chapter = F.nullif(F.regexp_extract(path, r"chapter-([0-9]+)/?\z", 1), F.lit("")).try_cast("int")
    intro = path.rlike(r"introduction/?\z")
    last = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.struct(
        F.when(chapter.isNotNull(), "chapter").when(intro, "introduction").otherwise("other").alias("kind"),
        chapter.alias("chapter"),
        F.when(chapter.isNotNull(), F.concat(F.lit("chapter_"), F.lpad(chapter.cast("string"), 2, "0")))
        .when(intro, "introduction")
        .otherwise(F.regexp_replace(last, "[^A-Za-z0-9]+", "_"))
        .alias("id"),
    )


def query_values(c: Column, name: str) -> Column:
    """All values of a query parameter, first of equals kept."""
    raw = F.regexp_extract_all(c, F.lit(rf"[?&]{name}=([^&#]*)"), 1)
    return F.array_distinct(F.filter(F.transform(raw, lambda v: normalise_crawled(F.try_url_decode(v))), lambda v: v != ""))


def ancestors(path: Column) -> Column:
    """Proper ancestor paths of a path, the root not counted."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.when(F.size(parts) > n, F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))),
    )
