"""Readers with explicit schemas."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str, schema: T.StructType, allow_missing: bool = False) -> DataFrame:
    """JSON lines; a malformed line raises. A missing path is empty if allowed; otherwise no rows are an error."""
    if allow_missing and not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not allow_missing and df.isEmpty():
        raise ValueError(f"no records in {path}")
    return df


def jsonl_required(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ("chunk_id", "text")) -> DataFrame:
    """JSON lines whose required fields are filled; a blank one raises when it is read."""
    df = jsonl(spark, path, schema)
    filled = F.lit(True)
    for c in required:
        filled = filled & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return df.filter(F.when(filled, True).otherwise(F.raise_error(F.lit("a required field is blank")).cast("boolean")))


def jsonl_permissive(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``(file, line, raw, record, bad)`` of every line that is not blank; bad lines are kept and marked."""
    lines = text_lines(spark, path).filter(F.trim("value") != "")
    corrupt = "_corrupt"
    parsed = F.from_json("value", schema.add(corrupt, T.StringType()) if corrupt not in schema.names else schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    return lines.select("file", F.col("pos").alias("line"), F.col("value").alias("raw"), parsed.alias("record")).withColumn(
        "bad", F.col(f"record.{corrupt}").isNotNull()
    )


def text_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(file, pos, value)`` with 1-based line numbers; files are read whole, so they should be small."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    whole = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\\A\ufeff", "").alias("value"))
    split = whole.filter(usable_file(F.col("file"))).select("file", F.posexplode(F.split(F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n\z", ""), "\n")).alias("pos", "value"))
    return split.withColumn("pos", F.col("pos") + 1)


def usable_file(path) -> F.Column:
    """Not a repository's or an archiver's own file."""
    return ~path.rlike(r"(?:\A|/)(?:__MACOSX|\.git|\.gitea|\.github)(?:/|\z)") & ~path.rlike(r"/\._[^/]*\z")


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",", unique: str | None = None) -> DataFrame:
    """Quoted cells with a header line; header names lower-cased; ``unique`` raises on a repeated key."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("sep", sep)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.toDF(*[c.replace("\ufeff", "").strip().lower() for c in df.columns])
    if unique and not df.groupBy(unique).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated {unique} in {path}")
    return df


def tsv_in_band(spark: SparkSession, path: str, marker: str, columns: int, least: int) -> DataFrame:
    """Tab-separated rows after the row whose first cell is the marker; short rows padded, too short ones dropped."""
    lines = text_lines(spark, path).withColumn("cells", F.split("value", "\t"))
    head = lines.filter(F.get("cells", F.lit(0)) == marker).groupBy("file").agg(F.min("pos").alias("head"))
    used = lines.join(head, "file").filter((F.col("pos") > F.col("head")) & (F.size("cells") >= least))
    return used.select("file", "pos", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(columns)])


def markdown(spark: SparkSession, path: str, segment: str | None = None) -> DataFrame:
    """``(file, text)`` of Markdown files but readmes and licences, under a path segment if given."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).filter(usable_file(F.col("file")))
    df = df.filter(~F.lower("file").rlike(r"/(?:readme|license|licence)\.md\z"))
    return df.filter(F.col("file").contains(f"/{segment}/")) if segment else df


def xml_words(spark: SparkSession, path: str, row_tag: str = "verse", id_attribute: str = "_osisID", word: str = "w") -> DataFrame:
    """``(id, words array<struct<text, lemma, morph>>)`` of verse elements; files that are not well-formed, which
    ``malformed_xml`` names, are to be left out of ``path``; malformed rows of the others are dropped."""
    attributes = [T.StructField("_VALUE", T.StringType()), T.StructField("_lemma", T.StringType()), T.StructField("_morph", T.StringType())]
    schema = T.StructType([T.StructField(id_attribute, T.StringType()), T.StructField(word, T.ArrayType(T.StructType(attributes)))])
    df = spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").option("ignoreNamespace", True).schema(schema).load(path)
    words = F.transform(word, lambda w: F.struct(w["_VALUE"].alias("text"), w["_lemma"].alias("lemma"), w["_morph"].alias("morph")))
    return df.select(F.col(id_attribute).alias("id"), words.alias("words"))


def malformed_xml(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """``(file, error)`` of the files that no XML parser reads to the end, to be reported as warnings and skipped."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def run(batches):
        from xml.parsers import expat

        for batch in batches:
            rows = []
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    expat.ParserCreate().Parse(raw, True)
                except expat.ExpatError as e:
                    rows.append({"file": file, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("error", pa.string())]))

    return whole.select("path", "content").mapInArrow(run, "file string, error string")


def sitemap_locations(df: DataFrame, column: str = "xml") -> DataFrame:
    """``(source columns, loc)`` of sitemap or sitemap-index documents, whatever their namespace."""
    return df.select(*[c for c in df.columns if c != column], F.explode(F.xpath(column, F.lit("//*[local-name()='loc']/text()"))).alias("loc"))


def zip_member(df: DataFrame, suffix: str, limit: int = 20 << 20, header: bytes = b"") -> DataFrame:
    """``(path, member, content, error)`` of binary files: exactly one member with the suffix, no absolute or
    parent paths, size at most the limit, and a content that starts with ``header``."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                member, content, error = None, None, None
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        found = [m for m in z.infolist() if m.filename.lower().endswith(suffix)]
                        if any(n.startswith("/") or ".." in n.split("/") for n in z.namelist()):
                            error = "unsafe_path"
                        elif len(found) != 1:
                            error = "not_one_member"
                        elif len(raw) > limit or found[0].file_size > limit:
                            error = "too_large"
                        else:
                            member, content = found[0].filename, z.read(found[0])
                            if not content.startswith(header):
                                member, content, error = None, None, "unexpected_header"
                except zipfile.BadZipFile:
                    error = "not_a_zip"
                rows.append({"path": path, "member": member, "content": content, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())]))

    return df.select("path", "content").mapInArrow(run, "path string, member string, content binary, error string")


def document_pages(df: DataFrame, read_pages: Callable[[bytes], list[str]], least: int = 120) -> DataFrame:
    """``(path, file_sha256, page_number, page_count, text)`` of binary documents by a page reader passed in;
    pages shorter than ``least`` are left out, page numbers stay those of the file."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                texts = read_pages(raw)
                rows += [
                    {"path": path, "page_number": k, "page_count": len(texts), "text": t}
                    for k, t in enumerate(texts, 1)
                    if len("\n".join(filter(None, (" ".join(x.split()) for x in t.splitlines())))) >= least
                ]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("page_number", pa.int32()), ("page_count", pa.int32()), ("text", pa.string())]))

    hashes = df.select("path", F.sha2("content", 256).alias("file_sha256"))
    pages = df.select("path", "content").mapInArrow(run, "path string, page_number int, page_count int, text string")
    return pages.join(hashes, "path")


#: A fetch client: ``url -> (status, final url, body)``, and the content type if it is known; OSError if there is no
#: answer. Sessions, agents and retries are the client's.
Fetch = Callable[[str], tuple]
#: What a page is served as.
PAGE_TYPES = ("text/html", "application/xhtml+xml")


def fetched(
    urls: DataFrame, fetch: Fetch, hosts: list[str], limit: int = 8 << 20, allow: Callable[[str], bool] | None = None, types: tuple[str, ...] = PAGE_TYPES
) -> DataFrame:
    """``(url, status, final_url, body, reason)`` by a fetch client passed in; no network here. URLs that ``allow`` (a
    robots gate) refuses or that are off the hosts are not fetched; off-host redirects, other content types, errors
    and oversize bodies get a reason and no body. A redirect's target has to pass the gate too."""

    def run(batches):
        from urllib.parse import urlsplit

        def one(url: str) -> tuple:
            if urlsplit(url).hostname not in hosts and allow is not None:
                return None, None, None, "host_not_allowed"
            if allow is not None and not allow(url):
                return None, None, None, "robots_disallowed"
            try:
                status, final, body, *kind = fetch(url)
            except OSError:
                return None, None, None, "request_failed"
            reason = None
            if status == 404:
                reason = "not_found"
            elif status >= 400:
                reason = "request_failed"
            elif urlsplit(final).hostname not in hosts:
                reason = "redirected_off_host"
            elif allow is not None and final != url and not allow(final):
                reason = "robots_disallowed"
            elif kind and not str(kind[0]).lower().startswith(types):
                reason = "not_html"
            elif len(body) > limit:
                reason = "too_large"
            return status, final, None if reason else body, reason

        names = ("status", "final_url", "body", "reason")
        for batch in batches:
            rows = [{"url": u, **dict(zip(names, one(u), strict=True))} for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("url", pa.string()), ("status", pa.int32()), ("final_url", pa.string()), ("body", pa.binary()), ("reason", pa.string())]))

    return urls.select("url").mapInArrow(run, "url string, status int, final_url string, body binary, reason string")
