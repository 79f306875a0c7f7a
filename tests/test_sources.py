import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.sources import readers, writers
from quillmesh.streaming import turns

RECORD = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType())])


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "g.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"chunk_id":"1","text":"a"}\n\n{"chunk_id":"2","text":"b"}\n')
    bad.write_text('{"chunk_id":"1","text":"a"}\nnot json\n{"chunk_id":"2","text":" "}\n')
    assert readers.jsonl(spark, str(good), RECORD).filter("chunk_id IS NOT NULL").count() == 2
    with pytest.raises(Exception):
        readers.jsonl(spark, str(bad), RECORD).collect()
    assert readers.jsonl(spark, str(tmp_path / "none"), RECORD, allow_missing=True).count() == 0
    got = readers.jsonl_permissive(spark, str(bad), RECORD).orderBy("line").collect()
    assert [(r.line, r.bad) for r in got] == [(1, False), (2, True), (3, False)]
    ok = tmp_path / "ok.jsonl"
    ok.write_text('{"chunk_id":"2","text":" "}\n')
    with pytest.raises(Exception, match="blank"):
        readers.jsonl_required(spark, str(ok), RECORD).collect()


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿URL,Note\nu1,"a, ""b"""\nu1,c\n', encoding="utf-8")
    df = readers.csv(spark, str(tmp_path / "m.csv"))
    assert df.columns == ["url", "note"] and df.first().note == 'a, "b"'
    with pytest.raises(ValueError):
        readers.csv(spark, str(tmp_path / "m.csv"), unique="url")
    (tmp_path / "t.tsv").write_text("intro\nmark\tx\ty\nG1\ta\tb\nG2\tc\n")
    assert [r.c0 for r in readers.tsv_in_band(spark, str(tmp_path / "t.tsv"), "mark", 4, 3).collect()] == ["G1"]
    for name in ("bible/a.md", "bible/README.md", ".git/b.md", "c.md"):
        (tmp_path / "md" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "md" / name).write_text("# T")
    assert readers.markdown(spark, str(tmp_path / "md"), "bible").count() == 1
    (tmp_path / "v.xml").write_text('<o xmlns="urn:x"><verse osisID="B.1.1"><w lemma="l" morph="m">one</w><w lemma="k" morph="n">two</w></verse></o>')
    r = readers.xml_words(spark, str(tmp_path / "v.xml")).first()
    assert r.id == "B.1.1" and [(w.text, w.lemma) for w in r.words] == [("one", "l"), ("two", "k")]
    site = spark.createDataFrame([("s", '<urlset xmlns="urn:y"><url><loc>https://a/1</loc></url><url><loc>https://a/2</loc></url></urlset>')], "src string, xml string")
    assert [r["loc"] for r in readers.sitemap_locations(site).collect()] == ["https://a/1", "https://a/2"]


def test_binaries(spark):
    def pack(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in members.items():
                z.writestr(k.replace("__", "/"), v)
        return out.getvalue()

    rows = [("a", pack(**{"x.txt": "one"})), ("b", pack(**{"x.txt": "1", "y.txt": "2"})), ("c", b"nope"), ("d", pack(**{"..__x.txt": "1"}))]
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    got = {r.path: (r.member, r.error) for r in readers.zip_member(df, ".txt").collect()}
    assert got == {"a": ("x.txt", None), "b": (None, "not_one_member"), "c": (None, "not_a_zip"), "d": (None, "unsafe_path")}
    pages = readers.document_pages(df, lambda raw: ["short", "long " * 40], 120).filter("path = 'a'").collect()
    assert [(p.page_number, p.page_count, len(p.file_sha256)) for p in pages] == [(2, 2, 64)]
    urls = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string")

    def fetch(url):
        if url == "u3":
            raise OSError("down")
        return (200, "https://ok/x", b"body") if url == "u1" else (200, "https://evil/x", b"body")

    assert {r.url: r.reason for r in readers.fetched(urls, fetch, ["ok"]).collect()} == {"u1": None, "u2": "redirected_off_host", "u3": "request_failed"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("2", None), ("1", "x")], "chunk_id string, b string")
    path = str(tmp_path / "out")
    for _ in range(2):
        writers.sorted_jsonl(df, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert lines == [{"b": "x", "chunk_id": "1"}, {"b": None, "chunk_id": "2"}]
    writers.replace(df, path, backup=str(tmp_path / "old"))
    assert spark.read.json(str(tmp_path / "old")).count() == 2 and spark.read.parquet(path).count() == 2
    body = spark.createDataFrame([("u", bytearray(b"1")), ("v", bytearray(b"1"))], "url string, body binary")
    for _ in range(2):
        assert writers.blobs(body, str(tmp_path / "blobs")).columns == ["url", "blob"]
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 1
    assert not writers.publish_all_or_nothing(df, df, str(tmp_path / "p"), df, str(tmp_path / "man"))
    assert (tmp_path / "man").exists() and not (tmp_path / "p").exists()
    assert writers.publish_all_or_nothing(df, df.limit(0), str(tmp_path / "p"), df, str(tmp_path / "man"))
    writers.table(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_streams(spark, tmp_path):
    rows = [(1, "send", "hi", "s", 1), (1, "send", "", "s", 2), (2, "load", None, "s", 1), (1, "send", "x", "z", 3)]
    schema = "player_id long, type string, text string, scope string, ts long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    checked = turns.validated(stream, ["s"]).filter("type = 'send'").withColumn("status", F.when(F.col("error_code").isNull(), "ok").otherwise("error"))
    q = turns.numbered(checked).writeStream.format("memory").queryName("numbered").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select turn_index, status from numbered where player_id = 1 order by turn_index").collect()
    assert [tuple(r) for r in got] == [(1, "ok"), (2, "error"), (3, "error")]
