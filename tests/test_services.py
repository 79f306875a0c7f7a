"""Clients, crawl and import controllers over services that answer from memory."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh import settings
from quillmesh.operators import answering, clients, crawl, embedding, importing
from quillmesh.operators.embedding import ServiceError


class Service:
    """Answers in turn; keeps what it was asked."""

    def __init__(self, *answers):
        self.answers, self.asked, self.slept = list(answers), [], []

    def __call__(self, url, headers, payload, timeout):
        self.asked.append((url, headers, payload, timeout))
        found = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(found, Exception):
            raise found
        return found


def client(service, provider="ollama", **more):
    return clients.EmbeddingClient(provider, more.pop("model", "m"), 3, service, "http://s/", sleep=service.slept.append, **more)


def test_embedding_calls_of_both_services():
    good = Service((200, {}, json.dumps({"embeddings": [[1, 2, 3], [4, 5, 6]]})))
    assert client(good)(["a", "b"], "document").tolist() == [[1, 2, 3], [4, 5, 6]]
    url, headers, payload, timeout = good.asked[0]
    assert (url, payload["input"], payload["truncate"], timeout) == ("http://s/api/embed", ["a", "b"], True, 120.0)
    good = Service((200, {}, json.dumps({"embeddings": [{"values": [1, 2, 3]}]})))
    assert client(good, "Gemini", key="k")(["a"], "query").shape == (1, 3)
    url, headers, payload, _ = good.asked[0]
    assert url == "http://s/models/m:batchEmbedContents" and headers["x-goog-api-key"] == "k"
    assert payload["requests"][0]["embedContentConfig"] == {"taskType": "RETRIEVAL_QUERY", "outputDimensionality": 3}
    for bad in (lambda: client(good, "other"), lambda: client(good)([], "query"), lambda: client(good)(["a"], "x"), lambda: clients.EmbeddingClient("ollama", "m", 0, good, "")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ServiceError, match="key"):
        client(good, "gemini")(["a"], "query")
    with pytest.raises(ServiceError, match="shape"):
        client(Service((200, {}, json.dumps({"embeddings": [[1, 2]]}))))(["a"], "query")
    assert "secret" not in repr(client(good, "gemini", key="secret"))


def test_calls_are_repeated_and_errors_sanitised():
    service = Service((429, {"Retry-After": "7"}, ""), OSError("down"), (500, {}, ""), (200, {}, json.dumps({"embeddings": [[1, 2, 3]]})))
    assert client(service)(["a"], "query").tolist() == [[1, 2, 3]]
    assert len(service.asked) == 4 and service.slept[0] == 7
    service = Service((403, {}, json.dumps({"error": {"message": "no\n  access"}})))
    with pytest.raises(ServiceError, match="HTTP 403: no access"):
        client(service, "gemini", key="secret")(["a"], "query")
    assert len(service.asked) == 1
    service = Service(OSError("down"))
    with pytest.raises(ServiceError, match="ollama pull m"):
        client(service, retries=2)(["a"], "query")
    assert len(service.asked) == 3


def test_generation(spark):
    service = Service((200, {}, json.dumps({"candidates": [{"content": {"parts": [{"text": "Ans"}, {"text": "wer"}]}}]})))
    model = clients.GenerationClient("m", service, "http://s", "k")
    rows = [(1, "rag", "Q?", "Ruth 1:1", "In the days", [("user", "hi"), ("robot", "x"), ("model", " ")])]
    q = spark.createDataFrame(rows, "question_id long, condition string, question string, scope string, passage string, history array<struct<role: string, text: string>>")
    c = spark.createDataFrame([(1, "[S1]", ["s"])], "question_id long, context string, sources array<string>")
    body = answering.with_context(q, c).select(answering.request("Be brief.", F.col("history"), answering.prompt(F.col("question"), F.col("scope"), F.col("passage"), F.col("context")))).first()[0]
    assert model(body) == "Answer"
    sent = service.asked[0][2]
    assert sent["systemInstruction"]["parts"][0]["text"] == "Be brief." and sent["generationConfig"]["thinkingConfig"] == {"thinkingLevel": "minimal"}
    assert [m["role"] for m in sent["contents"]] == ["user", "user"] and sent["contents"][1]["parts"][0]["text"].startswith("PASSAGE REFERENCE:\nRuth 1:1\n\nPASSAGE TEXT:")
    got = answering.answer_questions(q, c, lambda p: json.loads(p)["contents"][-1]["role"], system="s").first()
    assert got.answer == "user" and got.latency_ms >= 0
    with pytest.raises(ServiceError):
        clients.GenerationClient("m", Service((200, {}, "{}")), "http://s", "k")(body)


def test_texts_of_one_call_are_held_at_a_time(spark, monkeypatch):
    """Texts come as Arrow's column, also in slices with nulls, and only those of a call become strings."""
    texts = pa.array(["skipped", None, *map(str, range(5)), None, "x"]).slice(1)
    sent = []
    client = lambda t, task: sent.append(t) or embedding.hashing_embedder(8)(t, task)
    got = embedding._vectors(texts, client, 8, "document", 2).to_pylist()
    assert sent == [["0", "1"], ["2", "3"], ["4", "x"]]
    assert [v is None for v in got] == [True, *[False] * 5, True, False]
    for t, v in zip(texts.to_pylist(), got, strict=True):
        assert t is None or v == pytest.approx(embedding.embed_query(t, embedding.hashing_embedder(8), 8))
    assert embedding._vectors(pa.array([None, None], pa.string()), client, 8, "document", 2).to_pylist() == [None, None]
    assert embedding._vectors(pa.array([], pa.string()), client, 8, "document", 2).to_pylist() == []
    monkeypatch.setattr(embedding.F, "pandas_udf", None)  # a Series holds a whole batch's strings
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"t{i}") for i in range(40)], "i int, text string").coalesce(1)
    rows = embedding.embed(df, "text", embedding.hashing_embedder(8), 8).collect()
    assert [r.embedding is None for r in rows] == [r.i % 3 == 0 for r in rows]


def test_null_texts_are_not_embedded(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "chunk_id long, text string")
    got = {r.chunk_id: r.embedding for r in embedding.embed(df, "text", embedding.hashing_embedder(8), 8).collect()}
    assert got[2] is None and got[1] == got[3] and len(got[1]) == 8
    assert np.allclose(embedding.embed_query("a b", embedding.hashing_embedder(8), 8), got[1])
    assert embedding.smoke_test(df.filter("text is not null"), embedding.hashing_embedder(8), 8).count() == 2


PAGES = {f"https://h/p{i}": f"text of page {i} " * 20 for i in range(7)} | {"https://h/p5": "text of page 1 " * 20, "https://h/p6": "short"}


def extract(df):
    return df.select("url", F.col("body").alias("text"), F.when(F.length("body") < 50, "too_short").alias("reject_reason"))


def test_crawl_goes_on_from_its_checkpoint(spark, tmp_path):
    down = ["https://h/p3"]

    def fetch(url):
        if url in down:
            raise OSError("down")
        return 200, url, PAGES[url].encode(), "text/html; charset=utf-8"

    candidates = spark.createDataFrame([(u, i) for i, u in enumerate([*PAGES, "https://h/secret", "https://x/off"])], "url string, pos int")
    allow = crawl.robots("User-agent: *\nDisallow: /secret", "agent")
    path = str(tmp_path / "crawl")
    first = crawl.run(candidates, path, fetch, ["h"], extract, allow, checkpoint=2, most=3).first()
    assert (first.accepted, first.pending, first.status) == (3, 6, "partial")
    second = crawl.run(candidates, path, fetch, ["h"], extract, allow, checkpoint=4).first()
    # p0 to p2 and p4 are good; p5 repeats p1, p6 is short, one is off by the gate, one off the host; p3 failed.
    assert (second.accepted, second.terminal, second.transient, second.status) == (4, 4, 1, "partial")
    down.clear()
    seen = []
    last = crawl.run(candidates, path, lambda u: seen.append(u) or fetch(u), ["h"], extract, allow).first()
    assert (last.accepted, last.terminal, last.transient, last.pending, last.status) == (5, 4, 0, 0, "complete_with_rejections")
    assert spark.read.json(f"{path}/manifest").first().processed_this_run == 1
    with pytest.raises(ValueError):
        crawl.robots(None, "agent")
    with pytest.raises(ValueError):
        crawl.run(candidates, path, fetch, ["h"], extract, allow, checkpoint=0)


def test_polite_clients_wait():
    now, slept = [0.0], []
    fetch = crawl.polite(lambda u: (200, u, b""), 1.0, sleep=slept.append, clock=lambda: now[0])
    fetch("a")
    now[0] = 1.0
    fetch("b")
    assert slept == [2.0]


def test_sitemaps(spark):
    xml = lambda tag, *urls: f"<{tag} xmlns='http://s'>" + "".join(f"<x><loc>{u}</loc></x>" for u in urls) + f"</{tag}>"
    index = spark.createDataFrame([(xml("sitemapindex", "https://h/map_2_1.xml", "https://h/other.xml"),)], "xml string")
    children = spark.createDataFrame([("https://h/map_2_1.xml", xml("urlset", "https://h/a", "https://h/b", "https://h/a", "https://x/c")), ("https://h/other.xml", xml("urlset", "https://h/z"))], "sitemap string, xml string")
    found, counts = crawl.candidates_of_sitemaps(index, children, r"map_2_[0-9]+\.xml", F.col("url").startswith("https://h/"))
    assert [r.url for r in found.orderBy("pos").collect()] == ["https://h/a", "https://h/b"]
    assert [tuple(r) for r in counts.collect()] == [("https://h/map_2_1.xml", 4)]


def test_import_of_documents(spark, tmp_path):
    draw = random.Random(1)
    body = {n: bytes(draw.randrange(256) for _ in range(20)) for n in ("a.pdf", "b.pdf")}
    pages = {body["a.pdf"]: ["long  text\n\n" * 20, "short", "more " * 60], body["b.pdf"]: ["page " * 50]}
    files = spark.createDataFrame([(f"/raw/{n}", bytearray(b)) for n, b in body.items()], "path string, content binary")
    sources = spark.createDataFrame([("A", "a.pdf", True, "open"), ("B", "b.pdf", False, "held")], "source_id string, source_file string, index_eligible boolean, license_status string")
    manifest = files.selectExpr("CASE WHEN path LIKE '%a.pdf' THEN 'A' ELSE 'B' END AS source_id", "upper(sha2(content, 256)) AS file_hash")
    read = lambda raw: pages[bytes(raw)]
    path = str(tmp_path / "out")
    records, report = importing.import_documents(files, sources, manifest, read, path, dry_run=True)
    assert not (tmp_path / "out").exists()
    assert sorted(r.id for r in records.collect()) == ["A_page_0001", "A_page_0003", "B_page_0001"]
    assert {r.source_id: (r.pages, r.accepted_pages, r.skipped_short_pages) for r in report.collect()} == {"A": (3, 2, [2]), "B": (1, 1, [])}
    importing.import_documents(files, sources, manifest, read, path)
    assert spark.read.parquet(f"{path}/pages").count() == 3 and spark.read.json(f"{path}/report").count() == 2
    with pytest.raises(ValueError, match="manifest"):
        importing.import_documents(files, sources, manifest.withColumn("file_hash", F.lit("0")), read, path)
    with pytest.raises(FileNotFoundError):
        importing.import_documents(files.limit(1), sources, manifest, read, path)
    with pytest.raises(ValueError, match="no usable text"):
        importing.import_documents(files, sources, manifest, lambda raw: ["x"], path)


def test_settings():
    got = settings.Settings.of({"EMBEDDING_PROVIDER": " Ollama ", "RAG_TOP_K": "5"}, "/root")
    assert (got.provider, got.embedding_model, got.dimension, got.top_k, got.thinking) == ("ollama", "nomic-embed-text", 768, 5, "minimal")
    assert got.index == "/root/corpus/processed/index" and settings.resolved("/r", "/abs") == "/abs"
    for bad in ({"EMBEDDING_PROVIDER": "x"}, {"GEMINI_THINKING_LEVEL": "x"}, {"RAG_TOP_K": "0"}, {"RAG_TOP_K": "many"}):
        with pytest.raises(ValueError):
            settings.Settings.of(bad, "/")
    with pytest.raises(ValueError, match="KEY is missing"):
        settings.required({"KEY": " "}, "KEY")
    assert settings.required({"KEY": " v "}, "KEY") == "v"


def test_remaining_time():
    assert embedding.remaining(0, 10, 1.0) == (0.0, None)
    assert embedding.remaining(5, 20, 2.5) == (2.0, 7.5)


def test_zip_header_and_malformed_xml(spark, tmp_path):
    import io
    import zipfile

    from quillmesh.sources import readers, writers

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("x.txt", "From Verse\tTo")
    df = spark.createDataFrame([("a", bytearray(raw.getvalue()))], "path string, content binary")
    assert readers.zip_member(df, ".txt", header=b"From Verse").first().error is None
    assert readers.zip_member(df, ".txt", header=b"Other").first().error == "unexpected_header"
    (tmp_path / "good.xml").write_text("<a><b/></a>")
    (tmp_path / "bad.xml").write_text("<a><b></a>")
    assert [r.file.rsplit("/", 1)[1] for r in readers.malformed_xml(spark, str(tmp_path)).collect()] == ["bad.xml"]
    one, two = spark.range(1), spark.range(2)
    path = str(tmp_path / "snap")
    assert writers.keep_existing(one, path) and not writers.keep_existing(two, path) and spark.read.parquet(path).count() == 1
    assert writers.keep_existing(two, path, force=True) and spark.read.parquet(path).count() == 2
    assert writers.output_path("/o/x/", True) == "/o/x_smoke" and writers.output_path("/o/x") == "/o/x"
    writers.report({"sources": two, "totals": one}, str(tmp_path / "rep"))
    assert len(spark.read.json(str(tmp_path / "rep")).first().sources) == 2
    assert [p.name for p in tmp_path.iterdir() if "old-" in p.name or "staged-" in p.name] == []


def test_manifest_row_and_book_columns(spark):
    from quillmesh.operators import study, validation

    manifest = spark.createDataFrame([("A", "CC BY 4.0", "AB")], "source_id string, license string, file_hash string")
    problems = lambda *x: sorted(r.problem for r in validation.source_row_problems(manifest, *x).collect())
    assert problems("A", "CC BY 4.0", "ab") == [] and problems("B", "x", "y") == ["no_row"]
    assert problems("A", "other", "cd") == ["hash_differs", "unexpected_licence"]
    people = spark.createDataFrame([("a", "name")], "response_code string, label string")
    assert study.scrubbed(people, "label", "none").first().label == ""
    with pytest.raises(ValueError):
        study.chat_turns(people, people, people, {"chat_model": "x"})


def test_text_that_is_searched():
    from quillmesh.operators import retrieval

    assert retrieval.query_text("Ruth 1:1", "Who?") == "Biblical passage: Ruth 1:1\nBible-study question: Who?"
