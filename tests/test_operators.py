import random

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.operators import chunking, corpus, embedding, frontier, html, quality, retrieval, selection, study
from quillmesh.plans import queries


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. !?\n", max_size=300), st.integers(5, 40))
def test_pieces_are_bounded_and_lose_nothing(text, limit):
    got = chunking.pieces(text, limit)
    assert all(0 < len(p) <= limit for p in got)
    assert "".join("".join(got).split()) == "".join(text.split())


def test_pieces_by_hand():
    assert chunking.pieces("aa\n\nbb\n\ncc", 6) == ["aa\n\nbb", "cc"]
    assert chunking.pieces("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunking.pieces("x" * 25, 10, lossy=True) == ["x" * 10, "x" * 5]


def test_chunk_ids(spark):
    df = spark.createDataFrame([("a", "short"), ("b", "x" * 30), ("c", None)], "id string, text string")
    assert [(r.chunk_id, r.piece, r.pieces) for r in chunking.chunk(df, "id", "text", 20).orderBy("chunk_id").collect()] == [("a", 1, 1), ("b_01", 1, 2), ("b_02", 2, 2)]


def test_body_pieces(spark):
    rows = [(1, 0, "heading", "H"), (1, 1, "paragraph", 'a "q" b'), (1, 2, "table_row", "Book 1:2 | old | new"), (2, 0, "heading", "Only"), (3, 0, "paragraph", "p " * 40)]
    df = spark.createDataFrame(rows, "page_id long, pos int, type string, text string")
    got = {(r.page_id, r.piece_no): r for r in chunking.body_pieces(df, r"Book\s+\d+:\d+", 70).collect()}
    assert got[(1, 1)].text == "Section: H\na b" and got[(1, 2)].text == "Section: H\nTable reference: Book 1:2\nTable commentary: new"
    assert got[(2, 1)].text == "Section: Only" and got[(1, 1)].quotes_removed == 1 and got[(1, 1)].cells_removed == 2


def test_verses_and_cross_references(spark):
    lines = [r"\id BOO", r"\c 1", r"\v 1 In a", "more", r"\v 2-3 two", r"\mt skip", r"\c 2", r"\v 1 x"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, pos int, value string")
    got = sorted((r.chapter, r.verse_start, r.verse_end, r.text) for r in corpus.verses_from_lines(df).collect())
    assert got == [(1, 1, 1, "In a more"), (1, 2, 3, "two"), (2, 1, 1, "x")]
    edges = corpus.edges_from_lines(spark.createDataFrame([("From Verse To Votes",), ("# c",), ("",), ("A.1.1 B.2.2 5",), ("A.1.1 B.1.1-B.1.3 -2 x",)], "value string"))
    assert sorted(map(tuple, edges.collect())) == [("A.1.1", "B.1.1-B.1.3", -2), ("A.1.1", "B.2.2", 5)]
    chunks = spark.createDataFrame([("B", 1, 1, 2, "c1", "old"), ("B", 1, 2, None, "c2", "new")], "book string, chapter int, verse_start int, verse_end int, chunk_id string, text string")
    verses = corpus.verse_texts(chunks)
    assert sorted((r.verse, r.text) for r in verses.collect()) == [(1, "old"), (2, "new")]
    e = spark.createDataFrame([("B", 1, 1, "t2", 3), ("B", 1, 1, "t1", 3), ("B", 1, 1, "t0", 9), ("B", 9, 9, "t", 1)], "book string, chapter int, verse int, target string, votes int")
    found, missed = corpus.cross_reference_chunks(e, verses, F.col("target"))
    assert found.first().text == "old\n\nRelated: t0; t1; t2" and missed.count() == 1


def test_gates_and_merges(spark):
    df = spark.createDataFrame([("x Table of Contents", 3), ("Index of", 3), ("Under the editorship of", 9), ("Under the editorship of", 20), ("go paypal.me/x", 1), (None, 1)], "t string, n int")
    assert [r[0] for r in df.select(corpus.page_exclusion(F.col("t"), F.col("n"), ("paypal.me/",))).collect()] == ["contents", "index", "editorial_front_matter", None, "third_party_notice", None]
    rows = spark.createDataFrame([("s", True, "a"), ("s", None, "a"), ("s", True, "b")], "source_id string, index_eligible boolean, layer string")
    assert corpus.eligible(rows, spark.createDataFrame([("s", "a")], "source_id string, layer string"), ["layer"]).count() == 1
    ex = spark.createDataFrame([("u", "l", {"url": None})], "url string, licence string, extra map<string,string>")
    assert tuple(corpus.override(ex, "extra", ["url", "licence"]).select("url", "licence").first()) == (None, "l")


def test_selection(spark):
    df = spark.createDataFrame([("B", 1, 1, None), ("B", 1, 3, 9), ("C", 1, 1, 1)], "book string, chapter int, s int, e int")
    windows = spark.createDataFrame([("B", 1, 2, 4)], "book string, chapter int, low int, high int")
    assert [r.s for r in selection.interval_join(df, windows, ["book", "chapter"], "s", "e", "low", "high").collect()] == [3]
    pieces = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("b", 1, 2), ("c", 1, 1), ("c", 1, 1), ("d", 1, 1), ("d", 2, 2)], "p string, n int, t int")
    assert sorted(r.p for r in selection.sequence_gaps(pieces, "p", "n", "t").collect()) == ["b", "c", "d"]
    clip = df.select(selection.clipped_values(F.col("s"), F.col("e"), F.lit(2), F.lit(4)))
    assert [r[0] for r in clip.collect()] == [[], [3, 4], []]


def test_retrieval(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice(["a", "b", "c", "", None]), draw.choice([0.1, 0.5, 0.9]), "t" * draw.randrange(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_id int, source_id string, score double, text string")
    for k, cap in ((3, 1), (7, 2), (50, 3)):
        got = [(r.chunk_id, r.rank) for r in retrieval.diversified(df, k, cap).orderBy("rank").collect()]
        seen, want = {}, []
        for i, s, score, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
            if s and seen.get(s, 0) < cap and len(want) < k:
                seen[s] = seen.get(s, 0) + 1
                want.append((i, len(want) + 1))
        assert got == want
    got = {r.chunk_id: r.shown for r in retrieval.budgeted(df.withColumn("g", F.lit(0)), ["g"], [F.col("chunk_id")], "text", 5, 100).collect()}
    used, want = 0, {}
    for i, _, _, t in rows:
        if used < 100:
            want[i] = t[: min(5, 100 - used)]
            used += len(want[i])
    assert got == want
    ctx = retrieval.context(spark.createDataFrame([(0, 2, "T2", "x"), (0, 1, "T1", "y")], "g int, rank int, title string, shown string"), ["g"], [("Title", "title")])
    assert ctx.first().context == "[S1]\nTitle: T1\nContent:\ny\n\n[S2]\nTitle: T2\nContent:\nx"
    with pytest.raises(ValueError):
        retrieval.with_scores(df, [])


def test_frontier(spark):
    urls = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d/e",), ("/c",)], "path string")
    assert sorted(r.path for r in frontier.with_children(urls).filter("has_children").collect()) == ["/a", "/c"]
    c = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "url string")
    ok = spark.createDataFrame([("1",)], "url string")
    bad = spark.createDataFrame([("2", True), ("3", False)], "url string, terminal boolean")
    assert sorted(r.url for r in frontier.pending(c, ok, bad).collect()) == ["3", "4"]
    assert sorted(r.url for r in frontier.pending(c, ok, bad, retry_all=True).collect()) == ["2", "3", "4"]
    s = frontier.summary(c.withColumn("has_children", F.lit(False)), ok, bad).first()
    assert (s.pending, s.status) == (2, "partial")
    good, rest = frontier.advance((ok, bad), spark.createDataFrame([("3",)], "url string"), spark.createDataFrame([("4", True)], "url string, terminal boolean"))
    assert (good.count(), sorted(r.url for r in rest.collect())) == (2, ["2", "4"])


@pytest.mark.parametrize("n", [1, 8, 9, 20])
def test_assignment(spark, n):
    got = study.assign_blocks(spark.range(n).withColumnRenamed("id", "p"), "p", 3).orderBy("p").collect()
    assert [r.position for r in got] == list(range(1, n + 1))
    for b in range(0, n, 8):
        own = [r.sequence_id for r in got[b : b + 8]]
        assert len(set(own)) == len(own) and set(own) <= set(range(1, 9))


def test_study(spark):
    turns = spark.createDataFrame([(1, 1, "q", "a", "ok", '[{"rank":"1","title":"t","secret":"x"}]'), (1, 2, "q2", None, "error", None), (1, 3, "q3", "", "ok", "bad")],
                                  "player_id long, turn_index int, question string, answer string, status string, sources_json string")
    got = [(r.turn_index, r.sender, len(r.sources)) for r in study.public_history(turns).orderBy("turn_index", "seq").collect()]
    assert got == [(1, "user", 0), (1, "assistant", 1), (3, "user", 0), (3, "assistant", 0)]
    assert study.model_history(turns).count() == 2 and study.next_turn(turns).first().next_index == 4
    plan = spark.createDataFrame([(1, "p1", "rag", "p2", "baseline")], "sequence_id int, passage1 string, condition1 string, passage2 string, condition2 string")
    rows = study.rounds(spark.createDataFrame([(7, 1)], "pid int, sequence_id int"), plan).orderBy("round").collect()
    assert [(r.round, r.passage, r.condition) for r in rows] == [(1, "p1", "rag"), (2, "p2", "baseline")]


PAGE = """<html><head><title>A &amp; B</title><link rel="canonical" href="https://x.y/c"><script type="application/ld+json">
{"@graph":[{"@type":"Person"},{"@type":["Article"],"author":[{"name":"N"},"M"]}]}</script><script>var t="</p>";</script></head>
<body><nav><p>menu<p>more</nav><article><h1>H</h1><p>one <b>two<p>three<p>three<table><tr><td>a<td>b</tr></table><blockquote>q</blockquote>
<div class="ad"><div>x</div></div></article><p>outside <a href="/l">l</a></body>"""


def test_html(spark):
    page = html.read_page(PAGE, frozenset(("ad",)), "article")
    assert page.title == "A & B" and page.canonical == "https://x.y/c" and page.links == ["/l"]
    assert page.blocks == [("heading", "H"), ("paragraph", "one two"), ("paragraph", "three"), ("table_row", "a | b"), ("quote", "q")]
    assert html.author_names(html.article(page.json_ld)["author"]) == ["N", "M"]
    assert html.read_page(None).blocks == [] and html.read_page("<p>a &lt; b").blocks == [("paragraph", "a < b")]
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].container == "page" and got[1].authors == ["N", "M"] and got[2].text == ""
    assert html.blocks(df).filter("page_id = 1").count() > 4


def test_pages_are_held_in_parts(spark, monkeypatch):
    """Each part is handed on before the next is read, whatever Arrow's batches have."""
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(3 * html.PART + 1)), "html": [f"<p>{i}" for i in range(3 * html.PART + 1)]})
    parts = list(html.in_parts([batch, batch.slice(0, 0), batch.slice(5, 2)]))
    assert [p.num_rows for p in parts] == [html.PART] * 3 + [1, 2]
    assert [i for p in parts[:4] for i in p.column("page_id").to_pylist()] == batch.column("page_id").to_pylist()
    pages = spark.createDataFrame([(i, f"<p>{i}<a href='/{i}'>x</a>") for i in range(3 * html.PART + 1)], "page_id long, html string").coalesce(1)
    for make, wanted in ((html.extract, 4), (html.blocks, 4)):
        held, runs = [], []
        with monkeypatch.context() as m:
            m.setattr(type(pages), "mapInArrow", lambda self, f, schema: runs.append(f))
            make(pages)
        for out in runs[0](iter([batch])):
            held.append(out.num_rows)
        assert len(held) == wanted and sum(held) == batch.num_rows
    assert sorted((r.page_id, r.text, r.links) for r in html.extract(pages).collect()) == [(i, f"{i}x", [f"/{i}"]) for i in range(3 * html.PART + 1)]


def test_titles_as_their_sql_has_them(spark, tmp_path):
    titles = ["a &amp", "token = &quot;77", "&amp;lt; &lt;b&gt;", " a\n\n b\u00a0", "x\u200by\u00ad", "&#39;", "\x0ba"]
    rows = [(i, f"<p>1<title>{t}</title><title>z</title>") for i, t in enumerate(titles)] + [(90, None), (91, "<title>open"), (92, "<TITLE>a</TITLE>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select page_id, title, has_paragraph from ({queries.ORACLE_SQL['html_title']}) order by 1").fetchall()
    assert [tuple(r) for r in queries.html_title(spark, str(tmp_path)).select("page_id", "title", "has_paragraph").orderBy("page_id").collect()] == want
    assert html.read_page("<title>a &amp b &quot;</title>").title == 'a & b "'


def test_embedding(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"text {i}") for i in range(40)], "chunk_id string, text string")
    path, client = str(tmp_path / "index"), embedding.hashing_embedder(8)
    mark = embedding.fingerprint(embedding.content_digest(df), 40, "p", "m", 8)
    embedding.build_index(df.limit(10), path, client, 8, mark)
    assert embedding.build_index(df, path, client, 8, mark).select("chunk_id").distinct().count() == 40
    assert spark.read.parquet(path).count() == 40
    with pytest.raises(ValueError):
        embedding.build_index(df, path, client, 8, "other")
    assert embedding.content_digest(df) == embedding.content_digest(df.repartition(3))
    with pytest.raises(ValueError):
        embedding.validate([[1.0, 2.0]], 1, 3)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise embedding.ServiceError("busy", 503)
        return "done"

    assert embedding.with_retries(flaky, sleep=lambda s: None) == "done"
    with pytest.raises(embedding.ServiceError):
        embedding.with_retries(lambda: (_ for _ in ()).throw(embedding.ServiceError("no", 401)), sleep=lambda s: None)


def test_quality(spark):
    df = spark.createDataFrame([(1, ""), (2, "x"), (3, None)], "id long, text string")
    got = {r.check: (r.violations, r.examples) for r in quality.row_checks(df, "id", {"empty": F.coalesce("text", F.lit("")) == "", "never": F.lit(False)}).collect()}
    assert got == {"empty": (2, [1, 3]), "never": (0, None)}
    line = spark.createDataFrame([('{"a": null}',), ("[1]",)], "l string")
    assert [r[0] for r in line.select(quality.missing_keys("l", ["a", "b"])).collect()] == [["b"], ["a", "b"]]


def _scripture(s):
    out, i = [], 0
    while i < len(s):
        for opens, closes in ((r"\f ", r"\f*"), (r"\x ", r"\x*"), (r"\fe ", r"\fe*"), (r"\zaln-s ", r"\*")):
            if s.startswith(opens, i):
                i = s.index(closes, i) + len(closes)
                out.append(" ")
                break
        else:
            if s.startswith(r"\zaln-e\*", i):
                i += len(r"\zaln-e\*")
                out.append(" ")
            elif s.startswith(r"\w ", i):
                end = s.index(r"\w*", i)
                out.append(s[i + 3 : end].split("|")[0])
                i = end + 3
            elif s[i] == "\\":
                i += 1
                while i < len(s) and (s[i].isalnum() or s[i] in "+-"):
                    i += 1
                i += s[i : i + 1] == "*"
                out.append(" ")
            else:
                out.append(s[i])
                i += 1
    return " ".join("".join(out).split())


def test_scripture_markers_against_a_scanner(spark):
    import random

    from quillmesh.functions import text

    draw = random.Random(8)
    parts = ["plain", r"\w word|lemma=x\w*", r"\f + note here\f*", r"\x - ref\x*", r'\zaln-s |x="G1" \*', r"\zaln-e\*", r"\q1 ", r"\p ", " , "]
    rows = ["".join(draw.choices(parts, k=draw.randrange(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", text.strip_markers(F.col("s")).alias("t")).collect()}
    for i, r in enumerate(rows):
        assert got[i] == _scripture(r), r


def test_markdown_is_taken_off(spark):
    from quillmesh.functions import text

    cases = {
        "# A\n\n\n\ntext": "A\n\ntext", "see [b](u) and [[c]] and ![d](e)": "see b and c and d", "[![in](i.png)](u)": "in",
        "<!-- x\ny -->**b** _i_ `c` > q": "b i c q", "##no": "no", "a # b": "a # b", "[](u)": "[](u)", "![](u)x": "x",
    }
    df = spark.createDataFrame(list(cases.items()), "s string, want string")
    for r in df.select("s", "want", text.strip_markdown(F.col("s")).alias("t")).collect():
        assert r.t == r.want, r.s


def test_each_page_is_cut_by_its_own_head(spark):
    from quillmesh.operators import build

    body = "Some words here. " * 300
    block = [("paragraph", body)]
    row = lambda i, title: (i, f"https://h/{i}", title, "", [], [], "L", "article", block)
    schema = "id string, canonical_url string, title string, passage string, passage_tags array<string>, book_tags array<string>, license string, content_type string, blocks array<struct<type: string, text: string>>"
    alone = build.commentary(spark.createDataFrame([row("a", "Short")], schema), ["Ruth"], "L", "article")
    beside = build.commentary(spark.createDataFrame([row("a", "Short"), row("b", "Long " * 400)], schema), ["Ruth"], "L", "article")
    texts = lambda df: sorted(r.text for r in df.filter("source_page_id = 'a'").collect())
    assert texts(alone) == texts(beside) and len(texts(alone)) == 2
    assert all(len(r.text) <= 3500 for r in beside.collect())


def test_queries_in_blocks_find_what_all_pairs_find(spark):
    import numpy as np

    from quillmesh.operators import retrieval

    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 6))
    x[50:60] = x[40:50] * 3  # ties
    rows = [(i, v.tolist(), int(i % 7)) for i, v in enumerate(x)] + [(900, [0.0] * 6, 1), (901, [1.0], 1), (902, None, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").repartition(5)
    queries = vectors.filter("vec_id < 300 AND vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k, source, block in ((4, None, 7), (1, "label", 1000)):
        got = {}
        for r in retrieval.best_of_queries(vectors, queries, k, source, block).collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.source))
        assert set(got) == set(range(0, 300, 10))
        for q, found in got.items():
            score = np.round(unit @ unit[q], 9)
            order = sorted(range(300), key=lambda i: (-score[i], i))
            want = order[:k] if source is None else [next(i for i in order if i % 7 == s) for s in range(7)]
            assert sorted(i for i, _ in found) == sorted(want)


def test_budget_by_parts_is_the_budget(spark):
    from quillmesh.operators import retrieval

    rows = [(i, "ab"[i % 2], "x" * (i * 37 % 900)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    plain = retrieval.budgeted(df, ["lang"], [F.col("doc_id")], "text", 300, 2000)
    parts = retrieval.budgeted(df, ["lang"], [F.col("doc_id")], "text", 300, 2000, "doc_id")
    columns = ["doc_id", "lang", "used", "shown"]
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(map(tuple, parts.select(columns).collect()))


def test_keyed_history_and_checkpoint(spark, tmp_path):
    from quillmesh.streaming import turns

    rows = [(1, "q1", "a1", 1), (1, "q2", "", 2), (1, "q3", "a3", 3), (2, "p1", "b1", 1)]
    schema = "player_id long, question string, answer string, ts long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: turns.with_history(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    for _ in range(2):  # the second run finds nothing new
        turns.start(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.player_id, r.turn_index): (r.question, r.history) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 4 and got[(1, 3)] == ("q3", '[{"role": "user", "text": "q1"}, {"role": "model", "text": "a1"}]')
    told = spark.createDataFrame([(1, 1, "q1", "a1", "ok"), (1, 2, "q2", None, "error")], "player_id long, turn_index long, question string, answer string, status string")
    again = turns.recomputed_history(spark.createDataFrame([(1,), (3,)], "player_id long"), told).orderBy("player_id").collect()
    assert [m.text for m in again[0].history] == ["q1", "a1"] and again[1].history is None
