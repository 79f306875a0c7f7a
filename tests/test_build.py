import pytest
from pyspark.sql import functions as F

from quillmesh.operators import answering, build, validation

BOOKS = ["Song Two", "Book"]


def test_commentary(spark):
    schema = "id string, title string, canonical_url string, license string, content_type string, passage string, passage_tags array<string>, book_tags array<string>, blocks array<struct<type:string,text:string>>"
    fine = [("heading", "H"), ("paragraph", "words " * 30)]
    rows = [("p1", 'The "T" page', "u1", "L", "C", "Book 1:2-3", [], [], fine), ("p2", "t", "u2", "L", "X", "", [], [], fine), ("p3", "t", "u3", "L", "C", None, [], ["song two"], []),
            ("p4", "t", "u4", "L", "C", "", [], [], fine), ("p5", "t", "u4", "L", "C", "", [], [], fine)]
    got = build.commentary(spark.createDataFrame(rows, schema), BOOKS, "L", "C").collect()
    by = {r.source_page_id: r for r in got}
    assert by["p1"].chunk_id == "p1" and (by["p1"].book, by["p1"].chapter, by["p1"].verse_end, by["p1"].quotes_removed) == ("Book", 1, 3, 1)
    assert by["p1"].text.startswith("Commentary page: The page\nPassage: Book 1:2-3\nBook: Book\n\nSection: H\nwords")
    assert [by[k].error for k in ("p1", "p2", "p3", "p4", "p5")] == [None, "wrong_content_type", "no_usable_text", "repeated_identity", "repeated_identity"]
    with pytest.raises(Exception, match="wrong_content_type|no_usable_text|repeated_identity"):
        build.require_clean(build.commentary(spark.createDataFrame(rows, schema), BOOKS, "L", "C")).collect()


def test_document_pages(spark):
    schema = "id string, source_id string, source_name string, source_type string, license_status string, index_eligible boolean, page_number int, pdf_page_count int, book_tags array<string>, author string, text string"
    rows = [("1", "S", "Name", "a", "pd", True, 20, 30, ["Book"], "A", "prose " * 10), ("2", "S", "Name", "a", "pd", True, 3, 30, ["Book"], None, "Contents"), ("3", "H", "N", "conf", "review", False, 1, 1, [], None, "x"),
            ("4", "Z", "N", "a", "pd", True, 1, 1, ["Book"], None, "x"), ("5", "S", "N", "a", "pd", True, 9, 3, ["Book"], None, "x y"), ("6", "S", "N", "a", "pd", None, 1, 1, [], None, "x")]
    chunks, counts = build.document_pages(spark.createDataFrame(rows, schema), ["S"], {"source_type": "a", "license_status": "pd"}, "conf", "review")
    got = {r.id: r for r in chunks.collect()}
    assert "Author: A.\nBooks: Book.\nPage: 20 of 30.\n\nprose" in got["1"].text and got["1"].book == "Book" and got["1"].chunk_id == "S_1"
    assert {k: r.error for k, r in got.items()} == {"1": None, "4": "unapproved_source", "5": "bad_page_number", "6": "ineligible_kind"}
    assert {r.reason: r.n for r in counts.collect()} == {"contents": 1, "held": 1}


def test_articles(spark):
    schema = "id string, http_status int, title string, url string, permission_record string, passage string, passage_tags array<string>, book_tags array<string>, blocks array<struct<type:string,text:string>>, text string"
    blocks = [("heading", "H"), ("quote", "no"), ("p", "yes")]
    rows = [("a", 200, "T", "https://x.y/a", "ok", None, ["Book 2:1"], [], blocks, None), ("", None, "T", "https://x.y/b", "ok", "", None, ["Song Two"], None, "plain"), ("c", 500, "T", "https://x.y/c", "ok", "", [], [], None, "x"),
            ("d", 200, "T", "https://z/d", "ok", "", [], [], None, "x"), ("e", 200, "T", "https://x.y/e", None, "", [], [], None, "x"), ("f", 200, "T", "https://x.y/f", "ok", "", [], [], [], None)]
    got = build.articles(spark.createDataFrame(rows, schema), BOOKS, ["x.y"]).orderBy("canonical_url").collect()
    assert [r.error for r in got] == [None, None, "http_status", "no_permission", "incomplete", "unexpected_url"]
    assert got[0].text == "Article: T\n\nSection: H\n\nyes" and (got[0].book, got[0].chapter) == ("Book", 2)
    assert got[1].chunk_id.startswith("article_") and got[1].book == "Song Two"


def test_small_sources(spark):
    names = spark.createDataFrame([("BOO", "Book")], "code string, book string")
    notes = spark.createDataFrame([("BOO", 2, "1:2-3", "n1", "note\\nline", "q", ""), ("ZZZ", 3, "1:intro", "", "n", None, "s"), ("BOO", 4, "1:1", "x", " ", "q", "s")], "code string, row_no int, reference string, id string, note string, quote string, support string")
    got = {r.chunk_id: r for r in build.notes(notes, names).collect()}
    assert got["BOO_1_2_3_n1"].text == "Quoted expression: q\n\nnote\nline" and got["BOO_1_2_3_n1"].verse_end == 3
    assert got["ZZZ_1_intro_3"].book == "ZZZ" and got["ZZZ_1_intro_3"].chapter == 1 and len(got) == 2
    topic = build.topics(spark.createDataFrame([("/r/bible/kt/grace.md", "# Grace\n\n[x](y) *z*")], "file string, text string")).first()
    assert (topic.title, topic.text, topic.topic, topic.chunk_id) == ("Grace", "Grace\n\nx z", "bible/kt/grace", "kt_grace")
    lex = spark.createDataFrame([("G12", "d", 1, "<b>love</b>", ""), ("x", "d", 2, "", "")], "code string, dataset string, row_no int, gloss string, morph string")
    r = build.lexicon(lex, [("Code", "code"), ("Morphology", "morph"), ("Gloss", "gloss")]).collect()
    assert len(r) == 1 and r[0].title == "G12: love" and "Morphology" not in r[0].text
    books, full = F.create_map(F.lit("B"), F.lit("BOO")), F.create_map(F.lit("BOO"), F.lit("Book"))
    verses = spark.createDataFrame([("B.1.2", [("one", "l", None)]), ("B.1.3", [])], "id string, words array<struct<text:string,lemma:string,morph:string>>")
    w = build.word_analysis(verses, books, full).collect()
    assert len(w) == 1 and w[0].chunk_id == "BOO_001_002" and w[0].text.endswith("one | lemma=l | morphology=NA")
    assert build.held_source(lex, {"dataset": "d"}).count() == 0


def test_validation(spark):
    schema = "chunk_id string, source_id string, text string, index_eligible boolean, book string, chapter int, verse_start int, verse_end int, book_tags array<string>, source_page_id string, page_chunk_number int, page_chunk_count int, h string"
    rows = [("1", "S", "t", True, "Book", 1, 1, 2, [], "p", 1, 2, "a" * 64), ("1", "S", " ", True, "Book", 2, 4, None, [], None, None, None, "zz"), ("2", "X", "t" * 4000, None, None, None, None, None, ["book"], None, None, None, "b" * 64)]
    df = spark.createDataFrame(rows, schema)
    got = {r.check: r.violations for r in validation.report(df, spark.createDataFrame([("S",), ("T",)], "source_id string"), {"*": ["book"]}, ["X"], {"S": ["h"]}).collect()}
    assert got == {"missing_fields": 1, "empty_text": 1, "oversize": 1, "held_source_present": 1, "ineligible": 1, "bad_hash": 1, "duplicate_ids": 1, "missing_sources": 1, "unexpected_sources": 1, "page_sequence": 1}
    passages = spark.createDataFrame([("Book", 1, 1, 4)], "book string, chapter int, low int, high int")
    assert validation.passage_coverage(df, passages, ["S", "X"]).orderBy("source_id").collect()[0].missing == [3, 4]
    books = spark.createDataFrame([("Book", 3)], "book string, chapters int")
    assert validation.chapter_coverage(df, books, ["S"]).first().missing == [3]
    assert validation.crawl_problems({"status": "complete", "pending": 0, "accepted": 3}, 3) == []
    assert validation.crawl_problems({"status": "partial"}, 0) == ["status", "pending", "accepted", "page_count"]
    with pytest.raises(ValueError, match="duplicate_ids"):
        validation.require(validation.report(df, spark.createDataFrame([("S",)], "source_id string"), {}))


def test_answering(spark):
    q = spark.createDataFrame([(1, "RAG", "q?", "s", "p"), (2, "no-retrieval", "q?", "s", "p")], "question_id int, condition string, question string, scope string, passage string")
    c = spark.createDataFrame([(1, "[S1] x", ["a"]), (2, "[S1] y", ["b"])], "question_id int, context string, sources array<string>")
    got = {r.question_id: r for r in answering.answer_questions(q, c, lambda p: "Answer\n\nNote: SOURCE_CONTEXT citation").collect()}
    assert got[1].condition == "rag" and got[1].sources == ["a"] and "SOURCE CONTEXT:\n[S1] x" in got[1].prompt and got[1].answer == "Answer"
    assert got[2].condition == "baseline" and got[2].sources == [] and "SOURCE CONTEXT:\nNONE" in got[2].prompt
    with pytest.raises(Exception, match="unknown condition"):
        answering.with_context(q.withColumn("condition", F.lit("z")), c).collect()
    r = spark.createDataFrame([('{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}',), ("{}",)], "j string")
    assert [x[0] for x in r.select(answering.response_text(F.col("j"))).collect()] == ["ab", None]
