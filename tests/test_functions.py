import pytest
from pyspark.sql import functions as F

from quillmesh.functions import privacy, refs, text, urls, vectors
from quillmesh.plans import queries


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_text(spark):
    assert one(spark, text.normalise, "﻿ a  b\t\r\n\n\n\n c  ") == ["a b\n\nc"]
    assert one(spark, text.normalise_page, "a\n b\n\nc  d") == ["a b c d"]
    assert one(spark, text.normalise_crawled, "a ​b­  c") == ["a b c"]
    assert one(spark, text.normalise_lines, " a  b \n\n c") == ["a b\nc"]
    assert one(spark, text.safe_id, "--é a.b!", "", "___") == ["a_b", "NA", "NA"]
    assert one(spark, text.key, "1 Kings!", None) == ["1kings", ""]
    assert one(spark, text.plain_html, "<p>a<br/>b &amp; &lt;c&gt;</p>") == ["a\nb & <c>"]
    assert one(spark, text.strip_markers, r"\w word|x=1\w* \f + note\f* end\p", r"\zaln-s x\*a\zaln-e\*") == ["word end", "a"]
    assert one(spark, text.strip_markdown, "# T\n![i](u) [l](u) [[w]] **b** <!-- c -->") == ["T\ni l w b"]
    assert one(spark, lambda c: text.markdown_title(c, F.lit("f")), "x\n#  A b \ny", "none") == ["A b", "f"]
    assert [tuple(r) for r in one(spark, text.remove_quoted, 'a “b” c "d" ‘e’ “f')] == [("a c f", 3)]
    assert one(spark, text.split_tags, "a; b;;a ; c") == [["a", "b", "c"]]
    assert one(spark, text.lenient_int, "5", " 7 ", "5.0", "", None, "x") == [5, 7, None, None, None, None]
    assert [r[0] for r in one(spark, text.classify_licence, "x by-nc/4.0", "Attribution 4.0", "z")] == ["CC BY-NC 4.0", "CC BY 4.0", ""]
    assert one(spark, lambda c: text.detect_terms(c, {"NIV": ("niv",)}), "the NIV text", "university") == [["NIV"], []]
    assert one(spark, text.clean_answer, "Answer.\n\n(Note: the SOURCE_CONTEXT had x", "A\n\nNote: source_context citation\n\nB") == ["Answer.", "A"]
    assert one(spark, text.canonical_condition, " RAG-enhanced ", "LLM", "other") == ["rag", "baseline", None]
    assert one(spark, text.snippet, "word " * 200)[0].endswith(" …")
    assert one(spark, lambda c: text.retrieval_prefix(c, "nomic-embed-text:v1", "query"), "q") == ["search_query: q"]
    assert one(spark, text.is_sha256, "a" * 64, "A" * 64, None) == [True, False, False]
    assert one(spark, lambda c: text.document_template([("A", c), ("B", F.lit(""))], F.lit("t")), "1") == ["A: 1\nContent:\nt"]


def test_references(spark):
    got = [tuple(r) for r in one(spark, refs.parse_passage, "1 Book Two 3:4–6", "Book 1:2", "Book 1", "Book 1:2-3:4")]
    assert got == [("1 Book Two", 3, 4, 6), ("Book", 1, 2, 2), (None,) * 4, (None,) * 4]
    assert [tuple(r) for r in one(spark, refs.parse_note_reference, "1:2-5", "3:intro", "front")] == [(1, 2, 5), (3, None, None), (None,) * 3]
    books = F.create_map(F.lit("Bo"), F.lit("BOO"), F.lit("1Ot"), F.lit("1OT"))
    names = F.create_map(F.lit("BOO"), F.lit("Book"), F.lit("1OT"), F.lit("1 Other"))
    label = lambda c: refs.range_label(c, books, names)
    assert one(spark, label, "Bo.1.2", "Bo.1.2-Bo.1.4", "Bo.1.2-Bo.3.4", "Bo.1.2-1Ot.1.1") == ["Book 1:2", "Book 1:2–4", "Book 1:2–3:4", "Book 1:2–1 Other 1:1"]
    with pytest.raises(Exception, match="unsupported reference"):
        one(spark, label, "Zz.1.2")
    find = lambda c: refs.find_reference([c], ["Song of Songs", "Songs", "Book"])
    assert [tuple(r) for r in one(spark, find, "see song of songs 2:1-3.", "Book 3", "Book 1:2-2:5", "none")] == [
        ("Song of Songs", 2, 1, 3), ("Book", 3, None, None), ("Book", 1, 2, 2), (None,) * 4,
    ]
    assert one(spark, refs.topic_links, "rc://*/tw/dict/bible/kt/Grace x bible/names/abc/") == [["bible/kt/grace", "bible/names/abc"]]
    assert one(spark, refs.lexicon_codes, "g123 H04567a G12 xH123") == [["G123", "H04567A"]]
    assert one(spark, refs.bracketed_references, "T (1:2) (no) (3)") == ["1:2; 3"]
    row = spark.createDataFrame([("B", 1, 2, 3), ("B", 1, 2, 2), ("B", None, 2, 3), ("", 1, 1, 1)], "b string, c int, s int, e int")
    assert [r[0] for r in row.select(refs.format_reference(F.col("b"), F.col("c"), F.col("s"), F.col("e"))).collect()] == ["B 1:2-3", "B 1:2", "B", ""]


CHUNK = "source_id string, book string, chapter string, verse_start string, verse_end string, book_tags array<string>, passage_tags array<string>, title string, text string"
RECORDS = [
    ("S", "Book", None, None, None, [], [], "", ""), ("S", "book", "2", None, None, [], [], "", ""), ("S", "Book", "2", "3", None, [], [], "", ""),
    ("S", "Book", "2", "9", "12", [], [], "", ""), ("S", "Book", "3", "1", "1", ["BOOK"], [], "", ""), ("S", "Other", "2", "1", "1", [], ["bad", "Book 2:4-6"], "", ""),
    ("S", "Other", "1", None, None, [], [], "On Book 24", ""), ("T", "Book", None, None, None, [], [], "", ""), ("T", None, None, None, None, ["book"], None, None, None),
    ("S", "Book", "x", "3", "4", [], [], "", ""), ("S", "Book", "2", "3", "0", [], [], "", ""),
]


def test_passage_rules(spark):
    df = spark.createDataFrame(RECORDS, CHUNK)
    got = [r[0] for r in df.select(refs.matches_passage("Book", 2, 3, 5)).collect()]
    assert got == [True, True, True, False, True, True, True, True, True, True, False]
    got = [r[0] for r in df.select(refs.matches_development("Book", 2, 3, 5, "T")).collect()]
    assert got == [False, True, True, False, False, False, False, True, True, False, False]
    got = [r[0] for r in df.select(refs.matches_expected("Book", 2, 3, 5)).collect()]
    assert got == [True, True, True, False, False, False, False, True, True, True, True]
    books = df.select(refs.matched_books(["Other", "Book"])).collect()
    assert books[5][0] == ["Other", "Book"] and books[8][0] == ["Book"] and books[0][0] == ["Book"]


def test_urls(spark):
    assert one(spark, urls.normalise_url, "HTTPS://u:p@Ex.ORG:8080//a//b/?q=1#f", "http://x.y") == ["https://ex.org:8080/a/b", "http://x.y/"]
    allow = lambda c: urls.allowed(c, ["ex.org"], ["/a"])
    assert one(spark, allow, "https://ex.org/a/1", "http://ex.org/a", "https://ex.org/b", "https://u@ex.org/a", "::", None) == [True] + [False] * 5
    assert one(spark, urls.slug, "https://x.y/a/good-slug/", "https://x.y/A_b")[0] == "good-slug"
    assert [r.kind for r in one(spark, urls.page_kind, "https://x.y/chapter-3/", "https://x.y/introduction", "https://x.y/z")] == ["chapter", "introduction", "other"]
    assert one(spark, lambda c: urls.query_values(c, "book"), "/x?book=a%20b&c=1&book=d#e") == [["a b", "d"]]
    assert one(spark, lambda c: urls.choose_canonical(c, F.lit("https://x.y/f"), ["x.y"]), "https://x.y/C/", "https://evil.z/a", "") == ["https://x.y/C", "https://x.y/f", "https://x.y/f"]


def test_privacy(spark):
    values = ["a@b.cd", "see www.x", "call 123-45 67 89", "12 34 56", ":1234567", "é@ab", "hi @ab_c", "My full name is X", "contact me on", "clean", None]
    assert one(spark, privacy.identifier_kind, *values) == ["email", "web_address", "phone", None, None, None, "handle", "introduction", "introduction", None, None]
    errors = lambda c: privacy.multiselect_errors(c, ["a", "b", "no_preference", "other"], F.lit(""))
    assert one(spark, errors, "", "a,z", "a,no_preference", "other", "a,b") == [["empty"], ["unknown"], ["exclusive"], ["other_blank"], []]
    assert one(spark, privacy.permitted, "Granted by mail", "PENDING", "not yet approved", "written permission required!", None) == [True, False, False, False, False]
    error = lambda c: privacy.request_error(F.lit("send"), c, F.lit(True))
    assert one(spark, error, " ", "x" * 2001, "a@b.cd", "fine") == ["empty", "too_long", "identifying", None]


def test_identifiers_in_long_runs(spark):
    """Runs of many digits took a stack frame each, and the overflow ended the executor."""
    values = ["7" * 20000, "1 " * 20000, "7" * 20000 + "x", "+1-" * 20000 + "a", "a." * 20000 + "@", "." * 20000 + "@b.cd", "." * 20000 + "a@b.cd", "1 2 3 4 5 6 77x", "1 2 3 4 5 6 7 x"]
    assert one(spark, privacy.identifier_kind, *values) == ["phone", "phone", None, "phone", None, None, "email", None, "phone"]


def test_pii_queries_with_a_long_run_of_digits(spark, tmp_path):
    spark.createDataFrame([(1, "7" * 20000), (2, "clean")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("1 " * 20000,), (None,)], "text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, queries.pii_type(spark, str(tmp_path)).collect())) == [(1, "phone"), (2, None)]
    assert {tuple(r) for r in queries.pii_counts(spark, str(tmp_path)).collect()} == {("phone", 2), (None, 2)}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(vectors.is_valid(F.col("v"), 2)).collect()] == [True, False, False, False, False]
    assert df.limit(1).select(vectors.normalise(F.col("v"))).first()[0] == [0.6, 0.8]
