"""Registered queries of passage scopes, references, chunk builders, coverage, exports and single functions.

The driver's tables hold no chunks, so each query first lays out rows of the kind that the operator takes, with
expressions that mean the same to both engines (``CHUNK`` and the like); what is under test is the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import privacy, refs, text, urls
from quillmesh.functions import vectors as vec
from quillmesh.operators import answering, build, chunking, corpus, frontier, html, retrieval, selection, study, validation
from quillmesh.plans.queries import _n, query, table

#: Chunk columns over lineitem, in SQL that both engines read.
CHUNK = {
    "chunk_id": "concat(l_orderkey, '_', l_linenumber)",
    "source_id": "l_returnflag",
    "book": "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN 'Ruth' ELSE '1 Kings' END",
    "chapter": "CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_suppkey % 5 + 1 AS INT) END",
    "verse_start": "CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_quantity AS INT) END",
    "verse_end": "CASE WHEN l_linenumber IN (4, 5) THEN NULL ELSE CAST(CAST(l_quantity AS INT) + l_partkey % 4 AS INT) END",
    "title": "CASE WHEN l_linenumber = 1 AND l_suppkey % 10 = 0 THEN 'On ruth 2 again' ELSE 'Other' END",
    "text": "concat('Body of ', l_partkey)",
}
_CHUNKS = f"""chunks AS (SELECT l_linenumber, CAST(l_quantity AS INT) AS q, {", ".join(f"{e} AS {c}" for c, e in CHUNK.items())},
 CASE WHEN l_linenumber = 3 THEN ['RUTH'] ELSE [] END AS book_tags,
 CASE WHEN l_linenumber = 2 THEN ['Ruth 2:' || CAST(l_quantity AS INT) || '–' || (CAST(l_quantity AS INT) + 2)] ELSE [] END AS passage_tags FROM lineitem)"""


def chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        *[f"{e} AS {c}" for c, e in CHUNK.items()],
        "CASE WHEN l_linenumber = 3 THEN array('RUTH') ELSE cast(array() AS array<string>) END AS book_tags",
        "CASE WHEN l_linenumber = 2 THEN array(concat('Ruth 2:', int(l_quantity), '–', int(l_quantity) + 2)) ELSE cast(array() AS array<string>) END AS passage_tags",
    )


PASSAGE = ("Ruth", 2, 10, 20)
BOOKS = ["Ruth", "1 Kings", "Kings"]
_MET = "(verse_start <= 20 AND coalesce(verse_end, verse_start) >= 10)"


@query(f"""WITH {_CHUNKS} SELECT chunk_id,
 coalesce(book = 'Ruth' AND (chapter IS NULL OR (chapter = 2 AND (verse_start IS NULL OR {_MET}))), false) OR l_linenumber = 3
  OR (l_linenumber = 2 AND q <= 20 AND q + 2 >= 10) OR title LIKE '%ruth 2%' AS passage,
 coalesce(book = 'Ruth' AND CASE WHEN chapter IS NULL THEN source_id = 'A' ELSE chapter = 2 AND (verse_start IS NULL OR {_MET}) END, false)
  OR (source_id = 'A' AND l_linenumber = 3) AS development,
 coalesce((coalesce(book = 'Ruth', false) OR l_linenumber = 3) AND (chapter IS NULL OR (chapter = 2 AND (verse_start IS NULL OR {_MET}))), false) AS expected FROM chunks""")
def passage_scope(spark, sf_dir):
    """Which chunks may serve a passage, by the three rules."""
    return chunks(spark, sf_dir).select(
        "chunk_id", refs.matches_passage(*PASSAGE).alias("passage"), refs.matches_development(*PASSAGE, "A").alias("development"), refs.matches_expected(*PASSAGE).alias("expected")
    )


@query(f"""WITH {_CHUNKS} SELECT chunk_id, coalesce(source_id = 'A' AND chapter IS NULL AND book = 'Ruth', false) AS summary,
 coalesce(source_id = 'R' AND (book = 'Ruth' OR l_linenumber IN (2, 3)), false) AS of_ruth,
 concat_ws(',', CASE WHEN book = 'Ruth' OR l_linenumber IN (2, 3) THEN 'Ruth' END, CASE WHEN book = '1 Kings' THEN '1 Kings' END) AS books FROM chunks""")
def book_membership(spark, sf_dir):
    """Books that a chunk belongs to, by any of its marks; book summaries; rows of a source and book."""
    books = BOOKS[:2]
    return chunks(spark, sf_dir).select(
        "chunk_id", refs.is_book_summary("A", ["Ruth"]).alias("summary"), refs.of_source_and_book("R", "Ruth", books).alias("of_ruth"), F.array_join(refs.matched_books(books), ",").alias("books")
    )


_INDEX = """idx AS (SELECT vec_id::VARCHAR AS chunk_id, label::VARCHAR AS source_id, CASE WHEN label % 2 = 0 THEN 'Ruth' ELSE '1 Kings' END AS book,
 CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 4 END AS chapter, vec_id % 30 + 1 AS verse_start, d.text, embedding
 FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id),
scoped AS (SELECT i.*, list_cosine_similarity(i.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM idx i
 WHERE (book = 'Ruth' AND (chapter IS NULL OR (chapter = 2 AND verse_start BETWEEN 5 AND 25))) OR contains(lower('Chunk' || chr(10) || coalesce(text, '')), 'ruth 2')),
capped AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, chunk_id) AS n FROM scoped),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id)::INTEGER AS rank,
 book || coalesce(' ' || chapter || ':' || verse_start, '') AS reference FROM capped WHERE n <= 1)"""


def _retrieved(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    empty = F.array().cast("array<string>")
    index = vectors.join(texts, "vec_id", "left").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("source_id"), F.lit(None).cast("string").alias("source_name"),
        F.when(F.col("label") % 2 == 0, "Ruth").otherwise("1 Kings").alias("book"), F.when(F.col("vec_id") % 4 != 0, F.col("vec_id") % 4).alias("chapter"),
        (F.col("vec_id") % 30 + 1).alias("verse_start"), F.lit(None).cast("long").alias("verse_end"), empty.alias("book_tags"), empty.alias("passage_tags"),
        F.lit("Chunk").alias("title"), "text", F.lit("").alias("canonical_url"), F.lit("https://example.org").alias("url"), F.lit("free").alias("license"), "embedding",
    )
    question = list(vectors.filter("vec_id = 0").first()["embedding"])
    return retrieval.retrieve(index, ("Ruth", 2, 5, 25), question, 3)


@query(f"WITH {_INDEX} SELECT rank, chunk_id, source_id, source_id AS source_name, round(score, 6) AS score, reference, 'https://example.org' AS url FROM ranked WHERE rank <= 3")
def passage_retrieval(spark, sf_dir):
    """A question about a passage: scope, scores, at most one chunk of a source, three in all."""
    return _retrieved(spark, sf_dir).select("rank", "chunk_id", "source_id", "source_name", F.round("score", 6).alias("score"), "reference", "url")


@query(f"""WITH {_INDEX}, sized AS (SELECT *, coalesce(sum(least(length(coalesce(text, '')), 4000)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ranked WHERE rank <= 3)
SELECT string_agg('[S' || rank || ']' || chr(10) || 'Title: Chunk' || chr(10) || 'Source: ' || source_id || chr(10) || 'Biblical reference: ' || reference || chr(10) || 'URL: https://example.org' || chr(10)
 || 'Content:' || chr(10) || substr(coalesce(text, ''), 1, least(4000, 15000 - used)::BIGINT), chr(10) || chr(10) ORDER BY rank) AS context FROM sized WHERE used < 15000""")
def evidence_context(spark, sf_dir):
    return retrieval.evidence(_retrieved(spark, sf_dir))


_REPLIES = """t AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u
 LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1 AND a.role = 'assistant' WHERE u.role = 'user'),
blocks AS (SELECT *, 'PASSAGE REFERENCE:' || chr(10) || 'Ruth ' || turn || chr(10) || chr(10) || 'PASSAGE TEXT:' || chr(10) || 'In those days.' || chr(10) || chr(10)
 || 'SOURCE CONTEXT:' || chr(10) || 'NONE' || chr(10) || chr(10) || 'USER QUESTION:' || chr(10) || question || chr(10) AS block FROM t)"""


@query(f"""WITH {_REPLIES} SELECT conv_id, turn, md5(block) AS block, md5(to_json({{'systemInstruction': {{'parts': [{{'text': 'Be brief.'}}]}},
 'contents': list_concat(CASE WHEN trim(coalesce(answer, '')) <> '' THEN [{{'role': 'model', 'parts': [{{'text': trim(answer)}}]}}] ELSE [] END, [{{'role': 'user', 'parts': [{{'text': block}}]}}]),
 'generationConfig': {{'maxOutputTokens': 700, 'thinkingConfig': {{'thinkingLevel': 'minimal'}}}}}})::VARCHAR) AS request FROM blocks""")
def generation_requests(spark, sf_dir):
    """The body of each user turn's generation call, with the reply before it as history."""
    c = table(spark, sf_dir, "conversations")
    before = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("answer"))
    turns = c.filter("role = 'user'").join(before, ["conv_id", "turn"], "left")
    block = answering.prompt(F.col("text"), F.concat(F.lit("Ruth "), F.col("turn")), F.lit("In those days."), F.lit("NONE"))
    history = F.array(F.struct(F.lit("model").alias("role"), F.coalesce("answer", F.lit("")).alias("text")))
    return turns.select("conv_id", "turn", F.md5(block).alias("block"), F.md5(answering.request("Be brief.", history, block)).alias("request"))


# ---- references

_REF = """CASE l_linenumber % 5 WHEN 0 THEN concat('Ruth ', l_suppkey % 5, ':', l_partkey % 20, '–', l_partkey % 20 + 2) WHEN 1 THEN concat(' 1 Kings ', l_suppkey % 5, ':', l_partkey % 20)
 WHEN 2 THEN 'see Ruth 2' WHEN 3 THEN concat('Song of Songs 4:1—', l_partkey % 7 + 1) ELSE 'nothing' END"""
_PARSED = r"'^((?:[1-3]\s+)?[A-Za-z]+(?:\s+[A-Za-z]+)*)\s+([0-9]+):([0-9]+)(?:-([0-9]+))?$'"


@query(f"""WITH r AS (SELECT concat(l_orderkey, '_', l_linenumber) AS id, trim(replace(replace({_REF}, '–', '-'), '—', '-')) AS r FROM lineitem)
SELECT id, nullif(regexp_extract(r, {_PARSED}, 1), '') AS book, try_cast(nullif(regexp_extract(r, {_PARSED}, 2), '') AS INTEGER) AS chapter, try_cast(nullif(regexp_extract(r, {_PARSED}, 3), '') AS INTEGER) AS verse_start,
 try_cast(coalesce(nullif(regexp_extract(r, {_PARSED}, 4), ''), nullif(regexp_extract(r, {_PARSED}, 3), '')) AS INTEGER) AS verse_end FROM r""")
def reference_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.expr("concat(l_orderkey, '_', l_linenumber)").alias("id"), refs.parse_passage(F.expr(_REF)).alias("r"))
    return rows.select("id", "r.*")


_NOTE_REF = "CASE l_linenumber % 4 WHEN 0 THEN concat(l_suppkey % 5 + 1, ':', l_partkey % 20) WHEN 1 THEN concat(l_suppkey % 5 + 1, ':', l_partkey % 20, '-', l_partkey % 3) WHEN 2 THEN concat(l_suppkey % 5 + 1, ':INTRO') ELSE 'front:intro' END"


@query(f"""WITH r AS (SELECT concat(l_orderkey, '_', l_linenumber) AS id, {_NOTE_REF} AS r FROM lineitem), p AS (SELECT *, regexp_matches(r, '^[0-9]+:[0-9]') AS typed FROM r)
SELECT id, try_cast(nullif(regexp_extract(r, '^([0-9]+):', 1), '') AS INTEGER) AS chapter, CASE WHEN typed THEN regexp_extract(r, ':([0-9]+)', 1)::INTEGER END AS verse_start,
 CASE WHEN typed THEN coalesce(nullif(try_cast(nullif(regexp_extract(r, '-([0-9]+)$', 1), '') AS INTEGER), 0), regexp_extract(r, ':([0-9]+)', 1)::INTEGER) END AS verse_end FROM p""")
def note_reference_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.expr("concat(l_orderkey, '_', l_linenumber)").alias("id"), refs.parse_note_reference(F.expr(_NOTE_REF)).alias("r"))
    return rows.select("id", "r.*")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Ruth ' || (o_custkey % 4 + 1) || ':3' WHEN 1 THEN 'Ruth ' || (o_custkey % 4 + 1) || ':3–7'
 WHEN 2 THEN 'Ruth ' || (o_custkey % 4 + 1) || ':3–9:7' ELSE 'Ruth ' || (o_custkey % 4 + 1) || ':3–1 Kings 9:7' END AS label FROM orders""")
def range_labels(spark, sf_dir):
    books = F.create_map(F.lit("Rut"), F.lit("RUT"), F.lit("1Kgs"), F.lit("1KI"))
    names = F.create_map(F.lit("RUT"), F.lit("Ruth"), F.lit("1KI"), F.lit("1 Kings"))
    dotted = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN concat('Rut.', o_custkey % 4 + 1, '.3') WHEN 1 THEN concat('Rut.', o_custkey % 4 + 1, '.3-Rut.', o_custkey % 4 + 1, '.7')
     WHEN 2 THEN concat('Rut.', o_custkey % 4 + 1, '.3-Rut.9.7') ELSE concat('Rut.', o_custkey % 4 + 1, '.3-1Kgs.9.7') END""")
    return table(spark, sf_dir, "orders").select("o_orderkey", refs.range_label(dotted, books, names).alias("label"))


_FREE = r"'(?i)\b(1 Kings|Kings|Ruth)\s+([0-9]+)(?::([0-9]+)(?:\s*[-–—]\s*(?:([0-9]+):)?([0-9]+))?)?'"
_FREE_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN concat('as in RUTH ', o_custkey % 4 + 1, ':2 - 6 there') WHEN 1 THEN concat('1 kings ', o_custkey % 9, ':4—5:6') WHEN 2 THEN concat('on ruth ', o_custkey % 4)
 WHEN 3 THEN concat('truth 3:4 and Kings 7:', o_custkey % 8) ELSE 'none here' END"""


@query(f"""WITH f AS (SELECT o_orderkey, {_FREE_TEXT} AS t FROM orders), p AS (SELECT o_orderkey, lower(regexp_extract(t, {_FREE}, 1)) AS b, regexp_extract(t, {_FREE}, 2) AS c, regexp_extract(t, {_FREE}, 3) AS v, regexp_extract(t, {_FREE}, 4) AS c2, regexp_extract(t, {_FREE}, 5) AS w FROM f)
SELECT o_orderkey, CASE b WHEN 'ruth' THEN 'Ruth' WHEN 'kings' THEN 'Kings' WHEN '1 kings' THEN '1 Kings' END AS book, try_cast(nullif(c, '') AS INTEGER) AS chapter, try_cast(nullif(v, '') AS INTEGER) AS verse_start,
 CASE WHEN v <> '' AND (c2 = '' OR c2 = c) THEN try_cast(coalesce(nullif(w, ''), v) AS INTEGER) ELSE try_cast(nullif(v, '') AS INTEGER) END AS verse_end FROM p""")
def reference_scan(spark, sf_dir):
    """The first reference in free text, the longest book name first."""
    found = refs.find_reference([F.lit(None).cast("string"), F.expr(_FREE_TEXT)], BOOKS)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("r")).select("o_orderkey", "r.*")


_LINKED = "concat('See [[rc://*/tw/dict/bible/kt/', replace(p_name, ' ', '-'), ']] and Bible/Names/Ruth (', p_size, ':3; ', p_name, ') or (none), code g', p_size + 1000, 'A.')"


@query(f"""WITH t AS (SELECT p_partkey, p_size, p_name, {_LINKED} AS t FROM part) SELECT p_partkey, 'bible/kt/' || replace(p_name, ' ', '-') || ',bible/names/ruth' AS topics, 'G' || (p_size + 1000) || 'A' AS codes,
 p_size || ':3; ' || p_name AS bracketed FROM t""")
def topic_links_and_codes(spark, sf_dir):
    t = F.expr(_LINKED)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(refs.topic_links(t), ",").alias("topics"), F.array_join(refs.lexicon_codes(t), ",").alias("codes"), refs.bracketed_references(t).alias("bracketed")
    )


@query(f"""WITH {_CHUNKS} SELECT chunk_id, coalesce(book || coalesce(' ' || chapter || coalesce(':' || verse_start || CASE WHEN verse_end <> verse_start THEN '-' || verse_end ELSE '' END, CASE WHEN verse_start IS NOT NULL THEN ':' || verse_start ELSE '' END), ''), '') AS label FROM chunks""")
def reference_labels(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", refs.format_reference(F.col("book"), F.col("chapter"), F.col("verse_start"), F.col("verse_end")).alias("label"))


# ---- builders


@query("""WITH r AS (SELECT *, 'b' || p_size % 3 AS code, (p_size || ':' || p_partkey % 30) AS reference, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE 'n' || p_partkey END AS note_id FROM part WHERE p_partkey % 7 <> 0)
SELECT code || '_' || replace(reference, ':', '_') || '_' || note_id AS chunk_id, CASE code WHEN 'b0' THEN 'Ruth' WHEN 'b1' THEN '1 Kings' ELSE 'b2' END AS book, p_size AS chapter, (p_partkey % 30)::INTEGER AS verse_start,
 concat_ws(chr(10) || chr(10), CASE WHEN p_partkey % 2 = 0 THEN 'Quoted expression: ' || p_type END, 'Supporting topic: ' || p_brand, p_name || chr(10) || 'more') AS text FROM r""")
def note_chunks(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.concat(F.lit("b"), F.col("p_size") % 3).alias("code"), F.col("p_partkey").alias("row_no"), F.concat_ws(":", "p_size", F.col("p_partkey") % 30).alias("reference"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("n"), "p_partkey")).alias("id"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.concat("p_name", F.lit("\\nmore"))).alias("note"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(" ").alias("quote"), F.col("p_brand").alias("support"),
    )
    names = spark.createDataFrame([("b0", "Ruth"), ("b1", "1 Kings")], "code string, book string")
    return build.notes(rows, names).select("chunk_id", "book", "chapter", "verse_start", "text")


@query("""SELECT 'topic_' || replace(p_name, ' ', '_') || '_' || p_partkey AS chunk_id, p_name AS title, 'topic' AS category,
 p_name || chr(10) || 'See it and ' || p_brand || ', bold and code.' || chr(10) || 'end' AS text FROM part""")
def topic_chunks(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(
        F.concat(F.lit("/x/bible/topic/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey"), F.lit(".md")).alias("file"),
        F.concat(F.lit("# "), "p_name", F.lit("\n<!-- gone\n-->See ![it](a.png) and [["), "p_brand", F.lit("]], **[bold](u)** and `code`.\n> end")).alias("text"),
    )
    return build.topics(files).select("chunk_id", "title", "category", "text")


@query("""SELECT 'lex_' || c_custkey || '_G' || (c_custkey % 900 + 100) AS chunk_id, 'G' || (c_custkey % 900 + 100) || ': ' || c_mktsegment || ' & co' AS title,
 concat_ws(chr(10), 'Word: ' || c_name, CASE WHEN c_custkey % 4 <> 0 THEN 'Gloss: <b>' || c_mktsegment || '</b> &amp; co' END) AS text FROM customer WHERE c_custkey % 5 <> 0""")
def lexicon_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.lit("lex").alias("dataset"), F.col("c_custkey").alias("row_no"), F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.concat(F.lit("G"), F.col("c_custkey") % 900 + 100)).alias("code"),
        F.concat(F.lit("<b>"), "c_mktsegment", F.lit("</b> &amp; co")).alias("gloss"), F.col("c_name").alias("word"),
    ).withColumn("shown", F.when(F.col("row_no") % 4 != 0, F.col("gloss")))
    return build.lexicon(rows, [("Word", "word"), ("Gloss", "shown")]).select("chunk_id", "title", "text")


@query("""SELECT 'RUT_' || lpad((l_orderkey % 4 + 1)::VARCHAR, 3, '0') || '_' || lpad((l_orderkey % 150 + 1)::VARCHAR, 3, '0') || '_' || l_orderkey AS chunk_id,
 'Text: ' || string_agg('w' || l_partkey, ' ' ORDER BY l_linenumber, 'w' || l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'H' || l_suppkey END, l_returnflag) || chr(10) || 'Word-level lemma and morphology:' || chr(10)
 || string_agg('w' || l_partkey || ' | lemma=' || CASE WHEN l_suppkey % 3 = 0 THEN 'NA' ELSE 'H' || l_suppkey END || ' | morphology=' || l_returnflag, chr(10) ORDER BY l_linenumber, 'w' || l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'H' || l_suppkey END, l_returnflag) AS text FROM lineitem GROUP BY l_orderkey""")
def word_analysis_chunks(spark, sf_dir):
    word = F.struct("l_linenumber", F.concat(F.lit("w"), "l_partkey").alias("text"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("H"), "l_suppkey")).alias("lemma"), F.col("l_returnflag").alias("morph"))
    words = F.transform(F.array_sort(F.collect_list(word)), lambda w: F.struct(w["text"].alias("text"), w["lemma"].alias("lemma"), w["morph"].alias("morph")))
    verses = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(words.alias("words"))
    verses = verses.withColumn("id", F.concat(F.lit("Rut."), F.col("l_orderkey") % 4 + 1, F.lit("."), F.col("l_orderkey") % 150 + 1))
    out = build.word_analysis(verses, F.create_map(F.lit("Rut"), F.lit("RUT")), F.create_map(F.lit("RUT"), F.lit("Ruth")))
    return out.select(F.concat_ws("_", "chunk_id", "l_orderkey").alias("chunk_id"), "text")


_EDGES = "e AS (SELECT 'Ruth' AS book, (l_suppkey % 4 + 1)::INTEGER AS chapter, (l_orderkey % 20 + 1)::INTEGER AS verse, 'P ' || l_partkey || '.' || l_orderkey || '.' || l_linenumber AS label, l_quantity::INTEGER AS votes FROM lineitem)"


@query(f"""WITH {_EDGES} SELECT chapter, verse, md5('Verse ' || chapter || ':' || verse || chr(10) || chr(10) || 'Related: ' || string_agg(label, '; ' ORDER BY votes DESC, label)) AS text, count(*) AS n, max(votes) AS highest FROM e WHERE verse <= 15 GROUP BY chapter, verse""")
def cross_reference_chunks(spark, sf_dir):
    found, _ = _cross_references(spark, sf_dir)
    return found.select("chapter", "verse", F.md5("text").alias("text"), "n", "highest")


@query(f"WITH {_EDGES} SELECT DISTINCT chapter, verse FROM e WHERE verse > 15")
def cross_references_unmatched(spark, sf_dir):
    _, unmatched = _cross_references(spark, sf_dir)
    return unmatched.select("chapter", "verse")


def _cross_references(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").selectExpr(
        "'Ruth' AS book", "int(l_suppkey % 4 + 1) AS chapter", "int(l_orderkey % 20 + 1) AS verse", "concat('P ', l_partkey, '.', l_orderkey, '.', l_linenumber) AS label", "int(l_quantity) AS votes"
    )
    grid = spark.range(4).selectExpr("int(id + 1) AS chapter", "explode(sequence(1, 15)) AS verse")
    verses = grid.selectExpr("'Ruth' AS book", "chapter", "verse", "concat('Verse ', chapter, ':', verse) AS text")
    return corpus.cross_reference_chunks(edges, verses, F.col("label"))


@query("""WITH b AS (SELECT conv_id, turn, role, sum((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn) > 0 AS headed FROM conversations)
SELECT 'page' || conv_id AS chunk_id, CASE WHEN conv_id % 3 = 0 THEN 'Ruth' END AS book, CASE WHEN conv_id % 3 = 0 THEN 2 END AS chapter,
 'Commentary page: Talk ' || conv_id || CASE WHEN conv_id % 3 = 0 THEN chr(10) || 'Passage: Ruth 2:3' || chr(10) || 'Book: Ruth' ELSE '' END || chr(10) || chr(10)
 || string_agg(CASE WHEN headed THEN 'Section: Start' || chr(10) ELSE '' END || 'Turn ' || turn || ' of ' || role, chr(10) || chr(10) ORDER BY turn) FILTER (role <> 'system') AS text
FROM b GROUP BY conv_id""")
def commentary_chunks(spark, sf_dir):
    """Pages of blocks to chunks; here each turn is a block and system turns are headings."""
    kind = F.when(F.col("role") == "system", "heading").otherwise("paragraph")
    block = F.struct("turn", kind.alias("type"), F.when(F.col("role") == "system", "Start").otherwise(F.concat(F.lit("Turn "), "turn", F.lit(" of "), "role")).alias("text"))
    blocks = F.transform(F.array_sort(F.collect_list(block)), lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text")))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(blocks.alias("blocks"))
    pages = pages.select(
        F.concat(F.lit("page"), "conv_id").alias("id"), F.concat(F.lit("https://example.org/"), "conv_id").alias("canonical_url"), F.concat(F.lit("Talk "), "conv_id").alias("title"),
        F.when(F.col("conv_id") % 3 == 0, "Ruth 2:3").otherwise("").alias("passage"), F.array().cast("array<string>").alias("passage_tags"), F.array().cast("array<string>").alias("book_tags"),
        F.lit("CC BY 4.0").alias("license"), F.lit("article").alias("content_type"), "blocks",
    )
    return build.require_clean(build.commentary(pages, ["Ruth"], "CC BY 4.0", "article")).select("chunk_id", "book", "chapter", "text")


@query("""WITH a AS (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN 404 ELSE 200 END AS http_status, CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE c_name END AS title,
 CASE WHEN c_custkey % 17 = 0 THEN 'https://other.org/' ELSE 'https://example.org/' END || c_custkey AS url, CASE WHEN c_custkey % 19 = 0 THEN '' ELSE 'letter of May' END AS permission FROM customer)
SELECT 'art' || c_custkey AS chunk_id, CASE WHEN http_status <> 200 THEN 'http_status' WHEN trim(title) = '' THEN 'incomplete' WHEN url LIKE '%other%' THEN 'unexpected_url' WHEN permission = '' THEN 'no_permission' END AS error,
 CASE WHEN title = ' ' THEN 'Article:' ELSE 'Article: ' || title END || chr(10) || chr(10) || 'Section: ' || c_mktsegment || chr(10) || chr(10) || 'Body' AS text FROM a""")
def article_chunks(spark, sf_dir):
    key = F.col("c_custkey")
    block = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("text"))
    pages = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("art"), key).alias("id"), F.when(key % 11 == 0, 404).otherwise(200).alias("http_status"), F.when(key % 13 == 0, " ").otherwise(F.col("c_name")).alias("title"),
        F.concat(F.when(key % 17 == 0, "https://other.org/").otherwise("https://example.org/"), key).alias("url"), F.when(key % 19 == 0, "").otherwise("letter of May").alias("permission_record"),
        F.array(block("heading", F.col("c_mktsegment")), block("quote", F.lit("gone")), block("paragraph", F.lit(" Body "))).alias("blocks"),
        F.lit("").alias("text"), F.lit(None).cast("string").alias("passage"), F.array().cast("array<string>").alias("passage_tags"), F.array().cast("array<string>").alias("book_tags"),
    )
    return build.articles(pages, ["Ruth"], ["example.org"]).select("chunk_id", "error", "text")


# ---- coverage, reports, state


@query(f"""WITH {_CHUNKS}, w AS (SELECT * FROM (VALUES ('Ruth', 2, 10, 20), ('1 Kings', 3, 45, 60)) w(book, chapter, low, high)),
seen AS (SELECT DISTINCT w.book, w.chapter, source_id, unnest(range(greatest(verse_start, low), least(coalesce(verse_end, verse_start), high) + 1)) AS v FROM chunks c JOIN w ON c.book = w.book AND c.chapter = w.chapter
 WHERE verse_start <= high AND coalesce(verse_end, verse_start) >= low)
SELECT book, chapter, s AS source_id, (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM unnest(range(low, high + 1)) r(v) WHERE v NOT IN (SELECT v FROM seen x WHERE x.book = w.book AND x.source_id = s)) AS missing
FROM w, unnest(['A', 'N', 'none']) t(s)""")
def passage_coverage(spark, sf_dir):
    windows = spark.createDataFrame([("Ruth", 2, 10, 20), ("1 Kings", 3, 45, 60)], "book string, chapter int, low int, high int")
    out = validation.passage_coverage(chunks(spark, sf_dir), windows, ["A", "N", "none"])
    return out.select("book", "chapter", "source_id", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query(f"""WITH {_CHUNKS}, seen AS (SELECT DISTINCT source_id, b, chapter FROM (SELECT source_id, book AS b, chapter FROM chunks UNION ALL SELECT source_id, 'Ruth', chapter FROM chunks WHERE l_linenumber = 3) WHERE chapter >= 1)
SELECT s AS source_id, book, (SELECT coalesce(string_agg(c, ',' ORDER BY c), '') FROM unnest(range(1, chapters + 1)) r(c) WHERE c NOT IN (SELECT chapter FROM seen x WHERE x.source_id = s AND x.b = book)) AS missing
FROM (VALUES ('Ruth', 4), ('1 Kings', 7)) b(book, chapters), unnest(['A', 'none']) t(s)""")
def chapter_coverage(spark, sf_dir):
    books = spark.createDataFrame([("Ruth", 4), ("1 Kings", 7)], "book string, chapters int")
    out = validation.chapter_coverage(chunks(spark, sf_dir), books, ["A", "none"])
    return out.select("source_id", "book", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query(f"""WITH {_CHUNKS} SELECT p AS passage, source_id, count(*) AS n FROM chunks c JOIN (VALUES ('x', 'Ruth', 2, 10, 20), ('y', '1 Kings', 3, 45, 60)) w(p, book, chapter, low, high)
 ON c.book = w.book AND c.chapter = w.chapter WHERE verse_start <= high AND coalesce(verse_end, verse_start) >= low GROUP BY ALL""")
def passage_source_counts(spark, sf_dir):
    windows = spark.createDataFrame([("x", "Ruth", 2, 10, 20), ("y", "1 Kings", 3, 45, 60)], "passage string, book string, chapter int, low int, high int")
    return selection.counts_by_window(chunks(spark, sf_dir), windows, ["book", "chapter"], "verse_start", "verse_end", "low", "high", "passage", "source_id")


@query(f"""WITH {_CHUNKS}, c AS (SELECT *, CASE WHEN source_id = 'R' AND l_linenumber % 2 = 0 THEN 'CC BY 4.0' ELSE 'CC BY-NC 4.0' END AS license, 'https://example.org/' || l_linenumber AS url, l_linenumber <> 6 AS eligible FROM chunks)
SELECT 'empty_text' AS "check", 0 AS violations UNION ALL SELECT 'oversize', count_if(length(text) > 12)::BIGINT FROM c UNION ALL SELECT 'missing_fields', count_if(book IS NULL OR (source_id = 'A' AND chapter IS NULL))::BIGINT FROM c
UNION ALL SELECT 'metadata:A', count_if(source_id = 'A' AND chapter IS NULL)::BIGINT FROM c UNION ALL SELECT 'licence:R', count_if(source_id = 'R' AND license <> 'CC BY-NC 4.0')::BIGINT FROM c
UNION ALL SELECT 'url:N', count_if(source_id = 'N' AND url NOT LIKE 'https://example.org/1%')::BIGINT FROM c UNION ALL SELECT 'book_tags:N', count_if(source_id = 'N' AND l_linenumber <> 3)::BIGINT FROM c
UNION ALL SELECT 'policy:A', count_if(source_id = 'A' AND title <> 'Other')::BIGINT FROM c UNION ALL SELECT 'held_source_present', count_if(source_id = 'N')::BIGINT FROM c UNION ALL SELECT 'ineligible', count_if(NOT eligible)::BIGINT FROM c
UNION ALL SELECT 'bad_hash', count_if(source_id = 'A')::BIGINT FROM c UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT chunk_id FROM c GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing_sources', 1 UNION ALL SELECT 'unexpected_sources', 1""")
def corpus_report(spark, sf_dir):
    """The report of a chunk table with rules of each kind."""
    rows = chunks(spark, sf_dir).withColumns({
        "license": F.expr("CASE WHEN source_id = 'R' AND element_at(split(chunk_id, '_'), 2) % 2 = 0 THEN 'CC BY 4.0' ELSE 'CC BY-NC 4.0' END"),
        "canonical_url": F.expr("concat('https://example.org/', element_at(split(chunk_id, '_'), 2))"), "index_eligible": F.expr("element_at(split(chunk_id, '_'), 2) <> 6"),
    })
    expected = spark.createDataFrame([("A",), ("N",), ("Q",)], "source_id string")
    out = validation.report(
        rows, expected, {"*": ["book"], "A": ["chapter"]}, held=["N"], hashes={"A": ["text"]}, limit=12, licences={"R": "CC BY-NC 4.0"},
        url_prefixes={"N": "https://example.org/1"}, tagged=["N"], policy={"A": {"title": "Other"}},
    )
    return out.select("check", "violations")


@query("""SELECT count(*) AS candidates, count_if(page_id % 3 = 0)::BIGINT AS accepted, count_if(page_id % 3 = 1 AND page_id % 2 = 0)::BIGINT AS terminal, count_if(page_id % 3 = 1 AND page_id % 2 = 1)::BIGINT AS transient,
 (count(*) - count_if(page_id % 3 = 0) - count_if(page_id % 3 = 1 AND page_id % 2 = 0))::BIGINT AS pending, 'partial' AS status FROM pages""")
def crawl_summary(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("url"), F.lit(False).alias("has_children"))
    old, new = pages.filter("page_id % 3 = 0 AND page_id % 2 = 0"), pages.filter("page_id % 3 = 0 AND page_id % 2 = 1")
    bad = pages.filter("page_id % 3 = 1").withColumn("terminal", F.col("page_id") % 2 == 0)
    once = pages.filter("page_id % 3 = 0").withColumn("terminal", F.lit(False))  # rejected before, accepted now
    good, rejected = frontier.advance((old.select("url"), once.select("url", "terminal")), new.select("url"), bad.select("url", "terminal"))
    return frontier.summary(pages, good, rejected).select("candidates", "accepted", "terminal", "transient", "pending", "status")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT c_custkey + 1000000, 'added' FROM customer WHERE c_custkey % 5 = 0""")
def upsert_rows(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changed = old.filter("c_custkey % 5 = 0").select("c_custkey", F.lit("new").alias("segment"))
    added = changed.select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("added").alias("segment"))
    return corpus.last_wins(old, corpus.union_all([changed, added]), ["c_custkey"])


@query("""SELECT s_suppkey::VARCHAR AS source_id FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0""")
def manifest_hash_mismatches(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), F.sha2("s_name", 256).alias("file_sha256"), "s_suppkey")
    manifest = own.filter("s_suppkey % 7 <> 0").select("source_id", F.when(F.col("s_suppkey") % 5 == 0, "other").otherwise(F.upper("file_sha256")).alias("file_hash"))
    return validation.hash_mismatches(own, manifest).select("source_id")


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'Ruth 2:' || turn || CASE WHEN turn > 4 THEN '–9' ELSE '' END ELSE text END AS t FROM conversations),
m AS (SELECT *, regexp_matches(trim(t), '^(?:[1-3]\\s*)?[A-Za-z]+(?:\\s+[A-Za-z]+)?\\s+[0-9]+:[0-9]+(?:\\s*[-–]\\s*[0-9]+)?$') AS r FROM p),
w AS (SELECT *, length(t) >= 80 AND coalesce(lead(r) OVER o, false) AS quoted, r AND coalesce(lag(length(t)) OVER o >= 80, false) AS cited FROM m WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn FROM w WHERE NOT quoted AND NOT cited""")
def quoted_paragraph_removal(spark, sf_dir):
    """Long paragraphs that the next one names as scripture go with it."""
    reference = F.concat(F.lit("Ruth 2:"), F.col("turn"), F.when(F.col("turn") > 4, "–9").otherwise(""))
    blocks = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"), F.lit("paragraph").alias("type"), F.when(F.col("turn") % 3 == 2, reference).otherwise(F.col("text")).alias("text")
    )
    return html.without_quoted_paragraphs(blocks).select(F.col("page_id").alias("conv_id"), F.col("pos").alias("turn"))


# ---- exports

_PLAYER = """SELECT c_custkey, concat('r', c_custkey) AS response_code, c_custkey % 8 + 1 AS sequence_id, c_acctbal > 0 AS completed_study, c_mktsegment, c_nationkey FROM customer"""


def _people(spark, sf_dir):
    """Participants and their players; names and other identity columns are there and must not come out."""
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS participant_id", "concat('r', c_custkey) AS response_code", "c_custkey % 8 + 1 AS sequence_id", "c_acctbal > 0 AS completed_study", "c_mktsegment", "c_nationkey", "c_name AS label"
    )
    participants = rows.select("participant_id", "response_code", "sequence_id", "completed_study", F.col("c_mktsegment").alias("passage_block"), "label")
    return participants, rows.select("participant_id", F.col("participant_id").alias("player_id"), "c_nationkey", "c_mktsegment")


@query(f"WITH p AS ({_PLAYER}) SELECT response_code, sequence_id, c_mktsegment AS passage_block, c_nationkey AS age_group, NULL::VARCHAR AS english_level FROM p WHERE completed_study")
def study_background(spark, sf_dir):
    participants, players = _people(spark, sf_dir)
    players = players.select("participant_id", "player_id", F.col("c_nationkey").alias("age_group"))
    return study.background(players, participants).select("response_code", "sequence_id", "passage_block", "age_group", "english_level")


@query(f"""WITH p AS ({_PLAYER}) SELECT response_code, o_orderkey AS turn_index, o_orderstatus AS status, o_orderpriority AS question, 'chat' AS chat_model, 3 AS rag_top_k FROM p JOIN orders ON o_custkey = c_custkey WHERE completed_study""")
def study_chat_turns(spark, sf_dir):
    participants, players = _people(spark, sf_dir)
    turns = table(spark, sf_dir, "orders").selectExpr("o_custkey AS player_id", "o_orderkey AS turn_index", "o_orderstatus AS status", "o_orderpriority AS question")
    out = study.chat_turns(players, participants, turns, {"chat_model": "chat", "embedding_model": "embed", "rag_top_k": 3})
    return out.select("response_code", "turn_index", "status", "question", "chat_model", "rag_top_k")


@query(f"""WITH p AS ({_PLAYER}) SELECT response_code, r AS round_number, CASE WHEN r = 1 THEN c_mktsegment END AS use01, NULL::VARCHAR AS int02, 'pref ' || c_nationkey AS pref01 FROM p, (VALUES (1), (2)) t(r) WHERE completed_study""")
def study_evaluations_and_preferences(spark, sf_dir):
    """The task export and the final one, joined by the response code."""
    participants, players = _people(spark, sf_dir)
    rounds = players.withColumn("round_number", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("use01", F.when(F.col("round_number") == 1, F.col("c_mktsegment")))
    final = players.withColumn("pref01", F.concat(F.lit("pref "), "c_nationkey"))
    both = study.by_response(study.task_evaluations(rounds, participants), study.final_comparison(final, participants))
    return both.select("response_code", "round_number", "use01", "int02", "pref01")


@query("""SELECT c_custkey, r AS round, CASE r WHEN 1 THEN 'p' || c_custkey % 4 ELSE 'q' || c_custkey % 4 END AS passage, CASE WHEN (c_custkey + r) % 2 = 0 THEN 'rag' ELSE 'baseline' END AS condition FROM customer, (VALUES (1), (2)) t(r)""")
def study_rounds(spark, sf_dir):
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 4 AS sequence_id")
    name = lambda n: "rag" if n % 2 == 0 else "baseline"
    plan = spark.createDataFrame([(i, f"p{i}", name(i + 1), f"q{i}", name(i + 2)) for i in range(4)], "sequence_id long, passage1 string, condition1 string, passage2 string, condition2 string")
    return study.rounds(people, plan).select("c_custkey", "round", "passage", "condition")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS position, ((row_number() OVER (ORDER BY c_custkey) - 1) // 8)::BIGINT AS block_no FROM customer")
def arrival_positions(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey")
    return study.assign_blocks(people, "c_custkey", 7).select("c_custkey", F.col("position").cast("long").alias("position"), F.col("block_no").cast("long").alias("block_no"))


@query("""SELECT b AS block_no, least(8, n - 8 * b)::BIGINT AS people, least(8, n - 8 * b)::BIGINT AS sequences, true AS in_range FROM (SELECT count(*) AS n FROM customer), unnest(range((n + 7) // 8)) t(b)""")
def block_balance(spark, sf_dir):
    """A block gives each sequence at most once."""
    people = study.assign_blocks(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7)
    return people.groupBy(F.col("block_no").cast("long").alias("block_no")).agg(
        F.count(F.lit(1)).alias("people"), F.countDistinct("sequence_id").alias("sequences"), F.bool_and(F.col("sequence_id").between(1, 8)).alias("in_range")
    )


# ---- single functions

_PAGE = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/+$', ''), ''), '/')"


@query(f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, {_PAGE} AS path, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS raw FROM pages),
l AS (SELECT *, list_last(string_split(rtrim(raw, '/'), '/')) AS last FROM p)
SELECT page_id, CASE WHEN h LIKE 'www.%' THEN NULL WHEN h = 'thther.example.org' THEN 'https://www.thther.example.org' || path END AS on_host,
 CASE WHEN page_id % 2 = 0 THEN 'https://thther.example.org/x' ELSE regexp_extract(url, '^[a-z]+', 0) || '://' || h || path END AS canonical,
 CASE WHEN regexp_matches(last, '^[a-z0-9]+(?:-[a-z0-9]+)*$') THEN last ELSE substr(sha256(url), 1, 16) END AS slug, 'a_' || substr(sha256(url), 1, 16) AS id, 'other' AS kind,
 regexp_extract(url, '[?&]page=([^&#]*)', 1) AS pages FROM l""")
def url_functions(spark, sf_dir):
    url = F.col("url")
    link = F.when(F.col("page_id") % 2 == 0, "https://thther.example.org//x/").otherwise("https://other.org/y")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.on_host(url, "www.thther.example.org", ["thther.example.org"]).alias("on_host"), urls.choose_canonical(link, url, ["thther.example.org"]).alias("canonical"),
        urls.slug(url).alias("slug"), urls.hash_id(url, "a_").alias("id"), urls.page_kind(url)["kind"].alias("kind"), F.array_join(urls.query_values(url, "page"), ",").alias("pages"),
    )


@query("""SELECT p_partkey, p_brand || '; x' AS tags, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_type END, p_name) AS filled, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN -p_size END AS lenient, (p_retailprice::INT) AS truncated,
 CASE WHEN p_partkey % 2 = 0 THEN 'baseline' ELSE 'rag' END AS condition, 'search_query: ' || p_name AS prefixed, p_partkey % 3 = 1 AS hashed, p_brand || '|' || p_name AS label,
 CASE p_partkey % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'bullet' WHEN 2 THEN 'quote' WHEN 3 THEN 'rule' WHEN 4 THEN 'numbered' ELSE 'paragraph' END AS line_kind, p_partkey % 2 = 1 AS enabled, greatest(5, least(p_size, 20)) AS clamped FROM part""".replace("p_retailprice::INT", "trunc(p_retailprice)::INT"))
def text_functions(spark, sf_dir):
    """One column for each of the small text and value functions."""
    key, name = F.col("p_partkey"), F.col("p_name")
    size = F.col("p_size").cast("string")
    written = F.when(key % 4 == 0, F.concat(F.lit(" "), size)).when(key % 4 == 1, F.concat(F.lit("-"), size, F.lit(" "))).when(key % 4 == 2, F.concat(size, F.lit(".0"))).otherwise("")
    line = F.when(key % 6 == 0, F.concat(F.lit("## "), name)).when(key % 6 == 1, F.concat(F.lit("- "), name)).when(key % 6 == 2, F.concat(F.lit("> "), name)).when(key % 6 == 3, "---").when(key % 6 == 4, "3. x").otherwise(name)
    label = text.split_label(F.concat_ws("/", "p_brand", "p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(text.split_tags(F.concat("p_brand", F.lit(" ;; x ;"), "p_brand")), "; ").alias("tags"), text.first_filled(F.when(key % 3 == 0, F.col("p_type")).otherwise(""), name).alias("filled"),
        text.lenient_int(written).alias("lenient"), text.lenient_int(F.col("p_retailprice")).alias("truncated"), text.canonical_condition(F.when(key % 2 == 0, " No-Retrieval").otherwise("RAG_enhanced")).alias("condition"),
        text.retrieval_prefix(name, "nomic-embed-text:v1", "query").alias("prefixed"), text.is_sha256(F.when(key % 3 == 1, F.sha2(name, 256)).otherwise(F.upper(F.sha2(name, 256)))).alias("hashed"),
        F.concat_ws("|", label["content_type"], label["producer"]).alias("label"), text.markdown_line_kind(line).alias("line_kind"), frontier.enabled(F.when(key % 2 == 1, " Yes").otherwise("no")).alias("enabled"),
        vec.clamp(F.col("p_size"), 5, 20).alias("clamped"),
    )


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS slug, min(epoch_ms(l_shipdate) - epoch_ms(o_orderdate)) AS ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def time_labels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    stamp = lambda c: F.col(c).cast("timestamp")
    joined = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    return joined.groupBy("o_orderkey", text.utc_iso(stamp("o_orderdate")).alias("iso"), text.utc_slug(stamp("o_orderdate")).alias("slug")).agg(
        F.min(text.elapsed_ms(stamp("o_orderdate"), stamp("l_shipdate"))).alias("ms")
    )


@query("""SELECT p_type, '{' || string_agg('"' || p_brand || '":' || n, ',' ORDER BY p_brand) || '}' AS brands FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_type""")
def sorted_counts(spark, sf_dir):
    """Counts as a map in the order of its keys, as compact JSON."""
    counts = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(_n())
    return counts.groupBy("p_type").agg(text.compact_json(text.sorted_map(F.map_from_entries(F.collect_list(F.struct("p_brand", "n"))))).alias("brands"))


@query(f"WITH {_CHUNKS} SELECT string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS source_ids FROM chunks")
def source_id_set(spark, sf_dir):
    return corpus.source_ids(chunks(spark, sf_dir)).select(F.array_join("source_ids", ",").alias("source_ids"))


@query(r"""WITH s AS (SELECT p_partkey, p_name, p_partkey % 4 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 'before ' || p_name || ' after.' WHEN 1 THEN 'one two' WHEN 2 THEN p_name ELSE 'a b' END AS scripture,
 p_name || ' and word' AS markdown FROM s""")
def markup_removal(spark, sf_dir):
    name = F.col("p_name")
    k = F.col("p_partkey") % 4
    scripture = (
        F.when(k == 0, F.concat(F.lit(r"\p before \f + \ft note \w held|x\w*\f* "), F.concat(F.lit(r"\w "), name, F.lit(r'|strong="G1"\w*')), F.lit(" after.")))
        .when(k == 1, F.lit(r'\zaln-s |x-strong="H1" \*one\zaln-e\* \q1 two'))
        .when(k == 2, F.concat(F.lit("\\m\n"), name, F.lit(r" \x - \xt ref\x*")))
        .otherwise(F.lit(r"a\fe + note\fe*b"))
    )
    markdown = F.concat(F.lit("### "), name, F.lit(" <!-- no -->and [[word]]"))
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_markers(scripture).alias("scripture"), text.strip_markdown(markdown).alias("markdown"))


_PERMISSION = """CASE p_partkey % 8 WHEN 0 THEN 'Letter of 3 May' WHEN 1 THEN ' Pending ' WHEN 2 THEN 'not yet granted' WHEN 3 THEN 'approved; TBD later' WHEN 4 THEN 'Written permission required from all'
 WHEN 5 THEN NULL WHEN 6 THEN 'granted  by mail' ELSE 'appending is fine' END"""


@query("SELECT p_partkey, p_partkey % 8 IN (0, 6, 7) AS permitted, p_size > 10 AND p_size < 40 AS consented FROM part")
def permission_gate(spark, sf_dir):
    agreed = privacy.consented(F.col("p_size") > 10, F.when(F.col("p_size") < 40, True))
    return table(spark, sf_dir, "part").select("p_partkey", privacy.permitted(F.expr(_PERMISSION)).alias("permitted"), agreed.alias("consented"))


@query("""SELECT s_suppkey, n_name AS source_name, coalesce(s_suppkey % 3 = 0 AND n_regionkey = 1, false) AS eligible FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def source_projection(spark, sf_dir):
    """Rows with the columns of their source, and the gate that compares their policy with the source's."""
    nation = table(spark, sf_dir, "nation")
    dim = nation.select(F.col("n_nationkey").cast("string").alias("source_id"), F.col("n_name").alias("source_name"))
    policy = nation.select(F.col("n_nationkey").cast("string").alias("source_id"), F.col("n_regionkey").alias("region"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    named = build.project(rows, F.col("s_nationkey").cast("string"), dim)
    flagged = named.withColumn("index_eligible", F.when(F.col("s_suppkey") % 3 == 0, True).when(F.col("s_suppkey") % 3 == 1, False)).withColumn("region", F.lit(1))
    passed = corpus.eligible(flagged, policy, ["region"]).select("s_suppkey", F.lit(True).alias("passed"))
    return named.join(passed, "s_suppkey", "left").select("s_suppkey", "source_name", F.coalesce("passed", F.lit(False)).alias("eligible"))


@query("""SELECT p_size AS k, count(*) AS count FROM part WHERE p_size > 25 GROUP BY 1""")
def unmatched_keys(spark, sf_dir):
    known = spark.range(26).select(F.col("id").cast("int").alias("k"))
    return corpus.unmatched(table(spark, sf_dir, "part").select(F.col("p_size").alias("k")), known, "k")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'none' END AS note FROM customer""")
def overrides_and_defaults(spark, sf_dir):
    """Core columns that a record's own map replaces, also by null; curated columns with defaults."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    extra = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("segment"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    replaced = corpus.override(rows.withColumn("extra", extra), "extra", ["segment"]).drop("extra")
    curated = rows.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("own").alias("note"))
    return frontier.with_defaults(replaced, curated, "c_custkey", {"note": "none"}).select("c_custkey", "segment", "note")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Answer ' || o_custkey WHEN 1 THEN 'a' || o_custkey || 'b' END AS answer FROM orders""")
def response_texts(spark, sf_dir):
    """The text of an API response: of the first candidate, its parts joined."""
    body = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN concat('{"candidates": [{"content": {"parts": [{"text": "Answer ', o_custkey, '"}]}}, {"content": {"parts": [{"text": "x"}]}}]}')
     WHEN 1 THEN concat('{"candidates": [{"content": {"parts": [{"text": "a', o_custkey, '"}, {"text": "b"}]}}]}') WHEN 2 THEN '{"candidates": []}' ELSE 'no json' END""")
    return table(spark, sf_dir, "orders").select("o_orderkey", answering.response_text(body).alias("answer"))


@query(r"""SELECT 'b' || p_partkey % 5 AS file, (p_partkey // 5 + 1)::INTEGER AS chapter, v::INTEGER AS verse_start, (v + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS verse_end, p_name || ' goes on' AS text
FROM part, (VALUES (1), (3)) t(v)""")
def scripture_verses(spark, sf_dir):
    """Marked-up lines to verses: chapter markers set the state, plain lines go on with a verse."""
    verse = lambda v: F.concat(F.lit(rf"\v {v}"), F.when(F.col("p_partkey") % 2 == 0, f"-{v + 1}").otherwise(""), F.lit(r" \w "), "p_name", F.lit(r"|x\w*"))
    lines = F.array(F.concat(F.lit(r"\c "), (F.floor(F.col("p_partkey") / 5) + 1).cast("string")), F.lit(r"\h head"), verse(1), F.lit("goes on"), verse(3), F.lit(r"\q1 goes on"))
    spread = table(spark, sf_dir, "part").select(F.concat(F.lit("b"), F.col("p_partkey") % 5).alias("file"), "p_partkey", F.posexplode(lines).alias("i", "value"))
    return corpus.verses_from_lines(spread.select("file", (F.col("p_partkey") * 10 + F.col("i")).alias("pos"), "value"))


@query("""SELECT 'V.' || l_suppkey AS source, 'V.' || l_partkey AS target, l_quantity::INTEGER AS votes FROM lineitem WHERE l_linenumber <= 2""")
def edge_lines(spark, sf_dir):
    """An edge list as text: columns apart by any white space; header, blank lines and remarks are skipped."""
    value = F.expr(r"CASE WHEN l_linenumber <= 2 THEN concat(' V.', l_suppkey, '\t', 'V.', l_partkey, '   ', int(l_quantity), ' x') WHEN l_linenumber = 3 THEN '# remark' WHEN l_linenumber = 4 THEN 'From Verse\tTo Verse\tVotes' ELSE '  ' END")
    return corpus.edges_from_lines(table(spark, sf_dir, "lineitem").select(value.alias("value")))


@query("""WITH b AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations)
SELECT conv_id, turn, md5(heading) AS heading FROM b WHERE role <> 'system'""")
def active_headings(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "heading").otherwise("paragraph")
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"), kind.alias("type"), "text")
    return chunking.with_headings(blocks).select(F.col("page_id").alias("conv_id"), F.col("pos").alias("turn"), F.md5("heading").alias("heading"))


@query("""SELECT 'invalid_json' AS "check", count_if(event_id % 50 = 0)::BIGINT AS violations FROM events UNION ALL SELECT 'missing_keys', count_if(event_id % 50 <> 0 AND event_id % 7 = 0)::BIGINT FROM events""")
def json_line_report(spark, sf_dir):
    raw = F.expr("CASE WHEN event_id % 50 = 0 THEN '{broken' WHEN event_id % 7 = 0 THEN '{\"id\": null}' ELSE '{\"id\": 1, \"text\": null}' END")
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), raw.alias("raw"), (F.col("event_id") % 50 == 0).alias("bad"))
    return validation.line_report(lines, ["id", "text"]).select("check", "violations")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x hashed-y' WHEN 1 THEN p_name || ' & co' ELSE 'a b' END AS crawled, p_name || chr(10) || 'next' AS lines, 'A ' || p_name || chr(10) || '& B' AS plain,
 CASE p_partkey % 4 WHEN 0 THEN 'gospel' WHEN 1 THEN 'law,gospel' ELSE '' END AS terms, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS people, 'Good answer.' AS answer, p_name AS message, p_name || ' key' AS heading,
 'tag' || p_size AS as_list FROM part""")
def web_text_functions(spark, sf_dir):
    name, key = F.col("p_name"), F.col("p_partkey")
    crawled = F.when(key % 3 == 0, "x\u00a0 hash\u00aded-\u200by ").when(key % 3 == 1, F.concat(name, F.lit("\n&\tco"))).otherwise("\u200b a  b")
    told = F.when(key % 4 == 0, "The Gospel, not lawful").when(key % 4 == 1, "LAW and gospel").otherwise("none")
    people = F.when(key % 2 == 0, F.concat(F.lit("x Contributors:  "), name, F.lit(" Adopted by all"))).otherwise("Contributors unknown")
    answer = F.when(key % 2 == 0, "Good answer.\n\n*(Note: by SOURCE_CONTEXT)*").otherwise("Good answer.\n\n* Note: the SOURCE_CONTEXT has no citation\n\n")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.normalise_crawled(crawled).alias("crawled"), text.normalise_lines(F.concat(F.lit("\r\n  "), name, F.lit("\r\r next "))).alias("lines"),
        text.plain_html(F.concat(F.lit("<p>A <b>"), name, F.lit("</b><BR/>&amp; B</p>"))).alias("plain"),
        F.array_join(text.detect_terms(told, {"law": ("law", "torah"), "gospel": ("gospel",)}), ",").alias("terms"), text.contributors(people, ("Adopted by",)).alias("people"),
        text.clean_answer(answer).alias("answer"), text.safe_message(F.concat(F.lit(" "), name, F.lit("\n"))).alias("message"),
        text.markdown_title(F.concat(F.lit("text\n# "), name, F.lit("  key \nmore")), F.lit("none")).alias("heading"), F.array_join(text.as_list(F.concat(F.lit("tag"), "p_size")), ",").alias("as_list"),
    )
