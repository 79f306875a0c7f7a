import random
import re

import duckdb
import pytest

from quillmesh.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


ROWS = [(1, None), (2, ""), (3, " \n\x0b \r"), (4, "one"), (5, "a b c a b c"), (5, "a b c a b c"), (6, "x x x x"), (7, "line\nline\n \nline\r\n"),
        (8, "#*$%&|<> é ü \x1f"), (9, "p q r s p q r t q r s"), (None, "null id"), (10, "wow!! " * 80), (11, "### " * 60)]


def test_measures_against_brute_force(spark):
    draw = random.Random(2)
    rows = ROWS + [(100 + i, " ".join(draw.choices("abcdefgh", k=draw.randrange(0, 90)))) for i in range(80)]
    rows.append((12, "long " * 100_000))
    df = spark.createDataFrame([(d, t, 5, "y") for d, t in rows], "doc_id long, text string, n_words int, words string")
    got = {}
    for r in quality.query(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        if d == 12:
            assert (got[d][0].n_words, got[d][0].n_repeat_words) == (100_000, 100_000)
            continue
        n, chars, symbols, dup, repeat = slow(t)
        r = got[d][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        words = WORDS.findall(t or "")
        assert r.n_distinct_words == len(set(words))
        assert r.n_block_distinct == sum(len(set(words[i : i + 200])) for i in range(0, n, 200))
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    assert len(got[5]) == 2
    assert quality.query(df.limit(0)).count() == 0
    kept = quality.accepted(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, rs in got.items() for r in rs if r.kept)


def test_ablations(spark):
    book = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64,)], "rule_bits long")
    got = {r.rule: (r.n_failed, r.n_failed_only, r.n_kept_without) for r in quality.ablations(book, 2).collect()}
    assert got["few_words"] == (3, 2, 4)
    assert got["repeated_windows"] == (1, 0, 2)
    assert got["symbols"] == (1, 1, 3)


def test_a_long_text_is_not_held_to_the_ratio_of_a_short_one(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = [(1, " ".join(draw.choices(vocabulary, k=9000))), (2, " ".join(draw.choices(vocabulary[:40], k=9000)))]
    book = quality.stored_ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {v: {r.doc_id for r in quality.apply_policy(book, v).filter("kept").collect()} for v in quality.POLICIES}
    assert kept == {1: {1, 2}, 2: set(), 3: {1}}


@pytest.mark.parametrize("oracle, query", [(quality.ORACLE, quality.query), (quality.ABLATION_ORACLE, quality.ablation_query)])
def test_oracle_says_the_same(spark, oracle, query):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", ROWS)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted(map(tuple, query(df).collect()), key=str) == sorted(con.sql(oracle).fetchall(), key=str)
