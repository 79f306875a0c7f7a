import random
import re

import pytest

from quillmesh.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in licences.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.fixture(scope="module")
def scanner():
    return licences.Scanner()


def test_base_against_brute_force(scanner):
    draw = random.Random(1)
    pool = ["Under", "the", "MIT", "license", "apache", "version", "2", "0", "cc", "by", "nc", "é", "x1"]
    for _ in range(2000):
        text = "".join(draw.choice(pool) + draw.choice([" ", ", ", "\n", "-", "", "\x7f"]) for _ in range(25))
        n, places, labels, _ = scanner.scan(text)
        assert (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))) == slow(text)


def test_fuzzy_finds_every_occurrence_within_its_errors(scanner):
    draw = random.Random(2)
    for notice in licences.NOTICES:
        keys = " ".join(licences.KEYS.get(notice.text, ()))
        for _ in range(60):
            chars = list(notice.text)
            for _ in range(draw.randrange(0, notice.errors + 1)):
                k = draw.randrange(1, len(chars) - 1)
                if chars[k] == " ":
                    continue
                drop = draw.random() < 0.3 and all(c.isalnum() for c in chars[k - 1 : k + 2])
                chars[k] = "" if drop else draw.choice("xyz")
            noisy = re.sub(" +", " ", "".join(chars))
            if any(f" {k} " not in f" {noisy} " for k in licences.KEYS.get(notice.text, ())):
                continue
            got = scanner.near(f" some words before {noisy} and after ".encode())
            assert any(label == notice.label and abs(word - 3) <= 1 for label, word, _, _ in got), (noisy, got, keys)


def test_clean_text_has_no_match(scanner):
    draw = random.Random(3)
    for _ in range(200):
        text = " ".join(draw.choices("the of and version license public rights granted use source under by general".split(), k=80))
        assert not [s for s in scanner.scan(text)[3] if s[3] > 0 and s[0] != "proprietary"]


def test_query(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, "Relesed undr the MIT licence!"),
            (5, "x " * 50_000 + "Licensed under the Apache License, Version 2.0"), (None, "CC BY-NC 4.0"), (6, "GNU General Pubic License, version 3")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in licences.query(df).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert (got[4].labels, got[6].labels, got[1].labels) == ("mit", "gpl-3", "")
    assert licences.query(df).count() == len(rows) and licences.query(df.limit(0)).count() == 0


def test_weak_match_before_a_better_one_is_kept(scanner):
    both = scanner.scan("gnu generl publc license version 3 or gnu general public license version 2")[3]
    assert {("gpl-3", 0, 2), ("gpl-2", 7, 0)} <= {(label, word, errors) for label, word, _, errors in both}
    weak, exact = "relesed under the mit license", "released under the mit license"
    got = [(word, errors) for label, word, _, errors in scanner.scan(f"{weak} {weak} {exact}")[3] if label == "mit"]
    assert got == [(0, 1), (5, 1), (10, 0)]


def test_near_variants_of_the_base_phrases(scanner):
    for text, label in (("distributed undr the MIT license", "mit"), ("Apache Licence, Version 2.0", "apache-2"), ("see cc b nc", "cc-by-nc")):
        assert label in {s[0] for s in scanner.scan(text)[3]}, text


def test_an_earlier_match_is_in_the_window_of_a_later_seed():
    """Seeds of a piece that stands late in a notice may open a window before the last one's."""
    scan = licences.Scanner((licences.Notice("x", "abcd efgh ijkl mnop", 4),))
    text = b" abcd efgh ijkl zabcd efgh ijkl mnop "
    assert [(s[1], s[3]) for s in scan.near(text)][-1][1] <= 4
    assert any(s[1] + s[2] == 7 for s in scan.near(text))


def test_base_oracle_says_the_same(spark):
    import duckdb

    draw = random.Random(4)
    pool = ["Under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "é"]
    rows = [(1, None), (2, ""), (3, "cc by nc by nc cc by nc"), (3, "under the mit license under the MIT license")]
    rows += [(10 + i, " ".join(draw.choices(pool, k=60))) for i in range(200)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = licences.base_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(licences.BASE_ORACLE).fetchall(), key=str)
    assert all(tuple(r)[1:] == slow(dict([(r.doc_id, t) for d, t in rows if d == r.doc_id][-1:])[r.doc_id]) for r in got if r.doc_id >= 10)
