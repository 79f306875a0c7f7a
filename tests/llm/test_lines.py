import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import lines

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def rows():
    draw = random.Random(3)
    out = [(1, None), (2, ""), (3, "\n\n"), (4, "É only\nÉ only"), (5, "x\n" * 5000)]
    for i in range(60):
        parts = [draw.choice(["Home | Contact", " home | contact\r", "Own " + str(i), "rare", "\x1fodd", "", "é à"]) for _ in range(draw.randrange(1, 12))]
        out.append((10 + i, "\n".join(parts)))
    return out + [(20, "Home | Contact"), (20, "Home | Contact"), (None, "rare\nhome | contact")]


def slow(data, min_docs=10, min_key=1):
    docs = Counter(k for _, t in data for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for d, t in data:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < min_key or docs[key(x)] < min_docs]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows()], "doc_id long, text string, n_lines int, key string")
    assert sorted(map(tuple, lines.query(df).collect()), key=str) == slow(rows())
    assert lines.query(df.limit(0)).count() == 0
    kept = lines.drop_frequent_lines(df)
    assert kept.columns == [*df.columns, "_qm_n_lines", "_qm_n_dropped"]


@pytest.mark.parametrize("min_key", [1, 5])
def test_joined_path_is_the_same(spark, min_key):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    got = lines.drop_frequent_lines(df, broadcast_keys=0, min_key=min_key).select("doc_id", "_qm_n_lines", "_qm_n_dropped", F.sha2("text", 256))
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows(), min_key=min_key)


def test_runs_are_merged_and_tell_new_keys(spark):
    runs = lines.LineRuns(spark, 2)
    for part in (["a\nb"], ["b\nc"], ["a\nd"], ["a"]):
        runs.add(spark.createDataFrame([(t,) for t in part], "text string"))
    assert runs.batches == [(2, 2), (2, 1), (2, 1), (1, 0)]
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert runs.frequent(3).count() == 1


def test_real_size_against_brute_force(spark):
    """A compacted run has each key once, with the sum of its counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter(lines._hash(k) for _, t in data for k in set(lines.line_keys(t)[1]) if k)
    runs = lines.build_runs(docs)
    for name in runs.runs():
        keys = spark.table(name)
        assert keys.count() == keys.select("key").distinct().count() > 0
    assert {bytes(r.key): r.n for r in runs._merged(runs.runs()).collect()} == want
    plan = runs._merged(runs.runs())._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]
    names = runs.runs()
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)
    assert sorted(map(tuple, lines.query(docs).collect()), key=str) == slow(data)


def test_oracle_says_the_same():
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows())
    assert sorted(con.sql(lines.ORACLE).fetchall(), key=str) == slow(rows())
