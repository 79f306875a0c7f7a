import random
import re

import numpy as np
import pytest

from quillmesh.llm import mixing


def rows():
    draw = random.Random(8)
    out = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, "one", "B"), (5, "w " * 20_000, "a"), (6, "two words", None), (6, "two words", None)]
    for i in range(400):
        out.append((10 + i, " ".join(draw.choices(["x", "yy", "é"], k=draw.randrange(1, 400))), draw.choice(["a", "a", "a", "b", "c", "é", None])))
    return out


def test_targets_by_hand():
    assert mixing.targets([("a", 100), ("b", 100), (None, 100)]) == pytest.approx([200.0, 250 / 3, 500 / 3])
    got = mixing.targets([("a", 10), ("b", 1000)])
    assert got == pytest.approx([20.0, 1495.0])
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [0.0]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutations(n):
    for key in range(3):
        assert sorted(mixing.permute(np.arange(n), n, key)) == list(range(n))
    if n > 60:
        assert (mixing.permute(np.arange(n), n, 1) != mixing.permute(np.arange(n), n, 2)).any()


def test_shards_use_the_quota():
    quota = np.array([5000, 0, 3, 20_000])
    shards = mixing.draw_shards(quota)
    assert (shards.sum(axis=0) == quota).all() and (shards.sum(axis=1)[:-1] == mixing.SHARD_SLOTS).all()
    assert len({tuple(x) for x in shards}) > 20
    assert mixing.draw_shards(np.array([0, 0])).shape == (0, 2)


def test_query(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 3, "q") for r in data], "doc_id long, text string, source string, size int, at string")
    got = mixing.query(df).collect()
    assert len(got) == len(data)
    size = {}
    for _, t, s in data:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([(s, size[s]) for s in order])))
    by_doc = {}
    for d, t, s in data:
        by_doc.setdefault(d, (len((t or "").split()), size[s], s))
    taken = dict.fromkeys(order, 0)
    for r in got:
        n, whole, s = by_doc[r.doc_id]
        assert (r.size, r.source_size) == (n, whole) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= max(2 * mixing.BLOCK, 0.01 * want[s]), (s, taken[s], want[s])
    again = mixing.query(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.query(df.limit(0)).count() == 0
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.taken
    assert {d: n for d, n in total.items() if n} == words


def broadcasts(df):
    """The subtree of each broadcast in the plan that was run, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = [re.match(r"[ :]*([+:]- )?", x).end() for x in lines]
    out = []
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_slots_and_documents_are_not_broadcast(spark):
    """Whatever the threshold: Spark takes the slots for as few as the rows they are drawn from, and a table for as small as
    its compressed files. Only what has been shuffled, and so counted, may be broadcast, and the table of sources."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df = spark.createDataFrame([(i, "w " * 3000, "a") for i in range(100)], "doc_id long, text string, source string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
        for out in (mixing.mixed_documents(df), mixing.query(df)):
            assert out.collect()
            found = broadcasts(out)
            assert found and [x for x in found if ("MapInArrow" in x or "FileScan" in x) and "ENSURE_REQUIREMENTS" not in x] == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_targets_oracle_says_the_same(spark):
    import duckdb

    rows = [(i, f"s{i % 7}" if i % 9 else None, "w " * (i * i % 400)) for i in range(200)] + [(900, "s9", None), (901, "s8", "x " * 9000)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    got = mixing.source_targets(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    want = {s: (n, t) for s, n, t in con.sql(mixing.TARGETS_ORACLE).fetchall()}
    assert {r.source: (r.source_size, r.target) for r in got} == want
