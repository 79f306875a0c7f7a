import math

import numpy as np

from quillmesh.llm import vectors


def slow(rows):
    fine = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(v, np.float64) / np.linalg.norm(v) if f else None for (_, v), f in zip(rows, fine)]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, links[i], least.get(find(i), d), d == least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def rows():
    draw = np.random.default_rng(4)
    out, base = [], draw.normal(size=(12, 16))
    for i in range(260):
        v = base[draw.integers(12)] + draw.normal(size=16) * draw.choice([0.0, 0.1, 0.3, 0.45])
        out.append((i * 3, v.astype(np.float32).tolist()))
    for i in range(200):
        out.append((1000 + i, draw.normal(size=16).astype(np.float32).tolist()))
    for i in range(120):
        out.append((2000 + i, (base[0] + draw.normal(size=16) * 0.05).astype(np.float32).tolist()))
    out += [(5, None), (6, []), (7, [0.0] * 16), (8, [math.nan] + [1.0] * 15), (11, [None] + [1.0] * 15), (13, [math.inf] * 16),
            (14, [1.0, 2.0]), (16, [2.0, 4.0]), (17, out[0][1]), (17, out[0][1]), (None, [-3.0, 1.0])]
    return out


def test_query_against_brute_force(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame([(d, v, 1, "a") for d, v in data], "vec_id long, embedding array<float>, k int, cls string")
    for cell in (40, 2000):
        monkeypatch.setattr(vectors, "CELL", cell)
        assert sorted(map(tuple, vectors.query(df).collect()), key=str) == slow(data)
    assert vectors.query(df.limit(0)).count() == 0


def test_oracle_says_the_same(spark):
    import duckdb

    data = [(d, v) for d, v in rows() if v is None or len(v) != 16 or all(c is not None for c in v)]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", data)
    assert sorted(con.sql(vectors.ORACLE).fetchall(), key=str) == slow(data)
