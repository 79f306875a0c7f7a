import random

import numpy as np
import pytest
import xxhash

from quillmesh.llm import simhash

SCHEMA = "doc_id long, text string, label string, fp string, kept_id int"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = [slow_fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(zip([r[0] for r in rows], fps))), key=str)


def test_query_against_brute_force(spark):
    draw = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "ONE two\x1fthree É é"), (6, "ONE two\x1fthree É é")]
    base = [draw.choices("abcdefghij", k=400) for _ in range(12)]
    for i in range(150):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 1, 1, 2, 6])):
            words[draw.randrange(400)] = draw.choice(["x", "y", "z"])
        rows.append((100 + i, " ".join(words)))
    rows += [(7, "w " * 70_000), (None, "nobody has this one at all"), (300, "nobody has this one at all")]
    df = spark.createDataFrame([(d, t, "l", "f", 1) for d, t in rows], SCHEMA)
    got = sorted(map(tuple, simhash.query(df).collect()), key=str)
    assert got == slow_components(rows)
    assert simhash.query(df.limit(0)).count() == 0
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    groups = {g for _, _, g in got}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_trees_lose_no_pair():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**64, 3000, dtype=np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << draw.integers(0, 64, len(near)).astype(np.uint64)
    forest = simhash.Forest(base[:1000], 6000)
    assert forest.depth > 5
    (r1, s1), (r2, s2) = forest.route(base), forest.route(near)
    a = {}
    for r, s in zip(r1, s1):
        a.setdefault(r, set()).add(s)
    met = {r for r, s in zip(r2, s2) if s in a[r]}
    assert met == set(range(3000))


@pytest.mark.parametrize("n", [0, 1, 30, 700])
def test_dense_shard_is_spanned(n):
    draw = np.random.default_rng(n)
    x = np.uint64(77) ^ (np.uint64(1) << draw.integers(0, 60, n).astype(np.uint64))
    x = np.unique(np.concatenate([x, draw.integers(0, 2**64, n // 3, dtype=np.uint64)]))
    i, j = simhash.shard_links(x)
    root = list(range(len(x)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(i, j):
        assert int(x[a] ^ x[b]).bit_count() <= 4
        root[find(a)] = find(b)
    for a in range(len(x)):
        for b in range(a):
            assert int(x[a] ^ x[b]).bit_count() > 4 or find(a) == find(b)


@pytest.mark.parametrize("seed", range(4))
def test_full_shard_loses_no_link(monkeypatch, seed):
    """Scattered fingerprints that agree in the bits of one band, pairs among them, and a dense group."""
    monkeypatch.setattr(simhash, "FULL", 100)
    draw = random.Random(seed)
    fps = {draw.getrandbits(42) << 22 | 0b1011 << 10 | draw.getrandbits(2) for _ in range(1500)}
    for f in draw.sample(sorted(fps), 300):
        for _ in range(draw.choice([1, 2, 3, 4, 5])):
            f ^= 1 << draw.randrange(64)
        fps.add(f)
    centre = draw.getrandbits(64)
    for _ in range(400):
        f = centre
        for _ in range(draw.randrange(7)):
            f ^= 1 << draw.randrange(64)
        fps.add(f)
    x = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    i, j = simhash.shard_links(x)
    assert near[i, j].all() and (i != j).all()

    def components(link):
        label = np.arange(len(x))
        while True:
            new = np.where(link, label[None, :], len(x)).min(axis=1)
            if (new == label).all():
                return label
            label = new

    found = np.eye(len(x), dtype=bool)
    found[i, j] = found[j, i] = True
    assert (components(found) == components(near)).all()


def test_dense_groups_take_the_star_path(spark):
    draw = random.Random(9)
    fps = set()
    for centre in (0, 0b1111111, 1 << 40):
        for _ in range(400):
            f = centre
            for _ in range(draw.choice([0, 1, 2, 3, 4, 5, 6])):
                f ^= 1 << draw.randrange(64)
            fps.add(f - (1 << 64) if f >= 1 << 63 else f)
    fps = sorted(fps)
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    from quillmesh.llm.components import connected_components

    label = {r.node: r.label for r in connected_components(simhash.fingerprint_links(distinct)).collect()}
    x = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    want = np.arange(len(x))
    while True:
        new = np.where(near, want[None, :], len(x)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert [label.get(f, f) for f in fps] == [fps[w] for w in want]


def test_keep_first_keeps_one_row_of_each_group(spark):
    draw = random.Random(11)
    text = lambda: " ".join(draw.choices("abcdefghijklmnop", k=60))
    three, alone, left, right, *none, shared = (text() for _ in range(10))
    data = [(3, three), (5, three), (5, alone), (6, left), (6, right), (7, shared), (None, shared), (8, "B " + left), (8, None)]
    data += [(None, t) for t in none] * 2
    df = spark.createDataFrame([(d, t, "l", "f", 1) for d, t in data], SCHEMA).repartition(3)
    fps = [slow_fingerprint(t) for t in (three, alone, left, right, *none, shared)]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_first(df).collect()), key=str)
    want = [(3, three), (5, alone), (6, left), (6, right), (7, shared), (8, None), *((None, t) for t in none)]
    if (slow_fingerprint("B " + left) ^ slow_fingerprint(left)).bit_count() > 4:
        want.append((8, "B " + left))
    assert got == sorted(want, key=str)
