import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillmesh.llm import mixing, packing
from tests.llm import test_lines, test_quality, test_simhash


def rows():
    draw = random.Random(12)
    words = ["stone", "river", "Cloud", "maple", "ember", "quiet", "north", "glass", "paper", "amber", "sail", "été"]
    word = lambda: draw.choice(words) + str(draw.randrange(90))
    out, base = [], []
    for i in range(90):
        lines = [" ".join(word() for _ in range(draw.randrange(5, 15))) for _ in range(draw.randrange(6, 20))]
        if i % 4 == 0:
            lines.insert(draw.randrange(len(lines)), "  Shared LINE of the site")
        base.append("\n".join(lines))
        out.append((i, base[-1], "en", draw.choice(["a", "a", "b", None])))
    for i in range(12):
        out.append((200 + i, base[i], "fr", "b"))
        out.append((300 + i, base[i].replace(base[i].split()[30], "changed", 1), "fr", "a"))
    out += [(400, None, "en", "a"), (401, "", "en", "a"), (402, "junk ### " * 60, "en", "b"), (403, "same again " * 80, "en", "b"), (404, "too short", None, "a")]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in out]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(sf)).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        out.append((name, docs.columns, docs.collect()))
    return str(sf), out


def test_stages_against_brute_force(stages):
    now = [(d, t) for d, t, *_ in rows()]
    for _, columns, _ in stages[1][:-1]:
        assert columns == list(corpus_pipeline.COLUMNS)
    (_, _, quality), (_, _, lines), (_, _, near), (_, _, mixed), (_, _, packed) = stages[1]

    def keeps(t):
        n, chars, symbols, dup, repeat = test_quality.slow(t)
        found = [x for x in (t or "").split("\n") if x.strip()]
        return (
            n >= 50 and 100 * repeat <= 50 * n and 100 * symbols <= 5 * chars and 100 * dup <= 40 * len(found)
            and 100 * sum(len(set(t.split()[i : i + 200])) for i in range(0, n, 200)) >= 30 * n and 2 * (t or "").count("!") <= n
        )

    now = [(d, t) for d, t in now if keeps(t)]
    assert sorted((r.doc_id, r.text) for r in quality) == sorted(now) and len(now) < len(rows())
    docs = Counter(k for _, t in now for k in {test_lines.key(x) for x in t.split("\n")})
    now = [(d, "\n".join(x for x in t.split("\n") if not test_lines.key(x) or docs[test_lines.key(x)] < 10)) for d, t in now]
    assert sorted((r.doc_id, r.text) for r in lines) == sorted(now)
    assert any("Shared LINE" in r.text for r in quality) and not any("Shared LINE" in r.text for r in lines)
    first = {d for d, _, c in test_simhash.slow_components(now) if d == c}
    now = [(d, t) for d, t in now if d in first]
    assert sorted((r.doc_id, r.text) for r in near) == sorted(now) and all(r.n_chars == len(r.text) for r in near)
    size, words, source = Counter(), Counter(), {r.doc_id: r.source for r in near}
    for d, t in now:
        size[source[d]] += len(t.split())
    taken = Counter()
    for r in mixed:
        own = dict(now)[r.doc_id].split()
        assert not Counter(r.text.split()) - Counter(own)
        words[r.doc_id] += len(r.text.split())
        taken[source[r.doc_id]] += len(r.text.split())
    assert all(n <= 2 * len(dict(now)[d].split()) for d, n in words.items())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mixing.targets([(s, size[s]) for s in order])):
        assert abs(taken[s] - t) <= max(2 * mixing.BLOCK, 0.02 * t)
    encoder = packing.WordEncoder(packing.tokenizer_path())
    assert sum(r.length for r in packed) == sum(len(encoder.encode(r.text)) + 1 for r in mixed)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in places.values():
        ends = np.cumsum([n for _, n in sorted(items)])
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(places) <= -(-sum(r.length for r in packed) // 2048) + 1


def test_run_is_its_stages(spark, stages):
    sf, out = stages
    got = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in out[-1][2])


def test_edge_rows_and_tables(spark, tmp_path):
    """Repeated and null ids, null and empty texts, ties, a column more and columns fewer, no rows."""
    draw = random.Random(3)
    text = lambda: " ".join(draw.choice("abcdefghijklmnop") + str(draw.randrange(200)) for _ in range(80))
    one, two, *rest = (text() for _ in range(6))
    data = [(1, one), (1, one), (1, two), (None, one), (None, None), (2, ""), (3, None), *((None, t) for t in rest)]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in data], "doc_id long, text string, row_id int, label string")
    kept = corpus_pipeline.quality_rules(spark, df, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS) and sorted((r.doc_id, r.text) for r in kept.filter("doc_id is not null").collect()) == sorted([(1, one), (1, one), (1, two)])
    assert kept.count() == 8
    assert corpus_pipeline.line_dedup(spark, df, "").count() == len(data)
    near = corpus_pipeline.near_dedup(spark, kept, "")
    assert sorted((str(r.doc_id), r.text) for r in near.collect()) == sorted([("1", one), ("1", two), *(("None", t) for t in rest)])
    assert all(r.source is None and r.n_chars == len(r.text) for r in near.collect())
    df.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    df.write.parquet(str(tmp_path / "more" / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path / "more")).collect()
    assert packed and {r.doc_id for r in packed} <= {1, None}


def test_line_stage_at_real_size(spark):
    """The compacted runs of a whole table: the stage drops what brute force drops."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    count = Counter(k for _, t in data for k in {test_lines.key(x) for x in t.split("\n")})
    want = [(d, "\n".join(x for x in t.split("\n") if not test_lines.key(x) or count[test_lines.key(x)] < 10)) for d, t in data]
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()) == sorted(want)
