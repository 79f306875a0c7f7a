import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillmesh.llm import packing


def check(counts, capacity):
    place = {}
    for n, c in counts.items():
        if c:
            s, o = packing._place(packing.plan(counts, capacity), np.full(c, n), np.arange(c))
            for a, b in zip(s, o):
                place.setdefault(int(a), []).append((int(b), n))
    for items in place.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2
    assert sum(map(len, place.values())) == sum(counts.values())
    return len(place)


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_all(seed):
    draw = random.Random(seed)
    capacity = draw.choice([1, 2, 3, 10, 64, 100])
    counts = {n: draw.randrange(0, 30) for n in draw.sample(range(1, capacity + 1), draw.randrange(0, capacity) + 1)}
    used = check(counts, capacity)
    assert used >= -(-sum(n * c for n, c in counts.items()) // capacity)


def test_plan_is_tight_on_many_small():
    draw = random.Random(1)
    counts = Counter(min(2048, int(draw.lognormvariate(5, 1)) + 1) for _ in range(20_000))
    total = sum(n * c for n, c in counts.items())
    assert check(counts, 2048) <= -(-total // 2048) + 1


def test_words_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(packing.tokenizer_path()), packing.WordEncoder(packing.tokenizer_path())
    texts = ["", "It's we'll  DON'T\n\tstop", "é é ça ́x", "<|endoftext|> a<|startoftext|>b <| endoftext |>",
             "tab\x0bvt\x1cfs nbsp em İ ß Σας 1234 ...!!", "日本語 テスト 👍🏽", " " * 9]
    draw = random.Random(3)
    texts += ["".join(draw.choices("ab'sStT é́<|>\n 1２. İ", k=60)) for _ in range(300)]
    for t in texts:
        assert encoder.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_query_round_trip(spark):
    draw = random.Random(4)
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "nobody"), (5, "w1 " * 9000)]
    rows += [(10 + i, " ".join(draw.choices(["apple", "of", "unknowable"], k=draw.randrange(1, 900)))) for i in range(200)]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, rank int, bucket string")
    got = packing.query(df).collect()
    encoder = packing.WordEncoder(packing.tokenizer_path())
    want = Counter()
    for d, t in rows:
        ids = [*encoder.encode(t or "").tolist(), 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[(d, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in at.values():
        end = 0
        for o, n in sorted(items):
            assert o == end
            end += n
        assert end <= 2048
    assert len(at) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.query(df.limit(0)).count() == 0
    ids = packing.pack(df).filter("doc_id = 5 and piece = 0").first().ids
    assert np.frombuffer(ids, "<u4")[:3].tolist() == encoder.encode("w1 w1")[:3].tolist()
