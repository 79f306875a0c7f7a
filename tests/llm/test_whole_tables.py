"""The registered queries on the whole sf0.01 tables against plain versions that share no code with the operators."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmesh.llm import queries
from tests.llm import test_pii, test_simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op1(spark, docs):
    fps = np.array([test_simhash.slow_fingerprint(t) for _, t, _ in docs], np.uint64)
    label = np.array([d for d, _, _ in docs])
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while True:
        new = np.where(near, label[None, :], label.max()).min(axis=1)
        if (new == label).all():
            break
        label = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_near_dedup(spark, SF).collect()}
    assert got == {d: (f"{int(f):016x}", int(c)) for (d, _, _), f, c in zip(docs, fps, label, strict=True)}
    assert len(set(label)) < len(docs)


def test_op3_base_and_method(spark, docs):
    names, found = ("email", "ip", "card", "phone"), 0
    got = {r.doc_id: r for r in queries.op3_pii_bootstrap(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t, _ in docs:
        base, r = test_pii.slow(t), got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        spans = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        everything = r.spans.split(",") if r.spans else []
        assert set(spans) <= set(everything) and everything == sorted(everything, key=lambda s: (int(s.split(":")[1]), names.index(s.split(":")[0])))
        more = [tuple(map(int, s.split(":")[1:])) for s in set(everything) - set(spans)]
        assert all(b <= x or y <= a for a, b in more for x, _, y in base)
        found += len(spans)
    assert found > 50


def test_op4(spark, docs):
    words = {d: len([w for w in t.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]) for d, t, _ in docs}
    size, taken, target = Counter(), Counter(), {}
    for d, _, s in docs:
        size[s] += words[d]
    rows = queries.op4_source_mixing(spark, SF).collect()
    source = {d: s for d, _, s in docs}
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (words[r.doc_id], size[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        target[s] = r.target
    assert len(rows) == len(docs) and abs(sum(target.values()) - min(1.5, 2.0) * sum(size.values())) < 1
    assert all(t <= 2 * size[s] + 1e-6 for s, t in target.items())
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(128, 0.02 * t), s
    again = {r.doc_id: r.taken for r in queries.op4_source_mixing(spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_op10(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = {}, 0
    for d, t, _ in docs:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[(d, k // 2048)] = (k, len(part), zlib.crc32(part.tobytes()))
    rows = queries.op10_best_fit_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for items in places.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(places) == -(-total // 2048)
