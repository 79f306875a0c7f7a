import random
import re
from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quillmesh.llm import spans


def plain_pieces(text):
    """Sentence ends, then the word of the least hash (of equal ones the last) in each window of a sentence; word by
    word, with byte offsets. Runs of one word are left to the tests below."""
    raw = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode()
    ends = [m.end() for m in re.finditer(rb"(?:(?<=[^.!?])|^)[.!?]+[\"')\]]*[ \t-\r]+|\n+", raw)] + [len(raw)]
    out, start = [], 0
    for end in ends:
        words = [(m.start() + start, m[0]) for m in re.finditer(rb"[^ \t-\r]+", raw[start:end])]
        cuts = set()
        for i in range(len(words) - spans.WINDOW + 1):
            window = range(i, i + spans.WINDOW)
            cuts.add(min(window, key=lambda k: (xxh64_intdigest(words[k][1]) >> 32, -k)))
        a, n = start, 0
        for k, (_, w) in enumerate(words):
            n += 1
            if k in cuts and k + 1 < len(words):
                out.append((a, words[k + 1][0], n))
                a, n = words[k + 1][0], 0
        if end > a:
            out.append((a, end, n))
        start = end
    return raw, out


def slow(rows):
    places = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        raw, parts = plain_pieces(t or "")
        for a in range(len(parts)):
            for b in range(a + spans.SENTENCES, len(parts) + 1):
                if sum(p[2] for p in parts[a:b]) >= spans.WORDS:
                    x, y = parts[a][0], parts[b - 1][1]
                    places[b" ".join(raw[x:y].split())].append(((d is None, d or 0, k, x), k, x, y))
                    break
    drop = defaultdict(set)
    for found in places.values():
        for _, k, x, y in sorted(found)[1:]:
            drop[k].update(range(x, y))
    out = []
    for k, (d, t) in enumerate(rows):
        raw = (t or "").encode()
        kept = bytes(c for i, c in enumerate(raw) if i not in drop[k]).decode()
        out.append((d, kept, sum(i - 1 not in drop[k] for i in drop[k])))
    return sorted(out, key=str)


def rows():
    draw = random.Random(2)
    word = lambda: draw.choice("alpha beta gamma delta eps zeta eta theta iota kappa Äther".split()) + str(draw.randrange(30))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + draw.choice([". ", "! ", "\n", "?\n", '."\t', "\n\n"])
    text = lambda k: "".join(line(draw.randrange(1, 14)) for _ in range(k))
    passage, flat = text(9), " ".join(word() for _ in range(120))
    out = [(1, None), (2, ""), (3, "Hi. There."), (4, " \n "), (5, "...")]
    for i in range(30):
        out.append((10 + i, text(6) + (passage if i % 3 == 0 else "") + text(5)))
        out.append((100 + i, text(2) + (flat if i % 4 == 0 else "") + " tail"))
    return out + [(50, passage), (50, passage), (None, passage), (None, passage), (60, passage + text(3) + passage)]


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_query_against_brute_force(spark, bound):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows()], "doc_id long, text string, at int, row_id string")
    got = sorted(map(tuple, spans.remove_repeated(df, bound).collect()), key=str)
    want = slow(rows())
    assert got == want
    assert sum(r[2] for r in want) >= 20
    if bound:
        assert spans.query(df.limit(0)).count() == 0


def test_rows_without_or_with_the_same_id_keep_a_passage_once(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    for d in (7, None):
        got = spans.remove_repeated(spark.createDataFrame([(d, passage)] * 3, "doc_id long, text string")).collect()
        assert sorted(bool(r.n_removed) for r in got) == [False, True, True]
        assert sum(r.text == passage for r in got) == 1


@pytest.mark.parametrize("held", [50, 10**6])
def test_real_table_against_brute_force(spark, monkeypatch, held):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("length(text) < 2500")
    monkeypatch.setattr(spans, "HELD_SPANS", held)
    data = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert sorted(map(tuple, spans.remove_repeated(docs).collect()), key=str) == slow(data)


def test_hashes_do_not_depend_on_the_place():
    draw = random.Random(3)
    words = [str(draw.randrange(50)).encode() for _ in range(300)]
    first = np.arange(0, 280)
    last = first + np.array([draw.randrange(1, 20) for _ in first])
    for stretch in (16, 100, 1 << 16):
        found, seen = {}, {}
        for a, b, *key in zip(first, last, *spans.SpanHasher(stretch)(spans.word_hashes(words), first, last), strict=True):
            run, key = b" ".join(words[a:b]), tuple(map(int, key))
            assert found.setdefault(run, key) == key and seen.setdefault(key, run) == run


def keys(text):
    _, upto, _ = spans.pieces(text.encode())
    words, at = text.split(), [0, *upto.tolist()]
    return {tuple(words[at[a] : at[b]]) for a, b in zip(*map(list, spans.spans(upto)), strict=True)}


def test_any_passage_of_51_words_has_a_common_span():
    draw = random.Random(7)
    pool = [f"w{i}" for i in range(400)]
    for _ in range(600):
        words = draw.choices(pool[: draw.choice([1, 2, 3, 10, 400])], k=draw.randrange(51, 61))
        passage = " ".join(w + draw.choice(["", "", "", "", "", "."][: draw.choice([5, 6])]) for w in words)
        around = lambda: " ".join(draw.choices(pool, k=draw.randrange(30)))
        a, b = (f"{around()} {passage} {around()}." for _ in range(2))
        assert keys(a) & keys(b), passage


def test_very_long_text_and_a_run_of_one_word(spark):
    draw = random.Random(9)
    long = " ".join(f"w{draw.randrange(10**6)}" for _ in range(150_000))
    got = {r.doc_id: r for r in spans.remove_repeated(spark.createDataFrame([(1, long), (2, "x. " + long), (3, "a " * 5000)], "doc_id long, text string")).collect()}
    assert got[1].text == long
    assert len(got[2].text) < 300 and got[2].n_removed == 1
    assert len(got[3].text) < 400


def test_passage_inside_differing_sentences(spark):
    draw = random.Random(8)
    other = lambda k: " ".join(f"x{draw.randrange(10**6)}" for _ in range(k))
    data, planted = [], {}
    for i in range(0, 60, 2):
        words = [f"p{draw.randrange(10**6)}" for _ in range(51 + i % 10)]
        ends = {draw.randrange(4, 12), draw.randrange(20, 30), draw.randrange(40, 48)}
        passage = " ".join(w + "." * (k in ends) for k, w in enumerate(words))
        planted[i + 1] = words
        data += [(i, f"{other(20)} {passage} {other(3)}."), (i + 1, f"{other(5)} {passage} {other(25)}.")]
    got = {r.doc_id: r.text for r in spans.remove_repeated(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for d, t in data:
        if d in planted:
            gone = [w for w in planted[d] if w not in got[d].replace(".", "").split()]
            assert len(gone) >= 20, (d, got[d])
            assert all(w in got[d].split() for w in t.split() if w.startswith("x") and not w.endswith("."))
        else:
            assert got[d] == t
