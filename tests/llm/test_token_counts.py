import random
from collections import Counter

from tokenizers import Tokenizer

from quillmesh.llm import packing, token_counts


def rows():
    draw = random.Random(6)
    out = [(1, None, "a", "en"), (2, "", "a", None), (3, "x\nx\ny", None, "en"), (4, "same text", "a", "en"), (5, "same text", "b", "fr")]
    for i in range(60):
        t = "\n".join(draw.choices(["It's fine", "größe 12", "other line", ""], k=draw.randrange(1, 6)))
        out.append((10 + i, t, draw.choice("ab"), draw.choice(["en", "fr"])))
    return out


def test_query_against_brute_force(spark):
    whole = Tokenizer.from_file(packing.tokenizer_path())
    want, seen = {}, set()
    for d, t, s, lang in rows():
        if t is not None and t in seen:
            continue
        seen.add(t)
        new = "\n".join(dict.fromkeys((t or "").split("\n")))
        for name, n in (("word_bpe_49k@1", len(whole.encode(new, add_special_tokens=False).ids)), ("words@1", len(new.split()))):
            docs, total = want.get((s, lang, name), (0, 0))
            want[(s, lang, name)] = (docs + 1, total + n)
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, source string, lang string, n_tokens int")
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_counts.query(df).collect()}
    assert got == want
    assert token_counts.query(df.limit(0)).count() == 0


def test_batches_are_idempotent_and_signed(spark):
    words = {"w@1": token_counts._words}
    roll = token_counts.Rollup(spark, counters=words)
    make = lambda *r: spark.createDataFrame(list(r), "doc_id long, source string, lang string, text string")
    total = lambda: {(r.source, r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    first = make((1, "a", "en", "one two"), (2, "a", "en", "three"), (2, "a", "en", "three"), (None, "z", None, "no id"))
    assert roll.commit("1", first) and not roll.commit("1", first)
    assert total() == {("a", 3, 4), ("z", 1, 2)}
    assert roll.commit("2", upserts=make((1, "b", "en", "now four words here")), deletes=make((99, "", "", ""), (2, "", "", "")))
    assert total() == {("b", 1, 4), ("z", 1, 2)}
    assert roll.commit("3", deletes=make((None, "", "", ""), (1, "", "", "")))
    assert total() == set() and roll.current().count() == 0
    assert Counter(roll.batches()) == Counter(["1", "2", "3"])


def test_attempts_exclude_each_other_and_snapshots_keep_the_state(spark):
    words = {"w@1": token_counts._words}
    roll = token_counts.Rollup(spark, counters=words)
    make = lambda *r: spark.createDataFrame(list(r), "doc_id long, source string, lang string, text string")
    total = lambda: {(r.source, r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    roll.commit("1", make((1, "a", "en", "one two"), (2, "a", "en", "three")))
    slow = f"{roll.path}/staged/slow"
    roll._store(make((9, "a", "en", "x")).selectExpr("doc_id", "'w@1' AS tokenizer", "source", "lang", "1 AS sign", "1L AS n_tokens"), slow)
    assert not roll._publish(slow, "batches/1") and total() == {("a", 2, 3)}
    assert roll.compact() and total() == {("a", 2, 3)}
    roll.commit("2", deletes=make((2, "", "", "")))
    assert total() == {("a", 1, 2)} and not roll.commit("1", make((5, "q", "en", "again")))
    assert roll.compact()
    roll.vacuum()
    assert total() == {("a", 1, 2)} and roll.current().count() == 1 and roll.batches() == ["1", "2"]
    assert not roll.commit("2", make((5, "q", "en", "again")))
    assert roll.commit("3", upserts=make((1, "b", "en", "x"))) and total() == {("b", 1, 1)}


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "ab c\n" * 300_000, "a", "en")], "doc_id long, text string, source string, lang string")
    assert {r.tokenizer: r.n_tokens for r in token_counts.count_tokens(df, token_counts.COUNTERS).collect()}["words@1"] == 600_000
