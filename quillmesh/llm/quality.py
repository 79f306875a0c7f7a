"""Quality rules as a bitmask ledger, in built-in functions only.

Every rule is evaluated once for a document. The ledger keeps the measurements and one failure bit for each
rule; a policy is a versioned set of rules, so applying another policy, or asking what a rule costs, reads the
ledger's bits and not the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import WORD_PATTERN, WS_CHARS, WS_CLASS, materialise

WINDOW = 3
#: Words of a block in which distinct words are counted, so that the count doesn't depend on a text's length.
BLOCK = 200
#: Low bits of a packed window that hold its position; a text with more words is sorted by whole windows.
POSITION_BITS = 24
BARRIER = "_qm_barrier"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 5 * word_chars"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "few_distinct_words", "100 * n_distinct_words < 30 * n_words"),
    Rule(5, "exclamation", "2 * n_exclamation > n_words"),
    Rule(6, "few_distinct_in_blocks", "100 * n_block_distinct < 30 * n_words"),
)
#: Policy versions are only ever added; an entry never changes once it has been used.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "repeated_lines", "few_distinct_words", "exclamation"),
    3: ("few_words", "repeated_windows", "symbols", "repeated_lines", "few_distinct_in_blocks", "exclamation"),
}
BASE_POLICY, POLICY = 1, 3
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_block_distinct", "n_exclamation",
)


def mask(version: int) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[version])


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(WINDOW)]


def _repeated(sorted_items: Column, key, value) -> Column:
    """Values of the items whose key equals that of a neighbour in a sorted array."""
    same = lambda x, y: F.coalesce(key(x) == key(y), F.lit(False))
    return F.transform(
        F.filter(
            sorted_items, lambda x, i: same(x, F.get(sorted_items, i - 1)) | same(x, F.get(sorted_items, i + 1))
        ),
        value,
    )


def measurements(docs: DataFrame) -> DataFrame:
    """``(doc_id, MEASURES...)`` for each row; a null text has no words and no lines.

    Every row is measured, also one that repeats a doc_id or has none; other columns are ignored; an empty table gives
    no rows. A text of 2 ** POSITION_BITS words and more is measured like any other, but slower.

    Repeated windows are found by sorting one long for each window, the low bits of its hash above its
    position; the few windows that meet are then compared as text, so a hash collision changes nothing.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim("text0", F.lit(WS_CHARS))
    split = docs.select("doc_id", text.alias("text0")).select(
        "doc_id",
        "text0",
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, f"{WS_CLASS}+"))
        .alias("words"),
        F.filter(F.split("text0", "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "").alias("lines"),
    )
    words, n = F.col("words"), F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")
    packed = split.select(
        "*",
        F.when(
            n < 1 << POSITION_BITS,
            F.sort_array(
                F.transform(
                    starts, lambda i: F.shiftleft(F.xxhash64(*_window(words, i)), POSITION_BITS).bitwiseOR(i.cast("long"))
                )
            ),
        ).alias("packed"),
    )
    met = packed.select(
        "*",
        F.when(
            F.col("packed").isNotNull(),
            F.sort_array(
                _repeated(
                    F.col("packed"), lambda x: F.shiftright(x, POSITION_BITS), lambda x: x.bitwiseAND(low).cast("int")
                )
            ),
        )
        .otherwise(starts)
        .alias("met"),
    ).drop("packed")
    exact = met.select(
        "*",
        F.sort_array(
            F.transform("met", lambda i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("w"), i.alias("i")))
        ).alias("exact"),
    ).drop("met")
    at = exact.select(
        "*", F.sort_array(_repeated(F.col("exact"), lambda x: x["w"], lambda x: x["i"])).alias("at")
    ).drop("exact")
    covered = F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    blocks = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    in_blocks = F.aggregate(
        F.transform(blocks, lambda i: F.size(F.array_distinct(F.slice(words, i, BLOCK)))), F.lit(0), lambda a, x: a + x
    )
    count = lambda c: c.cast("long")
    without = lambda pattern: F.length("text0") - F.length(F.regexp_replace("text0", pattern, ""))
    return at.select(
        "doc_id",
        count(n).alias("n_words"),
        count(F.length(F.array_join("words", ""))).alias("word_chars"),
        count(without(r"[#*$%&|<>]")).alias("n_symbols"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        count(F.size("lines")).alias("n_lines"),
        count(F.size(F.array_distinct("words"))).alias("n_distinct_words"),
        count(in_blocks).alias("n_block_distinct"),
        count(without("!")).alias("n_exclamation"),
        # A filter above would be pushed below and evaluate the arrays again for each element; it can't pass this.
        F.monotonically_increasing_id().alias(BARRIER),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``rule_bits`` (bit k set: the rule with bit k fails) for each row of ``docs``; nulls, repeated
    rows and long texts as in ``measurements``."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs).withColumn("rule_bits", bits)


def apply_policy(book: DataFrame, version: int = POLICY) -> DataFrame:
    """Adds ``kept`` and ``policy`` to a ledger."""
    return book.withColumn("kept", F.col("rule_bits").bitwiseAND(F.lit(mask(version))) == 0).withColumn(
        "policy", F.lit(version)
    )


def ablations(book: DataFrame, version: int = POLICY) -> DataFrame:
    """One row for each rule of a policy: documents that fail it, that fail nothing else, and that stay if the
    rule is left out. The ledger shrinks to one row for each combination of bits before rules are looked at."""
    own = [r for r in RULES if r.name in POLICIES[version]]
    combos = book.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask(version))).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spread = combos.select(
        "bits", "n", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in own])).alias("r")
    )
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return spread.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_only"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def accepted(docs: DataFrame, version: int = POLICY) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with the same columns and in one pass over the texts."""
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc_id"), "text")
    kept = apply_policy(ledger(whole), version).filter(F.col("kept") & (F.col(BARRIER) >= 0))
    return kept.select(*[F.col("doc_id").getField(c).alias(c) for c in columns])


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger as a table of the shared folder: policies and ablations read it and never the texts."""
    return materialise(ledger(docs).drop(BARRIER), "quality-ledger")


def query(docs: DataFrame) -> DataFrame:
    """Digest columns of op9, with the other measurements, the ledger's bits and the policy's version beside them.

    One row for each row of ``docs``: a null text has no words and fails, an empty table gives no rows, rows that
    repeat a doc_id are judged each, texts are measured whole."""
    base = F.col("rule_bits").bitwiseAND(F.lit(mask(BASE_POLICY))) != 0
    return apply_policy(stored_ledger(docs)).select("doc_id", *MEASURES, base.alias("base_failed"), "kept", "rule_bits", "policy")


def ablation_query(docs: DataFrame) -> DataFrame:
    """What each rule of the current policy does, from the stored ledger."""
    return ablations(stored_ledger(docs))


_LEDGER_SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD_PATTERN}')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM twice WHERE n > 1) GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, len(list_distinct(words))::BIGINT AS n_distinct_words,
    coalesce(list_sum(list_transform(range(0, len(words), {BLOCK}), lambda i: len(list_distinct(words[i + 1 : i + {BLOCK}])))), 0)::BIGINT AS n_block_distinct,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamation
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
marked AS (
  SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)})::BIGINT AS rule_bits
  FROM measured)
"""
ORACLE = f"""{_LEDGER_SQL}
SELECT doc_id, {", ".join(MEASURES)}, (rule_bits & {mask(BASE_POLICY)}) <> 0 AS base_failed,
  (rule_bits & {mask(POLICY)}) = 0 AS kept, rule_bits, {POLICY}::INTEGER AS policy
FROM marked
"""
_OWN = ", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES if r.name in POLICIES[POLICY])
ABLATION_ORACLE = f"""{_LEDGER_SQL}
SELECT rule, count_if((rule_bits & bit) <> 0)::BIGINT AS n_failed, count_if((rule_bits & {mask(POLICY)}) = bit)::BIGINT AS n_failed_only,
  count_if((rule_bits & {mask(POLICY)}) IN (0, bit))::BIGINT AS n_kept_without
FROM marked, (VALUES {_OWN}) r(rule, bit) GROUP BY rule
"""
