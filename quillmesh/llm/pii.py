"""Personal data: exact base patterns, extended by bootstrapped contextual extraction.

The entities that the base patterns find are the seeds. Each sighting of an entity or of another identifier-like
run induces lexical patterns, from narrow to wide: the two words before it, the words on both sides, the two words
after it, the word before it, and its shape, if it passes its kind's check (a run that stands where the base's
greedy match went too far). Patterns and instances are a graph that Spark scores in rounds. A pattern's
confidence in a kind is the summed score of its instances of that kind over the number of all its instances (those
of unknown kind that may be of this one count half), shrunk by a prior so that few sightings prove nothing. An instance that confident patterns point at with enough belief
is promoted: it counts as a seed in the next round, so patterns that no seed has stood in can become confident
too. Rounds end when nothing more is promoted. The confident patterns then discover identifiers; a discovery must
be of the pattern's kind (number of digits, an at sign), in whatever form it is written.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import discard, materialise, text_slices

KINDS = ("email", "ip", "card", "phone")
#: A pattern is confident in a kind from this confidence and this many distinct seeds or promoted instances on.
THRESHOLD = 0.7
MIN_SEEDS = 3
#: Belief from which an instance is promoted to a seed.
PROMOTE = 0.75
#: Sightings of a made-up pattern of score zero that each pattern is mixed with.
PRIOR = 2.0
#: Weight against a pattern of an instance that may be of its kind but is neither seed nor promoted.
OPEN = 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match starts at the start of a run of digits and takes whole runs, so nothing is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_ANCHOR = re.compile(r"[0-9@]")
#: What ends a run that may be an identifier, the rest of such a run, and its longest length.
_ENDS = frozenset(" \t\n\x0b\x0c\r\xa0\"'<>(){}[],;|")
_REST = re.compile(r"[^\s\"'<>(){}\[\],;|]*")
LONGEST = 256
#: Groups of digits with single spaces, brackets and marks between them, and the most digits of such a run.
_GROUPS = re.compile(r"[0-9]++(?:[).\-/]?\x20?\(?[0-9]++)*(?![\w@])")
_GROUP_END = re.compile(r"(?<=[0-9])[^0-9]+[0-9]+$")
MOST_DIGITS = 19
#: What an instance of each kind is made of, and its least and most digits.
_KIND_TESTS = (
    (re.compile(r"[^@]+@[^@]*[^\W_][^@]*"), 0, LONGEST),
    (re.compile(r"(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}|(?=.*[0-9])[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}"), 1, 32),
    (re.compile(r"[\x20()./0-9-]+"), 12, MOST_DIGITS),
    (re.compile(r"[\x20()./0-9+-]+"), 7, 15),
)
#: Digits that a run without an at sign has at least.
LEAST_DIGITS = 5
_WORD = re.compile(r"[^\W\d_]+|[:=#]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str):
    """Each @ has one possible match: the run of local characters before it, from the last match's end on."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at)):
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base entities in code points, by start, then kind as listed."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def fits(instance: str) -> int:
    """Bit k is set if an instance may be an identifier of KINDS[k], whatever its form."""
    digits = sum(c in "0123456789" for c in instance)
    return sum(1 << k for k, (form, least, most) in enumerate(_KIND_TESTS) if least <= digits <= most and form.fullmatch(instance))


def _grouped(text: str, a: int, b: int, end: int) -> tuple[int, int]:
    """The run ``a:b`` if it is not of digits and marks, else with the groups of digits after it, up to ``end``,
    and a bracket and a plus sign before it."""
    first = a
    while first < b and text[first] in "+(":
        first += 1
    if not (m := _GROUPS.match(text, first, end)) or m.end() < b:
        return a, b
    b, run = m.end(), m[0]
    while sum(c in "0123456789" for c in run) > MOST_DIGITS and (cut := _GROUP_END.search(run)):
        run = run[: cut.start()]
        b = first + len(run)
    if a and text[a - 1] == "(" and ")" in run:
        a -= 1
        if a and text[a - 1] == "+":
            a -= 1
    return a, b


def valid_kinds(instance: str) -> list[str]:
    """The kinds whose base check a whole run passes."""
    return sorted({KINDS[k] for a, k, b in base_spans(instance) if (a, b) == (0, len(instance))})


def shape(instance: str) -> str:
    """Letters of a run as one a, digits as zeros (one for a run of them beside letters or an at sign)."""
    out = re.sub(r"[^\W\d_]+", "a", instance)
    return re.sub(r"[0-9]+", "0", out) if "a" in out or out.count(".") == 3 else re.sub(r"[0-9]", "0", out)


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place; _ stands for the run. Marks : = # count as words."""
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])[-2:]]
    after = [w.lower() for w in _WORD.findall(text[end : end + 48])[:2]]
    out = [f"{before[0]} {before[1]} _"] if len(before) == 2 else []
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    if before:
        out.append(f"{before[-1]} _")
    instance = text[start:end].lower()
    return out + [f"{kind} {shape(instance)}" for kind in valid_kinds(instance)]


def candidates(text: str | None, base: list[tuple[int, int, int]]):
    """``(start, end, seed kind or null)`` of all base entities and other identifier-like runs."""
    if not text:
        return []
    out = [(a, b, KINDS[k]) for a, k, b in base]
    taken = sorted((a, b) for a, _, b in base)
    starts = [a for a, _ in taken]
    last = 0
    for m in _ANCHOR.finditer(text):
        a = m.start()
        if a < last:
            continue
        while a > last and text[a - 1] not in _ENDS and m.start() - a <= LONGEST:
            a -= 1
        last = b = _REST.match(text, m.start()).end()
        while b > a and text[b - 1] in ".:!?":
            b -= 1
        k = bisect.bisect_left(starts, b)
        a, b = _grouped(text, a, b, starts[k] if k < len(starts) else len(text))
        last = max(last, b)
        token = text[a:b]
        if len(token) > LONGEST or sum(c in "0123456789" for c in token) < LEAST_DIGITS and "@" not in token[1:-1]:
            continue
        k = bisect.bisect_left(taken, (b,))
        if not any(a < y for _, y in taken[max(0, k - len(KINDS)) : k]):
            out.append((a, b, None))
    return out


def extract(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: base spans and sightings of possible identifiers."""
    sighting = pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("fits", pa.int32()), ("seed", pa.string())]
    )
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("seen", pa.list_(sighting))])

    def run(batches):
        for batch in batches:
            for ids, texts in text_slices(batch, ["doc_id", "text"]):
                rows = []
                for doc, text in zip(ids, texts, strict=True):
                    base = base_spans(text)
                    rows.append({
                        "doc_id": doc,
                        "base": [{"start": a, "kind": k, "end": b} for a, k, b in base],
                        "seen": [
                            {"start": a, "end": b, "instance": i, "patterns": patterns(text, a, b), "fits": fits(i), "seed": s}
                            for a, b, s in candidates(text, base)
                            for i in (text[a:b].lower(),)
                        ],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, base array<struct<start: int, kind: int, end: int>>, seen array<struct<start: int, end: int, "
        "instance: string, patterns: array<string>, fits: int, seed: string>>",
    )


def _kind_number() -> F.Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1


def _fits_kind() -> F.Column:
    """Whether the run of ``fits`` may be of the kind ``kind``."""
    return F.get(F.array(*[F.col("fits").bitwiseAND(1 << k) > 0 for k in range(len(KINDS))]), _kind_number())


def confident_patterns(seen: DataFrame, threshold: float = THRESHOLD, promote: float = PROMOTE) -> DataFrame:
    """``(pattern, kind, confidence)`` of the patterns that discover, from ``(patterns, instance, fits, seed, ...)``.

    The graph's edges are distinct (pattern, instance) pairs, so a repeated document adds nothing. Patterns
    with fewer than MIN_SEEDS instances can never be confident and leave the graph before the first round.
    Instances are never gathered: both sides of a round are sums.
    """
    edges = materialise(
        seen.select(F.explode("patterns").alias("pattern"), "instance", "fits", "seed")
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed"), F.max("fits").alias("fits")),
        "pii-edges",
    )
    is_open = lambda k: F.col("seed").isNull() & (F.col("fits").bitwiseAND(1 << k) > 0)
    sizes = (
        edges.groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(is_open(k)) for k in range(len(KINDS))]).alias("open"))
        .filter(F.col("n") >= MIN_SEEDS)
    )
    graph = materialise(edges.join(sizes, "pattern"), "pii-graph")
    discard(edges)
    seeds = graph.filter("seed IS NOT NULL").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score"), F.lit(0).alias("new")).distinct()
    scores, confidence, promoted, n = seeds, None, None, 0
    while True:
        old = confidence
        confidence = materialise(
            graph.join(scores, "instance")
            .groupBy("pattern", "kind")
            .agg(
                F.sum("score").alias("score"),
                F.count(F.lit(1)).alias("support"),
                (F.first("n") - (1 - OPEN) * (F.first(F.get("open", _kind_number())) - F.sum("new")) + PRIOR).alias("against"),
            )
            .withColumn("confidence", F.col("score") / F.col("against"))
            .filter((F.col("confidence") >= threshold) & (F.col("support") >= MIN_SEEDS))
            .select("pattern", "kind", "confidence"),
            "pii-confidence",
        )
        discard(old)
        discard(promoted)
        doubt = F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))
        promoted = materialise(
            graph.filter("seed IS NULL")
            .join(confidence, "pattern")
            .filter(_fits_kind())
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(doubt))).alias("score"))
            .groupBy("instance")
            .agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("best"))
            .select("instance", "best.kind", "best.score", F.lit(1).alias("new"))
            .filter(F.col("score") >= promote),
            "pii-promoted",
        )
        before, n = n, promoted.count()
        if n <= before:
            return confidence
        scores = seeds.union(promoted)


def find_identifiers(docs: DataFrame, threshold: float = THRESHOLD, promote: float = PROMOTE) -> DataFrame:
    """``(doc_id, base, found)`` for each row of ``docs``; both are arrays of ``(start, kind, end)`` in code points.

    ``found`` holds what the patterns discover beyond the base: a run outside all base spans that stands in a
    confident pattern and may be of the pattern's kind (see ``fits``). A null or empty text has none, and an empty
    table gives no rows. Rows that repeat a doc_id, or have none, are kept apart by a row id. Runs longer than
    LONGEST characters are no identifiers; texts of any length are read as a whole. Other columns are ignored.
    """
    rows = materialise(extract(docs).withColumn("row_id", F.monotonically_increasing_id()), "pii-rows")
    seen = rows.select("row_id", F.explode("seen").alias("s")).select("row_id", "s.*")
    good = confident_patterns(seen, threshold, promote)
    found = (
        seen.filter("seed IS NULL")
        .select("row_id", "start", "end", "fits", F.explode("patterns").alias("pattern"))
        .join(good, "pattern")
        .filter(_fits_kind())
        .groupBy("row_id", "start", "end")
        .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        .groupBy("row_id")
        .agg(F.collect_list(F.struct("start", _kind_number().alias("kind"), "end")).alias("found"))
    )
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    return rows.select("row_id", "doc_id", "base").join(found, "row_id", "left").select(
        "doc_id", "base", F.coalesce("found", none).alias("found")
    )


def _joined(spans) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def query(docs: DataFrame) -> DataFrame:
    """Digest columns of op3."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return find_identifiers(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
