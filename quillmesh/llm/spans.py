"""Repeated passages: sliding spans of consecutive sentences, joined globally by hash.

Sentences of WINDOW words and more are cut into pieces by winnowing: after the word of the least hash in each
window of words. Where a piece ends depends on at most WINDOW - 1 words on either side and never on how long the
sentence is, so a passage of n words that two texts share, wherever it starts and ends in their sentences, has at
least n - 4 * WINDOW + 3 words in equal pieces: WORDS and more from 49 words on.

A span is the shortest run of SENTENCES pieces and WORDS words or more from a piece on; every piece starts one.
Spans meet by hash in one shuffle. A worker first compares the spans that it holds itself and sends only the
earliest of equal ones, so a passage that very many documents share costs each worker one row, and the
task it lands in reads them in order and holds none. All spans but the first of their hash in the corpus are
removed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import materialise, text_slices, with_row_id

SENTENCES = 2
WORDS = 20
#: Words of a window, each of which has the end of a piece after one of its words.
WINDOW = 8
#: Deeper than this in a run of one repeated word, where every word ends a piece, only one in WINDOW does.
RUN = 64
#: Spans that a worker compares among themselves before it sends them.
HELD_SPANS = 400_000
#: Words hashed at once.
STRETCH = 1 << 16
#: Bytes of removal lists up to which they go to every task; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
_END = re.compile(rb"(?<![.!?])[.!?]+[\"')\]]*[\x20\x09-\x0D]+|\n+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NO_DOC = 2**63 - 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join(map(xxh64_digest, words)), ">u8").astype(np.uint64)


def _cuts(hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Numbers of the words after which pieces end inside their sentences, from each word's hash and sentence."""
    n = len(hashes)
    if n < WINDOW:
        return np.empty(0, np.int64)
    low = np.uint64(2**32 - 1)
    least = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))  # of equal hashes the last
    have = 1
    while have < WINDOW:
        step = min(have, WINDOW - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least = least[sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :]]
    end = np.zeros(n, bool)
    end[(low - (least & low)).astype(np.int64)] = True
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    length = np.diff(first, append=n)
    for a, k in zip(first[length > 2 * RUN].tolist(), length[length > 2 * RUN].tolist(), strict=True):
        # One of WINDOW words; what is left over stays cut after each word.
        deep = (k - 2 * RUN) // WINDOW * WINDOW
        end[a + RUN : a + RUN + deep] &= np.arange(1, deep + 1) % WINDOW == 0
    return np.flatnonzero(end)


def pieces(low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends in bytes of the consecutive pieces that make up a whole text, given as its lower-cased (A-Z) UTF-8; words
    before each end; and the hashes of the text's words."""
    ends = [m.end() for m in _END.finditer(low)]
    if low and (not ends or ends[-1] < len(low)):
        ends.append(len(low))
    ends = np.array(ends, np.int64)
    space = _SPACE[np.frombuffer(low, np.uint8)]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(space) else ends
    hashes = word_hashes(low.split())
    cuts = _cuts(hashes, np.searchsorted(ends, starts, "right"))
    if len(cuts):
        ends = np.union1d(ends, starts[cuts[cuts < len(hashes) - 1] + 1])
    return ends, np.searchsorted(starts, ends, "left"), hashes


def spans(upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the spans over pieces, from the number of words before each end (blank ones add none)."""
    words = np.concatenate([[0], upto])
    first = np.arange(len(upto))
    last = np.maximum(first + SENTENCES, np.searchsorted(words, words[:-1] + WORDS, "left"))
    whole = last <= len(upto)
    return first[whole], last[whole]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    up, down = (np.full(n, x, np.uint64) for x in (base, pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class SpanHasher:
    """128-bit hashes of runs of words as two polynomials in the words' hashes, from running sums modulo 2 ** 64."""

    def __init__(self, stretch: int = STRETCH):
        self.stretch = stretch
        self.powers = [_powers(b, stretch + 64) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]

    def __call__(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Two words of hash for each run ``first:last`` of words; ``first`` is in order."""
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        values = hashes, mixed ^ (mixed >> np.uint64(29))
        out = [np.empty(len(first), np.uint64) for _ in values]
        widest = int((last - first).max(initial=0))
        step = self.stretch
        if widest > 64:
            self.powers = [_powers(int(up[1]), step + widest) for up, _ in self.powers]
        for at in range(0, len(hashes), step):
            a, b = np.searchsorted(first, [at, at + step])
            if a == b:
                continue
            x, y = first[a:b] - at, last[a:b] - at
            for value, (up, down), to in zip(values, self.powers, out, strict=True):
                part = value[at : at + step + widest]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
                h = (sums[y] - sums[x]) * down[x]
                to[a:b] = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return out


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_SPAN = "k1 long, k2 long, doc_id long, row_id long, start int, stop int, gone boolean"


def _joined(start: np.ndarray, stop: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of the unions of overlapping or touching ranges, which come in order of row and start."""
    reach = np.maximum.accumulate(row * 2**32 + stop)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (row[1:] * 2**32 + start[1:] > reach[:-1])
    a = np.flatnonzero(new)
    return row[a], start[a], (reach[np.append(a[1:], len(row)) - 1] - row[a] * 2**32 if len(a) else a)


class _Held:
    """Spans of some documents of a worker: the earliest of each hash goes on, the others are gone."""

    def __init__(self):
        self.parts, self.ids, self.n = [], [], 0
        self.hasher = SpanHasher()

    def add(self, doc: int | None, row: int, text: str | None) -> None:
        ends, upto, hashes = pieces(_utf8(text).lower())
        first, last = spans(upto)
        if len(first):
            words = np.concatenate([[0], upto])
            k1, k2 = self.hasher(hashes, words[first], words[last])
            begins = np.concatenate([[0], ends])
            own = np.full(len(first), len(self.ids))
            self.parts.append((k1, k2, own, begins[first], begins[last]))
            self.ids.append((_NO_DOC if doc is None else doc, row, doc is None))
            self.n += len(first)

    def out(self) -> pa.RecordBatch:
        doc, row, no_doc = map(np.array, zip(*self.ids, strict=True))
        k1, k2, own, start, stop = map(np.concatenate, zip(*self.parts, strict=True))
        self.parts, self.ids, self.n = [], [], 0
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((row, doc, no_doc))] = np.arange(len(doc))
        order = np.lexsort((rank[own] * 2**32 + start, k2, k1))
        same = np.zeros(len(order), bool)
        same[1:] = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
        sent, again = order[~same], np.sort(order[same])
        g_own, g_start, g_stop = _joined(start[again], stop[again], own[again])
        gone = np.repeat([False, True], [len(sent), len(g_own)])
        key = (row[g_own].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        own = np.concatenate([own[sent], g_own])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([k1[sent], key]).view(np.int64)),
                pa.array(np.concatenate([k2[sent], np.zeros(len(g_own), np.uint64)]).view(np.int64)),
                pa.array(doc[own]),
                pa.array(row[own]),
                pa.array(np.concatenate([start[sent], g_start]).astype(np.int32)),
                pa.array(np.concatenate([stop[sent], g_stop]).astype(np.int32)),
                pa.array(gone),
            ],
            ["k1", "k2", "doc_id", "row_id", "start", "stop", "gone"],
        )


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """``(row_id, at)`` for rows of ``rows(row_id, doc_id, text)`` that have spans found earlier in the corpus: the
    spans' ranges in the UTF-8 text, as longs start * 2 ** 32 + stop in order."""

    def run(batches):
        held = _Held()
        for batch in batches:
            for docs, ids, texts in text_slices(batch, ["doc_id", "row_id", "text"], 128):
                for doc, row, text in zip(docs, ids, texts, strict=True):
                    held.add(doc, row, text)
                    if held.n >= HELD_SPANS:
                        yield held.out()
        if held.n:
            yield held.out()

    def later(batches):
        """Spans in order of hash and place: all but the first of a hash."""
        last = None
        for batch in batches:
            k1, k2, row, start, stop, gone = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "row_id", "start", "stop", "gone")
            )
            packed = start.astype(np.int64) * 2**32 + stop
            live = np.flatnonzero(~gone)
            again = np.flatnonzero(gone)
            if len(live):
                a, b = k1[live], k2[live]
                same = np.zeros(len(live), bool)
                same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                same[0] = last == (a[0], b[0])
                last = a[-1], b[-1]
                again = np.concatenate([again, live[same]])
            if len(again):
                yield pa.RecordBatch.from_arrays([pa.array(row[again]), pa.array(packed[again])], ["row_id", "at"])

    found = rows.select("doc_id", "row_id", "text").mapInArrow(run, _SPAN)
    ordered = found.repartition("k1").sortWithinPartitions("k1", "k2", "doc_id", "row_id", "start")
    return (
        ordered.mapInArrow(later, "row_id long, at long")
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_list("at")).alias("at"))
    )


def remove_repeated(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, text, n_removed)``, one row for each row of ``docs``: the text without its repeated spans, and the
    number of separate stretches taken out. A span goes with the white space after it, all else stays as it is.

    The first place of a span is that with the smallest doc_id (a null one comes last), of rows with one doc_id the
    first row, and the first in its text; so a passage stays in one place only, also among rows that repeat a
    doc_id or have none. Repeats inside a document count. A null text becomes empty; an empty table gives no
    rows; other columns are ignored. Texts of any length are cut as a whole, in stretches of STRETCH words.
    """
    rows = materialise(
        with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), "span-rows"
    )
    removed = materialise(repeated_ranges(rows), "span-removed")
    weight = removed.agg(F.sum(F.size("at") * 8 + 24)).first()[0] or 0
    side = F.broadcast(removed) if weight <= broadcast_bytes else removed

    def run(batches):
        for batch in batches:
            for ids, texts, ats in text_slices(batch, ["doc_id", "text", "at"], 128):
                kept, cut = [], []
                for text, at in zip(texts, ats, strict=True):
                    raw, left, end, n = _utf8(text), [], 0, 0
                    for start, stop in (divmod(x, 2**32) for x in at or ()):
                        if start > end or not n:
                            left.append(raw[end:start])
                            n += 1
                        end = max(end, stop)
                    left.append(raw[end:])
                    kept.append(b"".join(left).decode("utf-8", "surrogatepass") if n else text or "")
                    cut.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(kept, pa.string()), pa.array(cut, pa.int64())],
                    ["doc_id", "text", "n_removed"],
                )

    return rows.join(side, "row_id", "left").select("doc_id", "text", "at").mapInArrow(run, "doc_id long, text string, n_removed long")


def query(docs: DataFrame) -> DataFrame:
    return remove_repeated(docs)
