"""Licence notices: exact base phrases, and a fuzzy search for short notices.

The fuzzy search splits each notice into one more piece than it may have errors. By the pigeonhole principle an
occurrence with at most that many edits holds one piece unchanged, so an exact multi-pattern search for the
pieces finds all candidates; only around those does the regex library match the notice with a bounded number of
errors and report the span.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import text_slices

#: Fixed values of the base search: phrase -> label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # words of [0-9a-z] joined by single spaces
    errors: int


NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("apache-2", "licensed under the apache license version 2", 4),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("cc-by", "licensed under cc by 4 0", 2),
    Notice("gpl-3", "gnu general public license version 3", 3),
    Notice("gpl-2", "gnu general public license version 2", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl-2", "mozilla public license version 2 0", 3),
    Notice("proprietary", "all rights reserved", 1),
    Notice("mit", "under the mit license", 2),
    Notice("apache-2", "apache license version 2", 2),
    Notice("cc-by-nc", "cc by nc", 1),
)
#: Words that must stand in a match as they are: those that tell one licence from another.
KEYS = {
    "released under the mit license": ("mit",),
    "licensed under the apache license version 2": ("apache", "2"),
    "licensed under cc by nc 4 0": ("cc", "by", "nc"),
    "licensed under cc by 4 0": ("cc by 4",),
    "gnu general public license version 3": ("3",),
    "gnu general public license version 2": ("2",),
    "mozilla public license version 2 0": ("2",),
    "under the mit license": ("mit",),
    "apache license version 2": ("apache", "2"),
    "cc by nc": ("cc", "nc"),
}


def pieces(notice: Notice) -> list[tuple[str, int]]:
    """``errors + 1`` consecutive pieces of near-equal length that make up a notice, with their places."""
    n, k = len(notice.text), notice.errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(notice.text[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_WORD = np.zeros(256, bool)
_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


class Scanner:
    """Scans one text after another; built once in a worker."""

    def __init__(self, notices=NOTICES, base=None):
        import ahocorasick
        import regex

        self.base = [(f" {p} ".encode(), p.count(" "), label) for p, label in (base or BASE_PHRASES).items()]
        self.notices = notices
        bounded = [f"(?:{regex.escape(n.text)}){{e<={n.errors}}}" for n in notices]
        self.next = [regex.compile(f"(?e){p}") for p in bounded]
        self.best = [regex.compile(f"(?b){p}") for p in bounded]
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for piece, at in pieces(notice):
                found.setdefault(piece, []).append((i, at))
        for piece, where in found.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def normal(self, text: str | None) -> bytes:
        """Lower-cased words, each between single spaces."""
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        codes = np.frombuffer(raw, np.uint8)
        word = _WORD[codes]
        codes = np.where(word, codes, 0x20).astype(np.uint8)
        keep = word.copy()
        keep[1:] |= word[:-1]
        flat = codes[keep].tobytes()
        return b" " + flat + (b"" if flat.endswith(b" ") or not flat else b" ")

    def scan(self, text: str | None) -> tuple:
        flat = self.normal(text)
        n_words = flat.count(b" ") - 1
        places, labels = [], set()
        for phrase, _, label in self.base:
            at = flat.find(phrase)
            while at >= 0:
                places.append(flat.count(b" ", 0, at))
                labels.add(label)
                at = flat.find(phrase, at + 1)
        spans = self.near(flat)
        return n_words, places, labels, spans

    def near(self, flat: bytes) -> list[tuple[str, int, int, int]]:
        """``(label, first word, words, errors)`` of the fuzzy matches of all notices, the best of each place."""
        if len(flat) < 8:
            return []
        line = flat.decode("latin-1")
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.seeds.iter(line):
            for i, at in where:
                notice = self.notices[i]
                lo = max(0, end - length + 1 - at - notice.errors)
                hi = end - length + 1 - at + len(notice.text) + notice.errors
                runs = windows.setdefault(i, [])
                runs.append([lo, hi])
        out = []
        for i, found in windows.items():
            notice, runs = self.notices[i], []
            # Seeds come in the order of their ends, but a later one may stand for a match that begins earlier.
            for lo, hi in sorted(found):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            for lo, hi in runs:
                hi = min(hi, len(line))
                # The next match, then the best one in its place; a rejected match is passed by one character.
                while m := self.next[i].search(line, lo, hi):
                    lo = m.start() + 1
                    best = self.best[i].search(line, m.start(), min(hi, m.end() + notice.errors))
                    for x in (best, m):
                        inner = f" {x[0].strip()} " if x else ""
                        if inner and all(f" {k} " in inner for k in KEYS.get(notice.text, ())):
                            first = line.count(" ", 0, x.start() + 1) - 1
                            out.append((notice.label, first, len(inner.split()), sum(x.fuzzy_counts)))
                            lo = max(lo, x.end())
                            break
        # A short notice inside a longer one of its label says nothing more.
        inside = lambda x, y: x[0] == y[0] and y[1] <= x[1] and x[1] + x[2] <= y[1] + y[2]
        kept: list[tuple[str, int, int, int]] = []
        for x in sorted(out, key=lambda x: (-x[2], x[3], x[1])):
            if not any(inside(x, y) for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: (x[1], x[0]))


def scan_documents(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)`` for each row.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased (A-Z) whole text; a null text has none.
    ``spans`` are the fuzzy matches (label, first word, words, errors). The score is 1 with a base phrase, else
    the best match's share of unedited characters, else 0. Rows that repeat a doc_id are scanned each.
    """
    fields = [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("errors", pa.int64())]))),
    ]
    schema = pa.schema(fields)
    length = {}
    for n in notices:
        length[n.label] = max(len(n.text), length.get(n.label, 0))

    def run(batches):
        scanner = Scanner(notices)
        for batch in batches:
            for ids, texts in text_slices(batch, ["doc_id", "text"]):
                rows = []
                for doc, text in zip(ids, texts, strict=True):
                    n_words, places, base, spans = scanner.scan(text)
                    score = 1.0 if places else max((1 - e / length[label] for label, _, _, e in spans), default=0.0)
                    rows.append({
                        "doc_id": doc, "n_words": n_words, "n_base": len(places),
                        "first_word": min(places, default=None), "last_word": max(places, default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {s[0] for s in spans})), "score": score,
                        "spans": [{"label": a, "word": b, "words": c, "errors": e} for a, b, c, e in spans],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, word: long, words: long, errors: long>>",
    )


def query(docs: DataFrame) -> DataFrame:
    """Digest columns of op7."""
    return scan_documents(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("spans").cast("long").alias("n_fuzzy"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["word"], s["words"], s["errors"])), ",").alias("fuzzy_spans"),
    )


def base_query(docs: DataFrame) -> DataFrame:
    """The base columns alone, which SQL can say."""
    return scan_documents(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_FOUND = ", ".join(
    f"{{'label': '{label}', 'words': {phrase.count(' ') + 1}, 'parts': string_split(flat, ' {phrase.replace(' ', '  ')} ')}}" for phrase, label in BASE_PHRASES.items()
)
BASE_ORACLE = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
flat AS (SELECT doc_id, len(words)::BIGINT AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS flat FROM split),
found AS (SELECT doc_id, n_words, list_filter([{_FOUND}], lambda x: len(x.parts) > 1) AS found FROM flat),
placed AS (
  SELECT doc_id, n_words, list_transform(found, lambda x: {{'label': x.label, 'n': len(x.parts) - 1,
    'first': len(regexp_extract_all(x.parts[1], '[^ ]+')), 'last': n_words - len(regexp_extract_all(x.parts[-1], '[^ ]+')) - x.words}}) AS f FROM found)
SELECT doc_id, n_words, coalesce(list_sum(list_transform(f, lambda x: x.n)), 0)::BIGINT AS n_base,
  list_min(list_transform(f, lambda x: x.first))::BIGINT AS first_word, list_max(list_transform(f, lambda x: x.last))::BIGINT AS last_word,
  array_to_string(list_sort(list_transform(f, lambda x: x.label)), ',') AS base_labels
FROM placed
"""
