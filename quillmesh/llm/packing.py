"""Best-fit packing of tokenized documents into fixed-length sequences.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` entries whatever the
corpus: large items (above a third of the capacity, so two at most share a sequence) are matched greedily,
then the smaller ones best-fit the gaps. Runs of equal sequences are handled as one, so the plan is a short
table of (length, rank range) -> sequences, and placing a piece only needs its rank among those of its length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import materialise, text_slices

CAPACITY = 2048
SEPARATOR = 0
TOKENIZER = "word_bpe_49k.json"
#: Distinct words whose ids a worker remembers (and as many older ones), and the longest such word, in bytes.
MEMO_WORDS, MEMO_BYTES = 200_000, 48
_SIGN = re.compile(rb"(?<=[a-z])(?=[!-/:-@\[-`{-~])")
#: Pieces of one length and bucket that a task orders, on average.
BUCKET_ROWS = 20_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from 256 on, in order."""
    out, other = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE:
            out.append(chr(b))
        else:
            out.append(chr(other))
            other += 1
    return out


class WordEncoder(dict):
    """Token ids of whole texts by a tokenizer whose pieces never cross ASCII white space, nor the place between
    a letter and a sign. Each word is encoded once by the tokenizer and remembered as the bytes of its ids, so that a
    text's ids are one join; a word of letters needs its model only, as normalising and splitting leave it whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.older = self.tokenizer.model, _byte_letters(), {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode("utf-8", "surrogatepass")
            low = text.lower()
            # A sigma's lower case depends on its place, which the tokenizer doesn't look at.
            if low.isalpha() and unicodedata.is_normalized("NFC", text) and "\u03a3" not in text:
                found = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, low.encode())))]
            else:
                found = self.whole(text)
            ids = np.array(found, "<u4").tobytes()
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass")
        if b"<|" in data:  # special tokens are found before anything is lower-cased
            return np.array(self.whole(text), "<u4")
        words = _SIGN.sub(b" ", data.lower()).split()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: the text's ids, then the separator; null text: empty.

    ``ids`` are little-endian unsigned 32-bit integers (null unless ``keep_ids``); only documents with more ids
    than the capacity have several pieces, and all but their last are full."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = WordEncoder(path)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
        )
        for batch in batches:
            for docs_, texts in text_slices(batch, ["doc_id", "text"]):
                rows = []
                for doc, text in zip(docs_, texts, strict=True):
                    ids = np.append(encoder.encode(text or ""), np.array([SEPARATOR], "<u4"))
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        raw = ids[at : at + capacity].tobytes()
                        rows.append((doc, k, at, len(raw) // 4, zlib.crc32(raw), raw if keep_ids else None))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                    )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, items, first sequence, items a sequence, offset)`` that place every item."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    sequences = 0

    def put(length: int, items: int, first: int, each: int) -> None:
        runs.append((length, used[length], items, first, each, 0))
        used[length] += items
        left[length] -= items

    for length in sorted((n for n in left if 3 * n > capacity), reverse=True):
        partner = min(capacity - length, length)
        while left[length]:
            while 3 * partner > capacity and not left.get(partner):
                partner -= 1
            if 3 * partner <= capacity or partner == length == 1:
                many = left[length]
                put(length, many, sequences, 1)
                room = capacity - length
            elif partner == length:
                many = left[length] // 2
                if not many:
                    partner -= 1
                    continue
                put(length, 2 * many, sequences, 2)
                room = capacity - 2 * length
            else:
                many = min(left[length], left[partner])
                put(length, many, sequences, 1)
                runs.append((partner, used[partner], many, sequences, 1, length))
                used[partner] += many
                left[partner] -= many
                room = capacity - length - partner
            if room:
                gaps[room].append((sequences, many))
            sequences += many
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            gap = next((g for g in range(length, capacity) if gaps.get(g)), None)
            each = (gap or capacity) // length
            if gap is None:
                first, many = sequences, -(-left[length] // each)
                sequences += many
                gap = capacity
            else:
                first, many = gaps[gap].pop()
            whole = min(many, left[length] // each)
            if whole:
                runs.append((length, used[length], whole * each, first, each, capacity - gap))
                used[length] += whole * each
                left[length] -= whole * each
                if gap - each * length:
                    gaps[gap - each * length].append((first, whole))
            if whole < many:
                rest = left[length]
                if rest:
                    runs.append((length, used[length], rest, first + whole, rest, capacity - gap))
                    used[length] += rest
                    left[length] = 0
                    gaps[gap - rest * length].append((first + whole, 1))
                    whole += 1
                if whole < many and gap < capacity:
                    gaps[gap].append((first + whole, many - whole))
    return runs


def _place(runs: list[tuple[int, int, int, int, int, int]], length: np.ndarray, rank: np.ndarray):
    """Sequence and offset of items given by length and rank among the items of that length."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    at = np.empty(len(length), np.int64)
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        lo, hi = np.searchsorted(table[:, 0], [n, n + 1])
        at[own] = lo + np.searchsorted(table[lo:hi, 1], rank[own], "right") - 1
    run = table[at]
    k = rank - run[:, 1]
    return run[:, 3] + k // run[:, 4], run[:, 5] + (k % run[:, 4]) * length


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """All documents packed: the columns of ``pieces`` with ``sequence_id`` and ``offset``.

    Rows that repeat a doc_id are packed each on its own; an empty table gives an empty result. Reruns place
    pieces alike but for identical ones, which may change places with each other."""
    cut = materialise(pieces(docs, capacity, path, keep_ids), "packing-pieces")
    spark = docs.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    # One row for each length, so capacity rows at most; a length has as many buckets as its pieces fill.
    widths = F.broadcast(spark.createDataFrame([(n, max(1, -(-c // BUCKET_ROWS))) for n, c in counts.items()], "length long, buckets long"))
    bucketed = cut.join(widths, "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))
    )
    by_bucket = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        bucketed.withColumn("inside", F.row_number().over(inside))
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("inside") - 1)
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sequence, offset = _place(
                    runs.value, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
                )
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                    [*names, "sequence_id", "offset"],
                )

    return ranked.select(*names, "rank").mapInArrow(run, PIECE + ", sequence_id long, offset long")


def query(docs: DataFrame) -> DataFrame:
    """Digest columns of op10."""
    return pack(docs, keep_ids=False).drop("ids")
