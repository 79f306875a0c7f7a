"""Frequent-line removal over levelled sorted runs of line hashes.

Documents come in batches. A batch makes one run: its distinct line keys as 128-bit hashes with the number of
documents that have them, bucketed and sorted by hash. It is merge-anti-joined with the runs before it to tell
new keys from known ones, and then becomes a run itself; two runs of one level are merged into one of the next.
Runs share their bucketing, so neither the anti-join nor a merge shuffles the older runs again: a merge is a full
outer sort-merge join, bucket by bucket, that adds the counts of equal keys.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.common import delete, materialise, table_path, text_slices, with_row_id

MIN_DOCS = 10
MIN_KEY = 1
BATCHES = 3
#: Distinct keys that a worker sums up before it hands them on.
HELD_KEYS = 100_000
#: Frequent keys up to this number (16 bytes each) go to the workers; beyond it they are joined.
BROADCAST_KEYS = 500_000
#: Input rows that a bucket of a run stands for, on average.
BUCKET_ROWS = 100_000


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text (null: one empty line) and their keys: stripped of [\\x20\\x09-\\x0D], A-Z lower-cased."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def _hash(key: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(key)


def _counts(key: bytes, min_key: int) -> bool:
    return len(key) >= min_key and (min_key <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_key)


class LineRuns:
    """The levelled index. ``add`` takes a batch of documents, each of which is in one batch only."""

    def __init__(self, spark: SparkSession, buckets: int, min_key: int = MIN_KEY):
        self.spark, self.buckets, self.min_key = spark, buckets, min_key
        self.levels: list[list[str]] = [[]]
        self.batches: list[tuple[int, int]] = []
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        """``run`` has one row for each key; rows of one bucket come from one task."""
        name = f"quillmesh_line_run_{uuid.uuid4().hex}"
        self.paths[name] = table_path(self.spark, "line-run")
        writer = run.write.bucketBy(self.buckets, "key").sortBy("key")
        writer.option("path", self.paths[name]).option("compression", "zstd").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged by key. The first two meet in their buckets, without a shuffle."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnRenamed("n", "more")
            out = out.join(more, "key", "full_outer").select(
                "key", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n")
            )
        return out

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drops all runs."""
        for name in self.runs():
            self._drop(name)
        self.levels = [[]]

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, docs: DataFrame) -> None:
        min_key = self.min_key

        def run(batches):
            found: Counter = Counter()

            def out():
                return pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["key", "n"]
                )

            for batch in batches:
                for (texts,) in text_slices(batch, ["text"]):
                    for text in texts:
                        found.update({_hash(k) for k in set(line_keys(text)[1]) if _counts(k, min_key)})
                    if len(found) >= HELD_KEYS:
                        yield out()
                        found.clear()
            yield out()

        # Dealt to buckets first: the sum by key then needs no second shuffle, and a task has one bucket.
        dealt = docs.select("text").mapInArrow(run, "key binary, n long").repartition(self.buckets, "key")
        new = self._write(dealt.groupBy("key").agg(F.sum("n").alias("n")))
        fresh = self.spark.table(new)
        total = fresh.count()
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name).select("key"), "key", "left_anti")
        self.batches.append((total, fresh.count() if self.runs() else total))
        self.levels[0].append(new)
        level = 0
        while len(self.levels[level]) == 2:
            if level + 1 == len(self.levels):
                self.levels.append([])
            old, self.levels[level] = self.levels[level], []
            self.levels[level + 1].append(self._write(self._merged(old)))
            for name in old:
                self._drop(name)
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys found in at least ``min_docs`` documents, as ``key`` (the hash)."""
        if not self.runs():
            return self.spark.createDataFrame([], "key binary")
        return self._merged(self.runs()).filter(F.col("n") >= min_docs).select("key")


def build_runs(docs: DataFrame, batches: int = BATCHES, min_key: int = MIN_KEY) -> LineRuns:
    """The index of a whole table, added batch by batch (rows are dealt by a hash of their text)."""
    n = docs.select(F.count(F.lit(1))).first()[0]
    runs = LineRuns(docs.sparkSession, max(8, n // BUCKET_ROWS), min_key)
    for k in range(batches):
        runs.add(docs.filter(F.pmod(F.xxhash64("text"), F.lit(batches)) == k))
    return runs


def _result(batch, kept: list[str], n_lines: list[int], n_dropped: list[int]) -> pa.RecordBatch:
    names = batch.schema.names
    columns = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
        [*names, "_qm_n_lines", "_qm_n_dropped"],
    )


def drop_frequent_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_key: int = MIN_KEY,
    batches: int = BATCHES,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``docs`` with text replaced by its kept lines, joined by \\n, and ``_qm_n_lines``, ``_qm_n_dropped``.

    Lines whose key has at least ``min_key`` code points and is found in at least ``min_docs`` documents go
    from every document; each row counts as a document, also one that repeats a doc_id. Keys that are too
    short, as those of blank lines are, stay. A null or empty text is one empty line and becomes empty; a text
    that loses all its lines becomes empty too. Other columns pass through unchanged.
    """
    spark = docs.sparkSession
    runs = build_runs(docs, batches, min_key)
    frequent = materialise(runs.frequent(min_docs), "line-frequent")
    runs.close()
    schema = T.StructType(
        [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
        + [T.StructField("_qm_n_lines", T.LongType()), T.StructField("_qm_n_dropped", T.LongType())]
    )
    n = frequent.count()
    if n <= broadcast_keys:
        shared = spark.sparkContext.broadcast(b"".join(sorted(bytes(r.key) for r in frequent.collect())))

        def apply(parts):
            packed = shared.value
            drop = {packed[i : i + 16] for i in range(0, len(packed), 16)}
            for whole in parts:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    kept, n_lines, n_dropped = [], [], []
                    for text in batch.column("text").to_pylist():
                        lines, keys = line_keys(text)
                        stay = [x for x, k in zip(lines, keys, strict=True) if not (_counts(k, min_key) and _hash(k) in drop)]
                        kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
                        n_lines.append(len(lines))
                        n_dropped.append(len(lines) - len(stay))
                    yield _result(batch, kept, n_lines, n_dropped)

        return docs.mapInArrow(apply, schema)
    rows = materialise(with_row_id(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))), "line-docs")

    def places(parts):
        for batch in parts:
            for ids, texts in text_slices(batch, ["row_id", "text"]):
                out = [
                    (i, at, _hash(k))
                    for i, text in zip(ids, texts, strict=True)
                    for at, k in enumerate(line_keys(text)[1])
                    if _counts(k, min_key)
                ]
                if out:
                    i, at, key = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(i, pa.int64()), pa.array(at, pa.int32()), pa.array(key, pa.binary())],
                        ["row_id", "at", "key"],
                    )

    placed = rows.select("row_id", "doc.text").mapInArrow(places, "row_id long, at int, key binary")
    hits = placed.join(frequent, "key", "left_semi").groupBy("row_id").agg(F.collect_set("at").alias("at"))
    joined = rows.join(hits, "row_id", "left").select("doc.*", F.col("at").alias("_qm_at"))

    def cut(parts):
        for whole in parts:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                kept, n_lines, n_dropped = [], [], []
                for text, at in zip(
                    batch.column("text").to_pylist(), batch.column("_qm_at").to_pylist(), strict=True
                ):
                    lines, drop = line_keys(text)[0], set(at or ())
                    stay = [x for k, x in enumerate(lines) if k not in drop]
                    kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
                    n_lines.append(len(lines))
                    n_dropped.append(len(drop))
                yield _result(batch.drop_columns(["_qm_at"]), kept, n_lines, n_dropped)

    return joined.mapInArrow(cut, schema)


def query(docs: DataFrame) -> DataFrame:
    """Digest columns of op6."""
    return drop_frequent_lines(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("_qm_n_lines").alias("n_lines"),
        F.col("_qm_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, row_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)),
frequent AS (
  SELECT key FROM line WHERE length(key) >= {MIN_KEY} GROUP BY key HAVING count(DISTINCT row_id) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM line l LEFT JOIN frequent f ON l.key = f.key
GROUP BY row_id
"""
