"""Mixing sources to target weights, in fixed-length blocks of words.

Each source's words, in a fixed order of its documents, are cut into blocks of BLOCK words. The mix is a
sequence of slots in output shards: for each shard the number of slots of each source is a multinomial draw
with the weights that the source's remaining quota has; the k-th slot of a source takes the block to which a
pseudorandom permutation of the source's block numbers maps k (a new permutation each time all its blocks are
used up), and blocks are then joined to documents by number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import WS_CHARS, WS_CLASS, materialise, with_row_id, word_count

BLOCK = 64
SEED = 20240521
#: Weights of the sources in code-point order, repeating; the mix's share of all sizes; the most of a source.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Slots of a shard at least, and shards at most: what is drawn on the driver is bounded by shards x sources.
SHARD_SLOTS = 256
MAX_SHARDS = 4096
BUCKET_ROWS = 20_000
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source in the mix. Weights go by code point, null last; targets above ``most`` times
    their source's size stop there and the excess is shared again by weight until none is above."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0] is None, sizes[i][0] or ""))
    weight = np.zeros(len(sizes))
    for rank, i in enumerate(order):
        weight[i] = weights[rank % len(weights)]
    cap = np.array([most * n for _, n in sizes], float)
    out = np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    budget = share * sum(n for _, n in sizes)
    while free.any():
        out[free] = budget * weight[free] / weight[free].sum()
        over = free & (out > cap)
        if not over.any():
            break
        out[over] = cap[over]
        budget -= cap[over].sum()
        free &= ~over
    return out.tolist()


def draw_shards(quota: np.ndarray, seed: int = SEED) -> np.ndarray:
    """``counts[shard, source]``: multinomial draws that end with each source's quota used exactly."""
    left, rng = quota.astype(np.int64).copy(), np.random.default_rng(seed)
    total = int(left.sum())
    width = max(SHARD_SLOTS, -(-total // MAX_SHARDS))
    shards = []
    while total:
        want, got = min(width, total), np.zeros_like(left)
        while want:
            more = np.minimum(rng.multinomial(want, left / left.sum()), left)
            got, left = got + more, left - more
            want -= int(more.sum())
        shards.append(got)
        total -= int(got.sum())
    return np.array(shards, np.int64).reshape(len(shards), len(quota))


def permute(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1 chosen by ``key``, at ``k``: a four-round Feistel network, walked until it
    falls below n."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    low = np.uint64((1 << half) - 1)
    x = k.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        y = x[todo]
        left, right = y >> np.uint64(half), y & low
        for r in range(4):
            z = right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & low)
        y = (left << np.uint64(half)) | right
        x[todo] = y
        todo = todo[y >= n]
    return x.astype(np.int64)


def _plan(rows: DataFrame, block: int, seed: int):
    """The dimension of sources (one entry each) and the shards drawn for them."""
    sizes = sorted(
        ((r.source, r.size) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()),
        key=lambda s: (s[0] is None, s[0] or ""),
    )
    want = targets(sizes)
    blocks = np.array([-(-n // block) for _, n in sizes], np.int64)
    quota = np.array([round(t * b / n) if n else 0 for t, b, (_, n) in zip(want, blocks, sizes, strict=True)], np.int64)
    return sizes, want, blocks, draw_shards(np.minimum(quota, int(MOST) * blocks), seed)


def _dimension(spark, sizes, want) -> DataFrame:
    """``(source, at, source_size, target)``, one row for each source; to be broadcast if that is few."""
    dim = spark.createDataFrame(
        [(s, i, n, t) for i, ((s, n), t) in enumerate(zip(sizes, want, strict=True))],
        "source string, at int, source_size long, target double",
    )
    return F.broadcast(dim) if len(sizes) <= BROADCAST_SOURCES else dim


def mix_blocks(rows: DataFrame, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of ``rows(row_id, doc_id, source, size, tie)``, a materialised table.

    Returns ``(row_id, source, at, start, length, shard, slot, epoch)``, one row for each part of a document in a
    slot (``start`` counts its words from 0), and ``(source, at, source_size, target)``, one row for each source.
    """
    spark = rows.sparkSession
    sizes, want, blocks, counts = _plan(rows, block, seed)
    dim = _dimension(spark, sizes, want)
    before = np.cumsum(counts, axis=0) - counts
    drawn = spark.createDataFrame(
        [(i, int(s), int(counts[i, s]), int(before[i, s]), int(blocks[s])) for i in range(len(counts)) for s in np.flatnonzero(counts[i])],
        "shard int, at int, n long, first long, blocks long",
    )

    def slots(batches):
        for batch in batches:
            for r in batch.to_pylist():
                for start in range(0, r["n"], 65_536):
                    k = np.arange(r["first"] + start, r["first"] + min(r["n"], start + 65_536))
                    epoch, inner = np.divmod(k, r["blocks"])
                    number = np.empty(len(k), np.int64)
                    for e in np.unique(epoch):
                        own = epoch == e
                        number[own] = permute(inner[own], r["blocks"], (seed * 31 + r["at"]) * 1009 + int(e))
                    same = np.full(len(k), r["shard"], np.int32), np.full(len(k), r["at"], np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, same), pa.array(k), pa.array(epoch.astype(np.int32)), pa.array(number)],
                        ["shard", "at", "slot", "epoch", "block"],
                    )

    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slotted = drawn.repartition(wide, "shard").mapInArrow(slots, "shard int, at int, slot long, epoch int, block long")
    n = rows.count()
    buckets = max(8, n // BUCKET_ROWS)
    placed = rows.join(dim.select("source", "at"), rows["source"].eqNullSafe(dim["source"])).select(
        "row_id", "doc_id", "at", "size", "tie", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)).alias("bucket")
    )
    until = Window.unboundedPreceding, -1
    by_bucket = placed.groupBy("at", "bucket").agg(F.sum("size").alias("size"))
    offsets = by_bucket.select(
        "at",
        "bucket",
        F.coalesce(F.sum("size").over(Window.partitionBy("at").orderBy("bucket").rowsBetween(*until)), F.lit(0)).alias("g"),
    )
    inside = Window.partitionBy("at", "bucket").orderBy("doc_id", "tie", "row_id").rowsBetween(*until)
    ranged = (
        placed.withColumn("i", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["at", "bucket"])
        .filter("size > 0")
        .select("row_id", "at", "size", (F.col("g") + F.col("i")).alias("g"))
    )
    pieces = ranged.select(
        "*", F.explode(F.expr(f"sequence(g div {block}, (g + size - 1) div {block})")).alias("block")
    ).select(
        "row_id",
        "at",
        "block",
        F.greatest(F.col("block") * block - F.col("g"), F.lit(0)).alias("start"),
        F.least((F.col("block") + 1) * block - F.col("g"), F.col("size")).alias("end"),
    )
    # Never broadcast, whatever the threshold: the plan's estimate of the slots is the size of what they are drawn from.
    taken = pieces.join(slotted.hint("merge"), ["at", "block"]).select(
        "row_id", "at", "start", (F.col("end") - F.col("start")).alias("length"), "shard", "slot", "epoch"
    )
    return taken, dim


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        "row_id",
        "doc_id",
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("tie"),
    )


def taken_by_document(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs``; blank or null texts have size 0
    and nothing taken, a null source is a source of its own, rows that repeat a doc_id are documents each."""
    rows = materialise(_rows(with_row_id(docs.select("doc_id", "source", "text"))), "mixing-rows")
    taken, dim = mix_blocks(rows, block, seed)
    sums = taken.groupBy("row_id").agg(F.sum("length").alias("taken"))
    return (
        rows.join(dim, rows["source"].eqNullSafe(dim["source"]))
        .join(sums, "row_id", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row for each document and pass over its source
    in which words of it are taken. A document taken whole keeps its text as it is; else the text is the taken
    words, joined by spaces."""
    columns = docs.columns
    whole = materialise(
        with_row_id(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"))), "mixing-docs"
    )
    rows = materialise(_rows(whole.select("row_id", "doc.doc_id", "doc.source", "doc.text")), "mixing-rows")
    taken, _ = mix_blocks(rows, block, seed)
    ranges = taken.groupBy("row_id", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("parts"), F.sum("length").alias("taken")
    )
    words = F.split(F.btrim("doc.text", F.lit(WS_CHARS)), f"{WS_CLASS}+")
    chosen = F.array_join(
        F.flatten(F.transform("parts", lambda p: F.slice("words", (p["start"] + 1).cast("int"), p["length"].cast("int")))), " "
    )
    # Both tables have a row for each document; by the size of their compressed files they would be broadcast.
    joined = ranges.join(rows.select("row_id", "size").hint("merge"), "row_id").join(whole.hint("merge"), "row_id")
    # words is named twice below: a column named once would be inlined, and split again for each part.
    texts = joined.withColumn("words", F.when(F.col("taken") < F.col("size"), words)).withColumn(
        "chosen", F.when(F.size("words") > 0, chosen).otherwise(F.col("doc.text"))
    )
    return texts.select(*[F.col("chosen" if c == "text" else f"doc.`{c}`").alias(c) for c in columns])


def query(docs: DataFrame) -> DataFrame:
    """Digest columns of op4."""
    return taken_by_document(docs)


def source_targets(docs: DataFrame) -> DataFrame:
    """``(source, source_size, target)``: the plan alone, which SQL can say; targets to three digits."""
    rows = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sizes, want, _, _ = _plan(rows, BLOCK, SEED)
    return _dimension(docs.sparkSession, sizes, want).select("source", "source_size", F.round("target", 3).alias("target"))


_WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
TARGETS_ORACLE = rf"""
WITH sized AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')))::BIGINT AS source_size FROM documents GROUP BY source),
weighed AS (
  SELECT *, {MOST} * source_size AS most, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % {len(WEIGHTS)} {_WEIGHT} END::DOUBLE AS w FROM sized),
-- Sources reach their most in the order of most / weight; the level is that of the first that does not.
levels AS (
  SELECT *, ({SHARE} * sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, source_size, round(least(most, w * (SELECT coalesce(max(level) FILTER (w * level <= most), 1e300) FROM levels)), 3) AS target FROM levels
""".replace(' COLLATE "C"', "")
