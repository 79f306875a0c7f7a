"""Near-duplicate embeddings: an exact metric range join over pivot cells.

Distance is the angle, a metric. Every vector's home is the cell of its nearest pivot. If x (home p) and y (home
q) are within r, the triangle inequality gives d(x, q) <= d(x, p) + 2r, and d(x, q) lies within r of the range of
distances that q's own members have; a vector visits exactly the cells for which both hold. Of two cells only
one receives the other's visitors, so each pair is met once, and cells join independently: a cell's own
members are held, visitors stream past them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import discard, materialise
from quillmesh.llm.components import connected_components

COSINE = 0.9
#: Members of a cell, and of a block of a cell, on average, and pivots at most (they are fitted on the driver).
CELL = 8000
MAX_PIVOTS = 4096
#: Single precision decides outside this margin of the threshold, double precision inside.
MARGIN = 1e-4
SLACK = 1e-9


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(x: np.ndarray, x32: np.ndarray, y: np.ndarray, y32: np.ndarray, cosine: float) -> np.ndarray:
    """Boolean matrix of links between the rows of two sets of unit vectors."""
    near = x32 @ y32.T
    link = near >= cosine
    i, j = np.nonzero(np.abs(near - np.float32(cosine)) <= MARGIN)
    link[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
    return link


def _dealt(cls: np.ndarray) -> np.ndarray:
    """A number that deals members to blocks."""
    mixed = cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(33)).astype(np.int64)


class _Roots:
    """Union-find on arrays; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.up[i], self.up[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.up[self.up]
                if (up == self.up).all():
                    break
                self.up = up


class _Cell:
    """One cell: its members, then its visitors in batches. Yields ``(class, links, root class)``."""

    def __init__(self, cosine: float):
        self.cosine, self.parts, self.ready = cosine, [], False

    def add(self, cls: np.ndarray, copies: np.ndarray, x: np.ndarray, visitor: bool):
        if not visitor:
            self.parts.append((cls, copies, x))
        else:
            self.close()
            yield self.visit(cls, copies, x)

    def close(self) -> None:
        if self.ready:
            return
        self.ready = True
        if not self.parts:
            self.cls, self.copies, self.x = np.empty(0, np.int64), np.empty(0, np.int64), None
            self.links = np.empty(0, np.int64)
            return
        self.cls, self.copies, self.x = map(np.concatenate, zip(*self.parts, strict=True))
        self.x32, n = self.x.astype(np.float32), len(self.cls)
        self.roots, self.links = _Roots(n), np.zeros(n, np.int64)
        for start in range(0, n, 512):
            link = _linked(self.x[start : start + 512], self.x32[start : start + 512], self.x, self.x32, self.cosine)
            i, j = np.nonzero(link)
            other = i + start != j
            i, j = i[other] + start, j[other]
            self.links += np.bincount(i, self.copies[j], n).astype(np.int64)
            self.roots.join(i, j)

    def visit(self, cls: np.ndarray, copies: np.ndarray, x: np.ndarray) -> tuple:
        links, root = np.zeros(len(cls), np.int64), cls.copy()
        if self.x is not None:
            x32 = x.astype(np.float32)
            for start in range(0, len(cls), 512):
                i, j = np.nonzero(
                    _linked(x[start : start + 512], x32[start : start + 512], self.x, self.x32, self.cosine)
                )
                i += start
                links += np.bincount(i, self.copies[j], len(cls)).astype(np.int64)
                self.links += np.bincount(j, copies[i], len(self.cls)).astype(np.int64)
                if len(i):
                    first = np.full(len(cls), -1)
                    first[i[::-1]] = j[::-1]
                    self.roots.join(first[i], j)
                    hit = np.unique(i)
                    root[hit] = self.cls[first[hit]]
        return cls, links, root

    def end(self) -> tuple:
        self.close()
        return self.cls, self.links, self.cls[self.roots.up] if len(self.cls) else self.cls


def _range_join(classes: DataFrame, cosine: float) -> DataFrame:
    """``(cls, links, root)`` rows of all cells, from a materialised ``(cls, v binary, copies)`` of one dimension."""
    spark, r = classes.sparkSession, math.acos(cosine) + SLACK
    n = classes.count()
    sampled = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(min(MAX_PIVOTS, max(1, n // CELL)))
    pivots = _unit([bytes(p.v) for p in sampled.collect()])
    shared = spark.sparkContext.broadcast(pivots)

    def angles(raw: list[bytes]) -> np.ndarray:
        return np.arccos(np.clip(_unit(raw) @ shared.value.T, -1, 1))

    def homes(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                d = angles(part.column("v").to_pylist())
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], ["home", "d"]
                )

    ranges = classes.select("v").mapInArrow(homes, "home int, d double").groupBy("home").agg(
        F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")
    )
    low, high, blocks = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.ones(len(pivots), np.int64)
    for row in ranges.collect():
        low[row["home"]], high[row["home"]], blocks[row["home"]] = row["low"], row["high"], -(-row["n"] // CELL)
    bounds = spark.sparkContext.broadcast((low, high, blocks))

    def spread(batches):
        low, high, blocks = bounds.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                d = angles(part.column("v").to_pylist())
                rows = np.arange(len(d))
                home = d.argmin(axis=1)
                cells = np.arange(d.shape[1])
                turn = (cells[None, :] > home[:, None]) ^ ((cells[None, :] + home[:, None]) % 2 == 1)
                go = (d <= d[rows, home][:, None] + 2 * r) & (d >= low - r) & (d <= high + r) & turn
                go[rows, home] = True
                i, cell = np.nonzero(go)
                at_home = cell == home[i]
                cls = part.column("cls").to_numpy(zero_copy_only=False)
                own = np.where(at_home, _dealt(cls)[i] % blocks[cell], 0)
                each = blocks[cell] - own
                k = np.repeat(np.arange(len(i)), each)
                ahead = np.arange(len(k)) - np.repeat(np.cumsum(each) - each, each)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((cell[k] << 32) + own[k] + ahead),
                        pa.array(~(at_home[k] & (ahead == 0))),
                        *(part.column(c).take(pa.array(i[k])) for c in ("cls", "copies", "v")),
                    ],
                    ["cell", "visitor", "cls", "copies", "v"],
                )

    def join(batches):
        now, cell = None, None
        schema = ["cls", "links", "root"]
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                key = batch.column("cell").to_numpy(zero_copy_only=False) * 2 + batch.column("visitor").to_numpy(zero_copy_only=False)
                cls, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "copies"))
                x = _unit(batch.column("v").to_pylist())
                cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if key[a] // 2 != now:
                        if cell is not None:
                            yield pa.RecordBatch.from_arrays(list(map(pa.array, cell.end())), schema)
                        now, cell = key[a] // 2, _Cell(cosine)
                    for out in cell.add(cls[a:b], copies[a:b], x[a:b], key[a] % 2 == 1):
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), schema)
        if cell is not None:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cell.end())), schema)

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(blocks.sum()))
    return (
        classes.mapInArrow(spread, "cell long, visitor boolean, cls long, copies long, v binary")
        .repartition(width, "cell")
        .sortWithinPartitions("cell", "visitor")
        .mapInArrow(join, "cls long, links long, root long")
    )


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, embedding, ...)``.

    Links are all pairs of rows with cosine >= ``cosine`` in double precision. Vectors that are null, empty or
    zero, or hold null or non-finite components, link with nothing, and so do vectors of different lengths.
    Equal vectors are one class with a number of copies; its copies link with one another. Rows that repeat a
    vec_id are rows of their own; kept is whether vec_id is its component's smallest.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0)
    fine = fine & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                raw = [np.array(v, "<f8").tobytes() if v is not None else None for v in part.column("embedding").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "v"])

    rows = materialise(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(F.coalesce(fine, F.lit(False)), e.cast("array<double>")).alias("embedding"),
        ).mapInArrow(pack, "vec_id long, v binary"),
        "vectors-rows",
    )
    keyed = rows.withColumn("k", F.sha2("v", 256))
    classes = materialise(
        keyed.filter("v IS NOT NULL")
        .groupBy("k")
        .agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("cls", F.monotonically_increasing_id())
        .withColumn("size", F.length("v")),
        "vectors-classes",
    )
    joined = None
    for row in classes.select("size").distinct().collect():
        own = _range_join(classes.filter(F.col("size") == row["size"]).select("cls", "v", "copies"), cosine)
        joined = own if joined is None else joined.union(own)
    joined = materialise(
        joined if joined is not None else spark.createDataFrame([], "cls long, links long, root long"), "vectors-joined"
    )
    counts = joined.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = connected_components(joined.select(F.col("cls").alias("u"), F.col("root").alias("v")), "vectors-cc")
    labelled = classes.select("cls", "k", "copies", "first_id").join(
        linked.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("label", F.coalesce("label", "cls"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = materialise(
        labelled.join(smallest, "label").join(counts, "cls").select(
            "k", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id"
        ),
        "vectors-found",
    )
    discard(joined)
    return keyed.select("vec_id", "k").join(found, "k", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(vectors: DataFrame) -> DataFrame:
    """Digest columns of op5."""
    return near_vectors(vectors)


ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (
  SELECT i, vec_id, e FROM rows WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.i, b.i AS j FROM fine a, fine b WHERE a.i <> b.i AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT i, i AS j FROM rows UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
least AS (SELECT r.i, min(v.vec_id) AS component_id FROM reach r JOIN rows v ON v.i = r.j GROUP BY r.i)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.i = v.i) AS n_links, coalesce(component_id, vec_id) AS component_id,
  vec_id IS NOT DISTINCT FROM coalesce(component_id, vec_id) AS kept
FROM rows v JOIN least USING (i)
"""
