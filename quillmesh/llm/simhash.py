"""Near-duplicate documents: SimHash fingerprints joined through vantage-point trees.

A pair within ``radius`` bits of 64 differs in at most ``radius // 3`` bits of one of three bands. One
vantage-point tree per band halves the space by the Hamming distance to a vantage point. A fingerprint
goes to the side its distance says and, when it lies outside by no more than the band radius, to the inside
too: by the triangle inequality no linked pair is then kept apart, and no other branch has to be visited.
Every leaf is a shard; shards find their exact pairs on the whole 64 bits independently.

A dense group (thousands of near copies) cannot be split by any metric partition. Centres of such groups are
found on a bounded sample; fingerprints linked to a centre leave the shards and are joined as one star, and
only what lies near another group's centre is probed against that group's members.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import discard, materialise, text_slices, with_row_id
from quillmesh.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
#: (shift, bits) of the three bands of a fingerprint.
BANDS = ((42, 22), (21, 21), (0, 21))
#: Bounds of what is fitted on the driver: fingerprints sampled, tree depth, and centres of dense groups.
SAMPLE = 32_768
MAX_DEPTH = 18
MAX_CENTRES = 256
#: Sampled fingerprints within the radius that make a centre.
DENSE = 24
LEAF = 32
#: Fingerprints of a shard that are all compared; a fuller shard is split again. Members of a part that are
#: compared by their distance in order.
FULL = 4096
SMALL = 48


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of a text: majority of the bits of XXH64 over its word shingles, repeats included.

    A-Z count as lower case; fewer words than a shingle has: the whole sequence; no words or null: zero.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 65_536):
        part = words[start : start + 65_536 + shingle_words - 1]
        if len(words) <= shingle_words:
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle_words)), strict=False))
        hashes = np.array(list(map(xxh64_intdigest, shingles, repeat(SEED))), dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, row_ids: bool = False) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``; fp is the fingerprint as a signed long. With row_ids,
    ``docs`` has a ``row_id``, which is passed on."""
    ids = [F.col("doc_id").cast("long").alias("doc_id"), *([F.col("row_id")] if row_ids else [])]
    names = ["doc_id", "row_id"][: len(ids)]

    def run(batches):
        for batch in batches:
            for *kept, texts in text_slices(batch, [*names, "text"]):
                fps = np.array([fingerprint(t, shingle_words) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in kept), pa.array(fps)], [*names, "fp"])

    return docs.select(*ids, "text").mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


class VantageTree:
    """A complete binary vantage-point tree over one band; nodes in breadth-first order."""

    def __init__(self, sample: np.ndarray, bits: int, depth: int, radius: int):
        self.bits, self.depth, self.radius = bits, depth, radius
        draw = np.random.default_rng(bits * 1009 + depth)
        nodes = 2**depth - 1
        self.vantage = draw.integers(0, 2**bits, nodes).astype(np.uint32)
        self.limit = np.full(nodes, bits // 2 - (bits % 2 == 0), np.uint8)
        points, node = draw.permutation(sample.astype(np.uint32)), np.zeros(len(sample), np.int64)
        for _ in range(depth):
            if not len(points):
                break
            order = np.argsort(node, kind="stable")
            points, node = points[order], node[order]
            own, first, count = np.unique(node, return_index=True, return_counts=True)
            fitted = count >= 8
            self.vantage[own[fitted]] = points[first[fitted]]
            far = np.bitwise_count(points ^ self.vantage[node])
            by_far = far[np.lexsort((far, node))]
            self.limit[own[fitted]] = np.maximum(by_far[first + (count - 1) // 2][fitted].astype(np.int16), radius)
            node = 2 * node + 1 + (far > self.limit[node])

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves of all shards that each point belongs to."""
        row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            far = np.bitwise_count(points[row] ^ self.vantage[node])
            limit = self.limit[node]
            outside = far > limit
            both = outside & (far <= limit + self.radius)
            node, row = (
                np.concatenate([2 * node + 1 + outside, 2 * node[both] + 1]),
                np.concatenate([row, row[both]]),
            )
        return row, node - (2**self.depth - 1)


class Forest:
    """The three trees of a fingerprint set."""

    def __init__(self, sample: np.ndarray, n: int, radius: int = RADIUS, leaf: int = LEAF):
        self.depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(1, n) / leaf)))))
        self.trees = [
            VantageTree((sample >> np.uint64(s)) & np.uint64(2**b - 1), b, self.depth, radius // len(BANDS))
            for s, b in BANDS
        ]

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, shards = [], []
        for i, ((shift, bits), tree) in enumerate(zip(BANDS, self.trees, strict=True)):
            row, leaf = tree.route(((fps >> np.uint64(shift)) & np.uint64(2**bits - 1)).astype(np.uint32))
            rows.append(row)
            shards.append(leaf + (i << self.depth))
        return np.concatenate(rows), np.concatenate(shards)


def shard_links(x: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join the linked fingerprints of one shard. Those of a full shard are parted again: of radius +
    1 disjoint groups of the bits that vary in it, linked fingerprints have one in common, so pairs are looked for
    among those that agree in a group. Shards of any size thus stay far from all pairs unless they are dense."""
    n = len(x)
    if n <= FULL:
        return _all_links(x, radius)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 65_536):
        ones += np.unpackbits(x[start : start + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.argsort(np.abs(2 * ones - n), kind="stable")
    bits = bits[(ones[bits] > 0) & (ones[bits] < n)]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for group in range(radius + 1):
        key = np.zeros(n, np.uint64)
        for k, b in enumerate(bits[group :: radius + 1].tolist()):
            key |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
        order = np.argsort(key, kind="stable")
        y, key = x[order], key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(starts, append=n)
        for a, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            i, j = _all_links(y[a : a + size], radius)
            found.append((order[a + i], order[a + j]))
        few = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            i = np.flatnonzero(few[:-d] & (key[d:] == key[:-d]))
            i = i[np.bitwise_count(y[i] ^ y[i + d]) <= radius]
            found.append((order[i], order[i + d]))
    left, right = (np.concatenate(side) for side in zip(*found, strict=True))
    pairs = np.unique(np.minimum(left, right) * n + np.maximum(left, right))
    return pairs // n, pairs % n


def _all_links(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join linked fingerprints: all their links when they are few, else a spanning forest of them,
    found breadth-first over the fingerprints not yet reached."""
    n, budget = len(x), 8 * len(x)
    left, right, found = [], [], 0
    for start in range(0, n, 128):
        near = np.bitwise_count(x[start : start + 128, None] ^ x[None, start:]) <= radius
        i, j = np.divmod(np.flatnonzero(near), n - start)
        i, j = i[i < j], j[i < j]
        left.append(i + start)
        right.append(j + start)
        found += len(i)
        if found > budget:
            break
    else:
        return (np.concatenate(left), np.concatenate(right)) if n else (np.empty(0, int), np.empty(0, int))
    left, right = [], []
    rest = np.arange(n)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            some, front = front[:256], front[256:]
            near = np.bitwise_count(x[some, None] ^ x[None, rest]) <= radius
            hit = near.any(axis=0)
            left.append(some[near[:, hit].argmax(axis=0)])
            right.append(rest[hit])
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return np.concatenate(left), np.concatenate(right)


def dense_centres(sample: np.ndarray, forest: Forest, radius: int = RADIUS) -> np.ndarray:
    """Sampled fingerprints that have at least DENSE others of the sample within the radius, greedily chosen
    so that none covers another; the fullest first, MAX_CENTRES at most (what they miss stays in the shards)."""
    row, shard = forest.route(sample)
    order = np.argsort(shard, kind="stable")
    row, shard = row[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    found: dict[int, int] = {}
    for group in np.split(row, cuts):
        rest = sample[group]
        while len(rest) >= DENSE:
            near = np.bitwise_count(rest ^ rest[0]) <= radius
            if near.sum() >= DENSE:
                found[int(rest[0])] = int(near.sum())
                rest = rest[~near]
            else:
                rest = rest[1:]
    chosen: list[int] = []
    for c in sorted(found, key=lambda c: (-found[c], c)):
        if len(chosen) < MAX_CENTRES and all((c ^ k).bit_count() > radius for k in chosen):
            chosen.append(c)
    return np.array(chosen, np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Edges ``(u, v)`` over distinct fingerprints ``fp`` that have the same components as all their links.

    ``distinct`` must be a materialised table: it is read several times.
    """
    n = distinct.count()
    sample = np.array(
        [r.fp for r in distinct.select("fp", F.xxhash64("fp").alias("h")).orderBy("h", "fp").limit(SAMPLE).collect()],
        np.int64,
    ).view(np.uint64)
    forest = Forest(sample, n, radius, leaf)
    centres = dense_centres(sample, forest, radius)
    sc = distinct.sparkSession.sparkContext
    shared = sc.broadcast((forest, centres))

    def stars(batches):
        """Rows of a fingerprint: its star (kind 0), what it must probe (1), its group (2), or none (3)."""
        forest, centres = shared.value
        labels = np.arange(len(centres))
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(centres):
                yield pa.RecordBatch.from_arrays(
                    [_signed(x), pa.array(np.full(len(x), 3, np.int8)), _signed(np.zeros(len(x), np.int64))],
                    ["fp", "kind", "label"],
                )
                continue
            for start in range(0, len(x), 4096):
                y = x[start : start + 4096]
                far = np.bitwise_count(y[:, None] ^ centres[None, :])
                near = far <= radius
                own = np.where(near.any(axis=1), near.argmax(axis=1), -1)
                s_row, s_label = np.nonzero(near)
                p_row, p_label = np.nonzero((far <= 2 * radius) & ~near & (labels[None, :] != own[:, None]))
                member = np.flatnonzero(own >= 0)
                alone = np.flatnonzero(own < 0)
                row = np.concatenate([s_row, p_row, member, alone])
                kind = np.repeat(np.array([0, 1, 2, 3], np.int8), [len(s_row), len(p_row), len(member), len(alone)])
                label = np.concatenate([s_label, p_label, own[member], np.zeros(len(alone), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [_signed(y[row]), pa.array(kind), _signed(centres[label])], ["fp", "kind", "label"]
                )

    def route(batches):
        forest, _ = shared.value
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for start in range(0, len(x), 4096):
                row, shard = forest.route(x[start : start + 4096])
                row = row + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), _signed(x[row]), pa.array(label[row])], ["shard", "fp", "label"]
                )

    def pairs(batches):
        """Shards arrive in order, possibly cut by batches."""
        held_shard, held = None, []

        def out():
            x = np.concatenate(held)
            i, j = shard_links(x, radius)
            return pa.RecordBatch.from_arrays([_signed(x[i]), _signed(x[j])], ["u", "v"])

        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                if held and shard[a] != held_shard:
                    yield out()
                    held = []
                held_shard = shard[a]
                held.append(x[a:b].copy())
        if held:
            yield out()

    spread = "shard long, fp long, label long"
    parted = distinct.select("fp").mapInArrow(stars, "fp long, kind tinyint, label long")
    if len(centres):
        parted = materialise(parted, "simhash-parts")
    shards = parted.filter("kind = 3").select("fp", "label").mapInArrow(route, spread)
    width = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = (
        shards.select("shard", "fp").repartition(max(width, n // 100_000), "shard").sortWithinPartitions("shard")
    ).mapInArrow(pairs, "u long, v long")
    if len(centres):
        star = parted.filter("kind = 0").select(F.col("fp").alias("u"), F.col("label").alias("v"))
        probe = parted.filter("kind = 1").select("fp", "label").mapInArrow(route, spread).alias("p")
        group = parted.filter("kind = 2").select("fp", "label").mapInArrow(route, spread).alias("g")
        probed = probe.join(
            group,
            (F.col("p.shard") == F.col("g.shard"))
            & (F.col("p.label") == F.col("g.label"))
            & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("g.fp"))) <= radius),
            "left_semi",
        ).select(F.col("fp").alias("u"), F.col("label").alias("v"))
        edges = edges.union(star).union(probed)
    return edges


def simhash_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs(doc_id, text, ...)``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, the row's
    own included. A null or blank text has fingerprint zero, which links like any other. Equal texts share a
    fingerprint and so a group; rows that repeat a doc_id are rows of their own. A null doc_id counts as no
    candidate for the smallest. Columns other than doc_id and text are ignored; an empty table gives none.
    """
    prints = materialise(fingerprints(docs, shingle_words), "simhash-prints")
    return _grouped(prints, radius).select("doc_id", "fp", "component_id")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """``prints(doc_id, fp, ...)``, a materialised table, with the component's ``label`` and ``component_id``."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    linked = connected_components(fingerprint_links(distinct, radius), "simhash-cc")
    labelled = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )
    smallest = labelled.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    component = materialise(labelled.join(smallest, "label").select("fp", "label", "component_id"), "simhash-component")
    discard(distinct)
    return prints.join(component, "fp")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group: that with the smallest doc_id.

    Rows of a group that repeat its smallest doc_id are ordered by text and only the first stays; a row without
    doc_id stays only if its whole group has none, one per group. Rows of different groups never replace each
    other, also if they share a doc_id or have none."""
    rows = materialise(with_row_id(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))), "simhash-rows")
    prints = fingerprints(rows.select("doc.doc_id", "row_id", "doc.text"), row_ids=True)
    groups = _grouped(materialise(prints, "simhash-prints"), radius)
    # Of each group the rows with its smallest doc_id; their texts are read only where more than one is left.
    first = materialise(groups.filter("doc_id <=> component_id").select("row_id", "label"), "simhash-first")
    tied = first.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"))
    among = first.join(tied.filter("n > 1").select("label"), "label")
    texts = rows.select("row_id", F.col("doc.text").alias("text")).join(among, "row_id")
    # A minimum and not a window: a group of very many rows is a sum of partial minima.
    least = texts.groupBy("label").agg(F.min_by("row_id", F.struct(F.col("text").isNull(), "text", "row_id")).alias("row_id"))
    kept = tied.filter("n = 1").select("row_id").union(least.select("row_id"))
    return rows.join(kept, "row_id", "left_semi").select("doc.*")


def query(docs: DataFrame) -> DataFrame:
    """Digest columns of op1."""
    return simhash_groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
