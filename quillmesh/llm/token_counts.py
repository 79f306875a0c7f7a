"""Token counts as delta-maintained rollups.

The ledger holds signed rows: an insert adds +1 row for a document and tokenizer version, a delete adds the same
row with -1, a revision both. Each batch also stores its rows summed by source, language and tokenizer
version. Totals are the sum of the batches' sums. An attempt at a batch writes a folder of its own; the batch becomes
visible by one rename of that folder to its id, which fails if the id is there: a replay does nothing, two
attempts cannot both count, and a failed one leaves nothing that is read. A snapshot, committed in the same way, sums
up the batches before it, so that ledger and deltas are read from it and from the batches since.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import materialise, table_path, text_slices
from quillmesh.llm.packing import WordEncoder, tokenizer_path

#: Tokenizer version -> a function that makes a counter in a worker.
Counters = dict[str, Callable[[], Callable[[str], int]]]
LEDGER = "doc_id long, tokenizer string, source string, lang string, sign int, n_tokens long"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
KEYS = ("source", "lang", "tokenizer")


def _subwords():
    encoder = WordEncoder(tokenizer_path())
    return lambda text: len(encoder.encode(text))


def _words():
    return lambda text: len(text.encode("utf-8", "surrogatepass").split())


COUNTERS: Counters = {"word_bpe_49k@1": _subwords, "words@1": _words}


def count_tokens(docs: DataFrame, counters: Counters) -> DataFrame:
    """``docs(doc_id, source, lang, text)`` to ``(doc_id, tokenizer, source, lang, n_tokens)``; null text: 0."""

    def run(batches):
        made = {k: make() for k, make in counters.items()}
        for batch in batches:
            for ids, sources, langs, texts in text_slices(batch, ["doc_id", "source", "lang", "text"]):
                for name, count in made.items():
                    n = [count(t) if t else 0 for t in texts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array([name] * len(n), pa.string()), pa.array(sources, pa.string()), pa.array(langs, pa.string()), pa.array(n, pa.int64())],
                        ["doc_id", "tokenizer", "source", "lang", "n_tokens"],
                    )

    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text"
    )
    return plain.mapInArrow(run, "doc_id long, tokenizer string, source string, lang string, n_tokens long")


class Rollup:
    """Totals kept in a folder of the shared store. A document is a doc_id; null ids are one document."""

    def __init__(self, spark: SparkSession, path: str | None = None, counters: Counters = COUNTERS):
        self.spark, self.path, self.counters = spark, path or table_path(spark, "rollup"), counters
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), conf)
        self._exclusive = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        for part in ("batches", "snapshots", "staged"):
            self._fs.mkdirs(self._at(f"{self.path}/{part}"))

    def _names(self, part: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/{part}")))

    def batches(self) -> list[str]:
        return self._names("batches")

    def _parts(self) -> tuple[list[str], list[str]]:
        """Folders that make up the state: the last snapshot, if any, and the batches since; and the batches summed up."""
        batches, snapshots = self.batches(), self._names("snapshots")
        if not snapshots:
            return [f"batches/{b}" for b in batches], []
        last = f"snapshots/{snapshots[-1]}"
        inside = [r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{last}/members").collect()]
        return [last, *(f"batches/{b}" for b in batches if b not in set(inside))], inside

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{p}/{kind}" for p in self._parts()[0]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _publish(self, staged: str, name: str) -> bool:
        """Renames an attempt's folder, or deletes it (False) if the name is taken."""
        try:
            self._context.rename(self._at(staged), self._at(f"{self.path}/{name}"), self._exclusive)
            return True
        except Py4JJavaError:
            if not self._fs.exists(self._at(f"{self.path}/{name}")):
                raise
            self._fs.delete(self._at(staged), True)
            return False

    def current(self, ids: DataFrame | None = None) -> DataFrame:
        """The ledger's live rows: ``(doc_id, tokenizer, source, lang, n_tokens, copies)``; of ``ids(gone_id)`` only,
        if given, which are then all that is summed."""
        rows = self._read("ledger", LEDGER)
        if ids is not None:
            rows = rows.join(ids, rows["doc_id"].eqNullSafe(ids["gone_id"]), "left_semi")
        return (
            rows.groupBy("doc_id", "tokenizer", "source", "lang", "n_tokens")
            .agg(F.sum("sign").alias("copies"))
            .filter("copies <> 0")
        )

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)``: sums of the batches' deltas, without empty groups."""
        return (
            self._read("delta", DELTA)
            .groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .filter("n_docs <> 0 OR n_tokens <> 0")
        )

    def commit(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, fresh: bool = False) -> bool:
        """Applies one batch, or nothing (False) if its id is already there.

        ``upserts(doc_id, source, lang, text)`` are inserted, or replace what the ledger has of their doc_ids;
        ``fresh`` says that the ledger has none of them. Rows that repeat a doc_id in one batch count each.
        ``deletes(doc_id)`` are taken out; ids that the ledger doesn't have change nothing.
        """
        if batch_id in self.batches():
            return False
        rows = self.spark.createDataFrame([], LEDGER)
        if upserts is not None:
            new = count_tokens(upserts, self.counters)
            rows = rows.unionByName(new.withColumn("sign", F.lit(1)))
        gone = [d.select(F.col("doc_id").cast("long").alias("gone_id")) for d in (deletes, None if fresh else upserts) if d is not None]
        if gone and self.batches():
            ids = (gone[0] if len(gone) == 1 else gone[0].union(gone[1])).distinct()
            old = self.current(ids)
            rows = rows.unionByName(
                old.select("doc_id", "tokenizer", "source", "lang", (-F.col("copies")).cast("int").alias("sign"), "n_tokens")
            )
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self._store(rows, staged)
        return self._publish(staged, f"batches/{batch_id}")

    def _store(self, rows: DataFrame, staged: str) -> None:
        rows.write.parquet(f"{staged}/ledger")
        self.spark.read.schema(LEDGER).parquet(f"{staged}/ledger").groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")
        ).write.parquet(f"{staged}/delta")

    def compact(self) -> bool:
        """Writes a snapshot of all batches so far: their live ledger rows, and those rows' sums. The ids stay known,
        so replays still do nothing; False if another compaction was first."""
        parts, inside = self._parts()
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        live = self.current().withColumn("sign", F.col("copies").cast("int"))
        self._store(live.select("doc_id", "tokenizer", "source", "lang", "sign", "n_tokens"), staged)
        names = inside + [p.removeprefix("batches/") for p in parts if p.startswith("batches/")]
        self.spark.createDataFrame([(b,) for b in names], "batch string").coalesce(1).write.parquet(f"{staged}/members")
        return self._publish(staged, f"snapshots/{len(self._names('snapshots')):08d}")

    def vacuum(self) -> None:
        """Deletes the rows of batches that the last snapshot sums up (their ids stay), older snapshots, and attempts
        that came to nothing. Not while others read or commit."""
        for b in self._parts()[1]:
            for kind in ("ledger", "delta"):
                self._fs.delete(self._at(f"{self.path}/batches/{b}/{kind}"), True)
        for old in [*(f"snapshots/{s}" for s in self._names("snapshots")[:-1]), *(f"staged/{s}" for s in self._names("staged"))]:
            self._fs.delete(self._at(f"{self.path}/{old}"), True)


WORDS_ORACLE = r"""
WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL),
live AS (SELECT source, lang, list_distinct(string_split(text, chr(10))) AS lines FROM firsts WHERE n = 1
  UNION ALL SELECT source, lang, [] FROM documents WHERE text IS NULL)
SELECT source, lang, count(*) AS n_docs,
  sum(coalesce(list_sum(list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))), 0))::BIGINT AS n_tokens
FROM live GROUP BY source, lang
"""


def words_query(docs: DataFrame) -> DataFrame:
    """The rollup of plain words alone, which SQL can say."""
    return query(docs).filter("tokenizer = 'words@1'").select("source", "lang", "n_docs", "n_tokens")


def query(docs: DataFrame) -> DataFrame:
    """The whole life of a table: all documents inserted in two batches; those whose text an earlier doc_id has
    deleted; those with repeated lines revised to their distinct lines; and the last two batches sent again, the last
    after a compaction.

    A null text counts no tokens; null sources and languages are groups of their own; documents without doc_id are one
    document, rows that repeat a doc_id in a batch count each. Texts that are equal are copies of the one with the
    smallest doc_id (ties, and rows without id, stay). An empty table gives no groups; other columns are ignored;
    texts are counted whole."""
    own = docs.select("doc_id", "source", "lang", "text")
    roll = Rollup(docs.sparkSession)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    roll.commit("0001", own.filter(half == 0), fresh=True)
    roll.commit("0002", own.filter(half == 1), fresh=True)
    prints = own.select("doc_id", F.sha2("text", 256).alias("h"))
    # Stored, so that the join deals both sides anew and a text of very many rows can be split among tasks.
    firsts = materialise(prints.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "rollup-firsts")
    copies = prints.join(firsts, "h").filter("doc_id > first_id").select("doc_id")
    lines = F.split("text", "\n")
    revised = own.filter(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn(
        "text", F.array_join(F.array_distinct(lines), "\n")
    ).join(copies, "doc_id", "left_anti")
    roll.commit("0003", deletes=copies)
    roll.commit("0004", upserts=revised)
    roll.commit("0003", deletes=copies)
    roll.compact()
    roll.commit("0004", upserts=revised)
    return roll.totals()
