"""Five stages from raw documents to packed sequences; part of the training-data subpackage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``documents``: other columns are left out, a column that is missing is null (``text`` has to be there).
In every stage a row is a document of its own, also one that repeats a doc_id or has none; an empty table gives an empty
one; texts of any length are read whole. What a null or empty text means is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import lines, mixing, packing, quality, simhash
from quillmesh.llm.common import documents, materialise

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, whatever else a table has or lacks."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()])


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars the length of the text as it now is."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. A null or empty text has no words and goes; equal rows stay or go alike."""
    return _as_documents(quality.accepted(_documents(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share. None goes: a text that loses all its lines, and a
    null one, become empty. Rows that repeat a doc_id count as documents each."""
    return _as_documents(lines.drop_frequent_lines(_documents(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id, of rows with that id the one with the
    smallest text, of equal rows the first; a row without id stays only if its group has none with one. Null and empty
    texts are one group, of fingerprint zero."""
    return _as_documents(simhash.keep_first(_documents(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document is there once for each pass that takes words of it. Texts
    without words are in no block and so not in the mix; a null source is a source of its own, the last."""
    return _as_documents(mixing.mixed_documents(_documents(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens; a null or empty text is its separator alone."""
    return packing.query(_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Fingerprints, permutations and tokens are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
