"""Vector retrieval: scores, diversified top-k, budgeted context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import refs
from quillmesh.functions.text import first_filled
from quillmesh.functions.vectors import dot, is_valid, norm

TOP_K, PER_SOURCE = 3, 1
SOURCE_CHARS, TOTAL_CHARS = 4000, 15_000
#: Queries whose vectors the driver holds at once.
QUERY_BLOCK = 20_000
#: What the fast product may be off by; closer calls are decided by an exact sum.
MARGIN = 1e-9
#: Parts that the rows of one group are dealt to before their sizes are summed.
PARTS = 64


def with_scores(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """Cosine to one query vector, carried as a literal: no join."""
    if not query or not any(query):
        raise ValueError("the query vector is empty or zero")
    q = F.array(*map(F.lit, map(float, query)))
    n = sum(x * x for x in map(float, query)) ** 0.5
    return vectors.filter(is_valid(F.col(column), len(query))).withColumn(
        "score", dot(F.col(column), q) / (norm(F.col(column)) * F.lit(n))
    )


class _Best:
    """The best ``k`` rows of each query and source among those seen by one task, by score, then id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k, self.held, self.rows = queries, k, [], 0

    def add(self, ids: np.ndarray, sources: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(sources, kind="stable")
        ids, sources, x = ids[order], sources[order], x[order]
        near = x @ self.queries.T
        cuts = np.flatnonzero(np.concatenate([[True], sources[1:] != sources[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = near[a:b]
            least = np.partition(part, -self.k, axis=0)[-self.k] - MARGIN if b - a > self.k else np.full(part.shape[1], -2.0)
            i, q = np.nonzero(part >= least)
            i += a
            exact = np.einsum("ij,ij->i", x[i], self.queries[q])
            self.held.append((q, sources[i], exact, ids[i]))
            self.rows += len(i)
        if self.rows > 64 * self.k * len(self.queries) + 100_000:
            self.held = [self.best()]
            self.rows = len(self.held[0][0])

    def best(self) -> tuple[np.ndarray, ...]:
        q, source, score, ids = map(np.concatenate, zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, source, q))
        q, source, score, ids = q[order], source[order], score[order], ids[order]
        start = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (source[1:] != source[:-1])]))
        rank = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
        keep = rank < self.k
        return q[keep], source[keep], score[keep], ids[keep]


def best_of_queries(vectors: DataFrame, queries: DataFrame, k: int, source: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, vec_id, source, score)``: of each query ``(query_id, query)`` the best ``k`` rows of
    ``vectors(vec_id, embedding, ...)`` by cosine, then id; with ``source`` (an integer column) the best ``k`` of each source.

    Queries go against all rows in blocks of at most ``block``, whose matrix is sent to the workers. A worker keeps
    its own best rows only, so what is shuffled is ``k`` rows for a query and task and never all pairs. Vectors of
    another length than the queries, or that are zero or not finite, are left out.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // block))
    own = vectors.select("vec_id", (F.col(source) if source else F.lit(0)).cast("long").alias("source"), "embedding")
    out = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "query").collect()
        lengths = {len(r["query"]) for r in rows}
        if len(lengths) > 1:
            raise ValueError("queries of one block have one length")
        for n in lengths:
            q = np.array([r["query"] for r in rows], np.float64)
            shared = spark.sparkContext.broadcast((q / np.linalg.norm(q, axis=1, keepdims=True), np.array([r["query_id"] for r in rows])))
            found = own.filter(is_valid(F.col("embedding"), n)).mapInArrow(_searched(shared, k), "query_id long, vec_id long, source long, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, source long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    ranked = out.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(*order)))
    return ranked.filter(F.col("_n") <= k).drop("_n")


def _searched(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names = shared.value
        best = _Best(queries, k)
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
                x = flat.astype(np.float64).reshape(batch.num_rows, -1)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                best.add(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "source")), x)
        if best.held:
            q, source, score, ids = best.best()
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids), pa.array(source), pa.array(score)], ["query_id", "vec_id", "source", "score"])

    return run


def top_k(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    """Best k by score, then id; k below 1 counts as 1."""
    return scored.orderBy(F.desc("score"), F.asc(id_col)).limit(max(1, k))


def diversified(
    scored: DataFrame, k: int = TOP_K, cap: int = PER_SOURCE, source: str = "source_id", id_col: str = "chunk_id", by: list[str] = ()
) -> DataFrame:
    """Best k with at most ``cap`` of a source, rows without source left out; ``rank`` from 1, per ``by`` group."""
    filled = scored.filter(F.col(source).isNotNull() & (F.col(source).cast("string") != ""))
    order = [F.desc("score"), F.asc(id_col)]
    inside = Window.partitionBy(*by, source).orderBy(*order)
    capped = filled.withColumn("_n", F.row_number().over(inside)).filter(F.col("_n") <= cap).drop("_n")
    if not by:
        best = capped.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    whole = Window.partitionBy(*by).orderBy(*order)
    return capped.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def budgeted(
    df: DataFrame, by: list[str], order: list[Column], text: str, per_source: int = SOURCE_CHARS, total: int = TOTAL_CHARS, id_col: str | None = None
) -> DataFrame:
    """Adds ``used`` (characters before) and ``shown`` (text cut to both budgets); rows beyond the total go.

    With ``id_col``, which has to be unique, only ids and lengths are ordered: a group's rows are dealt to PARTS, a part
    drops what is beyond the budget by its own rows alone, and the texts of the few that are left are joined. Without
    it groups should be small, as ranked results are."""
    before = lambda *more: Window.partitionBy(*by, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = lambda *more: F.coalesce(F.sum("_size").over(before(*more)), F.lit(0))
    sized = df.withColumn("_size", F.least(F.length(text), F.lit(per_source)))
    if id_col is None:
        out = sized.withColumn("used", used()).filter(F.col("used") < total)
    else:
        few = sized.drop(text).withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(PARTS))).withColumn("_own", used("_part"))
        cut = few.filter(F.col("_own") < total).withColumn("used", used()).filter(F.col("used") < total)
        out = cut.drop("_part", "_own").join(df.select(id_col, text), id_col)
    room = F.least(F.lit(per_source), F.lit(total) - F.col("used"))
    return out.withColumn("shown", F.substr(F.col(text), F.lit(1), room.cast("int"))).drop("_size")


#: The text that a question is searched by, and the fields of a block of evidence.
QUERY_TEXT = "Biblical passage: {reference}\nBible-study question: {question}"
EVIDENCE = (("Title", "title"), ("Source", "source_name"), ("Biblical reference", "reference"), ("URL", "url"))
RETRIEVED = "rank int, score double, chunk_id string, source_id string, source_name string, title string, url string, license string, reference string, text string"


def query_text(reference: str, question: str) -> str:
    """What is embedded for a question about a passage."""
    return QUERY_TEXT.format(reference=reference, question=question)


def retrieve(index: DataFrame, passage: tuple[str, int, int, int], query: list[float], k: int = TOP_K, cap: int = PER_SOURCE) -> DataFrame:
    """RETRIEVED rows of an index of chunks for a query about ``passage`` (book, chapter, first and last verse): the
    scope first, then scores, at most ``cap`` of a source. Raises if no chunk may serve the passage."""
    if k < 1:
        raise ValueError("k is at least 1")
    scoped = index.filter(refs.matches_passage(*passage))
    if scoped.isEmpty():
        raise LookupError(f"no chunk of the index serves {passage}")
    # Only what is ranked is carried; the texts of the winners are joined at the end.
    best = diversified(with_scores(scoped.select("chunk_id", "source_id", "embedding"), query).drop("embedding"), k, cap)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    reference = refs.format_reference(F.col("book"), F.col("chapter"), F.col("verse_start"), F.col("verse_end"))
    return index.drop("source_id", "embedding").join(F.broadcast(best), "chunk_id").select(
        F.col("rank").cast("int").alias("rank"), "score", "chunk_id", "source_id", F.coalesce("source_name", "source_id").alias("source_name"),
        text("title").alias("title"), F.coalesce(first_filled(F.col("canonical_url"), F.col("url")), F.lit("")).alias("url"),
        text("license").alias("license"), F.coalesce(reference, F.lit("")).alias("reference"), text("text").alias("text"),
    )


def evidence(sources: DataFrame, by: list[str] = ()) -> DataFrame:
    """``(by..., context)`` of RETRIEVED rows, within the budgets."""
    grouped = sources if by else sources.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    return context(budgeted(grouped, keys, [F.col("rank")], "text"), keys, list(EVIDENCE)).drop("_all")


def context(shown: DataFrame, by: list[str], fields: list[tuple[str, str]]) -> DataFrame:
    """One labelled text per group: blocks ``[S<rank>]`` in rank order."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in fields]
    block = F.concat_ws("\n", F.concat(F.lit("[S"), F.col("rank"), F.lit("]")), *lines, F.concat(F.lit("Content:\n"), F.col("shown")))
    blocks = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), block.alias("b"))))
    return shown.groupBy(*by).agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))


def pass_rate(hits: DataFrame, case: str, hit: str) -> DataFrame:
    """Share of cases with at least one hit."""
    return hits.groupBy(case).agg(F.bool_or(hit).alias("passed")).agg(
        F.sum(F.col("passed").cast("int")).cast("long").alias("passed"), F.count(F.lit(1)).alias("cases"), F.avg(F.col("passed").cast("double")).alias("rate")
    )


def check_conditions(answers: DataFrame) -> DataFrame:
    """Rows that break the rule: baseline answers have no sources, retrieval answers at least one."""
    n = F.coalesce(F.size("sources"), F.lit(0))
    return answers.filter(((F.col("condition") == "baseline") & (n != 0)) | ((F.col("condition") == "rag") & (n < 1)))
