"""Data-quality checks as rows ``(check, violations, examples)``, all from one pass where a row decides alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 10


def row_checks(df: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """One aggregate over the table; examples are the ten smallest ids that fail."""
    hit = {name: F.coalesce(c, F.lit(False)) for name, c in checks.items()}
    failing = F.filter(
        F.array(*[F.when(c, F.lit(name)) for name, c in hit.items()]), lambda x: x.isNotNull()
    )
    counts = df.agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, c in hit.items()])
    sums = counts.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("long").alias("violations")) for n in hit])).alias("s")
    ).select("s.*")
    bad = df.select(F.col(id_col).alias("id"), F.explode(failing).alias("check")).distinct()
    return sums.join(_examples(bad), "check", "left")


def _examples(bad: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    first = Window.partitionBy("check").orderBy("id")
    few = bad.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= EXAMPLES)
    return few.groupBy("check").agg(F.array_sort(F.collect_list("id")).alias("examples"))


def group_check(name: str, bad: DataFrame, id_col: str) -> DataFrame:
    """A check whose violations are the rows of ``bad``."""
    count = bad.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))
    return count.join(_examples(bad.select(F.lit(name).alias("check"), F.col(id_col).alias("id"))), "check", "left")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def set_differences(present: DataFrame, expected: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys missing and keys unexpected."""
    return expected.select(key).subtract(present.select(key)), present.select(key).subtract(expected.select(key))


def missing_keys(line: str, required: list[str]) -> Column:
    """Required keys that a JSON line lacks; a key with a null value is there."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(line), F.array().cast("array<string>")))


def publish_gate(failed: DataFrame) -> bool:
    """All or nothing: whether nothing failed."""
    return failed.isEmpty()


def profile(df: DataFrame, by: str, distinct: str, total: str) -> DataFrame:
    """Per group: rows, distinct values of one column and the sum of another."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(distinct).alias(f"{distinct}s"), F.sum(total).alias("total"))


def length_gates(df: DataFrame, by: str, text: str, least: tuple[int, ...]) -> DataFrame:
    """Per group: rows that each least length would let pass, as ``n<length>``."""
    return df.groupBy(by).agg(*[F.count_if(F.length(text) >= n).alias(f"n{n}") for n in least])


def conditional_counts(df: DataFrame, by: str, conditions: dict[str, Column]) -> DataFrame:
    """Per group: rows for which each condition holds, in one pass."""
    return df.groupBy(by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
