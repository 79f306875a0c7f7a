"""Answering: condition dispatch, prompts, and the model seam, over a table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import canonical_condition, clean_answer
from quillmesh.operators import embedding

NO_CONTEXT = "NONE"
#: The labels of the user block, in order, and the limits of an answer.
LABELS = ("PASSAGE REFERENCE", "PASSAGE TEXT", "SOURCE CONTEXT", "USER QUESTION")
MAX_OUTPUT_TOKENS, THINKING = 700, "minimal"
MESSAGE = "struct<role: string, text: string>"


def prompt(question: Column, scope: Column, passage: Column, context: Column) -> Column:
    """The user block: scope, passage, evidence, question."""
    parts = zip(LABELS, (scope, passage, context, question), strict=True)
    return F.concat(F.concat_ws("\n\n", *[F.concat(F.lit(f"{label}:\n"), c) for label, c in parts]), F.lit("\n"))


def request(system: str, history: Column, block: Column, tokens: int = MAX_OUTPUT_TOKENS, thinking: str = THINKING) -> Column:
    """The JSON body of a generation call: system prompt, earlier messages that have a known role and a text, and the
    user block as the last message."""
    part = lambda text: F.array(F.struct(text.alias("text")))
    message = lambda role, text: F.struct(role.alias("role"), part(text).alias("parts"))
    told = F.filter(F.coalesce(history, F.array().cast(f"array<{MESSAGE}>")), lambda m: F.trim(m["role"]).isin("user", "model") & (F.trim(m["text"]) != ""))
    messages = F.concat(F.transform(told, lambda m: message(F.trim(m["role"]), F.trim(m["text"]))), F.array(message(F.lit("user"), block)))
    limits = F.struct(F.lit(tokens).alias("maxOutputTokens"), F.struct(F.lit(thinking).alias("thinkingLevel")).alias("thinkingConfig"))
    return F.to_json(F.struct(F.struct(part(F.lit(system)).alias("parts")).alias("systemInstruction"), messages.alias("contents"), limits.alias("generationConfig")))


def with_context(questions: DataFrame, contexts: DataFrame, key: str = "question_id") -> DataFrame:
    """Baseline questions get no evidence, retrieval ones their context; an unknown condition raises."""
    name = canonical_condition(F.col("condition"))
    told = F.when(name.isNotNull(), name).otherwise(F.raise_error(F.concat(F.lit("unknown condition "), F.col("condition"))))
    joined = questions.withColumn("condition", told).join(contexts.select(key, "context", "sources"), key, "left")
    rag = F.col("condition") == "rag"
    none = F.array().cast(contexts.schema["sources"].dataType)
    return joined.withColumn("context", F.when(rag, F.coalesce("context", F.lit(NO_CONTEXT))).otherwise(NO_CONTEXT)).withColumn(
        "sources", F.when(rag, F.coalesce("sources", none)).otherwise(none)
    )


def answer_questions(
    questions: DataFrame, contexts: DataFrame, model: Callable[[str], str], key: str = "question_id", system: str | None = None
) -> DataFrame:
    """Adds ``answer``, cleaned, and ``latency_ms``; questions are ``(key, condition, question, scope, passage)`` and may
    have a ``history`` of messages. With a ``system`` prompt the model gets the JSON of ``request``, else the block."""
    block = prompt(F.col("question"), F.col("scope"), F.col("passage"), F.col("context"))
    ready = with_context(questions, contexts, key)
    if system is not None:
        block = request(system, F.col("history") if "history" in questions.columns else F.array().cast(f"array<{MESSAGE}>"), block)
    return embedding.answer(ready.withColumn("prompt", block), model).withColumn("answer", clean_answer(F.col("answer")))


def response_text(json: Column) -> Column:
    """Parts of the first candidate of a nested API response, joined; null where there is none."""
    schema = "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>"
    first = F.get(F.from_json(json, schema)["candidates"], F.lit(0))
    return F.nullif(F.array_join(F.transform(first["content"]["parts"], lambda p: p["text"]), ""), F.lit(""))


def valid_history(messages: DataFrame) -> DataFrame:
    """Messages with a known role and filled text."""
    return messages.filter(F.col("role").isin("user", "model") & (F.coalesce(F.trim("text"), F.lit("")) != ""))
