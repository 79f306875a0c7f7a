"""Structured Streaming twins of the turn operators: request validation, and turn numbers as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.privacy import request_error
from quillmesh.operators import study


def validated(messages: DataFrame, scopes: list[str]) -> DataFrame:
    """Adds ``error_code`` to a stream of ``(player_id, type, text, scope, ts)``; stateless."""
    return messages.withColumn("error_code", request_error(F.col("type"), F.col("text"), F.col("scope").isin(*scopes)))


def numbered(messages: DataFrame) -> DataFrame:
    """``(player_id, turn_index, status, text)``: a counter per player is the only state; failed turns count."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values(["ts", "text"])
            turns = range(n + 1, n + 1 + len(frame))
            n += len(frame)
            yield pd.DataFrame({"player_id": key[0], "turn_index": turns, "status": frame["status"].values, "text": frame["text"].values})
        state.update((n,))

    return messages.groupBy("player_id").applyInPandasWithState(
        step, "player_id long, turn_index long, status string, text string", "n long", "append", "NoTimeout"
    )


def answered_counts(turns: DataFrame) -> DataFrame:
    """Running ``(player_id, n_turns, has_interacted)`` of a turn stream."""
    return turns.groupBy("player_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max(F.col("status") == "ok").alias("has_interacted"))


HISTORY = 20


def with_history(messages: DataFrame, most: int = HISTORY) -> DataFrame:
    """``(player_id, turn_index, question, history)`` of answered turns ``(player_id, question, answer, ts)``: the state
    of a player is a counter and the last ``most`` messages, as a list of JSON."""
    import json

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, past = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        for frame in frames:
            rows = []
            for r in frame.sort_values(["ts", "question"]).itertuples():
                n += 1
                rows.append((key[0], n, r.question, json.dumps(past, ensure_ascii=False)))
                if r.answer:
                    past = [*past, {"role": "user", "text": r.question}, {"role": "model", "text": r.answer}][-most:]
            yield pd.DataFrame(rows, columns=["player_id", "turn_index", "question", "history"])
        state.update((n, json.dumps(past, ensure_ascii=False)))

    return messages.groupBy("player_id").applyInPandasWithState(
        step, "player_id long, turn_index long, question string, history string", "n long, past string", "append", "NoTimeout"
    )


def recomputed_history(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """The stateless alternative: each message of a stream ``(player_id, ...)`` with the history that a table of turns
    has of its player, built anew for each batch."""
    told = study.model_history(turns)
    ordered = F.array_sort(F.collect_list(F.struct("turn_index", "seq", "role", "text")))
    history = told.groupBy("player_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("history"))
    return messages.join(history, "player_id", "left")


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A query that writes Parquet and goes on from its checkpoint after a restart; ends when all input is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
