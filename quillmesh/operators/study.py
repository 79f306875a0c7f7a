"""Assignment, turn histories and anonymised exports of a two-condition study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.operators.corpus import lookup_side

#: The columns of the four exports.
PERSON = ("response_code", "sequence_id")
BACKGROUND_COLUMNS = (
    *PERSON, "passage_block", "task_1_passage", "task_1_condition", "task_2_passage", "task_2_condition", "age_group", "english_level",
    "christian_identity_duration", "bible_study_frequency", "ai_use_frequency", "bible_ai_experience", "theological_training",
)
ROUND = (*PERSON, "round_number", "system_label", "system_condition", "passage_reference")
TURN_COLUMNS = (*ROUND, "turn_index", "question", "answer", "latency_ms", "status", "error_type", "retrieved_sources_json")
CONSTANT_COLUMNS = ("chat_model", "embedding_model", "rag_top_k")
RATINGS = ("use01", "use02", "use03", "ctx01", "tru01", "tru02", "tru03", "clr01", "sat01", "int01", "int02")
EVALUATION_COLUMNS = (*ROUND, "passage_familiarity", *RATINGS)
FINAL_COLUMNS = (*PERSON, "pref01", "pref03", "pref03_other", "pref04", "fb01")
#: The fields of a source record that are shown, and the steps of a session.
SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("rank", "title", "source_name", "reference", "url")])
STEPS, FIRST, PER_ROUND = 11, 4, 3
BLOCK = 8


def public_sources(json: Column) -> Column:
    """Public fields of a JSON list of sources; malformed or null JSON is an empty list."""
    return F.coalesce(F.from_json(json, T.ArrayType(SOURCE)), F.array().cast(T.ArrayType(SOURCE)))


def public_history(turns: DataFrame, by: str = "player_id", order: str = "turn_index") -> DataFrame:
    """Answered turns as two messages each, sources with the answer: ``(by, order, seq, sender, text, sources)``."""
    ok = turns.filter("status = 'ok'")
    none = F.array().cast(T.ArrayType(SOURCE))
    messages = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("user").alias("sender"), F.col("question").alias("text"), none.alias("sources")),
        F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("sender"), F.col("answer").alias("text"), public_sources(F.col("sources_json")).alias("sources")),
    )
    return ok.select(by, order, F.explode(messages).alias("m")).select(by, order, "m.*")


def model_history(turns: DataFrame, by: str = "player_id", order: str = "turn_index") -> DataFrame:
    """As sent to a model: answered turns with a filled answer, ``(by, order, seq, role, text)``."""
    ok = turns.filter("status = 'ok' AND answer IS NOT NULL AND answer <> ''")
    messages = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("model").alias("role"), F.col("answer").alias("text")),
    )
    return ok.select(by, order, F.explode(messages).alias("m")).select(by, order, "m.*")


def next_turn(turns: DataFrame, by: str = "player_id") -> DataFrame:
    """Index of the next turn: failed turns count too."""
    return turns.groupBy(by).agg((F.count(F.lit(1)) + 1).alias("next_index"))


def interacted(turns: DataFrame, by: str = "player_id") -> DataFrame:
    """Whether any turn was answered."""
    return turns.groupBy(by).agg(F.max(F.col("status") == "ok").alias("has_interacted"))


def assign_blocks(people: DataFrame, order: str, seed: int, block: int = BLOCK) -> DataFrame:
    """Adds ``block_no`` and ``sequence_id``: arrivals in blocks, each block a seeded permutation of 1..block.

    Arrival numbers come from per-partition counts of a range partitioning, not from one sorted task.
    """
    numbered = with_position(people, order)
    blocked = numbered.withColumn("block_no", F.floor((F.col("position") - 1) / block)).withColumn(
        "slot", (F.col("position") - 1) % block
    )
    rank = lambda s: F.xxhash64(F.lit(seed), F.col("block_no"), s)
    order_of = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(block)), lambda s: F.struct(rank(s).alias("h"), s.alias("s"))))
    return blocked.withColumn("sequence_id", F.get(order_of, F.col("slot").cast("int"))["s"]).drop("slot")


def with_position(df: DataFrame, order: str) -> DataFrame:
    """Adds ``position`` (from 1) in the order of a unique column, by buckets of its distinct ranges."""
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    bucket = F.lit(0)
    for c in sorted(set(cuts)):
        bucket = bucket + F.when(F.col(order) > c, 1).otherwise(0)
    cut = df.withColumn("_b", bucket)
    sizes = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o")))
    inside = Window.partitionBy("_b").orderBy(order)
    return cut.join(offsets, "_b").withColumn("position", F.row_number().over(inside) + F.col("_o")).drop("_b", "_o")


def rounds(people: DataFrame, plan: DataFrame) -> DataFrame:
    """Two rows per participant: the passage and condition of each round of its sequence."""
    joined = people.join(lookup_side(plan), "sequence_id")
    pair = lambda n: F.struct(F.lit(n).alias("round"), F.col(f"passage{n}").alias("passage"), F.col(f"condition{n}").alias("condition"))
    keep = [c for c in joined.columns if c not in ("passage1", "passage2", "condition1", "condition2")]
    return joined.select(*keep, F.explode(F.array(pair(1), pair(2))).alias("r")).select(*keep, "r.*")


def progress_percent(round_no: Column, offset: Column) -> Column:
    """Share of steps done, in percent, halves to even."""
    step = F.lit(FIRST) + F.lit(PER_ROUND) * (round_no - 1) + offset
    return F.bround(step * 100 / F.lit(STEPS)).cast("int")


def export(players: DataFrame, participants: DataFrame, columns: list[str], constants: dict[str, object] | None = None, details: DataFrame | None = None, key: str = "participant_id") -> DataFrame:
    """Columns of completed participants' rows, with detail rows if given; nothing that names a person."""
    done = participants.filter(F.col("completed_study").eqNullSafe(F.lit(True)))
    out = players.join(done, key)
    if details is not None:
        out = out.join(details, "player_id")
    return out.withColumns({k: F.lit(v) for k, v in (constants or {}).items()}).select(*columns, *(constants or {}))


def _completed(players: DataFrame, participants: DataFrame, columns: tuple[str, ...], details: DataFrame | None = None, constants: dict[str, object] | None = None) -> DataFrame:
    """An export's rows; answers that a table lacks are null."""
    known = set(players.columns) | set(participants.columns) | set(details.columns if details is not None else ())
    filled = players.withColumns({c: F.lit(None).cast("string") for c in columns if c not in known})
    return export(filled, participants, list(columns), constants, details)


def background(players: DataFrame, participants: DataFrame) -> DataFrame:
    """One row for each completed participant: assignment and background answers."""
    return _completed(players, participants, BACKGROUND_COLUMNS)


def chat_turns(players: DataFrame, participants: DataFrame, turns: DataFrame, models: dict[str, object]) -> DataFrame:
    """One row for each turn of completed participants, with the models as constant columns; readers that want turns
    in order sort by turn_index."""
    if set(models) != set(CONSTANT_COLUMNS):
        raise ValueError(f"models are {CONSTANT_COLUMNS}")
    return _completed(players, participants, TURN_COLUMNS, turns, models)


def task_evaluations(players: DataFrame, participants: DataFrame) -> DataFrame:
    """One row for each completed participant and round: familiarity and ratings."""
    return _completed(players, participants, EVALUATION_COLUMNS)


def final_comparison(players: DataFrame, participants: DataFrame) -> DataFrame:
    """One row for each completed participant: preferences and remarks."""
    return _completed(players, participants, FINAL_COLUMNS)


def by_response(*exports: DataFrame) -> DataFrame:
    """Exports of one person's answers side by side; columns that repeat are those of the first."""
    out = exports[0]
    for e in exports[1:]:
        out = out.join(e.select("response_code", *[c for c in e.columns if c not in out.columns]), "response_code", "left")
    return out


def scrubbed(participants: DataFrame, *labels: str) -> DataFrame:
    """Labels that could name a person, blanked."""
    return participants.withColumns({c: F.lit("") for c in labels if c in participants.columns})
