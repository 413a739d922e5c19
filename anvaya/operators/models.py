"""Model-backed steps behind plain interfaces, each with a deterministic stand-in.

A model is a function from a list of prompts to a list of strings. It is built
once a task by a factory that travels to the executors, and called a batch at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[Sequence[str]], list[str]]


def first_evidence() -> Model:
    """Stand-in: answers with the first evidence line of the prompt."""

    def run(prompts: Sequence[str]) -> list[str]:
        out = []
        for prompt in prompts:
            lines = prompt.split("Evidence:\n", 1)[-1].split("\n")
            out.append(json.dumps({"answer": lines[0], "evidence": [1]}, ensure_ascii=False))
        return out

    return run


def complete(prompts: DataFrame, factory: Callable[[], Model] = first_evidence, column: str = "prompt") -> DataFrame:
    """``prompts`` with the model's raw reply."""

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()), dtype=object)

    return prompts.withColumn("reply", reply(column))


def answer(prompts: DataFrame, factory: Callable[[], Model] = first_evidence) -> DataFrame:
    """Replies parsed as JSON; ``valid`` is false where the reply is none."""
    parsed = F.from_json("reply", "answer string, evidence array<int>")
    rows = complete(prompts, factory).withColumn("parsed", parsed)
    return rows.select(
        "question", F.size("evidence").alias("n_evidence"), F.col("parsed.answer").alias("answer"), F.col("parsed.answer").isNotNull().alias("valid")
    )


def select_frame(candidates: DataFrame, factory: Callable[[], Model] | None = None) -> DataFrame:
    """One frame a sentence: the model's choice if it is among the candidates, else the first."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "frame_id"))), lambda x: x["frame_id"])
    rows = candidates.groupBy("sent_key").agg(ordered.alias("options"))
    if factory is None:
        return rows.select("sent_key", F.get("options", F.lit(0)).alias("frame_id"))
    asked = complete(rows.withColumn("prompt", F.concat_ws("\n", F.lit("Choose one:"), F.array_join("options", "\n"))), factory)
    chosen = F.trim("reply")
    return asked.select(
        "sent_key", F.when(F.array_contains("options", chosen), chosen).otherwise(F.get("options", F.lit(0))).alias("frame_id")
    )


def extract_events(selected: DataFrame, best: DataFrame, words: DataFrame) -> DataFrame:
    """Rule-based extraction: the trigger under the best evidence, its left and right neighbours as roles."""
    spans = selected.join(best, ["sent_key", "frame_id"])
    met = spans.join(words.select("sent_key", "w", "word"), "sent_key")
    inside = (F.col("w") >= F.col("start")) & (F.col("w") < F.col("stop"))
    return met.groupBy("sent_key", "frame_id", "start", "stop").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(inside, F.struct("w", "word")))), lambda x: x["word"]), " ").alias("trigger"),
        F.max(F.when(F.col("w") == F.col("start") - 1, F.col("word"))).alias("agent"),
        F.max(F.when(F.col("w") == F.col("stop"), F.col("word"))).alias("patient"),
    )


def frame_schema(roles: DataFrame) -> DataFrame:
    """JSON schema text of each frame from (frame_id, role) rows."""
    grouped = roles.groupBy("frame_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    properties = F.map_from_entries(F.transform("roles", lambda r: F.struct(r, F.create_map(F.lit("type"), F.lit("object")))))
    return grouped.select("frame_id", F.to_json(F.struct(
        F.lit("object").alias("type"), F.struct(F.struct(F.col("frame_id").alias("const")).alias("frame"), F.struct(properties.alias("properties")).alias("arguments")).alias("properties")
    )).alias("schema"))
