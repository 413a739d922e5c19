"""Question answering over event tables: intents, ranking, evidence, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intent(text: Column | str, patterns: dict[str, list[str]], fallback: str = "list") -> Column:
    """The first intent with one of its words in the text."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.when(F.lit(False), "")
    for name, words in patterns.items():
        out = out.when(low.rlike(rf"(^|\s)({'|'.join(words)})(\s|$)"), name)
    return out.otherwise(fallback)


def ranked(events: DataFrame, keys: list[str], order: list[Column], top_k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def distinct_signatures(events: DataFrame, signature: list[str], order: list[Column]) -> DataFrame:
    """The best event of each signature."""
    w = Window.partitionBy(*signature).orderBy(*order)
    return events.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def prompts(events: DataFrame, key: str, question: Column, evidence: Column) -> DataFrame:
    """One grounded prompt a key: the question and its ranked evidence lines."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", evidence.alias("line")))), lambda x: x["line"])
    return events.groupBy(key).agg(F.min(question).alias("question"), lines.alias("evidence")).withColumn(
        "prompt", F.concat_ws("\n", F.concat(F.lit("Question: "), F.col("question")), F.lit("Evidence:"), F.array_join("evidence", "\n"), F.lit("Answer as JSON with answer and evidence numbers."))
    )
