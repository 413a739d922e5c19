"""Streaming forms: windowed event density, late data, sessions, and running clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_density(events: DataFrame, late: str = "10 minutes", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums of each type in tumbling or sliding windows; rows later than ``late`` go."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return at.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no longer gap between them."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n"
    )


def running_clusters(mentions: DataFrame) -> DataFrame:
    """Cluster numbers of (doc_id, form) mentions as they come, with the forms seen kept as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        forms = list(state.get[0]) if state.exists else []
        out = []
        for batch in batches:
            for form in batch["form"]:
                if form not in forms:
                    forms.append(form)
                out.append((key[0], form, forms.index(form)))
        state.update((forms,))
        yield pd.DataFrame(out, columns=["doc_id", "form", "cluster"])

    return mentions.groupBy("doc_id").applyInPandasWithState(
        run, "doc_id long, form string, cluster int", "forms array<string>", "append", GroupStateTimeout.NoTimeout
    )
