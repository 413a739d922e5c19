"""Every query of the library on the driver tables, with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvaya.operators import graph, lexicon
from anvaya.plans import (  # noqa: F401  importing registers the queries
    common, enrich_queries, entity_queries, graph_queries, layer_queries, lexicon_queries, rule_queries, span_queries, stats_queries, text_queries,
)
from anvaya.plans.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to sentences, words, candidates, events and quads; then event density."""
    index = lexicon.trigger_index(spark, common.FRAMES)
    top = lexicon.candidates(lexicon.evidence(common.word_arrays(spark, sf_dir), index, common.STOP), top_k=1)
    events = top.select(
        F.substring_index("sent_key", "::", 1).alias("doc_id"), F.substring_index("sent_key", "::", -1).alias("sent_id"),
        "frame_id", F.lit("").alias("word"), F.lit(0).alias("start"), F.lit(0).alias("stop"),
        (F.col("score") / 10).alias("confidence"),
    )
    parsed = graph.parse(graph.event_quads(events))
    return parsed.groupBy("p").agg(F.count("*").alias("quads"), F.count_distinct("s").alias("subjects"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
