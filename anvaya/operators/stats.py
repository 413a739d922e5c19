"""Density, caps, coverage, reconciliation, sampling and review queues."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anvaya.operators.spans import overlap_all


def density(counts: DataFrame, column: str, cap: int) -> DataFrame:
    """Mean, median, 95th percentile and cap hits of counts, over the rows that have any."""
    own = counts.where(F.col(column) > 0)
    return own.agg(
        F.count("*").alias("units"), F.sum(column).alias("total"), F.round(F.avg(column), 4).alias("mean"),
        F.round(F.percentile(column, F.lit(0.5)), 4).alias("median"),
        F.round(F.percentile(column, F.lit(0.95)), 4).alias("p95"),
        F.count_if(F.col(column) >= cap).alias("cap_hits"),
        F.round(F.count_if(F.col(column) >= cap) / F.count("*"), 4).alias("cap_rate"),
    )


def histogram(counts: DataFrame, column: str) -> DataFrame:
    return counts.groupBy(F.col(column).alias("size")).agg(F.count("*").alias("units"))


def cap_sweep(counts: DataFrame, column: str, caps: list[int]) -> DataFrame:
    """What is left under each cap. Caps are an array in the row, so nothing is joined."""
    spread = counts.select(column, F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap"))
    kept = F.least(F.col(column), F.col("cap"))
    return spread.groupBy("cap").agg(
        F.sum(kept).alias("kept"), F.round(F.avg(kept), 4).alias("mean"),
        F.count_if(F.col(column) >= F.col("cap")).alias("cap_hits"),
    )


def stabilised_at(counts: DataFrame, key: str, column: str, caps: list[int]) -> DataFrame:
    """The first cap from which a unit's count no longer changes."""
    value = F.col(column)
    out = F.lit(caps[-1])
    for cap in reversed(caps):
        out = F.when(value <= cap, cap).otherwise(out)
    return counts.select(key, column, out.alias("stable_cap"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two counts (key, n); rows that differ, with the reason."""
    a, b = left.withColumnRenamed("n", "n_left"), right.withColumnRenamed("n", "n_right")
    met = a.join(b, key, "full_outer").select(
        key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right")
    )
    reason = F.when(F.col("n_right") == 0, "missing_right").when(F.col("n_left") == 0, "missing_left").otherwise("count_differs")
    return met.where("n_left <> n_right").select(
        key, "n_left", "n_right", (F.col("n_left") - F.col("n_right")).alias("diff"), reason.alias("reason")
    )


def value_distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Unpivoted value counts of label columns, with the share of rows filled in."""
    n = rows.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = n.unpivot([], columns, "column_name", "value")
    total = Window.partitionBy("column_name")
    counted = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 6))


def stratified_sample(rows: DataFrame, stratum: str, key: Column, quota: int) -> DataFrame:
    """A quota a stratum, in hash order: the same rows whatever the partitioning."""
    w = Window.partitionBy(stratum).orderBy(key)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quota).drop("rn")


def review_queue(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows of a composite order, with empty columns to annotate."""
    return rows.orderBy(*order).limit(limit).withColumn("reviewer", F.lit(None).cast("string")).withColumn(
        "verdict", F.lit(None).cast("string")
    )


def role_inventory(rows: DataFrame, role: str, owner: str, example: str) -> DataFrame:
    """Owners and first examples of each role."""
    return rows.groupBy(role).agg(
        F.array_join(F.sort_array(F.collect_set(owner)), ",").alias("owners"),
        F.count_distinct(owner).alias("n_owners"), F.min(example).alias("example"),
    )


def match_greedy(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches of spans in a key, by overlap; the best pair first, ties by position.

    Candidates meet on the key by an equi-join of overlapping spans; the greedy pass
    needs all candidates of a key in order and runs on those alone.
    """
    pairs = overlap_all(gold, predicted, keys).where("ratio > 0")
    fields = ", ".join(f"{k} {t}" for k, t in pairs.select(*keys).dtypes)
    item = F.struct((-F.col("ratio")).alias("order"), "start", "r_start", "stop", "r_stop")
    grouped = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("pairs"))
    names = [*keys, "start", "stop", "r_start", "r_stop", "ratio"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, items in batch[[*keys, "pairs"]].itertuples(index=False):
                taken_a, taken_b = set(), set()
                for x in items:
                    a, b = (x["start"], x["stop"]), (x["r_start"], x["r_stop"])
                    if a not in taken_a and b not in taken_b:
                        taken_a.add(a)
                        taken_b.add(b)
                        out.append((*key, *a, *b, -x["order"]))
            yield pd.DataFrame(out, columns=names)

    return grouped.mapInPandas(run, f"{fields}, start int, stop int, r_start int, r_stop int, ratio double")


def mention_summary(mentions: DataFrame, kind: str, source: str, confidence: str) -> DataFrame:
    """Mentions by kind, with a row of all kinds: how many, from models and rules, and the mean confidence."""
    label = F.coalesce(F.when(F.trim(kind) != "", F.col(kind)), F.lit("MISC"))
    rows = mentions.select(label.alias("kind"), F.col(source).alias("source"), F.col(confidence).try_cast("double").alias("confidence"))
    return rows.rollup("kind").agg(
        F.count("*").alias("mentions"), F.count_if(F.col("source") == "model").alias("by_model"),
        F.count_if(F.col("source") == "rules").alias("by_rules"), F.round(F.avg("confidence"), 6).alias("confidence"),
    ).withColumn("kind", F.coalesce("kind", F.lit("*")))


def density_examples(counts: DataFrame, warned: DataFrame, cap: int, size: int) -> DataFrame:
    """The densest units with the reason to review them.

    ``counts`` has (sent_key, n), ``warned`` the keys with a warning. Order: count, cap, warning, key.
    """
    keys = warned.select("sent_key").distinct().withColumn("warned", F.lit(True))
    rows = counts.join(keys, "sent_key", "left").withColumn("warned", F.coalesce("warned", F.lit(False))).withColumn("at_cap", F.col("n") >= cap)
    reason = (
        F.when(F.col("at_cap") & F.col("warned"), "cap_hit_and_multi_event_warning").when(F.col("at_cap"), "cap_hit")
        .when(F.col("warned"), "multi_event_warning").otherwise("high_event_density")
    )
    order = [F.desc("n"), F.desc("at_cap"), F.desc("warned"), F.asc("sent_key")]
    return rows.withColumn("reason", reason).orderBy(*order).limit(size)


def uncovered(keys: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct keys that no text answers to; a blank text is none."""
    return keys.select(key).distinct().join(texts.where(F.trim(text) != "").select(key), key, "left_anti")
