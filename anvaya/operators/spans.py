"""Interval joins between annotations of a sentence: always an equi-join on the key plus a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anvaya.functions.text import overlap_ratio, overlaps, span_distance


def _sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    return left.join(renamed, keys)


def overlap_all(left: DataFrame, right: DataFrame, keys: list[str], ratio: float = 0.0) -> DataFrame:
    """All pairs of overlapping spans; with a ratio, by the shorter span at least that."""
    met = _sides(left, right, keys).where(overlaps("start", "stop", "r_start", "r_stop"))
    return met.withColumn(
        "ratio", F.round(overlap_ratio("start", "stop", "r_start", "r_stop"), 4)
    ).where(F.col("ratio") >= ratio)


def overlap_first(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each left span the first overlapping right one."""
    w = Window.partitionBy(*keys, "start", "stop").orderBy(*[f"r_{c}" for c in order])
    met = overlap_all(left, right, keys)
    return met.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "ratio")


def _touching(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    other = right.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    condition = overlaps("start", "stop", "r_start", "r_stop")
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"k_{k}"))
    return other, condition


def overlap_semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    other, condition = _touching(left, right, keys)
    return left.join(other, condition, "left_semi")


def overlap_anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    other, condition = _touching(left, right, keys)
    return left.join(other, condition, "left_anti")


def head_token(spans: DataFrame, toks: DataFrame, keys: list[str]) -> DataFrame:
    """The token that overlaps a span most; ties go to the first."""
    w = Window.partitionBy(*keys, "start", "stop").orderBy(F.desc("shared"), "r_idx")
    shared = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    met = overlap_all(spans, toks.select(*keys, "idx", "tok", "start", "stop"), keys)
    return met.withColumn("shared", shared).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(
        *keys, "start", "stop", F.col("r_idx").alias("idx"), F.col("r_tok").alias("tok")
    )


def nearest_cascade(left: DataFrame, right: DataFrame, keys: list[str], anchor: str, at: str, fallback: Column) -> DataFrame:
    """Nearest right row for each left one, else a fallback value.

    ``anchor`` and ``at`` are positions on a line. The nearest before and the nearest
    after come from one sorted pass over the union of both sides, not from
    a product of them. Strategy 1 is an equal position, 2 the nearest one, 3 the fallback.
    """
    both = left.select(*keys, F.col(anchor).alias("at"), F.col("id").alias("id"), F.lit(0).alias("side")).unionByName(
        right.select(*keys, F.col(at).alias("at"), F.col("id").alias("id"), F.lit(1).alias("side"))
    )
    mark = F.when(F.col("side") == 1, F.struct("at", "id"))
    before = Window.partitionBy(*keys).orderBy(F.asc("at"), F.desc("side"), F.asc("id")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.asc("at"), F.asc("side"), F.asc("id")).rowsBetween(1, Window.unboundedFollowing)
    rows = both.withColumn("b", F.last(mark, ignorenulls=True).over(before)).withColumn(
        "a", F.first(mark, ignorenulls=True).over(after)
    ).where("side = 0")
    gap_b, gap_a = F.col("at") - F.col("b.at"), F.col("a.at") - F.col("at")
    use_b = F.col("b").isNotNull() & (F.col("a").isNull() | (gap_b <= gap_a))
    chosen = F.when(use_b, F.col("b.id")).otherwise(F.col("a.id"))
    gap = F.when(use_b, gap_b).otherwise(gap_a)
    return rows.select(
        *keys, "id", F.coalesce(chosen, fallback).alias("linked"), F.coalesce(gap, F.lit(-1)).alias("gap"),
        F.when(gap == 0, "overlap").when(gap.isNotNull(), "proximity").otherwise("docdate").alias("strategy"),
        F.when(gap == 0, 0.88).when(gap.isNotNull(), 0.65).otherwise(0.75).alias("confidence"),
    )


def distance(a0, a1, b0, b1) -> Column:
    return span_distance(a0, a1, b0, b1)


def document_times(rows: DataFrame, key: str, date: str) -> DataFrame:
    """A time mention without a span for each sentence whose document has a date."""
    value = F.col(date).cast("string")
    return rows.where(F.col(date).isNotNull()).select(key, F.col(date)).distinct().select(
        F.concat(F.col(key), F.lit("::docdate")).alias("timex_id"), F.col(key), value.alias("text"), F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("stop"), F.lit("DATE").alias("type"), value.alias("value"), F.lit("docdate").alias("engine"),
        F.lit(1.0).alias("confidence"), F.lit(True).alias("is_document_time"),
    )
