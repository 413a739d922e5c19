"""Mentions: union, dedupe, merging, clustering, pronouns, refinement."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Clustering and pronoun scores.
SCORES = {
    "alternate_form_match": 0.48, "cleaned_match": 0.22, "normalized_match": 0.15,
    "head_surface_match": 0.10, "head_lemma_match": 0.08, "entity_type_match": 0.08, "propn_evidence": 0.04,
    "nearby_sentence": 0.05, "document_locality": 0.02,
}
CLUSTER_THRESHOLD = 0.72
PRONOUN = {"same_sentence": 0.32, "previous_sentence": 0.26, "document_locality": 0.18,
           "role_type_compatibility": 0.18, "plural_compatible": 0.08, "singular_compatible": 0.05}
PRONOUN_THRESHOLD, PRONOUN_DISTANCE = 0.62, 2
TYPES = ("PER", "ORG", "LOC")


def union_mentions(ranked_sources: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Union of mention tables; a key that several have is that of the first."""
    out = None
    for rank, df in enumerate(ranked_sources):
        part = df.withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy(*keys).orderBy("source_rank")
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def keep_best(df: DataFrame, keys: list[str], score: str, position: str) -> DataFrame:
    """Highest score a key; of equal ones the later row."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(position))
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def merge_islands(df: DataFrame, keys: list[str], order: list[str], label: str, breaks: Column) -> DataFrame:
    """Runs of adjacent rows with one label: a row starts a run where the label or ``breaks`` says so."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(
        F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label)) | F.coalesce(breaks, F.lit(False)), 1
    ).otherwise(0)
    return df.withColumn("new", new).withColumn(
        "island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("new")


def fallback_rows(entries: DataFrame, model: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Model rows, and rule rows for the entries that the model left empty."""
    bare = entries.select(key).join(model.select(key), key, "left_anti")
    return model.withColumn("origin", F.lit("model")).unionByName(
        rules.join(bare, key, "left_semi").withColumn("origin", F.lit("rule"))
    )


def keep_salient(mentions: DataFrame, keys: list[str], text: str, typed: Column) -> DataFrame:
    """Typed mentions, and others whose text repeats in the group."""
    w = Window.partitionBy(*keys, F.lower(text))
    return mentions.withColumn("times", F.count("*").over(w)).where(typed | (F.col("times") >= 2))


def cluster_mentions(mentions: DataFrame, threshold: float = CLUSTER_THRESHOLD) -> DataFrame:
    """Greedy online clusters a document, in (sent, start, text) order.

    ``mentions``: doc_id, sent_id, start, text, form, kind. A mention joins the
    cluster of highest score at or above the threshold, else opens one. What a
    cluster is depends on what came before, so a document is worked through in
    one go. Returns the input with ``cluster`` (0-based in its document) and ``score``.
    """
    schema = "doc_id long, sent_id int, start int, text string, form string, kind string, cluster int, score double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sent_id", "start", "text"], kind="stable").reset_index(drop=True)
        clusters: list[dict] = []
        placed, scores = [], []
        for row in pdf.itertuples(index=False):
            best, best_score = -1, 0.0
            for k, c in enumerate(clusters):
                if row.kind in TYPES and c["kind"] in TYPES and row.kind != c["kind"]:
                    continue
                gap = abs(row.sent_id - c["last"])
                score = (
                    SCORES["alternate_form_match"] * (row.form in c["forms"])
                    + SCORES["cleaned_match"] * (row.form == c["canonical"])
                    + SCORES["normalized_match"] * (row.text.lower() == c["canonical"])
                    + SCORES["head_surface_match"] * (row.form.rsplit(" ", 1)[-1] == c["canonical"].rsplit(" ", 1)[-1])
                    + SCORES["entity_type_match"] * (row.kind == c["kind"])
                    + (SCORES["nearby_sentence"] if gap <= 1 else SCORES["document_locality"] if gap <= 2 else 0.0)
                )
                if score > best_score:
                    best, best_score = k, score
            if best < 0 or round(best_score, 6) < threshold:
                clusters.append({"forms": set(), "canonical": row.form, "kind": row.kind, "last": row.sent_id})
                best, best_score = len(clusters) - 1, 0.5
            c = clusters[best]
            c["forms"].update((row.form, row.text.lower()))
            c["last"] = row.sent_id
            if len(row.form) >= len(c["canonical"]):
                c["canonical"] = row.form
            placed.append(best)
            scores.append(round(best_score, 4))
        return pdf.assign(cluster=pd.Series(placed, dtype="int32"), score=scores)[
            ["doc_id", "sent_id", "start", "text", "form", "kind", "cluster", "score"]
        ]

    return mentions.groupBy("doc_id").applyInPandas(run, schema)


def number_clusters(clusters: DataFrame) -> DataFrame:
    """Global ids ``c0001`` in document order, from counts a document and their running sum."""
    sizes = clusters.groupBy("doc_id").agg((F.max("cluster") + 1).alias("n"))
    # One row a document: buckets first, then bucket sums, so no window holds all documents.
    sized = sizes.withColumn("bucket", F.floor(F.col("doc_id") / 4096))
    sums = sized.groupBy("bucket").agg(F.sum("n").alias("n"))
    over = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0))).select("bucket", "base")
    within = Window.partitionBy("bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(base, "bucket")
    offsets = offsets.select("doc_id", (F.col("base") + F.col("before")).alias("offset"))
    return clusters.join(offsets, "doc_id").withColumn(
        "cluster_id", F.format_string("c%04d", (F.col("offset") + F.col("cluster") + 1).cast("long"))
    ).drop("offset")


def resolve_pronouns(
    mentions: DataFrame, pronouns: DataFrame, threshold: float = PRONOUN_THRESHOLD, distance: int = PRONOUN_DISTANCE
) -> DataFrame:
    """Best antecedent cluster of each pronoun within a backward window, or the reason for none.

    ``mentions``: doc_id, sent_id, start, cluster, kind (clustered); ``pronouns``:
    doc_id, sent_id, start, text, plural, hint. Attaching adds to a cluster's size, which later
    pronouns see, so a document is worked through in one go.
    """
    schema = "doc_id long, sent_id int, start int, text string, cluster int, score double, reason string"
    both = mentions.select(
        "doc_id", "sent_id", "start", F.lit("").alias("text"), "cluster", "kind", F.lit(False).alias("plural"),
        F.lit("").alias("hint"), F.lit(0).alias("side"),
    ).unionByName(pronouns.select(
        "doc_id", "sent_id", "start", "text", F.lit(-1).alias("cluster"), F.lit("").alias("kind"), "plural", "hint",
        F.lit(1).alias("side"),
    ))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sent_id", "start", "side"], kind="stable")
        heads: dict[int, dict] = {}
        for row in pdf[pdf.side == 0].itertuples(index=False):
            c = heads.setdefault(row.cluster, {"sent": row.sent_id, "start": row.start, "kind": row.kind, "n": 0})
            c["n"] += 1
        out = []
        for row in pdf[pdf.side == 1].itertuples(index=False):
            best, best_score, conflict, far, seen = -1, 0.0, False, False, False
            for k in sorted(heads):
                c = heads[k]
                if (c["sent"], c["start"]) >= (row.sent_id, row.start):
                    continue
                gap = row.sent_id - c["sent"]
                if gap > distance:
                    far = True
                    continue
                seen = True
                if row.hint in ("PER", "ORG") and c["kind"] == "LOC":
                    conflict = True
                    continue
                score = PRONOUN[("same_sentence", "previous_sentence", "document_locality")[min(gap, 2)]]
                if row.hint in ("PER", "ORG") and c["kind"] in ("PER", "ORG") or row.hint == "LOC" == c["kind"]:
                    score += PRONOUN["role_type_compatibility"]
                if row.plural:
                    score += PRONOUN["plural_compatible"] if c["n"] > 1 or c["kind"] == "ORG" else 0.0
                else:
                    score += PRONOUN["singular_compatible"]
                if score > best_score:
                    best, best_score = k, score
            score = round(best_score, 4)
            if best >= 0 and score >= threshold:
                heads[best]["n"] += 1
                out.append((row.doc_id, row.sent_id, row.start, row.text, best, score, "linked"))
                continue
            reason = (
                "low_confidence" if best >= 0 and score >= threshold - 0.08 else "type_conflict" if conflict
                else "distance_too_large" if far and not seen else "no_compatible_antecedent"
            )
            out.append((row.doc_id, row.sent_id, row.start, row.text, -1, score, reason))
        return pd.DataFrame(out, columns=["doc_id", "sent_id", "start", "text", "cluster", "score", "reason"])

    return both.groupBy("doc_id").applyInPandas(run, schema)


def cluster_summary(members: DataFrame, key: str, kind: str, score: str, position: str) -> DataFrame:
    """Size, mean score and most voted kind of each cluster; ties go to the kind seen first."""
    votes = members.groupBy(key, kind).agg(
        F.count("*").alias("n"), F.sum(score).alias("total"), F.min(position).alias("first")
    )
    return votes.groupBy(key).agg(
        F.sum("n").alias("mentions"), F.round(F.sum("total") / F.sum("n"), 4).alias("confidence"),
        F.max_by(kind, F.struct("n", (-F.col("first")).alias("first"))).alias("kind"),
        F.max("n").alias("votes"),
    )


def refine_confidence(
    has_head: Column, plausible: Column, is_root: Column, auxiliary: Column, warnings: Column
) -> Column:
    """Trigger confidence from its head word and the number of warnings."""
    score = (
        F.lit(0.35) + F.when(has_head, 0.2).otherwise(0.0) + F.when(plausible, 0.2).otherwise(0.0)
        + F.when(is_root, 0.1).otherwise(0.0) - F.when(auxiliary, 0.15).otherwise(0.0)
    )
    count = warnings + F.when(~plausible, 1).otherwise(0) + F.when(auxiliary, 1).otherwise(0)
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), score - 0.06 * count)), 4)


def argument_confidence(has_head: Column, nominal: Column, cluster: Column, timex: Column, ner: Column, warnings: Column) -> Column:
    score = F.lit(0.34)
    for condition, value in ((has_head, 0.18), (nominal, 0.12), (cluster, 0.16), (timex, 0.12), (ner, 0.12)):
        score = score + F.when(condition, value).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), score - 0.06 * warnings)), 4)


def warning_severity(label: Column) -> Column:
    cautions = [
        "multi_event_sentence", "trigger_auxiliary_like", "trigger_head_not_plausible", "argument_head_function_word",
        "source_without_se_marker", "destination_without_locative_marker", "locative_role_without_case_marker",
        "locative_role_without_locative_alignment",
    ]
    return F.when(label.startswith("overlapping_arguments:"), "hard_review").when(
        label.startswith("overlaps_with:") | label.startswith("duplicate_role_filler:") | label.isin(cautions), "caution"
    ).otherwise("info")


def review_priority(event: Column, trigger: Column, worst: Column, hard: float = 0.45, caution: float = 0.65) -> Column:
    return F.when((worst == "hard_review") | (event < hard), "hard_review").when(
        (worst == "caution") | (trigger < hard) | (event < caution), "caution"
    ).otherwise("info_only")
