"""Clause profiles of sentences and the two-pass precision filter over candidates.

A sentence has the few candidates that retrieval kept, so its rows fit in one array and
all steps on it are array functions: one grouping by sentence, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anvaya.operators import lexicon

#: Categories of words and of clauses.
HELPERS = ["auxiliary", "copula", "particle", "adp", "conjunction", "pronoun", "determiner", "closed_class"]
NOMINAL = ["noun", "proper_noun", "lexical", "number"]
CENTRES = ["verb", "adjective", *NOMINAL]
COPULAR_MEMBERS = [*HELPERS, "adjective", "noun", "proper_noun", "lexical", "light_verb"]
COPULAR_TYPES = ["predicative_adjectival_state", "copular_nominal_classification", "static_copular_identity"]
ROW_PRIORITY = {"verb": 1.0, "adjective": 0.82, "noun": 0.78, "proper_noun": 0.74, "lexical": 0.72, "number": 0.62, "copula": 0.2, "auxiliary": 0.18}
SOFT_SCORE = 0.3


@dataclass(frozen=True)
class ClauseWords:
    """Words that tell kinds of clauses apart. The defaults."""

    imperative: tuple[str, ...] = ("ो", "ओ", "ें", "एँ", "इए", "ईए", "ये", "िए")
    resultative: tuple[str, ...] = ("हो", "हुआ", "हुई", "हुए", "बन", "बना", "बनी", "बने")
    ability: tuple[str, ...] = ("सक", "पा")
    passive: tuple[str, ...] = ("जा",)
    possibility: tuple[str, ...] = ("प",)
    static: tuple[str, ...] = ("है", "हैं", "था", "थी", "थे", "थीं")
    coordination: tuple[str, ...] = ()
    subordination: tuple[str, ...] = ()
    limits: dict[str, int] = field(default_factory=dict)


def signals(toks: Column, category: Callable[[Column, Column], Column], words: ClauseWords) -> Column:
    """What the words of a sentence say of its clause, as a struct of flags and markers.

    The words are told apart once: all flags are read off one bound array. None counts words, so each different word is in it once.
    """
    bound = F.transform(F.array_distinct(toks), lambda t: F.struct(t.alias("tok"), F.lower(t).alias("word")))
    tagged = F.transform(bound, lambda x: F.struct(x["word"].alias("word"), category(x["word"], x["tok"]).alias("category")))
    return F.get(F.transform(F.array(tagged), lambda x: _flags(x, words)), F.lit(0))


def _flags(tagged: Column, words: ClauseWords) -> Column:
    def begins(x: Column, prefixes: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | x["word"].startswith(p)
        return out

    def ends(x: Column, suffixes: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for s in suffixes:
            out = out | x["word"].endswith(s)
        return out

    def markers(listed: tuple[str, ...]) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.transform(tagged, lambda x: x["word"]), lambda w: w.isin(list(listed)))))

    modal = words.ability + words.passive + words.possibility
    return F.struct(
        F.exists(tagged, lambda x: x["category"] == "copula").alias("copula"),
        F.exists(tagged, lambda x: x["category"].isin("verb", "light_verb", "auxiliary") & ends(x, words.imperative)).alias("imperative"),
        F.exists(tagged, lambda x: begins(x, words.resultative)).alias("resultative"),
        F.exists(tagged, lambda x: x["category"].isin("verb", "auxiliary", "light_verb", "copula") & begins(x, modal)).alias("modal"),
        F.exists(tagged, lambda x: begins(x, words.ability)).alias("ability"),
        F.exists(tagged, lambda x: begins(x, words.passive)).alias("passive"),
        F.exists(tagged, lambda x: x["word"].isin(list(words.static))).alias("static"),
        markers(words.coordination).alias("coordination"), markers(words.subordination).alias("subordination"),
    )


def row_priority() -> Column:
    """How well a scored candidate stands for its centre."""
    base = F.when(F.col("category") == "light_verb", F.when(F.col("multiword"), 0.9).otherwise(0.55))
    for category, value in ROW_PRIORITY.items():
        base = base.when(F.col("category") == category, value)
    pattern = F.col("source").isin("single_prefix", "multiword_prefix")
    return F.round(base.otherwise(0.3) - F.when(pattern, 0.12).otherwise(0.0) + F.col("plausibility"), 4)


def centre_groups(rows: Column, copula: Column, kind: str, window: int = 1, copular_window: int = 2) -> Column:
    """Rows of a sentence, in order of centre and priority, as runs that share a predicate centre.

    A row joins the run before it if it has the centre of its last row, stands within
    ``window`` words of it and either holds a helper, or stands within ``copular_window``
    words of it in a sentence with a copula and neither holds a verb or number.
    """
    def helper(x: Column) -> Column:
        return x["category"].isin(HELPERS)

    def fits(run: Column, x: Column) -> Column:
        gap = F.abs(x["centre"] - F.element_at(run, -1)["centre"])
        near = (gap <= window) & (helper(x) | F.exists(run, helper))
        quiet = x["category"].isin(COPULAR_MEMBERS) & F.forall(run, lambda y: y["category"].isin(COPULAR_MEMBERS))
        return (gap == 0) | near | (copula & (gap <= copular_window) & quiet)

    def step(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        joined = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.concat(last, F.array(x))))
        return F.when(F.size(runs) == 0, F.array(F.array(x))).when(fits(last, x), joined).otherwise(F.concat(runs, F.array(F.array(x))))

    return F.aggregate(rows, F.array().cast(f"array<array<{kind}>>"), step)


def group_summary(run: Column) -> Column:
    """The best row of a run, its centres and categories."""
    best = F.array_min(F.transform(run, lambda x, k: F.struct(
        (-x["priority"]).alias("order"), k.alias("at"), x["centre"].alias("centre"), x["category"].alias("category"), x["score"].alias("score")
    )))
    return F.struct(
        F.array_sort(F.array_distinct(F.transform(run, lambda x: x["centre"]))).alias("indices"),
        F.array_sort(F.array_distinct(F.transform(run, lambda x: x["category"]))).alias("categories"),
        F.exists(run, lambda x: ~x["category"].isin(HELPERS)).alias("predicate_like"),
        best["centre"].alias("primary_center"), best["category"].alias("primary_category"), best["score"].alias("best_score"),
    )


def clause_profile(scored: DataFrame, flags: DataFrame, words: ClauseWords = ClauseWords(), soft: float = SOFT_SCORE) -> DataFrame:
    """The kind of clause of each sentence with candidates, its groups of centres and its limit.

    ``scored`` is what ``lexicon.plausibility`` gives, ``flags`` (sent_key, signals). Rows
    that are rejected, score under ``soft`` or have the first word as their centre form no
    group, as in the results to match. A sentence without a group is a single predicate.
    """
    viable = ~F.col("hard_reject") & (F.col("plausibility") >= soft) & (F.col("centre") > 0)
    row = F.struct(
        F.col("centre"), (-row_priority()).alias("order"), "rank", "category", row_priority().alias("priority"),
        F.col("plausibility").alias("score"), "multiword",
    )
    kind = scored.select(row.alias("r")).schema["r"].dataType.simpleString()
    rows = scored.groupBy("sent_key").agg(F.array_sort(F.collect_list(F.when(viable, row))).alias("rows")).join(flags, "sent_key", "left")
    flag = lambda name: F.coalesce(F.col("signals")[name], F.lit(False))
    rows = rows.withColumn("groups", F.transform(centre_groups(F.col("rows"), flag("copula"), kind), group_summary))
    primary = F.array_min(F.transform("groups", lambda g, k: F.struct(
        (-g["best_score"]).alias("order"), (~g["predicate_like"]).alias("weak"), k.alias("at"), g["primary_center"].alias("centre"), g["primary_category"].alias("category")
    )))
    rows = rows.withColumn("primary", primary).withColumn("primary_center", F.coalesce("primary.centre", F.lit(-1))).withColumn(
        "primary_category", F.coalesce("primary.category", F.lit(""))
    ).withColumn("n_groups", F.size("groups"))
    has = lambda kinds: F.exists("groups", lambda g: F.arrays_overlap(g["categories"], F.array(*[F.lit(k) for k in kinds])))
    central, category = F.col("primary_category").isin(CENTRES), F.col("primary_category")
    adjectival = (category == "adjective") | ((category == "") & has(["adjective"]))
    nominal = category.isin(NOMINAL) | has(NOMINAL)
    compound = F.exists("rows", lambda x: x["multiword"] & x["category"].isin(CENTRES))
    single = (F.size(F.filter("groups", lambda g: g["predicate_like"])) <= 1) | (F.col("n_groups") <= 1)
    clause = (
        F.when(~single, "multi_predicate_clause").when(flag("imperative") & central, "imperative_predicate")
        .when(flag("resultative") & (has(["adjective"]) | nominal), "change_of_state_resultative")
        .when(flag("modal") & central, "modal_lexical_event").when(compound, "light_verb_compound_event")
        .when(flag("copula") & adjectival, "predicative_adjectival_state")
        .when(flag("copula") & nominal & flag("static"), "static_copular_identity")
        .when(flag("copula") & nominal, "copular_nominal_classification").otherwise("single_predicate_clause")
    )
    rows = rows.withColumn("clause_type", clause).withColumn("recover_now", F.col("clause_type").isin(list(lexicon.RECOVER_BONUS)))
    most = F.when(F.col("recover_now") | F.col("clause_type").isin(COPULAR_TYPES), 1).otherwise(2)
    for name, limit in words.limits.items():
        most = F.when(F.col("clause_type") == name, limit).otherwise(most)
    compressed = (F.col("recover_now") | F.col("clause_type").isin(COPULAR_TYPES)) & (F.col("n_groups") <= 1)
    hint = (
        F.when(F.col("clause_type") == "imperative_predicate", "directive").when(F.col("clause_type") == "change_of_state_resultative", "change_of_state")
        .when(F.col("clause_type") == "modal_lexical_event", F.when(flag("ability"), "ability").when(flag("passive"), "passive_modal").otherwise("possibility"))
        .when(F.col("clause_type") == "light_verb_compound_event", "light_verb_compound")
    )
    return rows.select(
        "sent_key", "clause_type", "recover_now", F.array_distinct(F.transform("groups", lambda g: g["primary_center"])).alias("centres"),
        "primary_center", "primary_category", single.alias("single_predicate_like"), most.alias("max_per_clause"), compressed.alias("compressed"),
        F.when(compressed, most).otherwise(2).alias("clause_limit"), "groups", hint.alias("hint"),
        "signals.coordination", "signals.subordination",
    )


def precision_filter(
    ranked: DataFrame, arrays: DataFrame, category: Callable[[Column, Column], Column], words: ClauseWords = ClauseWords()
) -> DataFrame:
    """Candidates with their decision, assessed twice.

    The first pass tells the kind of clause. Clauses of the kinds to recover are assessed
    again with what their kind adds, and profiled again; the last profile sets how many
    candidates a sentence keeps. Other sentences come out of both passes alike.
    """
    flags = arrays.select("sent_key", signals(F.col("toks"), category, words).alias("signals"))
    first = clause_profile(lexicon.plausibility(ranked, category), flags, words).select("sent_key", "clause_type")
    again = lexicon.plausibility(ranked.join(first, "sent_key"), category, F.col("clause_type"))
    profile = clause_profile(again, flags, words).select("sent_key", "clause_type", "primary_center", "clause_limit")
    rows = lexicon.competition(again.join(profile, "sent_key"), profiled=True)
    picked = lexicon.select_candidates(lexicon.collapse_same_centre(rows), limit="clause_limit")
    return picked.join(profile.select("sent_key", "clause_type"), "sent_key")
