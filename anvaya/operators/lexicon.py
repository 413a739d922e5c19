"""Lexicon-driven candidates: retrieval, evidence, plausibility, competition, selection.

A trigger index is a small table (frame_id, term array<string>). Sentences come
as rows with all their words (sent_key, toks). Words meet the index once, in one
equi-join; a lexicon is broadcast only if the engine finds it small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weights of the evidence sources and their quality.
SINGLE, PREFIX, NGRAM, SPLIT = 2, 1, 5, 4
MAX_GAP = 3
#: Rows of a trigger index that is sent to every task.
SMALL = 10_000
QUALITY = {
    "n_gram": 1.0, "split": 0.8, "single": 0.65, "single_prefix": 0.35, "multiword_prefix": 0.25,
}
#: Plausibility bonuses and penalties.
BONUS = {
    "retrieval_score": 0.32, "lexical_anchor": 0.22, "n_gram": 0.18, "split": 0.08,
    "multiword_predicate": 0.12, "lexical_span": 0.08,
}
PENALTY = {"single_prefix": 0.16, "multiword_prefix": 0.18, "closed_class_anchor": 1.0,
           "helper_only": 0.7, "auxiliary_anchor": 0.3, "copula_anchor": 0.24}
MIN_PLAUSIBILITY, MIN_FINAL = 0.28, 0.46
CENTRE_PRIORITY = {
    "lexical_verb": 1.0, "light_verb_compound": 0.92, "predicative_adjective": 0.88,
    "predicative_nominal": 0.84, "lexical_predicate": 0.8, "lexical_adjective": 0.66,
    "light_verb": 0.42, "other": 0.3, "helper_like": 0.1,
}
#: What the kinds of clauses to recover add to a candidate and to its centre.
RECOVER_BONUS = {
    "imperative_predicate": 0.06, "change_of_state_resultative": 0.07, "modal_lexical_event": 0.05, "light_verb_compound_event": 0.05,
}
RECOVER_CENTRE_BONUS = {
    "imperative_predicate": 0.04, "change_of_state_resultative": 0.05, "modal_lexical_event": 0.04, "light_verb_compound_event": 0.04,
}
#: How far each category is from the centre that such a clause wants: verb,
#: adjective, nominal in a multiword predicate, nominal, light verb.
RECOVER_RANK = {
    "imperative_predicate": (0.0, 1.4, 0.4, 1.4, 2.0), "change_of_state_resultative": (1.0, 0.0, 0.3, 0.3, 2.0),
    "modal_lexical_event": (0.0, 1.2, 0.5, 1.2, 2.0), "light_verb_compound_event": (0.6, 0.0, 0.0, 0.0, 2.0),
}
MISALIGNED, ROOT_BONUS = 0.08, 0.08
LEXICAL = ["verb", "adjective", "noun", "proper_noun", "lexical", "light_verb"]
CLOSED = ["pronoun", "determiner", "particle", "adp", "conjunction", "closed_class"]


def trigger_index(spark: SparkSession, triggers: dict[str, Sequence[str]]) -> DataFrame:
    """Distinct (frame_id, term, n, head, tail) of a lexicon of frames and their triggers."""
    rows = sorted({(frame, tuple(t.lower().split())) for frame, ts in triggers.items() for t in ts})
    table = spark.createDataFrame(
        [(f, list(t)) for f, t in rows if t], "frame_id string, term array<string>"
    )
    return table.select(
        "frame_id", "term", F.size("term").alias("n"), F.get("term", F.lit(0)).alias("head"),
        F.element_at("term", -1).alias("tail"),
    )


def _found(source: str, weight: Column | int, start: Column, items: Column) -> Column:
    return F.struct(
        F.lit(source).alias("source"), (F.lit(weight) if isinstance(weight, int) else weight).cast("int").alias("weight"),
        start.cast("int").alias("start"), (start + F.size(items)).cast("int").alias("stop"), items.alias("items"),
    )


def evidence(arrays: DataFrame, index: DataFrame, closed: Sequence[str] = (), gap: int = MAX_GAP) -> DataFrame:
    """All evidence rows (sent_key, frame_id, source, weight, start, stop, items).

    ``arrays`` has (sent_key, toks), a sentence a row. Each word meets the index once: as
    the first word of a trigger, or as the last of a multiword one. Those that do are taken
    with the word before and as many after as the longest trigger may reach. ``items``
    are the words of the span as written. The sources:

    - single: a one-word trigger; single_prefix: with a content word of two letters or
      more right before it; multiword_prefix: such a word before the last word of a
      multiword trigger of a frame that has no one-word trigger like it.
    - n_gram: a multiword trigger as it stands; split: its words in order, each the
      nearest next one within ``gap`` words of the last.
    """
    reach = 1 + gap * max(_longest(index) - 1, 0)
    one = index.where("n = 1").select("frame_id", F.col("head").alias("word"))
    tails = index.where("n > 1").select("frame_id", F.col("tail").alias("word")).distinct().join(one, ["frame_id", "word"], "left_anti")
    keys = index.select("frame_id", F.col("head").alias("word"), "n", "term").unionByName(
        tails.select("frame_id", "word", F.lit(0).alias("n"), F.lit(None).cast("array<string>").alias("term"))
    )
    w, n, several = F.col("w"), F.col("n"), F.col("n") > 1
    before = F.when(w > 0, F.get("toks", w - 1))
    led = F.coalesce((F.char_length(before) > 1) & ~F.lower(before).isin(list(closed)), F.lit(False))
    near = F.lit(False)
    for k in range(1, gap + 1):
        near = near | F.coalesce(F.lower(F.get("toks", w + k)) == F.get("term", F.lit(1)), F.lit(False))
    # What cannot be evidence goes before its words are copied: a trigger whose second word is not within the gap, a last word with none before it.
    met = _meet(arrays, index, keys).where(F.when(n == 1, True).when(n == 0, led).otherwise(near)).select(
        "sent_key", "frame_id", "n", "term", "w", before.alias("before"), led.alias("led"), F.slice("toks", w + 1, F.lit(reach)).alias("ahead")
    )

    low = F.when(several, F.transform("ahead", F.lower))
    pair = F.array(F.col("before"), F.get("ahead", F.lit(0)))

    def step(at: Column, part: Column) -> Column:
        """Place of the next word after place ``at``, or -1."""
        found = F.array_position(F.slice(F.col("low"), at + 2, F.lit(gap)), part)
        return F.when(at < 0, at).when(found > 0, at + found.cast("int")).otherwise(F.lit(-1))

    rest = F.slice("term", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0)))
    whole = several & (F.slice("low", F.lit(1), F.greatest(n, F.lit(1))) == F.col("term"))
    place = F.when(several, F.aggregate(rest, F.lit(0), step)).otherwise(F.lit(-1))
    found = met.withColumn("low", low).withColumn("place", place).select("sent_key", "frame_id", F.explode(F.array_compact(F.array(
        F.when(n == 1, _found("single", SINGLE, w, F.slice("ahead", 1, 1))),
        F.when((n == 1) & F.col("led"), _found("single_prefix", PREFIX, w - 1, pair)),
        F.when((n == 0) & F.col("led"), _found("multiword_prefix", PREFIX, w - 1, pair)),
        F.when(whole, _found("n_gram", n + NGRAM, w, F.slice("ahead", F.lit(1), F.greatest(n, F.lit(1))))),
        F.when(F.col("place") >= 0, _found("split", n + SPLIT, w, F.slice("ahead", F.lit(1), F.col("place") + 1))),
    ))).alias("e"))
    return found.select("sent_key", "frame_id", "e.*")


def _meet(arrays: DataFrame, index: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (frame_id, word, n, term) at each word ``w`` of a sentence, with all its words (toks).

    Other words go before anything is made of them. Against an index of up to ``SMALL``
    rows nothing is shuffled; against a larger one the bare words are, and the sentences once.
    """
    few = [r for r in index.select("head", "tail").limit(SMALL + 1).collect()]
    if len(few) <= SMALL:
        spread = arrays.select("sent_key", "toks", F.posexplode("toks").alias("w", "tok")).select("sent_key", "toks", "w", F.lower("tok").alias("word"))
        return spread.where(F.col("word").isin(sorted({x for r in few for x in r}))).join(F.broadcast(keys), "word")
    spread = arrays.select("sent_key", F.posexplode("toks").alias("w", "tok")).select("sent_key", "w", F.lower("tok").alias("word"))
    return spread.join(keys, "word").join(arrays, "sent_key")


def _longest(index: DataFrame) -> int:
    """Words of the longest trigger."""
    return index.agg(F.max("n")).first()[0] or 0


def candidates(found: DataFrame, top_k: int = 6) -> DataFrame:
    """The best frames of each sentence by (score, hits, frame), all descending, with their best evidence.

    The best evidence is that of highest quality; longer spans help; ties go to the first.
    """
    quality = F.round(_quality() + F.greatest(F.col("stop") - F.col("start"), F.lit(0)) * 0.05, 6)
    scored = found.groupBy("sent_key", "frame_id").agg(
        F.sum("weight").alias("score"), F.count("*").alias("hits"),
        F.min(F.struct((-quality).alias("quality"), "start", "stop", "source", "items")).alias("best"),
    )
    w = Window.partitionBy("sent_key").orderBy(F.desc("score"), F.desc("hits"), F.desc("frame_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select(
        "sent_key", "frame_id", "score", "hits", "rank", "best.source", "best.start", "best.stop",
        (-F.col("best.quality")).alias("quality"), "best.items",
    )


def _quality() -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for source, value in QUALITY.items():
        out = out.when(F.col("source") == source, F.lit(value))
    return out.otherwise(F.lit(0.2))


def best_evidence(found: DataFrame) -> DataFrame:
    """The best evidence of every frame found in a sentence, however many there are."""
    quality = F.round(_quality() + F.greatest(F.col("stop") - F.col("start"), F.lit(0)) * 0.05, 6)
    best = F.min(F.struct((-quality).alias("quality"), "start", "stop", "source"))
    return found.groupBy("sent_key", "frame_id").agg(best.alias("best")).select(
        "sent_key", "frame_id", "best.source", "best.start", "best.stop", (-F.col("best.quality")).alias("quality")
    )


def plausibility(
    ranked: DataFrame, category: Callable[[Column, Column], Column], clause: Column | None = None
) -> DataFrame:
    """Score every candidate by its best evidence and the categories of the words under it.

    ``category`` tells that of a word, from its lower case and as written. The anchor is
    the first word of the best tier: verb, adjective, nominal, light verb, anything.
    ``clause`` tells the kind of clause where it is known: one to recover adds its bonus,
    and a change of state looks for its centre among adjectives and nominals first.
    """
    change = F.lit(False) if clause is None else F.coalesce(clause == "change_of_state_resultative", F.lit(False))
    recover = F.lit(0.0)
    for kind_, value in RECOVER_BONUS.items() if clause is not None else ():
        recover = F.when(clause == kind_, value).otherwise(recover)

    def tier(kind: Column) -> Column:
        return (
            F.when(kind == "verb", F.when(change, 4).otherwise(1)).when(kind == "adjective", 2)
            .when(kind.isin("noun", "proper_noun", "lexical", "number"), 3).when(kind == "light_verb", 5).otherwise(6)
        )

    # Lower case is bound first: a category asks for it many times.
    parts = F.transform(F.transform("items", lambda t: F.struct(t.alias("tok"), F.lower(t).alias("word"))), lambda x, k: F.struct(
        (F.col("start") + k).alias("w"), x["word"].alias("word"), category(x["word"], x["tok"]).alias("category")
    ))
    tiers = F.transform("parts", lambda x: F.struct(tier(x["category"]).alias("tier"), x["w"].alias("w"), x["word"].alias("word"), x["category"].alias("category")))
    count = lambda *kinds: F.size(F.filter("parts", lambda x: x["category"].isin(*kinds)))
    top = Window.partitionBy("sent_key")
    rows = (
        ranked.withColumn("parts", parts).withColumn("anchor", F.array_min(tiers))
        .withColumn("lexical", count(*LEXICAL).cast("long"))
        .withColumn("share", F.col("score") / F.max("score").over(top))
        .withColumn("multiword", (F.size("parts") > 1) & (count("light_verb") > 0) & (count("verb", "adjective", "noun", "lexical") > 0))
        .withColumn("category", F.col("anchor.category"))
    )
    closed = F.col("category").isin(CLOSED) & ~F.col("multiword")
    helper = F.col("category").isin("auxiliary", "copula") & (F.col("lexical") == 0) & ~F.col("multiword")
    zero = F.lit(0.0)

    def part(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(zero)

    raw = (
        F.col("share") * BONUS["retrieval_score"] + part(F.col("lexical") > 0, BONUS["lexical_anchor"])
        + part(F.col("source") == "n_gram", BONUS["n_gram"]) + part(F.col("source") == "split", BONUS["split"])
        - part(F.col("source") == "single_prefix", PENALTY["single_prefix"])
        - part(F.col("source") == "multiword_prefix", PENALTY["multiword_prefix"])
        + part(F.col("multiword"), BONUS["multiword_predicate"])
        + part(F.col("lexical") > 1, BONUS["lexical_span"])
        - part(closed, PENALTY["closed_class_anchor"])
        - F.when(helper, PENALTY["helper_only"])
        .when(F.col("category") == "auxiliary", PENALTY["auxiliary_anchor"])
        .when(F.col("category") == "copula", PENALTY["copula_anchor"]).otherwise(zero)
        + F.when(~(closed | helper) & (F.col("lexical") > 0), recover).otherwise(zero)
    )
    return rows.withColumn("hard_reject", closed | helper).withColumn(
        "plausibility", F.round(F.greatest(zero, F.least(F.lit(1.5), raw)), 4)
    ).withColumn(
        "reason", F.when(closed, "closed_class_trigger").when(helper, "helper_only_trigger")
        .when(F.col("plausibility") < MIN_PLAUSIBILITY, "low_trigger_plausibility"),
    ).select(
        "sent_key", "frame_id", F.substring_index("frame_id", ".", 1).alias("family"), "rank", "score",
        "hits", "source", "start", "stop", F.col("anchor.w").alias("centre"),
        F.col("anchor.word").alias("centre_word"), "category", "lexical", "multiword", "hard_reject",
        "plausibility", "reason",
    )


def centre_label() -> Column:
    """What kind of predicate centre a scored candidate has."""
    nominal = F.col("category").isin("noun", "proper_noun", "lexical", "number")
    return (
        F.when(F.col("category").isin("auxiliary", "copula", *CLOSED), "helper_like")
        .when(F.col("category") == "verb", "lexical_verb")
        .when((F.col("category") == "light_verb") & F.col("multiword"), "light_verb_compound")
        .when(F.col("category") == "light_verb", "light_verb")
        .when(nominal, "lexical_predicate").when(F.col("category") == "adjective", "lexical_adjective")
        .otherwise("other")
    )


def mismatch() -> Column:
    """How badly the trigger pattern fits."""
    pattern = F.col("source").isin("single_prefix", "multiword_prefix")
    helper = F.col("hard_reject") & F.col("category").isin("auxiliary", "copula")
    raw = F.when(pattern, 1.35).otherwise(0.0) + F.when(helper, 1.5).otherwise(0.0)
    bare = (F.col("lexical") <= 0) & ~F.col("multiword")
    return F.round(F.greatest(raw, F.when(bare, 0.9).otherwise(0.0)), 4)


def recover_rank() -> Column:
    """How far a candidate's category is from the centre that its clause wants."""
    category, nominal = F.col("category"), F.col("category").isin("noun", "proper_noun", "lexical", "number")
    out = F.lit(0.0)
    for clause, (verb, adjective, compound, noun, light) in RECOVER_RANK.items():
        several = F.col("multiword")
        here = (
            F.when(category == "verb", verb).when(category == "adjective", F.when(several, min(compound, adjective)).otherwise(adjective))
            .when(nominal, F.when(several, compound).otherwise(noun)).when(category == "light_verb", light)
        )
        out = F.when(F.col("clause_type") == clause, here.otherwise(1.0)).otherwise(out)
    return out


def _clause_share() -> Column:
    """What the profile of its clause adds to a candidate."""
    bonus = F.lit(0.0)
    lexical = ~F.col("label").isin("helper_like", "other", "light_verb", "light_verb_compound")
    for clause, value in RECOVER_CENTRE_BONUS.items():
        bonus = F.when((F.col("clause_type") == clause) & lexical, value).otherwise(bonus)
    root = (F.col("centre") > 0) & (F.col("centre") == F.col("primary_center")) & ~F.col("label").isin("helper_like", "other")
    return bonus - MISALIGNED * recover_rank() + F.when(root, ROOT_BONUS).otherwise(0.0)


def competition(scored: DataFrame, profiled: bool = False) -> DataFrame:
    """Candidates with one centre compete; the best is the winner, the others pay.

    With ``profiled`` rows have (clause_type, primary_center) of their clause, which count too.
    """
    priority = F.when(F.lit(False), F.lit(0.0))
    for label, value in CENTRE_PRIORITY.items():
        priority = priority.when(F.col("label") == label, F.lit(value))
    order = [F.desc("adjusted"), F.desc("priority"), "severity", F.desc("lexical"), F.desc("hits"), "rank"]
    w = Window.partitionBy("sent_key", "centre").orderBy(*order)
    rows = (
        scored.withColumn("label", centre_label()).withColumn("severity", mismatch())
        .withColumn("priority", priority.otherwise(F.lit(0.25)))
        .withColumn("adjusted", F.round(
            F.col("plausibility") + F.when(F.col("priority") >= 0.66, 0.10).otherwise(0.0)
            - F.when(F.col("label") == "helper_like", 0.14).otherwise(0.0) - 0.14 * F.col("severity")
            + (_clause_share() if profiled else 0.0), 4))
        .withColumn("place", F.row_number().over(w))
    )
    return rows.withColumn(
        "final", F.round(F.col("adjusted") - F.when(F.col("place") > 1, 0.10).otherwise(0.0), 4)
    )


def collapse_same_centre(rows: DataFrame) -> DataFrame:
    """Per sentence, centre and family only the best stays; with the decision for each row."""
    w = Window.partitionBy("sent_key", "centre", "family").orderBy(F.desc("final"), "rank")
    decision = (
        F.when(F.col("hard_reject"), F.col("reason")).when(F.col("final") < MIN_FINAL, "below_threshold")
        .when(F.row_number().over(w) > 1, "same_family_duplicate").otherwise("kept")
    )
    return rows.withColumn("decision", decision)


def similarity(a: tuple, b: tuple) -> float:
    """Of two candidates (final, rank, frame_id, family, start, stop, centre, centre_word, decision)."""
    shared = max(0, min(a[5], b[5]) - max(a[4], b[4]))
    ratio = shared / max(1, a[5] - a[4], b[5] - b[4])
    return round(
        0.35 * (a[6] == b[6]) + 0.15 * (abs(a[6] - b[6]) <= 1) + 0.25 * (ratio >= 0.5)
        + 0.15 * (a[3] == b[3]) + 0.1 * (a[7] == b[7]), 4
    )


def select_candidates(
    rows: DataFrame, min_similarity: float = 0.6, per_centre: int = 2, most: int = 3, limit: str | None = None
) -> DataFrame:
    """Leader clustering of a sentence's candidates and the final pick.

    The best first: a candidate like a leader so far is its duplicate, others lead. Of the
    leaders ``per_centre`` stay for each predicate centre and ``most`` for the sentence, or
    as many as the column ``limit`` tells if that is fewer.
    Order decides, so each sentence is worked through in one go; it has at most the few
    candidates that retrieval kept.
    """
    schema = "sent_key string, frame_id string, cluster int, decision string, final double"

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, items, bound in zip(batch.sent_key, batch["items"], batch["bound"]):
                leaders: list[tuple] = []
                kept: dict[int, int] = {}
                for row in sorted((tuple(x.values()) for x in items), key=lambda r: (-r[0], r[1])):
                    final, _, frame, *_, centre, _, decision = row
                    if decision != "kept":
                        out.append((key, frame, -1, decision, final))
                        continue
                    home = next((k for k, x in enumerate(leaders) if similarity(row, x) >= min_similarity), None)
                    if home is not None:
                        out.append((key, frame, home, "duplicate_of_leader", final))
                        continue
                    leaders.append(row)
                    if sum(kept.values()) >= bound:
                        verdict = "sentence_limit"
                    elif kept.get(centre, 0) >= per_centre:
                        verdict = "centre_limit"
                    else:
                        verdict = "accepted"
                        kept[centre] = kept.get(centre, 0) + 1
                    out.append((key, frame, len(leaders) - 1, verdict, final))
            yield pd.DataFrame(out, columns=["sent_key", "frame_id", "cluster", "decision", "final"])

    item = F.struct("final", "rank", "frame_id", "family", "start", "stop", "centre", "centre_word", "decision")
    bound = F.lit(most) if limit is None else F.least(F.lit(most), F.col(limit))
    grouped = rows.groupBy("sent_key").agg(F.sort_array(F.collect_list(item)).alias("items"), F.min(bound).alias("bound"))
    return grouped.mapInPandas(pick, schema)
