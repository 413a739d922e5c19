"""Queries on lexicon matches and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvaya.operators import clauses, lexicon
from anvaya.plans import common
from anvaya.plans.registry import query

_CLOSED = common.quoted(common.STOP)
_NEXT = ", ".join(f"lead(word, {k}) OVER s AS x{k}" for k in range(1, 11))
#: The five evidence sources as SQL states them, on word positions.
_BASE = f"""WITH {common.WORD}, {common.TRIGGER},
ahead AS (SELECT sent_key, w, word, lag(word) OVER s AS before, {_NEXT} FROM word WINDOW s AS (PARTITION BY sent_key ORDER BY w)),
single AS (SELECT sent_key, frame_id, 'single' AS source, 2 AS weight, w AS start, w + 1 AS stop FROM ahead JOIN trig ON n = 1 AND head = word),
led AS (SELECT * FROM ahead WHERE length(before) > 1 AND before NOT IN ({_CLOSED})),
prefix AS (
  SELECT sent_key, frame_id, 'single_prefix' AS source, 1 AS weight, w - 1 AS start, w + 1 AS stop FROM led JOIN trig ON n = 1 AND head = word
  UNION ALL
  SELECT sent_key, frame_id, 'multiword_prefix', 1, w - 1, w + 1
  FROM led JOIN (SELECT DISTINCT frame_id, tail FROM trig WHERE n > 1) m ON m.tail = word
  WHERE NOT EXISTS (SELECT 1 FROM trig o WHERE o.n = 1 AND o.head = word AND o.frame_id = m.frame_id)),
ngram AS (SELECT sent_key, frame_id, 'n_gram' AS source, n + 5 AS weight, w AS start, w + n AS stop
  FROM ahead JOIN trig ON n > 1 AND head = word AND term = list_filter([word, x1, x2, x3, x4], lambda x: x IS NOT NULL)[1:n]),
p1 AS (SELECT sent_key, frame_id, w, n, term, [x1, x2, x3, x4, x5, x6, x7, x8, x9, x10] AS xs,
    list_position([x1, x2, x3], term[2]) AS a FROM ahead JOIN trig ON n BETWEEN 2 AND 4 AND head = word),
p2 AS (SELECT *, CASE WHEN n = 2 THEN a ELSE a + list_position(xs[a + 1:a + 3], term[3]) END AS b FROM p1 WHERE a > 0),
p3 AS (SELECT *, CASE WHEN n < 4 THEN b ELSE b + list_position(xs[b + 1:b + 3], term[4]) END AS c FROM p2 WHERE b > 0 AND (n = 2 OR b > a)),
split AS (SELECT sent_key, frame_id, 'split' AS source, n + 4 AS weight, w AS start, w + c + 1 AS stop FROM p3 WHERE c > 0 AND (n < 4 OR c > b)),
evidence AS (SELECT * FROM single UNION ALL SELECT * FROM prefix UNION ALL SELECT * FROM ngram UNION ALL SELECT * FROM split)"""
_SCORED = _BASE + """, scored AS (SELECT sent_key, frame_id, CAST(sum(weight) AS BIGINT) AS score, count(*) AS hits FROM evidence GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sent_key ORDER BY score DESC, hits DESC, frame_id DESC) AS INT) AS rank FROM scored) WHERE rank <= 6)"""
_BEST = _SCORED + """, best AS (SELECT sent_key, frame_id, source, start, stop, quality FROM (
  SELECT *, row_number() OVER (PARTITION BY sent_key, frame_id ORDER BY quality DESC, start, stop, source) AS rn FROM (
    SELECT *, round(CASE source WHEN 'n_gram' THEN 1.0 WHEN 'split' THEN 0.8 WHEN 'single' THEN 0.65 WHEN 'single_prefix' THEN 0.35 ELSE 0.25 END
      + (stop - start) * 0.05, 6)::DOUBLE AS quality FROM evidence)) WHERE rn = 1)"""
_LEX = common.quoted(lexicon.LEXICAL)
_SHUT = common.quoted(lexicon.CLOSED)
_PLAUSIBLE = _BEST + f""", spanned AS (
  SELECT b.sent_key, b.frame_id, w.w, w.word, w.category, CASE WHEN category = 'verb' THEN 1 WHEN category = 'adjective' THEN 2
    WHEN category IN ('noun', 'proper_noun', 'lexical', 'number') THEN 3 WHEN category = 'light_verb' THEN 4 ELSE 5 END AS tier
  FROM best b JOIN word w ON b.sent_key = w.sent_key AND w.w >= b.start AND w.w < b.stop),
anchors AS (SELECT sent_key, frame_id, min(struct_pack(tier := tier, w := w, word := word, category := category)) AS anchor,
  count(*) FILTER (category IN ({_LEX})) AS lexical, count(*) AS n_words, bool_or(category = 'light_verb') AS light,
  bool_or(category IN ('verb', 'adjective', 'noun', 'lexical')) AS fullc FROM spanned GROUP BY ALL),
joined AS (SELECT r.*, b.source, b.start, b.stop, a.anchor.w AS centre, a.anchor.word AS centre_word, a.anchor.category AS category, a.lexical,
  n_words > 1 AND light AND fullc AS multiword, score / max(score) OVER (PARTITION BY r.sent_key) AS share
  FROM ranked r JOIN best b USING (sent_key, frame_id) JOIN anchors a USING (sent_key, frame_id)),
flagged AS (SELECT *, category IN ({_SHUT}) AND NOT multiword AS closed, category IN ('auxiliary', 'copula') AND lexical = 0 AND NOT multiword AS helper FROM joined),
plausible AS (SELECT *, closed OR helper AS hard_reject, round(greatest(0, least(1.5,
  share * 0.32::DOUBLE + CASE WHEN lexical > 0 THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN source = 'n_gram' THEN 0.18::DOUBLE ELSE 0 END
  + CASE WHEN source = 'split' THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN source = 'single_prefix' THEN 0.16::DOUBLE ELSE 0 END
  - CASE WHEN source = 'multiword_prefix' THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN multiword THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN lexical > 1 THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN closed THEN 1.0::DOUBLE ELSE 0 END
  - CASE WHEN helper THEN 0.7::DOUBLE WHEN category = 'auxiliary' THEN 0.3::DOUBLE WHEN category = 'copula' THEN 0.24::DOUBLE ELSE 0 END)), 4) AS plausibility FROM flagged)"""
_COMPETED = _PLAUSIBLE + f""", labelled AS (SELECT *, split_part(frame_id, '.', 1) AS family, CASE WHEN category IN ('auxiliary', 'copula', {_SHUT}) THEN 'helper_like'
  WHEN category = 'verb' THEN 'lexical_verb' WHEN category = 'light_verb' AND multiword THEN 'light_verb_compound' WHEN category = 'light_verb' THEN 'light_verb'
  WHEN category IN ('noun', 'proper_noun', 'lexical', 'number') THEN 'lexical_predicate' WHEN category = 'adjective' THEN 'lexical_adjective' ELSE 'other' END AS label,
  round(greatest(CASE WHEN source IN ('single_prefix', 'multiword_prefix') THEN 1.35::DOUBLE ELSE 0 END
    + CASE WHEN hard_reject AND category IN ('auxiliary', 'copula') THEN 1.5::DOUBLE ELSE 0 END, CASE WHEN lexical <= 0 AND NOT multiword THEN 0.9::DOUBLE ELSE 0 END), 4) AS severity FROM plausible),
prio AS (SELECT *, CASE label WHEN 'lexical_verb' THEN 1.0 WHEN 'light_verb_compound' THEN 0.92 WHEN 'lexical_predicate' THEN 0.8 WHEN 'lexical_adjective' THEN 0.66
  WHEN 'light_verb' THEN 0.42 WHEN 'helper_like' THEN 0.1 ELSE 0.3 END::DOUBLE AS priority FROM labelled),
adj AS (SELECT *, round(plausibility + CASE WHEN priority >= 0.66 THEN 0.10::DOUBLE ELSE 0 END - CASE WHEN label = 'helper_like' THEN 0.14::DOUBLE ELSE 0 END - 0.14::DOUBLE * severity, 4) AS adjusted FROM prio),
comp AS (SELECT *, CAST(row_number() OVER (PARTITION BY sent_key, centre ORDER BY adjusted DESC, priority DESC, severity, lexical DESC, hits DESC, rank) AS INT) AS place FROM adj),
final AS (SELECT *, round(adjusted - CASE WHEN place > 1 THEN 0.10::DOUBLE ELSE 0 END, 4) AS final FROM comp)"""
_DECIDED = _COMPETED + """, decided AS (SELECT *, CASE WHEN hard_reject THEN CASE WHEN closed THEN 'closed_class_trigger' ELSE 'helper_only_trigger' END
  WHEN final < 0.46::DOUBLE THEN 'below_threshold' WHEN row_number() OVER (PARTITION BY sent_key, centre, family ORDER BY final DESC, rank) > 1 THEN 'same_family_duplicate' ELSE 'kept' END AS decision FROM final)"""


def _found(spark: SparkSession, sf_dir: str, *sources: str) -> DataFrame:
    found = lexicon.evidence(common.word_arrays(spark, sf_dir), lexicon.trigger_index(spark, common.FRAMES), common.STOP)
    return found.where(F.col("source").isin(*sources)) if sources else found


def _by_frame(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sent_key", "frame_id").agg(
        F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("start").cast("int").alias("first"), F.max("stop").cast("int").alias("last")
    )


def _frame_sql(cte: str, condition: str = "true") -> str:
    return _BASE + f""" SELECT sent_key, frame_id, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight, CAST(min(start) AS INT) AS first,
 CAST(max(stop) AS INT) AS last FROM {cte} WHERE {condition} GROUP BY ALL"""


@query(_frame_sql("single"))
def trigger_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_frame(_found(spark, sf_dir, "single"))


@query(_frame_sql("prefix"))
def trigger_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_frame(_found(spark, sf_dir, "single_prefix", "multiword_prefix"))


@query(_frame_sql("ngram"))
def trigger_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_frame(_found(spark, sf_dir, "n_gram"))


@query(_frame_sql("split"))
def trigger_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_frame(_found(spark, sf_dir, "split"))


@query(_SCORED + " SELECT sent_key, frame_id, score, hits, rank FROM ranked")
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.candidates(_found(spark, sf_dir)).select("sent_key", "frame_id", "score", "hits", "rank")


@query(_BEST + " SELECT sent_key, frame_id, source, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, quality FROM best")
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.best_evidence(_found(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.plausibility(lexicon.candidates(_found(spark, sf_dir)), common.category)


@query(_PLAUSIBLE + " SELECT sent_key, frame_id, rank, category, CAST(lexical AS BIGINT) AS lexical, multiword, hard_reject, plausibility FROM plausible")
def plausibility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("sent_key", "frame_id", "rank", "category", "lexical", "multiword", "hard_reject", "plausibility")


@query(_COMPETED + " SELECT sent_key, frame_id, label, severity, adjusted, place, final FROM final")
def center_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.competition(_scored(spark, sf_dir)).select("sent_key", "frame_id", "label", "severity", "adjusted", "place", "final")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.collapse_same_centre(lexicon.competition(_scored(spark, sf_dir)))


@query(_DECIDED + " SELECT sent_key, frame_id, decision FROM decided")
def same_center_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("sent_key", "frame_id", "decision")


@query()
def selection_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clustering decides in order, which SQL cannot state."""
    return lexicon.select_candidates(_decided(spark, sf_dir))


@query(_DECIDED + """ SELECT decision, count(*) AS n, count(DISTINCT sent_key) AS sentences, round(avg(plausibility), 4) AS mean FROM decided GROUP BY 1""")
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).groupBy("decision").agg(
        F.count("*").alias("n"), F.count_distinct("sent_key").alias("sentences"), F.round(F.avg("plausibility"), 4).alias("mean")
    )


@query(_DECIDED + """ SELECT sent_key, count(*) AS n, string_agg(frame_id || '=' || decision, ',' ORDER BY rank) AS log FROM decided GROUP BY 1""")
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("rank", F.concat_ws("=", "frame_id", "decision").alias("item"))))
    return _decided(spark, sf_dir).groupBy("sent_key").agg(
        F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x["item"]), ",").alias("log")
    )


#: Stand-ins in the languages of the tables for the words that tell clauses apart.
_CLAUSE_WORDS = clauses.ClauseWords(
    imperative=("eed",), resultative=("reen",), ability=("inst",), passive=("ann",), possibility=("tion",), static=("is", "est"),
    coordination=("and", "et", "und", "y"), subordination=("that", "que"),
)


@query()
def clause_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of centres are merged in order, which SQL cannot state."""
    flags = common.word_arrays(spark, sf_dir).select("sent_key", clauses.signals(F.col("toks"), common.category, _CLAUSE_WORDS).alias("signals"))
    profile = clauses.clause_profile(_scored(spark, sf_dir), flags, _CLAUSE_WORDS)
    groups = F.transform("groups", lambda g: F.concat_ws(":", g["primary_category"], F.array_join(g["indices"], "+")))
    return profile.select("sent_key", "clause_type", "primary_center", "clause_limit", "compressed", "hint", F.array_join(groups, ",").alias("groups"))


@query()
def precision_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both passes of assessment, profile and selection; order decides, as in selection_decisions."""
    return clauses.precision_filter(lexicon.candidates(_found(spark, sf_dir)), common.word_arrays(spark, sf_dir), common.category, _CLAUSE_WORDS)


def _typed(words: DataFrame) -> DataFrame:
    """Clause types of sentences from the categories in them."""
    def has(*names: str):
        return F.max(F.when(F.col("category").isin(*names), 1).otherwise(0)) == 1

    kind = (
        F.when(has("copula") & ~has("verb"), "copular_clause").when(has("light_verb") & has("verb"), "light_verb_compound_event")
        .when(has("auxiliary") & has("verb"), "modal_lexical_event").when(has("verb"), "single_predicate_clause")
        .when(has("adjective"), "predicative_adjectival_state").otherwise("no_predicate")
    )
    return words.groupBy("sent_key").agg(
        kind.alias("clause_type"), F.count_if(F.col("category") == "verb").alias("centres"), F.count("*").alias("n_words")
    )


@query(f"""WITH {common.WORD} SELECT sent_key, CASE WHEN bool_or(category = 'copula') AND NOT bool_or(category = 'verb') THEN 'copular_clause'
 WHEN bool_or(category = 'light_verb') AND bool_or(category = 'verb') THEN 'light_verb_compound_event' WHEN bool_or(category = 'auxiliary') AND bool_or(category = 'verb') THEN 'modal_lexical_event'
 WHEN bool_or(category = 'verb') THEN 'single_predicate_clause' WHEN bool_or(category = 'adjective') THEN 'predicative_adjectival_state' ELSE 'no_predicate' END AS clause_type,
 count(*) FILTER (category = 'verb') AS centres, count(*) AS n_words FROM word GROUP BY 1""")
def clause_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(common.words(spark, sf_dir))
