"""Queries on text: sentences, tokens, normalisers, forms, keys, fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvaya.functions import iri, text
from anvaya.operators import tokens as tok
from anvaya.plans import common
from anvaya.plans.registry import query, table


@query(f"WITH {common.SENTENCE} SELECT doc_id, CAST(sent_id AS INT) AS sent_id, sent_key, text FROM sentence")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.sentences(spark, sf_dir)


@query(f"""WITH {common.TOKEN} SELECT sent_key, CAST(idx AS INT) AS idx, tok, CAST(start AS INT) AS start, stop FROM token""")
def tokenize_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.tokens(spark, sf_dir).select("sent_key", "idx", "tok", "start", "stop")


@query(f"WITH {common.WORD} SELECT doc_id, category, count(*) AS n FROM word GROUP BY ALL")
def token_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.words(spark, sf_dir).groupBy("doc_id", "category").agg(F.count("*").alias("n"))


_SUFFIXES = ["ing", "ation", "ed", "er", "es"]
_STEM = "CASE " + " ".join(
    f"WHEN ends_with(word, '{s}') AND length(word) > {len(s) + 1} THEN left(word, length(word) - {len(s)})" for s in _SUFFIXES
) + " ELSE word END"


@query(f"WITH {common.WORD} SELECT {_STEM} AS stem, count(*) AS n, count(DISTINCT word) AS words FROM word GROUP BY 1")
def verb_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = common.words(spark, sf_dir)
    return words.groupBy(text.strip_suffix("word", _SUFFIXES).alias("stem")).agg(
        F.count("*").alias("n"), F.count_distinct("word").alias("words")
    )


_MARKERS = ["of", "to", "in", "de", "la", "der"]


@query(f"""WITH {common.TOKEN} SELECT sent_key, idx::INT AS idx, (idx + 1 + CASE WHEN m1 THEN CASE WHEN m2 THEN 2 ELSE 1 END ELSE 0 END)::INT AS stop
FROM (SELECT sent_key, idx, tok, coalesce(lead(tok, 1) OVER w IN ({common.quoted(_MARKERS)}), false) AS m1,
  coalesce(lead(tok, 2) OVER w IN ({common.quoted(_MARKERS)}), false) AS m2 FROM token WINDOW w AS (PARTITION BY sent_key ORDER BY idx))
WHERE tok IN ('and', 'que', 'und')""")
def case_marker_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.sentences(spark, sf_dir).withColumn("toks", tok.token_array())
    spread = rows.select("sent_key", "toks", F.posexplode("toks").alias("idx", "tok")).where(
        F.col("tok").isin("and", "que", "und")
    )
    return spread.select("sent_key", "idx", text.expand_over("toks", F.col("idx") + 1, _MARKERS).alias("stop"))


@query(r"""WITH n AS (SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'c' || c_custkey, 'Dr. ' || c_name || ' of the' FROM customer),
f AS (SELECT id, trim(regexp_replace(name, '\s+', ' ', 'g')) AS base FROM n),
g AS (SELECT id, base, regexp_replace(base, '(?i)^(?:(?:dr|mr|prof)\.? )+', '') AS a, regexp_replace(base, '(?i)(?: (?:of|the))+$', '') AS b FROM f),
h AS (SELECT id, list_distinct([base, a, b, regexp_replace(a, '(?i)(?: (?:of|the))+$', '')]) AS forms FROM g)
SELECT id, array_to_string(list_sort(forms), '|') AS forms, CAST(len(forms) AS INT) AS n FROM h""")
def entity_surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(
        table(spark, sf_dir, "customer").select(
            F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("Dr. "), "c_name", F.lit(" of the")).alias("name")
        )
    )
    forms = text.surface_forms("name", ["dr", "mr", "prof"], ["of", "the"])
    return names.select("id", F.array_join(F.sort_array(forms), "|").alias("forms"), F.size(forms).alias("n"))


@query(r"""SELECT doc_id, md5(lower(regexp_replace(regexp_replace(replace(text, '_', ' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS lookup_md5,
 length(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '', 'g')) AS n_plain FROM documents""")
def normalize_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = F.regexp_replace(text.squeezed("text"), r"\s+", "")
    return docs.select("doc_id", F.md5(text.normalize_lookup("text")).alias("lookup_md5"), F.char_length(plain).cast("long").alias("n_plain"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(translate(text, '“”‘’`', '""'''''''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS entity_md5,
 md5(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS eval_md5,
 md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '[?।.!]+$', ''), '\s+', '', 'g')) AS answer_md5 FROM documents""")
def normalize_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.normalize_quotes("text")).alias("entity_md5"), F.md5(text.normalize_eval("text")).alias("eval_md5"),
        F.md5(text.normalize_answer("text")).alias("answer_md5"),
    )


@query("""SELECT event_id, substr(sha1(concat_ws('|', user_id, event_type, props)), 1, 12) AS stable FROM events""")
def stable_event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", iri.stable_id(F.lit(None).cast("string"), "user_id", "event_type", "props").alias("stable")
    )


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x)), '|') AS parts, CAST(len(string_split(p_type, ' ')) AS INT) AS n FROM part""")
def list_field_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = text.distinct_spellings(text.list_field(F.replace(F.col("p_type"), F.lit(" "), F.lit(";"))))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(F.transform(items, F.upper), "|").alias("parts"), F.size(items).alias("n")
    )


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


_NUMBERS = {"un": 1, "der": 2, "two": 2, "ten": 10}
_NUM_SQL = "CASE WHEN regexp_matches(word, '^[0-9]{1,9}$') THEN TRY_CAST(word AS INT) " + " ".join(f"WHEN word = '{w}' THEN {n}" for w, n in _NUMBERS.items()) + " END"


@query(f"WITH {common.WORD}, v AS (SELECT doc_id, {_NUM_SQL} AS number FROM word) SELECT doc_id, count(number) AS n, CAST(sum(number) AS BIGINT) AS total FROM v GROUP BY 1")
def numeric_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.words(spark, sf_dir).withColumn("number", text.numeric_surface("word", _NUMBERS)).groupBy("doc_id").agg(
        F.count("number").alias("n"), F.sum("number").alias("total")
    )


@query("""SELECT event_id, round(1 / (1 + exp(-(value / 100 - 2.8))), 6) AS confidence,
 round(greatest(0.0, least(0.99, 0.9 - 0.08 * (event_id % 5) - 0.03 * greatest(user_id % 4 - 1, 0) + 0.01 * least(length(event_type), 6))), 4) AS lookup FROM events""")
def logistic_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", text.logistic(F.col("value") / 100).alias("confidence"),
        text.lookup_confidence(F.col("event_id") % 5, F.col("user_id") % 4, F.char_length("event_type")).alias("lookup"),
    )


@query(f"""WITH {common.TOKEN} SELECT sent_key, count(*) AS spans, CAST(sum(length(ctx)) AS BIGINT) AS chars FROM (
 SELECT t.sent_key, substr(s.text, greatest(t.start - 12, 0) + 1, t.stop + 12 - greatest(t.start - 12, 0)) AS ctx
 FROM token t JOIN sentence s USING (sent_key) WHERE t.tok IN ('and', 'und', 'que')) GROUP BY 1""")
def context_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = common.sentences(spark, sf_dir)
    toks = tok.tokens(sents).where(F.col("tok").isin("and", "und", "que")).select("sent_key", "start", "stop")
    cut = toks.join(sents.select("sent_key", "text"), "sent_key").withColumn("ctx", text.excerpt("text", "start", "stop", 12))
    return cut.groupBy("sent_key").agg(F.count("*").alias("spans"), F.sum(F.char_length("ctx")).alias("chars"))


_LABELS = {"PERSON": "PER", "GPE": "LOC"}


@query("""SELECT event_id, CASE WHEN b IN ('PERSON') THEN 'PER' WHEN b IN ('GPE') THEN 'LOC' WHEN b LIKE '%PER%' THEN 'PER' WHEN b LIKE '%ORG%' THEN 'ORG'
 WHEN b LIKE '%LOC%' THEN 'LOC' WHEN b LIKE '%TIME%' THEN 'TIME' WHEN b LIKE '%DATE%' THEN 'TIME' WHEN b LIKE '%NUM%' THEN 'NUM' ELSE 'MISC' END AS label
FROM (SELECT event_id, regexp_replace(upper((['B-PERSON', 'I-ORGANISATION', 'gpe', 'B_LOCATION', 'datetime', 'click', 'xnum'])[event_id % 7 + 1]), '^[BIESLU][-_]', '') AS b FROM events)""")
def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("B-PERSON", "I-ORGANISATION", "gpe", "B_LOCATION", "datetime", "click", "xnum")]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.canonical_label(raw, _LABELS).alias("label"))


@query(r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, 'the [a-z]+ [a-z]+') AS m FROM documents)
SELECT doc_id, CAST(len(m) AS INT) AS n, array_to_string(list_distinct(list_sort(m)), '|') <> '' AS has FROM s""")
def phrase_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("the [a-z]+ [a-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"), (F.size(found) > 0).alias("has"))


@query(f"""WITH {common.WORD}, p AS (SELECT doc_id, sent_key, w, word, lead(word) OVER (PARTITION BY sent_key ORDER BY w) AS nxt FROM word)
SELECT doc_id, count(*) AS spans, count(*) FILTER (word || ' ' || nxt <> 'of the') AS errors FROM p WHERE word = 'of' AND nxt IS NOT NULL GROUP BY 1""")
def span_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.sentences(spark, sf_dir).select("doc_id", F.explode(F.array(F.transform(tok.word_array(), F.lower))).alias("toks"))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("toks") - 2, F.lit(0))), lambda k: F.coalesce(
        (F.get("toks", k) == "of") & F.get("toks", k + 1).isNotNull(), F.lit(False)))
    items = F.transform(at, lambda k: F.struct(F.lit("span").alias("name"), F.lit("of the").alias("text"), k.alias("start"), (k + 2).alias("stop")))
    bound = rows.select("doc_id", "toks", F.explode(F.array(items)).alias("items"))
    checked = bound.select("doc_id", F.size("items").alias("spans"), F.size(text.validate_spans("toks", "items")).alias("errors"))
    return checked.where("spans > 0").groupBy("doc_id").agg(F.sum("spans").alias("spans"), F.sum("errors").alias("errors"))


@query("""SELECT doc_id, CASE WHEN n_chars > 0 THEN printf('%.2f%%', round(100.0 * len(string_split(text, chr(10))) / n_chars, 2)) ELSE 'n/a' END AS rate FROM documents""")
def rate_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.rate_text(F.size(F.split("text", "\n")), "n_chars").alias("rate"))


#: Letters of names in another script, to have something to write in ASCII.
_LATIN, _SCRIPT = "abdefghiklmnoprstuy#0123456789", "अबदइफगहईकलमनओपरसतउय#ािुेौ्ख़ळज"
_SINGLE = {k: v for k, v in (text.VOWELS | text.CONSONANTS | text.VOWEL_SIGNS).items() if len(v) == 1}
_MULTI = {k: v for k, v in (text.VOWELS | text.CONSONANTS | text.VOWEL_SIGNS).items() if len(v) > 1}
_BARE = f"regexp_replace(translate(lower(s_name), '{_LATIN}', '{_SCRIPT}'), '[^{''.join(text.CONSONANTS)}{''.join(text.VOWEL_SIGNS)}{text.VIRAMA}{''.join(text.VOWELS)}]', ' ', 'g')"
_INHERENT = f"'([{''.join(text.CONSONANTS)}])([^a{''.join(text.VOWEL_SIGNS)}{text.VIRAMA}]|$)', '\\1a\\2', 'g'"
_ASCII = f"regexp_replace(regexp_replace({_BARE}, {_INHERENT}), {_INHERENT})"  # twice, as a match takes the letter after it
for _letter, _ascii in _MULTI.items():
    _ASCII = f"replace({_ASCII}, '{_letter}', '{_ascii}')"


def _in_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.translate(F.lower("s_name"), _LATIN, _SCRIPT).alias("form"))


@query(f"SELECT s_suppkey, translate({_ASCII}, '{''.join(_SINGLE)}{text.VIRAMA} ', '{''.join(_SINGLE.values())}') AS ascii FROM supplier")
def transliteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_script(spark, sf_dir).select("s_suppkey", text.transliterate("form").alias("ascii"))


@query()
def transliteration_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ratio of matching blocks between a mention's forms and a title, which SQL has no function for."""
    forms = F.array(text.transliterate("form"), text.transliterate(F.concat(F.col("form"), F.lit(" का"))))
    return _in_script(spark, sf_dir).select("s_suppkey", F.round(text.best_ratio(forms, F.array(text.ascii_form("s_name"))), 4).alias("similarity"))
