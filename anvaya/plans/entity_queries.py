"""Queries on mentions, clusters, refinement and knowledge-base linking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anvaya.functions.text import normalize_lookup
from anvaya.operators import entities, linking
from anvaya.plans import common
from anvaya.plans.registry import query, table


@query(f"""WITH {common.WORD}, a AS (SELECT DISTINCT doc_id, word, 0 AS r FROM word WHERE category = 'verb'), b AS (SELECT DISTINCT doc_id, word, 1 AS r FROM word WHERE length(word) > 9)
SELECT doc_id, count(*) FILTER (r = 0) AS from_first, count(*) FILTER (r = 1) AS from_second FROM (SELECT doc_id, word, min(r) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) GROUP BY 1""")
def mention_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = common.words(spark, sf_dir).select("doc_id", "word", "category")
    first = words.where("category = 'verb'").select("doc_id", "word").distinct()
    second = words.where(F.char_length("word") > 9).select("doc_id", "word").distinct()
    merged = entities.union_mentions([first, second], ["doc_id", "word"])
    return merged.groupBy("doc_id").agg(
        F.count_if(F.col("source_rank") == 0).alias("from_first"), F.count_if(F.col("source_rank") == 1).alias("from_second")
    )


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY round(value, 0) DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def mention_dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("score", F.round("value", 0))
    return entities.keep_best(rows, ["user_id", "event_type"], "score", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type OR epoch(ts) - epoch(lag(ts) OVER w) > 86400 THEN 1 ELSE 0 END AS new
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY user_id, island""")
def token_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    gap = (seconds - F.lag(seconds).over(w)) > 86400
    rows = entities.merge_islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", gap)
    return rows.groupBy("user_id", "island").agg(
        F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id")
    )


@query("""SELECT doc_id, CAST(quality AS INT) AS grade, 'model' AS origin FROM labels UNION ALL
SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END, 'rule' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def rule_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = docs.select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("grade"))
    model = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    return entities.fallback_rows(docs, model, rules, "doc_id")


@query(f"""WITH {common.WORD}, m AS (SELECT *, count(*) OVER (PARTITION BY sent_key, word) AS times FROM word WHERE length(word) > 5)
SELECT sent_key, count(*) AS kept FROM m WHERE category = 'proper_noun' OR times >= 2 GROUP BY 1""")
def repeat_nominal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = common.words(spark, sf_dir).where(F.char_length("word") > 5)
    kept = entities.keep_salient(words, ["sent_key"], "word", F.col("category") == "proper_noun")
    return kept.groupBy("sent_key").agg(F.count("*").alias("kept"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of conversations as mentions, typed by their length."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+"), F.lit(0))).alias("start", "text"))
    size = F.char_length("text") % 3
    kind = F.when(size == 0, "PER").when(size == 1, "ORG").otherwise("LOC")
    return turns.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("sent_id"), "start", "text", F.lower("text").alias("form"), kind.alias("kind")
    )


@query()
def entity_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters depend on order, which SQL cannot state; global ids follow."""
    return entities.number_clusters(entities.cluster_mentions(_mentions(spark, sf_dir)))


@query()
def pronoun_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link changes what later pronouns see."""
    clustered = entities.cluster_mentions(_mentions(spark, sf_dir))
    words = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("sent_id"), F.posexplode(F.split(F.lower("text"), r"\s+")).alias("start", "text")
    ).where(F.col("text").isin("it", "he", "this", "that"))
    pronouns = words.withColumn("plural", F.col("text") == "that").withColumn("hint", F.when(F.col("text") == "he", "PER").otherwise(""))
    return entities.resolve_pronouns(clustered, pronouns)


@query("""WITH v AS (SELECT p_brand, split_part(p_type, ' ', 1) AS kind, count(*) AS n, sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS total, min(p_partkey) AS first FROM part GROUP BY ALL)
SELECT p_brand, CAST(sum(n) AS BIGINT) AS mentions, round(sum(total) / sum(n)::DOUBLE, 4) AS confidence, first(kind ORDER BY n DESC, first) AS kind, max(n) AS votes FROM v GROUP BY 1""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        "p_brand", F.substring_index("p_type", " ", 1).alias("kind"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"), "p_partkey"
    )
    return entities.cluster_summary(parts, "p_brand", "kind", "price", "p_partkey")


_WARN = "CAST(n_chars % 3 AS INT)"
_CONF = f"""round(greatest(0.05, least(1.0, 0.35 + CASE WHEN n_chars > 0 THEN 0.2 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END + CASE WHEN coalesce(quality, 0) = 1 THEN 0.1 ELSE 0 END
 - CASE WHEN coalesce(toxic, 0) = 1 THEN 0.15 ELSE 0 END - 0.06 * ({_WARN} + CASE WHEN lang = 'en' THEN 0 ELSE 1 END + CASE WHEN coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END)))::DOUBLE, 4)"""
_REFINED = f"WITH r AS (SELECT doc_id, {_CONF} AS confidence, CASE WHEN coalesce(toxic, 0) = 1 THEN 'hard_review' WHEN {_WARN} = 2 THEN 'caution' ELSE 'info' END AS worst FROM documents LEFT JOIN labels USING (doc_id))"


def _refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    toxic, good = F.coalesce("toxic", F.lit(0)) == 1, F.coalesce("quality", F.lit(0)) == 1
    warnings = (F.col("n_chars") % 3).cast("int")
    label = F.when(toxic, "overlapping_arguments:x").when(warnings == 2, "multi_event_sentence").otherwise("note")
    return docs.select(
        "doc_id", entities.refine_confidence(F.col("n_chars") > 0, F.col("lang") == "en", good, toxic, warnings).alias("confidence"),
        entities.warning_severity(label).alias("worst"),
    )


@query(_REFINED + " SELECT * FROM r")
def refine_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir)


@query(_REFINED + """ SELECT CASE WHEN worst = 'hard_review' OR confidence < 0.45 THEN 'hard_review' WHEN worst = 'caution' OR confidence < 0.65 THEN 'caution' ELSE 'info_only' END AS priority,
 count(*) AS n, round(avg(confidence), 4) AS mean FROM r GROUP BY 1""")
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _refined(spark, sf_dir)
    return rows.groupBy(entities.review_priority(F.col("confidence"), F.col("confidence"), F.col("worst")).alias("priority")).agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean")
    )


@query("""WITH u AS (SELECT s_nationkey AS nation, s_suppkey AS pos, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS label, s_acctbal AS popularity FROM supplier
 UNION ALL SELECT c_nationkey, 1000000 + c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END FROM customer)
SELECT nation, first(label ORDER BY pos) FILTER (label <> '') AS label, CAST(count(DISTINCT left(label, 3)) FILTER (label <> '') AS INT) AS prefixes, last(popularity ORDER BY pos) FILTER (popularity IS NOT NULL) AS popularity FROM u GROUP BY 1""")
def kb_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("pos"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("label"), F.col("s_acctbal").alias("popularity")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), (F.col("c_custkey") + 1000000).alias("pos"), F.col("c_name").alias("label"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("popularity"),
    )
    rows = suppliers.unionByName(customers).withColumn("prefix", F.when(F.col("label") != "", F.array(F.substring("label", 1, 3))).otherwise(F.array().cast("array<string>")))
    merged = linking.merge_resources(rows, "nation", "pos", ["label"], ["prefix"], ["popularity"])
    return merged.select("nation", "label", F.size("prefix").alias("prefixes"), "popularity")


_ALIASES = r"alias AS (SELECT p_partkey AS resource, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS alias_norm, p_name AS alias, CAST(p_size AS DOUBLE) AS popularity FROM part)"


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("resource"), normalize_lookup("p_name").alias("alias_norm"), F.col("p_name").alias("alias"), F.col("p_size").cast("double").alias("popularity")
    )


_MENTIONS = "mention AS (SELECT l_orderkey * 10 + l_linenumber AS mention, CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE '  ' || upper(p_name) END AS alias FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _lineitem_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    written = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("  "), F.upper("p_name")))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention"), written.alias("alias")).withColumn("alias_norm", normalize_lookup("alias"))


@query(f"WITH {_ALIASES}, {_MENTIONS} SELECT mention, min(resource) AS resource, count(*) AS n FROM mention JOIN alias USING (alias) GROUP BY 1")
def alias_lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = linking.alias_counts(_aliases(spark, sf_dir), "alias")
    return _lineitem_mentions(spark, sf_dir).join(counts, "alias").groupBy("mention").agg(F.min("resource").alias("resource"), F.sum("n").alias("n"))


_NORM = r"lower(trim(regexp_replace(m.alias, '\s+', ' ', 'g')))"


@query(f"WITH {_ALIASES}, {_MENTIONS} SELECT mention, min(resource) AS resource, count(*) AS n FROM mention m JOIN alias a ON a.alias_norm = {_NORM} GROUP BY 1")
def alias_lookup_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = linking.alias_counts(_aliases(spark, sf_dir), "alias_norm")
    return _lineitem_mentions(spark, sf_dir).join(counts, "alias_norm").groupBy("mention").agg(F.min("resource").alias("resource"), F.sum("n").alias("n"))


_LINKS = f"""WITH {_ALIASES}, {_MENTIONS}, f AS (SELECT mention, resource, popularity, 'exact' AS step, 2.4 AS bonus FROM mention JOIN alias USING (alias)
 UNION ALL SELECT mention, resource, popularity, 'normalized', 1.8 FROM mention m JOIN alias a ON a.alias_norm = {_NORM}),
g AS (SELECT mention, resource, round((max(bonus) + least(max(popularity) / 100.0, 0.6))::DOUBLE, 6) AS score, max(popularity) AS popularity, CASE WHEN max(bonus) = 2.4 THEN 'exact' ELSE 'normalized' END AS step FROM f GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY mention ORDER BY score DESC, popularity DESC, resource) AS INT) AS rank FROM g)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("alias", "exact", 2.4), ("alias_norm", "normalized", 1.8)]
    return linking.link_spellings(_lineitem_mentions(spark, sf_dir), _aliases(spark, sf_dir), steps, 3)


@query(_LINKS + " SELECT mention, resource, score, step, rank, round(1 / (1 + exp(-(score - 2.8))), 6) AS confidence FROM k WHERE rank <= 3")
def link_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("mention", "resource", "score", "step", "rank", "confidence")


@query(_LINKS + """ SELECT step, count(*) AS links, count(*) FILTER (1 / (1 + exp(-(score - 2.8))) >= 0.5) AS accepted, min(score) AS low, max(score) AS high FROM k WHERE rank = 1 GROUP BY 1""")
def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("rank = 1").groupBy("step").agg(
        F.count("*").alias("links"), F.count_if(F.col("confidence") >= 0.5).alias("accepted"), F.min("score").alias("low"), F.max("score").alias("high")
    )


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias rows of a small knowledge base: one resource a name and brand, by its label and a redirect."""
    brand = F.regexp_extract("p_brand", r"\d+$", 0).cast("int")
    base = table(spark, sf_dir, "part").groupBy("p_name", brand.alias("brand")).agg(F.count("*").cast("double").alias("popularity"))
    kind = F.when(F.col("brand") % 3 == 0, F.array().cast("array<string>")).when(F.col("brand") % 3 == 1, F.array(F.lit("Thing"))).otherwise(
        F.array(F.lit(linking.ONTOLOGY + "Organisation"))
    )
    rows = base.select(
        F.concat(F.lit("urn:kb/"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("_")), F.lit("_B"), "brand").alias("resource"), "popularity", kind.alias("types"),
        F.col("p_name").alias("label_hi"), F.lit(None).cast("string").alias("label_en"), F.lit(None).cast("string").alias("abstract_hi"),
        F.concat(F.lit("made by "), F.concat(F.lit("brand"), "brand")).alias("abstract_en"),
        F.explode(F.array(
            F.struct(F.col("p_name").alias("alias"), F.lit("hi").alias("lang"), F.lit("label_hi").alias("match_type")),
            F.struct(F.substring_index("p_name", " ", -1).alias("alias"), F.lit("en").alias("lang"), F.lit("redirect").alias("match_type")),
        )).alias("a"),
    ).select("*", "a.*").drop("a")
    return rows.withColumn("alias_norm", normalize_lookup("alias"))


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name"))
    org = F.col("p_partkey") % 2 == 0
    mentions = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("mention"), F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("the "), written)).otherwise(written).alias("raw"),
        written.alias("cleaned"), written.alias("normalized"), F.array().cast("array<string>").alias("alternates"), F.substring_index("p_name", " ", -1).alias("head"),
        F.lit("").alias("head_lemma"), F.lit("").alias("lemma"), F.concat_ws(" ", "p_name", F.lower(F.replace("p_brand", F.lit("#")))).alias("sentence"),
        F.when(org, "ORG").otherwise("").alias("ner_label"), F.lit("").alias("role"),
        F.when(org, F.array(F.lit("Organisation"))).otherwise(F.array().cast("array<string>")).alias("expected"),
    )
    return linking.cascade(mentions, _resources(spark, sf_dir), 5)


#: Parts' names have no Devanagari letters, so the similarity of sounds is 0 throughout.
_CASCADE = """WITH r AS (SELECT p_name, CAST(regexp_extract(p_brand, '[0-9]+$') AS INT) AS brand, CAST(count(*) AS DOUBLE) AS popularity FROM part GROUP BY ALL),
res AS (SELECT *, 'urn:kb/' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '_') || '_B' || brand AS resource,
  brand % 3 AS kind, string_split(p_name, ' ')[-1] AS tail FROM r),
al AS (SELECT resource, popularity, kind, brand, p_name, p_name AS alias, 'hi' AS lang, 'label_hi' AS match_type FROM res
  UNION ALL SELECT resource, popularity, kind, brand, p_name, tail, 'en', 'redirect' FROM res),
pool AS (SELECT *, count(*) OVER (PARTITION BY alias) AS pool FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY popularity DESC, resource, match_type) AS place FROM al) WHERE place <= 30),
m AS (SELECT p_partkey AS mention, CASE WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name END AS cleaned, CASE WHEN p_partkey % 3 = 2 THEN 'the ' ELSE '' END AS lead,
  string_split(p_name, ' ')[-1] AS head, p_partkey % 2 = 0 AS org, list_distinct(string_split(p_name || ' ' || lower(replace(p_brand, '#', '')), ' ')) AS terms FROM part),
st AS (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7]) AS pos, unnest(['exact_cleaned_hi', 'normalized_cleaned_hi', 'exact_raw_hi', 'normalized_raw_hi', 'normalized_text', 'syntax_head_form', 'syntax_head_form_normalized']) AS step,
  unnest([cleaned, lower(cleaned), lead || cleaned, lower(lead || cleaned), lower(cleaned), head, lower(head)]) AS q FROM m),
f AS (SELECT mention, resource, pos, step, place, popularity, match_type,
  CASE lang WHEN 'hi' THEN 0.8 ELSE -0.35 END
  + CASE WHEN match_type = 'label_hi' AND alias = cleaned THEN 4.8 WHEN match_type = 'label_hi' AND alias = lower(cleaned) THEN 4.1 ELSE 0 END
  + CASE WHEN match_type = 'label_hi' AND alias = lower(lead || cleaned) THEN 3.1 ELSE 0 END
  + CASE WHEN match_type = 'redirect' THEN 2.6 ELSE 0 END + CASE WHEN contains(step, 'cleaned') THEN 1.1 ELSE 0 END + CASE WHEN contains(step, 'head') THEN 1.0 ELSE 0 END
  + CASE WHEN org AND kind = 2 THEN 2.5 WHEN org AND kind = 1 THEN -1.5 WHEN kind = 0 AND org THEN -1.1 WHEN kind = 0 THEN -0.15 ELSE 0 END
  + 0.3 * least(4, len(list_intersect(terms, list_distinct(string_split(p_name, ' ') || [alias])))) + 0.2 * least(4, len(list_intersect(terms, ['made', 'by', 'brand' || brand])))
  + least(popularity, 1000) * 0.001 + CASE WHEN pool >= 4 AND kind = 0 THEN -2.2 ELSE 0 END + CASE WHEN kind = 0 THEN -3.5 ELSE 0 END AS score
  FROM st JOIN pool ON alias = q),
b AS (SELECT * FROM (SELECT mention, resource, popularity, round(score::DOUBLE, 6) AS score, match_type || ':' || step AS matched_via,
  row_number() OVER (PARTITION BY mention, resource ORDER BY round(score::DOUBLE, 6) DESC, pos, place) AS rn FROM f) WHERE rn = 1),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY mention ORDER BY score DESC, popularity DESC, resource) AS INT) AS rank FROM b)"""


@query(_CASCADE + " SELECT mention, resource, score, matched_via, rank, round(1 / (1 + exp(-(score - 2.8))), 6) AS confidence FROM k WHERE rank <= 5")
def link_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).select("mention", "resource", "score", "matched_via", "rank", "confidence")


@query(_CASCADE + """, t AS (SELECT *, 1 / (1 + exp(-(score - 2.8))) AS confidence FROM k WHERE rank = 1)
SELECT p_partkey AS mention, coalesce(resource, '') AS resource, CASE WHEN rank IS NULL THEN 'missed' WHEN confidence < 0.6 THEN 'low_confidence' ELSE 'linked' END AS bucket FROM part LEFT JOIN t ON mention = p_partkey""")
def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _cascade(spark, sf_dir).where("rank = 1").select("mention", "resource", "confidence")
    every = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mention"), F.lit(True).alias("linkable"))
    return linking.audit(every, best, 0.6).select("mention", "resource", "bucket")


@query("""WITH f AS (SELECT 'n' || n_nationkey AS s, 'region' AS p, 'r' || n_regionkey AS o FROM nation UNION ALL SELECT 'n' || n_nationkey, 'label', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'label', r_name FROM region),
x AS (SELECT 'n' || n_nationkey AS s, 'region' AS p, 'r' || n_regionkey AS o FROM nation WHERE n_nationkey % 2 = 0)
SELECT s, p, o FROM f WHERE p IN ('region', 'label') EXCEPT SELECT s, p, o FROM x""")
def fact_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")

    def fact(df: DataFrame, mark: str, key: str, p: str, o) -> DataFrame:
        return df.select(F.concat(F.lit(mark), key).alias("s"), F.lit(p).alias("p"), o.alias("o"))

    in_region = fact(nation, "n", "n_nationkey", "region", F.concat(F.lit("r"), "n_regionkey"))
    facts = in_region.unionByName(fact(nation, "n", "n_nationkey", "label", F.col("n_name"))).unionByName(fact(region, "r", "r_regionkey", "label", F.col("r_name")))
    known = fact(nation.where("n_nationkey % 2 = 0"), "n", "n_nationkey", "region", F.concat(F.lit("r"), "n_regionkey"))
    return linking.new_facts(facts, known, ["region", "label"])
