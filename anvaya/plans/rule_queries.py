"""Queries on small rules, summaries and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvaya.functions import rules
from anvaya.operators import spans, stats
from anvaya.plans import common
from anvaya.plans.registry import query, table

_BANNED = common.quoted(rules.BANNED_POS["argument"])
_STAGE = "CASE o_orderpriority WHEN '1-URGENT' THEN ' Initial ' WHEN '2-HIGH' THEN 'during' WHEN '5-LOW' THEN 'final' ELSE '' END"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'init' WHEN o_orderpriority = '2-HIGH' THEN 'proc' WHEN o_orderpriority = '5-LOW' THEN 'res'
 WHEN o_orderstatus = 'F' THEN 'res' END AS stage FROM (SELECT *, {_STAGE} AS label FROM orders)""")
def subevent_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    label = F.when(priority == "1-URGENT", " Initial ").when(priority == "2-HIGH", "during").when(priority == "5-LOW", "final").otherwise("")
    value = F.when(F.col("o_orderstatus") == "F", "E: Res (x)").otherwise("resume process")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.subevent_of([label], value).alias("stage"))


@query(f"""WITH {common.WORD}, p AS (SELECT sent_key, word, CASE category WHEN 'determiner' THEN 'DET' WHEN 'conjunction' THEN 'CCONJ' WHEN 'number' THEN 'NUM' WHEN 'verb' THEN 'VERB' ELSE '' END AS upos FROM word)
SELECT upos, count(*) AS n, count(*) FILTER (upos NOT IN ({_BANNED})) AS as_argument, count(*) FILTER (upos IN ('', 'VERB')) AS listed, count(*) FILTER (word IN ({common.quoted(common.STOP)})) AS functional FROM p GROUP BY 1""")
def pos_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.col("category")
    upos = F.when(category == "determiner", "DET").when(category == "conjunction", "CCONJ").when(category == "number", "NUM").when(category == "verb", "VERB").otherwise("")
    rows = common.words(spark, sf_dir).select(upos.alias("upos"), "word")
    return rows.groupBy("upos").agg(
        F.count("*").alias("n"), F.count_if(rules.pos_allowed(F.col("upos"), "argument")).alias("as_argument"),
        F.count_if(rules.pos_allowed(F.col("upos"), "argument", rules.pos_list("verb"))).alias("listed"),
        F.count_if(rules.function_only(F.col("word"), common.STOP)).alias("functional"),
    )


@query("""SELECT event_type, CASE event_type WHEN 'click' THEN 'ORG' ELSE 'MISC' END AS hint, count(*) AS n, CAST(sum(abs(event_id - user_id)) AS BIGINT) AS distance,
 count(*) FILTER (event_type = 'view') AS unmarked FROM events GROUP BY 1""")
def role_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    warning = rules.postposition_warning(F.col("event_type"), F.col("props"), ["view"], [], [])
    return rows.groupBy("event_type").agg(
        F.first(rules.role_hint(F.col("event_type"), {"click": "org"})).alias("hint"), F.count("*").alias("n"),
        F.sum(rules.sentence_distance(F.col("event_id"), F.col("user_id"))).alias("distance"), F.count(warning).alias("unmarked"),
    )


@query("""SELECT coalesce(event_type, '*') AS kind, count(*) AS mentions, count(*) FILTER (user_id % 2 = 0) AS by_model, count(*) FILTER (user_id % 2 = 1) AS by_rules, round(avg(event_id), 6) AS confidence
 FROM events GROUP BY ROLLUP (event_type)""")
def mention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("source", F.when(F.col("user_id") % 2 == 0, "model").otherwise("rules"))
    return stats.mention_summary(rows, "event_type", "source", "event_id")


@query("""WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS sent_key, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS sent_key FROM orders WHERE o_orderstatus = 'F')
SELECT c.sent_key, n, n >= 7 AS at_cap, w.sent_key IS NOT NULL AS warned, CASE WHEN n >= 7 AND w.sent_key IS NOT NULL THEN 'cap_hit_and_multi_event_warning' WHEN n >= 7 THEN 'cap_hit'
 WHEN w.sent_key IS NOT NULL THEN 'multi_event_warning' ELSE 'high_event_density' END AS reason FROM c LEFT JOIN w USING (sent_key) ORDER BY n DESC, at_cap DESC, warned DESC, c.sent_key LIMIT 100""")
def density_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("sent_key")).agg(F.count("*").alias("n"))
    warned = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("sent_key"))
    return stats.density_examples(counts, warned, 7, 100).select("sent_key", "n", "at_cap", "warned", "reason")


@query("""SELECT DISTINCT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND trim(l_linestatus) <> '')""")
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return stats.uncovered(table(spark, sf_dir, "orders"), texts, "o_orderkey", "l_linestatus")


@query("""SELECT o_orderkey || '::docdate' AS timex_id, strftime(o_orderdate, '%Y-%m-%d') AS value, 'DATE' AS type, true AS is_document_time FROM orders WHERE o_orderdate IS NOT NULL""")
def document_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sent_key"), F.to_date("o_orderdate").alias("doc_date"))
    return spans.document_times(rows, "sent_key", "doc_date").select("timex_id", "value", "type", "is_document_time")


@query("""SELECT l_orderkey || '||' || l_linenumber || '||' || l_partkey AS key, l_returnflag AS family, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END AS start FROM lineitem""")
def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    chars = F.when(number % 2 == 0, F.array(number, number + 1)).otherwise(F.array(number, number - 1))
    return table(spark, sf_dir, "lineitem").select(
        rules.event_key(F.col("l_orderkey"), number, F.col("l_partkey")).alias("key"), rules.frame_family(F.concat("l_returnflag", F.lit(".01.x"))).alias("family"),
        F.get(rules.span_of(chars, F.array(F.lit(0), F.lit(0))), F.lit(0)).alias("start"),
    )
