"""Queries on counts: density, caps, coverage, reconciliation, reviews, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvaya.operators import stats
from anvaya.operators.tokens import sentences
from anvaya.plans.registry import query, table

_LINES = "SELECT l_orderkey AS key, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY 1"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").cast("int").alias("n"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").cast("int").alias("n"))


@query(f"""WITH c AS ({_LINES}) SELECT count(*) AS units, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.5), 4) AS median, round(quantile_cont(n, 0.95), 4) AS p95,
 count(*) FILTER (n >= 7) AS cap_hits, round(count(*) FILTER (n >= 7) / count(*), 4) AS cap_rate FROM c""")
def event_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.density(_lines(spark, sf_dir), "n", 7)


@query(f"WITH c AS ({_LINES}) SELECT n AS size, count(*) AS units FROM c GROUP BY 1")
def density_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_lines(spark, sf_dir), "n")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.95), 4) AS p95 FROM c GROUP BY 1""")
def density_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("event_type").agg(*[F.round(F.percentile("n", F.lit(q)), 4).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95)])


@query(f"""WITH c AS ({_LINES}), k AS (SELECT unnest(range(1, 8)) AS cap) SELECT CAST(cap AS INT) AS cap, CAST(sum(least(n, cap)) AS BIGINT) AS kept, round(avg(least(n, cap)), 4) AS mean, count(*) FILTER (n >= cap) AS cap_hits FROM c, k GROUP BY 1""")
def cap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cap_sweep(_lines(spark, sf_dir), "n", list(range(1, 8)))


@query(f"WITH c AS ({_LINES}) SELECT key, n, least(n, 7) AS stable_cap FROM c")
def cap_stabilized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stabilised_at(_lines(spark, sf_dir), "key", "n", list(range(1, 8)))


@query("""SELECT lang, count(*) AS docs, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*), 4) AS coverage, count(*) FILTER (quality = 1) AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("has", F.lit(1))
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return joined.groupBy("lang").agg(
        F.count("*").alias("docs"), F.count("has").alias("labelled"), F.round(F.count("has") / F.count("*"), 4).alias("coverage"), F.count_if(F.col("quality") == 1).alias("good")
    )


@query("""WITH u AS (SELECT 'quality' AS column_name, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM labels)
SELECT column_name, value, n, round(n / (sum(n) OVER (PARTITION BY column_name))::DOUBLE, 6) AS share FROM (SELECT column_name, value, count(*) AS n FROM u GROUP BY ALL)""")
def annotation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_distribution(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query("""SELECT source, count(*) AS extracted, count(l.doc_id) AS reviewed, count(*) FILTER (toxic = 1) AS flagged, round(avg(n_chars) FILTER (l.doc_id IS NOT NULL), 4) AS mean_chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def precision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("has", F.lit(1))
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    return joined.groupBy("source").agg(
        F.count("*").alias("extracted"), F.count("has").alias("reviewed"), F.count_if(F.col("toxic") == 1).alias("flagged"),
        F.round(F.avg(F.when(F.col("has") == 1, F.col("n_chars"))), 4).alias("mean_chars"),
    )


@query("""SELECT doc_id, quality, toxic, n_chars, CAST(NULL AS VARCHAR) AS reviewer, CAST(NULL AS VARCHAR) AS verdict FROM documents JOIN labels USING (doc_id) ORDER BY toxic DESC, quality, n_chars DESC, doc_id LIMIT 50""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")
    return stats.review_queue(rows, [F.desc("toxic"), F.asc("quality"), F.desc("n_chars"), F.asc("doc_id")], 50)


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919) % 10007, doc_id) AS rn FROM documents) WHERE rn <= 20""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct((F.col("doc_id") * 7919) % 10007, "doc_id")
    return stats.stratified_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", order, 20)


@query("""WITH a AS (SELECT o_orderkey AS key, CAST(o_orderkey % 5 AS BIGINT) AS n FROM orders), b AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1)
SELECT key, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff,
 CASE WHEN coalesce(b.n, 0) = 0 THEN 'missing_right' WHEN coalesce(a.n, 0) = 0 THEN 'missing_left' ELSE 'count_differs' END AS reason FROM a FULL OUTER JOIN b USING (key) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 5).alias("n"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n"))
    return stats.reconcile(expected, found, "key")


@query("""SELECT p_type, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS owners, count(DISTINCT p_brand) AS n_owners, min(p_name) AS example FROM part GROUP BY 1""")
def role_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.role_inventory(table(spark, sf_dir, "part"), "p_type", "p_brand", "p_name")


@query()
def match_events_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches, best pair first: the greedy pass has no SQL form."""
    def places(pattern: str) -> DataFrame:
        docs = sentences(table(spark, sf_dir, "documents"))
        spread = docs.select("sent_key", F.posexplode(F.split(F.lower("text"), " ")).alias("start", "word"))
        size = F.when(F.char_length("word") > 6, 2).otherwise(1)
        return spread.where(F.col("word").rlike(pattern)).select("sent_key", "start", (F.col("start") + size).alias("stop"))

    return stats.match_greedy(places("^th"), places("^the"), ["sent_key"])


@query("""SELECT count(*) AS accepted, count(DISTINCT t) AS distinct_lines FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE length(t) BETWEEN 12 AND 280""".replace("\\\\", "\\"))
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anvaya.functions.text import stripped

    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("t")).select(stripped("t").alias("t"))
    return lines.where(F.char_length("t").between(12, 280)).agg(F.count("*").alias("accepted"), F.count_distinct("t").alias("distinct_lines"))
