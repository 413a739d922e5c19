"""Queries on the layers of the graph, counts of mentions, and surface tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvaya.functions import text
from anvaya.functions.iri import BASE, RDF_TYPE, RDFS_LABEL, XSD
from anvaya.operators import layers
from anvaya.plans.registry import query, table


def _sql(source: str, subject: str, items: list[tuple[str, str, str, str]]) -> str:
    """Quads as SQL states them; an item is (predicate, kind of object, expression, condition)."""
    def term(kind: str, x: str) -> str:
        if kind == "iri":
            return f"'<' || {x} || '>'"
        if kind in ("decimal", "integer"):
            value = f"printf('%.6f', ({x})::DOUBLE)" if kind == "decimal" else f"CAST({x} AS VARCHAR)"
            return f"""'"' || {value} || '"^^<{XSD}{kind}>'"""
        return f"""'"' || {x} || '"@{kind}'"""

    return " UNION ".join(
        f"SELECT '<' || {subject} || '> <{p}> ' || {term(kind, x)} || ' <{BASE}graph> .' AS quad FROM {source} WHERE {condition}"
        for p, kind, x, condition in items
    )


def _node(kind: str, *parts: str) -> str:
    return f"'{BASE}{kind}/' || " + " || '/' || ".join(f"replace(CAST({p} AS VARCHAR), ' ', '_')" for p in parts)


_MENTION = """(SELECT 's' || c_nationkey AS sent_key, c_custkey % 7 AS start, c_custkey % 7 + CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE length(c_name) END AS stop,
 upper(CASE c_custkey % 4 WHEN 0 THEN 'MISC' WHEN 1 THEN 'per' WHEN 2 THEN 'ORG' ELSE 'loc' END) AS kind, c_name AS text, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'rule' END AS engine,
 CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS raw_label, CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END AS confidence FROM customer)"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), "c_nationkey").alias("sent_key"), (key % 7).alias("start"),
        (key % 7 + F.when(key % 10 == 0, 0).otherwise(F.char_length("c_name"))).alias("stop"),
        F.when(key % 4 == 1, "per").when(key % 4 == 2, "ORG").when(key % 4 == 3, " loc").alias("label"), F.col("c_name").alias("text"),
        F.when(key % 3 != 0, "rule").alias("engine"), F.when(key % 5 == 0, F.col("c_mktsegment")).alias("raw_label"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000).alias("confidence"),
    )


_SENTENCE = _node("sentence", "sent_key")


@query(_sql(f"(SELECT * FROM {_MENTION} WHERE stop > start)", _node("mention", "sent_key", "start", "stop", "kind"), [
    (RDF_TYPE, "iri", f"'{BASE}class/mention'", "true"), (RDF_TYPE, "iri", f"'{BASE}class/phrase'", "true"),
    (RDF_TYPE, "iri", f"'{BASE}class/person'", "kind = 'PER'"), (RDF_TYPE, "iri", f"'{BASE}class/place'", "kind = 'LOC'"),
    (BASE + "anchorOf", "hi", "text", "true"), (BASE + "start", "integer", "start", "true"), (BASE + "stop", "integer", "stop", "true"),
    (BASE + "inSentence", "iri", _SENTENCE, "true"), (BASE + "derivedFrom", "iri", _SENTENCE, "true"), (BASE + "entityType", "en", "kind", "true"),
    (BASE + "detectedBy", "en", "engine", "true"), (BASE + "rawLabel", "en", "raw_label", "raw_label IS NOT NULL"),
    (BASE + "confidence", "decimal", "confidence", "confidence IS NOT NULL"),
]))
def mention_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.mention_quads(_mentions(spark, sf_dir), {"PER": "person", "LOC": "place"})


_TIMEX = """(SELECT 's' || o_custkey AS sent_key, 't' || o_orderkey AS timex_id, strftime(o_orderdate, '%Y-%m-%d') AS text, CASE WHEN o_orderkey % 4 = 0 THEN 'DURATION' ELSE 'DATE' END AS kind,
 CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'unresolved' ELSE 'resolved' END AS status, o_orderkey AS event_id FROM orders)"""
_TIME = _node("timex", "sent_key", "timex_id")


def _timexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), "o_custkey").alias("sent_key"), F.concat(F.lit("t"), "o_orderkey").alias("timex_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"), F.when(key % 4 == 0, "duration").alias("kind"),
        F.when(key % 5 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("value"), F.when(key % 5 != 0, "resolved").alias("status"), key.alias("event_id"),
    )


@query(_sql(_TIMEX, _TIME, [
    (RDF_TYPE, "iri", f"'{BASE}class/timex'", "true"), (RDF_TYPE, "iri", f"'{BASE}class/phrase'", "true"), (BASE + "anchorOf", "hi", "text", "true"),
    (BASE + "inSentence", "iri", _SENTENCE, "true"), (BASE + "derivedFrom", "iri", _SENTENCE, "true"), (BASE + "timexType", "en", "kind", "true"),
    (BASE + "resolutionStatus", "en", "status", "true"), (BASE + "timexValue", "en", "value", "value IS NOT NULL"),
]) + " UNION " + _sql(f"(SELECT * FROM {_TIMEX} WHERE event_id IN (SELECT l_orderkey FROM lineitem))", _node("event", "event_id"), [(BASE + "hasTime", "iri", _TIME, "true")]))
def timex_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = _timexes(spark, sf_dir)
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"))
    return layers.timex_quads(times).unionByName(layers.time_links(times, events))


_MEMBERS = "(SELECT s_nationkey AS cluster_id, s_suppkey AS mention, CASE WHEN s_suppkey % 2 = 0 THEN 'head' END AS role FROM supplier)"
_CLUSTERS = f"""(SELECT n_nationkey AS cluster_id, n_name AS label, CASE WHEN n_regionkey = 0 THEN 'MISC' ELSE 'LOC' END AS kind, n_nationkey / 100 AS confidence, coalesce(n, 0) AS n
 FROM nation LEFT JOIN (SELECT cluster_id, count(*) AS n FROM {_MEMBERS} GROUP BY 1) m ON cluster_id = n_nationkey)"""


@query(_sql(_CLUSTERS, _node("entity", "cluster_id"), [
    (RDF_TYPE, "iri", f"'{BASE}class/entity'", "true"), (RDFS_LABEL, "hi", "label", "true"), (BASE + "normalized", "hi", "lower(label)", "true"),
    (BASE + "entityType", "en", "kind", "true"), (BASE + "mentionCount", "integer", "n", "true"), (BASE + "confidence", "decimal", "confidence", "true"),
]) + " UNION " + _sql(f"(SELECT * FROM {_MEMBERS} WHERE mention % 3 <> 0)", _node("mention", "mention"), [
    (BASE + "refersTo", "iri", _node("entity", "cluster_id"), "true"), (BASE + "clusterRole", "en", "role", "role IS NOT NULL"),
]))
def cluster_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("label"), F.when(F.col("n_regionkey") != 0, "LOC").alias("kind"), (F.col("n_nationkey") / 100).alias("confidence")
    )
    members = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("cluster_id"), F.col("s_suppkey").alias("mention"), F.when(F.col("s_suppkey") % 2 == 0, "head").alias("role")
    )
    return layers.cluster_quads(clusters, members, members.where("mention % 3 <> 0"))


_LINK = """(SELECT p_partkey AS mention, p_brand AS resource, CASE WHEN p_size % 2 = 0 THEN 'alias' ELSE 'unknown' END AS via, CASE WHEN p_size % 3 = 0 THEN 'hi' END AS lang,
 p_size / 50 AS confidence FROM part WHERE p_size / 50 >= 0.3)"""


@query(_sql(_LINK, _node("mention", "mention"), [
    (BASE + "sameAs", "iri", _node("resource", "replace(resource, '#', '%23')"), "true"), (BASE + "matchedVia", "en", "via", "true"),
    (BASE + "matchedLang", "en", "lang", "lang IS NOT NULL"), (BASE + "linkEngine", "en", "'local'", "true"), (BASE + "linkConfidence", "decimal", "confidence", "true"),
]))
def link_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return layers.link_quads(table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("mention"), F.col("p_brand").alias("resource"), F.when(size % 2 == 0, "alias").alias("via"),
        F.when(size % 3 == 0, "hi").alias("lang"), F.lit(" ").alias("engine"), (size / 50).alias("confidence"),
    ), 0.3)


@query(f"""SELECT kind, engine, count(*) AS mentions, count(DISTINCT sent_key) AS sentences, count(confidence) AS scored, round(avg(confidence), 4) AS mean
FROM {_MENTION} GROUP BY ALL""")
def ner_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by type and engine."""
    kind = F.upper(F.coalesce(text.stripped("label"), F.lit("MISC")))
    return _mentions(spark, sf_dir).groupBy(kind.alias("kind"), F.coalesce("engine", F.lit("unknown")).alias("engine")).agg(
        F.count("*").alias("mentions"), F.count_distinct("sent_key").alias("sentences"), F.count("confidence").alias("scored"),
        F.round(F.avg("confidence"), 4).alias("mean"),
    )


@query(f"""SELECT kind, status, count(*) AS timexes, count(DISTINCT sent_key) AS sentences, count(value) AS resolved, round(count(value) / count(*), 4) AS rate FROM {_TIMEX} GROUP BY ALL""")
def temporal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time expressions by type and status."""
    kind = F.upper(F.coalesce("kind", F.lit("DATE")))
    return _timexes(spark, sf_dir).groupBy(kind.alias("kind"), F.coalesce("status", F.lit("unresolved")).alias("status")).agg(
        F.count("*").alias("timexes"), F.count_distinct("sent_key").alias("sentences"), F.count("value").alias("resolved"),
        F.round(F.count("value") / F.count("*"), 4).alias("rate"),
    )


_TITLES = ["UN_GA", "NASA_launch", "New_Delhi", "A1-B2", "Ab", "IIT%20Delhi", "WHO"]
_FORMS = ["it", "12 men", "of", "Delhi", "", "he", "river"]


@query(f"""WITH x AS (SELECT p_partkey, {_TITLES}[p_partkey % {len(_TITLES)} + 1] AS t, {_FORMS}[p_partkey % {len(_FORMS)} + 1] AS f FROM part)
SELECT p_partkey, regexp_matches(replace(t, '%20', ' '), '^[A-Z0-9]{{2,}}(?:[_-][A-Z0-9]{{2,}})+$') OR regexp_matches(split_part(replace(t, '%20', ' '), '_', 1), '^[A-Z0-9]{{3,}}$') AS acronym,
 regexp_matches(f, '[0-9]') AS numeric, f IN ('it', 'he') AS pronoun, f IN ('', 'of') AS functional FROM x""")
def surface_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mention's form or a resource's title looks like."""
    def pick(items: list[str]):
        return F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("p_partkey") % len(items) + 1).cast("int"))

    form = pick(_FORMS)
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.acronym_title(F.concat(F.lit("http://x.org/resource/"), pick(_TITLES))).alias("acronym"),
        text.numeric_form(form).alias("numeric"), text.listed(form, ["it", "He"]).alias("pronoun"),
        ((form == "") | text.listed(form, ["Of"])).alias("functional"),
    )
