"""Queries on graphs: quads, parsing, census, checks, shapes, star joins, answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anvaya.functions.iri import BASE, RDF_TYPE, RDFS_LABEL, XSD
from anvaya.operators import graph, qa
from anvaya.plans.registry import query, table

_G = f"<{BASE}graph> ."


def _enc(x: str) -> str:
    return f"replace(CAST({x} AS VARCHAR), ' ', '_')"


def _sql_entity(source: str, kind: str, key: str, label: str, links=(), numbers=()) -> str:
    s = f"'<{BASE}{kind}/' || {_enc(key)} || '>'"
    out = [f"SELECT {s} || ' <{RDF_TYPE}> <{BASE}class/{kind}> {_G}' AS quad FROM {source}",
           f"""SELECT {s} || ' <{RDFS_LABEL}> "' || {label} || '"@en {_G}' FROM {source} WHERE {label} IS NOT NULL"""]
    out += [f"SELECT {s} || ' <{BASE}{p}> <{BASE}{other}/' || {_enc(c)} || '> {_G}' FROM {source} WHERE {c} IS NOT NULL" for p, c, other in links]
    out += [f"""SELECT {s} || ' <{BASE}{p}> "' || printf('%.6f', {c}) || '"^^<{XSD}decimal> {_G}' FROM {source} WHERE {c} IS NOT NULL""" for p, c in numbers]
    return " UNION ALL ".join(out)


_QUADS = "quad AS (" + " UNION ALL ".join([
    _sql_entity("region", "region", "r_regionkey", "r_name"),
    _sql_entity("nation", "nation", "n_nationkey", "n_name", [("inRegion", "n_regionkey", "region")]),
    _sql_entity("supplier", "supplier", "s_suppkey", "s_name", [("inNation", "s_nationkey", "nation")], [("balance", "s_acctbal")]),
]) + ")"


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_quads(table(spark, sf_dir, "region"), "region", "r_regionkey", "r_name").unionByName(
        graph.entity_quads(table(spark, sf_dir, "nation"), "nation", "n_nationkey", "n_name", {"inRegion": ("n_regionkey", "region")})
    ).unionByName(graph.entity_quads(
        table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "s_name", {"inNation": ("s_nationkey", "nation")}, {"balance": "s_acctbal"}
    ))


_PARSED = _QUADS + r""", parsed AS (SELECT regexp_extract(quad, '^<([^>]*)> <([^>]*)> ', 1) AS s, regexp_extract(quad, '^<([^>]*)> <([^>]*)> ', 2) AS p,
 CASE WHEN regexp_matches(quad, '^<[^>]*> <[^>]*> <') THEN regexp_extract(quad, '^<[^>]*> <[^>]*> <([^>]*)>', 1) ELSE regexp_extract(quad, '^<[^>]*> <[^>]*> "([^"]*)"', 1) END AS o,
 CASE WHEN regexp_matches(quad, '^<[^>]*> <[^>]*> <') THEN 'uri' ELSE 'literal' END AS kind FROM quad)"""


@query(f"WITH {_QUADS} SELECT quad FROM quad")
def quads_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quads(spark, sf_dir)


@query(f"WITH {_PARSED} SELECT s, p, o, kind FROM parsed")
def quads_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.parse(_quads(spark, sf_dir)).select("s", "p", "o", "kind")


@query(f"WITH {_PARSED} SELECT o AS node_class, count(DISTINCT s) AS n FROM parsed WHERE p = '{RDF_TYPE}' GROUP BY 1 UNION ALL SELECT 'triples', count(*) FROM parsed")
def graph_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.census(graph.parse(_quads(spark, sf_dir)))


_BROKEN = _PARSED + f""", broken AS (SELECT * FROM parsed WHERE NOT (p = '{RDFS_LABEL}' AND s LIKE '%supplier/%7') AND NOT (p = '{RDF_TYPE}' AND s LIKE '%nation/_'))"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph without some labels and types, so that checks have something to find."""
    q = graph.parse(_quads(spark, sf_dir))
    no_label = (F.col("p") == RDFS_LABEL) & F.col("s").like("%supplier/%7")
    no_type = (F.col("p") == RDF_TYPE) & F.col("s").like("%nation/_")
    return q.where(~no_label & ~no_type)


@query(f"WITH {_BROKEN}" + f""" SELECT 'error' AS severity, 'missing_property' AS code, s AS node, '{RDFS_LABEL}' AS detail FROM (SELECT DISTINCT s FROM broken WHERE p = '{RDF_TYPE}' AND o = '{BASE}class/supplier') n
 WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.s = n.s AND b.p = '{RDFS_LABEL}')
 UNION ALL SELECT DISTINCT 'warning', 'dangling_reference', s, o FROM broken x WHERE p = '{BASE}inNation' AND NOT EXISTS (SELECT 1 FROM broken t WHERE t.s = x.o AND t.p = '{RDF_TYPE}' AND t.o = '{BASE}class/nation')""")
def graph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.checks(
        _broken(spark, sf_dir), {BASE + "class/supplier": [RDFS_LABEL]}, [(BASE + "start", BASE + "stop")], {BASE + "inNation": BASE + "class/nation"}
    )


def _shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([
        (BASE + "class/supplier", RDFS_LABEL, 1, None, None), (BASE + "class/supplier", BASE + "balance", 1, XSD + "decimal", None),
        (BASE + "class/supplier", BASE + "inNation", 1, None, BASE + "class/nation"), (BASE + "class/nation", RDFS_LABEL, 1, XSD + "string", None),
    ], "target string, path string, min_count int, datatype string, class string")


@query(f"WITH {_BROKEN}" + f""" SELECT s AS node, '{RDFS_LABEL}' AS path, '0' AS detail FROM (SELECT DISTINCT s FROM broken WHERE p = '{RDF_TYPE}' AND o = '{BASE}class/supplier') n
 WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.s = n.s AND b.p = '{RDFS_LABEL}')""")
def shape_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shape_violations(_broken(spark, sf_dir), _shapes(spark)).where("constraint = 'minCount'").select("node", "path", "detail")


@query(f"WITH {_BROKEN}" + f""" SELECT x.s AS node, 'datatype' AS constraint, x.o AS detail FROM broken x JOIN broken t ON t.s = x.s AND t.p = '{RDF_TYPE}' AND t.o = '{BASE}class/nation' WHERE x.p = '{RDFS_LABEL}'
 UNION ALL SELECT x.s, 'class', x.o FROM broken x WHERE p = '{BASE}inNation' AND NOT EXISTS (SELECT 1 FROM broken t WHERE t.s = x.o AND t.p = '{RDF_TYPE}')""")
def shape_datatype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shape_violations(_broken(spark, sf_dir), _shapes(spark)).where("constraint <> 'minCount'").select("node", "constraint", "detail")


@query(f"WITH {_PARSED} SELECT s, max(o) FILTER (p = '{RDFS_LABEL}') AS label, max(o) FILTER (p = '{BASE}inNation') AS nation, max(o) FILTER (p = '{BASE}balance') AS balance FROM parsed WHERE s LIKE '%supplier/%' GROUP BY 1")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.star(graph.parse(_quads(spark, sf_dir)), BASE + "class/supplier", {"label": RDFS_LABEL, "nation": BASE + "inNation", "balance": BASE + "balance"})


_QA = """WITH e AS (SELECT event_id, user_id AS actor, event_type AS action, CAST(json_extract(props, '$.k') AS BIGINT) AS place, value, strftime(ts, '%Y-%m-%d') AS day FROM events)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.from_json("props", "k long")["k"].alias("place"), "value",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


@query(_QA + """ SELECT action, actor, event_id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY value DESC, event_id) AS rn FROM e) WHERE rn <= 3""")
def qa_who(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.ranked(_facts(spark, sf_dir), ["action"], [F.desc("value"), F.asc("event_id")], 3).select("action", "actor", "event_id", "rank")


@query(_QA + """ SELECT place, day, event_id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY value DESC, event_id) AS rn FROM e) WHERE rn <= 3""")
def qa_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.ranked(_facts(spark, sf_dir), ["place"], [F.desc("value"), F.asc("event_id")], 3).select("place", "day", "event_id", "rank")


@query(_QA + """ SELECT actor, count(*) AS events, count(DISTINCT action) AS actions, array_to_string(list_sort(list_distinct(list(action))), ',') AS list FROM e GROUP BY 1""")
def qa_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).groupBy("actor").agg(
        F.count("*").alias("events"), F.count_distinct("action").alias("actions"), F.array_join(F.sort_array(F.collect_set("action")), ",").alias("list")
    )


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(^|\s)(who|qui|wer|the)(\s|$)') THEN 'who' WHEN regexp_matches(lower(text), '(^|\s)(where|ou|wo|in)(\s|$)') THEN 'where'
 WHEN regexp_matches(lower(text), '(^|\s)(when|quand|wann|to)(\s|$)') THEN 'when' ELSE 'list' END AS intent FROM conversations""")
def qa_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = {"who": ["who", "qui", "wer", "the"], "where": ["where", "ou", "wo", "in"], "when": ["when", "quand", "wann", "to"]}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", qa.intent("text", patterns).alias("intent"))


@query()
def qa_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved evidence, prompt and answer of the deterministic stand-in model."""
    from anvaya.operators import models

    top = qa.ranked(_facts(spark, sf_dir), ["action"], [F.desc("value"), F.asc("event_id")], 5)
    prompts = qa.prompts(top, "action", F.concat(F.lit("who did "), F.col("action")), F.format_string("event %d: actor %d on %s", "event_id", "actor", "day"))
    return models.answer(prompts)


@query("""WITH RECURSIVE node AS (SELECT 'r' || r_regionkey AS id, r_name AS v FROM region UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END FROM nation UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name END FROM supplier),
edge AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
up(id, cur, level) AS (SELECT id, id, 0 FROM node UNION ALL SELECT up.id, e.parent, level + 1 FROM up JOIN edge e ON e.id = up.cur)
SELECT up.id, first(n.v ORDER BY up.level) AS value, CAST(min(up.level) AS INT) AS level FROM up JOIN node n ON n.id = up.cur WHERE n.v IS NOT NULL GROUP BY up.id""")
def hierarchy_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = uuid.uuid4().hex  # calls at the same time do not see each other's views
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    mark = lambda m, c: F.concat(F.lit(m), c)
    region.select(mark("r", "r_regionkey").alias("id"), F.col("r_name").alias("value")).unionByName(
        nation.select(mark("n", "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("value"))
    ).unionByName(supplier.select(mark("s", "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("value"))).createOrReplaceTempView(f"nodes_{own}")
    nation.select(mark("n", "n_nationkey").alias("id"), mark("r", "n_regionkey").alias("parent")).unionByName(
        supplier.select(mark("s", "s_suppkey").alias("id"), mark("n", "s_nationkey").alias("parent"))
    ).createOrReplaceTempView(f"parents_{own}")
    return graph.inherit(spark, f"nodes_{own}", f"parents_{own}")


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS paragraphs, CAST(len(regexp_extract_all(html, '<li>')) AS INT) AS items, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
 regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages""")
def html_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(tag: str):
        return F.size(F.regexp_extract_all("html", F.lit(tag), F.lit(0)))

    return table(spark, sf_dir, "pages").select(
        "page_id", count("<p>").alias("paragraphs"), count("<li>").alias("items"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"),
    )


@query("""SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 7 = 0 THEN 'quarantine' ELSE 'accepted' END AS route FROM events""")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anvaya.sources.files import split_valid

    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    good, bad = split_valid(rows, F.col("k") % 7 != 0, "k")
    return good.select("event_id", F.lit("accepted").alias("route")).unionByName(bad.select("event_id", F.lit("quarantine").alias("route")))


@query("""SELECT b.item_id, d.n FROM benchmark b JOIN (SELECT item_id, count(*) AS n FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) GROUP BY 1) d USING (item_id)""")
def sentence_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines bound to keys by position; each key gets its own line."""
    items = table(spark, sf_dir, "benchmark")
    w = Window.orderBy("item_id")  # a benchmark is small
    numbered = items.withColumn("line", F.row_number().over(w) - 1)
    keys = numbered.select("item_id", "line")
    lines = numbered.select("line", "text")
    return keys.join(lines, "line").select("item_id", F.size(F.split(F.lower("text"), " ")).cast("long").alias("n"))
