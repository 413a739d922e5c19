"""Queries on interval joins, nearest matches, temporal values and relations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anvaya.functions import temporal
from anvaya.operators import entities, graph, spans
from anvaya.plans import common
from anvaya.plans.registry import query, table

_ARG, _NER = ["of", "and the", "que"], ["the", "of the", "la"]


def _hits(spark: SparkSession, sf_dir: str, phrases: list[str]) -> DataFrame:
    """Places of one- and two-word phrases among the words of sentences, as spans of words."""
    rows = common.word_arrays(spark, sf_dir).select("sent_key", F.posexplode(F.transform("toks", lambda t, k: F.struct(
        F.lower(t).alias("word"), F.concat_ws(" ", F.lower(t), F.lower(F.get("toks", k + 1))).alias("two")
    ))).alias("w", "at"))
    pairs = rows.select("sent_key", "w", "at.word", "at.two")
    ones = [p for p in phrases if " " not in p]
    twos = [p for p in phrases if " " in p]
    found = F.array_compact(F.array(
        F.when(F.col("word").isin(ones), F.struct((F.col("w") + 1).alias("stop"), F.col("word").alias("phrase"))),
        F.when(F.col("two").isin(twos), F.struct((F.col("w") + 2).alias("stop"), F.col("two").alias("phrase"))),
    ))
    return pairs.select("sent_key", F.col("w").alias("start"), F.explode(found).alias("hit")).select("sent_key", "start", "hit.*")


def _hits_sql(name: str, phrases: list[str]) -> str:
    ones = common.quoted(p for p in phrases if " " not in p)
    twos = common.quoted(p for p in phrases if " " in p) or "''"
    return f"""{name} AS (SELECT sent_key, w AS start, w + 1 AS stop, word AS phrase FROM pairs WHERE word IN ({ones})
 UNION ALL SELECT sent_key, w, w + 2, two FROM pairs WHERE two IN ({twos}))"""


_SPANS = f"""WITH {common.WORD}, pairs AS (SELECT *, concat_ws(' ', word, lead(word) OVER (PARTITION BY sent_key ORDER BY w)) AS two FROM word),
{_hits_sql('a', _ARG)}, {_hits_sql('b', _NER)}"""
_MEET = "a.sent_key = b.sent_key AND NOT (a.stop <= b.start OR b.stop <= a.start)"


@query(_SPANS + f""" SELECT sent_key, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, phrase, r_phrase FROM (SELECT a.*, b.phrase AS r_phrase,
 row_number() OVER (PARTITION BY a.sent_key, a.start, a.stop ORDER BY b.start, b.stop) AS rn FROM a JOIN b ON {_MEET}) WHERE rn = 1""")
def span_overlap_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = spans.overlap_first(_hits(spark, sf_dir, _ARG), _hits(spark, sf_dir, _NER), ["sent_key"], ["start", "stop"])
    return met.select("sent_key", "start", "stop", "phrase", "r_phrase")


@query(_SPANS + f""" SELECT * FROM (SELECT a.sent_key, CAST(a.start AS INT) AS start, CAST(a.stop AS INT) AS stop, CAST(b.start AS INT) AS r_start, CAST(b.stop AS INT) AS r_stop,
 round((least(a.stop, b.stop) - greatest(a.start, b.start)) / least(a.stop - a.start, b.stop - b.start)::DOUBLE, 4) AS ratio FROM a JOIN b ON {_MEET}) WHERE ratio >= 0.5""")
def span_overlap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = spans.overlap_all(_hits(spark, sf_dir, _ARG), _hits(spark, sf_dir, _NER), ["sent_key"], 0.5)
    return met.select("sent_key", "start", "stop", "r_start", "r_stop", "ratio")


@query(_SPANS + f""" SELECT sent_key, count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_MEET}) GROUP BY 1""")
def span_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.overlap_semi(_hits(spark, sf_dir, _ARG), _hits(spark, sf_dir, _NER), ["sent_key"]).groupBy("sent_key").agg(F.count("*").alias("n"))


@query(_SPANS + f""" SELECT sent_key, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_MEET}) GROUP BY 1""")
def span_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.overlap_anti(_hits(spark, sf_dir, _ARG), _hits(spark, sf_dir, _NER), ["sent_key"]).groupBy("sent_key").agg(F.count("*").alias("n"))


@query(f"""WITH {common.TOKEN}, s AS (SELECT sent_key, start - 2 AS start, stop + 1 AS stop FROM token WHERE tok IN ('of', 'que', 'und'))
SELECT sent_key, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, CAST(idx AS INT) AS idx, tok FROM (SELECT s.*, t.idx, t.tok, row_number() OVER (PARTITION BY s.sent_key, s.start, s.stop
 ORDER BY least(s.stop, t.stop) - greatest(s.start, t.start) DESC, t.idx) AS rn FROM s JOIN token t ON s.sent_key = t.sent_key AND NOT (s.stop <= t.start OR t.stop <= s.start)) WHERE rn = 1""")
def head_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = common.tokens(spark, sf_dir)
    asked = toks.where(F.col("tok").isin("of", "que", "und")).select("sent_key", (F.col("start") - 2).alias("start"), (F.col("stop") + 1).alias("stop"))
    return spans.head_token(asked, toks, ["sent_key"])


@query("""WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
r AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = (SELECT max(event_type) FROM events)),
c AS (SELECT l.user_id, l.event_id AS id, r.event_id AS linked, abs(l.at - r.at) AS gap, row_number() OVER (PARTITION BY l.user_id, l.event_id
  ORDER BY abs(l.at - r.at), CASE WHEN r.at <= l.at THEN 0 ELSE 1 END, CASE WHEN r.at <= l.at THEN -r.event_id ELSE r.event_id END) AS rn FROM l JOIN r USING (user_id))
SELECT l.user_id, l.event_id AS id, coalesce(c.linked, -1) AS linked, coalesce(c.gap, -1) AS gap,
 CASE WHEN c.gap = 0 THEN 'overlap' WHEN c.gap IS NOT NULL THEN 'proximity' ELSE 'docdate' END AS strategy,
 CASE WHEN c.gap = 0 THEN 0.88 WHEN c.gap IS NOT NULL THEN 0.65 ELSE 0.75 END::DOUBLE AS confidence
FROM l LEFT JOIN c ON l.user_id = c.user_id AND l.event_id = c.id AND c.rn = 1""")
def nearest_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    ends = events.agg(F.min("event_type").alias("low"), F.max("event_type").alias("high"))  # one row
    marked = events.crossJoin(F.broadcast(ends))
    return spans.nearest_cascade(
        marked.where("event_type = low"), marked.where("event_type = high"), ["user_id"], "at", "at", F.lit(-1).cast("long")
    )


@query("""SELECT * FROM (SELECT user_id, event_id, lag(event_id) OVER w AS previous, CASE WHEN lag(ts) OVER w IS NULL THEN NULL WHEN lag(ts) OVER w = ts THEN 'SHARED_TIME_ANCHOR' ELSE 'BEFORE' END AS relation
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE previous IS NOT NULL""")
def adjacent_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.lag("event_id").over(w).alias("previous"),
        F.when(F.lag("ts").over(w) == F.col("ts"), "SHARED_TIME_ANCHOR").otherwise("BEFORE").alias("relation"),
    )
    return rows.where("previous is not null")


_VALUE = "CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END"
_LOW = "CASE length(v) WHEN 4 THEN make_date(v::INT, 1, 1) WHEN 7 THEN CAST(v || '-01' AS DATE) ELSE CAST(v AS DATE) END"
_HIGH = "CASE length(v) WHEN 4 THEN make_date(v::INT, 12, 31) WHEN 7 THEN last_day(CAST(v || '-01' AS DATE)) ELSE CAST(v AS DATE) END"
_RELATION = """CASE WHEN a.v = b.v THEN 'SHARED_TIME_ANCHOR' WHEN a.high < b.low THEN 'BEFORE' WHEN a.low > b.high THEN 'AFTER'
 WHEN a.low = b.low AND a.high = b.high THEN 'SHARED_TIME_ANCHOR' WHEN a.low <= b.low AND a.high >= b.high THEN 'INCLUDES' ELSE 'OVERLAPS' END"""
_PAIRS = f"""WITH v AS (SELECT o_custkey, o_orderkey, {_VALUE} AS v FROM orders), i AS (SELECT *, {_LOW} AS low, {_HIGH} AS high FROM v),
p AS (SELECT a.o_custkey, a.o_orderkey AS src, b.o_orderkey AS dst, {_RELATION} AS relation FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 3
    value = F.when(key == 0, F.date_format("o_orderdate", "yyyy")).when(key == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", value.alias("v"))
    other = rows.select("o_custkey", F.col("o_orderkey").alias("dst"), F.col("v").alias("w"))
    return rows.join(other, "o_custkey").where("o_orderkey < dst").select(
        "o_custkey", F.col("o_orderkey").alias("src"), "dst", temporal.compare("v", "w").alias("relation")
    )


@query(_PAIRS + " SELECT * FROM p")
def pairwise_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(_PAIRS + """ SELECT o_custkey, relation, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, relation
 ORDER BY CASE relation WHEN 'SHARED_TIME_ANCHOR' THEN 0.68 ELSE 0.88 END DESC, src * 1000000 + dst DESC) AS rn FROM p) WHERE rn = 1""")
def relation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("confidence", F.when(F.col("relation") == "SHARED_TIME_ANCHOR", 0.68).otherwise(0.88)).withColumn(
        "position", F.col("src") * 1000000 + F.col("dst")
    )
    return entities.keep_best(rows, ["o_custkey", "relation"], "confidence", "position").select("o_custkey", "relation", "src", "dst")


_EXPRESSIONS = ["आज", "कल", "बीते कल", "परसों", "पिछले सप्ताह", "अगले महीने", "इस साल", "अगले दिन", "2023-5-7", "3/4/22", "5 मार्च", "12 जून 2020", "कभी"]
_DAY = "CAST(o_orderdate AS DATE)"


@query(f"""WITH e AS (SELECT o_orderkey, {_DAY} AS d, ({common.sql_list(_EXPRESSIONS)})[o_orderkey % {len(_EXPRESSIONS)} + 1] AS x FROM orders)
SELECT o_orderkey, CASE x WHEN 'आज' THEN strftime(d, '%Y-%m-%d') WHEN 'कल' THEN strftime(d + 1, '%Y-%m-%d') WHEN 'बीते कल' THEN strftime(d - 1, '%Y-%m-%d')
 WHEN 'परसों' THEN strftime(d + 2, '%Y-%m-%d') WHEN 'पिछले सप्ताह' THEN printf('%d-W%02d', isoyear(d - 7), week(d - 7)) WHEN 'अगले महीने' THEN strftime(d + INTERVAL 1 MONTH, '%Y-%m')
 WHEN 'इस साल' THEN strftime(d, '%Y') WHEN 'अगले दिन' THEN strftime(d + 1, '%Y-%m-%d') WHEN '2023-5-7' THEN '2023-5-7' WHEN '3/4/22' THEN '2022-04-03'
 WHEN '5 मार्च' THEN strftime(d, '%Y') || '-03-05' WHEN '12 जून 2020' THEN '2020-06-12' END AS value,
 CASE WHEN x = 'कभी' THEN 0.40 WHEN x = '2023-5-7' THEN 0.98 WHEN x = '3/4/22' THEN 0.96 WHEN x IN ('5 मार्च', '12 जून 2020') THEN 0.92 ELSE 0.85 END::DOUBLE AS confidence FROM e""")
def relative_date_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(x) for x in _EXPRESSIONS]), (F.col("o_orderkey") % len(_EXPRESSIONS) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", temporal.date_value(pick, F.col("o_orderdate")).alias("v"))
    return rows.select("o_orderkey", "v.value", "v.confidence")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'P' || q || 'D' WHEN 1 THEN 'P' || q || 'W' WHEN 2 THEN 'PT' || q || 'H' ELSE NULL END AS value
FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem)""")
def duration_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(x) for x in ("दिन", "हफ्ते", "घंटे", "xx")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", temporal.duration_value(F.col("l_quantity").cast("int"), unit).alias("value")
    )


@query(f"""WITH v AS (SELECT o_orderkey, {_VALUE} AS v FROM orders), i AS (SELECT *, {_LOW} AS low, {_HIGH} AS high FROM v)
SELECT a.o_orderkey, {_RELATION} AS relation FROM i a, (SELECT '1996-03' AS v, DATE '1996-03-01' AS low, DATE '1996-03-31' AS high) b""")
def interval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 3
    value = F.when(key == 0, F.date_format("o_orderdate", "yyyy")).when(key == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.compare(value, F.lit("1996-03")).alias("relation"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d{4}-\d{2}-\d{2}|\d+')) AS x FROM documents)
SELECT doc_id, count(*) AS n, count(*) FILTER (length(x) = 10 AND x LIKE '____-__-__') AS dates, md5(string_agg(x, ',' ORDER BY x)) AS found FROM m GROUP BY 1""")
def timex_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\d{4}-\d{2}-\d{2}|\d+"), F.lit(0))).alias("x"))
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("x").rlike(r"^.{4}-..-..$")).alias("dates"),
        F.md5(F.array_join(F.sort_array(F.collect_list("x")), ",")).alias("found"),
    )


@query("""WITH RECURSIVE node AS (SELECT conv_id AS grp, turn AS node FROM conversations), edge AS (SELECT conv_id AS grp, turn AS a, turn - 1 AS b FROM conversations WHERE turn > 0
  UNION ALL SELECT conv_id, turn, turn // 2 FROM conversations WHERE turn > 1), und AS (SELECT grp, a, b FROM edge UNION SELECT grp, b, a FROM edge),
walk(grp, node, steps) AS (SELECT grp, min(node), 0 FROM node GROUP BY grp UNION SELECT w.grp, u.b, w.steps + 1 FROM walk w JOIN und u ON u.grp = w.grp AND u.a = w.node WHERE w.steps < 6)
SELECT grp, node, CAST(min(steps) AS INT) AS steps FROM walk GROUP BY ALL""")
def dependency_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = uuid.uuid4().hex  # calls at the same time do not see each other's views
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("node"))
    turns.groupBy("grp").agg(F.min("node").alias("node")).createOrReplaceTempView(f"seeds_{own}")
    turns.where("node > 0").select("grp", F.col("node").alias("a"), (F.col("node") - 1).alias("b")).unionByName(
        turns.where("node > 1").select("grp", F.col("node").alias("a"), F.floor(F.col("node") / 2).alias("b"))
    ).createOrReplaceTempView(f"edges_{own}")
    return graph.distances(spark, f"seeds_{own}", f"edges_{own}")
