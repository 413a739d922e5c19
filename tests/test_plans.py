"""What the plans of queries leave out: work that is done twice and rows that need not move."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from anvaya.operators import clauses, enrich, lexicon, tokens
from anvaya.plans import catalogue, registry

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_guess(spark):
    """The engine broadcasts nothing on its own, as with tables whose size it cannot tell."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_stay_where_they_are(spark, no_guess, monkeypatch):
    texts = {"s": "x and the of y", "t": "and a the b of", "u": "the and", "none": ""}
    arrays = spark.createDataFrame([(k, v.split()) for k, v in texts.items()], "sent_key string, toks array<string>")
    index = lexicon.trigger_index(spark, {"one": ["and", "and the of"], "two": ["the of"]})
    found = lexicon.evidence(arrays, index, ["a"])
    rows = sorted(map(str, found.collect()))
    assert "BroadcastHashJoin [word" in plan(found) and len(rows) > 4
    monkeypatch.setattr(lexicon, "SMALL", 0)
    assert sorted(map(str, lexicon.evidence(arrays, index, ["a"]).collect())) == rows


def test_words_are_split_once(spark):
    from anvaya.plans import common

    df = common.word_arrays(spark, SMALL).select("sent_key", F.posexplode("toks"))
    assert plan(df).count("array_remove(") == 1


def test_words_are_tagged_once(spark):
    asked = []

    def category(word, raw):
        asked.append(1)
        return F.when(word.contains("CATEGORY_MARK"), "verb").otherwise("noun")

    df = spark.createDataFrame([("s", ["a"])], "sent_key string, toks array<string>")
    text = plan(df.select(clauses.signals(F.col("toks"), category, clauses.ClauseWords(coordination=("a",))).alias("x")))
    assert text.count("CATEGORY_MARK") == 1


def test_pieces_need_no_look_around(spark):
    import re

    from anvaya.functions.text import PIECE

    texts = ["a, b (c) d.", " x", "", "  ", "a\x01b, c\x01 ", "a  b\t,c ", "$0 \\ $1", "(", " ।॥ y", "a ,, b "]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string").select("n", tokens.pieces().alias("p"))
    want = {n: re.findall(PIECE, t, re.ASCII) for n, t in enumerate(texts)}
    assert {r["n"]: r["p"] for r in df.collect()} == want
    # Plain text takes the path of replacements.
    assert "replace(regexp_replace(" in plan(df)


def test_token_heads_need_no_sort(spark):
    toks = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "sent_key string, idx int, tok string")
    quads = enrich.token_quads(toks)
    assert quads.count() == 5 and "Window" not in plan(quads)


def test_span_validation_moves_no_words(spark):
    assert "collect_list" not in plan(catalogue.queries()["span_validation"](spark, SMALL))


def test_rates_round_like_their_sql(spark):
    import duckdb

    from anvaya.functions import text

    pairs = [(n, d) for d in (0, -3, 160, 2000, 4000) for n in (0, 1, 9, 11, 57)] + [(None, 5)]
    got = spark.createDataFrame(pairs, "n long, d long").select(text.rate_text("n", "d").alias("r")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE p AS SELECT unnest(?) AS n, unnest(?) AS d", [[n for n, _ in pairs], [d for _, d in pairs]])
    want = con.execute("SELECT CASE WHEN d > 0 THEN printf('%.2f%%', round(100.0 * n / d, 2)) ELSE 'n/a' END FROM p").fetchall()
    assert [r["r"] for r in got] == [w[0] for w in want]


def test_lower_case_is_bound_once(spark):
    from anvaya.plans import common

    df = spark.createDataFrame([("s", ["a"])], "sent_key string, toks array<string>")
    assert plan(df.select(clauses.signals(F.col("toks"), common.category, clauses.ClauseWords()).alias("x"))).count("lower(") == 1


def test_what_cannot_be_evidence_goes_with_the_join(spark):
    arrays = spark.createDataFrame([("s", "and a b c of x".split())], "sent_key string, toks array<string>")
    index = lexicon.trigger_index(spark, {"one": ["and of"], "two": ["x"]})
    assert "lower(toks" in next(x for x in plan(lexicon.evidence(arrays, index)).splitlines() if "BroadcastHashJoin [word" in x)


#: Queries on evidence, by finding (F9-F17).
ON_EVIDENCE = [
    "decision_summary", "selection_decisions", "decision_log", "same_center_collapse", "trigger_prefix", "candidate_topk", "best_evidence", "trigger_single", "trigger_split",
]


@pytest.mark.parametrize("name", ON_EVIDENCE)
def test_evidence_queries_shuffle_no_words(spark, no_guess, monkeypatch, name):
    """Documents over a split a core are not dealt out first, so only what was found may move."""
    monkeypatch.setattr(registry, "SPLIT_BYTES", 0)
    lines = plan(catalogue.queries()[name](spark, SMALL)).splitlines()
    assert any("BroadcastHashJoin [word" in x for x in lines)
    # The one join that shuffles is that of the index with itself.
    assert all("LeftAnti" in x for x in lines if "SortMergeJoin" in x)
