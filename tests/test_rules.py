from __future__ import annotations

from pyspark.sql import functions as F

from anvaya.functions import rules
from anvaya.operators import spans


def test_rules(spark):
    L = F.lit
    none = L(None).cast("string")
    row = spark.range(1).select(F.array(
        rules.subevent(L(" Result ")), rules.subevent(L("x")), rules.subevent_of([none, L("?")], L("a PROC b")), rules.subevent_of([none], none),
        rules.postposition_warning(L("Source"), L("घर"), ["source"], [], []), rules.postposition_warning(L("source"), L("घर से"), ["source"], [], []),
        rules.postposition_warning(L("goal"), L("घर"), [], ["goal"], []), rules.postposition_warning(none, none, ["a"], [], ["b"]),
        rules.role_hint(L(" Agent")), rules.role_hint(L("venue")), rules.role_hint(none), rules.role_hint(L("agent"), {"Agent": "org"}),
        rules.event_key(L("d"), L(None), L("e")), rules.frame_family(none),
    ).alias("t"), F.array(
        rules.pos_allowed(L("pron"), "argument"), rules.pos_allowed(L("PRON"), "trigger"), rules.pos_allowed(none, "argument"), rules.pos_allowed(L("VERB"), "x", []),
        rules.function_only(L(" Of the"), ["of", "the"]), rules.function_only(L("of x"), ["of"]), rules.function_only(none, []),
        rules.valid_token(L("a"), L(1), L(1)), rules.valid_token(L(" "), L(1), L(2)), rules.valid_token(L("a"), L(2), L(1)), rules.valid_token(L("a"), L(None), L(1)),
    ).alias("b"), F.array(rules.sentence_distance(L("3"), L(7)), rules.sentence_distance(L("x"), L(7))).alias("n"), F.array(
        rules.span_of(F.array(L(1), L(2)), F.array(L(0), L(0))), rules.span_of(F.array(L(2), L(1)), F.array(L(0), L(0))),
        rules.span_of(F.array(L(1), L(2)), F.array(L(0), L(0)), "token"), rules.span_of(L(None).cast("array<int>"), F.array(L(-1), L(0))),
    ).alias("s")).first()
    assert row["t"] == ["res", None, "proc", None, "source_without_se_marker", None, "destination_without_locative_marker", None,
                        "PER", "LOC", "MISC", "ORG", "d||||e", ""]
    assert row["b"] == [False, True, True, False, True, False, True, True, False, False, False]
    assert row["n"] == [4, 9999] and row["s"] == [[1, 2], [0, 0], [0, 0], None]
    assert rules.pos_list("") is None and rules.pos_list(" , ") == [] and rules.pos_list("noun, Verb") == ["NOUN", "VERB"]


def test_document_times(spark):
    rows = spark.createDataFrame([("1::0", "2024-01-02"), ("1::0", "2024-01-02"), ("2::0", None)], "sent_key string, doc_date string")
    assert [(r["timex_id"], r["value"], r["start"]) for r in spans.document_times(rows, "sent_key", "doc_date").collect()] == [("1::0::docdate", "2024-01-02", None)]
