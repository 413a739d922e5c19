"""Clause profiles against a plain walk over the rows, and the second pass of the filter."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from anvaya.operators import clauses, lexicon

WORDS = clauses.ClauseWords(imperative=("o",), resultative=("ban",), ability=("sak",), passive=("ja",), possibility=("p",), static=("hai",), coordination=("aur",))
SCORED = ("sent_key string, centre int, category string, plausibility double, multiword boolean, source string, hard_reject boolean, rank int")
KINDS = ["verb", "adjective", "noun", "lexical", "light_verb", "copula", "auxiliary", "adp", "number"]


def by_word(word, raw):
    """Category of a word by its first letter in these tests."""
    out = F.when(word == "hai", "copula")
    for letter, kind in {"v": "verb", "a": "adjective", "n": "noun", "l": "light_verb", "x": "auxiliary", "s": "auxiliary", "j": "auxiliary"}.items():
        out = out.when(word.startswith(letter), kind)
    return out.otherwise("lexical")


def plain_groups(rows, copula):
    def priority(r):
        base = clauses.ROW_PRIORITY.get(r["category"], 0.3)
        if r["category"] == "light_verb":
            base = 0.9 if r["multiword"] else 0.55
        return round(base - 0.12 * (r["source"] == "single_prefix") + r["plausibility"], 4)

    good = [r | {"p": priority(r)} for r in rows if not r["hard_reject"] and r["plausibility"] >= 0.3 and r["centre"] > 0]
    groups = []
    for r in sorted(good, key=lambda r: (r["centre"], -r["p"], r["rank"])):
        last = groups[-1] if groups else None
        if last:
            gap, kinds = abs(r["centre"] - last[-1]["centre"]), {x["category"] for x in last} | {r["category"]}
            helper = bool(kinds & set(clauses.HELPERS))
            if gap == 0 or (gap <= 1 and helper) or (copula and gap <= 2 and kinds <= set(clauses.COPULAR_MEMBERS)):
                last.append(r)
                continue
        groups.append([r])
    best = [max(g, key=lambda r: r["p"]) for g in groups]
    return [(b["centre"], b["category"], sorted({x["centre"] for x in g})) for b, g in zip(best, groups)]


def test_groups_brute(spark):
    rng = random.Random(4)
    rows, copulas = [], {}
    for n in range(120):
        copulas[str(n)] = rng.random() < 0.5
        for k in range(rng.randint(1, 6)):
            rows.append({"sent_key": str(n), "centre": rng.randint(0, 7), "category": rng.choice(KINDS), "plausibility": rng.choice([0.1, 0.3, 0.5, 0.9]),
                         "multiword": rng.random() < 0.3, "source": rng.choice(["single", "single_prefix"]), "hard_reject": rng.random() < 0.15, "rank": k + 1})
    toks = spark.createDataFrame([(k, ["hai"] if v else ["mmm"]) for k, v in copulas.items()], "sent_key string, toks array<string>")
    flags = toks.select("sent_key", clauses.signals(F.col("toks"), by_word, WORDS).alias("signals"))
    scored = spark.createDataFrame([[r[c.split()[0]] for c in SCORED.split(", ")] for r in rows], SCORED)
    got = {r["sent_key"]: [(g["primary_center"], g["primary_category"], list(g["indices"])) for g in r["groups"]] for r in clauses.clause_profile(scored, flags, WORDS).collect()}
    for key in copulas:
        assert got[key] == plain_groups([r for r in rows if r["sent_key"] == key], copulas[key]), key


def test_clause_types(spark):
    def row(key, centre, category, multiword=False, score=0.6):
        return (key, centre, category, score, multiword, "single", False, 1)

    texts = {
        "order": "x vao", "state": "n abc hai", "identity": "m nab hai", "become": "m abc bana", "ability": "m vab sakx", "passive": "m vab jax",
        "compound": "m nab lab", "plain": "m vab", "two": "vab m m m vac", "none": "m", "nothing": "",
    }
    scored = [
        row("order", 1, "verb"), row("state", 1, "adjective"), row("identity", 1, "noun"), row("become", 1, "adjective"), row("ability", 1, "verb"),
        row("passive", 1, "verb"), row("compound", 1, "noun", True), row("plain", 1, "verb"), row("two", 1, "verb"), row("two", 4, "verb"), row("none", 1, "verb", False, 0.1),
        row("missing", 1, "verb"),
    ]
    toks = spark.createDataFrame([(k, v.split()) for k, v in texts.items()], "sent_key string, toks array<string>")
    flags = toks.select("sent_key", clauses.signals(F.col("toks"), by_word, WORDS).alias("signals"))
    got = {r["sent_key"]: (r["clause_type"], r["clause_limit"], r["hint"]) for r in clauses.clause_profile(spark.createDataFrame(scored, SCORED), flags, WORDS).collect()}
    assert got == {
        "order": ("imperative_predicate", 1, "directive"), "state": ("predicative_adjectival_state", 1, None), "identity": ("static_copular_identity", 1, None),
        "become": ("change_of_state_resultative", 1, "change_of_state"), "ability": ("modal_lexical_event", 1, "ability"),
        "passive": ("modal_lexical_event", 1, "passive_modal"), "compound": ("light_verb_compound_event", 1, "light_verb_compound"),
        "plain": ("single_predicate_clause", 2, None), "two": ("multi_predicate_clause", 2, None), "none": ("single_predicate_clause", 2, None),
        "missing": ("single_predicate_clause", 2, None),
    }


def test_second_pass_recovers(spark):
    """A verb far below the best frame is kept in an order and dropped in a plain sentence."""
    texts = {"order": "mm vao", "plain": "mm vab"}
    arrays = spark.createDataFrame([(k, v.split()) for k, v in texts.items()], "sent_key string, toks array<string>")
    index = lexicon.trigger_index(spark, {"do.01": ["vao", "vab"]})
    ranked = lexicon.candidates(lexicon.evidence(arrays, index))
    first = {r["sent_key"]: r["plausibility"] for r in lexicon.plausibility(ranked, by_word).collect()}
    kinds = ranked.withColumn("clause", F.when(F.col("sent_key") == "order", "imperative_predicate").otherwise("single_predicate_clause"))
    again = {r["sent_key"]: r["plausibility"] for r in lexicon.plausibility(kinds, by_word, F.col("clause")).collect()}
    assert round(again["order"] - first["order"], 4) == 0.06 and again["plain"] == first["plain"]
    got = {r["sent_key"]: (r["decision"], r["final"], r["clause_type"]) for r in clauses.precision_filter(ranked, arrays, by_word, WORDS).collect()}
    # Both stand at the root of their clause (0.08); the order has 0.06 and 0.04 more.
    assert got["order"][0] == got["plain"][0] == "accepted" and round(got["order"][1] - got["plain"][1], 4) == 0.1
    assert (got["order"][2], got["plain"][2]) == ("imperative_predicate", "single_predicate_clause")


def test_limit_column(spark):
    rows = [("s", f"f{k}", f"f{k}", 9 * k, 9 * k + 1, 9 * k, f"w{k}", 0.9 - k / 10, k, "kept", 1) for k in range(3)]
    schema = "sent_key string, frame_id string, family string, start int, stop int, centre int, centre_word string, final double, rank int, decision string, most int"
    got = [r["decision"] for r in lexicon.select_candidates(spark.createDataFrame(rows, schema), limit="most").orderBy("frame_id").collect()]
    assert got == ["accepted", "sentence_limit", "sentence_limit"]
