"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import re

import duckdb
import pytest

from anvaya.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(df):
    cols = sorted(df.columns)

    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return cols, df[cols].map(cell).sort_values(cols).values.tolist()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
    else:
        assert plain(got) == plain(duck.execute(sql).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_order_dependent_queries_repeat(spark):
    for name in ("selection_decisions", "entity_cluster", "match_events_greedy"):
        query = catalogue.queries()[name]
        first = sorted(map(str, query(spark, SMALL).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = sorted(map(str, query(spark, SMALL).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert first == again


def test_dependency_distance_reaches_all(spark, tmp_path):
    turns = [(1, k) for k in range(300)] + [(2, 0), (3, 5)]
    spark.createDataFrame(turns, "conv_id long, turn int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["grp"], r["node"]): r["steps"] for r in catalogue.queries()["dependency_distance"](spark, str(tmp_path)).collect()}
    links = {}
    for grp, turn in turns:
        for other in ([turn - 1] if turn > 0 else []) + ([turn // 2] if turn > 1 else []):
            links.setdefault((grp, turn), set()).add((grp, other))
            links.setdefault((grp, other), set()).add((grp, turn))
    want = {(1, 0): 0, (2, 0): 0, (3, 5): 0}
    front = list(want)
    for at in front:
        for node in links.get(at, ()):
            if node not in want:
                want[node] = want[at] + 1
                front.append(node)
    assert got == want and max(want.values()) > 6


def test_distances_of_a_long_path(spark):
    from anvaya.operators import graph

    spark.createDataFrame([(1, 0)], "grp int, node int").createOrReplaceTempView("path_seeds")
    spark.createDataFrame([(1, k, k + 1) for k in range(20)], "grp int, a int, b int").createOrReplaceTempView("path_edges")
    got = sorted((r["node"], r["steps"]) for r in graph.distances(spark, "path_seeds", "path_edges").collect())
    assert got == [(k, k) for k in range(21)]


def test_long_triggers_match(spark):
    from anvaya.operators import lexicon

    term = "a b c d e f g"
    index = lexicon.trigger_index(spark, {"long": [term], "short": ["a b"]})
    texts = {"whole": "x " + term, "split": "a x b c x x d e f g", "far": "a b c d e f x x x g"}
    arrays = spark.createDataFrame([(k, v.split()) for k, v in texts.items()] + [("none", [])], "sent_key string, toks array<string>")
    found = lambda source, keys: sorted((r["sent_key"], r["start"], r["stop"]) for r in lexicon.evidence(arrays, keys).where(f"frame_id = 'long' and source = '{source}'").collect())
    assert found("n_gram", index) == [("whole", 1, 8)]
    assert found("split", index) == [("split", 0, 10), ("whole", 1, 8)]
    assert found("n_gram", index.where("false")) == []


def test_tokens_of_long_lines(spark):
    from anvaya.functions.text import PIECE
    from anvaya.operators import tokens

    texts = ["", "  a, b  ", "x" * 10, "".join(f" w{k}," for k in range(500)), "(a)|b॥ c।", "\ta\u00a0b  ?!"]
    sents = spark.createDataFrame([(n, 0, str(n), t) for n, t in enumerate(texts)], "doc_id int, sent_id int, sent_key string, text string")
    got = sorted((r["sent_key"], r["idx"], r["tok"], r["start"], r["stop"]) for r in tokens.tokens(sents).collect())
    want = []
    for n, t in enumerate(texts):
        for k, m in enumerate(re.finditer(PIECE, t, re.ASCII)):
            tok = m[0].lstrip(" \t")
            want.append((str(n), k, tok, m.end() - len(tok), m.end()))
    assert got == sorted(want)


def test_selection_limits(spark):
    from anvaya.operators import lexicon

    # Four centres far apart, the first with three unlike candidates.
    rows = [("s", f"f{k}.1", f"f{k}", 10 * c, 10 * c + 1, c * 9, f"w{k}", 1.0 - k / 100, k, "kept") for k, c in enumerate((0, 5, 9, 12))]
    rows += [("s", "f0.2", "f0", 0, 1, 0, "w0", 0.99, 9, "kept"), ("s", "low", "x", 40, 41, 40, "x", 0.1, 10, "below_threshold"), ("t", "one", "x", 0, 1, 0, "x", 0.9, 1, "kept")]
    df = spark.createDataFrame(rows, "sent_key string, frame_id string, family string, start int, stop int, centre int, centre_word string, final double, rank int, decision string")
    got = {(r["sent_key"], r["frame_id"]): (r["cluster"], r["decision"]) for r in lexicon.select_candidates(df).collect()}
    assert got == {
        ("s", "f0.1"): (0, "accepted"), ("s", "f0.2"): (0, "duplicate_of_leader"), ("s", "f1.1"): (1, "accepted"), ("s", "f2.1"): (2, "accepted"),
        ("s", "f3.1"): (3, "sentence_limit"), ("s", "low"): (-1, "below_threshold"), ("t", "one"): (0, "accepted"),
    }
    same = [("s", f"g{k}", f"g{k}", 20 * k, 20 * k + 1, 7, f"v{k}", 0.9 - k / 100, k, "kept") for k in range(3)]
    got = [r["decision"] for r in lexicon.select_candidates(spark.createDataFrame(same, df.schema), per_centre=1).orderBy("frame_id").collect()]
    assert got == ["accepted", "centre_limit", "centre_limit"]


def test_transliteration_similarity_brute(spark):
    from difflib import SequenceMatcher

    ascii_ = {r["s_suppkey"]: r["ascii"] for r in catalogue.queries()["transliteration"](spark, SMALL).collect()}
    names = {r["s_suppkey"]: r["s_name"] for r in spark.read.parquet(f"{SMALL}/supplier.parquet").collect()}
    for r in catalogue.queries()["transliteration_similarity"](spark, SMALL).collect():
        title = re.sub("[^a-z]", "", names[r["s_suppkey"]].lower())
        forms = [ascii_[r["s_suppkey"]], ascii_[r["s_suppkey"]] + "kaa"]
        assert r["similarity"] == round(max(SequenceMatcher(None, f, title).ratio() for f in forms), 4)
