"""Fixtures of the smallest kind for text, spans, IRIs, temporal values, sources and streams."""

from __future__ import annotations

import json
import urllib.parse

import pytest
from pyspark.sql import functions as F

from anvaya.functions import iri, temporal, text
from anvaya.operators import entities, graph, models, spans, stats, tokens
from anvaya.sources import files
from anvaya.streaming import density


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokenizer(spark):
    df = spark.createDataFrame([(0, "राम ने सीता को देखा।\n\nनमस्ते: जी")], "doc_id long, text string")
    sents = tokens.sentences(df)
    assert [r["sent_id"] for r in sents.orderBy("sent_id").collect()] == [0, 2]
    rows = tokens.tokens(sents).where("sent_id = 0").orderBy("idx").collect()
    assert [r["tok"] for r in rows] == ["राम", "ने", "सीता", "को", "देखा", "।"]
    line = df.first()["text"].split("\n")[0]
    assert all(line[r["start"] : r["stop"]] == r["tok"] for r in rows)


def test_spans(spark):
    toks = F.array(*[F.lit(x) for x in ("a", "b", "c")])
    got = one(spark, text.resolve_span(toks, F.lit(0), F.lit(2)), text.resolve_span(toks, F.lit(2), F.lit(4)))
    assert tuple(got) == ("a b", None)
    lit = lambda *xs: [F.lit(x) for x in xs]
    assert tuple(one(spark, text.overlaps(*lit(0, 3, 3, 5)), text.overlaps(*lit(0, 4, 3, 5)))) == (False, True)
    assert tuple(one(spark, text.overlap_ratio(*lit(0, 10, 5, 7)), text.overlap_ratio(*lit(0, 10, 5, 7), by="longer"))) == (1.0, 0.2)
    assert one(spark, text.span_distance(*lit(0, 2, 5, 6)))[0] == 3
    items = F.array(F.struct(F.lit("agent").alias("name"), F.lit("b").alias("text"), F.lit(0).alias("start"), F.lit(1).alias("stop")))
    assert len(one(spark, text.validate_spans(toks, items))[0]) == 1


def test_text(spark):
    assert one(spark, text.normalize_sentence(F.lit(" a॥  b‍ "), compose=True))[0] == "a। b"
    assert one(spark, text.list_field(F.lit('["x", "y"]')))[0] == ["x", "y"]
    assert one(spark, text.distinct_spellings(text.list_field(F.lit("A|b; c|a"))))[0] == ["A", "b; c"]
    assert one(spark, text.numeric_surface(F.lit("१२"), {}))[0] == 12
    for word, want in (("राम", "raama"), ("ज़रा", "jaraa"), ("\u095bरा", "zaraa"), ("क्षेत्र", "kshetra"), ("Ab औ १", "au"), ("क\u200dि", "kai")):
        assert one(spark, text.transliterate(F.lit(word)))[0] == want, word
    assert one(spark, text.acronym_title(F.lit("http://x/UN_GA")))[0] and not one(spark, text.acronym_title(F.lit("http://x/Ab")))[0]
    assert one(spark, text.canonical_label(F.lit("B-PERSON"), {"PERSON": "PER"}))[0] == "PER"
    assert one(spark, F.lit("कल परसों आए").rlike(text.bounded("परसों")))[0]
    assert one(spark, text.feature_values(F.lit("Case=Nom|Number=Sing")))[0] == {"Case": "Nom", "Number": "Sing"}


def test_iris(spark):
    for value in ("a b/c~*", "é?&=+", "x"):
        assert one(spark, iri.encoded(F.lit(value)))[0] == urllib.parse.quote(value.replace(" ", "_"), safe="/")
    term = one(spark, iri.literal_term(F.lit(0.5), datatype=iri.XSD + "decimal"))[0]
    assert term == f'"0.500000"^^<{iri.XSD}decimal>'
    quad = iri.quad(F.lit("urn:s"), "urn:p", iri.literal_term(F.lit('say "hi"\n\\é'), lang="en"))
    back = spark.range(1).select(quad.alias("quad"))
    row = graph.parse(back).first()
    assert row["o"] == 'say "hi"\n\\é' and row["lang"] == "en" and row["kind"] == "literal"
    assert graph.malformed(spark.createDataFrame([("junk",)], "quad string")).count() == 1
    assert one(spark, iri.stable_id(F.lit(None).cast("string"), F.lit("d"), F.lit(1)))[0] == one(spark, F.substring(F.sha1(F.lit("d|1")), 1, 12))[0]
    assert one(spark, iri.curie(F.lit("x:y"), {"x": "urn:x#"}))[0] == "urn:x#y"


def test_temporal(spark):
    pairs = [("2024-01", "2024-01-05", "INCLUDES"), ("2023", "2024", "BEFORE"), ("a", "a", "SHARED_TIME_ANCHOR"),
             ("2024-W01", "2024-01-01", "INCLUDES"), ("T10:00", "T11:00", "BEFORE"), ("2024-01-05", "2024-01", "OVERLAPS"), ("x", "2024", None)]
    for a, b, want in pairs:
        assert one(spark, temporal.compare(F.lit(a), F.lit(b)))[0] == want, (a, b)
    base = F.lit("2024-01-31").cast("date")
    for words, want in (("कल", "2024-02-01"), ("अगले महीने", "2024-02"), ("पिछले सप्ताह", "2024-W04"), ("इस साल", "2024")):
        assert one(spark, temporal.relative_date(F.lit(words), base))[0] == want
    assert one(spark, temporal.time_value(F.lit("शाम 5 बजे")))[0] == "T17:00"
    assert one(spark, temporal.date_value(F.lit("31/2/2020"), base))[0]["status"] == "unresolved"


def test_dedupe_and_reconcile(spark):
    df = spark.createDataFrame([("k", 1.0, 0), ("k", 1.0, 1)], "key string, c double, pos int")
    assert entities.keep_best(df, ["key"], "c", "pos").first()["pos"] == 1
    a = spark.createDataFrame([("a", 2), ("b", 1)], "key string, n long")
    b = spark.createDataFrame([("a", 1), ("c", 1)], "key string, n long")
    got = {r["key"]: r["reason"] for r in stats.reconcile(a, b, "key").collect()}
    assert got == {"a": "count_differs", "b": "missing_right", "c": "missing_left"}
    d = stats.density(spark.createDataFrame([(1,), (2,), (3,), (10,)], "n int"), "n", 3).first()
    assert d["p95"] == 8.95 and d["cap_hits"] == 2
    left = spark.createDataFrame([("s", 0, 3), ("s", 8, 9)], "k string, start int, stop int")
    right = spark.createDataFrame([("s", 2, 4)], "k string, start int, stop int")
    assert spans.overlap_semi(left, right, ["k"]).first()["start"] == 0
    assert spans.overlap_anti(left, right, ["k"]).first()["start"] == 8


def test_sources(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("﻿one\n\n two\n", encoding="utf-8")
    assert [(r["sent_id"], r["text"]) for r in files.text_lines(spark, str(tmp_path / "lines.txt")).collect()] == [(0, "one"), (2, " two")]
    event = {"doc_id": "d", "sent_id": 1, "frame": "f.1", "confidence": 0.5}
    wrapped = {"doc_id": "d", "sent_id": 2, "events": [{"frame": "g.1"}]}
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps(x) for x in (event, wrapped)))
    rows = files.events(spark, str(tmp_path / "e.jsonl")).orderBy("sent_id").collect()
    assert [(r["doc_id"], r["sent_id"], r["frame"]) for r in rows] == [("d", 1, "f.1"), ("d", 2, "g.1")]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    assert files.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").where("a is not null").count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"sentences": {"d": {"0": {"items": [{"text": "x"}, {"text": "y"}]}}}}))
    assert [r["sent_key"] for r in files.stage_cache(spark, str(tmp_path / "c.json"), "text: string").collect()] == ["d::0", "d::0"]
    (tmp_path / "g.nt").write_text('# c\n<urn:a> <urn:p> "v"@en .\n<urn:a> <urn:p> <urn:b> .\n')
    assert sorted(r["o"] for r in files.ntriples(spark, str(tmp_path / "g.nt")).collect()) == ["urn:b", "v"]
    (tmp_path / "t.tsv").write_text("Name\tLabel\nx\t\n")
    table = files.coerced(files.delimited(spark, str(tmp_path / "t.tsv")), {"label": ["Label", "Name"], "uri": ["iri"]})
    assert tuple(table.first()) == ("x", None)
    (tmp_path / "v.xml").write_text('<R><VNCLASS ID="a-1"><MEMBERS><MEMBER name="m"/></MEMBERS><THEMROLES><THEMROLE type="Agent"/></THEMROLES>'
                                    '<SUBCLASSES><VNSUBCLASS ID="a-1-1"><MEMBERS><MEMBER name="n"/></MEMBERS></VNSUBCLASS></SUBCLASSES></VNCLASS></R>')
    got = {r["class_id"]: r for r in files.verb_classes(spark, str(tmp_path / "v.xml")).collect()}
    assert got["a-1"]["members"] == ["m"] and got["a-1-1"]["parent_id"] == "a-1"
    (tmp_path / "s.json").write_text(json.dumps({"properties": {"frame": {"const": "f.1"}, "arguments": {"properties": {"B": {"type": "object"}, "A": {"type": "object"}}}}}))
    assert files.frame_schemas(spark, str(tmp_path / "s.json")).first()["roles"] == ["A", "B"]
    files.write_nquads(spark.createDataFrame([("<urn:a> <urn:p> <urn:b> <urn:g> .",)], "quad string"), str(tmp_path / "out"))
    assert files.nquads(spark, str(tmp_path / "out")).first()["g"] == "urn:g"
    assert "| a |" in files.markdown(spark.createDataFrame([(1,)], "a int"), "T")
    assert files.stage_metadata(spark, "s", "1", {"n": 1}, [], {"k": 2}).count() == 1


def test_models(spark):
    rows = spark.createDataFrame([("s", "b.1", 2), ("s", "a.1", 1)], "sent_key string, frame_id string, rank int")
    assert models.select_frame(rows).first()["frame_id"] == "a.1"
    assert models.select_frame(rows, lambda: lambda ps: ["b.1"] * len(ps)).first()["frame_id"] == "b.1"
    roles = spark.createDataFrame([("f", "B"), ("f", "A")], "frame_id string, role string")
    assert json.loads(models.frame_schema(roles).first()["schema"])["properties"]["frame"]["const"] == "f"


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)

    def drained(df, name, mode="complete"):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name)

    daily = drained(density.windowed_density(stream), "daily")
    want = events.groupBy(F.to_date("ts"), "event_type").count()
    assert daily.count() == want.count() and daily.agg(F.sum("n")).first()[0] == events.count()
    forms = stream.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("form"))
    clusters = drained(density.running_clusters(forms), "clusters", "append")
    assert clusters.select("doc_id", "form", "cluster").distinct().count() == events.select("user_id", "event_type").distinct().count()


def test_text_lines_in_splits(spark, tmp_path):
    lines = ["\ufefffirst", "", "third\r", "  "] + [f"line {k} " + "x" * (k % 50) for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines), encoding="utf-8", newline="")
    (tmp_path / "b.txt").write_text("last one", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = files.text_lines(spark, str(tmp_path))
        got = {r["sent_id"]: r["text"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {n: x.removeprefix("\ufeff").removesuffix("\r") for n, x in enumerate([*lines, "last one"]) if x.strip()}
    assert got == want


def test_links_labels_and_dates(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<urn:a> <http://www.w3.org/2002/07/owl#sameAs> <urn:b> .\n<urn:a> <http://www.w3.org/2002/07/owl#sameAs> <urn:b> .\n'
                                   '<urn:a> <http://www.w3.org/2002/07/owl#sameAs> <urn:a> .\n<urn:a> <http://www.w3.org/2000/01/rdf-schema#label> "A name"@en .\n')
    triples = files.ntriples(spark, str(tmp_path / "x.nt"))
    assert [tuple(r) for r in files.sameas_links(triples).collect()] == [("urn:a", "urn:b")]
    assert [tuple(r) for r in files.labels(triples).collect()] == [("urn:a", "A name")]
    (tmp_path / "d.json").write_text('{"1": "2024-02-03", "2": "soon"}')
    (tmp_path / "d.csv").write_text("doc_id,doc_date\n1,2024-02-03\n2,soon\n")
    for name in ("d.json", "d.csv"):
        dates = files.doc_dates(spark, str(tmp_path / name))
        rows = files.with_doc_dates(spark.createDataFrame([(1,), (2,)], "doc_id int"), dates).orderBy("doc_id").collect()
        assert [str(r["doc_date"]) for r in rows] == ["2024-02-03", "None"]
    with pytest.raises(ValueError):
        files.markdown(spark.range(5), "t", limit=4)


def test_clock_times(spark):
    for written, want in (("सुबह 9 बजे", "T09:00"), ("शाम 5:30 बजे", "T17:30"), ("दोपहर 2 बजे", "T14:00"), ("दोपहर 12 बजे", "T12:00"), ("रात 12 बजे", "T12:00"),
                          ("7 बजे", "T07:00"), ("at 18:45", "T18:45"), ("रात", "TNI"), ("118:45", None), ("x", None)):
        assert one(spark, temporal.time_value(F.lit(written)))[0] == want, written
