"""Layers of the graph beside events: mentions, times, canonical entities, external links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anvaya.functions.iri import BASE, RDF_TYPE, RDFS_LABEL, XSD, iri_term, literal_term, minted, quad
from anvaya.functions.text import stripped


def _filled(value: Column | str) -> Column:
    """The text without white space at its ends, null where nothing is left."""
    return F.nullif(stripped(F.col(value) if isinstance(value, str) else value), F.lit(""))


def _typed(subject: Column, *kinds: str) -> list[Column]:
    return [quad(subject, RDF_TYPE, iri_term(F.lit(f"{BASE}class/{kind}"))) for kind in kinds]


def _text(subject: Column, predicate: str, value: Column | str, lang: str = "en") -> Column:
    value = _filled(value)
    return F.when(value.isNotNull(), quad(subject, predicate, literal_term(value, lang=lang)))


def _number(subject: Column, predicate: str, value: Column | str, kind: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), quad(subject, predicate, literal_term(value, datatype=XSD + kind)))


def _lines(rows: DataFrame, items: list[Column]) -> DataFrame:
    return rows.select(F.explode(F.array_compact(F.array(*items))).alias("quad")).distinct()


def mention_quads(mentions: DataFrame, broader: dict[str, str], lang: str = "hi") -> DataFrame:
    """Entity mentions (sent_key, start, stop, label, text, engine, raw_label, confidence) as quads.

    Those without text or length are left out; a missing label is MISC, a missing engine unknown.
    """
    label = F.upper(F.coalesce(_filled("label"), F.lit("MISC")))
    node, sentence = minted("mention", "sent_key", "start", "stop", "kind"), iri_term(minted("sentence", "sent_key"))
    wide = F.when(F.lit(False), "")
    for name, kind in broader.items():
        wide = wide.when(F.col("kind") == name, kind)
    good = mentions.withColumn("kind", label).where((F.col("stop") > F.col("start")) & _filled("text").isNotNull())
    return _lines(good, [
        *_typed(node, "mention", "phrase"), _text(node, BASE + "anchorOf", "text", lang),
        _number(node, BASE + "start", "start", "integer"), _number(node, BASE + "stop", "stop", "integer"),
        quad(node, BASE + "inSentence", sentence), quad(node, BASE + "derivedFrom", sentence),
        _text(node, BASE + "entityType", "kind"), _text(node, BASE + "detectedBy", F.coalesce(_filled("engine"), F.lit("unknown"))),
        _text(node, BASE + "rawLabel", "raw_label"), _number(node, BASE + "confidence", "confidence", "decimal"),
        F.when(wide.isNotNull(), quad(node, RDF_TYPE, iri_term(F.concat(F.lit(BASE + "class/"), wide)))),
    ])


def timex_quads(timexes: DataFrame, lang: str = "hi") -> DataFrame:
    """Time expressions (sent_key, timex_id, text, kind, value, status) as quads."""
    node, sentence = minted("timex", "sent_key", "timex_id"), iri_term(minted("sentence", "sent_key"))
    return _lines(timexes, [
        *_typed(node, "timex", "phrase"), _text(node, BASE + "anchorOf", "text", lang),
        quad(node, BASE + "inSentence", sentence), quad(node, BASE + "derivedFrom", sentence),
        _text(node, BASE + "timexType", F.upper(F.coalesce(_filled("kind"), F.lit("DATE")))),
        _text(node, BASE + "resolutionStatus", F.coalesce(_filled("status"), F.lit("unresolved"))),
        _text(node, BASE + "timexValue", "value"),
    ])


def time_links(links: DataFrame, events: DataFrame) -> DataFrame:
    """Edges from events to times (event_id, sent_key, timex_id) of the events that are in the graph."""
    known = links.join(events.select("event_id").distinct(), "event_id", "left_semi")
    return _lines(known, [
        quad(minted("event", "event_id"), BASE + "hasTime", iri_term(minted("timex", "sent_key", "timex_id")))
    ])


def cluster_quads(clusters: DataFrame, members: DataFrame, known: DataFrame, lang: str = "hi") -> DataFrame:
    """Canonical entities (cluster_id, label, kind, confidence) with their mentions (cluster_id, mention, role).

    Mentions are counted all, and linked where the graph knows them (``known``: mention).
    """
    counted = clusters.join(members.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id", "left")
    node = minted("entity", "cluster_id")
    own = _lines(counted, [
        *_typed(node, "entity"), _text(node, RDFS_LABEL, "label", lang),
        _text(node, BASE + "normalized", F.lower("label"), lang),
        _text(node, BASE + "entityType", F.coalesce(_filled("kind"), F.lit("MISC"))),
        _number(node, BASE + "mentionCount", F.coalesce("n", F.lit(0)), "integer"),
        _number(node, BASE + "confidence", F.coalesce("confidence", F.lit(0.0)), "decimal"),
    ])
    mention = minted("mention", "mention")
    linked = members.join(known.select("mention").distinct(), "mention", "left_semi")
    return own.unionByName(_lines(linked, [
        quad(mention, BASE + "refersTo", iri_term(node)), _text(mention, BASE + "clusterRole", "role"),
    ]))


def link_quads(links: DataFrame, least: float = 0.0) -> DataFrame:
    """External links (mention, resource, via, lang, engine, confidence) of at least a confidence as quads."""
    score = F.coalesce("confidence", F.lit(0.0))
    mention = minted("mention", "mention")
    good = links.where((score >= least) & F.col("mention").isNotNull() & F.col("resource").isNotNull())
    return _lines(good, [
        quad(mention, BASE + "sameAs", iri_term(minted("resource", "resource"))),
        _text(mention, BASE + "matchedVia", F.coalesce(_filled("via"), F.lit("unknown"))),
        _text(mention, BASE + "matchedLang", "lang"),
        _text(mention, BASE + "linkEngine", F.coalesce(_filled("engine"), F.lit("local"))),
        _number(mention, BASE + "linkConfidence", score, "decimal"),
    ])
