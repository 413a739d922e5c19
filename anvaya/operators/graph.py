"""Graph tables: materialisation, parsing, census, checks, shapes, star joins, recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anvaya.functions.iri import BASE, RDF_TYPE, RDFS_LABEL, XSD, iri_term, literal_term, minted, quad, quad_fields


def entity_quads(rows: DataFrame, kind: str, key: str, label: str, links: dict[str, tuple[str, str]] | None = None, numbers: dict[str, str] | None = None) -> DataFrame:
    """Type, label, links and decimals of one row of a table, as N-Quads lines."""
    subject = minted(kind, key)
    items = [
        quad(subject, RDF_TYPE, iri_term(F.lit(f"{BASE}class/{kind}"))),
        F.when(F.col(label).isNotNull(), quad(subject, RDFS_LABEL, literal_term(label, lang="en"))),
    ]
    for predicate, (column, other) in (links or {}).items():
        items.append(F.when(F.col(column).isNotNull(), quad(subject, BASE + predicate, iri_term(minted(other, column)))))
    for predicate, column in (numbers or {}).items():
        items.append(F.when(F.col(column).isNotNull(), quad(subject, BASE + predicate, literal_term(column, datatype=XSD + "decimal"))))
    return rows.select(F.explode(F.array_compact(F.array(*items))).alias("quad"))


def event_quads(events: DataFrame) -> DataFrame:
    """Quads of events (doc_id, sent_id, frame_id, word, start, stop, confidence)."""
    event = minted("event", "doc_id", "sent_id", "frame_id")
    trigger = minted("trigger", "doc_id", "sent_id", "frame_id")
    sentence = minted("sentence", "doc_id", "sent_id")
    return events.select(F.explode(F.array(
        quad(event, RDF_TYPE, iri_term(F.lit(BASE + "class/event"))),
        quad(event, RDFS_LABEL, literal_term("frame_id")),
        quad(event, BASE + "inSentence", iri_term(sentence)),
        quad(event, BASE + "trigger", iri_term(trigger)),
        quad(event, BASE + "confidence", literal_term("confidence", datatype=XSD + "decimal")),
        quad(trigger, BASE + "anchorOf", literal_term("word")),
        quad(trigger, BASE + "start", literal_term("start", datatype=XSD + "integer")),
        quad(trigger, BASE + "stop", literal_term("stop", datatype=XSD + "integer")),
    )).alias("quad")).distinct()


def parse(lines: DataFrame, column: str = "quad") -> DataFrame:
    """(s, p, o, kind, lang, datatype, g) of the lines that are N-Quads; others are left out."""
    return lines.select(quad_fields(column).alias("q")).where("q is not null").select("q.*")


def malformed(lines: DataFrame, column: str = "quad") -> DataFrame:
    return lines.where(quad_fields(column).isNull())


def census(quads: DataFrame) -> DataFrame:
    """Nodes of each class and the number of triples."""
    typed = quads.where(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("node_class")).agg(
        F.count_distinct("s").alias("n")
    )
    return typed.unionByName(quads.agg(F.count("*").alias("n")).select(F.lit("triples").alias("node_class"), "n"))


def checks(quads: DataFrame, required: dict[str, list[str]], ranges: list[tuple[str, str]], references: dict[str, str]) -> DataFrame:
    """Structural findings (severity, code, node, detail), free of any order.

    ``required`` names properties that nodes of a class must have, ``ranges`` pairs of
    properties that must not be inverted, ``references`` properties whose object must be a node of a class.
    """
    typed = quads.where(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("class"))
    out = None

    def add(df: DataFrame) -> None:
        nonlocal out
        out = df if out is None else out.unionByName(df)

    for cls, properties in required.items():
        nodes = typed.where(F.col("class") == cls).select("s").distinct()
        for p in properties:
            add(nodes.join(quads.where(F.col("p") == p).select("s"), "s", "left_anti").select(
                F.lit("error").alias("severity"), F.lit("missing_property").alias("code"), F.col("s").alias("node"), F.lit(p).alias("detail")
            ))
    for low, high in ranges:
        a = quads.where(F.col("p") == low).select("s", F.expr("try_cast(o AS double)").alias("a"))
        b = quads.where(F.col("p") == high).select("s", F.expr("try_cast(o AS double)").alias("b"))
        add(a.join(b, "s").where("a > b").select(
            F.lit("error").alias("severity"), F.lit("inverted_range").alias("code"), F.col("s").alias("node"), F.lit(low).alias("detail")
        ).distinct())
    for p, cls in references.items():
        known = typed.where(F.col("class") == cls).select(F.col("s").alias("o"))
        add(quads.where((F.col("p") == p) & (F.col("kind") == "uri")).join(known, "o", "left_anti").select(
            F.lit("warning").alias("severity"), F.lit("dangling_reference").alias("code"), F.col("s").alias("node"), F.col("o").alias("detail")
        ).distinct())
    return out


def shape_violations(quads: DataFrame, shapes: DataFrame) -> DataFrame:
    """Violations of (target, path, min_count, datatype, class) constraints: a table of shapes, one pass each kind."""
    typed = quads.where(F.col("p") == RDF_TYPE).select(F.col("s"), F.col("o").alias("target"))
    asked = typed.join(shapes, "target")
    values = quads.select(F.col("s"), F.col("p").alias("path"), "o", "kind", F.col("datatype").alias("found"))
    met = asked.join(values, ["s", "path"], "left")
    counted = met.groupBy("s", "target", "path", "min_count").agg(F.count("o").alias("n")).where("n < min_count").select(
        F.col("s").alias("node"), "path", F.lit("minCount").alias("constraint"), F.col("n").cast("string").alias("detail")
    )
    typed_wrong = met.where("datatype is not null and o is not null and (kind <> 'literal' or coalesce(found, '') <> datatype)").select(
        F.col("s").alias("node"), "path", F.lit("datatype").alias("constraint"), F.col("o").alias("detail")
    ).distinct()
    of_class = met.where("class is not null and o is not null").join(
        typed.select(F.col("s").alias("o"), F.col("target").alias("class")), ["o", "class"], "left_anti"
    ).select(F.col("s").alias("node"), "path", F.lit("class").alias("constraint"), F.col("o").alias("detail")).distinct()
    return counted.unionByName(typed_wrong).unionByName(of_class)


def star(quads: DataFrame, cls: str, paths: dict[str, str]) -> DataFrame:
    """One row a node of a class, with the first value of each property: one grouped pass, no joins."""
    wanted = quads.where(F.col("p").isin([RDF_TYPE, *paths.values()]))
    aggs = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in paths.items()]
    is_class = F.max(F.when((F.col("p") == RDF_TYPE) & (F.col("o") == cls), 1).otherwise(0)).alias("is_class")
    return wanted.groupBy("s").agg(is_class, *aggs).where("is_class = 1").drop("is_class")


def inherit(spark: SparkSession, nodes: str, edges: str, depth: int = 10) -> DataFrame:
    """Nearest ancestor with a value, for nodes (id, value) and edges (id, parent) given as views."""
    return spark.sql(f"""
        WITH RECURSIVE up(id, at, level) AS (
          SELECT id, id, 0 FROM {nodes}
          UNION ALL
          SELECT up.id, e.parent, level + 1 FROM up JOIN {edges} e ON e.id = up.at WHERE level < {depth}
        )
        SELECT up.id, min_by(n.value, up.level) AS value, min(up.level) AS level
        FROM up JOIN {nodes} n ON n.id = up.at WHERE n.value IS NOT NULL GROUP BY up.id
    """)


def _written(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage: written to the checkpoint folder or, in a session without one, kept by the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def distances(spark: SparkSession, seeds: str, edges: str) -> DataFrame:
    """Fewest steps from seeds (grp, node) over undirected edges (grp, a, b), for all nodes that are reached.

    Each round goes on from the nodes that the last one reached first. Links have no
    direction, so what is known among their neighbours lies in the last two rounds.
    """
    one = spark.table(edges).select("grp", "a", "b")
    both = _written(one.unionByName(one.select("grp", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    level = _written(spark.table(seeds).select("grp", "node").distinct().withColumn("steps", F.lit(0)))
    before, levels, steps = level.limit(0), [level], 0
    while True:
        steps += 1
        known = level.select("grp", "node").unionByName(before.select("grp", "node"))
        found = _written(
            level.select("grp", F.col("node").alias("a")).join(both, ["grp", "a"]).select("grp", F.col("b").alias("node")).distinct()
            .join(known, ["grp", "node"], "left_anti").withColumn("steps", F.lit(steps))
        )
        if found.isEmpty():
            break
        before, level = level, found
        levels.append(found)
        if len(levels) == 16:  # keeps the plan short
            levels = [_written(_all(levels))]
    return _all(levels)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_links(links: DataFrame, nodes: DataFrame, on: str) -> DataFrame:
    """Links whose target is not in the graph."""
    return links.join(nodes.select(on).distinct(), on, "left_anti")


def condition_all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
