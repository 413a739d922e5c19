"""Sources and sinks: text lines, JSON lines, caches, N-Triples and N-Quads, tables, XML, HTML, schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from anvaya.functions.iri import RDFS_LABEL, quad_fields
from anvaya.functions.text import stripped

OWL_SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"
EVENT = (
    "doc_id string, sent_id int, frame string, trigger struct<text: string, span: array<int>, char_span: array<int>, category: string>,"
    " arguments map<string, struct<text: string, span: array<int>, char_span: array<int>>>, confidence double, event_id string"
)


def split_valid(rows: DataFrame, good: Column, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows that hold a condition, and the quarantine of those that do not or cannot tell."""
    flagged = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    return flagged.where("_good").drop("_good"), flagged.where("not _good").drop("_good")


def text_lines(spark: SparkSession, path: str, doc_id: str = "batch_run") -> DataFrame:
    """One sentence a line; numbers count blank lines and go on from file to file, by name.

    Files of any size are read in splits. A line's number is its place in its split, from
    ids that follow each other there, plus the lines of all splits before, of which there
    is one row each.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("text"),
    )
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "block", "first", "base")
    numbered = lines.join(F.broadcast(bases), ["file", "block"])  # a row a split, as the driver's own list of them
    sent_id = (F.col("base") + F.col("id") - F.col("first")).cast("int")
    bare = F.when(sent_id == 0, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))
    return numbered.select(F.lit(doc_id).alias("doc_id"), sent_id.alias("sent_id"), bare.alias("text")).where(stripped("text") != "")


def json_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False) -> DataFrame:
    """JSON rows; malformed ones fail the read if ``strict``, else go."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def events(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Event rows, plain or wrapped as (doc_id, sent_id, events); a wrapper fills in missing ids."""
    schema = f"{EVENT}, events array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in _fields(EVENT))}>>"
    rows = spark.read.schema(schema).option("multiLine", array).json(path)
    plain = rows.where("events is null").drop("events")
    inner = rows.where("events is not null").select("doc_id", "sent_id", F.explode("events").alias("e"))
    filled = inner.select(
        F.coalesce("e.doc_id", "doc_id").alias("doc_id"), F.coalesce("e.sent_id", "sent_id").alias("sent_id"),
        "e.frame", "e.trigger", "e.arguments", "e.confidence", "e.event_id",
    )
    return plain.unionByName(filled)


def _fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:k])
            at = k + 1
    return out


def stage_cache(spark: SparkSession, path: str, item: str) -> DataFrame:
    """A nested cache sentences[doc][sent].items as (sent_key, item) rows."""
    schema = f"sentences map<string, map<string, struct<items: array<struct<{item}>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    docs = rows.select(F.explode("sentences").alias("doc", "sents"))
    sents = docs.select("doc", F.explode("sents").alias("sent", "body"))
    return sents.select(F.concat_ws("::", "doc", "sent").alias("sent_key"), F.posexplode("body.items").alias("pos", "i")).select("sent_key", "pos", "i.*")


def nquads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(quad_fields("value").alias("q")).where("q is not null").select("q.*")


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or N-Quads lines; comments and other lines go."""
    term = r'(<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?|_:\S+)'
    pattern = rf"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+{term}(?:\s+<[^>]*>)?\s*\.\s*$"
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").rlike(pattern))
    part = lambda n: F.regexp_extract("value", pattern, n)
    return rows.select(F.regexp_replace(part(1), "^<|>$", "").alias("s"), part(2).alias("p"), part(3).alias("term")).select(
        "s", "p", F.regexp_replace("term", r'^[<"]|>$|"(@[A-Za-z-]+|\^\^<[^>]*>)?$', "").alias("o"), F.col("term").startswith('"').alias("is_literal")
    )


def sameas_links(triples: DataFrame, predicates: tuple[str, ...] = (OWL_SAME_AS,)) -> DataFrame:
    """(resource, other): each pair of IRIs once that a predicate says to be the same."""
    return triples.where(F.col("p").isin(list(predicates)) & ~F.col("is_literal")).select(
        F.col("s").alias("resource"), F.col("o").alias("other")
    ).where("resource <> other").distinct()


def labels(triples: DataFrame, predicates: tuple[str, ...] = (RDFS_LABEL,)) -> DataFrame:
    """(resource, label): the literals that name a resource."""
    return triples.where(F.col("p").isin(list(predicates)) & F.col("is_literal")).select(
        F.col("s").alias("resource"), stripped("o").alias("label")
    ).where("label <> ''").distinct()


def doc_dates(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc_date) of a JSON object of dates or of a table with these columns; bad dates go."""
    if path.endswith(".json"):
        rows = spark.read.option("wholetext", True).text(path).select(
            F.explode(F.from_json("value", "map<string, string>")).alias("doc_id", "doc_date")
        )
    else:
        rows = delimited(spark, path).select("doc_id", "doc_date")
    parsed = F.to_date(F.try_to_timestamp(F.col("doc_date"), F.lit("yyyy-MM-dd")))
    return rows.select("doc_id", parsed.alias("doc_date")).where("doc_date is not null")


def with_doc_dates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows with the date of their document, null where none is known; of several the first."""
    once = dates.groupBy(F.col("doc_id").alias("d_id")).agg(F.min("doc_date").alias("doc_date"))
    return rows.join(once, F.col("doc_id").cast("string") == F.col("d_id"), "left").drop("d_id")


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV with a header, all columns as strings."""
    return spark.read.option("header", True).option("sep", "\t" if path.endswith((".tsv", ".tab")) else ",").csv(path)


def coerced(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their own names, from the first alias that is there and not empty."""
    have = set(rows.columns)
    out = []
    for name, options in aliases.items():
        found = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in options if c in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return rows.select(*out)


def verb_classes(spark: SparkSession, path: str) -> DataFrame:
    """Verb classes of XML files: id, members, roles; subclasses are their own rows with a parent."""
    schema = (
        "_ID string, MEMBERS struct<MEMBER: array<struct<_name: string>>>, THEMROLES struct<THEMROLE: array<struct<_type: string>>>,"
        " SUBCLASSES struct<VNSUBCLASS: array<struct<_ID: string, MEMBERS: struct<MEMBER: array<struct<_name: string>>>>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "VNCLASS").schema(schema).load(path)
    top = rows.select(
        F.col("_ID").alias("class_id"), F.lit(None).cast("string").alias("parent_id"),
        F.col("MEMBERS.MEMBER._name").alias("members"), F.col("THEMROLES.THEMROLE._type").alias("roles"),
    )
    below = rows.select("_ID", F.explode("SUBCLASSES.VNSUBCLASS").alias("c")).select(
        F.col("c._ID").alias("class_id"), F.col("_ID").alias("parent_id"), F.col("c.MEMBERS.MEMBER._name").alias("members"),
        F.lit(None).cast("array<string>").alias("roles"),
    )
    return top.unionByName(below)


def role_pages(spark: SparkSession, path: str) -> DataFrame:
    """Predicate, roleset and role lines of HTML pages, tags stripped."""
    pages = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "<[^>]+>", " ").alias("text"))
    sets = pages.select(
        F.regexp_extract("text", r"Predicate:\s*(\S+)", 1).alias("predicate"),
        F.explode(F.regexp_extract_all("text", F.lit(r"Roleset:?\s*([\w.-]+)((?:(?!Roleset).)*)"), F.lit(0))).alias("part"),
    )
    return sets.select("predicate", F.regexp_extract("part", r"Roleset:?\s*([\w.-]+)", 1).alias("roleset"), F.regexp_extract_all("part", F.lit(r"Arg[0-9A-Z-]+"), F.lit(0)).alias("roles"))


def frame_schemas(spark: SparkSession, path: str) -> DataFrame:
    """Frames and their sorted roles from a folder of JSON schemas."""
    whole = spark.read.text(path, wholetext=True)
    arguments = F.from_json(F.get_json_object("value", "$.properties.arguments.properties"), "map<string, string>")
    return whole.select(
        F.get_json_object("value", "$.properties.frame.const").alias("frame"), F.sort_array(F.map_keys(arguments)).alias("roles")
    ).where("frame is not null")


def write_nquads(quads: DataFrame, path: str, column: str = "quad") -> None:
    quads.select(column).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A report table as Markdown, for the driver to hold; one of more than ``limit`` rows is refused."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report of more than {limit} rows; write it as CSV")
    for row in found:
        lines.append("| " + " | ".join("" if v is None else str(v) for v in row) + " |")
    return "\n".join(lines) + "\n"


def stage_metadata(spark: SparkSession, stage: str, version: str, counts: dict[str, int], warnings: list[str], config: dict) -> DataFrame:
    """One row that tells how a stage was run."""
    return spark.createDataFrame(
        [(stage, version, spark.version, counts, warnings, json.dumps(config, sort_keys=True))],
        "stage string, version string, engine string, input_counts map<string, long>, warnings array<string>, config string",
    )
