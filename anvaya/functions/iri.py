"""IRIs, keys and the N-Quads text form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = "urn:anvaya:"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
QUAD = (
    r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?)'
    r" <([^>]*)> \.$"
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def encoded(text: Column | str) -> Column:
    """Spaces as underscores, then percent-encoding that leaves ``/`` and ``~`` as they are."""
    out = F.url_encode(F.replace(F.trim(_col(text)), F.lit(" "), F.lit("_")))
    for old, new in (("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def minted(kind: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), F.concat_ws("/", *[encoded(_col(p).cast("string")) for p in parts]))


def stable_id(given: Column | str, *parts: Column | str) -> Column:
    """The given id, else the first twelve hex digits of the parts' SHA-1."""
    text = F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return F.coalesce(_col(given), F.substring(F.sha1(text), 1, 12))


def sentence_key(doc: Column | str, sent: Column | str) -> Column:
    return F.concat_ws("::", _col(doc).cast("string"), _col(sent).cast("string"))


def local_name(iri: Column | str) -> Column:
    """What follows the last ``#``, ``/`` or ``:``, decoded."""
    return F.try_url_decode(F.regexp_extract(_col(iri), r"([^#/:]*)$", 1))


def escaped(text: Column | str) -> Column:
    """JSON string escapes, without the quotes."""
    wrapped = F.to_json(F.struct(_col(text).alias("v")))
    return F.substring(wrapped, F.lit(7), F.char_length(wrapped) - 8)


def iri_term(iri: Column | str) -> Column:
    return F.concat(F.lit("<"), _col(iri), F.lit(">"))


def literal_term(text: Column | str, lang: str | None = None, datatype: str | None = None) -> Column:
    """A literal with a language or a datatype; decimals have six places, or ``.0`` where bare."""
    value = _col(text)
    if datatype == XSD + "decimal":
        value = F.format_string("%.6f", value.cast("double"))
    body = F.concat(F.lit('"'), escaped(value.cast("string")), F.lit('"'))
    if lang:
        return F.concat(body, F.lit(f"@{lang}"))
    return F.concat(body, F.lit(f"^^<{datatype}>")) if datatype else body


def quad(subject: Column | str, predicate: str, term: Column, graph: str = BASE + "graph") -> Column:
    return F.concat_ws(" ", iri_term(subject), F.lit(f"<{predicate}>"), term, F.lit(f"<{graph}> ."))


def curie(value: Column | str, prefixes: dict[str, str]) -> Column:
    """A prefixed name as a full IRI; other values as they are."""
    value = _col(value)
    out = value
    for prefix, full in prefixes.items():
        out = F.when(value.startswith(prefix + ":"), F.concat(
            F.lit(full), F.substring(value, F.lit(len(prefix) + 2), F.char_length(value))
        )).otherwise(out)
    return out


def quad_fields(line: Column | str) -> Column:
    """subject, predicate, object, kind, lang, datatype, graph of one N-Quads line; null if it is none."""
    line = _col(line)

    def part(n: int) -> Column:
        return F.regexp_extract(line, QUAD, n)

    literal = F.get_json_object(F.concat(F.lit('{"v":"'), part(4), F.lit('"}')), "$.v")
    is_iri = line.rlike(r"^<[^>]*> <[^>]*> <")
    return F.when(line.rlike(QUAD), F.struct(
        part(1).alias("s"), part(2).alias("p"),
        F.when(is_iri, part(3)).otherwise(F.coalesce(literal, F.lit(""))).alias("o"),
        F.when(is_iri, "uri").otherwise("literal").alias("kind"),
        F.nullif(part(5), F.lit("")).alias("lang"), F.nullif(part(6), F.lit("")).alias("datatype"),
        part(7).alias("g"),
    ))
