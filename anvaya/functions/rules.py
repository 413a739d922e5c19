"""Small tests and names: parts of speech, sub-events, roles, spans, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from anvaya.functions.text import normalize_lookup

#: Names of the stages of an event.
SUBEVENTS = {
    "init": "init", "initial": "init", "initial_state": "init", "inception": "init", "proc": "proc", "process": "proc",
    "during": "proc", "res": "res", "result": "res", "result_state": "res", "final": "res",
}
#: Parts of speech that are not looked up, by what is looked up.
BANNED_POS = {
    "trigger": ["PUNCT", "SYM"],
    "argument": ["PRON", "ADP", "SCONJ", "CCONJ", "DET", "PART", "NUM", "SYM", "PUNCT", "INTJ"],
}
#: Roles that persons and places have.
PERSON_ROLES = ["agent", "actor", "experiencer", "subject", "owner", "speaker", "leader"]
PLACE_ROLES = ["destination", "location", "source", "origin", "place", "venue"]
FAR = 9999


def _mapped(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, result in table.items():
        out = F.when(value == name, result).otherwise(out)
    return out


def subevent(label: Column) -> Column:
    """A stage label as init, proc or res; null for others."""
    return _mapped(F.lower(F.trim(label)), SUBEVENTS)


def subevent_of(attributes: Sequence[Column], value: Column) -> Column:
    """The stage by the first attribute that names one, else by a word of the value."""
    hint = F.regexp_extract(F.coalesce(value, F.lit("")), r"(?i)\b(init|proc|res)\b", 1)
    return F.coalesce(*[subevent(a) for a in attributes], subevent(hint))


def pos_allowed(upos: Column, kind: str, allowed: Sequence[str] | None = None) -> Column:
    """Whether a word of this part of speech is looked up; one of no known part is."""
    pos = F.upper(F.coalesce(upos, F.lit("")))
    test = pos.isin(list(allowed)) if allowed is not None else ~pos.isin(BANNED_POS.get(kind, []))
    return (pos == "") | test


def pos_list(raw: str) -> list[str] | None:
    """Parts of speech of a comma-separated list; None if there is no list."""
    return sorted({x.strip().upper() for x in raw.split(",") if x.strip()}) if raw else None


def function_only(text: Column, words: Sequence[str]) -> Column:
    """Whether a term holds nothing but function words."""
    parts = F.filter(F.split(normalize_lookup(text), " "), lambda x: x != "")
    return F.forall(parts, lambda x: x.isin(list(words)))


def valid_token(text: Column, start: Column, stop: Column) -> Column:
    """Whether a token has a text and a span in order."""
    return F.coalesce((F.trim(text) != "") & (stop >= start), F.lit(False))


def postposition_warning(
    role: Column, text: Column, source: Sequence[str], destination: Sequence[str], locative: Sequence[str]
) -> Column:
    """What is wrong with the case markers of an argument, by its role; null if nothing is."""
    name, words = F.lower(F.coalesce(role, F.lit(""))), F.coalesce(text, F.lit(""))

    def lacks(*markers: str) -> Column:
        return ~F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: words.contains(m))

    #: Case markers and warnings.
    return (
        F.when(name.isin(list(source)) & lacks("से"), "source_without_se_marker")
        .when(name.isin(list(destination)) & lacks("को", "तक", "में", "पर"), "destination_without_locative_marker")
        .when(name.isin(list(locative)) & lacks("में", "पर", "तक", "से", "को"), "locative_role_without_case_marker")
    )


def role_hint(role: Column, hints: dict[str, str] | None = None) -> Column:
    """PER, LOC or MISC for a role; given hints come first."""
    name = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    given = _mapped(name, {k.lower(): v.upper() for k, v in (hints or {}).items()})
    return F.coalesce(given, F.when(name.isin(PERSON_ROLES), "PER").when(name.isin(PLACE_ROLES), "LOC").otherwise("MISC"))


def sentence_distance(left: Column, right: Column) -> Column:
    """Sentences between two ids; FAR if either is no number."""
    a, b = F.trim(left.cast("string")), F.trim(right.cast("string"))
    return F.coalesce(F.abs(F.try_subtract(a.try_cast("long"), b.try_cast("long"))), F.lit(FAR).cast("long"))


def span_of(chars: Column, words: Column, prefer: str = "char") -> Column:
    """The first span of two that is a pair in order from 0 on, that of characters first unless said."""
    def good(span: Column) -> Column:
        return F.when((F.size(span) == 2) & (F.get(span, F.lit(0)) >= 0) & (F.get(span, F.lit(1)) >= F.get(span, F.lit(0))), span)

    return F.coalesce(good(chars), good(words)) if prefer == "char" else F.coalesce(good(words), good(chars))


def event_key(doc: Column, sent: Column, event: Column) -> Column:
    """Key of an event over reports."""
    return F.concat_ws("||", *[F.coalesce(x.cast("string"), F.lit("")) for x in (doc, sent, event)])


def frame_family(frame: Column) -> Column:
    """What stands before the first dot of a frame."""
    return F.substring_index(F.coalesce(frame, F.lit("")), ".", 1)
