"""Text and span expressions. All are built-in column expressions unless they say otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Single punctuation marks that are tokens of their own.
PUNCTUATION = ".,;!?।\"'|()[]{}<>॥"
_CLASS = r".,;!?।\"'|()\[\]{}<>॥"
#: A token with the white space before it; the two together tile a sentence.
PIECE = rf"\s*(?:[{_CLASS}]|[^\s{_CLASS}]+)"
#: Where one piece ends and the next begins. Splitting there is many times faster than
#: extracting all matches, which copies the text for each of them.
PIECE_END = rf"(?<=\S)(?=\s)|(?<=[{_CLASS}])(?=\S)|(?<=[^\s{_CLASS}])(?=[{_CLASS}])"
#: What stands between tokens that are no punctuation.
BETWEEN_WORDS = rf"[\s{_CLASS}]+"
#: A word boundary that knows combining marks; ``\b`` does not.
WORD_CLASS = r"\p{L}\p{N}\p{M}_"
BOUNDARY = (
    rf"(?:(?<![{WORD_CLASS}])(?=[{WORD_CLASS}])|(?<=[{WORD_CLASS}])(?![{WORD_CLASS}]))"
)
#: Digits of another script and their ASCII counterparts.
DIGITS_HI, DIGITS = "०१२३४५६७८९", "0123456789"


def bounded(pattern: str) -> str:
    """A pattern that matches whole words only."""
    return f"{BOUNDARY}(?:{pattern}){BOUNDARY}"


def stripped(text: Column | str) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def squeezed(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return stripped(F.regexp_replace(_col(text), r"\s+", " "))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def unicode_form(text: Column | str, form: str = "NFKC") -> Column:
    """A Unicode normal form; the one text step that has no built-in function."""

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else unicodedata.normalize(form, v))

    return normal(_col(text))


def normalize_sentence(text: Column | str, compose: bool = False) -> Column:
    """Sentence normaliser: one danda, no joiners or marks, single spaces."""
    value = unicode_form(text) if compose else _col(text)
    value = F.translate(value, "॥﻿‍‌", "।")
    return squeezed(F.coalesce(value, F.lit("")))


def normalize_quotes(text: Column | str) -> Column:
    """Entity normaliser: straight quotes, no joiners, single spaces."""
    value = F.translate(_col(text), "“”‘’`‍‌﻿", "\"\"'''")
    return squeezed(F.coalesce(value, F.lit("")))


def normalize_lookup(text: Column | str) -> Column:
    """Lookup normaliser: no joiners or nukta, underscores as spaces, lower case."""
    value = F.translate(_col(text), "_‍‌﻿़", " ")
    return F.lower(squeezed(F.coalesce(value, F.lit(""))))


def normalize_eval(text: Column | str) -> Column:
    """Evaluation normaliser: single spaces and lower case."""
    return F.lower(squeezed(F.coalesce(_col(text), F.lit(""))))


def normalize_answer(text: Column | str) -> Column:
    """Question-answer normaliser: no closing marks and no spaces."""
    value = F.regexp_replace(squeezed(F.coalesce(_col(text), F.lit(""))), r"[?।.!]+$", "")
    return F.regexp_replace(value, r"\s+", "")


def trim_punctuation(token: Column | str) -> Column:
    """A token without punctuation at its ends."""
    marks = r"[\s।,.;:!?()\[\]{}|\"'`“”’‘]+"
    return F.regexp_replace(_col(token), rf"^{marks}|{marks}$", "")


def strip_suffix(token: Column | str, suffixes: Sequence[str]) -> Column:
    """The first suffix of the list that fits comes off, if more than one letter stays."""
    token = _col(token)
    out = token
    for suffix in reversed(suffixes):
        fits = token.endswith(suffix) & (F.char_length(token) > len(suffix) + 1)
        out = F.when(fits, F.substring(token, F.lit(1), F.char_length(token) - len(suffix))).otherwise(out)
    return out


def token_category(
    token: Column | str, raw: Column | str, closed: dict[str, Sequence[str]],
    verb_suffixes: Sequence[str], adjective_suffixes: Sequence[str],
) -> Column:
    """Category of a token: word lists in order, then number, suffixes, capital, lexical."""
    token, raw = _col(token), _col(raw)
    out = F.when((token == "") | token.isNull(), "punct")
    for category, words in closed.items():
        out = out.when(token.isin(list(words)), category)
    out = out.when(token.rlike(r"^[0-9०-९]+$"), "number")
    for category, suffixes in (("verb", verb_suffixes), ("adjective", adjective_suffixes)):
        if suffixes:
            hit = token.endswith(suffixes[0])
            for suffix in suffixes[1:]:
                hit = hit | token.endswith(suffix)
            out = out.when(hit, category)
    return out.when(raw.rlike(r"\p{Lu}"), "proper_noun").otherwise("lexical")


def resolve_span(tokens: Column | str, start: Column | str, stop: Column | str) -> Column:
    """Tokens of a half-open span joined by spaces; null on bad bounds."""
    tokens, start, stop = _col(tokens), _col(start), _col(stop)
    good = (start >= 0) & (stop > start) & (stop <= F.size(tokens))
    return F.when(good, F.array_join(F.slice(tokens, start + 1, stop - start), " "))


def validate_spans(tokens: Column | str, items: Column | str) -> Column:
    """Error strings of spans (name, text, start, stop) whose text is not what they cover."""
    return F.array_compact(F.transform(_col(items), lambda x: F.when(
        resolve_span(tokens, x["start"], x["stop"]).isNull(),
        F.concat(x["name"], F.lit(": span out of bounds")),
    ).when(
        resolve_span(tokens, x["start"], x["stop"]) != x["text"],
        F.concat(x["name"], F.lit(": text does not match span")),
    )))


def expand_over(tokens: Column | str, stop: Column | str, markers: Sequence[str], most: int = 2) -> Column:
    """A span's end moved right over up to ``most`` marker tokens."""
    tokens, stop = _col(tokens), _col(stop)
    out = stop
    reached = F.lit(True)
    for k in range(most):
        reached = reached & F.coalesce(F.get(tokens, stop + k).isin(list(markers)), F.lit(False))
        out = F.when(reached, stop + (k + 1)).otherwise(out)
    return out


def valid_span(start: Column | str, stop: Column | str) -> Column:
    start, stop = _col(start), _col(stop)
    return F.coalesce((start >= 0) & (start <= stop), F.lit(False))


def overlaps(a0, a1, b0, b1) -> Column:
    """Half-open spans share a place."""
    return ~((_col(a1) <= _col(b0)) | (_col(b1) <= _col(a0)))


def span_distance(a0, a1, b0, b1) -> Column:
    """0 where spans overlap, else the gap; a million where one is null."""
    a0, a1, b0, b1 = map(_col, (a0, a1, b0, b1))
    return F.coalesce(
        F.when(overlaps(a0, a1, b0, b1), 0).otherwise(F.greatest(b0 - a1, a0 - b1)), F.lit(1_000_000)
    )


def overlap_ratio(a0, a1, b0, b1, by: str = "shorter") -> Column:
    """Shared length over the shorter or the longer span."""
    a0, a1, b0, b1 = map(_col, (a0, a1, b0, b1))
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    pick = F.least if by == "shorter" else F.greatest
    return F.coalesce(F.try_divide(shared.cast("double"), pick(a1 - a0, b1 - b0)), F.lit(0.0))


def surface_forms(
    text: Column | str, honorifics: Sequence[str], postpositions: Sequence[str]
) -> Column:
    """Distinct forms of a name: as is, without titles in front, without particles behind."""
    base = squeezed(text)
    lead = "|".join(honorifics)
    tail = "|".join(postpositions)
    no_title = F.regexp_replace(base, rf"(?i)^(?:(?:{lead})\.? )+", "")
    no_tail = F.regexp_replace(base, rf"(?i)(?: (?:{tail}))+$", "")
    clean = F.regexp_replace(no_title, rf"(?i)(?: (?:{tail}))+$", "")
    return F.array_distinct(F.array_remove(F.array(base, no_title, no_tail, clean), ""))


def list_field(text: Column | str) -> Column:
    """A list field: a JSON array, else split at the first of ``|``, ``;``, ``,`` that occurs."""
    text = stripped(F.coalesce(_col(text), F.lit("")))
    plain = (
        F.when(text.contains("|"), F.split(text, r"\|")).when(text.contains(";"), F.split(text, ";"))
        .when(text.contains(","), F.split(text, ",")).otherwise(F.array(text))
    )
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(plain)
    return F.array_remove(F.transform(F.coalesce(items, F.array(text)), stripped), "")


def distinct_spellings(items: Column | str) -> Column:
    """Order-preserving distinct that ignores case and keeps the first spelling."""
    return F.aggregate(
        _col(items), F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc)
        .otherwise(F.array_append(acc, x)),
    )


def canonical_label(label: Column | str, mapping: dict[str, str]) -> Column:
    """NER label: mapped, or without its B/I mark, or by the first known part it holds."""
    raw = F.upper(stripped(F.coalesce(_col(label), F.lit(""))))
    body = F.regexp_replace(raw, r"^[BIESLU][-_]", "")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in mapping.items():
        out = out.when((raw == key) | (body == key), value)
    for part, value in (("PER", "PER"), ("ORG", "ORG"), ("LOC", "LOC"), ("TIME", "TIME"),
                        ("DATE", "TIME"), ("NUM", "NUM")):
        out = out.when(body.contains(part), value)
    return out.otherwise("MISC")


def numeric_surface(text: Column | str, words: dict[str, int]) -> Column:
    """A number from digits of either script, or from a number word; else null."""
    ascii_ = F.translate(stripped(text), DIGITS_HI, DIGITS)
    out = F.when(ascii_.rlike("^[0-9]{1,9}$"), ascii_.try_cast("int"))
    for word, number in words.items():
        out = out.when(ascii_ == word, number)
    return out


def logistic(score: Column | str, centre: float = 2.8) -> Column:
    return F.round(1 / (1 + F.exp(-(_col(score) - centre))), 6)


def lookup_confidence(rank: Column | str, synsets: Column | str, length: Column | str) -> Column:
    """Linear confidence of a lexical lookup, between 0 and 0.99."""
    raw = (
        F.lit(0.9) - 0.08 * _col(rank) - 0.03 * F.greatest(_col(synsets) - 1, F.lit(0))
        + 0.01 * F.least(_col(length), F.lit(6))
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), raw)), 4)


def excerpt(text: Column | str, start: Column | str, stop: Column | str, radius: int = 40) -> Column:
    """The text around a span, ``radius`` characters on either side."""
    low = F.greatest(_col(start) - radius, F.lit(0))
    return F.substring(_col(text), low + 1, _col(stop) + radius - low)


def rate_text(numerator: Column | str, denominator: Column | str) -> Column:
    """A share as text with two places; ``n/a`` where there is nothing to divide by."""
    # Rounded as doubles are, after one division: 0.285 is a little less than that.
    share = F.try_divide(_col(numerator).cast("double") * 100, _col(denominator).cast("double"))
    return F.when(_col(denominator) > 0, F.when(share.isNotNull(), F.format_string("%.2f%%", F.round(share * 100) / 100))).otherwise(F.lit("n/a"))


def feature_values(feats: Column | str) -> Column:
    """Morphological features ``K=V|K=V`` as a map."""
    return F.str_to_map(F.coalesce(_col(feats), F.lit("")), F.lit("\\|"), F.lit("="))


#: Letters of the Devanagari script and their ASCII counterparts.
VOWELS = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
}
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h",
    "\u0958": "q", "\u0959": "kh", "\u095a": "g", "\u095b": "z", "\u095c": "r", "\u095d": "rh", "\u095e": "f",
}
VOWEL_SIGNS = {
    "\u093e": "aa", "\u093f": "i", "\u0940": "ii", "\u0941": "u", "\u0942": "uu", "\u0943": "ri", "\u0947": "e",
    "\u0948": "ai", "\u094b": "o", "\u094c": "au",
}
VIRAMA = "\u094d"


def transliterate(text: Column | str) -> Column:
    """Devanagari in ASCII letters: a consonant without a vowel sign or virama takes an ``a``.

    All other characters are left out.
    """
    letters, signs = "".join(CONSONANTS), "".join(VOWEL_SIGNS)
    known = letters + signs + VIRAMA + "".join(VOWELS)
    out = F.regexp_replace(_col(text), f"[^{known}]", " ")  # still between its neighbours
    out = F.regexp_replace(out, f"([{letters}])(?![{signs}{VIRAMA}])", "$1a")
    table = VOWELS | CONSONANTS | VOWEL_SIGNS
    single = {k: v for k, v in table.items() if len(v) == 1}
    for letter, ascii_ in table.items():
        if len(ascii_) > 1:
            out = F.replace(out, F.lit(letter), F.lit(ascii_))
    return F.translate(out, "".join(single) + VIRAMA + " ", "".join(single.values()))


def ascii_form(text: Column | str) -> Column:
    """A title in lower case without all but its ASCII letters."""
    return F.regexp_replace(F.lower(_col(text)), "[^a-z]", "")


def acronym_title(iri: Column | str) -> Column:
    """Whether the title at the end of an IRI is an acronym, or begins with one."""
    last = F.regexp_extract(_col(iri), "([^/]*)$", 1)
    title = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    #: Patterns of acronyms.
    return title.rlike("^[A-Z0-9]{2,}(?:[_-][A-Z0-9]{2,})+$") | F.substring_index(title, "_", 1).rlike("^[A-Z0-9]{3,}$")


def numeric_form(text: Column | str) -> Column:
    """Whether a form holds a digit of any script."""
    return _col(text).rlike(r"\p{Nd}")


def listed(text: Column | str, words: Sequence[str]) -> Column:
    """Whether a form is one of the words, both as they are looked up."""
    return F.array_contains(F.transform(F.array(*[F.lit(w) for w in words]), normalize_lookup), normalize_lookup(text))


def best_ratio(left: Column | str, right: Column | str) -> Column:
    """Best matching-blocks ratio between two lists of forms (Arrow UDF)."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def best(x, y) -> float:
            pairs = ((p, q) for p in (x if x is not None else ()) for q in (y if y is not None else ()))
            return max((SequenceMatcher(None, p, q).ratio() for p, q in pairs), default=0.0)

        return pd.Series([best(x, y) for x, y in zip(a, b)], dtype=float)

    return ratio(_col(left), _col(right))
