"""Shared tables of the catalogue: sentences, tokens and words of the documents, and lexicons.

The driver's documents are invented words of four languages, so the lexicons
here are small ones in their spirit; every operator takes its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anvaya.functions.text import PIECE, PUNCTUATION, token_category
from anvaya.operators import tokens as tok
from anvaya.plans.registry import spread, table

FRAMES = {
    "give.01": ["and", "of the", "the that"], "give.02": ["and the of", "inst"],
    "take.01": ["en la", "que", "de la que"], "take.02": ["tion", "in the", "to and"],
    "see.01": ["ing", "is a", "that this"], "go.01": ["und", "der die", "die und der"],
    "go.02": ["und", "oder", "in der"], "say.01": ["por", "la de", "los"],
}
CLOSED = {
    "determiner": ["the", "a", "le", "la", "der", "die"], "adp": ["of", "to", "in", "de", "en"],
    "conjunction": ["and", "et", "und", "y"], "pronoun": ["it", "he", "elle", "ist"],
    "copula": ["is", "est"], "auxiliary": ["was", "are", "be"], "light_verb": ["that", "que"],
}
STOP = sorted({w for words in CLOSED.values() for w in words})
VERB_SUFFIXES, ADJECTIVE_SUFFIXES = ["ing", "ed", "ent"], ["ble", "al", "ais"]


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.sentences(spread(table(spark, sf_dir, "documents")))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.tokens(sentences(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.words(sentences(spark, sf_dir)).withColumn("category", category(F.col("word"), F.col("tok")))


def category(word: Column, raw: Column) -> Column:
    return token_category(word, raw, CLOSED, VERB_SUFFIXES, ADJECTIVE_SUFFIXES)


def word_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_key, toks): the words of each sentence in one row.

    The explode keeps the split from being made again for what is asked of the array.
    """
    return sentences(spark, sf_dir).select("sent_key", F.explode(F.array(tok.word_array())).alias("toks"))


def quoted(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def sql_list(items) -> str:
    return f"[{quoted(items)}]"


_PIECE = PIECE.replace("'", "''")
SENTENCE = r"""sentence AS (
  SELECT doc_id, pos - 1 AS sent_id, doc_id || '::' || (pos - 1) AS sent_key, line AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '')"""
TOKEN = SENTENCE + rf""", piece AS (
  SELECT doc_id, sent_id, sent_key, unnest(regexp_extract_all(text, '{_PIECE}')) AS piece,
    generate_subscripts(regexp_extract_all(text, '{_PIECE}'), 1) - 1 AS idx FROM sentence),
token AS (
  SELECT doc_id, sent_id, sent_key, idx, regexp_replace(piece, '^\s+', '') AS tok,
    CAST(sum(length(piece)) OVER (PARTITION BY sent_key ORDER BY idx) AS INT)
      - length(regexp_replace(piece, '^\s+', '')) AS start,
    CAST(sum(length(piece)) OVER (PARTITION BY sent_key ORDER BY idx) AS INT) AS stop
  FROM piece)"""


def _category_sql() -> str:
    parts = [f"WHEN word IN ({quoted(words)}) THEN '{name}'" for name, words in CLOSED.items()]
    parts.append("WHEN regexp_matches(word, '^[0-9]+$') THEN 'number'")
    for name, suffixes in (("verb", VERB_SUFFIXES), ("adjective", ADJECTIVE_SUFFIXES)):
        parts.append("WHEN " + " OR ".join(f"ends_with(word, '{s}')" for s in suffixes) + f" THEN '{name}'")
    parts.append(r"WHEN regexp_matches(tok, '\p{Lu}') THEN 'proper_noun'")
    return "CASE " + " ".join(parts) + " ELSE 'lexical' END"


CATEGORY = _category_sql()
WORD = TOKEN + f""", word0 AS (
  SELECT *, row_number() OVER (PARTITION BY sent_key ORDER BY idx) - 1 AS w, lower(tok) AS word
  FROM token WHERE tok NOT IN ({quoted(PUNCTUATION)})),
word AS (SELECT *, {CATEGORY} AS category FROM word0)"""
TRIGGER = "trig AS (SELECT frame_id, term, len(term) AS n, term[1] AS head, term[-1] AS tail FROM (VALUES " + ", ".join(
    f"('{frame}', {sql_list(term.split())})" for frame, terms in sorted(FRAMES.items()) for term in terms
) + ") AS t(frame_id, term))"
