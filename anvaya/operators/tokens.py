"""From documents to sentences and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anvaya.functions.iri import sentence_key
from anvaya.functions.text import _CLASS, BETWEEN_WORDS, PIECE_END

BLOCK = 64
#: Marks the end of a piece in texts that do not hold it; the white space that may stand before a piece.
MARK, SPACE = "\x01", " \t\n\x0b\f\r"


def sentences(docs: DataFrame) -> DataFrame:
    """One row a line with text; blank lines have no row but keep their number."""
    return (
        docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "text"))
        .where(F.col("text").rlike(r"\S"))
        .select("doc_id", "sent_id", sentence_key("doc_id", "sent_id").alias("sent_key"), "text")
    )


def pieces(text: Column | str = "text") -> Column:
    """Tokens with the white space before them, which tile a text but for its last white space.

    Their ends are marked by plain replacements, many times faster than looking around at
    every letter, which only texts with other white space than single spaces, or with the mark, need.
    """
    text = F.col(text) if isinstance(text, str) else text
    marked = F.replace(F.regexp_replace(text, rf" ?[{_CLASS}]", f"{MARK}$0{MARK}"), F.lit(" "), F.lit(f"{MARK} "))
    odd = F.array_remove(F.split(F.regexp_replace(text, rf"[{SPACE}]+\z", ""), PIECE_END), "")
    return F.when(text.rlike(rf"[\t\x0b\f\r\n{MARK}]|\s\s|\s\z"), odd).otherwise(F.array_remove(F.split(marked, MARK), ""))


def token_array(text: Column | str = "text") -> Column:
    return F.transform(pieces(text), lambda p: F.ltrim(p, F.lit(SPACE)))


def word_array(text: Column | str = "text") -> Column:
    """The tokens that are no punctuation, as written: what stands between white space and marks."""
    return F.array_remove(F.split(F.col(text) if isinstance(text, str) else text, BETWEEN_WORDS), "")


def tokens(sents: DataFrame) -> DataFrame:
    """One row a token with half-open character offsets.

    Tokens and the white space before them tile the sentence, so the length of what
    comes before is the offset. It is taken within the row, over blocks of ``BLOCK`` pieces
    and then within a block, so that nothing is shuffled. Each explode also keeps the
    arrays above it from being made anew for every element.
    """
    keys = ["doc_id", "sent_id", "sent_key"]

    def length(part: Column) -> Column:
        return F.char_length(F.array_join(part, ""))

    cut = sents.select(*keys, F.explode(F.array(pieces())).alias("pieces"))
    blocks = cut.select(*keys, F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size("pieces") - 1) / BLOCK), F.lit(0)).cast("int")),
        lambda k: F.struct(
            (k * BLOCK).alias("first"), length(F.slice("pieces", F.lit(1), k * BLOCK)).alias("base"),
            F.slice("pieces", k * BLOCK + 1, F.lit(BLOCK)).alias("part"),
        ),
    )).alias("block"))
    placed = blocks.select(*keys, "block.first", F.posexplode(F.transform("block.part", lambda p, n: F.struct(
        p.alias("piece"), (F.col("block.base") + length(F.slice("block.part", F.lit(1), n + 1))).alias("stop"),
    ))).alias("pos", "one"))
    return placed.withColumn("tok", F.ltrim("one.piece", F.lit(SPACE))).select(
        *keys, (F.col("first") + F.col("pos")).alias("idx"), "tok",
        (F.col("one.stop") - F.char_length("tok")).alias("start"), F.col("one.stop").alias("stop"),
    )


def words(sents: DataFrame) -> DataFrame:
    """Tokens that are no punctuation, numbered (``w``), in lower case (``word``) and as written (``tok``)."""
    cut = sents.select("doc_id", "sent_id", "sent_key", F.posexplode(word_array()).alias("w", "tok"))
    return cut.withColumn("word", F.lower("tok"))


def context_windows(toks: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Each token with the tokens around it, joined by spaces."""
    w = Window.partitionBy("sent_key").orderBy("idx").rowsBetween(-before, after)
    return toks.withColumn("context", F.array_join(F.collect_list("tok").over(w), " "))
