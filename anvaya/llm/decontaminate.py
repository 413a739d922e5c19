"""Benchmark decontamination by a distributed positional inverted index.

Only DataFrame operations: no Python runs on the executors.

1. The windows of the benchmark (13 consecutive words of an item, or the whole
   of a shorter one) are made once each, whoever shares them.
2. One pass over the texts stores the postings of the terms that are rarest in
   the test: of each window the ``LISTS`` that the fewest windows hold. A posting is
   document, position, term. Only single words pass the join with the terms.
3. The stored terms are counted in the corpus, and the lists of each window are
   intersected by position less offset, from the rarest on: the rarest list gives the
   places where a window may start, and the second must agree. The lists of all terms are
   then made for the documents where these two meet, and every word must be in its place.
4. Matching windows give start and end of exact phrase matches per document;
   covered words are counted as the length of the union of these spans. The lists of the
   three rarest terms also give proximity matches, a few words off their places.

Benchmark-sized tables are broadcast only below ``BROADCAST_ROWS`` rows; beyond
that the same joins shuffle, and the engine may split them where a word is hot.

Defined results: a null or empty text has no words, no hits and is clean; an
item without words has no window; rows with a null item_id make windows but
are not counted as items; repeated rows repeat their result (a document is
told apart by doc_id and a 64-bit hash of its text); of terms equally rare in the
corpus the first in the window counts as rarer; empty tables give an empty result (documents)
or clean documents (benchmark); further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anvaya.llm.common import discard, stage

WINDOW = 13
SLOP = 4
LISTS = 4
BROADCAST_ROWS = 500_000
#: Term numbers of the row that stands for a document, and words that no text holds.
WHOLE, NAMELESS = -1, -2
_WHOLE, _NAMELESS = "/", "//"
#: ASCII letters in both cases and what separates words.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words: all outside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, with A-Z still upper case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def same_word(raw: Column, term: Column) -> Column:
    """Whether a word as written is the lower-cased ``term``; most are equal as they stand."""
    return (raw == term) | (F.translate(raw, UPPER, LOWER) == term)


def words_of(text: str = "text") -> Column:
    """The words of a text, cut as if lower-cased, not yet lower-cased.

    Splitting is many times faster than extracting all matches, which copies the text for each.
    """
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), "")


def document_key(docs: DataFrame) -> list[Column]:
    """(doc, text_hash): the pair tells documents apart, those without an id, too."""
    return [
        F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("doc"),
        F.xxhash64(docs["text"], docs["doc_id"].isNull()).alias("text_hash"),
    ]


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has few rows, else left to shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, phrase, terms): all windows of all items."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"),
        F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("text"),
    ).select("item_id", words_of().alias("w")).where(F.size("w") > 0)
    return (
        items.withColumn(
            "at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))))
        )
        .withColumn("terms", F.slice("w", F.col("at"), F.lit(size)))
        .select("item_id", F.array_join("terms", " ").alias("phrase"), "terms")
        .distinct()
    )


def postings(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """(doc, text_hash, n_words, at, term_id): where the terms stand in the documents.

    ``at`` is the 0-based position. ``terms`` has (term_id, term), ``rows`` of them at
    most. Each document also has one row with term_id ``WHOLE``, or ``NAMELESS`` where
    it has no id. The texts are read and cut once; only single words pass the join.
    """
    marked = terms.select("term_id", "term").unionByName(docs.sparkSession.createDataFrame(
        [(WHOLE, _WHOLE), (NAMELESS, _NAMELESS)], "term_id long, term string"
    ))
    own = F.array(F.when(docs["doc_id"].isNull(), _NAMELESS).otherwise(_WHOLE))
    # The array itself must not pass the explode, so its size is taken before.
    cut = docs.select(*document_key(docs), F.concat(own, words_of()).alias("raws")).select(
        "doc", "text_hash", (F.size("raws") - 1).alias("n_words"), "raws"
    )
    # Never empty; the outer form spares a filter that would cut the texts twice.
    tokens = cut.select("doc", "text_hash", "n_words", F.posexplode_outer("raws").alias("at", "raw"))
    # Full lower case is quick and wider than A-Z alone; the exact test follows on what meets.
    return tokens.join(sized(marked, rows), [
        F.lower("raw") == F.lower("term"), same_word(F.col("raw"), F.col("term")),
    ]).select("doc", "text_hash", "n_words", (F.col("at") - 1).alias("at"), "term_id")


def chosen_terms(phrases: DataFrame) -> DataFrame:
    """(phrase_id, length, offset, term): the ``LISTS`` rarest test terms of each window.

    Rarest among the windows themselves; of equally rare ones those of least digest, so
    that windows that share terms choose alike. ``offset`` is where a term stands first.
    """
    spots = phrases.select("phrase_id", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    rarity = spots.groupBy("term").agg(F.count("*").alias("windows"))
    order = F.sort_array(F.collect_list(F.struct("windows", F.md5(F.encode("term", "UTF-8")).alias("digest"), "term")))
    best = spots.join(rarity, "term").groupBy("phrase_id").agg(F.first("terms").alias("terms"), order.alias("order"))
    return best.select("phrase_id", "terms", F.explode(F.slice("order", 1, LISTS)).alias("one")).select(
        "phrase_id", F.size("terms").alias("length"),
        (F.array_position("terms", F.col("one.term")) - 1).cast("int").alias("offset"), F.col("one.term").alias("term"),
    )


def rarest_first(chosen: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase_id, length, lists): of each window its (n, offset, term_id), the rarest first.

    ``n`` is how often the term occurs in the documents. Windows with a term that never
    does are left out.
    """
    counts = index.where("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("n"))
    spots = chosen.join(terms, "term").join(counts, "term_id", "left")
    return spots.groupBy("phrase_id", "length").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term_id"))).alias("lists"),
    ).where("lists[0].n > 0")


def _near(found: DataFrame, index: DataFrame, ranked: DataFrame, rank: int, slop: int, rows: int) -> DataFrame:
    """``found`` (doc, text_hash, phrase_id, start) met with the list of the ``rank``-th term.

    Adds ``shift``: by how much the term is off its place, ``slop`` at most either way.
    Windows of fewer terms are left out.
    """
    wanted = ranked.where(F.size("lists") > rank).select(
        "phrase_id", F.col("lists")[rank]["offset"].alias("offset"), F.col("lists")[rank]["term_id"].alias("term_id")
    )
    size = 8 * (slop + 1)
    block = lambda at: F.floor(at / size)
    places = (
        found.join(sized(wanted, rows), "phrase_id")
        .withColumn("place", F.col("start") + F.col("offset"))
        .withColumn("block", F.explode(F.sequence(block(F.col("place") - slop), block(F.col("place") + slop))))
    )
    lists = (
        index.join(sized(wanted.select("term_id").distinct(), rows), "term_id", "left_semi")
        .select("doc", "text_hash", "term_id", "at").distinct()
        .withColumn("block", block(F.col("at")))
    )
    met = places.join(lists, ["doc", "text_hash", "term_id", "block"])
    return met.where(F.abs(F.col("at") - F.col("place")) <= slop).select(
        *found.columns, (F.col("at") - F.col("place")).alias("shift")
    )


def phrase_matches(
    docs: DataFrame, index: DataFrame, ranked: DataFrame, phrases: DataFrame, rows: int, slop: int = SLOP
) -> tuple[DataFrame, DataFrame]:
    """Exact matches (doc, text_hash, phrase_id, start, stop) and proximity matches
    (doc, text_hash, phrase_id) of windows.

    Offset-adjusted lists are intersected from the rarest term on. A window is near if its
    three rarest lists (all, where it has fewer) have a place within ``slop`` words of
    where the rarest one puts it.
    """
    key = ["doc", "text_hash"]
    first = stage(
        index.join(sized(ranked.select(
            "phrase_id", "length", F.size("lists").alias("n_lists"),
            F.col("lists")[0]["offset"].alias("offset"), F.col("lists")[0]["term_id"].alias("term_id"),
        ), rows), "term_id").select(
            *key, "phrase_id", "length", "n_lists", (F.col("at") - F.col("offset")).alias("start"), "n_words"
        ).distinct(),
        "decontaminate-first",
    )
    second = stage(_near(first, index, ranked, 1, slop, rows), "decontaminate-second")
    third = _near(second.drop("shift").distinct(), index, ranked, 2, slop, rows)
    near = (
        first.where("n_lists = 1").select(*key, "phrase_id")
        .unionByName(second.where("n_lists = 2").select(*key, "phrase_id"))
        .unionByName(third.select(*key, "phrase_id")).distinct()
    )
    met = stage(
        first.where("n_lists = 1").unionByName(second.where("shift = 0").select(*first.columns))
        .where("start >= 0 and start + length <= n_words").drop("n_lists", "n_words"),
        "decontaminate-met",
    )
    # All lists of the windows, in the few documents where the rarest two meet.
    held = stage(met.where("length > 1").select(*key).distinct(), "decontaminate-held")
    doc, text_hash = document_key(docs)
    few = sized(held, held.count()).withColumnsRenamed({"doc": "h_doc", "text_hash": "h_hash"})
    texts = docs.select("doc_id", "text").join(few, (doc == few["h_doc"]) & (text_hash == few["h_hash"]), "left_semi")
    spots = phrases.select("phrase_id", F.posexplode("terms").alias("offset", "term"))
    terms = stage(
        spots.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "decontaminate-all-terms"
    )
    lists = postings(texts, terms, rows).select(*key, "at", "term_id").distinct()
    closed = (
        met.where("length > 1").join(sized(spots.join(terms, "term").drop("term"), rows), "phrase_id")
        .withColumn("at", F.col("start") + F.col("offset"))
        .join(lists, [*key, "at", "term_id"])
        .groupBy(*key, "phrase_id", "length", "start").agg(F.count("*").alias("n"))
        .where("n = length")
    )
    columns = [*key, "phrase_id", "start", (F.col("start") + F.col("length")).alias("stop")]
    exact = stage(
        met.where("length = 1").select(*columns).unionByName(closed.select(*columns)), "decontaminate-exact"
    )
    near = stage(near, "decontaminate-near")
    discard(first, second, met, held, terms)
    return exact, near


def proximity_matches(docs: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """Places where two terms stand within ``slop`` words of each other, in any order.

    ``pairs`` has (pair_id, left_term, right_term), lower-cased. Returns (pair_id, doc,
    text_hash, left_at, right_at); the lists of both terms come from one index.
    """
    terms = stage(
        pairs.select(F.explode(F.array("left_term", "right_term")).alias("term")).distinct()
        .withColumn("term_id", F.monotonically_increasing_id()), "decontaminate-terms",
    )
    rows = terms.count()
    index = stage(postings(docs, terms, rows), "decontaminate-index").select("doc", "text_hash", "at", "term_id")
    # Positions share a block of slop + 1 words or neighbour one: an equi-join, not a scan.
    block = lambda at, step: F.floor(F.col(at) / (slop + 1)) + step
    sides = pairs.join(terms.withColumnsRenamed({"term": "left_term", "term_id": "left_id"}), "left_term").join(
        terms.withColumnsRenamed({"term": "right_term", "term_id": "right_id"}), "right_term"
    ).select("pair_id", "left_id", "right_id")
    left = index.withColumnsRenamed({"term_id": "left_id", "at": "left_at"}).join(sized(sides, rows * rows), "left_id").withColumn(
        "block", F.explode(F.array(*[block("left_at", step) for step in (-1, 0, 1)]))
    )
    right = index.withColumn("block", block("at", 0)).withColumnsRenamed({"term_id": "right_id", "at": "right_at"})
    return left.join(right, ["doc", "text_hash", "block", "right_id"]).where(
        (F.abs(F.col("left_at") - F.col("right_at")) <= slop)
        & (F.col("left_at") != F.col("right_at"))
    ).select("pair_id", "doc", "text_hash", "left_at", "right_at")


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, keys: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_passages, n_near) per row.

    n_passages counts the places where a window of ``size`` words stands, n_near the windows
    with a proximity match. With ``keys`` the columns (doc, text_hash) come too.
    """
    items = stage(windows(benchmark, size), "decontaminate-windows")
    rows = items.count() * size  # no benchmark-sized table has more
    phrases = stage(
        items.select("phrase", "terms").distinct().withColumn("phrase_id", F.monotonically_increasing_id()),
        "decontaminate-phrases",
    )
    chosen = stage(chosen_terms(phrases), "decontaminate-chosen")
    terms = stage(
        chosen.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()),
        "decontaminate-terms",
    )
    index = stage(postings(docs, terms, rows), "decontaminate-index")
    ranked = stage(rarest_first(chosen, terms, index), "decontaminate-ranked")
    matches, near = phrase_matches(docs, index, ranked, phrases, rows, slop)
    own = stage(
        index.where("term_id < 0").select(
            F.when(F.col("term_id") == WHOLE, F.col("doc")).alias("doc_id"), "doc", "text_hash", "n_words"
        ), "decontaminate-own",
    )
    discard(index, terms, chosen, ranked)

    key = ["doc", "text_hash"]
    spans = matches.groupBy(*key).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.count_distinct(F.when(F.col("stop") - F.col("start") == size, F.col("start"))).alias("n_passages"),
    )
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["reach"], s["stop"]).alias("reach"),
            (acc["n"] + F.greatest(s["stop"] - F.greatest(acc["reach"], s["start"]), F.lit(0)))
            .cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )
    found_items = (
        matches.select(*key, "phrase_id").distinct()
        .join(sized(phrases.select("phrase", "phrase_id"), rows), "phrase_id")
        .join(sized(items.select("item_id", "phrase"), rows), "phrase")
        .groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    )
    joined = (
        own.join(spans.select(*key, union.alias("n_hit"), "n_passages"), key, "left")
        .join(found_items, key, "left")
        .join(near.groupBy(*key).agg(F.count("*").alias("n_near")), key, "left")
    )
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", *(key if keys else []), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_passages", zero).alias("n_passages"), F.coalesce("n_near", zero).alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without rows that hold a passage of the benchmark.

    A row goes if a window of ``size`` words stands anywhere in it, however long the rest,
    or if it is contaminated by the words hit (shorter items count in this way only, as a
    word or two may stand in any text). Rows with the same id and text go together.
    """
    found = contamination(docs, benchmark, size, keys=True).where("contaminated or n_passages > 0")
    bad = stage(found.select("doc", "text_hash").distinct(), "decontaminate-bad")
    doc, text_hash = document_key(docs)
    return docs.join(bad, (doc == bad["doc"]) & (text_hash == bad["text_hash"]), "left_anti")


#: Contamination as DuckDB states it, by comparing windows directly.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(w[s:s + {WINDOW - 1}]) AS n,
    array_to_string(w[s:s + {WINDOW - 1}], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw USING (phrase)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
passages AS (SELECT doc_id, count(DISTINCT s) AS n_passages FROM hit WHERE n = {WINDOW} GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM d),
spots AS (
  SELECT phrase, n, unnest(string_split(phrase, ' ')) AS term, generate_subscripts(string_split(phrase, ' '), 1) AS offs
  FROM (SELECT DISTINCT phrase, n FROM bw)),
first AS (SELECT phrase, n, term, min(offs) AS offs FROM spots GROUP BY ALL),
chosen AS (
  SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY phrase ORDER BY windows, md5(term)) AS choice
    FROM first f JOIN (SELECT term, count(*) AS windows FROM first GROUP BY term) USING (term)) WHERE choice <= {LISTS}),
spot AS (
  SELECT phrase, term, offs, n, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(times, 0), offs) AS rank,
    min(coalesce(times, 0)) OVER (PARTITION BY phrase) AS least, count(*) OVER (PARTITION BY phrase) AS lists
  FROM chosen LEFT JOIN (SELECT term, count(*) AS times FROM tok GROUP BY term) USING (term)),
n1 AS (SELECT DISTINCT doc_id, phrase, lists, place - offs AS start FROM tok JOIN spot USING (term) WHERE rank = 1 AND least > 0),
n2 AS (SELECT DISTINCT n1.* FROM n1 JOIN spot ON spot.phrase = n1.phrase AND rank = 2
  JOIN tok ON tok.doc_id = n1.doc_id AND tok.term = spot.term AND abs(place - start - offs) <= {SLOP}),
n3 AS (SELECT DISTINCT n2.* FROM n2 JOIN spot ON spot.phrase = n2.phrase AND rank = 3
  JOIN tok ON tok.doc_id = n2.doc_id AND tok.term = spot.term AND abs(place - start - offs) <= {SLOP}),
near AS (SELECT doc_id, count(DISTINCT phrase) AS n_near FROM (
  SELECT * FROM n1 WHERE lists = 1 UNION ALL SELECT * FROM n2 WHERE lists = 2 UNION ALL SELECT * FROM n3) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
  CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN passages USING (doc_id) LEFT JOIN near USING (doc_id)
"""
