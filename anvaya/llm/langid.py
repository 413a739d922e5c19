"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of one fixed public
vocabulary. A word, with the word mark in front, may be cut into pieces in many ways;
its probability is the sum over all of them, found by the forward algorithm.
A text's score is the sum of its words' log probabilities, and the prediction
is the language with the largest. Probabilities are learned by expectation
maximisation (forward-backward counts) on word counts of a bounded sample of
about ``docs_per_lang`` documents a language, chosen by the hash of doc_id
among those whose crc32(doc_id) mod 5 is not 0. Every text is scored whole.

Letters that are no piece count with one fixed small probability in every
language. Runs of letters, with their combining marks, are words whatever their length.
The score is the posterior probability of the language if all languages are as likely and
words independent, so it is close to 1 for most long texts and says little about doubt.

Defined results: a null text, or one without a letter, is ``und`` with score
0, as is every text if there is nothing to learn from; equal scores go to the
language that sorts first; a null doc_id is neither held out nor learned from;
rows with a null lang are scored, not learned from; repeated rows repeat their
result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCS_PER_LANG = 500
#: Languages beyond the most frequent ones are not learned.
MOST_LANGS = 1000
#: Up to so many letters words are scored together; and how much of a long one is held at once.
BATCHED, PART = 24, 65_536
ROUNDS = 3
UNKNOWN = 1e-7
SMOOTHING = 0.02
CACHE_WORDS = 400_000
UNDETERMINED = "und"
MARK = "▁"
_BASE = np.uint64(1_000_003)


def _character_class(*categories: str) -> str:
    """The code points of Unicode categories, as ranges for a pattern."""
    ranges: list[list[int]] = []
    for n in range(sys.maxunicode + 1):
        if unicodedata.category(chr(n))[0] in categories:
            if ranges and ranges[-1][1] == n - 1:
                ranges[-1][1] = n
            else:
                ranges.append([n, n])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


#: A letter and what follows of letters and their marks.
LETTERS = re.compile(f"[{_character_class('L')}][{_character_class('L', 'M')}]*")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters with their marks, of any length."""
    return LETTERS.findall(text.lower())


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by length: sorted hashes and their piece numbers."""

    size: int
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def load(path: str) -> "Vocabulary":
        """The letter pieces of a public sentence-piece file, in lower case."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = set()
        for n in range(model.get_piece_size()):
            if model.is_control(n) or model.is_unknown(n) or model.is_byte(n):
                continue
            piece = model.id_to_piece(n).lower()
            body = piece.removeprefix(MARK)
            if piece and (not body or LETTERS.fullmatch(body)):
                pieces.add(piece)
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        order = sorted(pieces)
        for length in sorted({len(p) for p in order}):
            numbers = np.array([n for n, p in enumerate(order) if len(p) == length])
            codes = np.array(
                [[ord(c) for c in order[n]] for n in numbers.tolist()], dtype=np.uint64
            )
            hashes = np.zeros(len(numbers), dtype=np.uint64)
            for column in codes.T:
                hashes = hashes * _BASE + column
            rank = np.argsort(hashes)
            by_length[length] = hashes[rank], numbers[rank]
        return Vocabulary(len(order), by_length)


@dataclass
class Arcs:
    """All pieces found in words of one length: per end position, (word, start, piece)."""

    length: int
    words: np.ndarray
    ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def lattices(words: list[str], vocabulary: Vocabulary) -> list[Arcs]:
    """The segmentation lattices of words, grouped by length.

    The unknown letter is piece number ``vocabulary.size``; it spans a letter
    that is no piece on its own, so every word has a segmentation.
    """
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    found = []
    for length in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == length)
        joined = "".join(MARK + words[k] for k in own.tolist())
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        codes = codes.reshape(len(own), length).astype(np.uint64)
        parts: list[list[tuple[np.ndarray, int, np.ndarray]]] = [[] for _ in range(length + 1)]
        hashes = np.zeros_like(codes)
        for size in range(1, min(length, max(vocabulary.by_length)) + 1):
            last = length - size + 1
            hashes = hashes[:, :last] * _BASE + codes[:, size - 1 :]
            known = vocabulary.by_length.get(size)
            if known is None:
                continue
            table, numbers = known
            at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
            hit = table[at] == hashes
            for start in range(last):
                rows = np.flatnonzero(hit[:, start])
                if len(rows):
                    parts[start + size].append((rows, start, numbers[at[rows, start]]))
            if size == 1:
                for start in range(last):
                    rows = np.flatnonzero(~hit[:, start])
                    if len(rows):
                        unknown = np.full(len(rows), vocabulary.size)
                        parts[start + 1].append((rows, start, unknown))
        ends = []
        for arcs in parts[1:]:
            ends.append((
                np.concatenate([rows for rows, _, _ in arcs]),
                np.concatenate([np.full(len(rows), start) for rows, start, _ in arcs]),
                np.concatenate([pieces for _, _, pieces in arcs]),
            ))
        found.append(Arcs(length, own, ends))
    return found


def forward(arcs: Arcs, p: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]: mass of all segmentations up to a position."""
    alpha = np.zeros((arcs.length + 1, len(arcs.words), p.shape[1]))
    alpha[0] = 1
    for end, (rows, starts, pieces) in enumerate(arcs.ends, 1):
        mass = alpha[starts, rows] * p[pieces]
        for k in range(p.shape[1]):
            alpha[end, :, k] = np.bincount(rows, weights=mass[:, k], minlength=len(arcs.words))
    return alpha


def long_arcs(word: str, vocabulary: Vocabulary) -> list[list[tuple[int, int]]]:
    """For each end position in a word of any length the (start, piece) that end there."""
    codes = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    arcs: list[list[tuple[int, int]]] = [[] for _ in range(len(codes) + 1)]
    hashes = np.zeros(len(codes), np.uint64)
    for size in range(1, min(len(codes), max(vocabulary.by_length)) + 1):
        hashes = hashes[: len(codes) - size + 1] * _BASE + codes[size - 1 :]
        if (known := vocabulary.by_length.get(size)) is None:
            continue
        table, numbers = known
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        hit = table[at] == hashes
        for start in np.flatnonzero(hit).tolist():
            arcs[start + size].append((start, int(numbers[at[start]])))
        if size == 1:
            for start in np.flatnonzero(~hit).tolist():
                arcs[start + 1].append((start, vocabulary.size))
    return arcs


def long_forward(arcs: list[list[tuple[int, int]]], logs: np.ndarray) -> np.ndarray:
    """[position, language] log mass of all segmentations up to a position; never underflows."""
    alpha = np.zeros((len(arcs), logs.shape[1]))
    for end in range(1, len(arcs)):
        starts, pieces = zip(*arcs[end])
        alpha[end] = np.logaddexp.reduce(alpha[list(starts)] + logs[list(pieces)], axis=0)
    return alpha


def long_expected(arcs: list[list[tuple[int, int]]], logs: np.ndarray, counts: np.ndarray, expected: np.ndarray) -> None:
    """Add the expected piece counts of one long word that occurs ``counts`` times a language."""
    alpha = long_forward(arcs, logs)
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0
    for end in range(len(arcs) - 1, 0, -1):
        starts, pieces = (list(x) for x in zip(*arcs[end]))
        out = beta[end] + logs[pieces]
        expected_here = np.exp(alpha[starts] + out - alpha[-1]) * counts
        np.add.at(expected, pieces, expected_here)
        for start, value in zip(starts, out):
            beta[start] = np.logaddexp(beta[start], value)


def log_probabilities(words: list[str], vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """[word, language] log probabilities, all segmentations summed.

    Words up to ``BATCHED`` letters go together by length; longer ones one by one, in logs.
    """
    out = np.zeros((len(words), p.shape[1]))
    short = [n for n, w in enumerate(words) if len(w) <= BATCHED]
    for arcs in lattices([words[n] for n in short], vocabulary):
        out[np.array(short)[arcs.words]] = np.log(forward(arcs, p)[-1])
    logs = np.log(p)
    for n, word in enumerate(words):
        if len(word) > BATCHED:
            out[n] = long_log_probability(word, vocabulary, logs)
    return out


def long_log_probability(word: str, vocabulary: Vocabulary, logs: np.ndarray) -> np.ndarray:
    """Log probabilities of a word of any length, read in parts that overlap by a piece."""
    most = max(vocabulary.by_length)
    text = MARK + word
    tail = np.zeros((1, logs.shape[1]))  # log mass at the last positions so far
    done = 0
    while done < len(text):
        stop = min(len(text), done + PART)
        first = max(0, done - most)
        arcs = long_arcs(text[first + 1 : stop] if first == 0 else text[first:stop], vocabulary)
        if first:
            arcs = [[(a - 1, piece) for a, piece in own if a > 0] for own in arcs[1:]]  # without the mark put in front
        alpha = np.full((stop - first + 1, logs.shape[1]), -np.inf)
        alpha[: len(tail)] = tail
        for end in range(done - first + 1, stop - first + 1):
            starts, pieces = zip(*arcs[end])
            alpha[end] = np.logaddexp.reduce(alpha[list(starts)] + logs[list(pieces)], axis=0)
        done = stop
        tail = alpha[-min(most + 1, stop + 1) :]
    return tail[-1]


def learn(
    words: list[str], counts: np.ndarray, vocabulary: Vocabulary, rounds: int = ROUNDS
) -> np.ndarray:
    """Piece probabilities [piece, language] from word counts [word, language]."""
    n_langs = counts.shape[1]
    p = np.full((vocabulary.size + 1, n_langs), 1.0 / max(1, vocabulary.size))
    p[-1] = UNKNOWN
    short = np.array([n for n, w in enumerate(words) if len(w) <= BATCHED], dtype=np.int64)
    graph = lattices([words[n] for n in short.tolist()], vocabulary)
    long = [(long_arcs(w, vocabulary), counts[n]) for n, w in enumerate(words) if len(w) > BATCHED]
    for _ in range(rounds):
        expected = np.zeros_like(p)
        for arcs in graph:
            alpha = forward(arcs, p)
            beta = np.zeros_like(alpha)
            beta[-1] = counts[short[arcs.words]] / alpha[-1]
            for end in range(arcs.length, 0, -1):
                rows, starts, pieces = arcs.ends[end - 1]
                out = beta[end, rows] * p[pieces]
                np.add.at(beta, (starts, rows), out)
                use = out * alpha[starts, rows]
                for k in range(n_langs):
                    expected[:, k] += np.bincount(pieces, weights=use[:, k], minlength=len(p))
        logs = np.log(p)
        for arcs, own in long:
            long_expected(arcs, logs, own, expected)
        expected = expected[:-1] + SMOOTHING
        p[:-1] = expected / expected.sum(0)
        p[-1] = UNKNOWN
    return p


def training_counts(docs: DataFrame, docs_per_lang: int) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, words, and counts [word, language] of the bounded sample."""
    usable = docs.select("doc_id", "text", "lang").where(
        "lang is not null and text is not null and crc32(cast(doc_id as string)) % 5 <> 0"
    )
    counted = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    totals = {r["lang"]: r["n"] for r in counted.collect()}
    if not totals:
        return [], [], np.zeros((0, 0))
    langs = sorted(totals)
    bound = F.create_map(*[
        F.lit(x) for lang in langs
        for x in (lang, int(min(1.0, docs_per_lang / totals[lang]) * 1_000_000))
    ])
    sample = usable.where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < bound[F.col("lang")]
    ).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by_lang.setdefault(lang, Counter()).update(words_of(text.as_py()))
            rows = [(lang, w, n) for lang, c in by_lang.items() for w, n in c.items()]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))],
                names=["lang", "word", "n"],
            )

    rows = (
        sample.mapInArrow(run, "lang string, word string, n long")
        .groupBy("word", "lang").agg(F.sum("n").alias("n")).toArrow()
    )
    words, at = np.unique(np.array(rows.column("word").to_pylist(), dtype=object), return_inverse=True)
    place = {lang: k for k, lang in enumerate(langs)}
    counts = np.zeros((len(words), len(langs)))
    counts[at, [place[lang] for lang in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    return langs, words.tolist(), counts


class Scorer:
    """Log probabilities of words, with those of recent words at hand."""

    def __init__(self, vocabulary: Vocabulary, p: np.ndarray) -> None:
        self.vocabulary, self.p = vocabulary, p
        self._place: dict[str, int] = {}
        self._known = np.zeros((0, p.shape[1]))

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """[text, language] sums over the words of each text."""
        if len(self._place) > CACHE_WORDS:
            self._place, self._known = {}, self._known[:0]
        distinct = set().union(*texts)
        long = {w: n for n, w in enumerate(sorted(w for w in distinct if len(w) > BATCHED))}  # not worth keeping
        scores = log_probabilities(list(long), self.vocabulary, self.p)
        fresh = sorted(distinct.difference(self._place).difference(long))
        parts = [self._known]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            parts.append(log_probabilities(part, self.vocabulary, self.p))
        self._known = np.concatenate(parts)
        self._place.update(zip(fresh, range(len(self._place), len(self._known))))
        out = np.zeros((len(texts), self.p.shape[1]))
        for n, words in enumerate(texts):
            if long:
                for word in words:
                    if word in long:
                        out[n] += scores[long[word]]
                words = [w for w in words if w not in long]
            if words:
                at = np.fromiter(map(self._place.__getitem__, words), np.int64, len(words))
                out[n] += self._known[at].sum(0)
        return out


def identify(
    docs: DataFrame, vocabulary_path: str, docs_per_lang: int = DOCS_PER_LANG
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    langs, words, counts = training_counts(docs, docs_per_lang)
    vocabulary = Vocabulary.load(vocabulary_path)
    p = learn(words, counts, vocabulary) if langs else None
    shared = docs.sparkSession.sparkContext.broadcast((langs, vocabulary, p))  # vocabulary-sized

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, vocabulary, p = shared.value
        scorer = Scorer(vocabulary, p) if langs else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [words_of(t.as_py() or "") for t in part.column(1)]
                names: list[str] = [UNDETERMINED] * len(texts)
                scores = np.zeros(len(texts))
                if scorer is not None:
                    logs = scorer.texts(texts)
                    best = logs.argmax(1)
                    share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                    for n, found in enumerate(texts):
                        if found:
                            names[n], scores[n] = langs[best[n]], share[n]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores)],
                    names=["doc_id", "lang_pred", "score"],
                )

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
