"""Quality by ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 poor, 2 good. One weight vector over hashed text
features is shared by all thresholds, P(grade <= k) = logistic(theta_k - w.x)
with theta_0 < theta_1, so a text gets an expected grade and the tail
probabilities P(grade >= 1) and P(grade >= 2). A text is kept when it is more
likely than not to be of a good grade.

Features of a text, hashed to ``bins`` places: its distinct words, the distinct
openings of its words, and steps of four shares (upper-case words, words that
end in a symbol, lone symbols, repeats). Features are screened by the score
test of the two cuts before the fit: one that is rare among the rated texts, or
whose rate does not differ between grades by ``SCREEN`` standard errors, has
weight zero, so that chance words of long texts decide nothing.

The fit uses at most about ``fit_rows`` rated documents, chosen by the hash of
doc_id, at most twice as many if rows share an id; only their feature numbers reach
the driver. Every document is scored, whole.

Defined results: a null or text without a word has only its bands and is scored
like any other; a tail probability of exactly ``KEEP_AT`` keeps a text; ratings with a null quality and a toxic value other than 1 are
left out; a document with several ratings counts once for each; repeated rows repeat their
result; without ratings every text has tail probabilities 1 and is kept; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anvaya.llm.common import free_names

FIT_ROWS = 8000
BINS = 1 << 18
OPENINGS = (4, 5)
ROUNDS = 150
SCALE = 0.3
LEAST_TEXTS = 12
SCREEN = 6.0
KEEP_AT = 0.5
CACHE_ENTRIES = 150_000
_CORE = re.compile(r"[^\W_]+")
_STEPS = np.array([0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])


class Features:
    """Hashed features of texts; keeps what it has found for recent tokens."""

    def __init__(self, bins: int) -> None:
        self.bins = bins
        self._cache: dict[str, tuple[tuple[int, ...], int]] = {}

    def _hash(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.bins

    def _token(self, token: str) -> tuple[tuple[int, ...], int]:
        """Feature numbers and flags (1 upper case, 2 symbol at the end, 4 no word)."""
        words = _CORE.findall(token.lower())
        found = []
        for word in words:
            found.append(self._hash("w " + word))
            for size in OPENINGS:
                if len(word) > size:
                    found.append(self._hash("o " + word[:size]))
        upper = len(token) > 1 and token.isupper()
        symbol = bool(words) and not token[-1].isalnum() and token[-1] not in ".,;:?)\"'"
        return tuple(found), upper + 2 * symbol + 4 * (not words)

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct feature numbers of a text."""
        tokens = (text or "").split()
        cache = self._cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        distinct = set(tokens)
        for token in distinct.difference(cache):
            cache[token] = self._token(token)
        found: set[int] = set()
        flags = [0] * 8
        for token in distinct:
            numbers, flag = cache[token]
            found.update(numbers)
            flags[flag] += 1
        n = max(1, len(distinct))
        shares = (
            (flags[1] + flags[3] + flags[5]) / n, (flags[2] + flags[3]) / n,
            (flags[4] + flags[5]) / n, 1 - len(distinct) / max(1, len(tokens)),
        )
        for name, share in zip("usar", shares):
            passed = int(np.searchsorted(_STEPS, share, side="right"))
            found.update(self._hash(f"# {name}{step}") for step in range(passed + 1))
        return np.fromiter(found, dtype=np.int32, count=len(found))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: tuple[float, float]
    scale: float

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum()) * self.scale


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def screen(index: np.ndarray, owner: np.ndarray, grades: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Features whose rate differs between grades beyond chance."""
    seen = np.bincount(index, weights=weight[owner], minlength=bins)
    total = weight.sum()
    strong = np.zeros(bins, dtype=bool)
    for cut in (grades == 0, grades == 1, grades == 2):
        rate = (cut * weight).sum() / total
        if 0 < rate < 1:
            excess = np.bincount(index, weights=((cut - rate) * weight)[owner], minlength=bins)
            spread = np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
            strong |= np.abs(excess) >= SCREEN * spread
    return strong & (seen >= min(LEAST_TEXTS, max(1, total // 50)))


def slopes(x: np.ndarray, grades: np.ndarray, theta: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the loss, the sum of -share * log P(grade): by each x, by each threshold, and itself.

    P(grade = k) = logistic(theta_k - x) - logistic(theta_(k-1) - x).
    """
    upper = np.where(grades == 2, 1.0, _logistic(theta[np.minimum(grades, 1)] - x))
    lower = np.where(grades == 0, 0.0, _logistic(theta[np.maximum(grades - 1, 0)] - x))
    p = np.maximum(upper - lower, 1e-9)
    up, down = share * upper * (1 - upper) / p, share * lower * (1 - lower) / p
    by_theta = np.array([
        down[grades == 1].sum() - up[grades == 0].sum(),
        down[grades == 2].sum() - up[grades == 1].sum(),
    ])
    return up - down, by_theta, float(-(share * np.log(p)).sum())


def fit(
    rows: list[np.ndarray], grades: np.ndarray, bins: int, rounds: int = ROUNDS,
    weight: np.ndarray | None = None,
) -> Model:
    """Penalised maximum likelihood of the cumulative-link model, by adaptive gradient steps.

    ``weight`` says how often each rated text counts.
    """
    weights = np.zeros(bins)
    if not len(grades):
        return Model(weights.astype(np.float32), (-40.0, -40.0), SCALE)
    weight = np.ones(len(grades)) if weight is None else weight.astype(float)
    n = weight.sum()
    present = np.bincount(grades, weights=weight, minlength=3)
    low = np.clip(present[0] / n, 0.5 / n, 0.5)
    mid = np.clip((present[0] + present[1]) / n, low + 0.25 / n, 1 - 0.25 / n)
    theta = np.log([low / (1 - low), mid / (1 - mid)])
    index = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    kept = screen(index, owner, grades, weight, bins)[index]
    index, owner = index[kept], owner[kept]
    share = weight * np.sqrt(n / (3 * np.maximum(1, present)))[grades]
    square, theta_square = np.full(bins, 1e-10), np.full(2, 1e-10)
    for step in range(rounds):
        x = np.bincount(owner, weights=weights[index], minlength=len(rows)) * SCALE
        by_x, by_theta, _ = slopes(x, grades, theta, share)
        by_theta /= n
        gradient = np.bincount(index, weights=by_x[owner], minlength=bins) * SCALE / n
        gradient += 1e-5 * weights
        square += gradient**2
        theta_square += by_theta**2
        rate = 0.5 / np.sqrt(1 + step / 20)
        weights -= rate * gradient / np.sqrt(square)
        theta -= 0.2 * rate * by_theta / np.sqrt(theta_square)
        theta[1] = max(theta[1], theta[0] + 1e-3)
    return Model(weights.astype(np.float32), (float(theta[0]), float(theta[1])), SCALE)


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 toxic, 1 poor, 2 good; null where the rating says nothing."""
    return (
        F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)
    )


def train(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, bins: int = BINS
) -> Model:
    """The model of a bounded sample of the rated documents."""
    ratings = labels.select(F.col("doc_id").cast("long"), grade_of().cast("int").alias("grade")).where(
        "doc_id is not null and grade is not null"
    ).groupBy("doc_id", "grade").agg(F.count("*").alias("times"))
    total = ratings.agg(F.count_distinct("doc_id")).first()[0]
    share = min(1.0, fit_rows / max(1, total))
    chosen = ratings.where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    )
    # About fit_rows ids of at most three grades each, whatever the size of the tables.
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(
        F.broadcast(chosen), "doc_id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bins)
        for batch in batches:
            found = [features.of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), batch.column("times"),
                 pa.array([np.sort(f) for f in found], pa.list_(pa.int32()))],
                names=["doc_id", "grade", "times", "features"],
            )

    # Rows that share an id may be many: equal ones are one with a weight, and of different
    # ones the first 2 * fit_rows by hash are enough.
    rows = joined.select("doc_id", "grade", "times", "text").mapInArrow(
        run, "doc_id long, grade int, times long, features array<int>"
    ).groupBy("doc_id", "grade", "features").agg(F.sum("times").alias("times")).orderBy(
        F.xxhash64("doc_id", "grade", "features"), "doc_id", "grade"
    ).limit(2 * fit_rows).toArrow()
    lists = [np.asarray(x.values, dtype=np.int32) for x in rows.column("features")]
    return fit(lists, rows.column("grade").to_numpy(), bins, weight=rows.column("times").to_numpy())


def rated(docs: DataFrame, model: Model, name: str, bins: int = BINS, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` and a column ``name`` of (expected_grade, p_poor_up, p_good, keep)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``bins`` numbers

    @F.pandas_udf("expected_grade double, p_poor_up double, p_good double, keep boolean")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        features = Features(bins)
        for texts in batches:
            x = np.array([model.score(features.of(t)) for t in texts], dtype=float)
            tail = [_logistic(x - t) for t in model.thresholds]
            yield pd.DataFrame({
                "expected_grade": tail[0] + tail[1], "p_poor_up": tail[0], "p_good": tail[1],
                "keep": tail[1] >= keep_at,
            })

    return docs.withColumn(name, rate("text"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model keeps; no column of theirs is touched."""
    (name,) = free_names(docs, "rated")
    return rated(docs, model, name).where(F.col(name)["keep"]).drop(name)


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, expected_grade, p_poor_up, p_good, keep) of every row of ``docs``."""
    model = train(docs, labels, fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rated(rows, model, "rated").select("doc_id", "rated.*")
