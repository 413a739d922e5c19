"""Pattern packing of token sequences by non-negative least squares.

Texts are tokenised once, in the executors; only (doc_id, piece, length) rows
travel. Full pieces are sequences of their own. The lengths of the others form a
histogram of under ``max_len`` bins, which is all that reaches the driver. Patterns of
two to three lengths that fill a sequence exactly are enumerated on a coarse grid, their
repeat counts are fitted to the histogram by non-negative least squares, to convergence
whatever the size of the histogram, and rounded down, and what is left is packed by best
fit over the exact histogram. The plan is a table of (length, range of ranks, sequence,
offset) whose size depends on ``max_len`` alone, so it may be broadcast. Every piece finds
its place by its rank among the pieces of its length; ranks come from counts of as many
salted groups as a length needs, so no length, however common, meets in one task.

Defined results: a null text is an empty one and yields the single end token;
a text of n ids (end token included) yields ceil(n / max_len) pieces; repeated
rows are packed each on their own, as are ties in length, in any order; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anvaya.llm.common import stage

MAX_LEN = 4096
END_ID = 1
SALT_ROWS, MOST_SALTS = 1000, 200_000
GRID = 96
CACHE_ENTRIES = 300_000
#: How the public vocabulary file splits a lower-cased text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """The public word-end BPE vocabulary, with a cache of whole chunks.

    Word ends are written as a space after each word, a byte that no word
    holds, so that a plain rank-ordered byte BPE gives the vocabulary's ids.
    """

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte_of = self._alphabet()
        ranks = {}
        for token, rank in vocab.items():
            end = token.endswith("</w>")
            body = token[:-4] if end else token
            if all(c in byte_of for c in body) and not token.startswith("<|"):
                ranks[bytes(byte_of[c] for c in body) + b" " * end] = rank
        self._bpe = tiktoken.Encoding(
            "word", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}
        )
        self._pieces = regex.compile(PIECES)
        self._whole = Tokenizer.from_file(path)
        # White space here, but not to the vocabulary; and strings that are one id wherever they stand.
        self._odd = regex.compile("[\x1c-\x1f]")
        self._added = [token.content.lower() for token in self._whole.get_added_tokens_decoder().values()]
        self._cache: dict[str, bytes] = {}

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """Printable stand-ins of the 256 bytes, as byte-level vocabularies write them."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {chr(b): b for b in shown}
        for n, b in enumerate(b for b in range(256) if b not in set(shown)):
            table[chr(256 + n)] = b
        return table

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        low = text.lower()
        if self._odd.search(text) or any(token in low for token in self._added):
            return self._by_library(text)
        if not unicodedata.is_normalized("NFC", text):
            low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        elif "Σ" in text:
            low = text.replace("Σ", "σ").lower()
        chunks = low.split()
        cache = self._cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for chunk in set(chunks).difference(cache):
            if not chunk.isascii() and any(unicodedata.category(c) == "Cn" for c in chunk):
                # Letters that this Unicode table does not know yet, but another may.
                cache[chunk] = self._by_library(chunk)
                continue
            words = " ".join(self._pieces.findall(chunk)) + " "
            cache[chunk] = np.array(self._bpe.encode_ordinary(words), dtype="<u4").tobytes()
        return b"".join(map(cache.__getitem__, chunks))

    def _by_library(self, text: str) -> bytes:
        found = self._whole.encode(text, add_special_tokens=False).ids
        return np.array(found, dtype="<u4").tobytes()


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): texts cut into pieces."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = bpe.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(data), 4 * max_len)):
                    part = data[at : at + 4 * max_len]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by the active-set method, with normal equations.

    Goes on until no variable at zero would lower the residual, that is, until it has
    converged: every round lowers it, so no set of active variables comes twice.
    """
    gram, target = a.T @ a, a.T @ b
    n = a.shape[1]
    x = np.zeros(n)
    active = np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0.0)))
    barred = np.zeros(n, dtype=bool)  # entered and left again without lowering the residual
    least = float(b @ b)
    while True:
        gradient = np.where(active | barred, -np.inf, target - gram @ x)
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            return x
        active[best] = True
        while active.any():
            at = np.flatnonzero(active)
            solved = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[at] = solved
                break
            low = solved <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - solved[low], 1e-300))
            x[at] += step * (solved - x[at])
            drop = at[low & (x[at] <= 1e-12)]
            if not len(drop):
                drop = at[low][:1]
            x[drop] = 0
            active[drop] = False
        residual = float(np.sum((a @ x - b) ** 2))
        if residual < least * (1 - 1e-12):
            least = residual
            barred[:] = False
        else:
            barred[best] = True


def patterns(grid: int) -> list[tuple[int, ...]]:
    """Two or three grid lengths, in falling order, that sum to ``grid``."""
    found = [(a, grid - a) for a in range(grid - 1, (grid - 1) // 2, -1)]
    for a in range(grid - 2, 0, -1):
        for b in range(min(a, grid - a - 1), 0, -1):
            if 1 <= grid - a - b <= b:
                found.append((a, b, grid - a - b))
    return found


def plan(histogram: dict[int, int], max_len: int = MAX_LEN, grid: int = GRID) -> pd.DataFrame:
    """Places for all pieces: (length, first, last, sequence, offset).

    Ranks first to last - 1 of a length go to sequences ``sequence``,
    ``sequence`` + 1 and so on, at ``offset`` in each. Full pieces fill a sequence each and
    have no place here.
    """
    left = np.zeros(max_len + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    used = np.zeros(max_len + 1, dtype=np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def place(lengths: list[int], count: int) -> None:
        nonlocal sequence
        offset = 0
        for length in lengths:
            rows.append((length, int(used[length]), int(used[length]) + count, sequence, offset))
            used[length] += count
            left[length] -= count
            offset += length
        sequence += count

    def best_fit(room: int) -> list[int]:
        """Lengths that fill ``room`` best: the longest that fits, again and again."""
        chosen: list[int] = []
        taken: dict[int, int] = {}
        while room > 0:
            fits = np.flatnonzero(left[1 : room + 1] > 0) + 1
            at = len(fits) - 1
            while at >= 0 and left[fits[at]] <= taken.get(int(fits[at]), 0):
                at -= 1
            if at < 0:
                break
            length = int(fits[at])
            chosen.append(length)
            taken[length] = taken.get(length, 0) + 1
            room -= length
        return chosen

    # A length counts on the grid as its share rounded up, so that a pattern that is
    # full on the grid always fits.
    share = np.ceil(np.arange(max_len + 1) * grid / max_len).astype(int)
    coarse = np.bincount(share[1:], weights=left[1:], minlength=grid + 1)[1:grid]
    shapes = patterns(grid)
    if coarse.any():
        a = np.zeros((grid - 1, len(shapes)))
        for j, shape in enumerate(shapes):
            for part in shape:
                a[part - 1, j] += 1
        repeats = np.floor(nnls(a, coarse)).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable").tolist():
            wanted = int(repeats[j])
            while wanted > 0:
                chosen: list[int] = []
                spare = max_len
                for k, part in enumerate(shapes[j]):
                    later = sum(shapes[j][k + 1 :])
                    top = min(spare - (later * max_len) // grid, (part * max_len) // grid)
                    low = ((part - 1) * max_len) // grid + 1
                    have = [
                        n for n in range(top, low - 1, -1) if left[n] > chosen.count(n)
                    ]
                    if not have:
                        break
                    chosen.append(have[0])
                    spare -= have[0]
                if len(chosen) < len(shapes[j]):
                    break
                # Rounding up leaves a little room; short pieces may fill it.
                for length in chosen:
                    left[length] -= 1
                extra = best_fit(spare)
                for length in chosen:
                    left[length] += 1
                chosen += extra
                count = min(wanted, *(int(left[n]) // chosen.count(n) for n in chosen))
                place(chosen, count)
                wanted -= count

    for length in range(max_len - 1, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            rest = best_fit(max_len - length)
            left[length] += 1
            chosen = [length, *rest]
            count = min(int(left[n]) // chosen.count(n) for n in chosen)
            place(chosen, count)
    return pd.DataFrame(rows, columns=["length", "first", "last", "sequence", "offset"])


def pack(
    docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, salt_rows: int = SALT_ROWS
) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    ``salt_rows``: about so many pieces of one length are ranked together, more only where
    there would be over ``MOST_SALTS`` groups.
    """
    from pyspark.sql import Window

    cut = stage(
        pieces(docs, tokenizer_path, max_len).withColumn("uid", F.monotonically_increasing_id()), "packing-pieces"
    )
    histogram = {  # at most max_len rows
        r["length"]: r["n"]
        for r in cut.where(F.col("length") < max_len).groupBy("length").agg(F.count("*").alias("n")).collect()
    }
    spark = docs.sparkSession
    places = plan(histogram, max_len)
    salt_rows = max(salt_rows, -(-sum(histogram.values()) // MOST_SALTS))
    salts = spark.createDataFrame(
        [(length, -(-n // salt_rows)) for length, n in histogram.items()], "length long, salts long"
    )
    salted = (
        cut.where(F.col("length") < max_len).join(F.broadcast(salts), "length")  # at most max_len rows
        .withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts"))).drop("salts")
    )
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn(
        "before",
        F.coalesce(F.sum("n").over(
            Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        ), F.lit(0)),
    ).select("length", "salt", "before")
    own = Window.partitionBy("length", "salt").orderBy("uid")
    ranked = (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(F.broadcast(before), ["length", "salt"])  # at most MOST_SALTS + max_len rows
        .withColumn("rank", F.col("before") + F.col("own"))
        .drop("before", "own", "salt", "uid")
    )
    full = cut.where(F.col("length") == max_len).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    by_length = {
        int(length): tuple(part[c].to_numpy() for c in ("first", "sequence", "offset"))
        for length, part in places.sort_values("first").groupby("length")
    }
    shared = spark.sparkContext.broadcast(by_length)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence = np.zeros(len(lengths), dtype=np.int64)
            offset = np.zeros(len(lengths), dtype=np.int64)
            for length in np.unique(lengths).tolist():
                mine = lengths == length
                first, base, at = table[length]
                k = np.searchsorted(first, ranks[mine], side="right") - 1
                sequence[mine] = base[k] + ranks[mine] - first[k]
                offset[mine] = at[k]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=[
                    "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                ],
            )

    return ranked.mapInArrow(
        assign,
        "doc_id long, piece int, start long, length long, ids_crc32 long,"
        " sequence_id long, offset long",
    ).unionByName(full)
