"""Near-duplicate vectors by iterative quantisation.

Rotations that balance the bits of binary codes are learned on a bounded
sample. Codes are cut into substrings, each the key of one Hamming table
(multi-index hashing): two vectors whose codes agree in any substring meet. The
original vectors travel with the keys, so a bucket reranks its candidates by
the exact cosine in double precision and emits, for each vector, how many
others it links to, plus a spanning forest of the links. A pair that meets in
several tables is counted in the first only.

Width and number of the tables follow from the number of vectors (``table_sizes``), so that
buckets do not fill up as it grows, and a pair at the threshold is missed with a probability
of about ``MISSED``; closer pairs far less often. Measured recall is in the README.

Buckets of any size are whole: one with more than ``TILE_ROWS`` rows is cut into
tiles and all pairs of tiles meet, in separate tasks. Equal vectors of one label
are one class and travel once, so copies never multiply.

Defined results: vectors that are null, empty, zero, of another length than the
most common one, or that hold null or non-finite components link with nothing, as do
rows with a null label; each still yields its row. Equal rows link with each
other. A null vec_id is counted as a link by others but names no component. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anvaya.llm.common import connected_components, discard, sorted_slices, spanning_pairs, stage

THRESHOLD = 0.98
#: A table has so many more bits than the logarithm of the number of vectors; the share of
#: links at the threshold that all tables together may miss.
SPARE_BITS, MISSED = 2, 0.002
LEAST_BITS, MOST_BITS = 8, 30
SAMPLE_ROWS = 5000
ROUNDS = 30
TILE_ROWS = 2048
SEED = 20240229


def table_sizes(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(tables, bits of each) for n vectors.

    A bit of two vectors at an angle a differs with probability a / pi. With 2 ** bits beyond
    n, chance neighbours of a vector stay few in every table, however many vectors there
    are; the number of tables grows instead, with a power of n under a fifth.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, n))) + SPARE_BITS))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-agree))) if agree < 1 else 1, bits


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and stacked rotations [dimension, bits] that give balanced codes of the sample.

    Each block alternates between the codes of the rotated sample and the
    orthogonal map nearest to them (a Procrustes problem).
    """
    rng = np.random.default_rng(SEED)
    mean = sample.mean(0)
    centred = sample - mean
    dims = sample.shape[1]
    blocks = []
    for _ in range(-(-bits // dims)):
        rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(rounds):
            codes = np.where(centred @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(centred.T @ codes)
            rotation = u @ vt
        blocks.append(rotation)
    return mean, np.concatenate(blocks, axis=1)[:, :bits]


def substrings(vectors: np.ndarray, mean: np.ndarray, rotation: np.ndarray, tables: int) -> np.ndarray:
    """[vector, table] keys: the code of each vector cut into equal substrings."""
    bits = (vectors - mean) @ rotation >= 0
    width = bits.shape[1] // tables
    weights = 1 << np.arange(width)
    return (bits.reshape(len(vectors), tables, width) * weights).sum(2).astype(np.int32)


def unit_rows(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, scaled to length one, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    largest = np.abs(flat).max(1, keepdims=True)
    flat = flat / largest
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    # Floats travel as they are and are compared in double precision.
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast(kind).alias("embedding"),
        F.col("label").cast("string").alias("label"),
    )
    common = (
        rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d"))
        .count().orderBy(F.desc("count"), "d").first()
    )
    dims = common["d"] if common else 0
    # Components must be finite numbers and one of them not zero; adding 0 makes -0 and 0 one value.
    usable = (
        F.col("label").isNotNull() & (F.size("embedding") == dims)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    marked = stage(
        rows.withColumn("usable", F.coalesce(usable, F.lit(False)) & F.lit(dims > 0))
        .withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind[6:-1]))),
        "vectors-rows",
    )
    loose = marked.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    if not dims:
        return loose
    good = marked.where("usable").drop("usable")
    # One row per distinct vector of a label; the class number stands for its rows.
    classes = stage(
        good.groupBy("label", "embedding").agg(
            F.count("*").alias("copies"), F.min("vec_id").alias("least")
        ).withColumn("class_id", F.monotonically_increasing_id()),
        "vectors-classes",
    )
    total = classes.count()
    if not total:
        return loose
    tables, key_bits = table_sizes(total, threshold)
    share = min(1.0, SAMPLE_ROWS / total)
    sample = classes.where(
        F.pmod(F.xxhash64("embedding"), F.lit(1_000_000)) <= int(share * 1_000_000)
    ).select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE_ROWS).toArrow()
    column = sample.column(0).combine_chunks()
    units = unit_rows(column, dims) if len(column) else np.eye(dims)
    mean, rotation = learn_rotations(units, tables * key_bits)
    shared = spark.sparkContext.broadcast((mean, rotation))  # of the vectors' dimension

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, rotation = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = substrings(unit_rows(part.column(3), dims), mean, rotation, tables)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), tables)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists.cast(pa.list_(pa.int32()))],
                    names=["class_id", "label", "copies", "embedding", "codes"],
                )

    coded = stage(
        classes.select("class_id", "label", "copies", "embedding").mapInArrow(
            keys, f"class_id long, label string, copies long, embedding {kind}, codes array<int>"
        ),
        "vectors-coded",
    )
    # Only (bucket, class) rows travel here. The bucket is a hash of all that must agree; that
    # two buckets share one costs a few comparisons, not a wrong link: labels are compared again.
    placed = coded.select("class_id", F.posexplode("codes").alias("slot", "code"), "label").select(
        "class_id", "slot", F.xxhash64("label", "slot", "code").alias("bucket")
    )
    buckets = (
        placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        .select("bucket", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))
    )
    # Rows alone in their bucket stay behind; a bucket of t tiles meets as t * (t + 1) / 2 pairs.
    # Vectors are fetched once a row and bucket, after all others have gone.
    spread = (
        placed.join(buckets, "bucket")
        .withColumn("own", F.expr("cast(pmod(hash(class_id), tiles) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            (F.col("own") == F.col("low")).alias("first"), "slot", "class_id",
        )
        .join(coded.select("class_id", F.xxhash64("label").alias("tag"), "copies", "codes", "embedding"), "class_id")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def finish() -> pa.RecordBatch | None:
            if not held or sum(len(h[0]) for h in held) < 2:
                return None
            ids, copies, first = (np.concatenate([h[k] for h in held]) for k in range(3))
            codes, units, tags = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
            slot, low, high = current[3], current[1], current[2]
            a, b = (first, ~first) if low != high else (first, first)
            counts = np.zeros(len(ids), dtype=np.int64)
            left, right = [], []
            rows_a, rows_b = np.flatnonzero(a), np.flatnonzero(b)
            for at in range(0, len(rows_a), 1024):
                i = rows_a[at : at + 1024]
                near = units[i] @ units[rows_b].T >= threshold
                near &= tags[i][:, None] == tags[rows_b][None, :]
                if low == high:
                    near &= i[:, None] != rows_b[None, :]
                for earlier in range(slot):
                    if not near.any():
                        break
                    near &= codes[i, earlier][:, None] != codes[rows_b, earlier][None, :]
                x, y = np.nonzero(near)
                if not len(x):
                    continue
                counts[i] += near @ copies[rows_b]
                if low != high:
                    counts[rows_b] += copies[i] @ near
                left.append(ids[i[x]])
                right.append(ids[rows_b[y]])
            if not left:
                return None
            root, member = spanning_pairs(np.concatenate(left), np.concatenate(right))
            linked = np.flatnonzero(counts)
            blank = np.full(len(root), -1)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[linked], root])),
                 pa.array(np.concatenate([np.full(len(linked), -1), member])),
                 pa.array(np.concatenate([counts[linked], blank * 0]))],
                names=["class_id", "other_id", "links"],
            )

        for key, part in sorted_slices(batches, 4):
            if key != current:
                if (out := finish()) is not None:
                    yield out
                held, current = [], key
            codes = part.column("codes").flatten().to_numpy().reshape(-1, tables)
            held.append((
                part.column("class_id").to_numpy(), part.column("copies").to_numpy(),
                part.column("first").to_numpy(zero_copy_only=False), codes,
                unit_rows(part.column("embedding"), dims), part.column("tag").to_numpy(),
            ))
        if (out := finish()) is not None:
            yield out

    met = stage(
        spread.select("bucket", "low", "high", "slot", "first", "class_id", "copies", "codes", "embedding", "tag")
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high", "slot")
        .mapInArrow(compare, "class_id long, other_id long, links long"),
        "vectors-links",
    )
    discard(coded)
    counts = met.where("other_id < 0").groupBy("class_id").agg(F.sum("links").alias("links"))
    edges = met.where("other_id >= 0").select(
        F.col("class_id").alias("src"), F.col("other_id").alias("dst")
    )
    groups = connected_components(edges, "vectors")
    placed = stage(
        classes.join(counts, "class_id", "left")
        .join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select(
            "label", "embedding", "least",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("root"),
        ),
        "vectors-placed",
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = good.join(
        placed.join(named, "root").select("label", "embedding", "n_links", "component_id"),
        ["label", "embedding"],
    ).select(
        "vec_id", "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
    return linked.unionByName(loose)
