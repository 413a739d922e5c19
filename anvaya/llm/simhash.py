"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint. Distinct fingerprints are laid out in
cells by the population counts of their four 16-bit quarters. Two fingerprints
within ``radius`` bits have quarter counts whose absolute differences sum to at
most ``radius``, so whole pairs of cells further apart are skipped; the rest
are compared exactly, tile against tile, with exclusive-or and bit counts.
Cells with many rows are cut into several tiles. Links leave a tile as a
spanning forest, so a group of n near copies yields n links, not n squared.

Defined results: a null text is an empty one; an empty text, or one of white
space, has fingerprint zero and links like any other; repeated rows share their
fingerprint and component, as do ties (equal fingerprints); a doc_id that several rows
share names the component of each of them; rows with a null doc_id follow their
fingerprint's component and never name one (the component is null if nobody else is in
it); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anvaya.llm.common import (
    binary_column, connected_components, free_names, sorted_slices, spanning_pairs, stage,
)

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
TILE_ROWS = 8192
RECENT = 500_000


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words].tolist()
    stops = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    totals = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        totals += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(totals * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep_hash: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; with ``keep_hash`` also (text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in binary_column(batch, 1)], dtype=np.uint64)
            found = pa.array(fps.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), found, *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]]
            )

    columns, schema = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")], "doc_id long, fp long"
    if keep_hash:
        columns.append(F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias("text_hash"))
        schema += ", text_hash long"
    return docs.select(*columns).mapInArrow(run, schema)


def cell_of(fp: str = "fp"):
    """Quarter population counts of a fingerprint, five bits each."""
    return sum(
        (
            F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))), 5 * q)
            for q in range(1, 4)
        ),
        F.bit_count(F.col(fp).bitwiseAND(F.lit(0xFFFF))),
    ).cast("int")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Cell steps within the radius, one of each pair of opposite steps."""
    steps = product(range(-radius, radius + 1), repeat=4)
    return [s for s in steps if sum(map(abs, s)) <= radius and s[::-1] >= (0, 0, 0, 0)]


def tile_links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (src, dst) that join all (rep, fp) rows within ``radius`` bits.

    ``distinct`` has one row per fingerprint. At most 17**4 cells exist, so
    the table of their tile counts has a proven bound and may be broadcast.
    """
    rows = distinct.withColumn("cell", cell_of())
    cells = rows.groupBy("cell").agg(
        F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("tiles")
    )
    steps = F.array(*[
        F.lit(sum(d << (5 * q) for q, d in enumerate(step))) for step in _offsets(radius)
    ])
    spread = (
        rows.withColumn("step", F.explode(steps))
        .select("rep", "fp", "step", (F.col("cell") + F.col("step")).alias("tile_cell"))
        .join(F.broadcast(cells.withColumnRenamed("cell", "tile_cell")), "tile_cell")
        .withColumn("own", F.expr("cast(pmod(hash(fp), tiles) as int)"))
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .where("step <> 0 or tile >= own")
        .select(
            "tile_cell", "tile",
            ((F.col("step") != 0) | (F.col("tile") != F.col("own"))).alias("probe"),
            "rep", "fp",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, targets, held = [], [], 0
        current, own, own_rep = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for key, rows in sorted_slices(batches, 2):
            if key != current:
                current, own, own_rep = key, own[:0], own_rep[:0]
            fps = rows.column("fp").to_numpy().view(np.uint64)
            reps = rows.column("rep").to_numpy()
            home = ~rows.column("probe").to_numpy(zero_copy_only=False)
            own, own_rep = np.append(own, fps[home]), np.append(own_rep, reps[home])
            left, right = [], []
            height = max(1, 2_000_000 // len(fps))
            for at in range(0, len(own), height):
                near = np.bitwise_count(own[at : at + height, None] ^ fps[None, :]) <= radius
                i, j = np.nonzero(near)
                left.append(own_rep[at : at + height][i])
                right.append(reps[j])
            if not left:
                continue
            a, b = np.concatenate(left), np.concatenate(right)
            keep = a != b
            root, member = spanning_pairs(a[keep], b[keep])
            if len(root):
                sources.append(member)
                targets.append(root)
                held += len(root)
            if held > 50_000:
                yield _links(sources, targets)
                sources, targets, held = [], [], 0
        if held:
            yield _links(sources, targets)

    return (
        spread.repartition("tile_cell", "tile")
        .sortWithinPartitions("tile_cell", "tile", "probe")
        .mapInArrow(run, "src long, dst long")
    )


def _links(sources: list, targets: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(sources)), pa.array(np.concatenate(targets))],
        names=["src", "dst"],
    )


def components(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, group, component_id) for the fingerprints of ``marked`` (doc_id, fp).

    ``group`` names the component by one of its fingerprints, ``component_id`` by its
    smallest doc_id, null where no row of it has one.
    """
    distinct = stage(
        marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct"
    )
    found = connected_components(
        tile_links(distinct.select(F.col("fp").alias("rep"), "fp"), radius), "simhash"
    )
    grouped = stage(
        distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("group")),
        "simhash-groups",
    )
    named = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    return grouped.select("fp", "group").join(named, "group")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    marked = stage(fingerprints(docs), "simhash-fp")
    return marked.join(components(marked, radius), "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of linked fingerprints: that of the smallest doc_id.

    Groups are told apart by fingerprint, so rows with one doc_id and different texts stand
    for themselves. Of rows with one doc_id that are linked, the one of least text hash
    stays; of wholly repeated rows one. A row without a doc_id stays only where nobody in
    its group has one. What stays is decided on (doc_id, fingerprint, text hash) rows;
    texts are shuffled once.
    """
    identity, text_hash = free_names(docs, "identity", "text_hash")
    # A null id and the number that stands for it have different hashes.
    keys = [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(identity),
        F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias(text_hash),
    ]
    marked = stage(fingerprints(docs, keep_hash=True), "simhash-fp")
    classes = components(marked, radius)
    chosen = stage(
        marked.join(classes, "fp").groupBy("group").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one")
        ).select(
            F.coalesce("one.doc_id", F.lit(0)).alias("c_identity"), F.col("one.text_hash").alias("c_hash")
        ),
        "simhash-chosen",
    )
    repeated = not (
        marked.groupBy(F.coalesce("doc_id", F.lit(0)), "text_hash").agg(F.count("*").alias("n"))
        .where("n > 1").isEmpty()
    )
    rows = docs.select("*", *keys)
    if repeated:  # copies of a row meet once a task before the shuffle
        rows = once_a_task(rows, identity, text_hash)
    kept = rows.join(
        chosen, (rows[identity] == chosen["c_identity"]) & (rows[text_hash] == chosen["c_hash"]), "left_semi"
    )
    if repeated:
        kept = kept.dropDuplicates([identity, text_hash])
    return kept.drop(identity, text_hash)


def once_a_task(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` without those whose keys the same task has seen among its recent ones."""
    places = [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            fresh = []
            for n, key in enumerate(zip(*(batch.column(k).to_pylist() for k in places))):
                if key not in seen:
                    seen.add(key)
                    fresh.append(n)
            if len(seen) > RECENT:
                seen.clear()
            yield batch.take(pa.array(fresh, pa.int64()))

    return rows.mapInArrow(run, rows.schema)
