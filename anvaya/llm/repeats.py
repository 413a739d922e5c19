"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if some string of ``SPAN`` bytes that covers it also starts
anywhere else, in the same text or another.

1. Equal texts become one (a bucketed table by text hash, copies counted; a text
   with copies is all repeated). Copies meet once a task before the shuffle.
2. Every span has one anchor, the ``GRAM``-byte string of least hash in it,
   found by sliding minima. Equal spans have equal anchors, so a span whose anchor
   hash occurs once in the corpus is not repeated. Only anchor hashes travel.
3. Around each repeated anchor the bytes of all spans that it anchors, a
   *segment*, are cut out. Equal segments become one.
4. Segments that share an anchor hash meet, and the starts of all their spans
   are sorted as suffixes: multikey quicksort on eight-byte characters to a shallow
   depth of ``SHALLOW`` bytes, then the groups still tied are ordered as blind
   tries, where each suffix is compared with one leaf and branches off at the first
   byte that differs. Neighbours equal over ``SPAN`` bytes are repeated.
5. An anchor with more than ``HOT_SEGMENTS`` different segments (a passage before and
   after thousands of different ones) is first split by more bytes: its spans are halved by
   the place of the anchor in them, and each half is grouped by the bytes that all its spans
   must share. Groups small enough are sorted as above, others are halved again; after
   eight rounds at most a group is one span. So no task holds more, however hot the anchor.

Defined results: a null text is an empty one; texts under ``SPAN`` bytes lose
nothing; repeated rows are copies of each other; rows with a null doc_id count like
others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anvaya.llm.common import discard, sorted_slices, stage

SPAN = 200
GRAM = 64
SHALLOW = 32
HOT_SEGMENTS = 4000
CHUNK_BYTES = 1 << 20
SORT_BYTES = 1_500_000
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all ``gram``-byte strings of a buffer."""
    n = len(data)
    inverse = pow(_BASE, -1, 1 << 64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(inverse, n), out=sums[1:])
    return _mixed((sums[gram:] - sums[: n + 1 - gram]) * _powers(_BASE, n + 1 - gram))


def _sliding_minima(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(text, first start, starts, hash, lead) of each run of spans with one anchor.

    ``lead`` is how far the anchor is behind the first start.

    ``data`` holds several texts one after the other; text t is
    ``data[bounds[t]:bounds[t + 1]]``. Starts are positions in ``data``.
    """
    none = np.empty(0, np.int64)
    if len(data) < span:
        return none, none, none, np.empty(0, np.uint64), none
    hashes = gram_hashes(data, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_minima((hashes & ~_LOW) | place, span - gram + 1)
    anchor = (least & _LOW).astype(np.int64)
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(anchor)]
    starts = np.flatnonzero(np.arange(len(anchor)) + span <= bounds[text + 1])
    if not len(starts):
        return none, none, none, np.empty(0, np.uint64), none
    own, of = anchor[starts], text[starts]
    new = np.flatnonzero(
        np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])])
    )
    counts = np.diff(np.append(new, len(starts)))
    return of[new], starts[new], counts, hashes[own[new]], own[new] - starts[new]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_BYTES`` together, or of one long text."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > CHUNK_BYTES:
            yield first, k
            first, size = k, 0
        size += len(text)
    if texts:
        yield first, len(texts)


def pieces_of(text: bytes, span: int = SPAN) -> list[tuple[int, bytes]]:
    """(offset, bytes): a very long text in parts that overlap by a span less a byte."""
    limit = 8 * CHUNK_BYTES
    if len(text) <= limit:
        return [(0, text)]
    return [(at, text[at : at + limit + span - 1]) for at in range(0, len(text) - span + 1, limit)]


def runs_in(texts: list[bytes]):
    """(text, start in the text, starts, hash, lead) of all anchor runs, chunk by chunk."""
    parts = [(k, at, part) for k, text in enumerate(texts) for at, part in pieces_of(text)]
    for first, last in chunks([p for _, _, p in parts]):
        own = parts[first:last]
        data = np.frombuffer(b"".join(p for _, _, p in own), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(p) for _, _, p in own])])
        of, start, count, hashes, lead = anchors(data, bounds)
        names = np.array([k for k, _, _ in own])
        shift = np.array([at for _, at, _ in own])
        if len(of):
            yield names[of], start - bounds[of] + shift[of], count, hashes, lead


def equal_spans(buffer: np.ndarray, starts: np.ndarray, span: int = SPAN, shallow: int = SHALLOW):
    """Which of the spans at ``starts`` equal another one: a deep-shallow suffix sort.

    Returns (order, class): the starts in suffix order and a number that equal
    spans share. ``buffer`` must reach eight bytes beyond every span.
    """
    words = np.lib.stride_tricks.sliding_window_view(buffer, 8)

    def character(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words[at]).view(">u8").ravel().astype(np.uint64)

    n = len(starts)
    order = np.arange(n)
    group = np.zeros(n, dtype=np.int64)  # of each place in the order

    def split(active: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """Sort the places ``active`` by the keys within their groups; renumber groups."""
        rank = np.lexsort((*keys[::-1], group[active]))
        order[active] = order[active[rank]]
        old = group[active]
        sorted_keys = [k[rank] for k in keys]
        new = np.zeros(len(active), dtype=bool)
        new[0] = True
        new[1:] = old[1:] != old[:-1]
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        return rank

    def tied(places: np.ndarray) -> np.ndarray:
        """Of these places, those that share their group with another."""
        own = group[places]
        same = np.zeros(len(places), dtype=bool)
        same[1:] = own[1:] == own[:-1]
        same[:-1] |= own[1:] == own[:-1]
        return places[same]

    active = order.copy()
    for depth in range(0, shallow, 8):
        if not len(active):
            break
        split(active, [character(starts[order[active]] + depth)])
        active = tied(active)
    while len(active):
        # Blind trie: one leaf a group; the others branch off where they first differ.
        own = group[active]
        leaf = starts[order[own]]  # a group is named after its first place
        mine = starts[order[active]]
        common = np.full(len(active), span, dtype=np.int64)
        open_ = np.arange(len(active))
        for depth in range(shallow, span, 8):
            if not len(open_):
                break
            a, b = character(mine[open_] + depth), character(leaf[open_] + depth)
            differ = a != b
            if differ.any():
                gap = (a ^ b)[differ]
                zeros = sum((gap < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
                common[open_[differ]] = np.minimum(depth + zeros, span)
                open_ = open_[~differ]
        at = np.minimum(common, span - 1)
        byte, other = buffer[mine + at].astype(np.int64), buffer[leaf + at].astype(np.int64)
        equal = common >= span
        side = np.where(equal, span, np.where(byte < other, common, 2 * span - common))
        rank = split(active, [side, np.where(equal, 0, byte)])
        # Equal ones now form groups of their own and need no more looking at.
        active = tied(active[~equal[rank]])
    return order, group


def repeated_starts(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each span equals that at another of the starts."""
    out = np.zeros(len(starts), dtype=bool)
    if len(starts) > 1:
        order, group = equal_spans(buffer, starts)
        same = group[1:] == group[:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def _runs(flags: np.ndarray) -> list[int]:
    """First and last-plus-one of each run of true flags, flat."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges.tolist()


def _release(spark) -> None:
    """Let the cleaner drop the shuffle files of what is written already."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def distinct_texts(docs: DataFrame, name: str) -> DataFrame:
    """A bucketed table (tid, body) of the distinct texts of ``docs``."""
    spark = docs.sparkSession

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for k, tid in enumerate(batch.column(0).to_pylist()):
                if tid not in seen:
                    seen.add(tid)
                    fresh.append(k)
            if fresh:
                yield batch.take(pa.array(fresh, pa.int64()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            fresh = []
            for k, tid in enumerate(batch.column(0).to_pylist()):
                if tid != last:
                    fresh.append(k)
                    last = tid
            if fresh:
                yield batch.take(pa.array(fresh, pa.int64()))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = docs.select(F.xxhash64("body").alias("tid"), "body")
    schema = "tid long, body binary"
    (
        marked.mapInArrow(once, schema).repartition(n, "tid").sortWithinPartitions("tid")
        .mapInArrow(merge, schema)
        .write.bucketBy(n, "tid").format("parquet").option("compression", "zstd").saveAsTable(name)
    )
    return spark.table(name)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"),
    )
    name = f"repeats_{uuid.uuid4().hex}"
    try:
        texts = distinct_texts(rows.where(F.length("body") >= SPAN), name)
        _release(spark)
        cut = stage(_cut(texts), "repeats-cut")
        own = rows.select(
            "doc_id", F.xxhash64("body").alias("tid"), F.length("body").cast("long").alias("n_bytes"),
            F.sha2("body", 256).alias("whole"),
        )
        # Copies are counted over the rows themselves, combined map-side.
        copies = own.where(F.col("n_bytes") >= SPAN).groupBy("tid").agg(F.count("*").alias("copies"))
        result = own.join(
            copies.join(cut, "tid", "left"), "tid", "left"
        ).select(
            "doc_id", "n_bytes",
            F.when(F.col("copies") > 1, F.col("n_bytes"))
            .otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copies") > 1, 1)
            .otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(F.col("copies") > 1, F.sha2(F.lit(b""), 256))
            .otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        )
        out = stage(result, "repeats-result")
        discard(cut)
        return out
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _release(spark)


PART_COLUMNS = ("h", "s1", "s2", "lo", "hi", "lead", "body")
PART = "h long, s1 long, s2 long, lo int, hi int, lead int, body binary, p1 long, p2 long"
_PART_TYPES = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] + [pa.int64()] * 2


def halves(width: int):
    """Parts of segments cut in two, told apart by more bytes.

    The spans of a part have their anchor ``width`` different places in, at most. Those of
    half of these places have ``SPAN - width / 2 + 1`` bytes in common, which become the
    new key: equal spans have their anchor at the same place and so stay together. With one place
    left the key tells the whole span.
    """
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for h, s1, s2, lo, hi, lead, body in zip(*(batch.column(k).to_pylist() for k in range(7))):
                base = (lead - lo) // width * width
                for place in (base, base + half):  # the anchor is place to place + half - 1 bytes in
                    a, b = max(lo, lead - place - half + 1), min(hi, lead - place + 1)
                    if a >= b:
                        continue
                    part = body[a - lo : b - lo + SPAN - 1]
                    common = body[lead - place - lo : lead - place - half + 1 + SPAN - lo]
                    key = xxhash.xxh64_intdigest(common, (h + place * _BASE) % (1 << 64))
                    p1, p2 = np.frombuffer(xxhash.xxh3_128_digest(part), dtype="<i8").tolist()
                    rows.append((key - (1 << 63), s1, s2, a, b, lead, part, p1, p2))
                if len(rows) > 20_000:
                    yield _batch(rows, [*PART_COLUMNS, "p1", "p2"], _PART_TYPES)
                    rows = []
            if rows:
                yield _batch(rows, [*PART_COLUMNS, "p1", "p2"], _PART_TYPES)

    return run


def _cut(texts: DataFrame) -> DataFrame:
    """(tid, n_removed, n_spans, kept_sha256) of the distinct texts that lose bytes."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids = batch.column(0).to_numpy()
            for of, _, _, found, _ in runs_in(batch.column(1).to_pylist()):
                # A text that repeats an anchor says so once, with how often.
                h = found.view(np.int64)
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
                n = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[first]), pa.array(tids[of[first]]), pa.array(n)],
                    names=["h", "tid", "n"],
                )

    marked = texts.select("tid", "body").mapInArrow(hashes, "h long, tid long, n long")
    shared = marked.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    # No aggregate follows the join in its stage, so a hot anchor can be split.
    wanted = stage(marked.select("h", "tid").join(shared, "h"), "repeats-anchors")
    _release(texts.sparkSession)
    lists = wanted.groupBy("tid").agg(F.collect_set("h").alias("hs"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "tid", "start", "spans", "lead", "s1", "s2", "body"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        seen: set[bytes] = set()
        for batch in batches:
            tids = batch.column(0).to_numpy()
            bodies = batch.column(1).to_pylist()
            asked = [np.asarray(x.values).view(np.uint64) for x in batch.column(2)]
            rows: list[tuple] = []
            for of, start, count, found, lead in runs_in(bodies):
                for t in np.unique(of).tolist():
                    mine = np.flatnonzero(of == t)
                    mine = mine[np.isin(found[mine], asked[t])]
                    for k in mine.tolist():
                        a, c = int(start[k]), int(count[k])
                        body = bodies[t][a : a + c + SPAN - 1]
                        digest = xxhash.xxh3_128_digest(body)
                        s1, s2 = np.frombuffer(digest, dtype="<i8").tolist()
                        first = digest not in seen
                        if first:
                            if len(seen) > 500_000:
                                seen.clear()
                            seen.add(digest)
                        rows.append((
                            int(found[k].view(np.int64)), int(tids[t]), a, c, int(lead[k]), s1, s2,
                            body if first else None,
                        ))
                if len(rows) > 20_000:
                    yield _batch(rows, names, kinds)
                    rows = []
            if rows:
                yield _batch(rows, names, kinds)

    occurrences = stage(
        texts.select("tid", "body").join(lists.hint("shuffle_hash"), "tid")
        .select("tid", "body", "hs")
        .mapInArrow(segments, "h long, tid long, start long, spans int, lead int, s1 long, s2 long, body binary"),
        "repeats-segments",
    )
    _release(texts.sparkSession)
    counted = stage(
        occurrences.groupBy("h", "s1", "s2", "spans").agg(F.count("*").alias("n")),
        "repeats-counted",
    )
    several = counted.groupBy("h").agg(F.count("*").alias("different")).where("different > 1")
    bodies = occurrences.where("body is not null").select("h", "s1", "s2", "spans", "lead", "body").join(
        several, "h"
    )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["s1", "s2", "runs"], [pa.int64(), pa.int64(), pa.list_(pa.int32())]
        held: list[tuple[int, int, int, bytes]] = []
        size, current, last = 0, None, None

        def finish() -> pa.RecordBatch | None:
            lengths = np.array([len(b) for _, _, _, b in held])
            buffer = np.frombuffer(b"".join(b for *_, b in held) + bytes(16), dtype=np.uint8)
            base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            spans = np.array([c for _, _, c, _ in held])
            within = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
            flags = repeated_starts(buffer, np.repeat(base, spans) + within)
            out, at = [], 0
            for s1, s2, c, _ in held:
                if runs := _runs(flags[at : at + c]):
                    out.append((s1, s2, runs))
                at += c
            return _batch(out, names, kinds) if out else None

        for key, part in sorted_slices(batches, 3):
            h, s1, s2 = key
            if (s1, s2) == last:
                continue
            if h != current and size > SORT_BYTES:
                if (out := finish()) is not None:
                    yield out
                held, size = [], 0
            current, last = h, (s1, s2)
            body = part.column(4)[0].as_py()
            held.append((s1, s2, part.column(3)[0].as_py(), body))
            size += len(body)
        if held and (out := finish()) is not None:
            yield out

    def sorted_groups(groups: DataFrame) -> DataFrame:
        """(s1, s2, runs) of the groups (h, s1, s2, spans, body), each sorted in a task."""
        return (
            groups.select("h", "s1", "s2", "spans", "body")
            .repartition("h").sortWithinPartitions("h", "s1", "s2")
            .mapInArrow(sort, "s1 long, s2 long, runs array<int>")
        )

    sorted_runs = sorted_groups(bodies.where(F.col("different") <= HOT_SEGMENTS))
    # Parts of segments: (h, p1, p2) as above for the part, s1 and s2 of the whole, its starts lo to hi.
    hot = bodies.where(F.col("different") > HOT_SEGMENTS).select(
        "h", "s1", "s2", F.lit(0).alias("lo"), F.col("spans").alias("hi"), "lead", "body"
    ).dropDuplicates(["s1", "s2"])
    width = 1 << (SPAN - GRAM).bit_length()
    # Nothing is split, nor its bytes read, where no anchor is hot.
    none = several.where(F.col("different") > HOT_SEGMENTS).isEmpty()
    parts = stage(hot.where("false") if none else hot, "repeats-hot")
    staged = [parts]
    while width > 1 and not parts.isEmpty():
        parts = stage(parts.mapInArrow(halves(width), PART), "repeats-parts")
        staged.append(parts)
        width //= 2
        counts = parts.groupBy("h", "p1", "p2").agg(F.count("*").alias("n"))
        sizes = counts.groupBy("h").agg(F.count("*").alias("different"))
        known = stage(counts.join(sizes, "h").select("h", "p1", "p2", "n", "different"), "repeats-sizes")
        staged.append(known)
        same = parts.join(known.where("n > 1"), ["h", "p1", "p2"]).select(
            "s1", "s2", F.array("lo", "hi").alias("runs")
        )
        small = parts.select("h", "p1", "p2", "lo", "hi", "body").join(
            known.where((F.col("different") > 1) & (F.col("different") <= HOT_SEGMENTS)), ["h", "p1", "p2"]
        ).select("h", F.col("p1").alias("s1"), F.col("p2").alias("s2"), (F.col("hi") - F.col("lo")).alias("spans"), "body")
        found = sorted_groups(small).withColumnsRenamed({"s1": "p1", "s2": "p2"})
        placed = parts.select("p1", "p2", "s1", "s2", "lo").join(found, ["p1", "p2"]).select(
            "s1", "s2", F.transform("runs", lambda x: x + F.col("lo")).alias("runs")
        )
        level = stage(same.unionByName(placed), "repeats-level")
        staged.append(level)
        sorted_runs = sorted_runs.unionByName(level)
        parts = parts.join(known.where(F.col("different") > HOT_SEGMENTS).select("h").distinct(), "h").select(*PART_COLUMNS)
    alone = counted.where("n > 1").select("s1", "s2", F.array(F.lit(0), F.col("spans")).alias("runs"))
    runs = stage(alone.unionByName(sorted_runs), "repeats-runs")
    discard(*staged)
    found = occurrences.select("tid", "start", "s1", "s2").join(runs, ["s1", "s2"])
    marks = found.groupBy("tid").agg(
        F.collect_list(F.struct("start", "runs")).alias("marks")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tid, body, marks in zip(*(batch.column(k) for k in range(3))):
                text = body.as_py()
                gone = np.zeros(len(text) + 1, dtype=np.int32)
                for mark in marks.as_py():
                    edges = np.array(mark["runs"]) + mark["start"]
                    np.add.at(gone, edges[0::2], 1)
                    np.add.at(gone, edges[1::2] + SPAN - 1, -1)
                removed = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(text, dtype=np.uint8)[~removed].tobytes()
                out.append((
                    tid.as_py(), int(removed.sum()), len(_runs(removed)) // 2,
                    hashlib.sha256(kept).hexdigest(),
                ))
            if out:
                yield _batch(out, ["tid", "n_removed", "n_spans", "kept_sha256"],
                             [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return texts.select("tid", "body").join(marks.hint("shuffle_hash"), "tid").select(
        "tid", "body", "marks"
    ).mapInArrow(cut, "tid long, n_removed long, n_spans long, kept_sha256 string")


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names
    )
