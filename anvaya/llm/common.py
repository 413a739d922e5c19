"""Helpers shared by the training-data operators.

Nothing outside this subpackage imports this module, and this module imports
nothing from the rest of the library.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_OWNED: dict[str, set[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Spark resolves the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with underscores in front until ``df`` has none like it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    On a cluster this is ``spark.checkpoint.dir``. Only where that setting is
    absent in a local session, as in tests, a temporary folder stands in.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="anvaya-stage-")
    return _FALLBACK[app]


def _drop_owned(app: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _OWNED.pop(app, ()):
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system that owns it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the re-read of a file, never
    a recomputation of the stages above. Folders go when the application ends.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{staging_root(spark)}/anvaya/{name}-{uuid.uuid4().hex}"
    if app not in _OWNED:
        _OWNED[app] = set()
        atexit.register(_drop_owned, app)
    _OWNED[app].add(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing still to be run reads."""
    for df in tables:
        spark = df.sparkSession
        drop_path(spark, df._staged_at)
        _OWNED[spark.sparkContext.applicationId].discard(df._staged_at)


def binary_column(batch: pa.RecordBatch, index: int) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(index)
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def sorted_slices(
    batches: Iterable[pa.RecordBatch], keys: int
) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) runs of a partition that is sorted by its first ``keys`` columns.

    A group that crosses batches comes in several runs, one after the other,
    so no group is ever held whole.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        changed = np.zeros(n, dtype=bool)
        changed[0] = True
        for column in columns:
            changed[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(changed)
        ends = np.append(starts[1:], n)
        for start, end in zip(starts.tolist(), ends.tolist()):
            key = tuple(column[start].item() for column in columns)
            yield key, batch.slice(start, end - start)


def spanning_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (root, member) that join the same nodes as the given links.

    At most one pair a node comes back, however many links there are. The root
    of a component is its smallest node.
    """
    if not len(left):
        return left, right
    nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = np.minimum(label, label[label])
        if np.array_equal(before, label):
            break
    member = label != np.arange(len(nodes))
    return nodes[label[member]], nodes[member]


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """Components of an undirected graph of (src, dst) long links.

    Alternates the large-star and small-star steps until the links no longer
    change; every step is a map-side combined minimum and an equi-join, which
    the engine may split where a node holds many links. Each round is written
    to the shared folder. Returns (node, component): one row per node that has
    a link, component the smallest node that it reaches.
    """
    def both(df: DataFrame) -> DataFrame:
        flipped = df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return df.unionByName(flipped)

    def summary(df: DataFrame) -> tuple:
        row = df.agg(
            F.count("*").alias("n"), F.sum(F.hash("src", "dst").cast("long")).alias("h")
        ).first()
        return row["n"], row["h"]

    edges = edges.where("src <> dst and src is not null and dst is not null")
    edges = stage(
        edges.select(F.least("src", "dst").alias("dst"), F.greatest("src", "dst").alias("src"))
        .select("src", "dst")
        .distinct(),
        f"{name}-edges",
    )
    seen = summary(edges)
    while seen[0]:
        pairs = both(edges)
        low = pairs.groupBy("src").agg(F.min("dst").alias("low"))
        low = low.select("src", F.least("src", "low").alias("low"))
        large = (
            pairs.join(low, "src").where("dst > src")
            .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .where("src <> dst").distinct()
        )
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = (
            large.join(low, "src")
            .select(F.explode(F.array(
                F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")),
                F.struct(F.col("src"), F.col("low").alias("dst")),
            )).alias("e"))
            .select("e.src", "e.dst").where("src <> dst").distinct()
        )
        before, edges = edges, stage(small, f"{name}-round")
        discard(before)
        now = summary(edges)
        if now == seen:
            break
        seen = now
    member = edges.groupBy("src").agg(F.min("dst").alias("component"))
    root = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return member.select(F.col("src").alias("node"), "component").unionByName(root)
