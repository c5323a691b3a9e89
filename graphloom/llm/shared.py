"""Written tables, size-checked joins and connected groups."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of Parquet, up to which a written table is broadcast; beyond either, the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20
#: Edges up to which one task finds the connected groups.
EDGES = 1_000_000
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return folder.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_id(name: str = "doc_id") -> Column:
    """An id as a long; null where it is none, as for text that isn't a number."""
    return F.col(name).try_cast("long").alias(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, has a known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    # shuffle files go once the driver has collected what refers to them; nothing needs those of a written table
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def _folders(df: DataFrame) -> list:
    """(path, file system) of the folders that a written table is in."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(folder) for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})]
    return [(path, path.getFileSystem(spark._jsc.hadoopConfiguration())) for path in paths]


def remove(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        for path, system in _folders(df):
            system.delete(path, True)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint where its rows and the bytes of its files allow; else as it is, for a shuffled join."""
    if sum(system.getContentSummary(path).getLength() for path, system in _folders(df)) > most:
        return df
    return F.broadcast(df) if df.count() <= limit else df


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of the edges and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (x, y) = np.arange(len(nodes)), ends.reshape(2, -1)
    while (apart := root[x] != root[y]).any():
        x, y = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def connected(edges: DataFrame, at_once: int = EDGES) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node of the component.

    Up to at_once edges go to one task. Of more, alternating large-star and small-star steps until no edge changes: a logarithmic
    number of rounds, each two aggregations over the edges, each written to the shared
    folder. Self-loops and repeated edges don't matter; null ends are dropped; no edges, no rows.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if edges.count() <= at_once:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = list(batches)
            if parts:
                table = pa.Table.from_batches(parts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in components(table["a"].to_numpy(), table["b"].to_numpy())], names=["node", "root"])

        return edges.repartition(1).mapInArrow(run, "node long, root long")
    before = None
    while True:
        large = _star(edges, large=True)
        small = written(_star(large, large=False), "edges")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(edges)
        edges = small
        if tuple(state) == before:
            break
        before = tuple(state)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the star algorithm; edges (a, b) come back with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = both.where("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()
