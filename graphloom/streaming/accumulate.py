"""A lemma graph kept up to date from a stream of documents: counts are merged by key, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import textgraph


def merged(parts: DataFrame) -> DataFrame:
    """Nodes of several batches, summed by key; the first batch names the node."""
    first = F.min_by(F.struct("kind", "pos", "text", "label"), "batch")
    out = parts.groupBy("graph_id", "key").agg(first.alias("f"), F.sum("count").alias("count"), F.max("sub_obj").alias("sub_obj"))
    return out.select("graph_id", "key", "f.kind", "f.pos", "f.text", "f.label", "count", "sub_obj")


def accumulate(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's nodes under path, in a folder of its own that a repeated batch overwrites; merged(read) is the graph."""

    def batch(docs: DataFrame, number: int) -> None:
        textgraph.token_nodes(textgraph.tokens(docs)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
