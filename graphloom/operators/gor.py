"""Graph of relations: seeds, transformed triples, affinity between relations.

Triples are (src, rel, dst), distinct and without self-loops (``distinct_triples``). Affinity comes from a
closed form over counts by (node, direction, relation): no join of seeds with seeds, so a hub node costs
its number of relations squared, not its degree squared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Distinct triples with src <> dst; rows with a null are dropped."""
    return triples.select("src", "rel", "dst").where("src <> dst and rel is not null").distinct()


def seeds(triples: DataFrame) -> DataFrame:
    """(node, dir, rel, src, dst): each edge is a head seed of its target and a tail seed of its source."""
    ends = F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit("head").alias("dir")), F.struct(F.col("src").alias("node"), F.lit("tail").alias("dir"))))
    return triples.select(ends.alias("e"), "rel", "src", "dst").select("e.node", "e.dir", "rel", "src", "dst")


def node_trace(triples: DataFrame) -> DataFrame:
    """(node, dir, n, rels): degree and relations of every node by direction."""
    return _counts(triples).groupBy("node", "dir").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list("rel")), ",").alias("rels"))


def _counts(triples: DataFrame) -> DataFrame:
    """(node, dir, rel, n): seeds counted."""
    return seeds(triples).groupBy("node", "dir", "rel").agg(F.count("*").alias("n"))


def _met(triples: DataFrame) -> DataFrame:
    """(node, a, b): all pairs, in order, of the counts (dir, rel, n) of a node; as many as its relations squared, and no join."""
    listed = _counts(triples).groupBy("node").agg(F.collect_list(F.struct("dir", "rel", "n")).alias("c"))
    return listed.select("node", "c", F.explode("c").alias("a")).select("node", "a", F.explode("c").alias("b"))


def relation_order(triples: DataFrame, order: str) -> DataFrame:
    """(rel_id, rel): relations by first appearance in the given order, then by name, from 0."""
    first = triples.groupBy("rel").agg(F.min(order).alias("first"))
    ranked = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("first", "rel"))).alias("all"))  # as many rows as relations
    return ranked.select(F.posexplode("all").alias("rel_id", "r")).select("rel_id", "r.rel")


def arcs(triples: DataFrame) -> DataFrame:
    """(node, dir_a, rel_a, dir_b, rel_b, n): pairs of seeds at each node, counted by direction and relation, a before b."""
    met = _met(triples).select("node", F.col("a.dir").alias("dir_a"), F.col("a.rel").alias("rel_a"), F.col("a.n").alias("na"), F.col("b.dir").alias("dir_b"), F.col("b.rel").alias("rel_b"), F.col("b.n").alias("nb"))
    same = (F.col("dir_a") == F.col("dir_b")) & (F.col("rel_a") == F.col("rel_b"))
    pairs = met.where(same | (F.struct("dir_a", "rel_a") < F.struct("dir_b", "rel_b")))
    n = F.when(same, (F.col("na") * (F.col("na") - 1) / 2).cast("long")).otherwise(F.col("na") * F.col("nb"))
    return pairs.select("node", "dir_a", "rel_a", "dir_b", "rel_b", n.alias("n")).where("n > 0")


def pair_counts(triples: DataFrame) -> DataFrame:
    """(dir, rel_a, rel_b, total, nodes, tally): how often rel_a in direction dir meets rel_b, over all nodes."""
    c = F.struct("dir", "rel", "n")
    listed = _counts(triples).groupBy("node").agg(F.collect_list(c).alias("c"))
    both = listed.select("c", F.explode("c").alias("a")).select("a.dir", F.col("a.rel").alias("rel_a"), "a.n", F.explode(F.array_distinct(F.transform("c", lambda x: x["rel"]))).alias("rel_b"), "c")
    m = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.when(x["rel"] == F.col("rel_b"), x["n"]).otherwise(0))
    cnt = F.col("n") * m - F.when(F.col("rel_a") == F.col("rel_b"), F.col("n")).otherwise(0)
    met = both.select("dir", "rel_a", "rel_b", cnt.alias("cnt")).where("cnt > 0")
    counted = met.groupBy("dir", "rel_a", "rel_b").agg(F.sum("cnt").alias("total"), F.count("*").alias("nodes"))
    return counted.withColumn("tally", F.col("total") + F.col("nodes"))


def affinity(triples: DataFrame) -> DataFrame:
    """(rel_a, rel_b, affinity), rel_a <= rel_b: the mean of the shares each has in what the other meets."""
    w = pair_counts(triples).groupBy("rel_a", "rel_b").agg(F.sum("tally").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("rel_a"))
    # what one relation meets meets it: a pair has both shares, or one with itself, which counts whole
    half = w.select(F.least("rel_a", "rel_b").alias("rel_a"), F.greatest("rel_a", "rel_b").alias("rel_b"), F.when(F.col("rel_a") == F.col("rel_b"), share).otherwise(share / 2).alias("half"))
    return half.groupBy("rel_a", "rel_b").agg(F.sum("half").alias("affinity"))


def trace_metrics(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """(rel_a, rel_b, affinity, expected): scores beside published ones (rel_a, rel_b, expected), null where there is none."""
    return scores.join(expected, ["rel_a", "rel_b"], "left").select("rel_a", "rel_b", "affinity", "expected")


def published(scores: DataFrame, places: int = 2) -> DataFrame:
    """(pair, rel_a, rel_b, affinity, expected) of trace_metrics, rounded as published; pair joins the names."""
    return scores.select(F.concat_ws(" ", "rel_a", "rel_b").alias("pair"), "rel_a", "rel_b", F.round("affinity", places).alias("affinity"), "expected")


def source_edges(triples: DataFrame) -> DataFrame:
    """(node, dir, edges): the (src, rel, dst) of every node by direction, in order."""
    return seeds(triples).groupBy("node", "dir").agg(F.sort_array(F.collect_list(F.struct("src", "rel", "dst"))).alias("edges"))


def edge_styles(scores: DataFrame) -> DataFrame:
    """(rel_a, rel_b, title, width) for drawing: affinity to two places, and a width of its tenths, cut off."""
    return scores.select("rel_a", "rel_b", F.round("affinity", 2).alias("title"), (F.col("affinity") * 10).cast("int").alias("width"))
