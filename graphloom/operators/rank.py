"""Ranking: weighted PageRank per graph, quantile stripes, entity-first restacking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

ALPHA = 0.85
#: Places of PageRank that count for stripes: equal ranks, summed up in another order, stay equal.
PLACES = 12


def power_iteration(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, alpha: float = ALPHA, tolerance: float = 1e-6, rounds: int = 100) -> np.ndarray:
    """PageRank of a directed multigraph; dangling mass and teleports are uniform."""
    out = np.bincount(src, weights=weight, minlength=n)
    share = weight / out[src] if len(src) else weight
    dangling = out == 0
    rank = np.full(n, 1 / n) if n else np.zeros(0)
    for _ in range(rounds):
        last = rank
        rank = alpha * (np.bincount(dst, weights=last[src] * share, minlength=n) + last[dangling].sum() / n) + (1 - alpha) / n
        if np.abs(rank - last).sum() < n * tolerance:
            return rank
    raise ArithmeticError(f"no convergence in {rounds} rounds")


def power_iterations(graph: np.ndarray, graphs: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, alpha: float = ALPHA, tolerance: float = 1e-6, rounds: int = 100) -> np.ndarray:
    """power_iteration() of several graphs at once; graph: of each node, edges join nodes of one graph. Each graph stops by itself."""
    n = np.bincount(graph, minlength=graphs)
    size = n[graph]
    out = np.bincount(src, weights=weight, minlength=len(graph))
    share = weight / out[src] if len(src) else weight
    dangling = out == 0
    rank = 1 / size
    live = n > 0
    for _ in range(rounds):
        lost = np.bincount(graph[dangling], weights=rank[dangling], minlength=graphs)
        now = alpha * (np.bincount(dst, weights=rank[src] * share, minlength=len(graph)) + lost[graph] / size) + (1 - alpha) / size
        moved = np.bincount(graph, weights=np.abs(now - rank), minlength=graphs)
        rank = np.where(live[graph], now, rank)
        live &= moved >= n * tolerance
        if not live.any():
            return rank
    raise ArithmeticError(f"no convergence in {rounds} rounds")


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(graph_id, key, pagerank); each graph in one task, all graphs in parallel."""
    both = nodes.select("graph_id", F.col("key").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("w")).unionByName(edges.select("graph_id", "src", "dst", F.col("count").cast("double").alias("w")))

    def run(table: pa.Table) -> pa.Table:
        src, dst, w = (table[c].to_numpy(zero_copy_only=False) for c in ("src", "dst", "w"))
        is_node = table["dst"].is_null().to_numpy(zero_copy_only=False)
        keys, at = np.unique(src[is_node].astype(str), return_inverse=True)
        a, b = (np.searchsorted(keys, x[~is_node].astype(str)) for x in (src, dst))
        rank = power_iteration(len(keys), a, b, w[~is_node], alpha)
        return pa.Table.from_arrays([pa.array([table["graph_id"][0].as_py()] * len(keys), pa.int64()), pa.array(keys.tolist()), pa.array(rank)], names=["graph_id", "key", "pagerank"])

    return both.withColumn("graph_id", F.col("graph_id").cast("long")).groupBy("graph_id").applyInArrow(run, "graph_id long, key string, pagerank double")


def _scaled(values: str, top: str) -> Column:
    return F.transform(values, lambda v: F.try_divide(v, F.col(top)))


def restack(frame: DataFrame) -> DataFrame:
    """(graph_id, key, weight) from (graph_id, key, kind, pos, count, neighbors, sub_obj, pagerank).

    Four columns are normalised, striped by quantiles and combined by their root mean square; entities
    are scaled to come before all else by the closed form of the linear programme. A graph without
    ranked entities, or with nothing else ranked, keeps its PageRank.
    """
    used = S.stacked_count(F.col("pos"), F.col("kind"), F.col("count"))
    flat = frame.withColumn("used", used.cast("double")).withColumn("pr", F.when(F.col("used") < 1, 0.0).otherwise(F.col("pagerank"))).withColumn("hood", F.col("neighbors").cast("double")).withColumn("so", F.col("sub_obj").cast("double"))
    names = ("pr", "used", "hood", "so")
    tops = flat.groupBy("graph_id").agg(F.count("*").alias("n"), *(F.max(c).alias("max_" + c) for c in names), *(F.sort_array(F.collect_list(c)).alias("all_" + c) for c in names))
    for c in names:
        tops = tops.withColumn("q_" + c, S.nearest_quantiles(_scaled("all_" + c, "max_" + c), F.col("n")))
    joined = flat.join(tops.select("graph_id", *("max_" + c for c in names), *("q_" + c for c in names)), "graph_id")
    stripes = [S.stripe(F.try_divide(F.col(c), F.col("max_" + c)), F.col("q_" + c)) for c in names]
    joined = joined.withColumn("rms", F.when(F.col("used") < 1, 0.0).otherwise(S.root_mean_square(*stripes)))
    total = joined.groupBy("graph_id").agg(F.sum("rms").alias("total"))
    ranked = joined.join(total, "graph_id").withColumn("rank", F.coalesce(F.try_divide("rms", "total"), F.lit(0.0)))
    e, o = (F.col("kind") == "ent") & (F.col("rank") > 0), (F.col("kind") != "ent") & (F.col("rank") > 0)
    sums = ranked.groupBy("graph_id").agg(F.sum(F.when(e, F.col("rank"))).alias("sum_e"), F.sum(F.when(o, F.col("rank"))).alias("sum_l"), F.min(F.when(e, F.col("rank"))).alias("min_e"), F.max(F.when(o, F.col("rank"))).alias("max_l"))
    tight = F.col("max_l") >= F.col("min_e")
    d = F.col("sum_e") * F.col("max_l") + F.col("sum_l") * F.col("min_e")
    same = 1 / (F.col("sum_e") + F.col("sum_l") + F.col("min_e") - F.col("max_l"))
    sums = sums.select("graph_id", F.when(tight, F.col("max_l") / d).otherwise(same).alias("c0"), F.when(tight, F.col("min_e") / d).otherwise(same).alias("c1"))
    stacked = F.when(F.col("kind") == "ent", F.col("rank") * F.col("c0")).otherwise(F.col("rank") * F.col("c1"))
    return ranked.join(sums, "graph_id").select("graph_id", "key", F.coalesce(stacked, F.col("pagerank")).alias("weight"))


def restacked(graph: np.ndarray, graphs: int, ent: np.ndarray, used: np.ndarray, neighbors: np.ndarray, sub_obj: np.ndarray, pagerank: np.ndarray) -> np.ndarray:
    """restack() on arrays, of several graphs at once; used: the stacked counts."""
    order = np.argsort(graph, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(graph, minlength=graphs))])
    stripes = []
    for c in (np.where(used < 1, 0.0, pagerank), used.astype(float), neighbors.astype(float), sub_obj.astype(float)):
        stripe = np.empty(len(graph))
        for lo, hi in zip(begin[:-1], begin[1:]):
            if lo == hi:
                continue
            own, n = c[order[lo:hi]], int(hi - lo)
            top = own.max()
            if top == 0:
                stripe[order[lo:hi]] = -1
                continue
            x = own / top
            m = max(int(np.rint(np.log(n) * 4)), 1)
            bins = np.arange(m) * (1.0 / (m - 1)) if m > 1 else np.zeros(1)
            bins[-1] = 1.0 if m > 1 else 0.0
            at = np.rint(bins * 100 / 100 * (n - 1)).astype(int)
            stripe[order[lo:hi]] = np.searchsorted(np.sort(x)[at], x, "right") - 1
        stripes.append(stripe)
    rms = np.where(used < 1, 0.0, np.sqrt(sum(s * s for s in stripes) / len(stripes)))
    total = np.bincount(graph, weights=rms, minlength=graphs)
    with np.errstate(divide="ignore", invalid="ignore"):
        rank = np.where(total[graph] == 0, 0.0, rms / total[graph])
        e, o = ent & (rank > 0), ~ent & (rank > 0)
        sum_e, sum_l = (np.bincount(graph[k], weights=rank[k], minlength=graphs) for k in (e, o))
        min_e, max_l = np.full(graphs, np.inf), np.full(graphs, -np.inf)
        np.minimum.at(min_e, graph[e], rank[e])
        np.maximum.at(max_l, graph[o], rank[o])
        tight = max_l >= min_e
        d = sum_e * max_l + sum_l * min_e
        same = 1 / (sum_e + sum_l + min_e - max_l)
        c0, c1 = np.where(tight, max_l / d, same), np.where(tight, min_e / d, same)
        stacked = np.where(ent, rank * c0[graph], rank * c1[graph])
    whole = np.isfinite(min_e) & np.isfinite(max_l)
    return np.where(whole[graph], stacked, pagerank)


def phrases(nodes: DataFrame, edges: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(graph_id, key, text, pos, label, count, weight, rank) of all nodes of positive weight, best first in each graph.

    Equal weights go by node_id, and it is listed, where nodes have one; else by key.
    """
    from .textgraph import out_degree  # it imports docgraph, which ranks as well

    frame = nodes.join(out_degree(nodes, edges), ["graph_id", "key"]) if "neighbors" not in nodes.columns else nodes
    ids = ["node_id"] if "node_id" in nodes.columns else []
    ranks = pagerank(nodes, edges, alpha).withColumn("pagerank", F.round("pagerank", PLACES))
    weighed = restack(frame.join(ranks, ["graph_id", "key"])).where("weight > 0")
    listed = nodes.select("graph_id", "key", *ids, "text", "pos", "label", "count").join(weighed, ["graph_id", "key"])
    return listed.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("weight"), *(ids or ["key"]))))
