"""Entity pairs within reach of each other, term frequencies, communities, styles."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Nodes of a path at most; hops are one fewer.
MAX_NODES = 11
#: (kind, shape, color)
STYLES = [("dep", "star", "gray"), ("lem", "square", "olive"), ("ent", "circle", "orange"), ("chu", "triangle", "teal"), ("iri", "diamond", "tan")]
#: (kind, arrows, color, width); others have none.
EDGE_STYLES = [("dep", "to", "ltgray", 0), ("inf", "to", "hsl(289, 17%, 49%)", 3), ("syn", "from", "hsl(55, 17%, 49%)", 2)]


def distances(edges: dict[str, set[str]], start: str, most: int) -> dict[str, int]:
    """Hops from start to all nodes within most hops, edges taken both ways."""
    seen, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        if seen[at] < most:
            for to in edges.get(at, ()):
                if to not in seen:
                    seen[to] = seen[at] + 1
                    queue.append(to)
    return seen


def near_pairs(pairs: DataFrame, toks: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(graph_id, para_id, src, dst, n, hops): the pairs joined by a path of at most max_nodes nodes in their paragraph."""
    place = ["graph_id", "para_id"]
    heads = toks.select(*place, "sent_id", F.col("tok_i").alias("head_i"), F.col("key").alias("dst"))
    edges = toks.select(*place, "sent_id", "head_i", F.col("key").alias("src")).join(heads, [*place, "sent_id", "head_i"]).where("src <> dst")
    wanted = pairs.select(*place).distinct()
    both = edges.join(wanted, place, "left_semi").select(*place, "src", "dst", F.lit(None).cast("long").alias("n")).unionByName(pairs.select(*place, "src", "dst", "n"))

    def run(table: pa.Table) -> pa.Table:
        links: dict[str, set[str]] = {}
        asked: dict[str, list[tuple[str, int]]] = {}
        for a, b, n in zip(*(table[c].to_pylist() for c in ("src", "dst", "n"))):
            if n is None:
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
            else:
                asked.setdefault(a, []).append((b, n))
        out = []
        for a, to in asked.items():
            reach = distances(links, a, max_nodes - 1)
            out += [(a, b, n, reach[b]) for b, n in to if b in reach]
        columns = list(zip(*out)) or [()] * 4
        key = [pa.array([table[c][0].as_py()] * len(out), t) for c, t in (("graph_id", pa.int64()), ("para_id", pa.int32()))]
        return pa.Table.from_arrays([*key, *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int32())))], names=["graph_id", "para_id", "src", "dst", "n", "hops"])

    typed = both.withColumn("graph_id", F.col("graph_id").cast("long")).withColumn("para_id", F.col("para_id").cast("int"))
    return typed.groupBy(*place).applyInArrow(run, "graph_id long, para_id int, src string, dst string, n long, hops int")


def term_frequencies(nodes: DataFrame, weight: str = "count") -> DataFrame:
    """(graph_id, term, frequency): weights scaled to 1000 for the greatest of each graph. Of equal terms, the last node counts, by node_id where nodes have one; else the greatest."""
    top = nodes.groupBy("graph_id").agg(F.max(weight).alias("top"))
    scaled = F.bround(F.col(weight).cast("double") / F.col("top") * 1000).cast("int")
    one = F.max_by(scaled, "node_id") if "node_id" in nodes.columns else F.max(scaled)
    return nodes.join(top, "graph_id").groupBy("graph_id", F.translate("text", " ", "_").alias("term")).agg(one.alias("frequency"))


def styled(nodes: DataFrame) -> DataFrame:
    """(graph_id, key, shape, color, size, value, title, name) for drawing."""
    styles = nodes.sparkSession.createDataFrame(STYLES, "kind string, shape string, color string")
    value = F.when(F.col("kind").isin("chu", "iri"), 0.0).otherwise(F.col("weight"))
    title = F.when(F.col("kind") == "iri", F.col("text")).otherwise(F.col("key"))
    name = F.when(F.col("kind") == "iri", S.normalize_prefix(F.col("key"))).otherwise(S.display_label(F.col("kind"), F.col("text"), F.col("label")))
    return nodes.join(F.broadcast(styles), "kind").select("graph_id", "key", "shape", "color", F.col("count").alias("size"), value.alias("value"), title.alias("title"), name.alias("name"))


def styled_edges(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, title, arrows, color, width) for drawing, one for all edges between two nodes: the last that the graph got, by kind (classes, dependencies, chunks, then what was linked or inferred) and relation."""
    late = F.when(F.col("kind") == "iri", 0).when(F.col("kind") == "dep", 1).when(F.col("kind") == "chu", 2).when(F.col("kind") == "syn", 3).otherwise(4)
    last = edges.groupBy("graph_id", "src", "dst").agg(F.max(F.struct(late.alias("late"), "rel", "kind")).alias("e"))
    return styled_last(last.select("graph_id", "src", "dst", "e.rel", "e.kind"))


def styled_last(last: DataFrame) -> DataFrame:
    """styled_edges() of edges of which there is one for any two nodes."""
    styles = last.sparkSession.createDataFrame(EDGE_STYLES, "kind string, arrows string, color string, width int")
    return last.select("graph_id", "src", "dst", F.col("rel").alias("title"), "kind").join(F.broadcast(styles), "kind", "left").select("graph_id", "src", "dst", "title", "arrows", "color", "width")


def _components(links: dict[int, set[int]], n: int) -> list[list[int]]:
    seen, out = [False] * n, []
    for s in range(n):
        if not seen[s]:
            part, stack = [], [s]
            seen[s] = True
            while stack:
                at = stack.pop()
                part.append(at)
                for to in links[at]:
                    if not seen[to]:
                        seen[to] = True
                        stack.append(to)
            out.append(sorted(part))
    return sorted(out)


def betweenness(links: dict[int, set[int]], n: int) -> dict[tuple[int, int], float]:
    """Edge betweenness of an undirected graph without weights."""
    score: dict[tuple[int, int], float] = {}
    for s in range(n):
        order, before, count, depth = [], {s: []}, np.zeros(n), {s: 0}
        count[s] = 1
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in links[v]:
                if w not in depth:
                    depth[w], before[w] = depth[v] + 1, []
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    count[w] += count[v]
                    before[w].append(v)
        flow = np.zeros(n)
        for w in reversed(order):
            for v in before[w]:
                part = count[v] / count[w] * (1 + flow[w])
                score[min(v, w), max(v, w)] = score.get((min(v, w), max(v, w)), 0) + part
                flow[v] += part
    return score


def split_communities(n: int, edges: set[tuple[int, int]], splits: int = 2) -> list[list[int]]:
    """Girvan-Newman: remove the edge of greatest betweenness until the graph has fallen apart splits times more."""
    links: dict[int, set[int]] = {v: set() for v in range(n)}
    for a, b in edges:
        if a != b:
            links[a].add(b)
            links[b].add(a)
    parts = _components(links, n)
    for _ in range(splits):
        target = len(parts)
        while len(parts) == target:
            score = betweenness(links, n)
            if not score:
                return parts
            a, b = max(sorted(score), key=lambda e: round(score[e], 9))
            links[a].discard(b)
            links[b].discard(a)
            parts = _components(links, n)
    return parts


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, key, community) of the second split of each graph, whatever its size: each edge taken out costs nodes times edges."""
    both = nodes.select("graph_id", F.col("key").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges.select("graph_id", "src", "dst")).withColumn("graph_id", F.col("graph_id").cast("long"))

    def run(table: pa.Table) -> pa.Table:
        pairs = list(zip(table["src"].to_pylist(), table["dst"].to_pylist()))
        keys = sorted({a for a, b in pairs if b is None})
        at = {k: i for i, k in enumerate(keys)}
        links = {(at[a], at[b]) for a, b in pairs if b is not None}
        parts = split_communities(len(keys), links)
        of = {i: c for c, part in enumerate(parts) for i in part}
        return pa.Table.from_arrays([pa.array([table["graph_id"][0].as_py()] * len(keys), pa.int64()), pa.array(keys, pa.string()), pa.array([of[i] for i in range(len(keys))], pa.int32())], names=["graph_id", "key", "community"])

    return both.groupBy("graph_id").applyInArrow(run, "graph_id long, key string, community int")
