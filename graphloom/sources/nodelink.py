"""Node-link JSON of a graph, one line each graph: written from nodes and edges and read back without loss."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pajson
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.textgraph import LOC

#: Fields of a node and of a link in the JSON.
NODE = "lemma:string,count:bigint,weight:double,kind:string,label:string,name:string,subobj:boolean,pos:string,loc:" + LOC + ",length:int,hood:bigint,anno:boolean,iri:string"
LINK = "kind:string,title:string,lemma:string,weight:double,prob:double,count:bigint,source:bigint,target:bigint"
SCHEMA = f"struct<directed:boolean,multigraph:boolean,nodes:array<struct<{NODE}>>,links:array<struct<{LINK}>>>"
#: What nodes without these columns count as.
DEFAULTS = {"weight": "0.0D", "length": "size(split(text, ' '))", "loc": f"cast(array() as {LOC})", "neighbors": "0L", "annotated": "kind = 'ent' and label is not null", "node_id": "cast(null as bigint)"}


def dump(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, json): nodes in order of their ids (of their keys, where they have none), links by the positions of their ends.

    label is what a node is drawn with, iri the IRI of a class or of what a node is labelled with; weight of a link is its count.
    """
    full = nodes.selectExpr("*", *(f"{sql} as {c}" for c, sql in DEFAULTS.items() if c not in nodes.columns))
    kind, key, text, label = (F.col(c) for c in ("kind", "key", "text", "label"))
    shown = F.when(kind == "iri", S.normalize_prefix(label)).otherwise(S.display_label(kind, text, label))
    fields = [key.alias("lemma"), "count", "weight", "kind", shown.alias("label"), text.alias("name"), F.col("sub_obj").alias("subobj"), "pos", "loc", "length", F.col("neighbors").alias("hood"), F.col("annotated").alias("anno"), S.node_iri(kind, key, label).alias("iri")]
    listed = full.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "key", F.struct(*fields).alias("n")))).alias("nodes"))
    place = listed.select("graph_id", F.posexplode("nodes").alias("at", "n")).select("graph_id", F.col("at").cast("long").alias("at"), F.col("n.key").alias("key"))
    ends = edges.join(place.toDF("graph_id", "source", "src"), ["graph_id", "src"]).join(place.toDF("graph_id", "target", "dst"), ["graph_id", "dst"])
    link = F.struct("kind", F.col("rel").alias("title"), S.edge_key(F.col("source"), F.col("target"), F.col("rel"), F.col("kind")).alias("lemma"), F.col("count").cast("double").alias("weight"), "prob", "count", "source", "target")
    links = ends.groupBy("graph_id").agg(F.array_sort(F.collect_list(link)).alias("links"))
    both = listed.select("graph_id", F.transform("nodes", lambda x: x["n"]).alias("nodes")).join(links, "graph_id", "left")
    both = both.withColumn("links", F.coalesce("links", F.from_json(F.lit("[]"), f"array<struct<{LINK}>>")))
    return both.select("graph_id", F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), "nodes", "links")).alias("json"))


def load(dumped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of dump(). The label of an entity is its IRI again, that of a class the one it is drawn with."""
    kind = dumped.schema["graph_id"].dataType.simpleString()
    rows = dumped.select("graph_id", "json").where("json is not null")
    return rows.mapInArrow(_node_rows, f"graph_id {kind}, {NODES}"), rows.mapInArrow(_edge_rows, f"graph_id {kind}, {EDGES}")


NODES = "node_id bigint, key string, kind string, pos string, text string, label string, count bigint, sub_obj boolean, weight double, length int, loc " + LOC + ", neighbors bigint, annotated boolean"
EDGES = "src string, dst string, rel string, kind string, prob double, count bigint"
#: Bytes of JSON that are parsed at once.
SLICE = 8 << 20
_LOC = pa.list_(pa.struct([("para_id", pa.int32()), ("sent_id", pa.int32()), ("tok_i", pa.int32())]))
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}


def _fields(ddl: str) -> pa.StructType:
    return pa.struct([(name, _LOC if name == "loc" else _TYPES[kind]) for name, kind in (f.split(":", 1) for f in ddl.replace(LOC, "loc").split(","))])


def _parsed(batches: Iterator[pa.RecordBatch], want: str) -> Iterator[tuple[pa.Array, pa.Table]]:
    """Ids of graphs and their JSON in columns, a slice at a time; text that is no such JSON is a graph without nodes and links."""
    schema = pa.schema([("nodes", pa.list_(_fields(NODE) if want == "nodes" else pa.struct([("lemma", pa.string())]))), *([("links", pa.list_(_fields(LINK)))] if want == "links" else [])])

    def read(texts: pa.Array) -> pa.Table:
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")
        return pajson.read_json(pa.BufferReader(lines.buffers()[2]), pajson.ReadOptions(use_threads=False, block_size=lines.buffers()[2].size + 1), pajson.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore"))

    def one(text: str) -> pa.Table:
        try:
            found = read(pa.array([text.replace("\n", " ").replace("\r", " ")]))
            if found.num_rows == 1:
                return found
        except pa.ArrowInvalid:
            pass
        return pa.table([pa.array([None], f.type) for f in schema], schema=schema)

    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        lo, total = 0, 0
        for hi in range(len(sizes) + 1):
            if hi == len(sizes) or total and total + sizes[hi] > SLICE:
                ids, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                lo, total = hi, 0
                if not len(texts):
                    continue
                try:
                    found = read(texts)
                    if found.num_rows != len(texts):
                        raise pa.ArrowInvalid("not a graph a line")
                except pa.ArrowInvalid:
                    found = pa.concat_tables([one(x) for x in texts.to_pylist()])
                yield ids, found.combine_chunks()
            if hi < len(sizes):
                total += sizes[hi]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.StructArray]:
    """How many elements each list has, and all of them."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, found in _parsed(batches, "nodes"):
        n, x = _flat(found["nodes"])
        c = {f.name: pc.struct_field(x, f.name) for f in x.type}
        at = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        label = pc.if_else(pc.fill_null(pc.equal(c["kind"], "iri"), False), c["label"], c["iri"])
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(at), c["lemma"], c["kind"], c["pos"], c["name"], label, c["count"], c["subobj"], c["weight"], c["length"], c["loc"], c["hood"], c["anno"]],
            names="graph_id node_id key kind pos text label count sub_obj weight length loc neighbors annotated".split(),
        )


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, found in _parsed(batches, "links"):
        n, x = _flat(found["nodes"])
        m, y = _flat(found["links"])
        lemma = pc.struct_field(x, "lemma")
        graph = np.repeat(np.arange(len(m)), m)

        def end(side: str) -> pa.Array:
            at = pc.struct_field(y, side)
            known = pc.fill_null(pc.and_(pc.greater_equal(at, 0), pc.less(at, pa.array(n[graph]))), False)
            return lemma.take(pc.if_else(known, pc.add(at, pa.array((np.cumsum(n) - n)[graph])), pa.scalar(None, pa.int64())))

        field = lambda name: pc.struct_field(y, name)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(graph)), end("source"), end("target"), field("title"), field("kind"), field("prob"), field("count")], names=["graph_id", "src", "dst", "rel", "kind", "prob", "count"])


def class_links(nodes: DataFrame) -> DataFrame:
    """Edges from the entities of loaded nodes to the classes they are labelled with, where a graph has these as nodes."""
    ent = (F.col("kind") == "ent") & F.col("label").isNotNull()
    picked = nodes.where((F.col("kind") == "iri") | ent).groupBy("graph_id")
    both = picked.agg(F.collect_set(F.when(F.col("kind") == "iri", F.col("key"))).alias("classes"), F.collect_list(F.when(ent, F.struct(F.col("key").alias("src"), F.col("label").alias("dst")))).alias("ents"))
    return both.select("graph_id", "classes", F.explode("ents").alias("e")).where(F.array_contains("classes", F.col("e.dst"))).select("graph_id", "e.src", "e.dst")
