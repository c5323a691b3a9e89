"""Exchange formats: relation JSON, a subset of Turtle, property-graph CSV."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import IRI_BASE, W3, denormalize_iri, entity_iri

RDF = W3 + "1999/02/22-rdf-syntax-ns#"
_TURTLE = re.compile(r'"""(.*?)"""(?:@[\w-]+|\^\^\S+)?|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^[^\s;,.]+)?|<([^>]*)>|(@prefix|@base|[^\s;,."<>]*:[^\s;,"<>]*[^\s;,."<>]|[^\s;,."<>]*:|\ba\b)|([;,.])|#[^\n]*', re.S)


def relation_json(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Triples (ord, src, rel, dst) and published scores (rel_a, rel_b, expected) of {rels, ents: {src: [[rel, dst]]}, scores}.

    A relation that rels doesn't list is a ValueError. Repeated triples and self-loops are left to distinct_triples.
    """
    data = json.loads(text)
    rels = data.get("rels", [])
    rows = [(src, rel, dst) for src, out in data.get("ents", {}).items() for rel, dst in out]
    unknown = sorted({rel for _, rel, _ in rows} - set(rels))
    if unknown:
        raise ValueError(f"relations not listed: {', '.join(unknown)}")
    triples = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, src string, rel string, dst string")
    scores = [(*sorted((rels[int(a)], rels[int(b)])), float(s)) for a, b, s in data.get("scores", [])]
    return triples, spark.createDataFrame(scores, "rel_a string, rel_b string, expected double")


def turtle_triples(text: str) -> list[tuple[str, str, str]]:
    """(subject, predicate, object) of Turtle without blank nodes and collections; prefixes and base are resolved."""
    prefixes: dict[str, str] = {"rdf": RDF}
    base, out, part, directive = "", [], [], None

    def iri(name: str) -> str:
        prefix, _, rest = name.partition(":")
        return prefixes.get(prefix, prefix + ":") + rest

    for m in _TURTLE.finditer(text):
        long, short, full, name, mark = m.groups()
        if mark is None and long is None and short is None and full is None and name is None:
            continue
        if name in ("@prefix", "@base"):
            directive = name
            continue
        if directive == "@prefix" and name:
            part.append(name.rstrip(":"))
        elif directive and full is not None:
            if directive == "@base":
                base = full
            else:
                prefixes[part[0]] = full if "://" in full or not base else base + full
        elif directive and mark == ".":
            directive, part = None, []
        elif mark:
            if len(part) == 3:
                out.append(tuple(part))
            part = {".": [], ";": part[:1], ",": part[:2]}[mark]
        elif full is not None:
            part.append(full if "://" in full or not base else base + full)
        elif name == "a":
            part.append(prefixes["rdf"] + "type")
        elif name:
            part.append(iri(name))
        else:
            part.append(long if long is not None else re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), short))
    return out


def bootstrap(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, kind, text, label, type) and edges (src, dst, rel, kind) of a Turtle vocabulary, all with count 0.

    Subjects and whatever they refer to are nodes; a node without skos:prefLabel is named by the end of its IRI. Nodes are in order of
    their IRIs. skos:broader edges are of kind syn, all others iri.
    """
    skos, rdf = W3 + "2004/02/skos/core#", RDF + "type"
    frame = spark.createDataFrame(turtle_triples(text), "subj string, pred string, obj string").distinct()
    named = lambda p: F.max(F.when(F.col("pred") == p, F.col("obj")))
    facts = frame.groupBy("subj").agg(named(skos + "prefLabel").alias("label"), named(skos + "definition").alias("text"), named(rdf).alias("type"))
    links = frame.where(~F.col("pred").isin(skos + "prefLabel", skos + "definition"))
    subjects = frame.select(F.col("subj").alias("key"))
    keys = subjects.unionByName(links.select(F.col("obj").alias("key"))).distinct()
    classes = links.where(F.col("pred") == rdf).select(F.col("obj").alias("key"), F.lit(True).alias("is_class")).distinct()
    nodes = keys.join(facts.withColumnRenamed("subj", "key"), "key", "left").join(classes, "key", "left")
    kind = F.when(F.col("is_class"), "iri").otherwise("ent")
    nodes = nodes.select("key", kind.alias("kind"), "text", F.coalesce("label", F.regexp_extract("key", r"([^/#]*)$", 1)).alias("label"), "type", F.lit(0).cast("long").alias("count")).orderBy("key")
    edges = links.select(F.col("subj").alias("src"), F.col("obj").alias("dst"), F.col("pred").alias("rel"), F.when(F.col("pred") == skos + "broader", "syn").otherwise("iri").alias("kind"))
    return nodes, edges


def vocabulary_nodes(nodes: DataFrame, graph_ids: DataFrame, base: str = IRI_BASE) -> DataFrame:
    """Nodes of bootstrap() in the columns of the lemma graph, for each of graph_ids (graph_id): entities under the keys that texts give them."""
    key = F.when(F.col("kind") == "iri", F.col("key")).otherwise(denormalize_iri(F.col("key"), base))
    shown = nodes.select(key.alias("key"), "kind", F.when(F.col("kind") == "iri", RDF + "type").otherwise("PROPN").alias("pos"), F.when(F.col("kind") == "iri", F.coalesce("text", "label")).otherwise(F.col("label")).alias("text"), F.when(F.col("kind") == "iri", F.col("label")).otherwise(F.col("type")).alias("label"), "count", F.lit(False).alias("sub_obj"))
    return graph_ids.select("graph_id").distinct().crossJoin(F.broadcast(shown))  # a vocabulary, given as one text


def turtle_lines(triples: DataFrame) -> DataFrame:
    """(graph_id, line): one statement each, of rdf_triples."""
    return triples.select("graph_id", F.concat(F.lit("<"), "subj", F.lit("> "), "pred", F.lit(" "), "obj", F.lit(" .")).alias("line"))


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str], base: str = "") -> None:
    """One statement a line; triples as of rdf_triples. The base and the prefixes come first in every file, so that each is whole."""
    head = (f"@base <{base}> .\n" if base else "") + "".join(f"@prefix {p}: <{iri}> .\n" for p, iri in sorted(prefixes.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([head.rstrip("\n")])], names=["value"])
            yield batch

    turtle_lines(triples).select(F.col("line").alias("value")).mapInArrow(run, "value string").write.mode("append").text(path)


def property_graph(nodes: DataFrame, edges: DataFrame, base: str = IRI_BASE) -> tuple[DataFrame, DataFrame]:
    """Rows of a property graph's files: nodes (id, iri, weight, kind, key, label, text, pos, length, count) of those with an IRI, edges (src, dst, rel, prob, kind, count) between such, by id.

    nodes need node_id, length and weight.
    """
    keep = (F.col("kind") == "iri") | (F.col("kind").isin("ent", "lem") & (F.col("pos") != "VERB"))
    iri = F.when(F.col("kind") == "iri", F.col("key")).otherwise(entity_iri(F.col("key"), base))
    kept = nodes.where(keep).select("graph_id", F.col("node_id").alias("id"), iri.alias("iri"), F.col("weight").cast("float").alias("weight"), "kind", "key", "label", "text", "pos", F.col("length").cast("int").alias("length"), "count")
    ends = kept.select("graph_id", "key", "id")
    met = edges.join(ends.toDF("graph_id", "src", "from"), ["graph_id", "src"]).join(ends.toDF("graph_id", "dst", "to"), ["graph_id", "dst"])
    return kept, met.select("graph_id", F.col("from").alias("src"), F.col("to").alias("dst"), "rel", F.col("prob").cast("float").alias("prob"), "kind", "count")


def write_property_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and edges of exported() or property_graph() as CSV without header, a folder each."""
    nodes.write.csv(path + "/nodes", header=False)
    edges.write.csv(path + "/edges", header=False)


def zip_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, archive): nodes.csv and edges.csv of property_graph() of each graph, without header, as a ZIP file."""

    def packed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, table, order in (("nodes.csv", left, "id"), ("edges.csv", right, "src")):
                rows = io.StringIO()
                csv.writer(rows, lineterminator="\n").writerows(zip(*(c.to_pylist() for c in table.drop(["graph_id"]).sort_by(order).columns)))
                archive.writestr(zipfile.ZipInfo(name), rows.getvalue())
        return pa.table({"graph_id": pa.array([key[0].as_py()], pa.int64()), "archive": pa.array([out.getvalue()], pa.binary())})

    return nodes.groupBy("graph_id").cogroup(edges.toDF(*edges.columns).groupBy("graph_id")).applyInArrow(packed, "graph_id long, archive binary")
