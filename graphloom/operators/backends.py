"""What the graph is made with, each part exchangeable: a language backend, a knowledge graph, extractors of relations.

A backend takes DataFrames and returns DataFrames; models run on Arrow batches, made once for each worker's run over a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import linking, paths, textgraph

TOKEN_COLUMNS = "graph_id long, para_id int, sent_id int, tok_i int, text string, lemma string, pos string, kind string, key string, ent_label string, head_i int, dep string"
TRIPLE_COLUMNS = "graph_id long, para_id int, sent_id int, head string, rel string, tail string, prob double"


class LanguageBackend(Protocol):
    def tokens(self, docs: DataFrame) -> DataFrame:
        """Tokens, in TOKEN_COLUMNS, of docs (doc_id, text)."""


class KnowledgeGraph(Protocol):
    def remap_ner(self, label: Column) -> Column: ...

    def normalize_prefix(self, iri: Column) -> Column: ...

    def links(self, nodes: DataFrame) -> DataFrame | None:
        """(graph_id, key, iri, prob, name) for entity nodes; None for no linking."""

    def relation_iris(self, relations: DataFrame) -> DataFrame:
        """(rel, iri) of relations (rel)."""


class RelationExtractor(Protocol):
    def triples(self, toks: DataFrame) -> DataFrame:
        """Relations, in TRIPLE_COLUMNS, between texts of tokens of one sentence."""


class RuleLanguage:
    """The rules of textgraph."""

    def tokens(self, docs: DataFrame) -> DataFrame:
        return textgraph.tokens(docs)


@dataclass
class ModelLanguage:
    """A parser of any kind: make() gives a function from a text to its tokens, dictionaries of TOKEN_COLUMNS without graph_id. It is made once for each partition.

    entities, where given, makes a function from a text to {(para_id, sent_id, tok_i): label}, whose labels take the place of the parser's.
    """

    make: Callable[[], Callable[[str], list[dict[str, Any]]]]
    entities: Callable[[], Callable[[str], dict[tuple[int, int, int], str]]] | None = None

    def tokens(self, docs: DataFrame) -> DataFrame:
        make, entities = self.make, self.entities
        names = [c.split()[0] for c in TOKEN_COLUMNS.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in TOKEN_COLUMNS.split(", ")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parse, label = make(), entities() if entities else None
            for batch in batches:
                rows = []
                for graph_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    own = label(text) if label else None
                    for t in parse(text):
                        t = {"graph_id": graph_id, **t}
                        if own is not None:
                            t["ent_label"] = own.get((t["para_id"], t["sent_id"], t["tok_i"]))
                        rows.append({c: t.get(c) for c in names})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKEN_COLUMNS)


class NoKnowledge:
    """Labels, IRIs and relations as they are; no links."""

    def remap_ner(self, label: Column) -> Column:
        return label

    def normalize_prefix(self, iri: Column) -> Column:
        return iri

    def links(self, nodes: DataFrame) -> DataFrame | None:
        return None

    def relation_iris(self, relations: DataFrame) -> DataFrame:
        return relations.select("rel", F.col("rel").alias("iri")).distinct()


@dataclass
class TableKnowledge:
    """Dimension tables in place of services: entities (iri, label, aliases), relations (rel, equivalent, broader), annotations (text, iri, similarity) and a second source of entities."""

    entities: DataFrame
    relations: DataFrame
    spotted: DataFrame | None = None
    secondary: DataFrame | None = None
    source: str = "rel"
    classes: list[tuple[str, str, str, str]] = field(default_factory=lambda: list(S.NER_CLASSES))
    prefixes: list[tuple[str, str]] = field(default_factory=lambda: list(S.PREFIXES))
    min_alias: float = linking.MIN_ALIAS
    min_similarity: float = linking.MIN_SIMILARITY

    def remap_ner(self, label: Column) -> Column:
        return S.remap_ner(label, self.classes)

    def normalize_prefix(self, iri: Column) -> Column:
        return S.normalize_prefix(iri, self.prefixes)

    def links(self, nodes: DataFrame) -> DataFrame | None:
        if self.spotted is None:
            found = linking.link_entities(nodes, self.entities, self.min_alias)
        else:
            first = linking.link_spotted(nodes, self.spotted, self.entities, self.min_similarity, self.min_alias)
            found = first.unionByName(linking.link_entities(linking.unlinked(nodes, first), self.entities, self.min_alias))
        return found if self.secondary is None else found.unionByName(linking.link_secondary(found, self.secondary, self.min_similarity))

    def relation_iris(self, relations: DataFrame) -> DataFrame:
        return linking.resolve_relations(relations, self.relations, self.source)


@dataclass
class VerbRelations:
    """The first verb between an entity and the next one of its sentence relates them; the further apart, the less sure."""

    loss: float = 0.002

    def triples(self, toks: DataFrame) -> DataFrame:
        after = Window.partitionBy("graph_id", "para_id", "sent_id").orderBy(F.desc("tok_i")).rowsBetween(Window.unboundedPreceding, -1)
        verb, ent = F.when(F.col("pos") == "VERB", F.col("tok_i")), F.when(F.col("kind") == "ent", F.col("tok_i"))
        # going backwards, the last seen is the next one
        seen = toks.select("graph_id", "para_id", "sent_id", "tok_i", "text", "kind", F.min(verb).over(after).alias("verb"), F.min_by("lemma", verb).over(after).alias("rel"), F.min(ent).over(after).alias("next"), F.min_by("text", ent).over(after).alias("tail"))
        met = seen.where("kind = 'ent' and verb < next")
        return met.select("graph_id", "para_id", "sent_id", F.col("text").alias("head"), "rel", "tail", (1 - self.loss * (F.col("next") - F.col("tok_i"))).alias("prob"))


@dataclass
class PairRelations:
    """A classifier of pairs: make() gives a function from [(paragraph, head, tail)] to [(relation, probability)]. It sees the entity pairs joined by at most max_nodes nodes."""

    make: Callable[[], Callable[[list[tuple[str, str, str]]], list[tuple[str, float]]]]
    max_nodes: int = paths.MAX_NODES

    def triples(self, toks: DataFrame) -> DataFrame:
        make = self.make
        ents = toks.where("kind = 'ent'").groupBy("graph_id", "para_id", "key").agg(F.min_by(F.struct("text", "sent_id"), F.struct("sent_id", "tok_i")).alias("e"))
        near = paths.near_pairs(textgraph.entity_pairs(toks), toks, self.max_nodes)
        paras = toks.groupBy("graph_id", "para_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "tok_i", "text"))).alias("t")).select("graph_id", "para_id", F.array_join(F.transform("t", lambda t: t["text"]), " ").alias("para"))
        both = near.join(ents.toDF("graph_id", "para_id", "src", "h"), ["graph_id", "para_id", "src"]).join(ents.toDF("graph_id", "para_id", "dst", "t"), ["graph_id", "para_id", "dst"]).join(paras, ["graph_id", "para_id"])
        asked = both.select("graph_id", "para_id", F.col("h.sent_id").alias("sent_id"), F.col("h.text").alias("head"), F.col("t.text").alias("tail"), "para")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classify = make()
            for batch in batches:
                found = classify(list(zip(*(batch.column(c).to_pylist() for c in ("para", "head", "tail"))))) if batch.num_rows else []
                rel, prob = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("graph_id", "para_id", "sent_id", "head")), pa.array(rel, pa.string()), batch.column("tail"), pa.array(prob, pa.float64())], names=[c.split()[0] for c in TRIPLE_COLUMNS.split(", ")])

        return asked.mapInArrow(run, TRIPLE_COLUMNS)


@dataclass
class TaggedRelations:
    """A generator of tagged text: make() gives a function from sentences to texts that parse_triplets reads."""

    make: Callable[[], Callable[[list[str]], list[str]]]

    def triples(self, toks: DataFrame) -> DataFrame:
        make = self.make
        sents = toks.groupBy("graph_id", "para_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("tok_i", "text"))).alias("t"))
        sents = sents.select("graph_id", "para_id", "sent_id", F.array_join(F.transform("t", lambda t: t["text"]), " ").alias("sent"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            generate = make()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("graph_id", "para_id", "sent_id")), pa.array(generate(batch.column("sent").to_pylist()), pa.string())], names=["graph_id", "para_id", "sent_id", "said"])

        said = sents.mapInArrow(run, "graph_id long, para_id int, sent_id int, said string")
        each = said.select("graph_id", "para_id", "sent_id", F.explode(S.parse_triplets("said")).alias("r"))
        return each.select("graph_id", "para_id", "sent_id", "r.head", "r.rel", "r.tail", F.lit(1.0).alias("prob"))


@dataclass
class Extraction:
    """All parts and thresholds, and what they make of documents."""

    language: LanguageBackend = field(default_factory=RuleLanguage)
    knowledge: KnowledgeGraph = field(default_factory=NoKnowledge)
    relations: list[RelationExtractor] = field(default_factory=list)
    min_relation: float = linking.MIN_RELATION

    def graph(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges: tokens, chunks, classes, links and relations; lemmas without a label are things."""
        toks = self.language.tokens(docs)
        nodes, edges = textgraph.lemma_graph(toks)
        if (links := self.knowledge.links(nodes)) is not None:
            more, to = linking.link_nodes(links)
            nodes, edges = nodes.unionByName(more.join(nodes.select("graph_id", "key"), ["graph_id", "key"], "left_anti")), edges.unionByName(to)
        for extractor in self.relations:
            found = extractor.triples(toks)
            iris = self.knowledge.relation_iris(found.select("rel"))
            named = found.join(iris, "rel").select("graph_id", "para_id", "sent_id", "head", F.col("iri").alias("rel"), "tail", "prob")
            edges = edges.unionByName(linking.inferred_edges(named, toks, self.min_relation))
        return textgraph.default_labels(nodes), edges


def triples_view(triples: DataFrame, name: str = "triples") -> None:
    """Triples (subj, pred, obj) as a view, for queries in SQL."""
    triples.select("subj", "pred", "obj").createOrReplaceTempView(name)
