"""Entity and relation linking by joins with local dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

MIN_ALIAS = 0.8
MIN_SIMILARITY = 0.9
MIN_RELATION = 0.9


def link_entities(nodes: DataFrame, entities: DataFrame, min_alias: float = MIN_ALIAS) -> DataFrame:
    """(graph_id, key, iri, prob, name): the best entity (iri, label, aliases) for the text of each entity node.

    Distinct lower-cased texts are looked up once, by equal label or alias, then scored; prob must be over min_alias. Of equally good
    entities, those labelled so come before those with such an alias, then the first IRI.
    """
    names = entities.select("*", F.explode(F.array_distinct(F.transform(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(x)))).alias("query"))
    asked = nodes.where("kind = 'ent' and text is not null").select(F.lower("text").alias("query")).distinct()
    hits = asked.join(names, "query").withColumn("hit", S.match_aliases("query", "label", "aliases"))
    best = hits.where(F.col("hit.prob") > min_alias).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("hit.prob"), F.lower("label") != F.col("query"), "iri"))).where("r = 1")
    found = best.select("query", "iri", F.col("hit.prob").alias("prob"), F.col("hit.name").alias("name"))
    return nodes.where("kind = 'ent'").withColumn("query", F.lower("text")).join(found, "query").select("graph_id", "key", "iri", "prob", "name")


def unlinked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Entity nodes that no link has."""
    return nodes.where("kind = 'ent'").join(links.select("graph_id", "key"), ["graph_id", "key"], "left_anti")


def link_spotted(nodes: DataFrame, spotted: DataFrame, entities: DataFrame, min_similarity: float = MIN_SIMILARITY, min_alias: float = MIN_ALIAS) -> DataFrame:
    """(graph_id, key, iri, prob, name) of proper nouns that an annotator spotted (text, iri, similarity), at least min_similarity, and whose
    text the entities have as well, over min_alias; the most similar, then the first IRI, of several."""
    known = link_entities(nodes.where("pos = 'PROPN'"), entities, min_alias).select("graph_id", "key", "name")
    best = spotted.where(F.col("similarity") >= min_similarity).groupBy(F.lower("text").alias("query")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "iri")).alias("b"))
    found = nodes.select("graph_id", "key", F.lower("text").alias("query")).join(best, "query").join(known, ["graph_id", "key"])
    return found.select("graph_id", "key", F.col("b.iri").alias("iri"), (-F.col("b.s")).alias("prob"), "name")


def link_all(nodes: DataFrame, entities: DataFrame, spotted: DataFrame | None = None) -> DataFrame:
    """Links of entity nodes: what an annotator spotted first, a search by name for the rest."""
    if spotted is None:
        return link_entities(nodes, entities)
    first = link_spotted(nodes, spotted, entities)
    return first.unionByName(link_entities(unlinked(nodes, first), entities))


def link_secondary(links: DataFrame, entities: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(graph_id, key, iri, prob, name): the entity of another source for the name of each link, over min_similarity; links without one are left out."""
    asked = links.select("graph_id", "key", F.lit("ent").alias("kind"), F.col("name").alias("text"))
    return link_entities(asked, entities, min_similarity)


def link_nodes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class-like nodes and edges for links, in the columns of the lemma graph."""
    nodes = links.groupBy("graph_id", "iri").agg(F.first("name").alias("name"), F.count("*").alias("count"))
    nodes = nodes.select("graph_id", F.col("iri").alias("key"), F.lit("iri").alias("kind"), F.lit("dbr").alias("pos"), F.col("name").alias("text"), F.col("iri").alias("label"), "count", F.lit(False).alias("sub_obj"))
    edges = links.select("graph_id", F.col("key").alias("src"), F.col("iri").alias("dst"), F.lit("linked").alias("rel"), F.lit("iri").alias("kind"), "prob", F.lit(1).cast("long").alias("count"))
    return nodes, edges


def resolve_relations(relations: DataFrame, dimension: DataFrame, source: str) -> DataFrame:
    """(rel, iri) of relations by a dimension (rel, equivalent, broader), else the relation's name in its source's namespace."""
    return relations.select("rel").distinct().join(dimension, "rel", "left").select("rel", S.relation_iri(F.coalesce("equivalent", "broader"), F.col("rel"), source).alias("iri"))


def equivalents(triples: DataFrame, within: str = "www.wikidata.org", most: int = 1000) -> DataFrame:
    """(iri, same): owl:sameAs objects that contain within, at most so many for each IRI."""
    same = triples.where(F.col("pred").endswith("sameAs") & F.contains("obj", F.lit(within))).select(F.col("subj").alias("iri"), F.col("obj").alias("same")).distinct()
    return same.withColumn("r", F.row_number().over(Window.partitionBy("iri").orderBy("same"))).where(F.col("r") <= most).drop("r")


def with_iris(found: DataFrame, dimension: DataFrame, source: str) -> DataFrame:
    """Relations under the IRIs of resolve_relations(), without another pass over them."""
    named = found.join(dimension, "rel", "left").withColumn("rel", S.relation_iri(F.coalesce("equivalent", "broader"), F.col("rel"), source))
    return named.select(*found.columns)


def inferred_edges(triples: DataFrame, toks: DataFrame, min_prob: float = MIN_RELATION) -> DataFrame:
    """Edges of kind inf from (graph_id, sent_id, para_id, head, rel, tail, prob): texts are matched to the last token of that text in the sentence; both must be."""
    return merged_relations(matched(triples, toks, min_prob))


def matched(triples: DataFrame, toks: DataFrame, min_prob: float = MIN_RELATION) -> DataFrame:
    """(graph_id, src, dst, rel, prob) of relations by the keys of tokens, as inferred_edges() merges them."""
    place = ["graph_id", "para_id", "sent_id"]
    last = toks.groupBy(*place, "text").agg(F.max_by("key", "tok_i").alias("key"))
    met = triples.where(F.col("prob") >= min_prob).join(last.toDF(*place, "head", "src"), [*place, "head"]).join(last.toDF(*place, "tail", "dst"), [*place, "tail"])
    return met.where("src <> dst").select("graph_id", "src", "dst", "rel", "prob")


def merged_relations(found: DataFrame) -> DataFrame:
    """Edges of kind inf, one for each relation of two nodes."""
    return found.groupBy("graph_id", "src", "dst", "rel").agg(F.count("*").alias("count"), F.max("prob").alias("prob")).withColumn("kind", F.lit("inf")).select("graph_id", "src", "dst", "rel", "kind", "prob", "count")
