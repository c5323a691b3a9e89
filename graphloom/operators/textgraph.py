"""From texts to a graph of lemmas, entities, noun chunks and classes.

The default language backend is a set of rules (an approximation, documented as such); any
DataFrame of tokens with the same columns may take its place: the operators here join and group them.
Graphs are keyed by graph_id (the document). For documents by the rules, docgraph makes the same at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import docgraph
from .rules import ADPOSITIONS, DETERMINERS, RDF_TYPE, SENTENCE, TOKEN, VERB_ENDINGS  # noqa: F401

LOC = "array<struct<para_id:int,sent_id:int,tok_i:int>>"


def tokens(docs: DataFrame) -> DataFrame:
    """(graph_id, para_id, sent_id, tok_i, text, lemma, pos, kind, key, ent_label, head_i, dep) of every token.

    Paragraphs are lines; null texts give none. The head of a token is the next content word, so that a sentence falls into
    runs of one head each: heads cost time in proportion to the sentence, and no shuffle.
    """
    return docgraph.tokens(docs)


def token_nodes(toks: DataFrame, placed: bool = False) -> DataFrame:
    """(graph_id, key, kind, pos, text, label, count, sub_obj): tokens merged by key; the first occurrence names the node.

    placed adds length (in words), loc (all places; none for words without content) and order, that of first appearance.
    """
    order = F.struct("para_id", "sent_id", "tok_i")
    first = F.min_by(F.struct("kind", "pos", "text", "ent_label"), order)
    where = [F.min(order).alias("at"), F.array_sort(F.collect_list(order)).alias("loc")] if placed else []
    out = toks.groupBy("graph_id", "key").agg(first.alias("f"), F.count("*").alias("n"), F.max(F.col("dep").isin("nsubj", "pobj")).alias("sub_obj"), *where)
    count = F.when(F.col("f.kind") == "dep", 0).otherwise(F.col("n")).cast("long")
    base = out.select("graph_id", "key", "f.kind", "f.pos", "f.text", S.remap_ner(F.col("f.ent_label")).alias("label"), count.alias("count"), "sub_obj", *(["at", "loc"] if placed else []))
    if not placed:
        return base
    at = F.struct(F.col("at.para_id").alias("para"), F.lit(0).alias("late"), F.col("at.sent_id").alias("sent"), F.lit(0).alias("step"), F.col("at.tok_i").alias("at"))
    return base.select(*(c for c in base.columns if c not in ("at", "loc")), F.size(F.split("text", " ")).alias("length"), F.when(F.col("kind") == "dep", F.array().cast(LOC)).otherwise(F.col("loc")).alias("loc"), at.alias("order"))


def dep_edges(toks: DataFrame) -> DataFrame:
    """(graph_id, src, dst, rel, kind, prob, count): token to head, merged; no self-loops."""
    place = ["graph_id", "para_id", "sent_id"]
    heads = toks.select(*place, F.col("tok_i").alias("head_i"), F.col("key").alias("dst"))
    met = toks.select(*place, "head_i", F.col("key").alias("src"), F.col("dep").alias("rel")).join(heads, [*place, "head_i"]).where("src <> dst")
    return met.groupBy("graph_id", "src", "dst", "rel").agg(F.count("*").alias("count")).withColumn("kind", F.lit("dep")).withColumn("prob", F.lit(1.0)).select("graph_id", "src", "dst", "rel", "kind", "prob", "count")


def chunks(toks: DataFrame) -> DataFrame:
    """(graph_id, para_id, sent_id, start, length, text, key): a determiner or noun run before a noun, of two tokens or more.

    A token is of the chunk that started last, unless something else than a noun came in between: two running
    maxima of the sentence, whatever its length.
    """
    place = ["graph_id", "para_id", "sent_id"]
    so_far = Window.partitionBy(*place).orderBy("tok_i")
    noun = F.col("pos").isin("NOUN", "PROPN")
    may_start = noun | (F.col("pos") == "DET")
    begins = toks.select(*place, "tok_i", "text", "pos", (may_start & ~F.coalesce(F.lag(may_start).over(so_far), F.lit(False))).alias("begins"))
    start = F.max(F.when(F.col("begins"), F.col("tok_i"))).over(so_far)
    broken = F.max(F.when(~noun & ~F.col("begins"), F.col("tok_i"))).over(so_far)
    inside = begins.select(*place, "tok_i", "text", "pos", start.alias("start"), broken.alias("broken")).where("start is not null and coalesce(broken, -1) <= start")
    parts = inside.groupBy(*place, "start").agg(F.array_sort(F.collect_list(F.struct("tok_i", "text", "pos"))).alias("part")).where(F.size("part") > 1)
    text = F.array_join(F.transform("part", lambda x: x["text"]), " ")
    key = F.array_join(F.transform("part", lambda x: F.concat(F.lower(x["text"]), F.lit("."), x["pos"])), ".")
    return parts.select(*place, "start", F.size("part").alias("length"), text.alias("text"), key.alias("key"))


def chunk_overlay(toks: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of chunks whose key is no node yet, and their edges to the tokens they cover; placed where nodes are."""
    placed = "order" in nodes.columns
    fresh = chunks(toks).join(nodes.select("graph_id", "key"), ["graph_id", "key"], "left_anti")
    order = F.struct("para_id", "sent_id", "start")
    where = [F.min_by("length", order).alias("length"), F.array_sort(F.collect_list(F.struct("para_id", "sent_id", F.col("start").alias("tok_i")))).alias("loc")] if placed else []
    new = fresh.groupBy("graph_id", "key").agg(F.min_by("text", order).alias("text"), F.count("*").alias("count"), *where)
    columns = ["graph_id", "key", F.lit("chu").alias("kind"), F.lit("noun_chunk").alias("pos"), "text", F.lit(None).cast("string").alias("label"), "count", F.lit(False).alias("sub_obj")]
    if placed:
        one = F.get("loc", F.lit(0))
        columns += ["length", "loc", F.struct(one["para_id"].alias("para"), F.lit(1).alias("late"), one["sent_id"].alias("sent"), F.lit(0).alias("step"), one["tok_i"].alias("at")).alias("order")]
    covered = fresh.select("graph_id", "para_id", "sent_id", F.col("key").alias("src"), F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("tok_i"))
    edges = covered.join(toks.select("graph_id", "para_id", "sent_id", "tok_i", F.col("key").alias("dst")), ["graph_id", "para_id", "sent_id", "tok_i"])
    edges = edges.groupBy("graph_id", "src", "dst").agg(F.count("*").alias("count"))
    return new.select(*columns), edges.select("graph_id", "src", "dst", F.lit("noun_chunk").alias("rel"), F.lit("chu").alias("kind"), F.lit(1.0).alias("prob"), "count")


def class_overlay(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the classes of entities, counted by entity, and the edges to them; placed, after the sentence of their first entity, where nodes are."""
    spark = nodes.sparkSession
    placed = "order" in nodes.columns
    classes = spark.createDataFrame([(iri, text, short) for _, iri, text, short in S.NER_CLASSES], "label string, definition string, short string")
    ents = nodes.where("kind = 'ent' and label is not null").join(F.broadcast(classes), "label")
    new = ents.groupBy("graph_id", "label").agg(F.first("definition").alias("text"), F.first("short").alias("short"), F.count("*").alias("count"), *([F.min("order").alias("one")] if placed else []))
    columns = ["graph_id", F.col("label").alias("key"), F.lit("iri").alias("kind"), F.lit(RDF_TYPE).alias("pos"), "text", F.col("short").alias("label"), "count", F.lit(False).alias("sub_obj")]
    if placed:
        columns += [F.size(F.split("short", " ")).alias("length"), F.array().cast(LOC).alias("loc"), F.struct("one.para", F.lit(0).alias("late"), "one.sent", F.lit(1).alias("step"), "one.at").alias("order")]
    edges = ents.select("graph_id", F.col("key").alias("src"), F.col("label").alias("dst"), F.lit(RDF_TYPE).alias("rel"), F.lit("iri").alias("kind"), F.lit(0.0).alias("prob"), F.lit(1).cast("long").alias("count"))
    return new.select(*columns), edges


def lemma_graph(toks: DataFrame, placed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the whole graph: tokens, chunks, classes."""
    base = token_nodes(toks, placed)
    chunk_nodes, chunk_edges = chunk_overlay(toks, base)
    class_nodes, class_edges = class_overlay(base)
    return base.unionByName(chunk_nodes).unionByName(class_nodes), dep_edges(toks).unionByName(chunk_edges).unionByName(class_edges)


def numbered(nodes: DataFrame) -> DataFrame:
    """Placed nodes with node_id, from 0 in order of first appearance in their graph: sentence by sentence its tokens, then its classes; the chunks of a paragraph at its end."""
    node_id = F.row_number().over(Window.partitionBy("graph_id").orderBy("order", "key")) - 1
    return nodes.withColumn("node_id", node_id.cast("long")).drop("order")


def whole_graph(toks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lemma_graph with all that nodes have: node_id, length, loc, neighbors, annotated."""
    nodes, edges = lemma_graph(toks, placed=True)
    degree = edges.groupBy("graph_id", F.col("src").alias("key")).agg(F.count_distinct("dst").alias("neighbors"))
    found = numbered(nodes).join(degree, ["graph_id", "key"], "left").withColumn("neighbors", F.coalesce("neighbors", F.lit(0)).cast("long"))
    return found.withColumn("annotated", (F.col("kind") == "ent") & F.col("label").isNotNull()), edges


def merged_with(nodes: DataFrame, earlier: DataFrame) -> DataFrame:
    """Nodes of a graph and those of an earlier one (a vocabulary, or a graph read back): equal keys are one node, its counts
    summed; what the earlier one says of it holds, else what the later one does."""
    both = nodes.select("graph_id", "key", "kind", "pos", "text", "label", "count", "sub_obj", F.lit(1).alias("late")).unionByName(earlier.select("graph_id", "key", "kind", "pos", "text", "label", "count", "sub_obj", F.lit(0).alias("late")))
    first = F.min_by(F.struct("kind", "pos", "text"), "late").alias("f")
    label = F.coalesce(F.max(F.when(F.col("late") == 0, F.col("label"))), F.max(F.when(F.col("late") == 1, F.col("label"))))
    out = both.groupBy("graph_id", "key").agg(first, label.alias("label"), F.sum("count").alias("count"), F.max("sub_obj").alias("sub_obj"))
    return out.select("graph_id", "key", "f.kind", "f.pos", "f.text", "label", "count", "sub_obj")


def token_offsets(toks: DataFrame) -> DataFrame:
    """(graph_id, para_id, sent_id, tok_i, length, offset): words of each token, and how many words of its paragraph come before it."""
    before = Window.partitionBy("graph_id", "para_id").orderBy("sent_id", "tok_i").rowsBetween(Window.unboundedPreceding, -1)
    sized = toks.select("graph_id", "para_id", "sent_id", "tok_i", F.size(F.split("text", " ")).alias("length"))
    return sized.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("int"))


def unmerged(toks: DataFrame) -> DataFrame:
    """(graph_id, para_id, word_i, text, pos, sent_id, tok_i): the words of paragraphs, those of entities apart; tok_i is the token a word is of."""
    place = ["graph_id", "para_id", "sent_id", "tok_i"]
    words = toks.select(*place, "pos", F.posexplode(F.split("text", " ")).alias("k", "text"))
    return words.join(token_offsets(toks), place).select("graph_id", "para_id", (F.col("offset") + F.col("k")).alias("word_i"), "text", "pos", "sent_id", "tok_i")


def entity_keys(toks: DataFrame) -> DataFrame:
    """(graph_id, para_id, ordinal, key, length) of the entities of paragraphs, in order from 0; length in words."""
    order = F.row_number().over(Window.partitionBy("graph_id", "para_id").orderBy("sent_id", "tok_i")) - 1
    return toks.where("kind = 'ent'").select("graph_id", "para_id", order.alias("ordinal"), "key", F.size(F.split("text", " ")).alias("length"))


def chunk_offsets(toks: DataFrame) -> DataFrame:
    """(graph_id, para_id, ordinal, key, first_word, words): chunks of paragraphs, in order from 0, by their place among the words of unmerged()."""
    order = F.row_number().over(Window.partitionBy("graph_id", "para_id").orderBy("sent_id", "start")) - 1
    one = chunks(toks).select("graph_id", "para_id", "sent_id", F.col("start").alias("tok_i"), "key", F.size(F.split("text", " ")).alias("words"), order.alias("ordinal"))
    return one.join(token_offsets(toks), ["graph_id", "para_id", "sent_id", "tok_i"]).select("graph_id", "para_id", "ordinal", "key", F.col("offset").alias("first_word"), "words")


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, key, neighbors): distinct successors of every node."""
    degree = edges.groupBy("graph_id", F.col("src").alias("key")).agg(F.count_distinct("dst").alias("neighbors"))
    return nodes.select("graph_id", "key").join(degree, ["graph_id", "key"], "left").select("graph_id", "key", F.coalesce("neighbors", F.lit(0)).cast("long").alias("neighbors"))


def entity_pairs(toks: DataFrame) -> DataFrame:
    """(graph_id, para_id, src, dst, n): ordered pairs of mentions of different entities in one paragraph, counted."""
    ents = toks.where("kind = 'ent'").groupBy("graph_id", "para_id", "key").agg(F.count("*").alias("n"))
    x, y = ents.alias("x"), ents.alias("y")
    both = x.join(y, (F.col("x.graph_id") == F.col("y.graph_id")) & (F.col("x.para_id") == F.col("y.para_id")) & (F.col("x.key") != F.col("y.key")))
    return both.select("x.graph_id", "x.para_id", F.col("x.key").alias("src"), F.col("y.key").alias("dst"), (F.col("x.n") * F.col("y.n")).alias("n"))


def exported_nodes(nodes: DataFrame, base: str = S.IRI_BASE) -> DataFrame:
    """The nodes of exported()."""
    keep = (F.col("kind") == "iri") | (F.col("kind").isin("ent", "lem") & (F.col("pos") != "VERB"))
    iri = F.when(F.col("kind") == "iri", F.col("key")).otherwise(S.entity_iri(F.col("key"), base))
    return nodes.where(keep).select("graph_id", "key", iri.alias("iri"), "kind", "pos", "text", "label", "count")


def exported(nodes: DataFrame, edges: DataFrame, base: str = S.IRI_BASE) -> tuple[DataFrame, DataFrame]:
    """Property-graph rows: nodes with an IRI (entities, lemmas that are no verbs, classes), and edges between such."""
    out = exported_nodes(nodes, base)
    ends = out.select("graph_id", "key")
    kept = edges.join(ends.withColumnRenamed("key", "src"), ["graph_id", "src"], "left_semi").join(ends.withColumnRenamed("key", "dst"), ["graph_id", "dst"], "left_semi")
    return out, kept.select("graph_id", "src", "dst", "rel", "kind", "prob", "count")


def rdf_triples(nodes: DataFrame, edges: DataFrame, base: str = S.IRI_BASE, lang: str = "en") -> DataFrame:
    """Distinct (graph_id, subj, pred, obj): labels, types, class labels and definitions, and inferred relations.

    The ends of a relation are the IRIs of what is exported, else the node's label, else what its IRI would be. A
    relation that is an IRI stands in angle brackets.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit(f'"@{lang}'))
    own = S.entity_iri(F.col("key"), base)
    is_named = F.col("kind").isin("ent", "lem") & (F.col("pos") != "VERB")
    named = nodes.where(is_named).select("graph_id", own.alias("subj"), F.lit("skos:prefLabel").alias("pred"), quoted(F.col("text")).alias("obj"))
    typed = nodes.where("kind = 'ent' and label is not null").select("graph_id", own.alias("subj"), F.lit("rdf:type").alias("pred"), F.concat(F.lit("<"), "label", F.lit(">")).alias("obj"))
    classes = nodes.where("kind = 'iri'")
    labels = classes.where("label is not null").select("graph_id", F.col("key").alias("subj"), F.lit("skos:prefLabel").alias("pred"), quoted(F.col("label")).alias("obj"))
    defined = classes.select("graph_id", F.col("key").alias("subj"), F.lit("skos:definition").alias("pred"), quoted(F.col("text")).alias("obj"))
    ref = nodes.select("graph_id", "key", F.when(F.col("kind") == "iri", F.col("key")).when(is_named, own).otherwise(F.coalesce("label", own)).alias("ref"))
    inferred = edges.where("kind = 'inf'").join(ref.toDF("graph_id", "src", "subj"), ["graph_id", "src"]).join(ref.toDF("graph_id", "dst", "to"), ["graph_id", "dst"])
    inferred = relation_triples(inferred, F.col("subj"), F.col("to"))
    return named.unionByName(typed).unionByName(labels).unionByName(defined).unionByName(inferred).distinct()


def relation_triples(inferred: DataFrame, subj: Column, obj: Column) -> DataFrame:
    """(graph_id, subj, pred, obj) of inferred relations between IRIs."""
    pred = F.when(F.contains("rel", F.lit("://")), F.concat(F.lit("<"), "rel", F.lit(">"))).otherwise(F.col("rel"))
    return inferred.select("graph_id", subj.alias("subj"), pred.alias("pred"), F.concat(F.lit("<"), obj, F.lit(">")).alias("obj"))


def default_labels(nodes: DataFrame) -> DataFrame:
    """nodes, lemmas without a label labelled as things."""
    thing = (F.col("kind") == "lem") & F.col("label").isNull()
    return nodes.withColumn("label", F.when(thing, S.W3 + "2002/07/owl#Thing").otherwise(F.col("label")))


def inferred_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, rel, weight) of the inferred relations, by the texts of their ends."""
    text = nodes.select("graph_id", "key", "text")
    both = edges.where("kind = 'inf'").join(text.toDF("graph_id", "src", "from"), ["graph_id", "src"]).join(text.toDF("graph_id", "dst", "to"), ["graph_id", "dst"])
    return both.select("graph_id", F.col("from").alias("src"), F.col("to").alias("dst"), "rel", F.col("prob").alias("weight"))
