"""Exchangeable parts of the extraction, linking thresholds, vocabularies and archives, on small fixtures."""

import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import backends, linking, rank, textgraph
from graphloom.sources import exchange

TEXT = "The mayor visited Werner Herzog and Werner Herzog wanted Berlin.\nA small house in Berlin ended."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")


def test_long_sentence(spark):
    text = " ".join(["the", "word", "of"] * 7000)
    toks = textgraph.tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert toks.count() == 21_000
    assert [r.head_i for r in toks.orderBy("tok_i").limit(4).collect()] == [1, 4, 4, 4]
    assert textgraph.chunks(toks).count() == 7000


def test_ids_and_places(spark, docs):
    nodes, edges = textgraph.whole_graph(textgraph.tokens(docs))
    rows = nodes.orderBy("node_id").collect()
    assert [r.node_id for r in rows] == list(range(len(rows)))
    by = {r.key: r for r in rows}
    herzog, berlin = by["werner.PROPN.herzog.PROPN"], by["berlin.PROPN"]
    assert herzog.length == 2 and [tuple(x) for x in herzog.loc] == [(0, 0, 3), (0, 0, 5)] and herzog.annotated
    assert herzog.node_id < by["http://dbpedia.org/ontology/Person"].node_id < min(r.node_id for r in rows if r.kind == "chu")
    assert [tuple(x) for x in berlin.loc] == [(0, 0, 7), (1, 0, 4)] and by["http://dbpedia.org/ontology/Person"].label == "person"
    ranked = rank.phrases(nodes, edges).orderBy("rank").collect()
    assert [(-r.weight, r.node_id) for r in ranked] == sorted((-r.weight, r.node_id) for r in ranked)


def test_extraction_with_tables(spark, docs):
    entities = spark.createDataFrame([("http://k/WH", "Werner Herzog", None), ("http://k/B", "Berlin", None)], "iri string, label string, aliases array<string>")
    spotted = spark.createDataFrame([("Berlin", "http://s/B", 0.9), ("Werner Herzog", "http://s/WH", 0.89)], "text string, iri string, similarity double")
    relations = spark.createDataFrame([("wanted", "http://k/wanted", None)], "rel string, equivalent string, broader string")
    known = backends.TableKnowledge(entities, relations, spotted, entities.withColumn("iri", F.concat(F.lit("http://second/"), "label")))
    nodes, edges = backends.Extraction(knowledge=known, relations=[backends.VerbRelations()]).graph(docs)
    linked = {(r.src, r.dst) for r in edges.where("rel = 'linked'").collect()}
    assert linked == {("berlin.PROPN", "http://s/B"), ("werner.PROPN.herzog.PROPN", "http://k/WH"), ("berlin.PROPN", "http://second/Berlin"), ("werner.PROPN.herzog.PROPN", "http://second/Werner Herzog")}
    assert [(r.src, r.dst, r.rel) for r in edges.where("kind = 'inf'").collect()] == [("werner.PROPN.herzog.PROPN", "berlin.PROPN", "http://k/wanted")]
    assert nodes.where("kind = 'lem' and label is null").count() == 0
    triples = {(r.subj, r.pred, r.obj) for r in textgraph.rdf_triples(nodes, edges).collect()}
    base = S.IRI_BASE + "entity/"
    assert (base + "werner_PROPN_herzog_PROPN", "<http://k/wanted>", f"<{base}berlin_PROPN>") in triples
    assert ("http://dbpedia.org/ontology/Person", "skos:prefLabel", '"person"@en') in triples
    backends.triples_view(textgraph.rdf_triples(nodes, edges), "facts")
    assert spark.sql("select obj from facts where pred = '<http://k/wanted>'").count() == 1


def test_no_knowledge(spark, docs):
    plain, _ = backends.Extraction().graph(docs)
    assert plain.where("kind = 'iri' and pos = 'dbr'").count() == 0
    frame = spark.createDataFrame([("GPE", "http://dbpedia.org/ontology/Country")], "label string, iri string")
    known = backends.NoKnowledge()
    assert tuple(frame.select(known.remap_ner(F.col("label")), known.normalize_prefix(F.col("iri"))).first()) == ("GPE", "http://dbpedia.org/ontology/Country")


def test_models_in_place(spark, docs):
    def parser():
        return lambda text: [{"para_id": 0, "sent_id": 0, "tok_i": i, "text": w, "lemma": w.lower(), "pos": "PROPN", "kind": "ent", "key": w.lower() + ".PROPN", "ent_label": None, "head_i": 0, "dep": "dep"} for i, w in enumerate(text.split()[:3])]

    toks = backends.ModelLanguage(parser, lambda: lambda text: {(0, 0, 1): "GPE"}).tokens(docs)
    assert [(r.text, r.ent_label) for r in toks.orderBy("tok_i").collect()] == [("The", None), ("mayor", "GPE"), ("visited", None)]
    own = textgraph.tokens(docs)
    paired = backends.PairRelations(lambda: lambda pairs: [("met", 0.95) for _ in pairs]).triples(own)
    assert ("Werner Herzog", "met", "Berlin") in {(r.head, r.rel, r.tail) for r in paired.collect()}
    said = backends.TaggedRelations(lambda: lambda sents: ["<triplet> Werner Herzog <per> Berlin <loc> lives in" if "Werner" in s else "" for s in sents]).triples(own)
    assert [(r.head, r.rel, r.tail, r.sent_id) for r in said.collect()] == [("Werner Herzog", "lives in", "Berlin", 0)]


def test_secondary_links_need_more(spark):
    links = spark.createDataFrame([(1, "a", "http://k/a", 1.0, "Berlin"), (1, "b", "http://k/b", 1.0, "Rome")], "graph_id long, key string, iri string, prob double, name string")
    second = spark.createDataFrame([("q:1", "BERLIN", None), ("q:2", "Paris", ["Rom"])], "iri string, label string, aliases array<string>")
    assert [(r.key, r.iri) for r in linking.link_secondary(links, second).collect()] == [("a", "q:1")]


def test_vocabulary_first(spark, docs):
    base = S.IRI_BASE
    turtle = f'@base <{base}> .\n@prefix skos: <{S.W3}2004/02/skos/core#> .\n<entity/berlin_PROPN> a <http://o/City> ; skos:prefLabel "Berlin, city"@en .\n<http://o/City> skos:prefLabel "city"@en .\n'
    nodes, _ = textgraph.lemma_graph(textgraph.tokens(docs))
    earlier = exchange.vocabulary_nodes(exchange.bootstrap(spark, turtle)[0], nodes)
    merged = {r.key: r for r in textgraph.merged_with(nodes, earlier).collect()}
    assert merged["berlin.PROPN"].text == "Berlin, city" and merged["berlin.PROPN"]["count"] == 2 and merged["berlin.PROPN"].label == "http://o/City"
    assert merged["http://o/City"].kind == "iri" and merged["http://o/City"]["count"] == 0


def test_archives(spark, docs):
    nodes, edges = textgraph.whole_graph(textgraph.tokens(docs))
    rows, between = exchange.property_graph(nodes.withColumn("weight", F.lit(0.5)), edges)
    (found,) = exchange.zip_graphs(rows, between).collect()
    with zipfile.ZipFile(io.BytesIO(found.archive)) as archive:
        first = list(csv.reader(io.StringIO(archive.read("nodes.csv").decode())))
        second = list(csv.reader(io.StringIO(archive.read("edges.csv").decode())))
    assert len(first) == rows.count() and len(first[0]) == 10 and len(second) == between.count() and len(second[0]) == 6
    ids = {r[0] for r in first}
    assert all(r[0] in ids and r[1] in ids for r in second)
