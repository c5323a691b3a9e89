"""Exchange formats, linking and the stream, as round trips and on small fixtures."""

import json

import pytest

from graphloom.functions.scalars import W3
from graphloom.operators import linking, textgraph
from graphloom.sources import exchange, nodelink
from graphloom.streaming import accumulate

TEXT = "The mayor of Werner Herzog walked to Berlin.\nA small house in Berlin ended."


@pytest.fixture(scope="module")
def graph(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Old dogs of Rome."), (3, None)], "doc_id long, text string")
    toks = textgraph.tokens(docs)
    return toks, *(f.cache() for f in textgraph.lemma_graph(toks))


def test_graph(graph):
    toks, nodes, edges = graph
    by = {r.key: r for r in nodes.where("graph_id = 1").collect()}
    assert by["berlin.PROPN"]["count"] == 2 and by["berlin.PROPN"].kind == "ent" and by["berlin.PROPN"].label.endswith("Country")
    assert by["werner.PROPN.herzog.PROPN"].label.endswith("Person")
    assert by["small.NOUN.house.NOUN"].kind == "chu" if "small.NOUN.house.NOUN" in by else any(r.kind == "chu" for r in by.values())
    assert edges.where("src = dst").count() == 0
    assert nodes.count() == nodes.select("graph_id", "key").distinct().count()


def test_nodelink_round_trip(graph):
    _, nodes, edges = graph
    again = nodelink.load(nodelink.dump(nodes, edges))
    for was, now in zip((nodes, edges), again):
        columns = sorted(was.columns)
        assert set(columns) <= set(now.columns)
        assert sorted(map(str, was.select(*columns).collect())) == sorted(map(str, now.select(*columns).collect()))


def test_relation_json(spark):
    text = json.dumps({"rels": ["a", "b"], "ents": {"x": [["a", "y"], ["b", "z"]]}, "scores": [[1, 0, 0.5]]})
    triples, scores = exchange.relation_json(spark, text)
    assert [tuple(r) for r in triples.collect()] == [(0, "x", "a", "y"), (1, "x", "b", "z")]
    assert [tuple(r) for r in scores.collect()] == [("a", "b", 0.5)]
    with pytest.raises(ValueError):
        exchange.relation_json(spark, '{"rels": [], "ents": {"x": [["a", "y"]]}}')


TURTLE = """@base <http://b.example/> .
@prefix skos: <SKOS> .
@prefix dbo: <ONTOLOGY> .
<entity/herzog> a dbo:Person ; # a comment
  skos:prefLabel "Werner \\"H\\" Herzog"@en, "Herzog"@de ; skos:broader <entity/werner> .
<entity/werner> skos:prefLabel "Werner"@en .
dbo:Person skos:prefLabel "person"@en ; skos:definition "People. All."@en .
""".replace("SKOS", W3 + "2004/02/skos/core#").replace("ONTOLOGY", "http://o.example/")


def test_turtle(spark):
    found = set(exchange.turtle_triples(TURTLE))
    skos = W3 + "2004/02/skos/core#"
    assert found == {
        ("http://b.example/entity/herzog", exchange.RDF + "type", "http://o.example/Person"),
        ("http://b.example/entity/herzog", skos + "prefLabel", 'Werner "H" Herzog'),
        ("http://b.example/entity/herzog", skos + "prefLabel", "Herzog"),
        ("http://b.example/entity/herzog", skos + "broader", "http://b.example/entity/werner"),
        ("http://b.example/entity/werner", skos + "prefLabel", "Werner"),
        ("http://o.example/Person", skos + "prefLabel", "person"),
        ("http://o.example/Person", skos + "definition", "People. All."),
    }
    nodes, edges = exchange.bootstrap(spark, TURTLE)
    assert {(r.key.rsplit("/", 1)[1], r.kind) for r in nodes.collect()} == {("herzog", "ent"), ("werner", "ent"), ("Person", "iri")}
    assert sorted(r.kind for r in edges.collect()) == ["iri", "syn"]


def test_exports(spark, graph, tmp_path):
    _, nodes, edges = graph
    rows = textgraph.rdf_triples(nodes, edges)
    exchange.write_turtle(rows, str(tmp_path / "ttl"), {"skos": "http://s#"}, "http://b.example/")
    lines = [r.value for r in spark.read.text(str(tmp_path / "ttl")).collect()]
    assert len([x for x in lines if x[0] != "@"]) == rows.count() and all(x.endswith(" .") for x in lines)
    whole = (p.read_text() for p in (tmp_path / "ttl").glob("*.txt"))
    assert sum(len(exchange.turtle_triples(x)) for x in whole) == rows.count()
    out = textgraph.exported(nodes, edges)
    exchange.write_property_graph(*out, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/nodes")).count() == out[0].count()
    keys = {(r.graph_id, r.key) for r in out[0].collect()}
    assert all((r.graph_id, r.src) in keys and (r.graph_id, r.dst) in keys for r in out[1].collect())


def test_linking(spark, graph):
    toks, nodes, _ = graph
    known = spark.createDataFrame([("http://k/Berlin", "Berlin", ["berlin city"]), ("http://k/WH", "W. Herzog", ["Werner Herzog"]), ("http://k/None", "Nothing", None)], "iri string, label string, aliases array<string>")
    links = linking.link_entities(nodes, known)
    assert {(r.key, r.iri, r.prob) for r in links.collect()} == {("berlin.PROPN", "http://k/Berlin", 1.0), ("werner.PROPN.herzog.PROPN", "http://k/WH", 1.0)}
    new, edges = linking.link_nodes(links)
    assert new.count() == 2 and edges.count() == 2
    rels = spark.createDataFrame([("lives in",), ("is",)], "rel string")
    dim = spark.createDataFrame([("is", None, "http://k/is")], "rel string, equivalent string, broader string")
    assert {tuple(r) for r in linking.resolve_relations(rels, dim, "re").collect()} == {("lives in", "re:lives_in"), ("is", "http://k/is")}
    said = spark.createDataFrame([(1, 0, 0, "Werner Herzog", "r", "Berlin", 0.95), (1, 0, 0, "Werner Herzog", "r", "Berlin", 0.1), (1, 0, 0, "Nobody", "r", "Berlin", 0.95)], "graph_id long, para_id int, sent_id int, head string, rel string, tail string, prob double")
    assert [(r.src, r.dst, r["count"]) for r in linking.inferred_edges(said, toks).collect()] == [("werner.PROPN.herzog.PROPN", "berlin.PROPN", 1)]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, TEXT) for i in range(4)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accumulate.accumulate(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(100)
    got = accumulate.merged(spark.read.parquet(str(tmp_path / "out")))
    want = textgraph.token_nodes(textgraph.tokens(docs))
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))
