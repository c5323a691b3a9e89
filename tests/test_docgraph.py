"""Graphs made at once from documents: against the SQL and against the operators on tokens, on odd documents."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from graphloom.operators import docgraph, rank, textgraph
from graphloom.plans import queries as plans
from graphloom.sources import nodelink

TEXTS = [
    "The mayor visited Werner Herzog and Werner Herzog wanted Berlin.\nA small house in Berlin ended.",
    "",
    "\n\n",
    "...Hello World2 abc. New York2 City Hall!? 12 34a a12 Ab",
    "É Éa Ünder Wasser ÀB c  Two  Spaces Here\tTab Ab Cd\r\nend",
    "A B C Dd Ee Ff. x",
    "Ab Cd 😀 Ef Gh Ij \"kl\" \\ 'm'",
    "the a an dog. A Dog The Cat A dog",
    "   . ! ? ",
    "a. b. c.  ",
    "Ab  Cd Werner. Werner Herzog; WERNER HERZOG wanted Berlin and Paris",
    "x" * 50 + " " + "Yy Zz " * 20,
    "1 2 3 Ⅷ ½ a½ é combining Ab́ Cd",
    "Then Ti Ti ended, and It It and TI TI.",
    "Walked Ab Cd wanted Ef Gh meeting Ij. \x0bMarks \x00 here",
]
#: Queries that took joins of tokens with tokens; where further tables are joined, they are small.
ONE_PASS = "text_tokens lemma_keys token_offsets unmerged_words chunk_offsets entity_keys node_upsert edge_upsert class_nodes class_links chunk_nodes chunk_edges out_degree export_nodes export_edges node_styles edge_styles edge_keys node_labels node_table property_graph_nodes property_graph_edges wordcloud verb_relations near_entities nodelink_nodes nodelink_round_trip".split()
WITH_JOINS = "rdf_triples inferred_edges inferred_table entity_links unlinked_entities secondary_links nodelink_class_links".split()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([*enumerate(TEXTS), (100, None)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ONE_PASS + WITH_JOINS)
def test_odd_documents(spark, odd, name):
    folder, con = odd
    found = plans.QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    got = Counter(tuple(r) for r in found.select(*columns).collect())
    want = Counter(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", ONE_PASS)
def test_only_documents_are_shuffled(spark, odd, name):
    plan = plans.QUERIES[name](spark, odd[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in plan


def test_repeated_ids(spark):
    rows = [*enumerate(TEXTS), (5, "A B C Dd Ee Ff. other Werner Herzog walking"), (5, TEXTS[5]), (7, TEXTS[0]), (7, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toks = textgraph.tokens(docs).cache()
    nodes, edges = textgraph.lemma_graph(toks, placed=True)
    degree = textgraph.out_degree(textgraph.token_nodes(toks), textgraph.dep_edges(toks))
    pairs = [
        (docgraph.nodes(docs), textgraph.token_nodes(toks)),
        (docgraph.lemma_nodes(docs, placed=True), textgraph.whole_graph(toks)[0]),
        (docgraph.lemma_edges(docs), edges),
        (docgraph.edges(docs, exported=True), textgraph.exported(textgraph.token_nodes(toks), textgraph.dep_edges(toks))[1]),
        (docgraph.out_degree(docs), degree),
        (docgraph.entity_keys(docs), textgraph.entity_keys(toks)),
    ]
    for a, b in pairs:
        columns = sorted(a.columns)
        assert columns == sorted(b.columns) and dict(a.dtypes) == dict(b.dtypes)
        assert Counter(map(str, a.select(*columns).collect())) == Counter(map(str, b.select(*columns).collect()))


def test_ranks(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    toks = textgraph.tokens(docs).cache()
    for name, found in (("pagerank", rank.pagerank(textgraph.token_nodes(toks), textgraph.dep_edges(toks))), ("ranked_phrases", rank.phrases(*textgraph.whole_graph(toks)))):
        got = plans.QUERIES[name](spark, odd[0])
        value = "pagerank" if name == "pagerank" else "weight"
        rows = lambda d: {(r.graph_id, r.key): r[value] for r in d.collect()}  # noqa: E731, B023
        assert rows(got) == pytest.approx(rows(found), abs=1e-8)
        assert "Exchange" not in str(got._jdf.queryExecution().executedPlan()).replace("Exchange hashpartitioning(doc_id", "")


def test_ranks_of_several_graphs():
    """Each graph's ranks are those that it has alone."""
    rng = np.random.default_rng(1)
    sizes, parts, src, dst, weight, base = (3, 40, 1, 17), [], [], [], [], 0
    for n in sizes:
        a, b, w = rng.integers(0, n, 2 * n), rng.integers(0, n, 2 * n), rng.integers(1, 9, 2 * n).astype(float)
        parts.append(rank.power_iteration(n, a, b, w))
        src, dst, weight, base = [*src, *(a + base)], [*dst, *(b + base)], [*weight, *w], base + n
    got = rank.power_iterations(np.repeat(range(4), sizes), 4, np.array(src), np.array(dst), np.array(weight))
    assert got == pytest.approx(np.concatenate(parts), abs=1e-12)


def test_links_of_a_long_graph(spark):
    """Links are read without a copy of all nodes for each: a graph of 60,000 links would otherwise take tens of GB."""
    text = " ".join(f"w{i} of W{i % 977} the" for i in range(20_000))
    dumped = docgraph.nodelink(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    nodes, edges = nodelink.load(dumped)
    assert nodes.count() > 60_000 and edges.where("src is not null and dst is not null").count() > 60_000
    assert "Generate" not in str(edges._jdf.queryExecution().executedPlan())


def test_json_that_is_none(spark):
    bad = spark.createDataFrame([(1, "{"), (2, None), (3, "{}"), (4, '{"nodes":[{"lemma":"a"}],\n"links":[{"source":0,"target":5,"title":"t"}]}'), (5, "[1]")], "graph_id long, json string")
    nodes, edges = nodelink.load(bad)
    assert [(r.graph_id, r.key) for r in nodes.collect()] == [(4, "a")]
    assert [(r.graph_id, r.src, r.dst, r.rel) for r in edges.collect()] == [(4, "a", None, "t")]


def test_blocks_of_graphs(spark, monkeypatch):
    """Rows of one id stay together whatever the size of a block."""
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string")
    whole = Counter(map(str, docgraph.nodes(docs).collect()))
    monkeypatch.setattr(docgraph, "BLOCK", 1)
    assert whole == Counter(map(str, docgraph.nodes(docs).collect()))
