"""Ranking, paths, communities and scalar functions against plain recomputations."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import gor, paths, rank

GOLDEN = {"00": 0.3, "01": 0.265385, "02": 0.342857, "11": 0.230769, "12": 0.370879, "14": 0.132479, "22": 0.214286, "24": 0.126984, "33": 0.333333, "34": 0.555556, "35": 0.222222, "45": 0.444444}
RELS = "directed job acted_in lived_in born_in nation".split()
TRIPLES = [("spielberg", 1, "director"), ("spielberg", 0, "catch"), ("spielberg", 0, "ryan"), ("hanks", 2, "catch"), ("hanks", 2, "ryan"), ("hanks", 1, "actor"), ("hamil", 1, "actor"), ("hamil", 2, "wars"), ("hamil", 4, "california"), ("pitt", 5, "usa"), ("pitt", 4, "usa"), ("pitt", 3, "california"), ("eastwood", 4, "sf"), ("eastwood", 3, "sf"), ("eastwood", 3, "california")]


def test_affinity_golden(spark):
    frame = spark.createDataFrame([(a, RELS[r], b) for a, r, b in TRIPLES] + [("x", "self", "x"), ("spielberg", "directed", "ryan")], "src string, rel string, dst string")
    found = {"".join(sorted(f"{RELS.index(r.rel_a)}{RELS.index(r.rel_b)}")): r.affinity for r in gor.affinity(gor.distinct_triples(frame)).collect()}
    assert found == pytest.approx(GOLDEN, abs=1e-6)


def plain_restack(f):
    n = len(f)
    bins = np.linspace(0, 1, max(round(math.log(n) * 4), 1))
    f = f.assign(used=np.where((f.pos == "VERB") | (f.kind == "iri"), 0, f["count"]))
    cols = [np.where(f.used < 1, 0, f.pagerank), f.used, f.neighbors, f.sub_obj.astype(float)]
    stripes = []
    for c in cols:
        x = np.asarray(c, float)
        if x.max() == 0:
            stripes.append(np.full(n, -1.0))
            continue
        x = x / x.max()
        stripes.append(np.digitize(x, pd.Series(x).quantile(bins, interpolation="nearest").to_numpy()) - 1.0)
    rms = np.where(f.used < 1, 0, np.sqrt(np.mean(np.square(stripes), axis=0)))
    r = rms / rms.sum() if rms.sum() else rms
    e, o = r[(f.kind == "ent") & (r > 0)], r[(f.kind != "ent") & (r > 0)]
    if not len(e) or not len(o):
        return f.pagerank.to_numpy()
    if o.max() >= e.min():
        d = e.sum() * o.max() + o.sum() * e.min()
        c0, c1 = o.max() / d, e.min() / d
    else:
        c0 = c1 = 1 / (e.sum() + o.sum() + e.min() - o.max())
    return np.where(f.kind == "ent", r * c0, r * c1)


def test_restack_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(60):
        n = int(rng.integers(2, 40))
        kinds = ["lem", "chu", "iri", "dep"] + ["ent"] * (g % 3)
        for i in range(n):
            kind = rng.choice(kinds)
            rows.append((g, f"k{i}", str(kind), str(rng.choice(["NOUN", "VERB"])), int(rng.integers(0, 4)), int(rng.integers(0, 3)) * (g % 5 > 0), bool(rng.random() < 0.3), float(rng.random())))
    names = ["graph_id", "key", "kind", "pos", "count", "neighbors", "sub_obj", "pagerank"]
    frame = pd.DataFrame(rows, columns=names)
    found = rank.restack(spark.createDataFrame(frame)).toPandas().set_index(["graph_id", "key"]).weight
    for g, part in frame.groupby("graph_id"):
        want = plain_restack(part.reset_index(drop=True))
        assert np.allclose(found.loc[g].loc[part.key].to_numpy(), want, atol=1e-9), g


def test_pagerank_against_matrix():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(2, 12))
        m = int(rng.integers(1, 30))
        src, dst, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(1, 4, m).astype(float)
        a = np.zeros((n, n))
        np.add.at(a, (src, dst), w)
        p = np.where(a.sum(1, keepdims=True) > 0, a / np.maximum(a.sum(1, keepdims=True), 1e-300), 1 / n)
        x = np.full(n, 1 / n)
        for _ in range(300):
            x = 0.85 * x @ p + 0.15 / n
        assert np.allclose(rank.power_iteration(n, src, dst, w, tolerance=1e-12, rounds=500), x, atol=1e-9)


def test_communities():
    cliques = [set(itertools.combinations(range(b, b + 4), 2)) for b in (0, 4, 8)]
    edges = set().union(*cliques) | {(3, 4), (7, 8)}
    assert paths.split_communities(12, edges, 2) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    assert paths.split_communities(3, set(), 2) == [[0], [1], [2]]


def test_hops():
    line = {str(i): {str(i - 1), str(i + 1)} for i in range(30)}
    assert max(paths.distances(line, "0", 10).values()) == 10


def test_scalars(spark):
    iris = {"http://dbpedia.org/resource/Category:Art": "dbc:Art", "http://dbpedia.org/ontology/Person": "dbo:Person", S.W3 + "2002/07/owl#Thing": "owl:Thing", "http://www.wikidata.org/entity/Q183": "wd_ent:Q183", "https://dbpedia.org/resource/Rome": "dbr:Rome", "http://x y/": "http://x y/", "plain": "plain", None: None}
    rows = spark.createDataFrame([(i,) for i in iris], "iri string").select("iri", S.normalize_prefix(F.col("iri")).alias("short"), S.normalize_prefix(F.col("iri"), compat=True).alias("compat")).collect()
    assert {r.iri: r.short for r in rows} == iris
    assert {r.compat for r in rows if r.iri and "Q183" in r.iri} != {"wd_ent:Q183"}
    one = spark.range(1).select(S.remap_ner(F.lit("WORK OF ART")).alias("a"), S.remap_ner(F.lit("NONE")).alias("b"), S.span_key(F.lit("Werner Herzog"), "PROPN").alias("c"), S.entity_iri(F.lit("a.b c"), "http://b/").alias("d"), S.denormalize_iri(F.lit("http://b/entity/a_b"), "http://b/").alias("e"), S.edge_key(F.lit("1"), F.lit("2"), F.lit("is a"), F.lit("inf")).alias("f"), S.markdown_text(F.lit("**A** [b](http://c) <i>d</i>")).alias("g"), S.enum_encode(F.lit(2)).alias("h"), S.relation_iri(F.lit(None).cast("string"), F.lit("lives in"), "re").alias("i"), S.is_url(F.lit("see http://x")).alias("j")).first()
    assert tuple(one) == ("http://dbpedia.org/resource/Work_of_art", None, "werner.PROPN.herzog.PROPN", "http://b/entity/a_b_c", "a.b", "1.2.is_a.2", "A b d", "ent", "re:lives_in", True)


def test_aliases_and_triplets():
    assert S.best_alias("Rome", "rome", []) == (1.0, "rome")
    assert S.best_alias("roma", "xx", ["Roma", "roma"]) == (1.0, "Roma")
    assert S.best_alias("ab", "ax", ["ay"]) == (0.5, "ay")
    got = S.tagged_triplets("tp_XX<triplet> A B <per> C <loc> lives in <triplet> D <org> E <loc> in <per> F <loc> near</s>")
    assert [(t["head"], t["rel"], t["tail"]) for t in got] == [("A B", "lives in", "C"), ("D", "in", "E"), ("D", "near", "F")]
    assert S.tagged_triplets("") == [] and S.tagged_triplets("<triplet> A <per> B") == [] and S.tagged_triplets(None) == []
