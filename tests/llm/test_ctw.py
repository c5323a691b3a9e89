import math
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import ctw

SCHEMA = "doc_id long, text string, gram string, bits string, n int"


def literal(texts, depth):
    """Code lengths by recursion over the tree, straight from its definition."""
    counts = defaultdict(lambda: [0, 0])
    data = [b"\0" * depth + (t or "").encode() for t in texts]

    def steps(byte):
        for k in range(8):
            yield (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1

    for d in data:
        for i in range(depth, len(d)):
            for node, bit in steps(d[i]):
                for n in range(depth + 1):
                    counts[d[i - n : i], node][bit] += 1
    children = defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append((context, node))

    def own(key):
        a, b = counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(key):
        if len(key[0]) == depth:
            return own(key)
        below = sum(weighted(c) for c in children[key])
        return math.log(0.5 * math.exp(own(key)) + 0.5 * math.exp(below))

    def one(context, node, d=0):
        key = (context[len(context) - d :], node)
        a, b = counts[key]
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        w = 0.5 * math.exp(own(key) - weighted(key))
        return w * p + (1 - w) * one(context, node, d + 1)

    return [sum(-math.log2(p if bit else 1 - p) for i in range(depth, len(d)) for node, bit in steps(d[i]) for p in [one(d[i - depth : i], node)]) for d in data]


@pytest.fixture(scope="module")
def rows():
    return [(1, "abracadabra", None, None, 1), (2, "abra é cad", None, None, 1), (3, "", None, None, 1), (4, None, None, None, None), (None, "bra\nbra", None, None, 1), (1, "abracadabra", None, None, 1)]


def test_against_the_definition(spark, rows):
    want = sorted(zip((r[0] or 0 for r in rows), literal([r[1] for r in rows], ctw.DEPTH)))
    found = ctw.score(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((r.doc_id or 0, r.code_bits) for r in found)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([b for _, b in got], [b for _, b in want], atol=1e-6)
    for r in found:
        assert (r.bits_per_byte is None) == (r.n_bytes == 0)


def test_table_and_join_agree(spark, rows):
    docs = spark.createDataFrame(rows + [(7, "long text " * 100_000, None, None, 1)], SCHEMA)
    counts = ctw.gram_counts(docs)
    assert counts.agg({"n": "sum"}).first()[0] == sum(len((r.text or "").encode()) for r in docs.collect())
    costs = ctw.gram_costs(counts).cache()
    a, b = (sorted((r.doc_id or 0, r.n_bytes, round(r.code_bits, 4)) for r in ctw.scored(docs, costs, limit).collect()) for limit in (10_000, 0))
    assert a == b


def test_cost_table():
    rng = np.random.default_rng(0)
    gram = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    gram[0] = 0
    table = ctw.CostTable(gram, gram.astype(float))
    ask = rng.choice(gram, 20_000)
    assert (table(ask) == ask).all()


def test_empty(spark):
    assert ctw.score(spark.createDataFrame([], SCHEMA)).count() == 0
