import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import packing

SCHEMA = "doc_id long, text string, used string, pack int"


def naive(lengths, capacity):
    left, out = [], []
    for n in lengths:
        fits = [(r, -i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[-min(fits)[1]] -= n
            out.append(min(fits)[0])
        else:
            left.append(capacity - n)
            out.append(capacity)
    return sorted(left)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=80))
def test_like_naive_best_fit(capacity, lengths):
    lengths = np.array(sorted((min(n, capacity) for n in lengths), reverse=True), dtype=np.int64)
    bins, count = packing.best_fit_decreasing(lengths, capacity)
    used = np.bincount(bins, weights=lengths, minlength=count)
    assert sorted(capacity - used) == naive(lengths.tolist(), capacity)


@pytest.mark.parametrize("parts", [256, 1])
def test_every_token_once(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(n), "x", None) for i, n in enumerate(rng.integers(1, 90, 300))]
    rows += [(900, "z " * 100_000, None, 1), (901, None, None, None), (902, " ", None, None), (None, "a b c", None, None), rows[0], rows[0]]
    packs = packing.packed(spark.createDataFrame(rows, SCHEMA), 64, parts).collect()
    assert sorted(p.pack for p in packs) == list(range(len(packs)))
    spans = {}
    for p in packs:
        assert p.used == sum(p.lengths) <= 64
        for d, s, n in zip(p.doc_ids, p.starts, p.lengths):
            spans.setdefault(d, []).append((s, n))
    size = {}
    for d, t, *_ in rows:
        size[d] = size.get(d, 0) + len((t or "").split())
    assert {d: sum(n for _, n in s) for d, s in spans.items()} == {d: n for d, n in size.items() if n}
    assert sorted(spans[900]) == [(s, min(64, 100_000 - s)) for s in range(0, 100_000, 64)]
    pieces = sorted((min(64, n - s) for _, t, *_ in rows for n in [len((t or "").split())] for s in range(0, n, 64)), reverse=True)
    assert sorted(64 - p.used for p in packs) == naive(pieces, 64)  # the bins of one best fit over all of them


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0
