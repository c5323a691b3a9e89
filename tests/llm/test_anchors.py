import numpy as np
import pytest

from graphloom.llm import anchors

SCHEMA = "doc_id long, text string, row string, keep string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["w" + str(i) for i in range(900)]
    rows = []
    for base in range(40):
        text = list(rng.choice(vocabulary, 120))
        for copy in range(3):
            if copy:
                text = text.copy()
                for at in rng.integers(0, 120, 1 + copy):
                    text[at] = rng.choice(vocabulary)
            rows.append((base * 10 + copy, " ".join(text), None, "x"))
    rows += [(900, "", None, None), (901, None, None, None), (None, "a null id", None, None), (902, "long " * 300_000, None, None), (0, rows[0][1], None, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("extra", [anchors.NEAR, anchors.FAR])
def test_anchors_cover(extra):
    covering = anchors._covering(extra)
    value = np.random.default_rng(0).integers(0, 1 << 23, 300)
    flat, at = anchors.section_anchors(value, *covering)
    code = np.unique(anchors.section_anchors(np.arange(0, 1 << 23, 97), *anchors._covering(0))[0])
    for i in range(300):
        own = flat[at[i] : at[i + 1]]
        assert len(set(own.tolist())) == len(own) and np.bitwise_count(value[i] ^ own).max() <= anchors.RADIUS + extra
        near = code[np.bitwise_count(value[i] ^ code) <= anchors.RADIUS + extra]
        assert set(near.tolist()) == set(own.tolist())
    assert len(code) == 4096


def brute(prints, limit):
    pairs = set()
    for i, (a, f1, f2) in enumerate(prints):
        for b, g1, g2 in prints[:i]:
            if bin((f1 ^ g1) & (1 << 64) - 1).count("1") + bin((f2 ^ g2) & (1 << 64) - 1).count("1") <= limit:
                pairs.add((min(a, b), max(a, b)))
    return pairs


def test_pairs_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for base in range(150):
        bits = rng.integers(0, 2, 115)
        for copy in range(3):
            other = bits.copy()
            other[rng.choice(115, rng.integers(1, 15), replace=False)] ^= 1
            number = int("".join(map(str, other)), 2)
            f1, f2 = number & (1 << 64) - 1, number >> 64
            rows.append((base * 3 + copy, f1 - (1 << 64) if f1 >> 63 else f1, f2))
    frame = spark.createDataFrame(rows, "node long, f1 long, f2 long")
    found = {tuple(r) for r in anchors.near_pairs(frame).collect()}
    monkeypatch.setattr(anchors, "MOST_FAR", 0)  # all anchors are joined
    assert {tuple(r) for r in anchors.near_pairs(frame).collect()} == found
    want = brute(rows, anchors.MAX_DISTANCE)
    assert found == want and len(want) > len(brute(rows, 14)) > 50


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 97}, {"BLOCK": 200, "MATCHES": 64, "KEPT": 5}])
def test_links_connect_what_all_pairs_do(spark, monkeypatch, limits):
    """Few links for a cluster of 300 with 44,850 pairs, and none of the others lost, at the greatest distance too, however fingerprints are cut into blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(anchors, name, value)
    rng = np.random.default_rng(6)
    bits = [rng.integers(0, 2, 115) for _ in range(80)]
    numbers = {}
    for base, flips in [(0, 6)] * 300 + [(b, 19) for b in range(1, 80) for _ in range(2)]:
        other = bits[base].copy()
        other[rng.choice(115, rng.integers(flips // 2, flips // 2 + 2) if base == 0 else flips, replace=False)] ^= 1
        for x in (other, bits[base]):
            numbers.setdefault(int("".join(map(str, x)), 2), 7 * len(numbers) + 3)
    rows = [(node, (n & (1 << 64) - 1) - ((n >> 63 & 1) << 64), n >> 64) for n, node in numbers.items()]
    want = brute(rows, anchors.MAX_DISTANCE)
    links = [tuple(r) for r in anchors.linked(spark.createDataFrame(rows, "node long, f1 long, f2 long")).collect()]
    nodes = [r[0] for r in rows]
    assert components(nodes, links) == components(nodes, want)
    assert all(a != b for a, b in links) and len(want) > 40_000 > 10 * len(links)


def test_groups_nulls_and_repeats(docs):
    found = anchors.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    group = {r.doc_id: r.group_id for r in found}
    for base in range(40):
        assert {group[base * 10 + c] for c in range(3)} == {base * 10}
    assert group[900] == 900 and group[901] == 901 and group[None] is None
    kept = anchors.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [b * 10 for b in range(40)] + [900, 901, 902] and ids.count(None) == 1


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert anchors.near_duplicates(none).count() == 0 and anchors.deduplicated(none).count() == 0


def test_clashing_names_and_text_ids(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [("2", words, "r", 1, "k"), ("1", words, None, None, None), ("1", words, "s", None, None), ("x", words, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _row string, _doc int, node string")
    kept = anchors.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == ["1", "x"]
