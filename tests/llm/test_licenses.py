import numpy as np
import pytest

from graphloom.llm import licenses

SCHEMA = "doc_id long, text string, license string, template int, row string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(500)]
    filler = lambda n: " ".join(rng.choice(vocabulary, n))
    rows, truth = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        rows.append((i, f"{filler(50)}\n{text.upper()}\n{filler(30)}", "x", None, None))
        truth[i] = name
        body = text.split()
        if len(body) > 30:  # two words changed, one dropped, one added
            body[10], body[20] = "changed", "words"
            body = body[:5] + ["added"] + body[5:15] + body[16:]
            rows.append((100 + i, f"{filler(20)} {' '.join(body)} {filler(9)}", None, 1, None))
            truth[100 + i] = name
    rows += [(200 + i, filler(200) + " under the license of", None, None, None) for i in range(20)]
    rows += [(300, None, None, None, None), (301, "", None, None, None), (None, "Released under the MIT License.", None, None, None), (302, "Released under the MIT License. " * 3, None, None, None)]
    rows += [(303, "word " * 200_000 + "Licensed under CC BY-NC 4.0.", None, None, None), rows[0]]
    return spark.createDataFrame(rows, SCHEMA), truth


def test_finds_planted_and_leaves_the_rest(docs):
    frame, truth = docs
    found = licenses.scan(frame).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for i, name in truth.items():
        assert [r.license for r in by[i]] == [name] * (2 if i == 0 else 1), i
    assert not [i for i in by if i is not None and 200 <= i < 302]
    assert [r.license for r in by[None]] == ["MIT"]
    assert sorted((r.first_word, r.last_word) for r in by[302]) == [(0, 4), (5, 9), (10, 14)]
    assert [(r.license, r.first_word) for r in by[303]] == [("CC-BY-NC-4.0", 200_000)]


def test_votes_against_brute_force(spark, docs):
    frame, _ = docs
    grams = licenses.template_grams(spark, licenses.TEMPLATES, licenses.K)
    total = sum(r.votes for r in licenses.candidates(frame.where("doc_id < 303").dropDuplicates(["doc_id"]), grams).collect())
    want = 0
    texts = [r.text for r in frame.where("doc_id < 303").dropDuplicates(["doc_id"]).collect()]
    templates = [licenses.word_hashes(t).tolist() for _, t in licenses.TEMPLATES]
    for text in texts:
        own = licenses.word_hashes(text).tolist()
        for t in templates:
            want += sum(own[i : i + 3] == t[j : j + 3] for i in range(len(own) - 2) for j in range(len(t) - 2))
    assert total == want


def test_common_words():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 20))
        assert licenses.common_words(a, b)[0] == lcs(a.tolist(), b.tolist())


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
