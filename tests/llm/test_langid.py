import numpy as np

from graphloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, key string, bucket int"
SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["shen", "blor", "ist", "und"], "cc": ["éla", "oux", "ieu", "re"]}


def sample(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(rng.integers(3, 40)))
        rows.append((seed * 10_000 + i, text, lang, None, 7))
    return rows


def test_held_out_accuracy_and_calibration(spark):
    model = langid.train(spark.createDataFrame(sample(1, 240), SCHEMA), 80)
    found = langid.identified(spark.createDataFrame(sample(2, 150), SCHEMA), model).collect()
    assert np.mean([r.lang == r._predicted for r in found]) > 0.97
    assert np.mean([r._confidence for r in found]) > 0.9
    assert (model.weights == 0).mean() > 0.5, "the penalty leaves few weights"


def test_frequencies_count_all_documents(spark):
    docs = spark.createDataFrame([(1, "ab", None, None, 0), (2, "AB ab", None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0)], SCHEMA)
    total, seen = langid.document_frequencies(docs)
    assert total == 4 and set(seen[seen > 0]) == {2, 1} and (seen == 2).sum() >= 3


def test_nulls_long_repeated_and_clashing(spark):
    rows = sample(3, 60) + [(1, None, "aa", None, 1), (2, "", "bb", None, 1), (None, "12 ... !!", None, None, None), (3, "kato miru " * 60_000, None, None, 1)]
    rows += rows[:1]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = langid.language_id(docs, 30)
    assert found.columns[:5] == docs.columns
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1, 2, None):
            assert r._predicted is None and r._confidence is None and r._accepted is False
        if r.doc_id == 3:
            assert r._predicted == "aa" and r._accepted


def test_empty_and_unlabelled(spark):
    assert langid.language_id(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = langid.language_id(spark.createDataFrame([(1, "some text", None, None, None)], SCHEMA)).collect()
    assert row._predicted is None and row._accepted is False
    (row,) = langid.language_id(spark.createDataFrame([(1, "some text", "aa", None, None)], SCHEMA)).collect()
    assert row._predicted == "aa" and row._confidence == 1.0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, text, lang, None, k, False, "p", 0.1) for i, text, lang, _, k in sample(5, 30)], SCHEMA + ", _accepted boolean, _predicted string, _confidence double")
    found = langid.language_id(docs, 30)
    assert found.columns == [*docs.columns, "__predicted", "__confidence", "__accepted"]
    kept = langid.accepted(docs, 30)
    assert kept.columns == docs.columns and kept.count() == sum(r["__accepted"] for r in found.collect()) > 20


def test_fit_against_the_definition():
    """Weights of FTRL-proximal recomputed coordinate by coordinate, the temperature by a finer search."""
    rng = np.random.default_rng(6)
    examples = [("ab"[i % 2], np.sort(rng.choice(40, 6, replace=False)) + 20 * (i % 2), rng.integers(1, 4, 6)) for i in range(60)]
    idf = np.ones(langid.BUCKETS)
    model = langid.fit(examples, idf)
    train = [e for i, e in enumerate(examples) if i % 5]
    z, n = {}, {}

    def weight(c, j):
        l1 = 0 if j == "bias" else langid.L1
        v = z.get((c, j), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((langid.BETA + n.get((c, j), 0.0) ** 0.5) / langid.ALPHA + langid.L2)

    def values(e):
        x = 1 + np.log(e[2])
        x = x / np.sqrt((x * x).sum())
        return [*zip(e[1].tolist(), x.tolist()), ("bias", 1.0)]

    for _ in range(langid.EPOCHS):
        for e in train:
            at = values(e)
            s = [sum(weight(c, j) * x for j, x in at) for c in (0, 1)]
            p = np.exp(np.array(s) - max(s))
            p /= p.sum()
            old = {(c, j): weight(c, j) for c in (0, 1) for j, _ in at}
            for c in (0, 1):
                for j, x in at:
                    g = (p[c] - (c == "ab".index(e[0]))) * x
                    before = n.get((c, j), 0.0)
                    z[c, j] = z.get((c, j), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / langid.ALPHA * old[c, j]
                    n[c, j] = before + g * g
    for c in (0, 1):
        assert abs(model.bias[c] - weight(c, "bias")) < 1e-9
        assert all(abs(model.weights[c][j] - weight(c, j)) < 1e-9 for j in range(60))

    def loss(t):
        held, total = examples[::5], 0.0
        miss = 1 / (len(held) + 2)
        for e in held:
            s = np.array([sum(weight(c, j) * x for j, x in values(e)) for c in (0, 1)]) / t
            log_p = s - np.log(np.exp(s - s.max()).sum()) - s.max()
            y = "ab".index(e[0])
            total -= (1 - miss) * log_p[y] + miss * log_p[1 - y]
        return total

    best = min(np.exp(np.linspace(np.log(0.02), np.log(20), 4000)), key=loss)
    assert abs(np.log(best / model.temperature)) < 0.04
