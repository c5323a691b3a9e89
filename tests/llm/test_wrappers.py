import re

import numpy as np
import pytest

from graphloom.llm import wrappers

SCHEMA = "page_id long, url string, html string, host string, wrapper string, stream string"


def slow_regex(items):
    """The wrapper as a regular expression over one character per token: T for a text, else by tag."""
    tags = {}

    def one(x):
        if isinstance(x, str):
            return re.escape(tags.setdefault(x, chr(0x4E00 + len(tags))))
        if isinstance(x, int) or x[0] == "#":
            return "T"
        return "(?:" + "".join(map(one, x[1])) + ")" + x[0]

    return "".join(map(one, items)), tags


def page(rng, site, n):
    words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é&amp;t"], k))
    links = "".join(f'<li><a href="/{i}">{words(1)}</a></li>' for i in range(rng.integers(1, 6)))
    ad = f'<div class="ad">{words(3)}</div>' if rng.random() < 0.4 else ""
    body = "".join(f"<p>{words(4)} t{n}</p>" for _ in range(rng.integers(1, 7)))
    return f"<!DOCTYPE html><html><head><title>{words(2)} {n}</title><script>var a='<p>';</script></head><body><ul>{links}</ul>{ad}<h1>Site {site}</h1>{body}<footer>All rights of {site}</footer></body></html>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    return [(i, f"https://www.site{i % 3}.example:8080/a?x={i}", page(rng, i % 3, i), "x", None, None) for i in range(120)]


def test_tokens():
    got = wrappers.tokens('<!-- <p> --><P CLASS="a b" id=x>one &lt;two&gt;\n three<br/><script>if (a<b) "</p>"</script> 1 < 2</p>')
    assert got == ["<p.a.b>", ["#", "one <two> three"], "<br>", ["#", "1 < 2"], "</p>"]


def test_union_free_inference():
    a, b, c = (wrappers.tokens(x) for x in ("<ul><li>1</li><li>2</li></ul><p>x</p>", "<ul><li>3</li></ul><b>opt</b><p>x</p>", "<ul><li>3</li><li>4</li><li>5</li></ul><p>x</p>"))
    items, changed = wrappers.infer([a, b, c])
    assert items == ["<ul>", ["+", ["<li>", -1, "</li>"]], "</ul>", ["?", ["<b>", -1, "</b>"]], "<p>", ["#", "x"], "</p>"]
    assert changed == [a, b]
    assert all(wrappers.accepts(items, s) for s in (a, b, c)) and not wrappers.accepts(items, wrappers.tokens("<ul></ul><p>x</p>"))


def test_reader_against_regular_expressions(rows):
    for site in range(3):
        streams = [wrappers.tokens(r[2]) for r in rows if r[0] % 3 == site]
        items, _ = wrappers.infer(map(wrappers.shortened, streams))
        pattern, tags = slow_regex(items)
        for s in streams:
            text = "".join(tags.get(t, "?") if isinstance(t, str) else "T" for t in s)
            assert wrappers.accepts(items, s) and re.fullmatch(pattern, text)


@pytest.mark.parametrize("fan", [256, 2])
def test_extracts_what_varies(spark, rows, fan):
    frame = spark.createDataFrame(rows, SCHEMA)
    found = wrappers.extracted(frame, wrappers.wrappers(frame, fan)).collect()
    assert len(found) == len(rows) and {r.host for r in found} == {f"www.site{i}.example" for i in range(3)}
    html = {r[0]: re.sub("<script>.*?</script>", "", r[2]) for r in rows}
    assert np.mean([r.matched for r in found]) > 0.95
    for r in found:
        want = [re.sub("&amp;", "&", t) for t in re.findall(r"<(?:p|title|a href=\"/\d+\"|div class=\"ad\")>([^<]*)<", html[r.page_id])]
        assert sorted(r.texts) == sorted(want) and len(r.slots) == len(r.texts)


def test_nulls_long_repeated_and_odd(spark, rows):
    more = [(900, None, None, None, None, None), (901, None, "<p>no host</p>", None, None, None), (902, "http://h.example", "", None, None, None), (903, "not a url", "a < b", None, None, None)]
    more += [(None, "http://one.example/x", "<p>only page</p><p>of it</p>", None, None, None), (904, "http://long.example", "<p>word " * 30_000, None, None, None), rows[0], (905, rows[0][1], "<table><tr><td>quite", None, None, None)]
    found = wrappers.extract(spark.createDataFrame(rows + more, SCHEMA)).collect()
    assert len(found) == len(rows) + len(more)
    by = {r.page_id: r for r in found}
    assert not by[900].matched and by[900].texts == [] and by[902].texts == [] and by[900].host == ""
    assert "no host" in by[901].texts and by[903].host == "" and "a < b" in by[903].texts
    assert by[None].texts == ["only page", "of it"] and by[None].matched
    assert by[904].matched and len(by[904].texts) == 30_000
    assert "quite" in by[905].texts


def test_empty(spark):
    assert wrappers.extract(spark.createDataFrame([], SCHEMA)).count() == 0
