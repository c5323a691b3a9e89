"""HTML extraction by union-free wrappers, inferred host by host.

A page is a stream of tags and texts. The wrapper of a host is a union-free regular expression over such
streams: tags, constant texts, text slots, optional groups and repeated groups. It starts as the first page
and is aligned with one page after the other; a mismatch of texts becomes a slot, one of tags a
repeated group where what follows repeats what was just read (on either side), else an optional group up to
the next common tag. Pages are aligned in every partition first; only those that changed a wrapper there (few) go on to be
aligned by host, in a tree of tasks. Then every page is read by the wrapper of its host.

Items of a wrapper: a tag is a string, a slot an int, a constant text ["#", text], a repeated group
["+", items] and an optional group ["?", items].
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_or_shuffled, written
from .textcore import row_slices

#: Streams of one host that one task aligns at most; with more, tasks form a tree.
FAN = 256
#: Hosts up to which the wrappers are broadcast to the pages.
BROADCAST_HOSTS = 5_000
NEW = -1
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s>/]*)([^>]*)>?|[^<]+|<", re.S | re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LONG = 64


def tokens(page: str) -> list:
    """Tags (name and class) and texts ["#", text] of a page; scripts, styles and comments are left out."""
    out: list = []
    text: list[str] = []

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                out.append(["#", whole])

    for m in _PIECE.finditer(page):
        name = m.group(3)
        if name:
            flush()
            kind = _CLASS.search(m.group(4)) if m.group(4) and not m.group(2) else None
            out.append(f"<{m.group(2)}{name.lower()}" + (f".{'.'.join((kind[1] or kind[2] or kind[3] or '').split())}" if kind else "") + ">")
        elif m.group(1) is None and (m.group()[0] != "<" or m.group() == "<"):
            text.append(m.group())
    flush()
    return out


def shortened(stream: list) -> list:
    """As tokens(), with long texts by their digest: all that alignment needs."""
    return [t if t.__class__ is str or len(t[1]) <= _LONG else ["#", "md5:" + md5(t[1].encode()).hexdigest()] for t in stream]


def _same(constant: str, text: str) -> bool:
    return constant == text or (len(text) > _LONG and constant == "md5:" + md5(text.encode()).hexdigest())


def consume(items: list, stream: list, j: int, found: list) -> int:
    """Read stream from j by all the items; the place after, or -1. found gets (slot, text)."""
    n = len(stream)
    for item in items:
        kind = item.__class__
        if kind is str:
            if j >= n or stream[j] != item:
                return -1
            j += 1
        elif kind is int:
            if j >= n or stream[j].__class__ is str:
                return -1
            found.append((item, stream[j][1]))
            j += 1
        elif item[0] == "#":
            if j >= n or stream[j].__class__ is str or not _same(item[1], stream[j][1]):
                return -1
            j += 1
        else:
            times = 0
            while True:
                mark = len(found)
                k = consume(item[1], stream, j, found)
                if k <= j:
                    del found[mark:]
                    break
                j, times = k, times + 1
                if item[0] == "?":
                    break
            if item[0] == "+" and not times:
                return -1
    return j


def accepts(items: list, stream: list) -> bool:
    return consume(items, stream, 0, []) == len(stream)


def slotted(items: list) -> list:
    """Items or tokens with all texts as slots."""
    return [x if x.__class__ is str else NEW if x.__class__ is int or x[0] == "#" else [x[0], slotted(x[1])] for x in items]


def _optional(items: list) -> list:
    items = slotted(items)
    return items[0] if len(items) == 1 and items[0].__class__ is list and items[0][0] == "?" else ["?", items]


def _first_tag(item: object) -> str | None:
    while item.__class__ is list and item[0] != "#":
        item = item[1][0] if item[1] else None
    return item if item.__class__ is str else None


def _repeat(out: list, group: list) -> None:
    """Put a repeated group in place of all copies of it at the end of out."""
    size = len(group)
    while len(out) >= size and slotted(out[-size:]) == group:
        del out[-size:]
    out.append(["+", group])


def learn(items: list, stream: list) -> list:
    """The wrapper generalised so that it reads the stream as well."""
    out: list = []
    i = j = 0
    while i < len(items) or j < len(stream):
        here, there = items[i] if i < len(items) else None, stream[j] if j < len(stream) else None
        if here is not None:
            k = consume([here], stream, j, [])
            if k >= 0:
                out.append(here)
                i, j = i + 1, k
                continue
            here_text = here.__class__ is int or (here.__class__ is list and here[0] == "#")
            if here_text and there is not None and there.__class__ is not str:
                out.append(NEW)
                i, j = i + 1, j + 1
                continue
            if here_text:
                out.append(["?", [NEW]])
                i += 1
                continue
        if there is not None and there.__class__ is not str:
            out.append(["?", [NEW]])
            j += 1
            continue
        # a repeated group: what was just read, again in the page ...
        again = False
        for size in range(1, len(out) + 1) if there is not None else ():
            if out[-size] == there and there[1] != "/":
                group = slotted(out[-size:])
                k = consume(group, stream, j, [])
                if k > j:
                    _repeat(out, group)
                    while (more := consume(group, stream, k, [])) > k:
                        k = more
                    j, again = k, True
                    break
        # ... or again in the wrapper
        for size in range(1, min(len(out), len(items) - i) + 1) if here is not None and not again else ():
            if out[-size] == here and here.__class__ is str and here[1] != "/":
                group = slotted(out[-size:])
                if slotted(items[i : i + size]) == group:
                    _repeat(out, group)
                    while slotted(items[i : i + size]) == group:
                        i += size
                    again = True
                    break
        if again:
            continue
        # optional groups, up to the next common tag
        if here is None:
            out.append(_optional(stream[j:]))
            break
        if there is None:
            out.append(_optional(items[i:]))
            break
        tag = _first_tag(here)
        in_page = next((k for k in range(j + 1, len(stream)) if stream[k] == tag), None) if tag else None
        in_items = next((k for k in range(i + 1, len(items)) if _first_tag(items[k]) == there), None)
        if in_page is not None and (in_items is None or in_page - j <= in_items - i):
            out.append(_optional(stream[j:in_page]))
            j = in_page
        elif in_items is not None:
            out.append(_optional(items[i:in_items]))
            i = in_items
        else:
            out += [_optional([here]), _optional([there])]
            i, j = i + 1, j + 1
    return out


def infer(streams: Iterable[list]) -> tuple[list | None, list[list]]:
    """The wrapper of streams, and those of them that changed it."""
    items, changed = None, []
    for stream in streams:
        if items is None:
            items = list(stream)
        elif accepts(items, stream):
            continue
        else:
            items = learn(items, stream)
        changed.append(stream)
    return items, changed


def numbered(items: list, at: list[int] | None = None) -> list:
    """Items with their slots numbered from 0 in order."""
    at = [0] if at is None else at
    out: list = []
    for x in items:
        if x.__class__ is int:
            out.append(at[0])
            at[0] += 1
        else:
            out.append([x[0], numbered(x[1], at)] if x.__class__ is list and x[0] != "#" else x)
    return out


def host(url: str | Column) -> Column:
    """Lower-case host of a URL, without user and port; empty for null or no host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper) of every host of pages (url, html); wrapper is JSON. Pages without tokens don't count."""

    def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        kept: list[tuple[str, str]] = []
        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                stream = shortened(tokens(page))
                if not stream:
                    continue
                if name not in known:
                    known[name] = stream
                elif accepts(known[name], stream):
                    continue
                else:
                    known[name] = learn(known[name], stream)
                kept.append((name, json.dumps(stream)))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.string()) for i in (0, 1)], names=["host", "stream"])

    def by_group(table: pa.Table) -> pa.Table:
        streams = table["stream"].to_pylist()
        changed = infer(map(json.loads, sorted(streams, key=lambda s: (len(s), s))))[1]
        return pa.Table.from_arrays([pa.array([table["host"][0].as_py()] * len(changed), pa.string()), pa.array([json.dumps(s) for s in changed], pa.string())], names=["host", "stream"])

    def by_host(table: pa.Table) -> pa.Table:
        items, changed = infer(map(json.loads, sorted(table["stream"].to_pylist(), key=lambda s: (len(s), s))))
        items = slotted(items) if items and len(changed) == 1 else items
        return pa.Table.from_arrays([pa.array([table["host"][0].as_py()]), pa.array([json.dumps(numbered(items or []))])], names=["host", "wrapper"])

    source = pages.where("html is not null").select(host("url").alias("host"), "html")
    streams = written(source.mapInArrow(by_partition, "host string, stream string").distinct(), "streams")
    while (most := streams.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > fan:
        # about as many tasks for each host as it takes for fan streams each
        size = streams.groupBy("host").agg(F.ceil(F.count("*") / fan).alias("parts"))
        placed = streams.join(small_or_shuffled(written(size, "sizes")), "host").withColumn("part", F.pmod(F.xxhash64("stream"), "parts"))
        fewer = written(placed.select("host", "stream", "part").groupBy("host", "part").applyInArrow(by_group, "host string, stream string").distinct(), "streams")
        reached = fewer.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        streams = fewer
        if reached > most * 0.8:
            break  # most pages differ in structure: nothing is gained by another round
    return streams.groupBy("host").applyInArrow(by_host, "host string, wrapper string")


def extracted(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, host, matched, slots, texts) of every row of pages, read by the wrappers of wrappers()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list] = {}
        for batch in batches:
            for part in row_slices(batch, "html"):
                matched, slots, texts = [], [], []
                for name, page, wrapper in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), part.column("wrapper").to_pylist()):
                    stream = tokens(page or "")
                    if name not in parsed:
                        if len(parsed) > 2000:
                            parsed.clear()
                        parsed[name] = json.loads(wrapper or "[]")
                    out: list[tuple[int, str]] = []
                    good = consume(parsed[name], stream, 0, out) == len(stream)
                    if not good:  # resolve this page's own mismatches
                        out.clear()
                        if consume(learn(parsed[name], stream), stream, 0, out) != len(stream):
                            out = [(NEW, t[1]) for t in stream if t.__class__ is not str]
                    matched.append(good and bool(stream))
                    slots.append([s for s, _ in out])
                    texts.append([t for _, t in out])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), pa.array(matched, pa.bool_()), pa.array(slots, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))], names=["page_id", "host", "matched", "slots", "texts"])

    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), host("url").alias("host"), "html")
    joined = keyed.join(small_or_shuffled(found, BROADCAST_HOSTS), "host", "left").select("page_id", "host", "html", "wrapper")
    return joined.mapInArrow(run, "page_id long, host string, matched boolean, slots array<int>, texts array<string>")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, matched, slots, texts) of every row of pages (page_id, url, html; others are ignored).

    texts are what the slots of the host's wrapper hold, in order, slots their numbers; constant texts of the wrapper (boilerplate)
    are left out; where all pages of a host are alike, all texts are slots. matched tells that the wrapper reads the whole page; else the page's own mismatches with it are
    resolved for this page, new slots having number -1. A null url, or one without a host, is the host ''. A null or empty page has no
    texts and matched false. Repeated rows come each; an empty table gives no rows.
    """
    return extracted(pages, written(wrappers(pages), "wrappers"))
