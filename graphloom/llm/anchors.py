"""SimHash near-duplicates by anchor-point covering.

Fingerprint: SimHash of a document's distinct words, 5 sections of 23 bits.
Anchors: the 4096 codewords of the binary Golay code, which covers 23 bits with
radius 3 and no overlap. Of two sections that differ in at most 3 bits, with one of the values at 1 bit from the
first and 2 from the second, the home anchor of that value is within 4 of the first and 5 of the second: one fingerprint is copied to every anchor
within radius + NEAR of a section, the other to every one within radius + FAR, and they meet. Of 5
sections with at most 19 differing bits in all, one differs in at most 3: all
pairs within MAX_DISTANCE are found (``near_pairs``). Sections are searched one after the other, anchors in parallel.

Of the fingerprints that meet at an anchor, under one in a hundred differ in at most 3 bits there. ``linked``, for groups, compares
only those: fingerprints go in blocks, every pair of blocks to one task, which looks up the values of a section at so few bits from each
other; the task returns one link to a root for each fingerprint in a pair, in place of the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected, small_or_shuffled, unused, whole_id, written
from .textcore import distinct_in_rows, give_back, row_slices, segments, simhash, words

SECTIONS, SECTION_BITS, RADIUS, NEAR, FAR = 5, 23, 3, 1, 2
MAX_DISTANCE = SECTIONS * (NEAR + FAR + 1) - 1
#: Fingerprints near an anchor, and far from it, that one task compares; an anchor with more is joined in parallel. Pairs compared at once.
MOST_NEAR, MOST_FAR, AT_ONCE = 1 << 17, 1 << 21, 1 << 18
_GENERATOR = 0b101011100011
#: Fingerprints of a block at most, and blocks at least for as many; bits that may be flipped in the index; matches compared, and pairs kept, at once.
BLOCK, BLOCKS, FLIPPED, MATCHES, KEPT = 1 << 18, 5, 12, 1 << 20, 1 << 22


def _remainders() -> list[np.ndarray]:
    """Remainders of polynomials by the generator, for each of the three bytes of a section."""
    tables = []
    for shift in (0, 8, 16):
        value = np.arange(256, dtype=np.int64) << shift
        for bit in range(SECTION_BITS, 10, -1):
            value = np.where((value >> bit) & 1 == 1, value ^ (_GENERATOR << (bit - 11)), value)
        tables.append(value)
    return tables


def _covering(extra: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Remainder tables; patterns to all anchors within RADIUS + extra, and their offsets by remainder."""
    tables = _remainders()
    remainder = lambda v: tables[0][v & 255] ^ tables[1][(v >> 8) & 255] ^ tables[2][v >> 16]
    bits = np.array([1 << i for i in range(SECTION_BITS)])
    patterns = [np.zeros(1, dtype=np.int64)]
    for _ in range(RADIUS + extra):
        patterns.append(np.unique((patterns[-1][:, None] ^ bits[None, :]).ravel()))
        patterns[-1] = patterns[-1][np.bitwise_count(patterns[-1]) == len(patterns) - 1]
    reach = np.concatenate(patterns)
    reach = reach[np.argsort(remainder(reach), kind="stable")]
    return tables, reach, np.searchsorted(remainder(reach), np.arange(2049))


def section_anchors(section: np.ndarray, tables, reach, offsets) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit value all anchors in reach, flat with offsets."""
    rest = tables[0][section & 255] ^ tables[1][(section >> 8) & 255] ^ tables[2][section >> 16]
    count = offsets[rest + 1] - offsets[rest]
    ends = np.cumsum(count)
    flat = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(offsets[rest], count)
    return np.repeat(section, count) ^ reach[flat], np.concatenate([[0], ends])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(row, doc_id, f1, f2) of each row: 64 + 51 bits; null where a text is null or has no word.

    row is a hash of doc_id and text, so repeated rows share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                feature, first = distinct_in_rows(words(part.column("text")))
                kept, starts = segments(first)
                print_ = simhash(feature, starts, 2)
                print_[:, 1] &= np.uint64((1 << 51) - 1)
                at = np.full(part.num_rows, -1, dtype=np.int64)
                at[kept] = np.arange(len(kept))
                pick = pa.array(at, mask=at < 0)
                halves = [pa.array(np.ascontiguousarray(print_[:, k]).view(np.int64)).take(pick) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *halves], names=["row", "doc_id", "f1", "f2"])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), whole_id(), "text")
    return keyed.mapInArrow(run, "row long, doc_id long, f1 long, f2 long")


def _sections(f1: np.ndarray, f2: np.ndarray) -> list[np.ndarray]:
    low = (1 << SECTION_BITS) - 1
    return [f1 & low, (f1 >> 23) & low, f2 & low, (f2 >> 23) & low, ((f1 >> 46) & 0x3FFFF) | (((f2 >> 46) & 31) << 18)]


def placed(prints: DataFrame, section: int, extra: int) -> DataFrame:
    """(at, node, f1, f2): fingerprints at every anchor within RADIUS + extra of a section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covering = _covering(extra)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                f1, f2 = (part.column(c).to_numpy() for c in ("f1", "f2"))
                at, offsets = section_anchors(_sections(f1, f2)[section], *covering)
                pick = pa.array(np.repeat(np.arange(len(f1)), np.diff(offsets)))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(part.column(c).take(pick) for c in ("node", "f1", "f2"))], names=["at", "node", "f1", "f2"])
        give_back()

    return prints.select("node", "f1", "f2").mapInArrow(run, "at int, node long, f1 long, f2 long")


def _compared(first: np.ndarray, second: np.ndarray, max_distance: int) -> Iterator[np.ndarray]:
    """Pairs of nodes, the lesser first, of rows (node, f1, f2) of first and second that differ in at most max_distance bits."""
    step = max(1, AT_ONCE // max(1, len(second)))
    for start in range(0, len(first), step):
        x = first[start : start + step]
        apart = np.bitwise_count(x[:, None, 1] ^ second[None, :, 1]) + np.bitwise_count(x[:, None, 2] ^ second[None, :, 2])
        i, j = np.nonzero(apart <= max_distance)
        pairs = np.stack([x[i, 0], second[j, 0]], axis=1).view(np.int64)
        pairs.sort(axis=1)
        yield pairs[pairs[:, 0] != pairs[:, 1]]


def near_pairs(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Distinct (a, b), a < b: nodes whose fingerprints meet at an anchor and differ in at most max_distance bits.

    The fingerprints near an anchor come sorted before those far from it, which go by one batch at a time. The pairs of each section are written, so
    that the copies of one section only are about at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, near, far, hot = None, [], 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            at, is_far = batch.column("at").to_numpy(), batch.column("far").to_numpy(zero_copy_only=False)
            values = np.stack([batch.column(c).to_numpy() for c in ("node", "f1", "f2")], axis=1).view(np.uint64)
            found, crowded = [], []
            edges = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (is_far[1:] != is_far[:-1])) + 1, [len(at)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if at[a] != current:
                    current, near, far, hot = at[a], [], 0, False
                if not hot and is_far[a]:
                    far += b - a
                    for part in near:
                        found += _compared(part, values[a:b], max_distance)
                elif not hot:
                    near.append(values[a:b].copy())
                if not hot and (sum(map(len, near)) > MOST_NEAR or far > MOST_FAR):
                    hot, near = True, []
                    crowded.append(int(current))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            columns = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int32())]
            if crowded:
                columns = [pa.concat_arrays([c, more]) for c, more in zip(columns, (pa.nulls(len(crowded), pa.int64()), pa.nulls(len(crowded), pa.int64()), pa.array(crowded, pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "hot"])
        give_back()

    every = None
    for section in range(SECTIONS):
        near, far = placed(prints, section, NEAR), placed(prints, section, FAR)
        both = near.withColumn("far", F.lit(False)).unionByName(far.withColumn("far", F.lit(True))).repartition("at").sortWithinPartitions("at", "far")
        found = written(both.select("at", "far", "node", "f1", "f2").mapInArrow(run, "a long, b long, hot int").distinct(), "met")
        pairs = found.where("a is not null").select("a", "b")
        if (hot := found.where("hot is not null").select(F.col("hot").alias("at"))).head(1):
            pairs = pairs.unionByName(_joined(near.join(hot, "at"), far.join(hot, "at"), max_distance))
        every = pairs if every is None else every.unionByName(pairs)
    return every.distinct()


def _joined(near: DataFrame, far: DataFrame, max_distance: int) -> DataFrame:
    """(a, b), a < b: as near_pairs, for anchors of any size, by a join that the engine splits where it is skewed."""
    x, y = near.alias("x"), far.alias("y")
    apart = F.bit_count(F.col("x.f1").bitwiseXOR(F.col("y.f1"))) + F.bit_count(F.col("x.f2").bitwiseXOR(F.col("y.f2")))
    met = x.join(y, (F.col("x.at") == F.col("y.at")) & (apart <= max_distance) & (F.col("x.node") != F.col("y.node")))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """Patterns of the index (one of FLIPPED bits or none) and of the search: any of at most RADIUS bits is one of the former with one of the latter."""
    bits = [1 << k for k in range(SECTION_BITS)]
    few = [sum(c) for n in range(RADIUS) for c in itertools.combinations(bits, n)]
    return np.array([0, *bits[:FLIPPED]], np.int32), np.array(few + [sum(c) for c in itertools.combinations(bits[FLIPPED:], RADIUS)], np.int32)


def _rooted(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the least of those that the pairs (a, b) connect them with."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _section_pairs(first: np.ndarray, second: np.ndarray, section: int, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in first and second, (rows, 2) fingerprints, of pairs that differ in at most RADIUS bits of a section and max_distance in all; some come more than once."""
    stored, searched = _flips()
    values = [_sections(x[:, 0].view(np.int64), x[:, 1].view(np.int64))[section].astype(np.int32) for x in (first, second)]
    # in the order of the values, what is looked up one after the other is near in memory
    orders = [np.argsort(v) for v in values]
    values, first, second = [v[o] for v, o in zip(values, orders)], first[orders[0]], second[orders[1]]
    at = (values[0][:, None] ^ stored[None, :]).astype(np.int64) << 32 | np.arange(len(first))[:, None]
    at = np.sort(at.ravel())
    place = (at & 0xFFFFFFFF).astype(np.int32)
    offsets = np.zeros((1 << SECTION_BITS) + 1, np.int32)
    np.cumsum(np.bincount(at >> 32, minlength=1 << SECTION_BITS), out=offsets[1:])
    del at
    some = offsets[1:] > offsets[:-1]
    x, y = ([np.ascontiguousarray(side[:, k]) for k in (0, 1)] for side in (first, second))
    word = 1 if section < 2 else 0  # the one with no bit of the section, or few, is compared first
    step = max(1, MATCHES // len(searched))
    for start in range(0, len(second), step):
        key = (searched[:, None] ^ values[1][None, start : start + step]).ravel()
        hit = np.flatnonzero(some[key])
        key, probe = key[hit], start + hit % min(step, len(second) - start)
        low = offsets[key]
        count = offsets[key + 1] - low
        ends = np.cumsum(count, dtype=np.int64)
        edges = np.unique([0, *np.searchsorted(ends, np.arange(MATCHES, int(ends[-1]) if len(ends) else 0, MATCHES)).tolist(), len(key)])
        for u, v in zip(edges[:-1].tolist(), edges[1:].tolist()):
            n = count[u:v]
            i = place[np.arange(n.sum()) + np.repeat(low[u:v] - (np.cumsum(n) - n), n)]
            j = np.repeat(probe[u:v], n)
            apart = np.bitwise_count(x[word][i] ^ y[word][j])
            left = np.flatnonzero(apart <= max_distance)
            i, j = i[left], j[left]
            left = apart[left] + np.bitwise_count(x[1 - word][i] ^ y[1 - word][j]) <= max_distance
            yield orders[0][i[left]], orders[1][j[left]]


def linked(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b) of nodes of prints (node, f1, f2): what they connect is what the pairs within max_distance, at most MAX_DISTANCE, connect."""
    rows = prints.count()
    blocks = max(-(-rows // BLOCK), min(BLOCKS, 1 + rows // 1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        del parts
        later = table.column("later").to_numpy()
        order = np.argsort(later, kind="stable")
        node = table.column("node").to_numpy()[order]
        both = np.stack([table.column(c).to_numpy()[order] for c in ("f1", "f2")], axis=1).view(np.uint64)
        n = len(later) - int(later.sum())
        # a block with itself, or the first block with the second
        second, base = (both, 0) if n == len(both) else (both[n:], n)
        a, b, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for section in range(SECTIONS):
            for i, j in _section_pairs(both[:n], second, section, max_distance):
                a.append(i)
                b.append(j + base)
                size += len(i)
                if size > KEPT:
                    root = _rooted(np.concatenate(a), np.concatenate(b), len(node))
                    i = np.flatnonzero(root != np.arange(len(node)))
                    a, b, size = [i], [root[i]], 0
        root = _rooted(np.concatenate(a), np.concatenate(b), len(node))
        i = np.flatnonzero(root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[root[i]])], names=["a", "b"])
        del table, both, second
        give_back()

    own, other = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    copies = prints.select("node", "f1", "f2", own.alias("own"), other.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    group = (low * (2 * blocks + 1 - low) / 2).cast("int") + high - low
    copies = copies.select(group.alias("group"), (F.col("own") > F.col("other")).cast("int").alias("later"), "node", "f1", "f2")
    return copies.repartitionById(blocks * (blocks + 1) // 2, F.col("group")).select("later", "node", "f1", "f2").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(row, doc_id, group_id, keep) for every row of docs (doc_id, text; other columns are ignored).

    Groups are the connected components of near pairs; group_id is the least
    doc_id of the group, and keep marks its row (the least row of that doc_id).
    Rows of equal doc_id count as one document. A null doc_id (as is one that is no whole number), and a null text or one
    without words, is in no group: group_id is doc_id and keep is true. Repeated
    rows get the same result each; ``deduplicated`` leaves one of them. An empty table gives no rows.
    """
    prints = written(fingerprints(docs), "prints")
    usable = prints.where("f1 is not null and doc_id is not null")
    distinct = written(usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("node")), "distinct")
    links = linked(distinct, max_distance) if max_distance <= MAX_DISTANCE else near_pairs(distinct, max_distance)
    roots = written(connected(links), "roots")
    by_print = distinct.join(small_or_shuffled(roots), "node", "left").withColumn("group_id", F.coalesce("root", "node")).select("f1", "f2", "group_id")
    grouped = usable.join(by_print, ["f1", "f2"]).groupBy("row", "doc_id").agg(F.min("group_id").alias("group_id"))
    # fingerprints of one doc_id with unequal texts, and their groups, are one
    first = grouped.groupBy("group_id").agg(F.min_by("row", F.struct("doc_id", "row")).alias("kept"))
    grouped = grouped.join(first, "group_id").select("row", "group_id", (F.col("row") == F.col("kept")).alias("keep"))
    return prints.join(grouped, "row", "left").select("row", "doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("keep", F.lit(True)).alias("keep"))


def deduplicated(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one of each set of rows equal in doc_id and text; same columns, whatever their names."""
    found = written(near_duplicates(docs, max_distance).groupBy("row", "doc_id").agg(F.min("keep").alias("keep"), F.count("*").alias("n")), "keep")
    doc, row = (unused(docs, c) for c in ("_doc", "_row"))

    def rows(which: str) -> DataFrame:
        return small_or_shuffled(written(found.where(which).select(F.col("doc_id").alias(doc), F.col("row").alias(row)), "rows"))

    same = F.col("doc_id").try_cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("doc_id", "text") == F.col(row))
    kept = docs.join(rows("not keep"), same, "left_anti")
    again = rows("keep and n > 1")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
