"""Best-fit-decreasing packing with a segment tree over remaining capacities.

Best fit sees a document only as its length, and by decreasing length equal ones come in a row. So the packing of the whole table is
planned from how many pieces there are of each length, a table of at most capacity rows: bins of the same remaining
capacity are kept as ranges of bin numbers at the leaves of the tree, and a run of equal pieces fills a range at a time. The plan says
which bins the pieces of a length go to, by their number among those; pieces are numbered and joined with it in parallel.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import token_count
from .shared import small_or_shuffled, whole_id, written

CAPACITY = 2048
#: Parts in which the pieces of one length are numbered.
PARTS = 256


class OpenBins:
    """Ranges of bins by remaining capacity: a segment tree of counts over 0..capacity, a stack of ranges at each leaf."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, remaining: int, by: int) -> None:
        at = remaining + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, remaining: int, start: int, end: int) -> None:
        self.stacks[remaining].append((start, end))
        self._add(remaining, end - start)

    def take(self, needed: int, most: int) -> tuple[int, int, int] | None:
        """(remaining, start, end) of up to most bins with the least remaining capacity of at least needed, the last put first; taken out."""
        count, at = self.count, needed + self.size
        if not count[at]:
            while True:  # climb to the first ancestor with something to the right
                if at <= 1:
                    return None
                if not at & 1 and count[at + 1]:
                    at += 1
                    break
                at >>= 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        remaining = at - self.size
        start, end = self.stacks[remaining].pop()
        if end - start > most:
            self.stacks[remaining].append((start, end - most))
            start = end - most
        self._add(remaining, start - end)
        return remaining, start, end


def plan(lengths: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing of (length, how many), longest first: (length, first, bin, each) and the number of bins.

    The pieces of a length from number first on go to the bins from bin on, each of them taking so many, until the next
    row's first. A bin that takes several pieces of a length is the tightest again after each, so it takes them in a row.
    """
    bins, rows, n = OpenBins(capacity), [], 0
    for length, left in lengths:
        first = 0
        while left:
            found = bins.take(length, left)
            if found is None:
                each = capacity // length
                number = max(1, left // each)
                found = capacity, n, n + number
                n += number
            remaining, start, end = found
            each = min(remaining // length, left)
            full = min(end - start, left // each)
            if full < end - start:  # too few pieces for all of these bins
                if found[0] < capacity:
                    bins.put(remaining, start + full, end)
                else:
                    n -= end - start - full
                end = start + full
            rows.append((length, first, start, each))
            first, left = first + full * each, left - full * each
            if remaining - each * length:
                bins.put(remaining - each * length, start, end)
    return rows, n


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each piece (lengths 1..capacity, in decreasing order), and the number of bins."""
    size, first, number = np.unique(-lengths, return_index=True, return_counts=True)
    rows, n = plan(zip((-size).tolist(), number.tolist()), capacity)
    bins = np.empty(len(lengths), dtype=np.int64)
    starts = {-s: f for s, f in zip(size.tolist(), first.tolist())}
    ends = {-s: f + c for s, f, c in zip(size.tolist(), first.tolist(), number.tolist())}
    for i, (length, begin, start, each) in enumerate(rows):
        end = starts[length] + rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == length else ends[length]
        at = np.arange(starts[length] + begin, end)
        bins[at] = start + (at - starts[length] - begin) // each
    return bins, n


def packed(docs: DataFrame, capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """(pack, used, doc_ids, starts, lengths): sequences of at most capacity tokens, packed over the whole table.

    Pieces are whole documents; one of more tokens than capacity is cut at multiples of it. Every
    token of docs (doc_id, text, any others) is in one pack, at starts[i] of its document. Rows without tokens
    (null or empty text) are in none. Repeated rows and null doc_ids are documents of their
    own; a doc_id that is no whole number counts as null. Which of several pieces of one length goes where goes by a hash. An empty table gives no packs.
    """
    sized = docs.select(whole_id(), F.xxhash64("doc_id", "text").alias("row"), token_count("text").alias("n")).where("n > 0")
    cut = sized.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("k"))
    start = F.col("k") * capacity
    pieces = written(cut.select("doc_id", "row", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).cast("int").alias("length"), F.pmod(F.xxhash64("row", "k"), F.lit(parts)).cast("int").alias("part")), "pieces")
    counts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")  # capacity * parts rows at most
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("length"))
    rows, _ = plan([(r.length, r.n) for r in by_length.collect()], capacity)

    # every (length, part) has its pieces numbered from where those of the parts before it end
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("row", "start", "doc_id")) - 1
    numbered = pieces.withColumn("within", within).join(small_or_shuffled(written(before, "before")), ["length", "part"])
    known = docs.sparkSession.sparkContext.broadcast(_by_length(rows))  # its size depends on capacity alone

    def run(batches):
        steps = known.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            bins = np.empty(len(length), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                first, begin, each = steps[size]
                step = np.searchsorted(first, number[at], side="right") - 1
                bins[at] = begin[step] + (number[at] - first[step]) // each[step]
            yield pa.RecordBatch.from_arrays([pa.array(bins), *(batch.column(c) for c in ("doc_id", "start", "length"))], names=["pack", "doc_id", "start", "length"])

    placed = numbered.select("doc_id", "start", "length", (F.col("before") + F.col("within")).alias("number")).mapInArrow(run, "pack long, doc_id long, start long, length int")
    held = placed.groupBy("pack").agg(F.sum("length").alias("used"), F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("l"), "doc_id", "start"))).alias("held"))
    return held.select("pack", "used", F.col("held.doc_id").alias("doc_ids"), F.col("held.start").alias("starts"), F.transform("held.l", lambda x: (-x).cast("long")).alias("lengths"))


def _by_length(rows: list[tuple[int, int, int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The steps of a plan by length: first numbers, first bins, pieces of each bin."""
    keys = [-r[0] for r in rows]
    out = {}
    for length in sorted({-k for k in keys}):
        some = np.array([r[1:] for r in rows[bisect_left(keys, -length) : bisect_left(keys, -length + 1)]], np.int64)
        out[length] = some[:, 0], some[:, 1], some[:, 2]
    return out
