"""Language-model scores by context-tree weighting over the corpus.

Bytes are coded as eight binary decisions, highest bit first; a decision's context is
the bits of its byte so far and the last DEPTH bytes of the document (zero bytes before its
start). The tree of a decision has one node for each context of 0 to DEPTH bytes.
Each node has zeros and ones counted over all documents and a Krichevsky-Trofimov
estimate; its weighted probability is half its own estimate and half the product over its
children (all of it its own at DEPTH). The probability of a bit then mixes the
estimates along its context path by the posterior weights of these halves.

The counts are grams of DEPTH + 1 bytes, counted over every document in every partition and
summed by the end of their contexts. Every gram of the corpus has one cost in bits, so that a document's
code length is a sum of table lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_or_shuffled, whole_id, written
from .textcore import row_slices, text_bytes

DEPTH = 4
#: Depth at which the tree is split into tasks.
TOP = 2
#: Contexts of TOP bytes (4 kB each) up to which what lies above them is broadcast.
UPPER_ROWS = 20_000
#: Grams up to which the costs go to the executors as one table (17 bytes a slot, at most half full); beyond it documents are joined with them.
TABLE_GRAMS = 2_000_000


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The gram of DEPTH + 1 bytes that ends at each byte, as uint64, and the rows' offsets."""
    data, rows = text_bytes(column, lower=False)
    inside = np.ones(len(data), dtype=bool)
    inside[rows[1:] - 1] = False  # the newline that text_bytes adds
    code = data.astype(np.uint64)
    at = np.arange(len(data)) - np.repeat(rows[:-1], np.diff(rows))
    for back in range(1, DEPTH + 1):
        older = np.zeros(len(data), dtype=np.uint64)
        older[back:] = data[:-back]
        older[at < back] = 0
        code |= older << np.uint64(8 * back)
    return code[inside], rows - np.arange(len(rows))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all documents, for each task its own; a gram is an int of DEPTH + 1 bytes, the last the byte coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merge() -> None:
            nonlocal known, count
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            both = np.concatenate([known, new])
            total = np.concatenate([count, n])
            order = np.argsort(both, kind="stable")
            both, total = both[order], total[order]
            starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            known, count = both[starts], np.add.reduceat(total, starts)

        for batch in batches:
            for part in row_slices(batch, "text"):
                waiting.append(grams(part.column("text"))[0])
                if sum(map(len, waiting)) > 4_000_000:
                    merge()
        if sum(map(len, waiting)):
            merge()
        for start in range(0, len(known), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(known[start : start + (1 << 16)].astype(np.int64)), pa.array(count[start : start + (1 << 16)])], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series at x + 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - 1.1447298858494002


@dataclass
class Level:
    """Nodes of one depth: key (context bytes, then the byte's bits so far after a 1), counts, and the weighted ln probability."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    lw: np.ndarray
    own: np.ndarray  # posterior weight of the node's own estimate against its children's

    def mixed(self, below: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of a one from this depth down, given that from the next depth, for paths through the nodes at."""
        p = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        return self.own[at] * p[at] + (1 - self.own[at]) * below

    def parents(self, depth: int) -> tuple[Level, np.ndarray]:
        """The level of that depth above this one, and the parent of each node."""
        key, at = np.unique(self.key & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        zeros, ones, children = (np.bincount(at, weights=x, minlength=len(key)) for x in (self.zeros, self.ones, self.lw))
        own = log_kt(zeros, ones)
        return Level(key, zeros, ones, np.logaddexp(own, children) - np.log(2), 1 / (1 + np.exp(np.clip(children - own, -700, 700)))), at


def subtrees(gram: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, Level]:
    """For distinct grams the probability of a one at each of their 8 decisions (8, grams), from depth TOP down; the nodes at TOP."""
    byte = gram & np.uint64(255)
    keys, bits = [], []
    for k in range(8):
        keys.append((gram & ~np.uint64(255)) | (np.uint64(1 << k) | (byte >> np.uint64(8 - k))))
        bits.append((byte >> np.uint64(7 - k)) & np.uint64(1))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    one = np.concatenate(bits).astype(np.float64) * np.tile(n, 8)
    ones = np.bincount(at, weights=one, minlength=len(key))
    zeros = np.bincount(at, weights=np.tile(n, 8) - one, minlength=len(key))
    level = Level(key, zeros, ones, log_kt(zeros, ones), np.ones(len(key)))
    p = level.mixed(np.zeros(len(at)), at)
    for d in range(depth - 1, TOP - 1, -1):
        level, up = level.parents(d)
        at = up[at]
        p = level.mixed(p, at)
    return p.reshape(8, len(gram)), level


def gram_costs(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, bits): code length of the last byte of each gram after its context.

    Counts go by the last TOP bytes of their contexts to tasks that build all the tree below those nodes; the few nodes
    above are built from the probabilities at TOP.
    """

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        names = ["gram", "suffix", "p", "key", "zeros", "ones", "lw"]

        def built(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(gram, kind="stable")
            gram, n = gram[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            gram, n = gram[starts], np.add.reduceat(n, starts)
            p, top = subtrees(gram, n.astype(np.float64), depth)
            for start in range(0, len(gram), 1 << 14):
                some = gram[start : start + (1 << 14)]
                flat = pa.array(np.ascontiguousarray(p[:, start : start + (1 << 14)].T).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * 8), flat)
                none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(_suffix(some).astype(np.int64)), lists, *none], names=names)
            none = [pa.nulls(len(top.key), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(top.key.astype(np.int64)), *(pa.array(x) for x in (top.zeros, top.ones, top.lw))], names=names)

        for batch in batches:
            gram = np.concatenate([gram, batch.column("gram").to_numpy().astype(np.uint64)])
            n = np.concatenate([n, batch.column("n").to_numpy()])
            if len(gram) > 1 << 19:  # whole suffixes only; the last may go on
                suffix = _suffix(gram)
                cut = int(np.searchsorted(suffix, suffix[-1]))
                if cut:
                    yield from built(gram[:cut], n[:cut])
                    gram, n = gram[cut:], n[cut:]
        if len(gram):
            yield from built(gram, n)

    suffix = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))
    placed = counts.withColumn("suffix", suffix).repartition("suffix").sortWithinPartitions("suffix").select("gram", "n")
    tree = written(placed.mapInArrow(below, "gram long, suffix long, p array<double>, key long, zeros double, ones double, lw double"), "tree")
    above = written(_upper(tree.where("key is not null").select("key", "zeros", "ones", "lw")), "upper")
    found = tree.where("gram is not null").select("gram", "suffix", "p").join(small_or_shuffled(above, UPPER_ROWS), "suffix")
    byte = F.col("gram").bitwiseAND(F.lit(255))
    bits = F.lit(0.0)
    for k in range(8):
        node = F.shiftright(byte, 8 - k).bitwiseOR(F.lit(1 << k)).cast("int")
        one = F.get("sum", node) + F.get("left", node) * F.get("p", F.lit(k))
        bits = bits - F.log2(F.when(F.shiftright(byte, 7 - k).bitwiseAND(F.lit(1)) == 1, one).otherwise(1 - one))
    return found.select("gram", bits.alias("bits"))


def _suffix(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(8)) & np.uint64((1 << 8 * TOP) - 1)


def _upper(top: DataFrame) -> DataFrame:
    """(suffix, sum, left): by contexts of TOP bytes, for each node the part of its probability from depths above TOP and the weight left for the rest.

    There are at most 2 ** (8 * TOP + 8) nodes at TOP, however large the corpus: one task builds what lies above them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        key, *rest = (table[c].to_numpy() for c in ("key", "zeros", "ones", "lw"))
        level = Level(key.astype(np.uint64), *rest, np.ones(len(key)))
        at, path = np.arange(len(key)), []
        for d in range(TOP - 1, -1, -1):
            level, up = level.parents(d)
            at = up[at]
            path.append((level, at))
        total, left = np.zeros(len(key)), np.ones(len(key))
        for level, at in reversed(path):
            total += left * level.mixed(np.zeros(len(key)), at)
            left *= 1 - level.own[at]
        suffix, row = np.unique(key >> 8, return_inverse=True)
        for start in range(0, len(suffix), 1 << 10):
            some = (row >= start) & (row < start + (1 << 10))
            count = min(1 << 10, len(suffix) - start)
            out = []
            for x in (total, left):
                grid = np.zeros((count, 256))
                grid[row[some] - start, key[some] & 255] = x[some]
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * 256), pa.array(grid.ravel())))
            yield pa.RecordBatch.from_arrays([pa.array(suffix[start : start + count]), *out], names=["suffix", "sum", "left"])

    return top.coalesce(1).mapInArrow(run, "suffix long, sum array<double>, left array<double>")


class CostTable:
    """Open addressing from gram to bits."""

    def __init__(self, gram: np.ndarray, bits: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * max(1, len(gram)) - 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.bits, self.full = np.zeros(size, np.uint64), np.zeros(size, np.float64), np.zeros(size, bool)
        gram, todo = gram.astype(np.uint64), np.arange(len(gram))
        slot = self._slot(gram)
        while len(todo):
            free = todo[~self.full[slot[todo]]]
            taken, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[taken], self.bits[taken], self.full[taken] = gram[won], bits[won], True
            todo = todo[self.keys[slot[todo]] != gram[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        """Bits of grams that are all in the table."""
        slot = self._slot(gram)
        todo = np.flatnonzero(self.keys[slot] != gram)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            todo = todo[self.keys[slot[todo]] != gram[todo]]
        return self.bits[slot]


def scored(docs: DataFrame, costs: DataFrame, table_grams: int = TABLE_GRAMS) -> DataFrame:
    """(doc_id, n_bytes, code_bits, bits_per_byte) of each row of docs. code_bits is 0 and bits_per_byte null for
    a null or empty text; costs hold every gram of docs."""
    keyed = docs.select(whole_id(), "text")
    if costs.count() > table_grams:
        return _scored_by_join(docs, costs)
    found = costs.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((found["gram"].to_numpy(), found["bits"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = CostTable(*shared.value)
        for batch in batches:
            for part in row_slices(batch, "text"):
                gram, rows = grams(part.column("text"))
                total = np.concatenate([[0.0], np.cumsum(table(gram))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(rows)), pa.array(total[rows[1:]] - total[rows[:-1]])], names=["doc_id", "n_bytes", "code_bits"])

    out = keyed.mapInArrow(run, "doc_id long, n_bytes long, code_bits double")
    return out.withColumn("bits_per_byte", F.try_divide("code_bits", F.col("n_bytes").cast("double")))


def _scored_by_join(docs: DataFrame, costs: DataFrame) -> DataFrame:
    """As scored, for costs of any size: distinct grams of each row, joined with the costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                gram, rows = grams(part.column("text"))
                known, at = np.unique(gram, return_inverse=True)
                key, n = np.unique(np.repeat(np.arange(part.num_rows), np.diff(rows)) * max(1, len(known)) + at, return_counts=True)
                pick = pa.array(key // max(1, len(known)))
                yield pa.RecordBatch.from_arrays([part.column("row").take(pick), pa.array(known[key % max(1, len(known))].astype(np.int64)), pa.array(n)], names=["row", "gram", "n"])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), whole_id(), "text")
    total = keyed.dropDuplicates(["row"]).select("row", "text").mapInArrow(run, "row long, gram long, n long").join(costs, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("bits")).alias("code_bits"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = keyed.select("row", "doc_id", size.alias("n_bytes")).join(total, "row", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("code_bits", F.lit(0.0)).alias("code_bits"), F.try_divide("code_bits", F.col("n_bytes").cast("double")).alias("bits_per_byte"))


def score(docs: DataFrame) -> DataFrame:
    """Code length of every document under the tree of all of them (doc_id, text; other columns are ignored).

    Repeated rows count, and are scored, each. An empty table, or one without text, gives what scored() gives.
    """
    return scored(docs, written(gram_costs(gram_counts(docs)), "costs"))
