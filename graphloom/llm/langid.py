"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all documents. The classifier is fitted on
the driver, by follow-the-regularised-leader with L1 and L2 penalties, on at most
``SAMPLE_PER_LANGUAGE`` labelled rows of each language (those of least hash), a
fifth of them held out to fit the temperature. Every document is then scored as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_or_shuffled, unused, written
from .textcore import row_slices, text_bytes

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 300
MIN_CONFIDENCE = 0.5
#: Columns that identified() adds.
ADDED = ("_predicted", "_confidence", "_accepted")
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3
_MULTIPLIERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]
_LETTER = np.zeros(128, dtype=bool)
_LETTER[97:123] = True


def gram_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) with counts, in row order. Grams with no letter don't count."""
    data, offsets = text_bytes(column, lower=True)
    code = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letter = (code >= 0xC0) | _LETTER[np.minimum(code, 127)]
    code = np.where(letter, code, np.uint32(32))
    row = np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(ends))
    keys = []
    for order in ORDERS:
        n = len(code) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order, dtype=np.uint32)
        some = np.zeros(n, dtype=bool)
        for k in range(order):
            h = (h ^ code[k : n + k]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
            some |= letter[k : n + k]
        some &= row[:n] == row[order - 1 :]
        keys.append((row[:n][some] << np.uint64(15)) | (h[some] >> np.uint32(17)))
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if len(column) < 1 << 17:
        key = key.astype(np.uint32)
    key, count = np.unique(key, return_counts=True)
    return (key >> key.dtype.type(15)).astype(np.int64), (key & key.dtype.type(BUCKETS - 1)).astype(np.int64), count


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and how many have each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            total += batch.num_rows
            for part in row_slices(batch, "text"):
                seen += np.bincount(gram_counts(part.column("text"))[1], minlength=BUCKETS)
        kept = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(seen[kept], total))], names=["bucket", "df"])

    table = docs.select("text").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    seen, total = np.zeros(BUCKETS, dtype=np.int64), 0
    for bucket, df in zip(table["bucket"].to_pylist(), table["df"].to_pylist()):
        if bucket < 0:
            total = df
        else:
            seen[bucket] = df
    return total, seen


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (labels, buckets)
    bias: np.ndarray
    temperature: float

    def logits(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated logits, and which rows have a gram."""
        out = np.tile(self.bias, (rows, 1))
        some = np.zeros(rows, dtype=bool)
        if len(row):
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            x = (1 + np.log(count)) * self.idf[bucket]
            norm = np.sqrt(np.add.reduceat(x * x, starts))
            some[row[starts]] = True
            for k in range(len(self.labels)):
                out[row[starts], k] += np.add.reduceat(x * self.weights[k][bucket], starts) / norm
        return out, some

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def labelled_sample(docs: DataFrame, per_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of at most per_language labelled rows with text of each language, by least hash."""
    key = F.xxhash64("doc_id", "text", F.lit("langid"))
    usable = docs.where("lang is not null and text is not null")
    least = Window.partitionBy("lang").orderBy("key")
    chosen = written(usable.select("lang", key.alias("key")).distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= per_language).select("key"), "sample")
    rows = usable.select("lang", "text", key.alias("key")).join(small_or_shuffled(chosen.distinct()), "key", "left_semi").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                row, bucket, count = gram_counts(part.column("text"))
                at = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (bucket, count)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("lang"), *lists], names=["key", "lang", "bucket", "count"])

    table = rows.select("key", "lang", "text").mapInArrow(run, "key long, lang string, bucket array<int>, count array<int>").toArrow().sort_by("key").combine_chunks()
    lang = table["lang"].to_pylist()
    return [(lang[i], table["bucket"][i].values.to_numpy(), table["count"][i].values.to_numpy()) for i in range(table.num_rows)]


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """FTRL-proximal on four fifths of the sample, temperature on the rest."""
    labels = sorted({lang for lang, _, _ in sample})
    at = {lang: k for k, lang in enumerate(labels)}
    examples = []
    for lang, bucket, count in sample:
        x = (1 + np.log(count)) * idf[bucket]
        if len(x):
            examples.append((at[lang], bucket, x / np.sqrt((x * x).sum())))
    held, train = examples[::5], [e for i, e in enumerate(examples) if i % 5]
    k = len(labels)
    z, n = np.zeros((k, BUCKETS + 1)), np.zeros((k, BUCKETS + 1))  # the last is the bias, not penalised by L1
    l1 = np.full(BUCKETS + 1, L1)
    l1[-1] = 0

    def weights(index) -> np.ndarray:
        zi = z[:, index]
        return np.where(np.abs(zi) > l1[index], -(zi - np.sign(zi) * l1[index]) / ((BETA + np.sqrt(n[:, index])) / ALPHA + L2), 0)

    for _ in range(EPOCHS):
        for y, bucket, x in train:
            index, x = np.append(bucket, BUCKETS), np.append(x, 1.0)
            w = weights(index)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            old = n[:, index]
            z[:, index] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
            n[:, index] = old + g * g
    w = weights(slice(None))
    model = Model(labels, idf, w[:, :-1], w[:, -1], 1.0)
    if k > 1 and held:
        scores = np.array([w[:, :-1][:, bucket] @ x + w[:, -1] for _, bucket, x in held])
        truth = np.array([y for y, _, _ in held])

        def loss(t: float) -> float:
            s = scores / t
            top = s.max(axis=1)
            log_p = s - (np.log(np.exp(s - top[:, None]).sum(axis=1)) + top)[:, None]
            miss = 1 / (len(held) + 2)  # smoothed targets, else a separable held-out part asks for certainty
            right = log_p[np.arange(len(s)), truth]
            return float(-((1 - miss) * right + miss / (k - 1) * (log_p.sum(axis=1) - right)).mean())

        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
        model.temperature = float(min(grid, key=loss))
    return model


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    total, seen = document_frequencies(docs)
    return fit(labelled_sample(docs, per_language), np.log((1 + total) / (1 + seen)) + 1)


def identified(docs: DataFrame, model: Model, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """docs with _predicted, _confidence and _accepted added last (with more underscores where docs has such columns), every row of docs once.

    _accepted: the calibrated probability of the best language is at least
    min_confidence. A null or empty text, one without letters, or a model that saw no
    labelled row gives null, null and false. Ties go to the first language in order.
    Other columns pass through.
    """

    names = [*docs.columns, *(unused(docs, c) for c in ADDED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                best, sure, some = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                if model.labels:
                    logits, some = model.logits(*gram_counts(part.column("text")), part.num_rows)
                    p = model.probabilities(logits)
                    best, sure = p.argmax(axis=1), p.max(axis=1)
                label = pa.array(model.labels or [""], pa.string()).take(pa.array(best, mask=~some))
                yield pa.RecordBatch.from_arrays([*part.columns, label, pa.array(sure, mask=~some), pa.array(some & (sure >= min_confidence))], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    added = ", ".join(f"{c} {t}" for c, t in zip(names[-3:], ("string", "double", "boolean")))
    return docs.mapInArrow(run, f"{schema}, {added}")


def language_id(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Train on docs (doc_id, text, lang) and identify all of them; an empty table gives no rows."""
    return identified(docs, train(docs, per_language), min_confidence)


def accepted(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of docs that language_id accepts, with the columns of docs, whatever their names."""
    found = language_id(docs, per_language, min_confidence)
    return found.where(F.col(found.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))
