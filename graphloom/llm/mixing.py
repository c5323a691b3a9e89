"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_or_shuffled, unused, written

SEED = 17
#: Copies of a document that are numbered at once.
STEP = 1000
#: A token is a maximal run of characters other than space, tab, newline, return and form feed.
TOKEN = r"[^ \t\n\r\f]+"


def token_count(text: str | Column) -> Column:
    """Tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def draw(seed: int) -> Column:
    """A number in [0, 1) from a hash of the seed and the document: its doc_id, or its text where that is null."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: int | None = None) -> DataFrame:
    """(source, tokens, rate): how often each document of a source is to be repeated.

    weights: relative targets by source, null included; sources not named get none. By default all
    sources weigh the same. budget: tokens wanted in all, by default as many as there are.
    A source without tokens has rate 0, as has one without weight.
    """
    tokens = docs.groupBy("source").agg(F.sum(token_count("text")).alias("tokens"))
    if weights is None:
        weighed = tokens.withColumn("weight", F.lit(1.0))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").isNull() if name is None else F.col("source") == name, float(w)).otherwise(weight)
        weighed = tokens.withColumn("weight", weight)
    total = weighed.agg(F.sum("weight").alias("_all"), F.sum("tokens").alias("_tokens"))
    wanted = F.lit(float(budget)) if budget is not None else F.col("_tokens").cast("double")
    rate = F.try_divide(F.try_divide(F.col("weight"), F.col("_all")) * wanted, F.col("tokens").cast("double"))
    return weighed.crossJoin(total).select("source", "tokens", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source, any others) with each row floor(rate) times, and once more
    with the probability of the fraction; _rate and _copy (from 0) are added last, with more underscores where docs has such columns.

    Null sources are one source. Rows of equal doc_id share their draw, so repeated rows
    are repeated alike. Null and empty texts have no tokens but go with their
    source. An empty table gives no rows.
    """
    source, rate, copy = (unused(docs, c) for c in ("_source", "_rate", "_copy"))
    rates = small_or_shuffled(written(source_rates(docs, weights, budget), "rates").select(F.col("source").alias(source), F.col("rate").alias(rate)))
    floor = F.floor(rate)
    copies = floor + F.when(draw(seed) < F.col(rate) - floor, 1).otherwise(0)
    joined = docs.join(rates, docs["source"].eqNullSafe(F.col(source))).drop(source)
    # in two steps, so that no array of numbers grows beyond the root of the copies
    step = F.lit(STEP).cast("long")
    first = joined.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), copies - 1, step)))
    return first.withColumn(copy, F.explode(F.sequence(F.col(copy), F.least(F.col(copy) + (STEP - 1), copies - 1))))


SQL = f"""
WITH t AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens FROM t GROUP BY source),
r AS (SELECT source, coalesce((1::DOUBLE / (SELECT count(*) FROM s)) * (SELECT sum(tokens) FROM s)::DOUBLE / nullif(tokens, 0)::DOUBLE, 0) AS rate FROM s),
c AS (SELECT t.doc_id, t.source, rate,
  ('0x' || substr(md5('{SEED}:' || coalesce(t.doc_id::VARCHAR, t.text, '')), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u
  FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, round(rate, 9) AS rate, unnest(range(0, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT))::BIGINT AS copy FROM c
"""
