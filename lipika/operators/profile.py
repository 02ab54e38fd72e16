"""Corpus quality operators: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lipika.functions import text as X


def with_features(pairs: DataFrame) -> DataFrame:
    """Lengths, pauses, sentence type and script flags of input/output pairs."""
    i, o = F.col("input"), F.col("output")
    return pairs.withColumns(
        {
            "input_chars": X.char_count(i), "output_chars": X.char_count(o),
            "input_words": X.word_count(i), "output_words": X.word_count(o),
            "pause_count": X.pause_count(o), "sentence_type": X.sentence_type(i),
            "input_has_latin": X.has_latin(i), "output_has_latin": X.has_latin(X.without_pauses(o)),
        }
    )


def column_health(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, repeats after the first (nulls are equal), distinct values without null. One scan.

    Texts are told apart by 128 bits of hashes, so that the exchange for distinct values carries no texts.
    """
    parts = []
    for c in columns:
        text = isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))
        d = F.countDistinct(F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(c), F.xxhash64(F.lit(1), c))) if text else F.col(c))
        has_null = F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))
        parts.append(
            F.struct(
                F.lit(c).alias("column_name"), F.count("*").alias("row_count"), F.count_if(F.col(c).isNull()).alias("null_count"),
                (F.count("*") - d - has_null).alias("duplicate_count"), d.alias("distinct_count"),
            )
        )
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, exact interpolated quartiles, max; one row per column."""
    def row(c: str):
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(c).cast("double").alias("max"),
        )

    return df.agg(F.array(*map(row, columns)).alias("a")).select(F.inline("a"))


def frequency(df: DataFrame, column: str, by: str = "count") -> DataFrame:
    """Value counts without null, by key or by descending count (ties by key)."""
    out = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return out.orderBy(column) if by == "key" else out.orderBy(F.desc("n"), column)


def fraction(df: DataFrame, predicate, prefix: str) -> DataFrame:
    """How many rows hold, and which share."""
    return df.agg(F.count_if(predicate).alias(f"{prefix}_count"), F.avg(predicate.cast("double")).alias(f"{prefix}_fraction"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the column's own range, the last one closed, empty bins included."""
    x = F.col(column).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).filter("lo IS NOT NULL")
    # One value only: the range is widened by a half on both sides.
    span = span.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    b = F.least(F.floor((x - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("bigint")
    counts = df.filter(x.isNotNull()).join(F.broadcast(span)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    edges = span.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"), "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    return edges.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("bin_from"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_to"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def unit_histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts for every whole number from 0 to the maximum."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("bigint").alias("value")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("value").alias("top"))
    every = top.filter("top IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("value"))
    return every.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def shortest(df: DataFrame, column: str, row_id: str, n: int = 5) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).orderBy(column, row_id).limit(n)


def longest(df: DataFrame, column: str, row_id: str, n: int = 5) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).orderBy(F.desc(column), row_id).limit(n)


def head(df: DataFrame, row_id: str, n: int | None) -> DataFrame:
    """The first n rows by id; None and 0 mean all; negative numbers are refused."""
    if n is not None and n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(row_id).limit(n) if n else df


def leaks(features: DataFrame) -> DataFrame:
    """Pairs with Latin script on both sides."""
    return features.filter(F.col("input_has_latin") & F.col("output_has_latin"))
