"""Growing a corpus: unique merge, resume by anti join, growth until a target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.functions.text import trim
from lipika.schemas import NORMALIZED_DDL, SENTENCES_DDL


def merge_unique(existing: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Union of both as a set; new values are trimmed, blank and null ones dropped."""
    fresh = new.select(trim(F.col(column)).alias(column)).filter(F.col(column) != "")
    return existing.select(column).union(fresh).distinct()


def todo(candidates: DataFrame, done: DataFrame, column: str) -> DataFrame:
    """Candidates whose key is not done yet; the left side's repeats stay."""
    return candidates.join(done.select(column).distinct(), column, "left_anti")


def parse_sentences(replies: DataFrame, column: str) -> DataFrame:
    """One row per sentence of a JSON reply; an absent list is empty."""
    reply = F.from_json(column, SENTENCES_DDL)["sentences"]
    return replies.select(F.explode(F.coalesce(reply, F.array().cast("array<string>"))).alias("input"))


def parse_normalized(replies: DataFrame, reply: str, raw: str) -> DataFrame:
    """The reply's text; the raw text if the reply has none."""
    return replies.withColumn("output", F.coalesce(F.from_json(reply, NORMALIZED_DDL)["normalized_text"], raw))


def grow(seed: DataFrame, batch: Callable[[int], DataFrame], target: int, batch_size: int = 25, column: str = "input") -> DataFrame:
    """Merge batches until ``target`` distinct values or target // batch_size * 4 attempts; ordered by text, cut at target.

    ``batch(i)`` makes the i-th batch. The set so far is checkpointed after every merge, so plans do not grow.
    """
    have = seed.select(column).distinct()
    for i in range(max(1, target // batch_size * 4)):
        if have.count() >= target:
            break
        have = merge_unique(have, batch(i), column).checkpoint()
    return first_values(have, column, target)


def first_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first n rows by a column, without passing them through one task: the column is sorted over range partitions,
    which are counted; whole partitions are taken, and of the one that n falls in, its first rows."""
    parts = df.repartitionByRange(column).withColumn("_part", F.spark_partition_id()).checkpoint()
    left, whole, cut = n, [], None
    for r in sorted(parts.groupBy("_part").count().collect()):  # a row per partition
        if r["count"] <= left:
            whole.append(r["_part"])
            left -= r["count"]
        elif cut is None:
            cut = r["_part"]
            break
    out = parts.filter(F.col("_part").isin(whole))
    if cut is not None and left:
        out = out.unionByName(parts.filter(F.col("_part") == cut).orderBy(column).limit(left))
    return out.drop("_part").orderBy(column)
