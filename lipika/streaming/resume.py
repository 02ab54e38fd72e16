"""Incremental corpus building as a file stream: each micro-batch does only what is not on disk yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lipika.operators.corpus import todo
from lipika.sources.records import append_pairs, read_done


def resume_stream(spark: SparkSession, incoming: str, output: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], schema: str = "input STRING") -> None:
    """Run over all files of ``incoming`` not seen before, then stop.

    Keys already in ``output`` are excluded by an anti join per micro-batch, so state does not grow with the corpus and
    a batch that ran twice after a failure adds nothing twice.
    """

    def each(batch: DataFrame, _: int) -> None:
        fresh = todo(batch.dropDuplicates(["input"]), read_done(spark, output), "input")
        append_pairs(work(fresh), output)

    (
        spark.readStream.schema(schema).json(incoming).writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )
