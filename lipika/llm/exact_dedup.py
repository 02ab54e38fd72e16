"""Stateful streaming exact deduplication, DataFrame and SQL functions only.

1. A stream turns each row into (id, digest, content locator) and appends it to a table.
2. A second stream feeds that table to keyed state: digest -> (largest id, its locator, rows seen). The state lives in
   RocksDB under the checkpoint and never expires; a later run with the same checkpoint folder goes on from it.
3. The state is read back and joined to every row. Rows whose digest was hit again have their full normalised bytes
   compared: min = max over a digest's texts holds only if all are byte-identical, and both are pre-aggregated before
   the exchange, so a hot group costs one row per task. A digest that covers different texts is split by the text.

Files that an earlier run has seen must still be there while their rows are hit; only those with hits are read again.

Defined results. Null text counts as empty. Null ids are allowed and rank lowest. Rows that repeat an id are separate
rows; of equal (id, text) the one latest by (file, row) stays. An empty table gives no rows.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lipika.llm.common import ascii_lower, is_empty, remove, scratch, settings, stored, tidied

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: space for logs is not reserved ahead.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    "spark.sql.streaming.metricsEnabled": "false",
}


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _wanted(spark: SparkSession, path: str, id_col: str, text_col: str) -> T.StructType:
    """The two columns; a schema without the others keeps a column named ``_metadata`` away from the file source's own."""
    schema = spark.read.parquet(path).schema
    return T.StructType([schema[id_col], schema[text_col]])


def _source(spark: SparkSession, path: str, wanted: T.StructType) -> DataFrame:
    # A file stream takes a folder or a glob; one bracket makes a single file's path a glob of itself.
    glob = path[:-1] + f"[{path[-1]}]"
    return spark.readStream.schema(wanted).parquet(glob)


def _literal(file: str) -> str:
    """A file's path as a locator gives it, as a path to read: without escapes, and no glob."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


@tidied
def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256_digest,
    state_dir: str | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``digest`` maps the normalised text to a key; any function of the text gives the same groups, for the bytes decide.
    ``state_dir`` keeps digests and state between runs; by default a fresh scratch folder.
    """
    root = state_dir or scratch(spark, "dedup")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    wanted = _wanted(spark, path, id_col, text_col)
    rows = _source(spark, path, wanted).select(
        F.col(id_col).alias("id"),
        digest(norm).alias("digest"),
        sha256_digest(norm).alias("text_sha256"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    with settings(spark, STATE_CONF):
        (
            rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/rows_cp")
            .trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
        )
        digests = spark.read.schema(rows.schema).parquet(f"{root}/rows")
        if is_empty(digests):
            return digests.select(
                F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                F.lit(True).alias("kept"), "text_sha256",
            )
        (
            spark.readStream.schema(rows.schema).parquet(f"{root}/rows")
            .groupBy("digest")
            .agg(F.max(F.struct("id", "file", "row")).alias("keeper"), F.count("*").alias("n"))
            .writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True).start().awaitTermination()
        )
    raw = spark.read.format("statestore").load(f"{root}/state")
    (keeper, n) = raw.schema["value"].dataType.fieldNames()
    state = stored(
        raw.select(F.col("key.digest").alias("digest"), F.col("value")[keeper].alias("keeper"), F.col("value")[n].alias("n")),
        "dedup-state",
    )
    found = digests.join(state, "digest")
    hits = stored(found.filter("n > 1").select("id", "digest", "file", "row"), "dedup-hits")
    # The locator, unique to a row, fetches the hit rows' bytes from their own files, of this run or an earlier one.
    files = [_literal(r["file"]) for r in hits.select("file").distinct().collect()]  # names of files
    docs = spark.read.schema(wanted).parquet(*files) if files else spark.createDataFrame([], wanted).withColumn("_metadata", F.struct(F.lit("").alias("file_path"), F.lit(0).alias("row_index")))
    located = docs.select(
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    content = located.join(hits, ["file", "row"]).select("id", "digest", "file", "row", ascii_lower(F.col("text")).alias("text"))
    mixed = stored(
        content.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("digest"),
        "dedup-mixed",
    )
    if is_empty(mixed):
        out = found
    else:
        # Different texts under one digest: group those by their bytes.
        texts = content.join(mixed, "digest", "left_semi")
        own = texts.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("keeper2"), F.count("*").alias("n2"))
        split = stored(texts.join(own, ["digest", "text"]).select("file", "row", "keeper2", "n2"), "dedup-split")
        out = found.join(split, ["file", "row"], "left").withColumns(
            {"n": F.coalesce("n2", "n"), "keeper": F.coalesce("keeper2", "keeper")}
        )
    return out.select(
        F.col("id").alias(id_col),
        F.col("keeper.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        F.struct("id", "file", "row").eqNullSafe(F.col("keeper")).alias("kept"),
        "text_sha256",
    )


def clear(spark: SparkSession, state_dir: str) -> None:
    """Forget a run's digests and state."""
    remove(spark, state_dir)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
