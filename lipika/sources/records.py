"""Reading and writing records: JSON lines, audio, run metadata."""

from __future__ import annotations

import os
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions.text import audio_name
from lipika.schemas import PAIR_DDL, REPORT_DDL, RUN_DDL


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a single machine may do without, and gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lipika-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def set_checkpoints(spark: SparkSession) -> None:
    """Let DataFrames be checkpointed to the shared folder, where nothing is set yet."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Instruction/input/output lines; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(PAIR_DDL).option("mode", "FAILFAST").json(path)


def require_pairs(df: DataFrame) -> DataFrame:
    """Fail on rows without input or output."""
    return df.withColumns(
        {c: F.coalesce(c, F.raise_error(F.lit(f"missing key: {c}")).cast("string")) for c in ("input", "output")}
    )


def read_done(spark: SparkSession, path: str, column: str = "input") -> DataFrame:
    """The distinct keys already written; an absent path has none. Only the key column is parsed."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{column} STRING")
    return spark.read.schema(f"{column} STRING").json(path).select(column).distinct()


def append_pairs(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Null fields are left out, so scored and failed rows have their own shapes."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_DDL).json(path)


def append_run(spark: SparkSession, summary: DataFrame, path: str, engine: str, checkpoint: str, note: str | None = None, commit: str | None = None) -> None:
    """One row of parameters and metrics per run; ``commit`` is this package's own where none is given."""
    row = summary.select(
        F.lit(engine).alias("engine"), F.lit(commit or code_version()).alias("git_commit"), F.lit(checkpoint).alias("checkpoint"),
        "eval_rows", F.lit(note).cast("string").alias("note"), "normalizer_wer", "round_trip_wer",
    )
    row.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_DDL).parquet(path)


def code_version() -> str:
    """The commit of the checkout that this package is in, or "unknown"."""
    here = os.path.dirname(os.path.abspath(__file__))
    try:
        done = subprocess.run(["git", "-C", here, "describe", "--always", "--abbrev=7"], capture_output=True, text=True, check=False)
    except OSError:
        return "unknown"
    return done.stdout.strip() or "unknown"


def write_audio(df: DataFrame, path: str, text: str = "text", payload: str = "bytes", ext: str = "mp3") -> None:
    """Content-addressed audio as a table: name, text, bytes."""
    df.select(audio_name(F.col(text), ext).alias("name"), text, payload).write.mode("overwrite").parquet(path)


def export_audio(df: DataFrame, folder: str) -> None:
    """One file per row, ``folder/name``, into a folder that executors share; rewriting a name is harmless."""

    def save(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, r["name"]), "wb") as f:
                f.write(r["bytes"])

    df.select("name", "bytes").foreachPartition(save)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, bytes)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("bytes"))
