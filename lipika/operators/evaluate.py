"""Normalise, evaluate and speak in batches; models are plug-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.functions import wer as E
from lipika.functions.numbers import preprocess
from lipika.functions.postprocess import apply_pauses, postprocess, prompt
from lipika.functions.text import audio_name, data_url, trim
from lipika.sources.models import ENGINES, map_model

MAX_TEXT = 500
EMPTY, TOO_LONG = "Text must not be empty.", f"Text must be at most {MAX_TEXT} characters."


def normalize(df: DataFrame, model: str, column: str = "input", out: str = "normalized") -> DataFrame:
    """Expand numbers, prompt the text model, clean its answer. ``{out}_error`` holds a row's failure."""
    asked = df.withColumn("_prompt", prompt(preprocess(F.col(column))))
    told = map_model(asked, model, "_prompt", "_answer", "string")
    return told.withColumns(
        {out: postprocess(F.col(column), F.col("_answer")), f"{out}_error": F.col("_answer_error")}
    ).drop("_prompt", "_answer", "_answer_error").withColumnRenamed("_answer_seconds", f"{out}_seconds")


def evaluate(pairs: DataFrame, text_model: str, engine: str, recognizer: str) -> DataFrame:
    """Report rows: text-only WER for all, round-trip WER or the synthesis error."""
    rows = normalize(pairs, text_model)
    rows = rows.withColumn("_spoken", apply_pauses(F.col("normalized")))
    rows = map_model(rows, engine, "_spoken", "_audio", "binary")
    rows = map_model(rows, recognizer, "_audio", "transcribed", "string")
    return rows.select(
        "input", F.col("output").alias("reference"), "normalized",
        E.word_error_rate(F.col("output"), F.col("normalized")).alias("normalized_wer"),
        trim(F.col("transcribed")).alias("transcribed"),
        E.round_trip_wer(F.col("output"), trim(F.col("transcribed"))).alias("wer"),
        F.coalesce("normalized_error", "_audio_error", "transcribed_error").alias("error"),
    )


def summary(report: DataFrame) -> DataFrame:
    """Rows, scored, errored, macro averages; NaN where nothing was scored."""
    nan = F.lit(float("nan"))
    return report.agg(
        F.count("*").alias("eval_rows"), F.count("wer").alias("scored"), F.count_if(F.col("wer").isNull()).alias("errored"),
        F.coalesce(F.avg("normalized_wer"), nan).alias("normalizer_wer"), F.coalesce(F.avg("wer"), nan).alias("round_trip_wer"),
    )


def validate(requests: DataFrame, column: str = "text") -> DataFrame:
    """Trimmed text with status 200 or 400 and the reason."""
    t = trim(F.coalesce(F.col(column), F.lit("")))
    empty, long = F.length("clean_text") == 0, F.length("clean_text") > MAX_TEXT
    return requests.withColumn("clean_text", t).withColumns(
        {"status": F.when(empty | long, 400).otherwise(200), "detail": F.when(empty, EMPTY).when(long, TOO_LONG)}
    )


def speak_batch(requests: DataFrame, text_model: str) -> DataFrame:
    """Requests (text, engine) to normalised text, data URL and file name; status 400, 500 or 502 where a step failed.

    An engine that is not registered means the fallback engine. Each model runs once per row that may be spoken; its time
    is reported. Texts with status 400 reach no model.
    """
    asked = validate(requests).withColumn("_asked", F.when(F.col("status") == 200, F.col("clean_text")))
    rows = normalize(asked, text_model, "_asked", "normalized_text")
    rows = rows.withColumn("_spoken", F.when((F.col("status") == 200) & F.col("normalized_text_error").isNull(), apply_pauses(F.col("normalized_text"))))
    chosen = F.when(F.col("engine").isin(*ENGINES), F.col("engine")).otherwise("fallback")
    out = map_model(rows.withColumn("_engine", chosen), "fallback", "_spoken", "_audio", "binary", by="_engine")
    kind = lambda i: F.coalesce(*(F.when(F.col("_engine") == n, e[i]) for n, e in ENGINES.items()))
    out = out.withColumns({"_mime": kind(0), "_ext": kind(1)})
    status = (
        F.when(F.col("status") != 200, F.col("status")).when(F.col("normalized_text_error").isNotNull(), 500)
        .when(F.col("_audio_error").isNotNull(), 502).otherwise(200)
    )
    ok = F.col("status") == 200
    return out.withColumn("status", status).select(
        "text", "engine", "status",
        F.coalesce("detail", F.when(F.col("status") == 500, "normalization failed").when(F.col("status") == 502, "synthesis failed")).alias("detail"),
        F.when(ok, F.col("normalized_text")).alias("normalized_text"),
        F.when(ok, data_url(F.col("_audio"), F.col("_mime"))).alias("audio_url"),
        F.when(ok, F.concat(audio_name(F.col("text"), ""), F.col("_ext"))).alias("name"),
        F.when(ok, F.col("_audio")).alias("bytes"), F.when(ok, F.col("_mime")).alias("mime"),
        F.col("normalized_text_seconds").alias("text_seconds"), F.col("_audio_seconds").alias("audio_seconds"),
    )
