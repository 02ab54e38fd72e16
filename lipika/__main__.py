"""Command line: ``python -m lipika evaluate|speak|profile|build ...`` over JSON-lines files.

Options that are the same for every call can stand in ``spark.lipika.<option>`` settings (``spark-defaults.conf`` or
``--conf``): ``engine``, ``text-model``, ``recognizer``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lipika.functions import text, wer
from lipika.operators import corpus, evaluate, profile
from lipika.functions.postprocess import INSTRUCTION
from lipika.sources import models, records


def build(spark: SparkSession, inputs: str, pairs: str, model: str, failures: str | None = None) -> tuple[int, int]:
    """(pairs added, inputs that failed): what the corpus has is skipped, so a stopped run goes on where it was.

    The model answers in JSON; an answer without a text keeps the input. A failure is noted and does not stop the rest.
    """
    todo = corpus.todo(spark.read.schema("input STRING").json(inputs).filter("input <> ''").distinct(), records.read_done(spark, pairs), "input")
    records.set_checkpoints(spark)
    told = models.map_model(todo, model, "input", "_reply", "string").checkpoint()
    made = corpus.parse_normalized(told.filter("_reply IS NOT NULL"), "_reply", "input")
    # Once more right before writing: another run may have written meanwhile.
    made = corpus.todo(made, records.read_done(spark, pairs), "input")
    records.append_pairs(made.select(F.lit(INSTRUCTION).alias("instruction"), "input", "output"), pairs)
    failed = told.filter("_reply_error IS NOT NULL").select("input", F.col("_reply_error").alias("error"))
    if failures:
        failed.write.mode("append").json(failures)
    return told.filter("_reply IS NOT NULL").count(), failed.count()


def selfcheck(spark: SparkSession) -> None:
    """Error rates of known pairs."""
    known = [("a b c", "a b c", 0.0), ("a b c d", "a x c", 0.5), ("", "a", 1.0), ("", "", 0.0)]
    df = spark.createDataFrame(known, "ref STRING, hyp STRING, rate DOUBLE")
    if df.filter(wer.word_error_rate(F.col("ref"), F.col("hyp")) != F.col("rate")).count():
        raise SystemExit("the error rate of a known pair is wrong")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lipika")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate", help="normalise, synthesise, transcribe and score input/output pairs")
    e.add_argument("pairs")
    e.add_argument("report")
    e.add_argument("--limit", type=int, help="first n rows; 0 means all")
    e.add_argument("--engine", choices=sorted(models.ENGINES))
    e.add_argument("--text-model")
    e.add_argument("--recognizer")
    e.add_argument("--runs", help="table that gets a row of parameters and metrics")
    e.add_argument("--note")
    e.add_argument("--commit", help="version to note with the run; by default this package's own")
    e.add_argument("--selfcheck", action="store_true", help="score known pairs first and stop if they come out wrong")
    s = sub.add_parser("speak", help="one text to an audio file")
    s.add_argument("text")
    s.add_argument("folder")
    s.add_argument("--engine", "--voice", choices=sorted(models.ENGINES))
    s.add_argument("--text-model")
    q = sub.add_parser("profile", help="lengths, pauses, sentence types and script leakage of pairs")
    q.add_argument("pairs")
    b = sub.add_parser("build", help="have a model answer inputs that the corpus lacks, and append the pairs")
    b.add_argument("inputs", help="JSON lines with an input each")
    b.add_argument("pairs", help="the corpus; inputs that it has are skipped")
    b.add_argument("--text-model")
    b.add_argument("--failures", help="JSON lines of inputs that failed, with the error")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"lipika {a.command}").getOrCreate()
    for option, default in (("engine", "fallback"), ("text_model", "echo_input"), ("recognizer", "text_of_bytes")):
        if hasattr(a, option) and not getattr(a, option):
            setattr(a, option, spark.conf.get(f"spark.lipika.{option.replace('_', '-')}", default))
    if a.command == "build":
        answered, failed = build(spark, a.inputs, a.pairs, a.text_model, a.failures)
        print(f"{answered} pairs added, {failed} inputs failed")
        return
    if a.command == "speak":
        out = evaluate.speak_batch(spark.createDataFrame([(a.text, a.engine)], "text STRING, engine STRING"), a.text_model)
        row = out.select("status", "detail", "normalized_text", "name").first()
        if row["status"] == 200:
            records.export_audio(out.select("name", "bytes"), a.folder)
        print(*(x for x in row if x is not None), sep="\n")
        return
    pairs = records.read_pairs(spark, a.pairs)
    if a.command == "profile":
        f = profile.with_features(pairs).cache()
        profile.column_health(f, ["instruction", "input", "output"]).show()
        profile.describe(f, ["input_chars", "output_chars", "input_words", "output_words"]).show()
        profile.frequency(f, "sentence_type").show()
        profile.frequency(f, "pause_count", by="key").show()
        profile.fraction(f, F.col("output_has_latin"), "leaked").show()
        return
    if a.limit:
        # File order: by path, place of the block in its file, and place in the block.
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
        pairs = profile.head(pairs.withColumn("_row", place), "_row", a.limit).drop("_row")
    if a.selfcheck:
        selfcheck(spark)
    records.write_report(evaluate.evaluate(records.require_pairs(pairs), a.text_model, a.engine, a.recognizer), a.report)
    summary = evaluate.summary(records.read_report(spark, a.report))
    summary.show()
    shown = summary.select(text.fixed(F.col("normalizer_wer")), text.fixed(F.col("round_trip_wer")), text.percent(F.col("errored") / F.greatest("eval_rows", F.lit(1)))).first()
    print("normaliser error rate {}, round trip {}, failed {}".format(*shown))
    if a.runs:
        records.append_run(spark, summary, a.runs, a.engine, a.text_model, a.note, a.commit)


if __name__ == "__main__":
    main()
