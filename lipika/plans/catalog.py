"""Queries: each operator applied to the driver's tables, whole tables and whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lipika.functions import numbers as N
from lipika.functions import postprocess as P
from lipika.functions import text as X
from lipika.functions import wer as E
from lipika.operators import corpus, evaluate, profile
from lipika.sources.records import set_checkpoints, shared_folder
from lipika.streaming.resume import resume_stream

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# Corpus quality


@query
def corpus_profile(spark, d):
    docs = read(spark, d, "documents").select(
        X.sentence_type(F.col("text")).alias("sentence_type"), X.char_count(F.col("text")).alias("chars"), X.word_count(F.col("text")).alias("words")
    )
    out = docs.groupBy("sentence_type").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.avg("words").alias("mean_words")
    )
    return _round(out, "mean_words").orderBy(F.desc("n"), "sentence_type")


@query
def sentence_types_by_key(spark, d):
    docs = read(spark, d, "documents").select(X.sentence_type(F.col("text")).alias("sentence_type"))
    return profile.frequency(docs, "sentence_type", by="key")


@query
def languages_by_count(spark, d):
    return profile.frequency(read(spark, d, "documents"), "lang")


@query
def null_dup_distinct(spark, d):
    return profile.column_health(read(spark, d, "documents"), ["text", "lang", "source"])


def _lengths(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", X.char_count(t).alias("chars"), X.word_count(t).alias("words"))


@query
def length_describe(spark, d):
    return _round(profile.describe(_lengths(spark, d), ["chars", "words"]), "mean", "std", "p25", "p50", "p75")


@query
def length_hist30(spark, d):
    return _round(profile.histogram(_lengths(spark, d), "chars"), "bin_from", "bin_to")


def _paused(spark, d):
    return read(spark, d, "conversations").withColumn("marked", F.replace(F.col("text"), F.lit(", "), F.lit(" [pause] ")))


@query
def pause_hist(spark, d):
    return profile.unit_histogram(_paused(spark, d).select(X.pause_count(F.col("marked")).alias("pauses")), "pauses")


@query
def pause_counts(spark, d):
    return _long(profile.frequency(_paused(spark, d).select(X.pause_count(F.col("marked")).alias("pauses")), "pauses", by="key"), "pauses")


@query
def pause_coverage(spark, d):
    n = X.pause_count(F.col("marked"))
    return _round(
        _paused(spark, d).agg(
            F.count("*").alias("n"), F.count_if(n == 0).alias("without"), F.avg((n == 0).cast("double")).alias("share_without"), F.max(n).cast("bigint").alias("most")
        ),
        "share_without",
    )


def _pairs(spark, d):
    """Pairs from turns: the marked text as output."""
    return _paused(spark, d).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.lit(P.INSTRUCTION).alias("instruction"), F.col("text").alias("input"), F.col("marked").alias("output")
    )


@query
def corpus_features(spark, d):
    cols = ["input_chars", "output_chars", "input_words", "output_words", "pause_count"]
    return _long(profile.with_features(_pairs(spark, d)).select("row_id", *cols, "sentence_type", "input_has_latin", "output_has_latin"), *cols)


@query
def instruction_constant(spark, d):
    return profile.column_health(_pairs(spark, d), ["instruction"])


@query
def latin_coverage(spark, d):
    return _round(profile.fraction(read(spark, d, "documents"), X.has_latin(F.col("text")), "latin"), "latin_fraction")


@query
def latin_leak(spark, d):
    found = profile.leaks(profile.with_features(_pairs(spark, d)))
    return profile.head(found.select("row_id", "input", "output"), "row_id", 10)


@query
def shortest5(spark, d):
    return _long(profile.shortest(_lengths(spark, d), "words", "doc_id"), "chars", "words")


@query
def longest5(spark, d):
    return _long(profile.longest(_lengths(spark, d), "words", "doc_id"), "chars", "words")


@query
def head_rows(spark, d):
    return profile.head(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 5)


@query
def head_all(spark, d):
    return profile.head(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 0)


# Numbers


@query
def int_words(spark, d):
    n = F.floor("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", n.alias("n"), N.int_words(n % N.LIMIT).alias("said"))


@query
def int_words_overflow(spark, d):
    t = F.format_number(F.floor("o_totalprice"), 0)
    return read(spark, d, "orders").select("o_orderkey", t.alias("t"), N.expand_comma_integers(t).alias("said"), N.has_overflow(t).alias("overflow"))


def _lines(spark, d):
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.floor("l_extendedprice").alias("price"), F.floor("l_quantity").cast("bigint").alias("whole")
    )


def _sign(n: Column) -> Column:
    return F.when(n % 4 == 0, "₹").when(n % 4 == 1, "₹ ").when(n % 4 == 2, "$").otherwise("")


def _unit(n: Column) -> Column:
    return F.when(n % 4 == 0, " kg").when(n % 4 == 1, "kg").when(n % 4 == 2, "%").otherwise("°C")


def _key(c: Column) -> list[Column]:
    return [F.col("l_orderkey"), F.col("l_linenumber").cast("bigint").alias("l_linenumber"), c.alias("said")]


@query
def comma_int_expand(spark, d):
    t = F.concat(_sign(F.col("l_linenumber")), F.format_number("price", 0), F.lit(" आहे"))
    return _lines(spark, d).select(*_key(N.expand_comma_integers(t)))


@query
def comma_int_devanagari(spark, d):
    t = F.translate(F.format_number("price", 0), "0123456789", "०१२३४५६७८९")
    return _lines(spark, d).select(*_key(N.expand_comma_integers(t)))


def _decimal(devanagari: bool = False) -> Column:
    t = F.concat(F.col("whole").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return F.translate(t, "0123456789", "०१२३४५६७८९") if devanagari else t


@query
def decimal_expand(spark, d):
    return _lines(spark, d).select(*_key(N.expand_decimals(F.concat(F.lit("साधारण "), _decimal(), F.lit(" आहे")))))


@query
def decimal_half(spark, d):
    return _lines(spark, d).select(*_key(N.expand_decimals(F.concat((F.col("whole") - 1).cast("string"), F.lit(".5 km")))))


@query
def decimal_devanagari(spark, d):
    return _lines(spark, d).select(*_key(N.expand_decimals(_decimal(devanagari=True))))


@query
def currency_guard(spark, d):
    return _lines(spark, d).select(*_key(N.expand_decimals(F.concat(_sign(F.col("l_linenumber")), _decimal()))))


@query
def boundary_guard(spark, d):
    return _lines(spark, d).select(*_key(N.expand_decimals(F.concat(_decimal(), _unit(F.col("l_suppkey"))))))


@query
def preprocess_chain(spark, d):
    t = F.concat(F.format_number("price", 0), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(" व "), F.format_number("price", 0))
    return _lines(spark, d).select(*_key(N.preprocess(t)))


# Around the model


@query
def prompt_build(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", P.prompt(F.col("text")).alias("prompt"))


@query
def stop_marker_cut(spark, d):
    marker = F.element_at(F.array(*map(F.lit, P.HEADINGS)), (F.col("turn") % 3 + 1).cast("int"))
    t = F.concat("text", F.lit("\n"), marker, F.lit(" x "), F.lit(P.HEADINGS[0]), "text")
    return read(spark, d, "conversations").select("conv_id", "turn", P.cut_stop_markers(t).alias("said"))


@query
def sentence_end_count(spark, d):
    return read(spark, d, "documents").select("doc_id", P.sentence_ends(F.col("text")).cast("bigint").alias("ends"))


@query
def runaway_cut(spark, d):
    c = read(spark, d, "conversations").filter(F.col("text").rlike(r"[.!?]\z"))
    return c.select("conv_id", "turn", P.cut_runaway(F.col("text"), F.concat("text", F.lit(" "), "text")).alias("said"))


@query
def restart_cut(spark, d):
    t = F.regexp_replace("text", r"[.,!?\s]+", " ")
    t = F.concat_ws(" ", F.concat(F.lit("w"), F.col("conv_id").cast("string"), F.lit("x"), F.col("turn").cast("string")), F.lit("zq zr"), X.trim(t))
    c = read(spark, d, "conversations").select("conv_id", "turn", t.alias("once"))
    c = c.filter(X.word_count(F.col("once")) >= 6)
    return c.select("conv_id", "turn", P.cut_restart(F.concat("once", F.lit(" [pause] "), "once")).alias("said"))


@query
def apply_pauses(spark, d):
    return _paused(spark, d).select("conv_id", "turn", P.apply_pauses(F.col("marked")).alias("said"))


# Evaluation


def _turns(spark, d):
    """Each user turn with the assistant turn that follows it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, d, "conversations").withColumns({"answer": F.lead("text").over(w), "by": F.lead("role").over(w)})
    return c.filter("role = 'user' AND by = 'assistant'").select("conv_id", "turn", F.col("text").alias("ref"), F.col("answer").alias("hyp"))


@query
def pair_wer(spark, d):
    t = _turns(spark, d)
    return t.select("conv_id", "turn", E.word_distance(X.words(F.col("ref")), X.words(F.col("hyp"))).cast("bigint").alias("distance"), F.round(E.word_error_rate(F.col("ref"), F.col("hyp")), 6).alias("wer"))


@query
def pair_wer_macro(spark, d):
    t = _turns(spark, d).select(E.word_error_rate(F.col("ref"), F.col("hyp")).alias("wer"))
    return _round(t.agg(F.count("*").alias("n"), F.avg("wer").alias("wer")), "wer")


@query
def strip_artifacts_wer(spark, d):
    t = _turns(spark, d)
    ref = F.concat("ref", F.lit(" [pause] "), "ref")
    heard = F.element_at(F.array(*map(F.lit, E.HEARD_PAUSES)), (F.col("turn") % 4 + 1).cast("int"))
    hyp = F.concat("ref", F.lit(" "), heard, F.lit(", "), "ref", F.lit(" x"))
    return t.select("conv_id", "turn", E.strip_heard_pauses(hyp).alias("kept"), F.round(E.round_trip_wer(ref, hyp), 6).alias("wer"))


def _report(spark, d):
    """Turns as an evaluation whose fourth turns failed: what was normalised has a word more in front and lacks the last
    two; the transcript is the text without its first word."""
    c = read(spark, d, "conversations")
    normalized = F.concat(F.lit("so "), F.array_join(F.slice(X.words(F.col("reference")), F.lit(1), F.greatest(F.size(X.words(F.col("reference"))) - 2, F.lit(0))), " "))
    failed = F.col("turn") % 4 == 3
    heard = F.when(~failed, F.array_join(F.slice(X.words(F.col("text")), F.lit(2), F.size(X.words(F.col("text")))), " "))
    return c.select("conv_id", "turn", F.col("text").alias("reference"), heard.alias("transcribed"), F.when(failed, "no audio").alias("error")).withColumns(
        {"normalized_wer": E.word_error_rate(F.col("reference"), normalized), "wer": E.round_trip_wer(F.col("reference"), F.col("transcribed"))}
    )


@query
def eval_report(spark, d):
    return _round(_report(spark, d), "normalized_wer", "wer")


@query
def eval_summary(spark, d):
    return _round(evaluate.summary(_report(spark, d)), "normalizer_wer", "round_trip_wer")


@query
def eval_stub_round_trip(spark, d):
    """The whole evaluation with stand-in models; it shows the plumbing, not any model's quality."""
    pairs = read(spark, d, "conversations").select(F.col("text").alias("input"), F.concat("text", F.lit(" and on")).alias("output"))
    return _round(evaluate.evaluate(pairs, "echo_input", "bytes_of_text", "text_of_bytes"), "normalized_wer", "wer")


@query
def speak_requests(spark, d):
    """Batch requests with stand-in models: a named engine, and names that mean the fallback."""
    docs = read(spark, d, "documents").select("text", F.when(F.col("doc_id") % 3 == 0, "stub_wav").otherwise(F.col("lang")).alias("engine"))
    out = evaluate.speak_batch(docs, "echo_input").select("text", "engine", "status", "detail", "name", "mime")
    return _long(out, "status")


# Hashes, encodings, validation


@query
def audio_name(spark, d):
    return read(spark, d, "documents").select("doc_id", X.audio_name(F.col("text")).alias("name"))


@query
def data_url(spark, d):
    mime = F.when(F.col("turn") % 2 == 0, "audio/wav").otherwise("audio/mpeg")
    return read(spark, d, "conversations").select("conv_id", "turn", X.data_url(F.col("text").cast("binary"), mime).alias("url"))


@query
def validate_requests(spark, d):
    t = F.when(F.col("doc_id") % 7 == 0, F.lit(" \t")).when(F.col("doc_id") % 7 == 1, F.concat(F.lit(" "), F.repeat(F.lit("x"), 500), F.lit(" "))).otherwise(F.col("text"))
    rows = evaluate.validate(read(spark, d, "documents").select("doc_id", t.alias("text")))
    return _long(rows.select("doc_id", "status", "detail"), "status")


@query
def json_roundtrip(spark, d):
    e = read(spark, d, "events")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))
    return e.select("event_id", k.alias("k"), F.get_json_object(F.to_json(F.struct(k.alias("normalized_text"))), "$.normalized_text").alias("again"))


@query
def reply_sentences(spark, d):
    c = read(spark, d, "conversations")
    reply = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.split("text", r"\. ").alias("sentences")))).otherwise("{}")
    return corpus.parse_sentences(c.select(reply.alias("reply")), "reply").select(F.col("input").alias("sentence"))


@query
def reply_default(spark, d):
    c = read(spark, d, "conversations")
    reply = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.upper("role").alias("normalized_text")))).otherwise("{}")
    return corpus.parse_normalized(c.select("conv_id", "turn", F.col("role").alias("raw"), reply.alias("reply")), "reply", "raw").select("conv_id", "turn", "output")


# Corpus building


@query
def merge_unique(spark, d):
    have = read(spark, d, "benchmark").select("text")
    new = read(spark, d, "documents").select(F.concat(F.lit("  "), "text", F.lit("\t")).alias("text")).union(spark.createDataFrame([(" ",), (None,)], "text STRING"))
    return corpus.merge_unique(have, new, "text")


@query
def resume_todo(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    done = docs.filter("doc_id % 3 = 0").select("text")
    return corpus.todo(docs, done, "text").select("doc_id", "text")


@query
def grow_corpus(spark, d):
    """Batches of benchmark texts until all texts of documents and 10 more are there."""
    set_checkpoints(spark)
    docs = read(spark, d, "documents").select(F.col("text").alias("input")).filter("input <> ''").distinct()
    bench = read(spark, d, "benchmark").select("item_id", F.concat(F.lit("bench "), F.col("item_id").cast("string")).alias("input"))
    return corpus.grow(docs, lambda i: bench.filter((F.col("item_id") % 4) == i % 4).select("input"), docs.count() + 10, batch_size=25)


@query
def resume_stream_run(spark, d):
    """Two waves of input files; the second repeats the first and only adds what is new."""
    base = f"{shared_folder(spark)}/resume-{uuid.uuid4().hex}"
    docs = read(spark, d, "documents").select(F.col("text").alias("input"), "doc_id")
    work = lambda b: b.select(F.lit(P.INSTRUCTION).alias("instruction"), "input", F.concat("input", F.lit("!")).alias("output"))
    for mode, rows in (("overwrite", docs.filter("doc_id % 2 = 0")), ("append", docs)):
        rows.select("input").write.mode(mode).json(f"{base}/in")
        resume_stream(spark, f"{base}/in", f"{base}/out", f"{base}/cp", work)
    return spark.read.schema("input STRING, output STRING").json(f"{base}/out")
