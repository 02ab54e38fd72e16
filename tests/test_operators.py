import json
import os
import uuid
import math

import pytest
from pyspark.sql import functions as F

from lipika.operators import corpus, evaluate, profile
from lipika.sources import models, records
from lipika.streaming.resume import resume_stream


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_profile(spark):
    df = spark.createDataFrame([(0, 0.0, "a"), (1, 1.0, None), (2, 5.0, "a"), (3, 10.0, None)], "i INT, x DOUBLE, s STRING")
    d = profile.describe(df, ["x"]).first()
    assert (d["p25"], d["p50"], d["p75"], d["n"]) == (0.75, 3.0, 6.25, 4)
    assert rows(profile.column_health(df, ["s", "i"])) == [("s", 4, 2, 2, 1), ("i", 4, 0, 0, 4)]
    h = profile.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 0, 1, 0, 1]
    assert [r["n"] for r in profile.histogram(df.filter("i = 0"), "x", 4).orderBy("bin").collect()] == [0, 0, 1, 0]
    assert profile.histogram(df.limit(0), "x").count() == 0
    assert [r["n"] for r in profile.unit_histogram(df, "i").orderBy("value").collect()] == [1, 1, 1, 1]
    assert rows(profile.frequency(df, "s")) == [("a", 2)]
    assert [r["i"] for r in profile.longest(df, "x", "i", 2).collect()] == [3, 2]
    assert profile.head(df, "i", 0).count() == profile.head(df, "i", None).count() == 4
    with pytest.raises(ValueError):
        profile.head(df, "i", -1)


def test_merge_grow_todo(spark):
    frame = lambda *t: spark.createDataFrame([(x,) for x in t], "input STRING")
    one = corpus.merge_unique(frame(), frame("a", "b", " ", "a", "  c  ", None), "input")
    assert sorted(r[0] for r in one.collect()) == ["a", "b", "c"]
    assert sorted(r[0] for r in corpus.merge_unique(one, frame("c", "d"), "input").collect()) == ["a", "b", "c", "d"]
    assert sorted(r[0] for r in corpus.todo(frame("a", "a", "b"), frame("b"), "input").collect()) == ["a", "a"]
    got = corpus.grow(frame("z"), lambda i: frame(f"s{i}", f"t{i}"), 6, batch_size=1)
    assert got.count() == 6
    assert corpus.grow(frame(), lambda i: frame("same"), 50, batch_size=25).count() == 1  # stops at the attempts' cap
    r = spark.createDataFrame([('{"sentences": ["a", "b"]}',), ("{}",)], "reply STRING")
    assert sorted(x[0] for x in corpus.parse_sentences(r, "reply").collect()) == ["a", "b"]


def test_evaluate_and_report(spark, tmp_path):
    models.register("flaky", lambda: lambda t: (_ for _ in ()).throw(ValueError("no audio")) if "bad" in t else t.encode())
    pairs = spark.createDataFrame([("एक.", "एक."), ("bad.", "bad."), ("दोन तीन.", "दोन [pause] तीन.")], "input STRING, output STRING")
    report = evaluate.evaluate(pairs, "echo_input", "flaky", "text_of_bytes").cache()
    by = {r["input"]: r for r in report.collect()}
    assert by["bad."]["error"] == "ValueError: no audio" and by["bad."]["wer"] is None
    assert by["दोन तीन."]["wer"] == 0.0 and by["दोन तीन."]["normalized_wer"] == pytest.approx(1 / 3)
    s = evaluate.summary(report).first()
    assert (s["eval_rows"], s["scored"], s["errored"]) == (3, 2, 1)
    assert math.isnan(evaluate.summary(report.limit(0)).first()["round_trip_wer"])
    records.write_report(report, f"{tmp_path}/report")
    shapes = {frozenset(json.loads(r[0])) for r in spark.read.text(f"{tmp_path}/report").collect()}
    assert {"error" in s for s in shapes} == {True, False} and all(("wer" in s) != ("error" in s) for s in shapes)
    records.append_run(spark, evaluate.summary(report), f"{tmp_path}/runs", "flaky", "none", "n")
    assert records.read_runs(spark, f"{tmp_path}/runs").first()["eval_rows"] == 3


def test_speak_batch(spark):
    req = spark.createDataFrame([(" ", "x"), ("a" * 500, "x"), ("a" * 501, "x"), (None, "x"), ("fine.", None)], "text STRING, engine STRING")
    got = {r["text"]: r for r in evaluate.speak_batch(req, "echo_input").collect()}
    assert got[" "]["status"] == got[None]["status"] == 400 and got[" "]["detail"] == evaluate.EMPTY
    assert got["a" * 501]["detail"] == evaluate.TOO_LONG and got["a" * 500]["status"] == 200
    assert got["fine."]["audio_url"].startswith("data:audio/mpeg;base64,") and got["fine."]["name"].endswith(".mp3")


def test_one_pass_over_several_engines(spark, monkeypatch, tmp_path):
    """Each row's text goes through the text model once, however many engines there are; times are reported."""

    def counted(text):
        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w"):
            return text.split("### Input:\n", 1)[1].rsplit("\n\n### Response:", 1)[0]

    monkeypatch.setitem(models._MODELS, "counted", lambda: counted)
    monkeypatch.setitem(models._MODELS, "down", lambda: lambda t: 1 / 0)
    monkeypatch.setitem(models.ENGINES, "down", ("audio/ogg", "ogg"))
    req = spark.createDataFrame([(f"text {i}.", ["stub_wav", "down", "nobody"][i % 3]) for i in range(9)], "text STRING, engine STRING")
    out = evaluate.speak_batch(req, "counted").collect()
    assert len(os.listdir(tmp_path)) == 9
    assert {(r["engine"], r["status"], r["mime"]) for r in out} == {("stub_wav", 200, "audio/wav"), ("down", 502, None), ("nobody", 200, "audio/mpeg")}
    assert all(r["text_seconds"] >= 0 and r["audio_seconds"] >= 0 for r in out)
    told = models.map_model(req, "fallback", "text", "said", "binary", by="engine")
    spent = models.latency(told, "said").first()
    assert (spent["calls"], spent["errors"]) == (9, 3) and 0 <= spent["mean_seconds"] <= spent["max_seconds"]


def test_first_values(spark):
    records.set_checkpoints(spark)
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(100)], "v STRING").repartition(7)
    for n in (0, 1, 37, 100, 200):
        assert [r[0] for r in corpus.first_values(df, "v", n).collect()] == [f"{i:03d}" for i in range(min(n, 100))]


def test_shown_numbers(spark):
    from lipika.functions import text

    assert tuple(spark.range(1).select(text.percent(F.lit(0.1234)), text.fixed(F.lit(1 / 3))).first()) == ("12.3%", "0.3333")


def test_retry_and_pacing():
    slept, calls = [], []

    def fails(x):
        calls.append(x)
        raise models.Transient

    with pytest.raises(models.Transient):
        models.retrying(fails, 5, lambda k: 4.5 * (k + 1), sleep=slept.append)(1)
    assert len(calls) == 6 and slept == [4.5, 9.0, 13.5, 18.0, 22.5]
    slept.clear()
    with pytest.raises(ValueError):
        models.speech_model(lambda t: b"", sleep=slept.append)("x")
    assert slept == [1.5, 3.0]
    clock = iter([0.0, 0.0, 1.0, 4.5])
    slept.clear()
    call = models.paced(lambda x: x, 4.5, clock=lambda: next(clock), sleep=slept.append)
    call(1), call(2)
    assert slept == [3.5]
    assert models.audio_of_chunks([{"type": "audio", "data": b"a"}, {"type": "x", "data": b"b"}, {"type": "audio", "data": b"c"}]) == b"ac"


def test_records(spark, tmp_path):
    p = f"{tmp_path}/pairs.jsonl"
    with open(p, "w") as f:
        f.write('{"instruction": "i", "input": "क", "output": "ख"}\n\n{"instruction": "i", "input": "ग", "output": null}\n')
    pairs = records.read_pairs(spark, p)
    assert pairs.count() == 2
    with pytest.raises(Exception, match="missing key"):
        records.require_pairs(pairs).collect()
    assert records.read_done(spark, f"{tmp_path}/absent").count() == 0
    assert sorted(r[0] for r in records.read_done(spark, p).collect()) == ["क", "ग"]
    with open(f"{tmp_path}/bad.jsonl", "w") as f:
        f.write("{nope\n")
    with pytest.raises(Exception):
        records.read_pairs(spark, f"{tmp_path}/bad.jsonl").collect()
    audio = spark.createDataFrame([("a.mp3", bytearray(b"x"))], "name STRING, bytes BINARY")
    records.export_audio(audio, f"{tmp_path}/out")
    assert records.read_audio(spark, f"{tmp_path}/out").first()["bytes"] == b"x"
    assert records.code_version()


def test_resume_stream(spark, tmp_path):
    work = lambda b: b.select(F.lit("i").alias("instruction"), "input", F.concat("input", F.lit("!")).alias("output"))
    for wave in (["a", "b"], ["b", "c", "c"]):
        spark.createDataFrame([(x,) for x in wave], "input STRING").write.mode("append").json(f"{tmp_path}/in")
        resume_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", work)
    assert sorted(r["output"] for r in records.read_pairs(spark, f"{tmp_path}/out").collect()) == ["a!", "b!", "c!"]


def test_command_line(spark, tmp_path, capsys):
    from lipika.__main__ import main

    with open(f"{tmp_path}/p.jsonl", "w") as f:
        for t in ("एक दोन.", "तीन?"):
            f.write(json.dumps({"instruction": "i", "input": t, "output": t}) + "\n")
    main(["evaluate", f"{tmp_path}/p.jsonl", f"{tmp_path}/r", "--runs", f"{tmp_path}/runs", "--limit", "1"])
    assert records.read_runs(spark, f"{tmp_path}/runs").first()["eval_rows"] == 1
    main(["speak", "एक.", f"{tmp_path}/audio"])
    assert records.read_audio(spark, f"{tmp_path}/audio").count() == 1
    main(["profile", f"{tmp_path}/p.jsonl"])
    assert "question" in capsys.readouterr().out
    main(["evaluate", f"{tmp_path}/p.jsonl", f"{tmp_path}/r", "--selfcheck"])
    assert "round trip 0.0000, failed 0.0%" in capsys.readouterr().out


def test_building_goes_on_and_skips_failures(spark, tmp_path, capsys, monkeypatch):
    from lipika.__main__ import main

    def reply(text):
        if "bad" in text:
            raise ValueError("no answer")
        return json.dumps({"normalized_text": text.upper()}) if text != "none" else "{}"

    monkeypatch.setitem(models._MODELS, "replies", lambda: reply)
    monkeypatch.setitem(models._MODELS, "must not be asked again", lambda: lambda t: 1 / 0)
    with open(f"{tmp_path}/in.jsonl", "w") as f:
        f.writelines(json.dumps({"input": t}) + "\n" for t in ("a", "b", "b", "bad", "none", ""))
    call = ["build", f"{tmp_path}/in.jsonl", f"{tmp_path}/pairs", "--failures", f"{tmp_path}/failed"]
    main([*call, "--text-model", "replies"])
    assert "3 pairs added, 1 inputs failed" in capsys.readouterr().out
    assert {(r["input"], r["output"]) for r in records.read_pairs(spark, f"{tmp_path}/pairs").collect()} == {("a", "A"), ("b", "B"), ("none", "none")}
    assert [tuple(r) for r in spark.read.schema("input STRING, error STRING").json(f"{tmp_path}/failed").collect()] == [("bad", "ValueError: no answer")]
    main([*call, "--text-model", "must not be asked again"])
    assert "0 pairs added, 1 inputs failed" in capsys.readouterr().out


def test_models_get_their_column_only_and_refused_texts_reach_none(spark, tmp_path):
    """Columns beside the asked one stay out of the workers; texts that are refused are no calls."""

    def seen(text):
        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        return text

    models.register("seen", lambda: seen)
    req = spark.createDataFrame([("a" * 501, "x"), (" ", "x"), (None, "x"), ("fine.", "x")], "text STRING, engine STRING")
    out = {r["text"]: r for r in evaluate.speak_batch(req, "seen").collect()}
    assert len(os.listdir(tmp_path)) == 1 and out["fine."]["status"] == 200 and out["a" * 501]["text_seconds"] is None
    told = models.map_model(req, "fallback", "text", "said", "binary", by="engine")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    big = spark.range(64).coalesce(1).select(F.repeat(F.lit("x"), 1 << 18).alias("t"), "id")
    assert [(r[0], r[1]) for r in models.map_model(big, "bytes_of_text", "t", "said", "binary").select("id", F.length("said")).collect()] == [(i, 1 << 18) for i in range(64)]
