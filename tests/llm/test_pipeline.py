from collections import Counter

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from lipika.llm import mixing, packing, toxicity
from lipika.llm.registry import ORACLES, QUERIES


def test_stages_against_brute_force(spark, docs, rows, tmp_path):
    """Every stage on its predecessor's rows, compared with a plain version of it."""
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], int(i % 4 == 0)) for i, r in enumerate(rows)], "doc_id LONG, toxic INT")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    d, now = str(tmp_path), docs
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, now, d).cache())
        now = kept[-1]
    for df in kept[:-1]:
        assert df.columns == docs.columns
    toxic, lines, near, mixed, packed = kept

    def texts(df):
        return {r[0]: r[1] for r in df.select("doc_id", "text").collect()}

    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert set(texts(toxic)) == {i for i, s in scores.items() if s < 0.5}
    assert texts(lines) == brute.lines(list(texts(toxic).items()))
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in lines.collect())
    assert set(texts(near)) == {i for i, (_, c) in brute.ngram(list(texts(lines).items())).items() if i == c}
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(near).collect() if r["taken"]}
    repeats = Counter(r["doc_id"] for r in near.collect())
    assert Counter(r["doc_id"] for r in mixed.collect()) == {i: n * repeats[i] for i, n in times.items()}
    pieces = packing.pieces(mixed).collect()
    assert Counter((r["id"], r["piece"], r["ids_crc32"]) for r in pieces) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed.collect())
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))


def test_empty_tables(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id LONG, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered(spark, sf):
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES if q.startswith("op")} and set(ORACLES) <= set(QUERIES)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for q in ("op3_quality_classifier", "op7_toxicity"):
        assert QUERIES[q](spark, sf).filter(F.col("score").between(0, 1)).count() == n
