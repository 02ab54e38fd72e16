"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. Every whole text becomes STATS numbers: shares of byte classes and of some class pairs, word and line lengths, how
   often words repeat. They are made from the Arrow buffers in blocks, at a few operations a byte.
2. Random Fourier features of the standardised numbers approximate a Gaussian kernel. Partitions sum their share of the
   normal equations; the sums are added row by row of the matrix, and the driver gets just the one matrix.
3. A quarter of the labelled rows is left out of the fit: their raw scores, counted in BINS bins, give the isotonic
   calibration (pool adjacent violators), which maps any raw score to a probability.

Only labels of rows outside the held-out fold are learned from; neither labels nor lang, source or id enter a score.

Defined results. Null and empty texts have all statistics 0 and are scored like others. Null ids are scored and never
match a label; labels with a null id or value are ignored. A repeated id with a label counts as often as it stands
there. Without any usable label every score is 0.5. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import fold, stored, table, tidied
from lipika.llm.isotonic import pool_adjacent, probability
from lipika.llm.textbytes import blocks

FEATURES = 256
RIDGE = 1e-3
SEED = 7
BINS = 1000
CALIBRATION = 4  # one row in so many

#: Byte classes.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, CRY, SYMBOL, QUOTE, HIGH = range(10)
CLASSES = 10
_CLASS = np.full(256, SYMBOL, np.uint8)
_CLASS[0x80:] = HIGH
for _chars, _k in (
    (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b" \t", SPACE),
    (b"\n\v\f\r", LINE), (b".,;:", STOP), (b"!?", CRY), (b"\"'()[]{}-", QUOTE),
):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
#: Class pairs whose share counts besides the single classes.
PAIRS = ((LOWER, UPPER), (UPPER, UPPER), (CRY, CRY), (SYMBOL, SYMBOL), (STOP, STOP), (LOWER, SYMBOL), (LINE, LINE), (DIGIT, DIGIT))
STATS = CLASSES + len(PAIRS) + 6
_MIX = np.random.default_rng(SEED).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATS numbers for each text; ``offsets`` bound the texts in ``data``."""
    n = len(offsets) - 1
    out = np.zeros((n, STATS))
    length = np.diff(offsets)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n, dtype=np.int64), length)
    kind = _CLASS[data]
    size = np.maximum(length, 1)[:, None]
    out[:, :CLASSES] = np.bincount(doc * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / size
    same = doc[1:] == doc[:-1]
    pair = kind[:-1].astype(np.int64) * CLASSES + kind[1:]
    for j, (a, b) in enumerate(PAIRS):
        hit = np.flatnonzero((pair == a * CLASSES + b) & same)
        out[:, CLASSES + j] = np.bincount(doc[hit], minlength=n) / size[:, 0]
    blank = (kind == SPACE) | (kind == LINE)
    start = ~blank
    start[1:] &= blank[:-1] | ~same
    first = np.flatnonzero(start)
    if len(first):
        # A word's bytes, mixed with their place in the word, add up to its hash.
        place = np.arange(len(data)) - first[np.maximum(np.cumsum(start) - 1, 0)]
        mixed = (_MIX[0][data] * _MIX[1][place & 255]) * ~blank
        word = np.add.reduceat(mixed, first)
        width = np.add.reduceat((~blank).astype(np.int64), first)
        owner = doc[first]
        words = np.bincount(owner, minlength=n)
        mean = np.bincount(owner, width, n) / np.maximum(words, 1)
        square = np.bincount(owner, width.astype(float) ** 2, n) / np.maximum(words, 1)
        # The owner is mixed into the hash, so one sort finds each text's distinct words.
        key = word ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        fresh = np.ones(len(key), bool)
        fresh[1:] = np.diff(key[order]) != 0
        j = CLASSES + len(PAIRS)
        out[:, j] = np.log1p(words)
        out[:, j + 1] = mean
        out[:, j + 2] = np.sqrt(np.maximum(square - mean**2, 0))
        out[:, j + 3] = np.bincount(owner[order][fresh], minlength=n) / np.maximum(words, 1)
        lines = np.bincount(doc[kind == LINE], minlength=n) + 1
        out[:, j + 4] = np.log1p(words / lines)
        out[:, j + 5] = np.log1p(np.bincount(owner, width > 20, n))
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s0, s1, ...) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(data, offsets) for _, data, offsets in blocks(batch.column(1))]
            got = np.concatenate(parts) if parts else np.zeros((0, STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in got.T)], ["id", *(f"s{i}" for i in range(STATS))])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"s{i} double" for i in range(STATS))
    return docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"]).mapInArrow(run, schema)


class Fourier:
    """x -> sqrt(2 / D) cos(W z + b) of the standardised statistics z, and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        # Bandwidth: the root of the dimension, the usual distance of two standardised rows.
        self.w = rng.normal(0, 1 / np.sqrt(d), (d, features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def normal_equations(rows: DataFrame, fourier: Fourier, columns: list[str], target: str) -> np.ndarray:
    """[Z'Z | Z'y] over all rows: summed within partitions, then row of matrix by row of matrix; the driver gets one matrix."""
    width = len(fourier.b) + 2

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width - 1, width))
        for pdf in batches:
            z = fourier(pdf[columns].to_numpy(float))
            total += z.T @ np.column_stack([z, pdf[target].to_numpy(float)])
        yield pd.DataFrame({"i": np.arange(width - 1), "v": [r.tobytes() for r in total]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in pdf["v"])
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [total.tobytes()]})

    sums = rows.select(*columns, target).mapInPandas(partial, "i int, v binary").groupBy("i").applyInPandas(add, "i int, v binary")
    got = sorted((r["i"], r["v"]) for r in sums.collect())  # FEATURES + 1 rows
    return np.array([np.frombuffer(v) for _, v in got]) if got else np.zeros((width - 1, width))


def fit(stats: DataFrame, labelled: DataFrame, columns: list[str]) -> tuple[Fourier, np.ndarray, np.ndarray]:
    """(features, coefficients, calibration) from rows of statistics and of (id, y) labels."""
    row = stats.agg(*(F.avg(c).alias(f"m{c}") for c in columns), *(F.stddev_pop(c).alias(f"d{c}") for c in columns)).first()
    fourier = Fourier(np.array([row[f"m{c}"] or 0.0 for c in columns]), np.array([row[f"d{c}"] or 0.0 for c in columns]))
    rows = stored(stats.join(labelled.withColumnRenamed("id", "lid"), F.col("id") == F.col("lid")).drop("lid"), "quality-labelled")
    out = F.crc32(F.concat(F.lit("calibration:"), F.col("id").cast("string")).cast("binary")) % CALIBRATION == 0
    a = normal_equations(rows.filter(~out), fourier, columns, "y")
    gram, right = a[:, :-1], a[:, -1]
    if not gram.any():
        return fourier, np.zeros(len(right)), np.array([[0.0], [0.5]])
    beta = np.linalg.solve(gram + RIDGE * gram[-1, -1] * np.eye(len(gram)) / len(gram), right)
    raw = scored(rows.filter(out), fourier, beta, None, columns, ["y"])
    b = F.least(F.greatest(F.floor((F.col("raw") + 1) / 3 * BINS), F.lit(0)), F.lit(BINS))
    bins = raw.groupBy(b.alias("b")).agg(F.sum("y").alias("y"), F.count("*").alias("n"), F.avg("raw").alias("x")).collect()  # BINS + 1 rows
    if not bins:
        return fourier, beta, np.array([[0.0, 1.0], [0.0, 1.0]])
    bins = sorted(bins, key=lambda r: r["b"])
    return fourier, beta, pool_adjacent(*(np.array([float(r[k]) for r in bins]) for k in ("x", "y", "n")))


def scored(rows: DataFrame, fourier: Fourier, beta: np.ndarray, curve: np.ndarray | None, columns: list[str], keep: list[str]) -> DataFrame:
    """Kept columns, the raw score and, with a calibration, the probability."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = fourier(pdf[columns].to_numpy(float)) @ beta
            yield pdf[keep].assign(raw=raw, score=probability(curve, raw) if curve is not None else raw)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, *columns).mapInPandas(run, f"{kinds}, raw double, score double")


@tidied
def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1) -> DataFrame:
    """Per row: id, held_out, score, predicted. Rows of fold ``held`` of ``folds`` are never learned from."""
    columns = [f"s{i}" for i in range(STATS)]
    stats = stored(with_statistics(docs, id_col, text_col), "quality-stats")
    known = labels.select(labels[f"`{id_col}`"].alias("id"), labels[f"`{label_col}`"].cast("double").alias("y"))
    known = known.filter((fold(F.col("id"), folds) != held) & F.col("y").isNotNull())
    model = fit(stats, known, columns)
    out = scored(stats, *model, columns, ["id"])
    return out.select(
        F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
