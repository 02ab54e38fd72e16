"""Chroma fingerprints of audio columns, and the alignment of recordings by them.

1. Recordings (WAV bytes) are cut into frames; a frame's spectrum is folded into 12 pitch classes, smoothed over time
   and normalised.
2. FILTERS rectangles slide over the (time, pitch class) image. An integral image makes any rectangle's sum four
   look-ups; the log ratio of two areas is quantised to two Gray-coded bits, and the 16 filters fill a 32-bit integer
   for every position.
3. Two recordings are aligned by the offsets between integers that differ in one bit at most: a block of queries is
   indexed by its runs of equal integers and their 32 neighbours, and recordings' runs are looked up; the offsets of each
   pair of recordings are counted in a histogram, and those with VOTES or more are checked by the share of differing
   bits over the whole overlap.

Recordings of equal integers are one class and searched once. A search takes a query set against all recordings. Tonal
integers meet by chance, more than once for each query and recording, so hits are made and counted where the two blocks
meet, in slices of bounded size, and only alignments become rows. Blocks of packed recordings are what Spark pairs: their
number grows with the product of both tables by its nature, a row for QUERIES * OTHERS pairs of recordings. A run of T
equal integers, as of silence or a held tone, is one entry, and two runs give their offsets with counts, not T * T hits.

Defined results. Null, empty, unreadable and too short audio has an empty fingerprint, aligns with nothing and is its
own class. Equal fingerprints share a class, named by the smallest id. Of equally good alignments the smaller query id,
then the smaller offset is taken. A recording is not aligned with a query of its own id and fingerprint; rows that repeat
an id with other audio are recordings of their own. Null ids are no queries. Empty tables give no rows.
"""

from __future__ import annotations

import contextlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import settings, stored, table, tidied

FRAME_S, HOP_S = 0.256, 0.064
LOWEST, HIGHEST = 110.0, 1760.0
SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
WINDOW = 16
STEP = 0.25
#: (kind, first class, classes, frames): kinds split the rectangle by class, by time, in quarters, or into middle and rest.
FILTERS = tuple(((i * 5) % 4, (i * 7) % 12 if (i * 7) % 12 + 2 + i % 3 * 2 <= 12 else 12 - (2 + i % 3 * 2), 2 + i % 3 * 2, 4 + i % 4 * 4) for i in range(16))
#: Alignment: integers at one offset that differ in one bit at most, least overlap, most differing bits.
VOTES, OVERLAP, ERROR = 4, 24, 0.25
#: Queries of a block, recordings that are searched with one at a time, and integers that either has, about.
QUERIES, OTHERS, CODES = 256, 512, 1 << 18
#: Offsets of runs that are counted at a time.
WORK = 2_000_000
#: Recordings go to and from the workers in batches of so many rows and bytes: by default they are of 10,000 rows.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Recordings that are rendered at a time.
RENDERED = 32


def decode(audio: bytes | None) -> tuple[np.ndarray, int]:
    """(mono samples, rate); empty where the bytes are no PCM WAV."""
    with contextlib.suppress(Exception), wave.open(io.BytesIO(audio or b"")) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
        if width == 1:
            x = np.frombuffer(raw, np.uint8).astype(float) - 128
        elif width in (2, 4):
            x = np.frombuffer(raw, f"<i{width}").astype(float)
        elif width == 3:
            three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((three[:, 2] << 24 | three[:, 1] << 16 | three[:, 0] << 8) >> 8).astype(float)
        else:
            return np.zeros(0), 0
        return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate
    return np.zeros(0), 0


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV of samples in -1..1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_FOLD: dict[tuple[int, int], np.ndarray] = {}


def _fold(size: int, rate: int) -> np.ndarray:
    """Spectrum bins to pitch classes."""
    if (size, rate) not in _FOLD:
        f = np.fft.rfftfreq(size, 1 / rate)
        use = (f >= LOWEST) & (f <= HIGHEST)
        m = np.zeros((len(f), 12))
        m[use, np.round(12 * np.log2(f[use] / 440.0)).astype(int) % 12] = 1
        _FOLD[size, rate] = m
    return _FOLD[size, rate]


def pitch_classes(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12), smoothed and normalised."""
    size, hop = max(1, round(rate * FRAME_S)), max(1, round(rate * HOP_S))
    if len(samples) < size:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    energy = np.empty((len(frames), 12))
    for lo in range(0, len(frames), 4096):
        energy[lo : lo + 4096] = (np.abs(np.fft.rfft(frames[lo : lo + 4096] * np.hanning(size), axis=1)) ** 2) @ _fold(size, rate)
    if len(energy) >= len(SMOOTH):
        energy = np.stack([np.convolve(energy[:, c], SMOOTH, "valid") for c in range(12)], axis=1)
    norm = np.sqrt((energy**2).sum(axis=1, keepdims=True))
    return energy / np.maximum(norm, 1e-9)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """Packed integers, one for each position of a window of WINDOW frames."""
    image = pitch_classes(samples, rate)
    n = len(image) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in FILTERS:
        whole, t, m = area(0, w, c, c + h), w // 2, h // 2
        if kind == 0:
            part = area(0, w, c, c + m)
        elif kind == 1:
            part = area(0, t, c, c + h)
        elif kind == 2:
            part = area(0, t, c, c + m) + area(t, w, c + m, c + h)
        else:
            part = area(w // 4, w - w // 4, c, c + h)
        ratio = np.log1p(part) - np.log1p(np.maximum(whole - part, 0))
        level = (ratio > -STEP).astype(np.uint32) + (ratio > 0) + (ratio > STEP)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(id, codes) of every recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(*decode(a.as_py())).view(np.int32) for a in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], ["id", "codes"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(media[f"`{id_col}`"], media[f"`{audio_col}`"]).mapInArrow(run, f"id {kind}, codes array<int>")


#: An integer's neighbours, itself included, as what to exclusive-or it with.
NEIGHBOURS = np.append(0, 1 << np.arange(32)).astype(np.uint32)


def packed(prints: DataFrame, rows: int) -> DataFrame:
    """(cs, sizes, codes) of (c, codes): up to ``rows`` recordings, or about CODES integers, to a row."""
    step = min(rows, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, ["cs", "sizes", "codes"])

        for part in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
            sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
            held.append((part.column(0).to_numpy(), sizes.astype(np.int64), part.column(1).flatten().to_numpy()))
            if sum(len(h[0]) for h in held) + step > rows or sum(len(h[2]) for h in held) >= CODES:
                yield flush()
        if held:
            yield flush()

    return prints.select("c", "codes").mapInArrow(run, "cs binary, sizes binary, codes binary")


class Prints:
    """The recordings of a packed row, and their runs of equal integers: whose, the integer, first place, length."""

    def __init__(self, cs: bytes, sizes: bytes, codes: bytes):
        self.c, self.size, x = np.frombuffer(cs, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(codes, np.uint32)
        first = np.cumsum(self.size) - self.size
        self.codes = np.split(x, first[1:])
        who = np.repeat(np.arange(len(self.c)), self.size)
        head = np.ones(len(x), bool)
        head[1:] = (x[1:] != x[:-1]) | (who[1:] != who[:-1])
        at = np.flatnonzero(head)
        self.who, self.code, self.start, self.n = who[at], x[at], at - first[who[at]], np.diff(np.append(at, len(x)))


class Index:
    """The runs of a block of queries under their integers and those of one other bit."""

    def __init__(self, queries: Prints):
        self.queries = queries
        probes = (queries.code[:, None] ^ NEIGHBOURS).ravel()
        order = np.argsort(probes, kind="stable")
        self.run = order // len(NEIGHBOURS)
        self.code, first = np.unique(probes[order], return_index=True)
        self.first = np.append(first, len(probes))
        self.sums = np.append(0, np.cumsum(queries.n[self.run]))

    def votes(self, prints: Prints) -> Iterator[tuple[int, int, np.ndarray]]:
        """(q, c, offsets): places in the block and among ``prints``, and the offsets of VOTES integers or more."""
        at = np.minimum(np.searchsorted(self.code, prints.code), len(self.code) - 1)
        lo, hi = self.first[at], np.where(self.code[at] == prints.code, self.first[at + 1], self.first[at])
        work = np.bincount(prints.who, self.sums[hi] - self.sums[lo] + (hi - lo) * (prints.n - 1), minlength=len(prints.c))
        runs = np.append(0, np.cumsum(np.bincount(prints.who, minlength=len(prints.c))))
        ends, c = np.cumsum(work), 0
        while c < len(work):
            last = max(c + 1, int(np.searchsorted(ends, (ends[c - 1] if c else 0) + WORK, side="right")))
            count = self._sparse if ends[last - 1] - (ends[c - 1] if c else 0) <= WORK else self._dense
            yield from count(prints, lo, hi, runs[c], runs[last])
            c = last

    def _pairs(self, lo: np.ndarray, hi: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(run of a recording, run of a query) of equal integers, for the recordings' runs a to b."""
        k = hi[a:b] - lo[a:b]
        return np.repeat(np.arange(a, b), k), self.run[np.arange(k.sum()) + np.repeat(lo[a:b] - np.cumsum(k) + k, k)]

    def _sparse(self, prints: Prints, lo: np.ndarray, hi: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Sorts the hits: two runs give their offsets with counts."""
        q = self.queries
        x, y = self._pairs(lo, hi, a, b)
        k = prints.n[x] + q.n[y] - 1
        offset = prints.start[x] - q.start[y] - q.n[y] + 1
        if (k > 1).any():
            x, y, offset = np.repeat(x, k), np.repeat(y, k), np.arange(k.sum()) + np.repeat(offset - np.cumsum(k) + k, k)
        if not len(x):
            return
        agree = np.minimum(prints.start[x] + prints.n[x], q.start[y] + q.n[y] + offset) - np.maximum(prints.start[x], q.start[y] + offset)
        least, span = int(q.size.max()), int(q.size.max() + prints.size.max())
        key = (prints.who[x] * len(q.c) + q.who[y]) * span + offset + least
        if (agree == 1).all():
            key.sort()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, total = key[first], np.diff(np.append(first, len(key)))
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, total = key[first], np.add.reduceat(agree[order], first)
        key = key[total >= VOTES]
        pair, offset = key // span, key % span - least
        for i, j in _groups(pair):
            yield int(pair[i] % len(q.c)), int(pair[i] // len(q.c)), offset[i:j]

    def _dense(self, prints: Prints, lo: np.ndarray, hi: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Counts one recording's hits in cells, of some queries at a time; two runs' counts by offset are the second sum of four ones."""
        q, c = self.queries, int(prints.who[a])
        width = q.size + prints.size[c] + 3
        ends, pairs = np.cumsum(width), np.cumsum(hi[a:b] - lo[a:b])
        one = 0
        while one < len(width):
            before = int(ends[one - 1]) if one else 0
            last = max(one + 1, int(np.searchsorted(ends, before + WORK, side="right")))
            cells = int(ends[last - 1]) - before
            bend, r = np.zeros(cells, np.int64), 0
            while r < b - a:
                to = max(r + 1, int(np.searchsorted(pairs, (pairs[r - 1] if r else 0) + WORK, side="right")))
                x, y = self._pairs(lo, hi, a + r, a + to)
                mine = (q.who[y] >= one) & (q.who[y] < last)
                x, y, r = x[mine], y[mine], to
                n, m = prints.n[x], q.n[y]
                at = ends[q.who[y]] - width[q.who[y]] - before + q.size[q.who[y]] + prints.start[x] - q.start[y] - m + 1
                bend += np.bincount(at, minlength=cells) + np.bincount(at + n + m, minlength=cells)
                bend -= np.bincount(at + np.minimum(n, m), minlength=cells) + np.bincount(at + np.maximum(n, m), minlength=cells)
            found = np.flatnonzero(bend.cumsum().cumsum() >= VOTES)
            who = np.searchsorted(ends, found + before, side="right")
            offset = found + before - (ends - width)[who] - q.size[who]
            for i, j in _groups(who):
                yield int(who[i]), c, offset[i:j]
            one = last


def _groups(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of equal keys."""
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)
    return list(zip(first.tolist(), np.append(first[1:], len(sorted_keys)).tolist(), strict=True)) if len(first) else []


def best_offset(recording: np.ndarray, query: np.ndarray, tried: np.ndarray) -> tuple[float, int] | None:
    """(bit error, offset) of the best of the offsets that align."""
    found = []
    for off in tried.tolist():
        a, b = max(0, off), max(0, -off)
        k = min(len(recording) - a, len(query) - b)
        if k >= OVERLAP:
            error = float(np.bitwise_count(recording[a : a + k] ^ query[b : b + k]).sum()) / (32 * k)
            if error <= ERROR:
                found.append((error, off))
    return min(found, default=None)


def alignments(queries: DataFrame, prints: DataFrame) -> DataFrame:
    """(q, c, offset, bit_error) of every pair of a query (c, codes) and a recording (c, codes) that align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index = None, None
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                *asked, cs, sizes, codes = (x[r].as_py() for x in b.columns)
                if asked != block:  # a task goes through its recordings with one block after the other
                    block, index = asked, Index(Prints(*asked))
                others = Prints(cs, sizes, codes)
                for q, c, tried in index.votes(others):
                    best = best_offset(others.codes[c], index.queries.codes[q], tried)
                    if best:
                        rows.append((int(index.queries.c[q]), int(others.c[c]), best[1], best[0]))
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(),) * 3 + (pa.float64(),), strict=True)], ["q", "c", "offset", "bit_error"])

    # Not broadcast, so that nothing of the queries' size goes through the driver.
    with settings(queries.sparkSession, SMALL_BATCHES | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        blocks = stored(packed(queries.repartition(max(1, -(-queries.count() // QUERIES))), QUERIES), "chroma-queries")
        pairs = blocks.toDF("qs", "qsizes", "qcodes").crossJoin(packed(prints, OTHERS))
        return stored(pairs.mapInArrow(run, "q long, c long, offset long, bit_error double"), "chroma-aligned")


@tidied
def aligned_recordings(media: DataFrame, id_col: str, audio_col: str, every: int = 100) -> DataFrame:
    """Per recording: id, codes, class_id, and its best alignment with a query (ids divisible by ``every``)."""
    with settings(media.sparkSession, SMALL_BATCHES):
        prints = stored(fingerprints(media, id_col, audio_col), "chroma-prints")
    named = prints.withColumn("name", F.sha2(F.to_json("codes"), 256))
    asked = F.when(F.col("id") % every == 0, F.col("id"))
    classes = named.filter("size(codes) > 0").groupBy("name").agg(
        F.min("id").alias("class_id"), F.first("codes").alias("codes"), F.min(asked).alias("q1"), F.count_distinct(asked).alias("asks")
    )
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "chroma-classes")
    second = named.filter(asked.isNotNull()).join(classes.filter("asks > 1").select("name", "q1"), "name").filter("id <> q1").groupBy("name").agg(F.min("id").alias("q2"))
    found = alignments(classes.filter("asks > 0"), classes)
    asks = classes.filter("asks > 0").select(F.col("c").alias("q"), "q1", "asks")
    others = found.filter("q <> c").join(asks, "q").groupBy("c").agg(
        F.min(F.struct("bit_error", F.col("q1").alias("match_id"), "offset")).alias("other"), F.sum("asks").alias("links")
    )
    own = found.filter("q = c").select("c", F.col("bit_error").alias("own_error"), F.col("offset").alias("own_offset"))
    told = classes.select("name", "c", "class_id", "q1", "asks").join(second, "name", "left").join(others, "c", "left").join(own, "c", "left")
    rows = named.join(stored(told.drop("c"), "chroma-told"), "name", "left")
    # A row's own class holds queries too, but for itself.
    mate = F.when(F.col("id").isNull() | (F.col("id") != F.col("q1")), F.col("q1")).otherwise(F.col("q2"))
    same = F.when(F.col("own_error").isNotNull() & mate.isNotNull(), F.struct(F.col("own_error").alias("bit_error"), mate.alias("match_id"), F.col("own_offset").alias("offset")))
    mates = F.when(F.col("own_error").isNotNull(), F.col("asks") - asked.isNotNull().cast("int"))
    rows = rows.withColumn("best", F.least("other", same)).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.coalesce(mates, F.lit(0)))
    return rows.select(
        F.col("id").alias(id_col), F.size("codes").cast("long").alias("n_codes"), "codes", F.coalesce("class_id", "id").alias("class_id"),
        "best.match_id", "best.offset", "best.bit_error", F.col("n_links").cast("long").alias("n_links"),
    )


RATE, NOTE = 4000, 512


def melody(vector) -> np.ndarray:
    """A vector as samples: a note for each number, higher for larger ones, five semitones a standard deviation."""
    x = np.asarray(vector if vector is not None else [], float)
    x = np.where(np.isfinite(x), x, 0.0)
    z = x * np.sqrt(len(x)) / max(float(np.sqrt((x**2).sum())), 1e-9) if len(x) else x
    pitch = 440.0 * 2 ** (np.clip(np.round(5 * z), -12, 12) / 12)
    t = np.arange(NOTE) / RATE
    return (0.5 * np.sin(2 * np.pi * pitch[:, None] * t) * np.hanning(NOTE) ** 0.25).ravel()


def media_of_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, audio): the tables hold no recordings, so each vector is played as one.

    So that recordings share material, ids that end in 7 begin with the second half of the melody of their hundred's
    first id, at half the volume.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, RENDERED):
                part = b.slice(lo, RENDERED)
                audio = []
                for v, before in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    own, lead = melody(v), melody(before)
                    audio.append(encode(np.concatenate([0.5 * lead[len(lead) // 2 :], own]), RATE))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(audio, pa.binary())], [id_col, "audio"])

    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{vector_col}`"].alias("vector"))
    first = rows.filter("id % 100 = 0").select(F.col("id").alias("first"), F.col("vector").alias("lead"))
    rows = rows.join(first, (F.col("id") % 10 == 7) & (F.col("id") - F.col("id") % 100 == F.col("first")), "left")
    return rows.select("id", "vector", "lead").mapInArrow(run, f"`{id_col}` {kind}, audio binary")


def op6_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_recordings(media_of_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding"), "vec_id", "audio")
