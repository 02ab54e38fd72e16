"""Best-fit packing of token pieces into sequences through a configuration linear program.

1. Executors tokenise whole texts and cut only what is longer than a sequence; every piece becomes one row.
2. The histogram of piece lengths (at most ``size`` rows) is all that the driver gets. A configuration is a multiset of
   lengths that fits a sequence. Multiplicative weights approximate the configuration program: each length has a dual
   price that falls with its coverage, and a knapsack dynamic program prices out, for every length that is behind, the
   best configuration with it. Rounding takes the whole multiples of the solution and one more by the fraction's
   chance, as far as pieces are left; the program of what is left is solved and rounded again, PASSES times. The few
   pieces that then remain are taken by the same knapsack at the last prices.
3. Pieces are numbered within their length by counts per (length, bucket), never by a window over a length, and the
   plan, whose size depends on ``size`` and not on the documents, turns (length, number) into (sequence, offset).

Defined results. Null text is empty and gives one piece with just the end id. Rows that repeat an id are packed each.
Null ids are allowed. An empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lipika.llm.common import stored, table, tidied

SIZE = 1024
END_ID = 2
PASSES, ROUNDS = 10, 24
#: Prices fall by exp(-ETA) for a coverage of one; PART of a length's count is covered at a time, and a length LEAD ahead waits.
ETA, PART, LEAD = 0.5, 0.34, 3.0
#: Configurations priced this close to the best one count as best.
NEAR = 0.02
SEED = 1
BUCKET = 50_000
TOKENIZER = "byte_bpe_50k.json"


class Encoder:
    """Text to the little-endian uint32 bytes of its ids.

    The ids are those of the byte-level BPE file at ``path``. Where its merges stand in the order of the ids they make,
    they are ranks, which a faster library applies to the file's own vocabulary with the same ids; any other file, a
    text which that library cannot split, and a text that spells one of the file's added tokens go through the file's
    own library.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.end = np.array([end_id], "<u4").tobytes()
        self.plain = Tokenizer.from_file(path)
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.quick = None
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        if all(c in vocabulary for c in letters) and all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            # The byte of each letter: printable bytes stand for themselves, the others follow from 256 on in order.
            own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
            ranks = {bytes(byte[c] for c in w): i for w, i in vocabulary.items() if i < 256 + len(merges)}
            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        ids = None
        if self.quick and not any(t in text for t in self.added):
            with contextlib.suppress(Exception):  # a run of white space too long for its pattern library
                ids = self.quick(text)
        if ids is None:
            ids = self.plain.encode(text, add_special_tokens=False).ids
        data = array("I", ids)
        if sys.byteorder == "big":
            data.byteswap()
        return data.tobytes() + self.end


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian uint32."""
    name = tokenizer  # a path; by default each executor's own copy of the public file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = None
        for batch in batches:
            encode = encode or Encoder(name or tokenizer_path())
            ids, at, start, length, crc, raw = [], [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py() or "")
                n = len(data) // 4
                k = o = 0
                while o < n:
                    step = (n % size or size) if o == 0 else size
                    part = data[4 * o : 4 * (o + step)]
                    ids.append(i), at.append(k), start.append(o), length.append(step), crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
                    k, o = k + 1, o + step
            columns = [pa.array(ids, batch.schema.field(0).type), pa.array(at, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"]).mapInArrow(run, schema)


class Knapsack:
    """The highest price of any capacity, with at most ``count[l]`` of length l: a 0/1 dynamic program over powers of two."""

    def __init__(self, price: np.ndarray, count: np.ndarray, size: int):
        self.items: list[tuple[int, int]] = []
        for l in np.flatnonzero((price > 0) & (count > 0)).tolist():
            left, m = min(int(count[l]), size // l), 1
            while left:
                m = min(m, left)
                self.items.append((l, m))
                left, m = left - m, 2 * m
        self.best = np.zeros(size + 1)
        self.took = np.zeros((len(self.items), size + 1), bool)
        for i, (l, m) in enumerate(self.items):
            w = l * m
            more = self.best[: size + 1 - w] + price[l] * m
            hit = more > self.best[w:]
            self.took[i, w:] = hit
            self.best[w:] = np.where(hit, more, self.best[w:])

    def configurations(self, capacity: np.ndarray) -> list[dict[int, int]]:
        """The best one of each capacity."""
        room, found = capacity.copy(), [{} for _ in capacity]
        for i in range(len(self.items) - 1, -1, -1):
            hit = np.flatnonzero(self.took[i, room])
            if len(hit):
                l, m = self.items[i]
                room[hit] -= l * m
                for j in hit.tolist():
                    found[j][l] = found[j].get(l, 0) + m
        return found


def program(count: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[dict[tuple, float], np.ndarray]:
    """(configuration -> sequences, prices) that cover ``count`` pieces of each length, by multiplicative weights."""
    lengths, length = np.flatnonzero(count), np.arange(size + 1, dtype=float)
    per, cover, x, price = np.maximum(count, 1), np.zeros(size + 1), {}, length
    for _ in range(rounds):
        share = cover / per
        ahead = share - share[lengths].min()
        price = length * np.where((count > 0) & (ahead <= LEAD), np.exp(-ETA * ahead), 0.0)
        best = Knapsack(price, count, size)
        first = lengths[np.argsort(share[lengths], kind="stable")]
        first = first[price[first] + best.best[size - first] >= (1 - NEAR) * best.best[size]]
        # Prices hold for a round, in which no length may be covered by more than twice PART.
        room = cover + 2 * PART * count
        for l, c in zip(first.tolist(), best.configurations(size - first), strict=True):
            c[l] = c.get(l, 0) + 1
            step = PART * min(count[k] / a for k, a in c.items())
            if c[l] > count[l] or cover[l] > room[l] - PART * count[l] or any(cover[k] + a * step > room[k] for k, a in c.items()):
                continue
            key = tuple(sorted(c.items()))
            x[key] = x.get(key, 0.0) + step
            for k, a in c.items():
                cover[k] += a * step
    scale = (length * count).sum() / max((length * cover).sum(), 1e-9)
    return {c: v * scale for c, v in x.items()}, price


def plan(histogram: dict[int, int], size: int = SIZE, rounds: int = ROUNDS, passes: int = PASSES) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(configuration, sequences) that hold every piece of the histogram exactly once, and how many pieces the rounded program left over."""
    left = np.zeros(size + 1, np.int64)
    for l, n in histogram.items():
        left[l] = n
    out: list[tuple[dict[int, int], int]] = []

    def take(c: dict[int, int], k: int) -> None:
        out.append((c, k))
        for l, a in c.items():
            left[l] -= a * k

    if left[size]:
        take({size: 1}, int(left[size]))
    length, rng = np.arange(size + 1, dtype=float), np.random.default_rng(SEED)
    # Of configurations equally full, the one with long pieces comes first: short ones fit anywhere later.
    price = length * (1 + 0.05 * length / size)
    for turn in range(passes if rounds else 0):
        if not left.any():
            break
        x, price = program(left, size, rounds)
        fill = {c: sum(l * a for l, a in c) for c in x}
        least = sum(fill[c] * v for c, v in x.items()) / max(sum(x.values()), 1e-9) - 1 - turn * turn
        for c, v in sorted(x.items(), key=lambda cv: (-cv[1], cv[0])):
            if fill[c] >= least:  # emptier ones wait for a later pass
                k = min(int(v) + int(rng.random() < v - int(v)), *(int(left[l]) // a for l, a in c))
                if k:
                    take(dict(c), k)
    over = int(left.sum())
    while left.any():
        c = Knapsack(np.maximum(price, 1e-6 * length), left, size).configurations(np.array([size]))[0]
        take(c, max(1, min(int(left[l]) // a for l, a in c.items())))
    return out, over


def _places(made: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Sorted by (length, first number): which numbers of a length a configuration takes, and where they go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for c, k in made:
        offset = 0
        for l, a in sorted(c.items(), reverse=True):
            rows.append((l, used.get(l, 0), a, sequence, offset))
            used[l] = used.get(l, 0) + a * k
            offset += l * a
        sequence += k
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), a.T, strict=True))


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to pieces (id, piece, start, length, ...)."""
    cut = stored(cut, "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    buckets = max(1, -(-sum(histogram.values()) // BUCKET))
    places = _places(plan(histogram, size)[0])
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "start"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")) - 1
    numbered = cut.withColumn("number", number).join(counts, ["length", "bucket"]).withColumn("number", F.col("number") + F.col("before"))
    numbered = numbered.drop("bucket", "before")
    n_name, l_name = numbered.columns.index("number"), numbered.columns.index("length")
    rest = [c for c in numbered.columns if c != "number"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = places["length"] << 44 | places["first"]
        for b in batches:
            number, length = b.column(n_name).to_numpy(), b.column(l_name).to_numpy()
            i = np.searchsorted(key, length << 44 | number, side="right") - 1
            nth = number - places["first"][i]
            sequence = places["sequence"][i] + nth // places["each"][i]
            offset = places["offset"][i] + nth % places["each"][i] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(sequence), pa.array(offset)], [*rest, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number") + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


@tidied
def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    columns = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return pack(pieces(docs, id_col, text_col, size, tokenizer, with_ids), size).withColumnRenamed("id", id_col).select(columns)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
