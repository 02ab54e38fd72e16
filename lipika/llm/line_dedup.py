"""Removes lines that are nearly an earlier line, by an exact set-similarity join over all lines.

A line is its set of words (A-Z lower-cased). It goes if an earlier line of the input, in the order of (id, line
number), has Jaccard >= 3/4 with it. What is earlier is judged on the input, not on what is left.

1. Words are counted over all rows, in CELLS cells. A line's words are ordered by rarity (the count's class, then the
   hash), and the first n - ceil(3n/4) + 1 of them, its prefix, are its index entries: two lines that are similar share
   a word there. Entries go out packed by bucket of the word. Of lines with equal sets, named by 128 bits, only the
   earliest goes on, first within a run and then under their common words, so a hot line costs an entry per run.
2. Under a word, entries are sorted by size. The length filter leaves a range of partners; the positional filter bounds
   the overlap by what follows the shared word; counts of each line's words in 32 cells bound it once more. Pairs that
   remain are verified on the full sets of 64-bit word hashes, which are read again from the texts.
3. A word whose pairs outnumber its entries is dense. There each line is first compared with the earliest lines of its
   own and the neighbouring size bands only, which settles groups of near copies at the cost of their size. Lines that
   are still there come back with their full sets: (word, band) is cut into blocks of lines to settle and blocks of
   earlier lines, each a task of bounded size, and every pair that the filters leave is verified until one fits.

Defined results. Null text stays null and has no lines; empty lines and lines without words stay. Rows with a null id
are left as they are. Ids are integers of any size. Rows that repeat an id share positions: lines at equal positions do
not remove each other, and a position that goes, goes in each of them. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import bucket_count, in_blocks, is_empty, stored, table, tidied
from lipika.llm.counting import cell_counts
from lipika.llm.shingles import mix, word_hashes
from lipika.llm.textbytes import slices, whole

#: Jaccard at least 3/4: 7 * intersection >= 3 * (n + m).
NUM, DEN = 3, 4
CELLS = 1 << 20
BLOCK = 2 << 20
RUN = 400_000
#: Under a word: pairs per entry, and pairs of fitting sizes, up to which all are looked at in one task.
DENSE, MOST = 8, 20_000_000
#: Of each size band of a dense word, the earliest lines that all are compared with.
FIRST = 2
#: Lines to settle and earlier lines that one task of a dense word compares.
LATER, EARLIER = 2048, 16384
#: Pairs that are looked at together.
PAIRS = 1_000_000
#: A one in each byte.
EACH = np.uint64(0x0101010101010101)
#: ``a`` and ``b`` name the line's set, ``i`` is the word's place in it, ``cells`` holds 32 counts of four bits, 15 for
#: that many or more.
ENTRY = np.dtype([("word", "<u8"), ("id", "<i8"), ("a", "<u8"), ("b", "<u8"), ("line", "<i4"), ("n", "<i4"), ("i", "<u2"), ("cells", "u1", 16)])
LINE = np.dtype([("id", "<i8"), ("a", "<u8"), ("b", "<u8"), ("line", "<i4")])
PLACE = np.dtype([("id", "<i8"), ("line", "<i4")])
FOUND_DDL = "id long, line int, eid long, eline int, word long, band int, record binary"


def _size_bands() -> np.ndarray:
    """First sizes of the bands: sizes that can be similar are in the same or in neighbouring bands."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(DEN * out[-1] // NUM + 1)
    return np.array(out, np.int64)


BANDS = _size_bands()


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, n, side="right") - 1


def classes(counts: np.ndarray) -> np.ndarray:
    """Rarity class of a cell: 32 steps for each doubling of its count, rarest 0; ten bits."""
    return np.minimum(32 * np.log2(1 + counts), 1023).astype(np.uint16)


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines, row, number of the line in its row)"""
    split = pc.split_pattern(texts, "\n")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return split.flatten(), row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def line_sets(lines: pa.Array, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, sizes): every line's distinct words, rarest first, one line after the other."""
    words, sizes = [], []
    for lo in range(0, len(lines), 1 << 14):
        part = lines[lo : lo + (1 << 14)]
        h, owner = word_hashes(part)
        # 14 bits of line, 10 of rarity and the upper 40 of the hash settle the order, but for a tie of different words.
        key = owner.astype(np.uint64) << np.uint64(50) | rarity[(h & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)
        order = np.argsort(key)
        key, h, owner = key[order], h[order], owner[order]
        same = key[1:] == key[:-1]
        if (same & (h[1:] != h[:-1])).any():
            order = np.lexsort((h, key))
            key, h, owner = key[order], h[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = ~(same & (h[1:] == h[:-1]))
        words.append(h[fresh])
        sizes.append(np.bincount(owner[fresh], minlength=len(part)))
    return (np.concatenate(words), np.concatenate(sizes)) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def prefix(n: np.ndarray) -> np.ndarray:
    return n - -(-NUM * n // DEN) + 1


def overlap(n, m):
    """The least intersection of similar sets of sizes n and m."""
    return -(-NUM * (n + m) // (NUM + DEN))


def entries_of(lines: pa.Array, ids: np.ndarray, number: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, lines): the prefix of each line, and a record for each line with words."""
    words, n = line_sets(lines, rarity)
    start = np.cumsum(n) - n
    filled = n > 0
    every = np.zeros(int(filled.sum()), LINE)
    every["id"], every["line"] = ids[filled], number[filled]
    if not len(words):
        return np.zeros(0, ENTRY), every
    for name, salt in (("a", 0), ("b", 0x9E3779B97F4A7C15)):
        total = np.add.reduceat(mix(words ^ np.uint64(salt)), start[filled])
        every[name] = mix(total + n[filled].astype(np.uint64))
    line = np.repeat(np.arange(len(n)), n)
    cells = np.minimum(np.bincount(line * 32 + (words >> np.uint64(59)).astype(np.int64), minlength=len(n) * 32), 15).astype(np.uint8).reshape(-1, 32)
    cells = cells[:, :16] | cells[:, 16:] << 4
    place = np.arange(len(words)) - start[line]
    take = np.flatnonzero(place < prefix(n)[line])
    owner = line[take]
    record = (np.cumsum(filled) - 1)[owner]
    out = np.zeros(len(take), ENTRY)
    out["word"], out["i"] = words[take], np.minimum(place[take], 65535)
    for name in ("id", "line", "a", "b"):
        out[name] = every[name][record]
    out["n"], out["cells"] = n[owner], cells[owner]
    return out, every


def of_equal(e: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest row of each run of equal keys, in the rows' order, and the rows that stand at later places)"""
    one = keys[0]
    for k in keys[1:]:
        one = mix(one) ^ k
    # Most rows differ from all others in a single number made of their keys; only the rest is sorted in full.
    order = np.argsort(one)
    same = one[order][1:] == one[order][:-1]
    order = order[_either(same)]
    part = e[order]
    within = np.lexsort((part["line"], part["id"], *(k[order] for k in keys)))
    order, part = order[within], part[within]
    head = np.ones(len(order), bool)
    head[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
    later = (part["id"] != part["id"][first]) | (part["line"] != part["line"][first])
    stays = np.ones(len(e), bool)
    stays[order[~head]] = False
    return np.flatnonzero(stays), order[later]


def _either(same: np.ndarray) -> np.ndarray:
    """Which rows equal the one before or after, of whether each row but the first equals the one before."""
    return np.append(same, False) | np.append(False, same) if len(same) else np.zeros(0, bool)


def packed_entries(rarity, buckets: int):
    """(bucket, payload): packed entries; places that an equal earlier line of the same run already removes in buckets below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            e, line = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            later = of_equal(line, [line["b"], line["a"]])[1]
            gone = np.zeros(len(later), PLACE)
            gone["id"], gone["line"] = line["id"][later], line["line"][later]
            gone = np.unique(gone)
            place = np.zeros(len(e), PLACE)
            place["id"], place["line"] = e["id"], e["line"]
            bucket = (mix(e["word"]) % np.uint64(buckets)).astype(np.int32)
            order = np.flatnonzero(~among(place, gone))
            order = order[np.argsort(bucket[order], kind="stable")]
            e, bucket = e.take(order), bucket[order]
            used, first = np.unique(bucket, return_index=True)
            payload = [e[i:j].tobytes() for i, j in zip(first, np.append(first[1:], len(e)), strict=True)]
            if len(gone):
                spread = mix(np.array([gone["id"][0]]).view(np.uint64) ^ np.uint64(len(gone)))[0]
                used, payload = np.append(used, np.int32(-1 - int(spread % np.uint64(buckets)))), [*payload, gone.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "payload"])

        for b in batches:
            ids = b.column(0).to_numpy()
            for first, texts in slices(b.column(1), BLOCK):
                lines, row, number = lines_of(texts)
                held.append(entries_of(lines, ids[first + row], number, rarity.value))
                size += len(held[-1][0])
                if size >= RUN:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def among(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the places are among the sorted distinct ``wanted``."""
    if not len(wanted):
        return np.zeros(len(places), bool)
    ids, inside = np.unique(wanted["id"], return_inverse=True)
    at = np.minimum(np.searchsorted(ids, places["id"]), len(ids) - 1)
    key = np.where(ids[at] == places["id"], at << 32 | places["line"], -1)
    return np.isin(key, inside << 32 | wanted["line"])


def ranks(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct places in order, the place of each row as a number)"""
    ids, line = np.ascontiguousarray(e["id"]), np.ascontiguousarray(e["line"])
    low, high = (int(ids.min()), int(ids.max())) if len(e) else (0, 0)
    order = np.argsort((ids - low) << 32 | line) if high - low < 1 << 31 else np.lexsort((line, ids))
    ids, line = ids[order], line[order]
    head = np.ones(len(e), bool)
    head[1:] = (ids[1:] != ids[:-1]) | (line[1:] != line[:-1])
    at = np.empty(len(e), np.int64)
    at[order] = np.cumsum(head) - 1
    place = np.zeros(int(head.sum()), PLACE)
    place["id"], place["line"] = ids[head], line[head]
    return place, at


def columns(e: np.ndarray, order: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The rows' columns for the filters; ``at`` numbers the places."""
    out = {k: e[k][order].astype(np.int64) for k in ("n", "i")}
    return out | {"word": e["word"][order], "at": at[order], "cells": np.ascontiguousarray(e["cells"][order]), "row": order}


def fitting(e: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of entries the length, positional and cell filters leave."""
    n, m = e["n"][x], e["n"][y]
    need = overlap(n, m)
    keep = np.flatnonzero((e["at"][x] != e["at"][y]) & (np.minimum(n, m) >= need) & (1 + np.minimum(n - e["i"][x], m - e["i"][y]) - 1 >= need))
    cx, cy = e["cells"][x[keep]], e["cells"][y[keep]]
    both, full = np.zeros(len(keep), np.int64), np.zeros(len(keep), np.uint64)
    for counts in (np.minimum(cx & 15, cy & 15), np.minimum(cx >> 4, cy >> 4)):
        # Eight counts to a number: one product adds them up, one sum shows a count of 15.
        eight = counts.view("<u8")
        both += (eight[:, 0] * EACH >> np.uint64(56)).astype(np.int64) + (eight[:, 1] * EACH >> np.uint64(56)).astype(np.int64)
        full |= (eight[:, 0] + EACH * np.uint64(0x71) | eight[:, 1] + EACH * np.uint64(0x71)) & (EACH << np.uint64(7))
    out = np.zeros(len(x), bool)
    out[keep[(both >= need[keep]) | (full != 0)]] = True
    return out


def pairs_under_words(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, dense rows) of entries sorted by (word, n): pairs that the filters leave, and the rows of dense words, which have no pairs."""
    size = len(e["word"])
    if not size:
        return (np.zeros(0, np.int64),) * 3
    head = np.ones(size, bool)
    head[1:] = e["word"][1:] != e["word"][:-1]
    group = np.cumsum(head) - 1
    start = np.flatnonzero(head)
    entries = np.bincount(group)
    span = int(e["n"].max()) + 2
    low = np.maximum(np.searchsorted(group * span + e["n"], group * span + -(-NUM * e["n"] // DEN), side="left"), start[group])
    many = np.arange(size) - low
    dense = np.bincount(group, many) > MOST
    many[dense[group]] = 0
    ends, found, passed = np.cumsum(many), [], np.zeros(len(start), np.int64)
    lo = 0
    while lo < size:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        k = np.where(dense[group[lo:hi]], 0, many[lo:hi])
        x = np.repeat(np.arange(lo, hi), k)
        y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[lo:hi], k)
        lo = hi
        if len(x):
            keep = fitting(e, x, y)
            x, y = x[keep], y[keep]
            passed += np.bincount(group[x], minlength=len(start))
            dense |= passed > DENSE * entries
            keep = ~dense[group[x]]
            found.append((x[keep], y[keep]))
    x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    keep = ~dense[group[x]]  # a word may have become dense after its first pairs
    return x[keep], y[keep], np.flatnonzero(dense[group])


def with_earliest(e: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): each of the rows with the FIRST earliest rows of its word in its own and the neighbouring bands."""
    band, (_, word) = band_of(e["n"][rows]), np.unique(e["word"][rows], return_inverse=True)
    key = word * (len(BANDS) + 2) + band + 1
    order = np.lexsort((e["at"][rows], key))
    rows, key = rows[order], key[order]
    pairs = []
    for near in (-1, 0, 1):
        first = np.searchsorted(key, key + near, side="left")
        for f in range(FIRST):
            at = np.minimum(first + f, len(key) - 1)
            ok = (key[at] == key + near) & (e["at"][rows[at]] < e["at"][rows])
            pairs.append((rows[ok], rows[at[ok]]))
    x, y = (np.concatenate(p) for p in zip(*pairs, strict=True))
    keep = fitting(e, x, y)
    return x[keep], y[keep]


def candidates(part: pa.Table) -> pa.Table:
    """Of one bucket: places that go, pairs (later, earlier) to verify, and the entries of dense words."""
    raw = np.concatenate([whole(c)[0] for c in part["payload"].chunks])
    none = np.zeros(0, PLACE)
    if part["bucket"][0].as_py() < 0:
        return _found(raw.view(PLACE), none, none, np.zeros(0, ENTRY))
    rows = raw.view(ENTRY)
    word = np.ascontiguousarray(rows["word"])
    order = np.argsort(word)
    word = word[order]
    rows = rows.take(order[_either(word[1:] == word[:-1])])
    # Equal sets meet under every word of their prefix; the first word reports them, and the earliest goes on.
    first, later = of_equal(rows, [rows["b"], rows["a"], rows["word"]])
    later = later[rows["i"][later] == 0]
    gone = np.zeros(len(later), PLACE)
    gone["id"], gone["line"] = rows["id"][later], rows["line"][later]
    rows = rows.take(first)
    places, at = ranks(rows)
    order = np.lexsort((at, rows["n"], rows["word"]))
    e = columns(rows, order, at)
    x, y, dense = pairs_under_words(e)
    if len(dense):
        more = with_earliest(e, dense)
        x, y = np.concatenate([x, more[0]]), np.concatenate([y, more[1]])
    pairs = np.unique(np.maximum(e["at"][x], e["at"][y]) << 32 | np.minimum(e["at"][x], e["at"][y]))
    return _found(gone, places[pairs >> 32], places[pairs & 0xFFFFFFFF], rows[e["row"][dense]])


def _found(gone: np.ndarray, later: np.ndarray, earlier: np.ndarray, dense: np.ndarray) -> pa.Table:
    g, p, d = len(gone), len(later), len(dense)
    column = lambda kind, *parts: pa.concat_arrays([pa.nulls(x, kind) if isinstance(x, int) else pa.array(np.ascontiguousarray(x), kind) for x in parts])
    return pa.table(
        {
            "id": column(pa.int64(), gone["id"], later["id"], dense["id"]),
            "line": column(pa.int32(), gone["line"], later["line"], dense["line"]),
            "eid": column(pa.int64(), g, earlier["id"], d),
            "eline": column(pa.int32(), g, earlier["line"], d),
            "word": column(pa.int64(), g, p, dense["word"].astype(np.uint64).view(np.int64)),
            "band": column(pa.int32(), g, p, band_of(dense["n"]).astype(np.int32)),
            "record": pa.concat_arrays([pa.nulls(g + p, pa.binary()), pa.array([r.tobytes() for r in dense], pa.binary())]),
        }
    )


class Sets:
    """Sets of words, coded by their places among all words here."""

    def __init__(self, column: pa.Array):
        data, ends = whole(column)
        words, codes = np.unique(np.frombuffer(np.ascontiguousarray(data), "<u8"), return_inverse=True)
        self.codes, self.start, self.n = codes.astype(np.uint64), ends[:-1] // 8, np.diff(ends) // 8

    def _of(self, x: np.ndarray) -> np.ndarray:
        """(pair, word) as one number."""
        n = self.n[x]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[x], n)
        return np.repeat(np.arange(len(x), dtype=np.uint64), n) << np.uint64(32) | self.codes[at]

    def similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the sets of each pair have Jaccard 3/4."""
        every = np.sort(np.concatenate([self._of(x), self._of(y)]))
        both = np.bincount((every[1:][every[1:] == every[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(x))
        return DEN * both >= NUM * (self.n[x] + self.n[y] - both)


def settle(part: pa.Table) -> pa.Table:
    """Of a block of a dense word (id, line, mine, record, words): the lines to settle that an earlier line of the block is similar to."""
    rows = np.frombuffer(b"".join(x.as_py() for x in part["record"]), ENTRY)
    places, at = ranks(rows)
    e, sets = columns(rows, np.arange(len(rows)), at), Sets(part["words"].combine_chunks())
    own = part["mine"].to_numpy(zero_copy_only=False)
    mine, theirs = np.flatnonzero(own), np.flatnonzero(~own)
    theirs = theirs[np.argsort(at[theirs], kind="stable")]
    gone = []
    for x in mine:
        before = theirs[: np.searchsorted(at[theirs], at[x])]
        lo, step = 0, 64
        while lo < len(before):
            y = before[lo : lo + step]
            y = y[fitting(e, np.full(len(y), x), y)]
            if len(y) and sets.similar(np.full(len(y), x), y).any():
                gone.append(at[x])
                break
            lo, step = lo + step, 2 * step
    gone = places[np.array(gone, np.int64)]
    return pa.table({"id": pa.array(np.ascontiguousarray(gone["id"]), pa.int64()), "line": pa.array(np.ascontiguousarray(gone["line"]), pa.int32())})


def read_sets(places: DataFrame, docs: DataFrame, rarity) -> DataFrame:
    """(id, line, words) of distinct places: the line's full set as bytes of 64-bit hashes."""
    need = places.groupBy(F.col("id").alias("nid")).agg(F.collect_list("line").alias("numbers"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, numbers = b.column(0).to_numpy(), b.column(2)
            for first, texts in slices(b.column(1), BLOCK):
                lines, row, number = lines_of(texts)
                part = numbers[first : first + len(texts)]
                count = pc.list_value_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
                want = np.repeat(np.arange(len(texts)), count) << 32 | part.flatten().to_numpy()
                hit = np.flatnonzero(np.isin(row << 32 | number, want))
                words, n = line_sets(lines.take(pa.array(hit)), rarity.value)
                ends = np.concatenate([[0], np.cumsum(n)])
                data = words.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[first + row[hit]], pa.int64()), pa.array(number[hit].astype(np.int32)),
                        pa.array([data[8 * i : 8 * j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    ],
                    ["id", "line", "words"],
                )

    # The same plan at any size: texts are shuffled by id, and the few rows wanted are the hashed side.
    rows = docs.join(need.hint("shuffle_hash"), F.col("id") == F.col("nid")).select("id", "text", "numbers")
    return rows.mapInArrow(read, "id long, line int, words binary")


@tidied
def similar(pairs: DataFrame, docs: DataFrame, rarity) -> DataFrame:
    """(id, line) of the later places of the pairs whose full sets are similar."""
    places = pairs.select("id", "line").union(pairs.select("eid", "eline")).distinct()
    sets = stored(read_sets(places, docs, rarity), "lines-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(lo, 512) for batch in batches for lo in range(0, batch.num_rows, 512)):
            both = Sets(pa.concat_arrays([b.column(2), b.column(3)]))
            x = np.arange(b.num_rows)
            yield b.select(["id", "line"]).filter(pa.array(both.similar(x, x + b.num_rows), pa.bool_()))

    later = sets.withColumnRenamed("words", "x")
    earlier = sets.select(F.col("id").alias("eid"), F.col("line").alias("eline"), F.col("words").alias("y"))
    both = pairs.join(earlier, ["eid", "eline"]).join(later, ["id", "line"]).select("id", "line", "x", "y")
    return stored(both.mapInArrow(verify, "id long, line int").distinct(), "lines-gone")


@tidied
def settled_lines(dense: DataFrame, gone: DataFrame, docs: DataFrame, rarity) -> DataFrame:
    """(id, line) of the lines under dense words that are still there and have a similar earlier line under the word."""
    live = dense.join(gone, ["id", "line"], "left_anti")
    last = live.groupBy("word", "band").agg(F.max(F.struct("id", "line")).alias("last"))
    near = dense.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    near = stored(near.join(last, ["word", "band"]).filter(F.struct("id", "line") < F.col("last")).drop("last"), "lines-near")
    rows = stored(in_blocks(live, near, ["word", "band"], ["id", "line"], LATER, EARLIER), "lines-blocks")
    sets = stored(read_sets(rows.select("id", "line").distinct(), docs, rarity), "lines-sets")
    return stored(rows.join(sets, ["id", "line"]).groupBy("word", "band", "part", "block").applyInArrow(settle, "id long, line int").distinct(), "lines-gone")


@tidied
def removed_lines(docs: DataFrame) -> DataFrame:
    """(id, line), distinct, of all lines that go; ``docs`` has id and text."""
    spark = docs.sparkSession
    docs = docs.filter("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long"), "text")
    counts = cell_counts(docs.select("text"), lambda column: (word_hashes(t)[0] for _, t in slices(column, BLOCK)), CELLS)
    rarity = spark.sparkContext.broadcast(classes(counts))
    packed = docs.mapInArrow(packed_entries(rarity, bucket_count(docs)), "bucket int, payload binary")
    found = stored(packed.groupBy("bucket").applyInArrow(candidates, FOUND_DDL), "lines-found")
    gone = stored(found.filter("eid IS NULL AND word IS NULL").select("id", "line").distinct(), "lines-gone")
    pairs = stored(found.filter("eid IS NOT NULL").select("id", "line", "eid", "eline").distinct().join(gone, ["id", "line"], "left_anti"), "lines-pairs")
    gone = gone.union(similar(pairs, docs, rarity))
    dense = found.filter("word IS NOT NULL").select("word", "band", "id", "line", "record")
    if not is_empty(dense):
        gone = gone.union(settled_lines(dense, gone, docs, rarity))
    return gone.distinct()


@tidied
def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with the lines gone; with ``digest`` instead id, n_lines, n_removed and the SHA-256 of the text left."""
    gone = removed_lines(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")))
    gone = stored(gone.groupBy(F.col("id").alias("_rid")).agg(F.collect_list("line").alias("_lines")), "lines-by-id")
    joined = docs.join(gone, docs[f"`{id_col}`"].cast("long") == F.col("_rid"), "left")
    own = docs[f"`{text_col}`"]
    # Places that stay, by a set difference, so that a text costs its lines and not lines times removed lines. Lines are
    # bound by a lambda: what is named inside one is made again for each element.
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("_lines", F.array().cast("array<int>")))
    if digest:
        kept = lambda lines, left: F.struct(F.size(lines).alias("n"), F.size(left).alias("left"), F.array_join(F.transform(left, lambda i: lines[i]), "\n").alias("text"))
        split = F.when(own.isNotNull(), F.split(own, "\n", -1))
        both = F.transform(F.array(split), lambda lines: F.transform(F.array(stay(lines)), lambda left: kept(lines, left))[0])[0]
        out = joined.select(docs[f"`{id_col}`"], both.alias("_kept"))
        n, left = (F.coalesce(F.col(f"_kept.{c}"), F.lit(0)).cast("long") for c in ("n", "left"))
        return out.select(out[f"`{id_col}`"], n.alias("n_lines"), (n - left).alias("n_removed"), F.sha2(F.coalesce("_kept.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    text = F.transform(F.array(F.split(own, "\n", -1)), lambda lines: F.array_join(F.transform(stay(lines), lambda i: lines[i]), "\n"))[0]
    text = F.when(F.col("_lines").isNull() | own.isNull(), own).otherwise(text)
    return joined.select(*(text.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)


SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
w AS (SELECT DISTINCT doc_id, i, unnest(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word FROM l),
k AS (SELECT doc_id, i, list_sort(list(word)) AS ws, count(*) AS n FROM w GROUP BY 1, 2),
c AS (SELECT ws, n, min((doc_id, i)) AS first, row_number() OVER (ORDER BY min((doc_id, i))) AS c FROM k GROUP BY 1, 2),
v AS (SELECT c, n, unnest(ws) AS word FROM c),
f AS (SELECT word, count(*) AS f FROM v GROUP BY 1),
o AS (SELECT c, n, v.word, row_number() OVER (PARTITION BY c ORDER BY f, v.word) AS r FROM v JOIN f ON f.word = v.word),
p AS (SELECT DISTINCT a.c AS a, b.c AS b FROM o a JOIN o b ON a.word = b.word AND a.c > b.c AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
      AND a.r <= a.n - ceil(0.75 * a.n) + 1 AND b.r <= b.n - ceil(0.75 * b.n) + 1),
s AS (SELECT DISTINCT p.a FROM p JOIN c x ON x.c = p.a JOIN c y ON y.c = p.b
      WHERE 7 * len(list_intersect(x.ws, y.ws)) >= 3 * (x.n + y.n)),
g AS (SELECT doc_id, i FROM k JOIN c ON c.ws = k.ws WHERE (doc_id, i) > c.first OR c.c IN (SELECT a FROM s)),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS kept
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""
