"""Removes every byte covered by a string of WIDTH bytes that also starts earlier, by a sparse suffix array.

Texts are UTF-8 bytes; matches never cross documents; earlier is by (id, start) on the input.

1. Of the GRAM-byte grams of each window of WIDTH bytes the one of least hash is its anchor, the leftmost of equals.
   Equal windows have equal anchors, and windows that start next to each other mostly share theirs, so about one
   position in 35 is an anchor. An anchor's span is all its windows. Where a gram repeats within a run of texts, the
   spans are sorted by deep-shallow sorting; of equal ones only the earliest goes on and the others are covered in whole,
   so a hot passage costs a row per run.
2. Anchors go out packed by bucket of their gram, which says which grams occur again, and how often.
3. The bytes of those anchors' spans are read again from the texts and dealt by gram. Gram by gram, the bytes after and
   the bytes before the anchors are sorted by deep-shallow sorting (multikey quicksort, then blind tries where prefixes
   are long). Neighbours' common prefixes say which anchors agree, and how far: equal spans are covered but for the
   earliest, and two windows of different spans are equal exactly if they agree as far to the left and to the right as
   they reach. Hashes only say where rows go; what is equal, the common prefixes say.
4. A frequent gram's spans are cut into ranges of windows, each dealt by the bytes that all its windows share, so that a
   short phrase before varied text does not meet in one place: STEPS windows to a range by how often the gram occurs.
5. Covered ranges are united per document and cut from its bytes.

Defined results. Null text is empty. Rows with a null id are left whole and cover nothing. Ids are integers of any size;
a long text is looked at in pieces of PIECE windows. Rows that repeat an id are one place: equal starts do not cover each
other, and what is covered in one of them is covered in each, as far as it reaches. Texts shorter than WIDTH lose
nothing. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import bucket_count, discard, stored, table, tidied
from lipika.llm.shingles import mix
from lipika.llm.suffix_sort import deep_shallow
from lipika.llm.textbytes import blocks

WIDTH = 100
GRAM = 32
GRAMS = WIDTH - GRAM + 1
#: Bits for a place within a block.
PLACE_BITS = 26
BLOCK = 1 << 19
PIECE = 1 << 22
RUN = 200_000
#: Spans whose bytes are taken together.
STRIP = 8192
SPAN = WIDTH + GRAMS - 1
#: (occurrences of a gram up to which, windows to a range); a gram in no more than the first is not cut.
STEPS = ((4096, GRAMS), (1 << 20, 8), (1 << 62, 1))
ANCHOR = np.dtype([("gram", "<u8"), ("id", "<i8"), ("start", "<i4"), ("off", "u1"), ("run", "u1")])
EDGE = np.dtype([("key", "<u8"), ("id", "<i8"), ("start", "<i4"), ("off", "u1"), ("run", "u1"), ("bytes", "u1", SPAN)])
RANGE = np.dtype([("id", "<i8"), ("start", "<i4"), ("length", "<i4")])
_RNG = np.random.default_rng(100)
_MIX = _RNG.integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)
_CORE = _RNG.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)


def anchors(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(the anchors of a block of texts, each with the start of its span and its own place in it; where the spans start in the block).

    ``base`` is added to starts: the place of the block in its text where the block is a piece of one.
    """
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, ANCHOR), np.zeros(0, np.int64)
    eight = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()
    grams = n - GRAM + 1
    h = eight[:grams] * _MIX[0]
    for j in range(1, GRAM // 8):
        h += (eight[8 * j : 8 * j + grams] ^ (eight[8 * j : 8 * j + grams] >> np.uint64(29))) * _MIX[j]
    h = mix(h)
    # Hash above, position below: the least is the least hash, leftmost of equals. 69 = 64 + 5.
    low = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(grams, dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: -(GRAMS - 64)], low[GRAMS - 64 :])
    at = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    length = np.diff(offsets)
    windows = np.maximum(length - WIDTH + 1, 0)
    doc = np.repeat(np.arange(len(length)), windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[doc]
    if not len(start):
        return np.zeros(0, ANCHOR), np.zeros(0, np.int64)
    at = at[start]
    head = np.ones(len(start), bool)
    head[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    lo, hi, anchor, doc = start[first], start[last], at[first], doc[first]
    out = np.zeros(len(first), ANCHOR)
    out["gram"], out["off"], out["run"] = h[anchor], anchor - lo, hi - lo
    out["id"], out["start"] = ids[doc], lo - offsets[doc] + base
    return out, lo


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, base): blocks of whole texts; a text of more than PIECE windows by pieces that share WIDTH - 1 bytes."""
    for first, data, offsets in blocks(column, BLOCK):
        if len(offsets) > 2 or len(data) < PIECE + WIDTH:
            yield first, data, offsets, 0
            continue
        for base in range(0, len(data) - WIDTH + 1, PIECE):
            part = data[base : base + PIECE + WIDTH - 1]
            yield first, part, np.array([0, len(part)]), base


def repeated(key: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def span_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes from each start on, padded with zeros."""
    out = np.zeros((len(start), SPAN), np.uint8)
    for lo in range(0, len(start), STRIP):
        s, n = start[lo : lo + STRIP, None], length[lo : lo + STRIP, None]
        place = np.arange(SPAN)
        out[lo : lo + STRIP] = np.where(place < n, data[np.minimum(s + place, len(data) - 1)], 0)
    return out


def of_equal(places: tuple[np.ndarray, np.ndarray], names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest (id, start) of each run of equal names, those at later places)"""
    ids, start = places
    order = np.lexsort((start, ids, *names))
    head = np.ones(len(order), bool)
    head[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in names])
    first = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else order
    later = (ids[order] != ids[first]) | (start[order] != start[first])
    return order[head], order[later]


def whole_ranges(e: np.ndarray) -> np.ndarray:
    """The bytes of spans."""
    out = np.zeros(len(e), RANGE)
    out["id"], out["start"], out["length"] = e["id"], e["start"], e["run"].astype(np.int32) + WIDTH
    return out


def distinct_spans(e: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest anchor of each set of equal spans, ranges of the others); ``rows`` are the spans' bytes."""
    shape = mix(e["gram"] ^ (e["off"].astype(np.uint64) << np.uint64(8) | e["run"])) if "gram" in e.dtype.names else e["key"]
    order, lcp = deep_shallow(rows, e["run"].astype(np.int64) + WIDTH, shape)
    same = np.zeros(len(e), np.int64)
    alike = lcp == e["run"][order].astype(np.int64) + WIDTH
    alike[1:] &= (e["off"][order][1:] == e["off"][order][:-1]) & (e["run"][order][1:] == e["run"][order][:-1])
    same[order] = np.cumsum(~alike)
    keep, later = of_equal((e["id"], e["start"]), [same])
    return e[keep], whole_ranges(e[later])


def by_bucket(e: np.ndarray, key: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    e, bucket = e[order], bucket[order]
    used, first = np.unique(bucket, return_index=True)
    return [(b, e[i:j].tobytes()) for b, i, j in zip(used.tolist(), first, np.append(first[1:], len(e)), strict=True)]


def packed_rows(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])


def packed_anchors(buckets: int):
    """(bucket, payload): anchors by bucket of their gram; ranges already covered without a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            e = np.concatenate([h[0] for h in held])
            again = repeated(e["gram"])
            spans, at = [np.zeros((0, SPAN), np.uint8)], 0
            for a, lo, data in held:
                mine = again[at : at + len(a)]
                at += len(a)
                spans.append(span_bytes(data, lo[mine], a["run"][mine].astype(np.int64) + WIDTH))
            kept, covered = distinct_spans(e[again], np.concatenate(spans))
            e = np.concatenate([e[~again], kept])
            rows = by_bucket(e, e["gram"], buckets)
            return packed_rows(rows + [(None, covered.tobytes())] * bool(len(covered)))

        for b in batches:
            ids = b.column(0).to_numpy()
            for first, data, offsets, base in pieces(b.column(1)):
                a, lo = anchors(data, offsets, ids[first : first + len(offsets) - 1], base)
                if len(a):
                    held.append((a, lo, data))
                    size += len(a)
                if size >= RUN:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


RANGES_DDL = "id long, start int, length int"


def ranges_table(r: np.ndarray) -> dict[str, pa.Array]:
    return {"id": pa.array(np.ascontiguousarray(r["id"]), pa.int64()), **{c: pa.array(np.ascontiguousarray(r[c]), pa.int32()) for c in ("start", "length")}}


def covered_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0):
            yield pa.RecordBatch.from_pydict(ranges_table(united(np.frombuffer(x.as_buffer(), RANGE))))


def repeated_grams(part: pa.Table) -> pa.Table:
    """Of one bucket: the anchors whose gram occurs again, with the windows to a range of theirs."""
    e = np.frombuffer(b"".join(x.as_py() for x in part["payload"]), ANCHOR)
    _, place, count = np.unique(e["gram"], return_inverse=True, return_counts=True)
    count = count[place]
    e, count = e[count > 1], count[count > 1]
    step = np.array([s for _, s in STEPS])[np.searchsorted([n for n, _ in STEPS], count)]
    kinds = {"id": pa.int64(), "start": pa.int32(), "gram": pa.int64(), "off": pa.int16(), "run": pa.int16(), "step": pa.int16()}
    values = {"id": e["id"], "start": e["start"], "gram": np.ascontiguousarray(e["gram"]).view(np.int64), "off": e["off"], "run": e["run"], "step": step}
    return pa.table({c: pa.array(np.ascontiguousarray(values[c]), k) for c, k in kinds.items()})


def cut_spans(e: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(spans in ranges of ``step`` windows by their place before the anchor, the anchor each comes from)"""
    off, run = e["off"].astype(np.int64), e["run"].astype(np.int64)
    low, high = (off - run) // step, off // step
    owner = np.repeat(np.arange(len(e)), high - low + 1)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[owner]
    out, s = e[owner], step[owner]
    last = np.minimum(off[owner], part * s + s - 1)
    out["run"] = last - np.maximum(off[owner] - run[owner], part * s)
    out["start"] += (off[owner] - last).astype(np.int32)
    out["off"] = last
    return out, owner


def edge_bytes(buckets: int):
    """(bucket, payload): the spans of a document's row, by the bytes that all windows of their range share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids, texts, wanted = b.column(0).to_numpy(), b.column(1), b.column(2)
            for i in range(b.num_rows):
                data = np.frombuffer(texts[i].as_buffer(), np.uint8)
                w = wanted[i].values
                start, gram, off, run_, step = (w.field(k).to_numpy() for k in range(5))
                a = np.zeros(len(start), ANCHOR)
                a["gram"], a["id"], a["start"], a["off"], a["run"] = gram.view(np.uint64), ids[i], start, off, run_
                inside = start.astype(np.int64) + run_ + WIDTH <= len(data)  # a repeated id may have a shorter text
                a, owner = cut_spans(a[inside], step[inside].astype(np.int64))
                step = step[inside].astype(np.int64)[owner]
                for lo in range(0, len(a), STRIP):
                    p, s = a[lo : lo + STRIP], step[lo : lo + STRIP]
                    e = np.zeros(len(p), EDGE)
                    for c in ("id", "start", "off", "run"):
                        e[c] = p[c]
                    e["key"] = p["gram"]
                    e["bytes"] = span_bytes(data, p["start"].astype(np.int64), p["run"].astype(np.int64) + WIDTH)
                    cut = np.flatnonzero(s < GRAMS)
                    if len(cut):
                        # What the range's windows share begins where its last window does.
                        o, k = p["off"][cut].astype(np.int64), s[cut]
                        begin, n = o - o // k * k, WIDTH + 1 - k
                        place = np.arange(WIDTH)
                        core = np.where(place < n[:, None], e["bytes"][cut[:, None], np.minimum(begin[:, None] + place, SPAN - 1)], 0)
                        e["key"][cut] = mix((core * _CORE).sum(axis=1, dtype=np.uint64) ^ mix(p["gram"][cut] + (o // k).astype(np.uint64)))
                    held.append(e)
                    size += len(e)
                    if size >= RUN:
                        yield flush(held, buckets)
                        held, size = [], 0
        if held:
            yield flush(held, buckets)

    def flush(held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
        e = np.concatenate(held)
        # Equal spans of the run, but for the earliest, are covered here and go no further.
        again = repeated(e["key"])
        kept, covered = distinct_spans(e[again], e["bytes"][again])
        e = np.concatenate([e[~again], kept])
        return packed_rows(by_bucket(e, e["key"], buckets) + [(None, covered.tobytes())] * bool(len(covered)))

    return run


def covered_edges(part: pa.Table) -> pa.Table:
    """Of a bucket's spans: the bytes that an equal earlier window covers, as ranges."""
    e = np.frombuffer(b"".join(x.as_py() for x in part["payload"]), EDGE)
    e = e[repeated(e["key"])]
    n = len(e)
    off, run = e["off"].astype(np.int64), e["run"].astype(np.int64)
    k = np.arange(WIDTH)
    right = np.where(off[:, None] + k < (run + WIDTH)[:, None], e["bytes"][np.arange(n)[:, None], np.minimum(off[:, None] + k, SPAN - 1)], 0)
    k = np.arange(GRAMS - 1)
    left = np.where(k < off[:, None], e["bytes"][np.arange(n)[:, None], np.maximum(off[:, None] - 1 - k, 0)], 0)
    after, before = np.minimum(run + WIDTH - off, WIDTH), off
    by_right, lcp_right = deep_shallow(right.astype(np.uint8), after, e["key"])
    by_left, lcp_left = deep_shallow(left.astype(np.uint8), before, e["key"])

    def agreeing(by: np.ndarray, lcp: np.ndarray, depth) -> np.ndarray:
        """A number for each row, the same for rows that agree so far."""
        out = np.zeros(n, np.int64)
        out[by] = np.cumsum(lcp < depth)
        return out

    # Spans that agree over all their bytes: but for the earliest they are covered in whole.
    same_right = agreeing(by_right, lcp_right, np.maximum(after[by_right], np.append(-1, after[by_right][:-1])))
    same_left = agreeing(by_left, lcp_left, np.maximum(before[by_left], np.append(-1, before[by_left][:-1])))
    place = e["start"].astype(np.int64) + off
    keep, later = of_equal((e["id"], place), [run, off, same_right, same_left])
    out = [whole_ranges(e[later])]
    keep = keep[repeated(e["key"][keep])]
    for o in range(GRAMS):
        # Windows that begin o bytes before their anchor; such a window must be one of the anchor's own.
        has = keep[(off[keep] >= o) & (off[keep] - o <= run[keep])]
        if len(has) < 2:
            continue
        r, l = agreeing(by_right, lcp_right, WIDTH - o)[has], agreeing(by_left, lcp_left, o)[has]
        _, later = of_equal((e["id"][has], place[has]), [r, l])
        covered = np.zeros(len(later), RANGE)
        covered["id"], covered["start"], covered["length"] = e["id"][has[later]], place[has[later]] - o, WIDTH
        out.append(covered)
    return pa.table(ranges_table(united(np.concatenate(out))))


def covered_ranges(docs: DataFrame) -> DataFrame:
    """(id, start, length) of covered bytes; ``docs`` has id and text, neither null."""
    buckets = bucket_count(docs)

    def dealt_to(df: DataFrame, run, label: str) -> tuple[DataFrame, DataFrame]:
        rows = stored(df.mapInArrow(run, "bucket int, payload binary"), label)
        covered = rows.filter("bucket IS NULL").select("payload").mapInArrow(covered_before, RANGES_DDL)
        return rows.filter("bucket IS NOT NULL"), stored(covered, "suffix-covered")

    packed, first = dealt_to(docs, packed_anchors(buckets), "suffix-anchors")
    found = packed.groupBy("bucket").applyInArrow(repeated_grams, "id long, start int, gram long, off short, run short, step short")
    wanted = found.groupBy(F.col("id").alias("wid")).agg(F.collect_list(F.struct("start", "gram", "off", "run", "step")).alias("wanted"))
    wanted = stored(wanted, "suffix-wanted")
    discard(packed)
    texts = docs.join(wanted, F.col("id") == F.col("wid")).select("id", "text", "wanted")
    packed, second = dealt_to(texts, edge_bytes(buckets), "suffix-spans")
    discard(wanted)
    third = stored(packed.groupBy("bucket").applyInArrow(covered_edges, RANGES_DDL), "suffix-covered")
    return first.union(second).union(third)


def united(ranges: np.ndarray) -> np.ndarray:
    """Ranges, united where they touch."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.lexsort((ranges["start"], ranges["id"]))]
    start, end = ranges["start"].astype(np.int64), ranges["start"].astype(np.int64) + ranges["length"]
    # Ids by their number, so that one running maximum serves all.
    doc = np.cumsum(np.append(0, ranges["id"][1:] != ranges["id"][:-1])) << 33
    furthest = np.maximum.accumulate(doc + end)
    head = np.ones(len(ranges), bool)
    head[1:] = (doc + start)[1:] > furthest[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(ranges)) - 1
    out = np.zeros(len(first), RANGE)
    out["id"], out["start"], out["length"] = ranges["id"][first], start[first], furthest[last] - (doc + start)[first]
    return out


@tidied
def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the remaining bytes."""
    plain = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    ranges = tidied(covered_ranges)(plain.filter("id IS NOT NULL").select(F.col("id").cast("long"), "text"))
    ranges = ranges.groupBy(F.col("id").alias("rid")).agg(F.collect_list(F.struct("start", "length")).alias("ranges"))
    joined = plain.join(stored(ranges, "suffix-ranges"), F.col("id") == F.col("rid"), "left").select("id", "text", "ranges")
    kind = plain.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, ranges in zip(b.column(1), b.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                kept, spans, n = data, 0, 0
                if ranges.is_valid:
                    v = ranges.values
                    r = np.zeros(len(v), RANGE)
                    r["start"], r["length"] = v.field(0).to_numpy(), v.field(1).to_numpy()
                    r = united(r)
                    r = r[r["start"] < len(data)]
                    parts, end = [], 0
                    for _, s, k in r.tolist():
                        parts.append(data[end:s])
                        end = min(s + k, len(data))
                        n += end - s
                    kept, spans = b"".join([*parts, data[end:]]), len(r)
                rows.append((len(data), n, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), *[pa.array(cols[4], pa.binary())] * with_text]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
