"""Exact Jaccard join of shingle sets by universe partition and the pigeonhole principle.

Two sets with Jaccard >= t differ in at most (1 - t) / (1 + t) of their summed sizes. In each size band every set is
hashed into m segments, the same for all sets of the band; a pair that differs in at most u elements agrees on at least
m - u segments. Cost-based allocation decides which are indexed:

* Segments get an order from how rare their content is: by how many of their shingles are not frequent in the corpus
  (a count of all shingles in CELLS cells says which are), frequent ones late, empty ones last, ties by hash. A set indexes only
  the first u + 1 segments of that order; under a common order any pair in question meets in one of them. So the
  costly segments, those that many sets share, get no allocation.
* Or a band has d = u / 2 + 1 segments: a pair differs by at most one shingle in one of them, so each segment is indexed
  with its one-deletion neighbourhood. That is more entries, but of longer segments, none of which may be left out.
* The costs come from the counts: the share of shingles that are frequent, and how often those occur, say how many
  entries of either kind a band's sets would be forced to share with strangers. The cheaper kind is allocated.

Sets of equal content are one node before anything is compared. Sets that meet in an entry are compared with the
entry's first set, exactly, on their full sets; components are formed; then members of an entry that are still in
different components are compared with each other, until every pair that meets is either compared or connected. No
pairs are made within what is already connected, so a group of near copies costs its size and not its square.

Defined results. Null and empty texts have size 0 and are linked with nothing. Texts of fewer words than a shingle are
one shingle. Equal texts, also under a repeated id, are linked. A null id has a row, links like others and is never the
smallest id unless all that it reaches are null. Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import bucket_count, discard, in_blocks, is_empty, stored, table, tidied
from lipika.llm.components import connected_components
from lipika.llm.counting import cell_counts
from lipika.llm.shingles import digest, links, mix, sets, shingles
from lipika.llm.textbytes import slices

PERCENT = 75
CELLS = 1 << 20
#: Largest sizes of the bands; each is three times the one before.
FIRST_BAND, GROWTH = 5, 3
#: Entries with at most so many sets are compared in full at once; larger ones through HUBS of them first.
SMALL, HUBS = 48, 8
#: Sets that one task compares with how many others of a group, and pairs that it looks at together.
PART, OTHERS, STRIP = 1024, 8192, 4096
PROFILE = 256
#: Entries that a task holds before they go out.
RUN = 1_000_000
#: Segments that are made at a time.
SEGMENTS = 500_000
BLOCK = 2 << 20


def most_different(n: np.ndarray, top: np.ndarray, percent: int) -> np.ndarray:
    """The largest difference of a set of size n and a partner of size at most ``top`` with at least that Jaccard."""
    top = np.minimum(top, n * 100 // percent)
    return (n + top) * (100 - percent) // (100 + percent)


def bands(largest: int, percent: int = PERCENT, share: float = 0.0, load: float = 0.0) -> list[tuple[int, int, int, int]]:
    """(low, high, segments, segments with deletions or 0) up to the size ``largest``.

    ``share`` of the shingles are frequent, and those occur ``load`` times: what an entry costs that only they make up.
    """
    out, low, high = [], 1, FIRST_BAND
    while low <= max(largest, 1):
        different = lambda n, top: int(most_different(np.array([n]), np.array([top]), percent)[0])  # noqa: E731, B023
        m = max(different(high, high * 100 // percent) + 1, high // 2)
        d = different(high, high) // 2 + 1
        # The band's smallest sets that link with others at all are the ones that run out of segments.
        n = next((n for n in range(low, high) if different(n, high)), high)
        k = different(n, high) + 1
        rare = m * (1 - (1 - 1 / m) ** n) * (1 - share ** max(1.0, n / m))
        plain = k + load * max(0.0, k - rare)
        deletions = n + d + load * (d * (1 - 1 / d) ** n + (n + d) * share ** max(1.0, n / d - 1))
        out.append((low, high, m, d if deletions < plain else 0))
        low, high = high + 1, high * GROWTH
    return out


class Signer:
    """Index entries of sets."""

    def __init__(self, frequent: np.ndarray, percent: int = PERCENT, share: float = 0.0, load: float = 0.0):
        self.frequent, self.percent, self.counts = frequent, percent, (share, load)
        self._grow(1 << 20)

    def _grow(self, largest: int) -> None:
        self.bands = bands(largest, self.percent, *self.counts)
        self.high = np.array([b[1] for b in self.bands])

    def entries(self, group: list[np.ndarray]) -> list[np.ndarray]:
        """Entries of each set; sorted within a band."""
        sizes = np.array([len(s) for s in group])
        while len(group) and sizes.max() > self.high[-1]:
            self._grow(int(self.high[-1]) * GROWTH)
        own = np.searchsorted(self.high, sizes)
        out: list[list[np.ndarray]] = [[] for _ in group]
        for b, (low, high, m, d) in enumerate(self.bands):
            # As a band's own set, or as the smaller partner of one of the band's sets.
            mine = np.flatnonzero((sizes > 0) & ((own == b) | ((own == b - 1) & (sizes * 100 // self.percent >= low))))
            if not len(mine):
                continue
            n = sizes[mine]
            u = most_different(n, np.full(len(n), high), self.percent)
            some = u > 0  # with u = 0 only equal sets link, and those are one node
            mine, u = mine[some], u[some]
            if not len(mine):
                continue
            salt = np.uint64((b + 1) * 0xD6E8FEB86659FD93 % 2**64)
            step = min(2048, max(1, SEGMENTS // (d or m)))
            for lo in range(0, len(mine), step):
                part = mine[lo : lo + step]
                sets_ = [group[i] for i in part]
                made = self._neighbourhoods(sets_, d, salt) if d else self._segments(sets_, u[lo : lo + step], m, salt)
                for i, e in zip(part, made, strict=True):
                    out[i].append(e)
        return [np.concatenate(o) if o else np.zeros(0, np.uint64) for o in out]

    def _neighbourhoods(self, group: list[np.ndarray], d: int, salt: np.uint64) -> list[np.ndarray]:
        """Every segment, and every segment without one of its shingles."""
        k, n = len(group), np.array([len(s) for s in group])
        of = np.repeat(np.arange(k), n)
        spread = mix(np.concatenate(group) ^ salt)
        segment = ((spread >> np.uint64(32)) * np.uint64(d) >> np.uint64(32)).astype(np.int64)
        code = of * d + segment
        order = np.argsort(code, kind="stable")
        used, first = np.unique(code[order], return_index=True)
        total = np.zeros(k * d, np.uint64)
        total[used] = np.add.reduceat(mix(spread)[order], first)
        tag = mix(np.arange(d, dtype=np.uint64) ^ salt)
        # Bit 63 stays clear for MORE.
        whole = (mix(total ^ np.tile(tag, k)) >> np.uint64(1)).reshape(k, d)
        less = mix((total[code] - mix(spread)) ^ tag[segment]) >> np.uint64(1)
        ends = np.cumsum(n)
        return [np.concatenate([whole[i], less[ends[i] - n[i] : ends[i]]]) for i in range(k)]

    def _segments(self, group: list[np.ndarray], u: np.ndarray, m: int, salt: np.uint64) -> list[np.ndarray]:
        k = len(group)
        flat = np.concatenate(group)
        of = np.repeat(np.arange(k), [len(s) for s in group])
        spread = mix(flat ^ salt)
        code = of * m + ((spread >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        rare = np.bincount(code, ~self.frequent[(flat & np.uint64(CELLS - 1)).astype(np.int64)], k * m)
        # Sums of 32-bit halves stay exact in doubles; together they name the segment's content.
        low = np.bincount(code, (spread & np.uint64(0xFFFFFFFF)).astype(float), k * m).astype(np.uint64)
        count = np.bincount(code, (mix(spread) >> np.uint64(32)).astype(float), k * m).astype(np.uint64)
        segment = np.tile(np.arange(m, dtype=np.uint64), k)
        name = mix(low ^ mix(count ^ mix(segment ^ salt)))
        # 11 bits of set, 2 bits of rarity (rarest first), 51 bits of name: one sort orders all.
        filled = (low != 0) | (count != 0)
        tier = np.where(filled, 2 - np.minimum(rare, 2), 3).astype(np.uint64)
        packed = np.repeat(np.arange(k, dtype=np.uint64), m) << np.uint64(53) | tier << np.uint64(51) | name >> np.uint64(13)
        packed.sort()
        names = packed & np.uint64((1 << 51) - 1)
        return [names[i * m : i * m + min(int(u[i]) + 1, m)] for i in range(k)]


def frequent_cells(docs: DataFrame) -> tuple[np.ndarray, float, float]:
    """(which of CELLS cells of shingle hashes hold clearly more than their share, the share of shingles in them, how many a cell of theirs holds), over all rows."""
    total = cell_counts(docs.select("text"), lambda column: (shingles(t)[0] for _, t in slices(column, BLOCK)), CELLS)
    mean = total.mean()
    frequent = total > mean + 3 * np.sqrt(mean) + 4
    held = total[frequent].astype(float)
    return frequent, float(held.sum() / max(total.sum(), 1)), float((held**2).sum() / max(held.sum(), 1))


def profile(members: np.ndarray) -> bytes:
    """How many shingles fall in each of PROFILE cells, 255 for that many or more: bounds any intersection from above."""
    return np.minimum(np.bincount((members >> np.uint64(40)).astype(np.int64) % PROFILE, minlength=PROFILE), 255).astype(np.uint8).tobytes()


def at_most_shared(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bound of the intersections of profile rows; a full cell may hold anything up to n."""
    both = np.minimum(x, y)
    return np.where((both == 255).any(axis=1), n, both.sum(axis=1, dtype=np.int64))


ENTRY = np.dtype([("entry", "<u8"), ("node", "<i8")])
MEETING = np.dtype([("entry", "<i8"), ("hub", "<i8"), ("node", "<i8")])
#: Set in an entry whose node stands for more nodes that met it before the exchange; clear in every entry's own name.
MORE = np.uint64(1 << 63)
MET_DDL = "entry long, hub long, member long"


def number(name: bytes) -> int:
    """The 64 bits of a set's name that stand for it in entries."""
    return int.from_bytes(name[:8], "little", signed=True)


def _meet(entry: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (entry, node), whether each is its entry's first, and the first node of its entry."""
    order = np.lexsort((node, entry))
    entry, node = entry[order], node[order]
    if len(entry):
        fresh = np.ones(len(entry), bool)
        fresh[1:] = (entry[1:] != entry[:-1]) | (node[1:] != node[:-1])
        entry, node = entry[fresh], node[fresh]
    head = np.ones(len(entry), bool)
    head[1:] = entry[1:] != entry[:-1]
    hub = node[np.flatnonzero(head)][np.cumsum(head) - 1] if len(node) else node
    return entry, node, head, hub


def signed(docs: DataFrame, counts: tuple[np.ndarray, float, float], percent: int, buckets: int) -> DataFrame:
    """Rows of three kinds: documents (with a name), entries packed by bucket, and meetings (a payload without a bucket).

    Nodes that share an entry within a run of documents meet here: only the first goes on under that entry, marked with
    MORE, so that an entry of a third of all documents still sends one row per run.
    """
    frequent, *rest = counts
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(np.unpackbits(shared.value, count=CELLS).astype(bool), percent, *rest)
        held, size = [], 0
        names = ["bucket", "payload", "id", "key", "n", "node", "name", "profile"]

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            entry, node, head, hub = _meet(np.concatenate([e for e, _ in held]), np.concatenate([n for _, n in held]))
            met = np.zeros(int((~head).sum()), MEETING)
            met["entry"], met["hub"], met["node"] = entry[~head].view(np.int64), hub[~head], node[~head]
            out = np.zeros(int(head.sum()), ENTRY)
            first = np.flatnonzero(head)
            several = np.diff(np.concatenate([first, [len(entry)]])) > 1
            out["entry"], out["node"] = entry[first] | np.where(several, MORE, np.uint64(0)), node[first]
            bucket = (entry[first] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            used, first = np.unique(bucket, return_index=True)
            rows = [(b, out[i:j].tobytes()) for b, i, j in zip(used.tolist(), first, np.append(first[1:], len(out)), strict=True)]
            rows += [(None, met[i : i + RUN].tobytes()) for i in range(0, len(met), RUN)]
            k = len(rows)
            nothing = [pa.nulls(k, id_type), *[pa.nulls(k, pa.int64())] * 3, *[pa.nulls(k, pa.binary())] * 2]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), *nothing], names)

        for b in batches:
            ids, keys = b.column(0), b.column(2)
            for first, texts in slices(b.column(1), BLOCK):
                group = list(sets(texts))
                named = [digest(s) for s in group]
                nodes = np.array([number(x) for x in named], np.int64)
                k = len(group)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), ids[first : first + k], keys[first : first + k],
                        pa.array([len(s) for s in group], pa.int64()), pa.array(nodes), pa.array(named, pa.binary()),
                        pa.array([profile(s) for s in group], pa.binary()),
                    ],
                    names,
                )
                once = list({x: i for i, x in enumerate(named)}.values())
                entries = signer.entries([group[i] for i in once])
                held.append((np.concatenate(entries), np.repeat(nodes[once], [len(e) for e in entries])))
                size += len(held[-1][0])
                if size >= RUN:
                    yield flush(ids.type)
                    held, size = [], 0
        if size:
            yield flush(ids.type)

    return docs.select("id", "text", "key").mapInArrow(run, f"bucket int, payload binary, id {kind}, key long, n long, node long, name binary, profile binary")


def before_exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The meetings (entry, hub, member) of payloads."""
    for b in batches:
        for x in b.column(0):
            met = np.frombuffer(x.as_buffer(), MEETING)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(met[c]), pa.int64()) for c in ("entry", "hub", "node")], ["entry", "hub", "member"])


def meetings(part: pa.Table) -> pa.Table:
    """Of one bucket: (entry, hub, member) for every node after an entry's first.

    An entry of exactly two nodes that stand for themselves is done once these are compared: its name stays null.
    """
    rows = np.frombuffer(b"".join(x.as_py() for x in part["payload"]), ENTRY)
    name, node, head, hub = _meet(rows["entry"] & ~MORE, rows["node"])
    marked = np.unique(rows["entry"][rows["entry"] >= MORE] & ~MORE)
    size = np.diff(np.concatenate([np.flatnonzero(head), [len(head)]]))[np.cumsum(head) - 1] if len(head) else np.zeros(0, np.int64)
    done = (size == 2) & ~np.isin(name, marked)
    duo = np.unique(np.column_stack([hub[done & ~head], node[done & ~head]]), axis=0) if (done & ~head).any() else np.zeros((0, 2), np.int64)
    more = ~head & ~done
    entry = pa.concat_arrays([pa.nulls(len(duo), pa.int64()), pa.array(name[more].view(np.int64), pa.int64())])
    hub, node = np.concatenate([duo[:, 0], hub[more]]), np.concatenate([duo[:, 1], node[more]])
    return pa.table([entry, pa.array(hub, pa.int64()), pa.array(node, pa.int64())], names=["entry", "hub", "member"])


def cross_pairs(percent: int):
    """For rows (entry, node, component, n, profile) sorted by entry: pairs of nodes in different components, that sizes
    and profiles do not rule out. Pairs are made and dropped by STRIP, so the strangers of a common entry give no rows.

    Entries of at most SMALL nodes give all of them. In larger ones a node of each of the HUBS largest components meets
    the nodes outside its component; what that leaves open is for ``far_pairs``.
    """

    def group(node, comp, n, profiles: pa.Array) -> np.ndarray:
        k = len(node)
        if k <= SMALL:
            a, b = np.triu_indices(k, 1)
        else:
            _, inverse, size = np.unique(comp, return_inverse=True, return_counts=True)
            order = mix(node.view(np.uint64))
            hubs = []
            for c in np.argsort(-size, kind="stable")[:HUBS]:
                own = np.flatnonzero(inverse == c)
                hubs.append(own[np.argmin(order[own])])
            a, b = np.repeat(hubs, k), np.tile(np.arange(k), len(hubs))
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        keep = (comp[a] != comp[b]) & (100 * low >= percent * high)
        a, b, low, both = a[keep], b[keep], low[keep], (low + high)[keep]
        if not len(a):
            return np.zeros((0, 2), np.int64)
        cells = np.frombuffer(b"".join(profiles.to_pylist()), np.uint8).reshape(-1, PROFILE)
        out = []
        for lo in range(0, len(a), STRIP):
            x, y = a[lo : lo + STRIP], b[lo : lo + STRIP]
            shared = at_most_shared(cells[x], cells[y], low[lo : lo + STRIP])
            ok = 100 * shared >= percent * (both[lo : lo + STRIP] - shared)
            x, y = node[x[ok]], node[y[ok]]
            out.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
        return np.concatenate(out)

    def pairs(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        """Of the entries that end at the row numbers ``ends``."""
        node, comp, n = (rows[c].to_numpy() for c in ("node", "comp", "n"))
        profiles = rows["profile"]
        got, i = [np.zeros((0, 2), np.int64)], 0
        for j in ends.tolist():
            if j - i > 1:
                got.append(group(node[i:j].copy(), comp[i:j], n[i:j], profiles.slice(i, j - i)))
            i = j
        return _pairs(np.unique(np.concatenate(got), axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            entry = batch.column(0).to_numpy()
            if held and held[-1].column(0)[0].as_py() == entry[-1]:  # one entry, still open
                held.append(batch)
                continue
            rows = pa.Table.from_batches([*held, batch])
            ends = np.flatnonzero(np.diff(rows["entry"].to_numpy())) + 1
            if len(ends):
                yield pairs(rows, ends)
            held = rows.slice(int(ends[-1]) if len(ends) else 0).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield pairs(rows, np.array([rows.num_rows]))

    return run


def far_pairs(percent: int):
    """Of nodes (node, comp, n, profile, mine): pairs of one that is mine and one that is not, in different components,
    that sizes and profiles do not rule out. Rows of pairs are made and dropped by STRIP, so only the promising ones remain."""

    def run(part: pa.Table) -> pa.Table:
        node, comp, n = (part[c].to_numpy() for c in ("node", "comp", "n"))
        cells = np.frombuffer(b"".join(part["profile"].to_pylist()), np.uint8).reshape(-1, PROFILE)
        mine = part["mine"].to_numpy()
        out = [np.zeros((0, 2), np.int64)]
        for i in np.flatnonzero(mine):
            j = np.flatnonzero(~mine & (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            for lo in range(0, len(j), STRIP):
                k = j[lo : lo + STRIP]
                shared = at_most_shared(cells[k], cells[i], np.minimum(n[k], n[i]))
                k = k[100 * shared >= percent * (n[k] + n[i] - shared)]
                out.append(np.column_stack([np.minimum(node[k], node[i]), np.maximum(node[k], node[i])]))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _pairs(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0], pa.int64()), pa.array(rows[:, 1], pa.int64())], ["a", "b"])


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members) of the given (node, name, id, key): sets from the whole texts, made where they are needed.

    An id that repeats with equal text gives equal rows, which do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, want = b.column(0), b.column(1).to_pylist()
            for first, texts in slices(b.column(2), BLOCK):
                group = list(sets(texts))
                keep = [i for i, s in enumerate(group) if digest(s) == want[first + i]]
                yield pa.RecordBatch.from_arrays(
                    [nodes.take(pa.array([first + i for i in keep], pa.int64())), pa.array([group[i].tobytes() for i in keep], pa.binary())], ["node", "members"]
                )

    # The same plan at any size: texts are shuffled by id, and the few rows wanted are the hashed side.
    wanted = nodes.select("node", "name", F.col("id").alias("wid"), F.col("key").alias("wkey")).hint("shuffle_hash")
    rows = docs.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & F.col("key").eqNullSafe(F.col("wkey"))).select("node", "name", "text")
    return rows.mapInArrow(run, "node long, members binary")


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                ok = [links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = members.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = members.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


@tidied
def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id that links reach), class_id (smallest id of an equal set)."""
    docs = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    # Rows without an id are found again by their text.
    docs = docs.withColumn("key", F.when(F.col("id").isNull(), F.xxhash64("text")))
    return _components(docs, percent).withColumnRenamed("id", id_col)


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and profiles do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, PROFILE) for i in (4, 5))
            shared = at_most_shared(x, y, np.minimum(n, m))
            yield b.select(["a", "b"]).filter(pa.array(100 * shared >= percent * (n + m - shared)))

    p = pairs.join(classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa")), "a")
    p = p.join(classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb")), "b")
    p = p.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return p.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def relabelled(label: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, component) after more edges: only the components that they touch are joined anew."""
    if label is None:
        return stored(connected_components(edges, "a", "b"), "ngram-labels")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    label = label.union(ends.join(label, "node", "left_anti").select("node", F.col("node").alias("component")))
    label = stored(label, "ngram-labels")
    q = edges.join(label.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(label.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    over = connected_components(q.select("x", "y"), "x", "y").select(F.col("node").alias("component"), F.col("component").alias("to"))
    return stored(label.join(over, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "ngram-labels")


def told_apart(classes: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes with a node of their own each, and the meetings between those: names that share a node get new ones.

    Each of them takes the meetings of the shared node, and they meet each other under an entry of their own.
    """
    shared = stored(classes.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1").select("node"), "ngram-shared")
    if is_empty(shared):
        return classes, met
    turn, new = 0, classes
    while not is_empty(clash := new.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("node").alias("old"))):
        turn += 1
        other = F.when(F.col("old").isNotNull(), F.xxhash64("name", F.lit(turn))).otherwise(F.col("node"))
        new = stored(new.join(clash, F.col("node") == F.col("old"), "left").withColumn("node", other).drop("old"), "ngram-classes")
    names = classes.join(shared, "node", "left_semi").select(F.col("node").alias("old"), "name").join(new.select("name", F.col("node").alias("new")), "name")
    names = stored(names.select("old", "new"), "ngram-renamed")
    for c in ("hub", "member"):
        met = met.join(names, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
    first = names.groupBy("old").agg(F.min("new").alias("hub"))
    # Entries are never below 0, so these are entries of their own.
    own = names.join(first, "old").filter("new <> hub").select((-1 - F.col("old").bitwiseAND(2**63 - 1)).alias("entry"), "hub", F.col("new").alias("member"))
    return new, stored(met.filter("hub <> member").union(own), "ngram-met")


def _components(docs: DataFrame, percent: int) -> DataFrame:
    everything = stored(signed(docs, frequent_cells(docs), percent, bucket_count(docs)), "ngram-signed")
    rows = everything.filter("name IS NOT NULL").select("id", "key", "n", "node", "name", "profile")
    met = everything.filter("bucket IS NOT NULL").select("bucket", "payload").groupBy("bucket").applyInArrow(meetings, MET_DDL)
    met = met.union(everything.filter("payload IS NOT NULL AND bucket IS NULL").select("payload").mapInArrow(before_exchange, MET_DDL))
    met = stored(met, "ngram-met")
    classes = stored(
        rows.filter("n > 0").groupBy("name").agg(
            F.min("id").alias("class_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("node").alias("node"), F.first("profile").alias("profile")
        ),
        "ngram-classes",
    )
    classes, met = told_apart(classes, met)
    met = met.withColumnRenamed("member", "node")
    rows = stored(rows.select("id", "n", "name"), "ngram-rows")
    discard(everything)

    def compare(pairs: DataFrame) -> DataFrame:
        """Links among the pairs."""
        good = stored(promising(pairs, classes, percent), "ngram-pairs")
        wanted = good.select(F.col("a").alias("node")).union(good.select("b")).distinct()
        # A class that has an id is found by it, else by its text.
        key = F.when(F.col("class_id").isNull(), F.col("key")).alias("key")
        wanted = stored(wanted.join(classes.select("node", "name", F.col("class_id").alias("id"), key), "node"), "ngram-wanted")
        members = stored(full_sets(docs, wanted), "ngram-sets")
        edges = stored(verified(good, members, percent), "ngram-edges")
        discard(pairs, good, wanted, members)
        return edges

    def open_entries(at: DataFrame, label: DataFrame) -> DataFrame:
        """(entry, node, comp, n, k) of entries whose nodes are not all connected yet."""
        now = at.join(label.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        now = stored(now.join(classes.select("node", "n"), "node"), "ngram-at")
        k = now.groupBy("entry").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count("*").alias("k")).filter("p <> q")
        out = stored(now.join(k.select("entry", "k"), "entry").select("entry", "node", "comp", "n", "k"), "ngram-open")
        discard(now)
        return out

    # First every node of an entry meets the entry's first node.
    tried = stored(met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), "ngram-tried")
    label = relabelled(None, compare(tried))
    many = met.filter("entry IS NOT NULL")
    # Then the nodes of an entry that are not connected by that meet each other, or hubs of a large entry.
    open_ = open_entries(many.select("entry", "node").union(many.select("entry", "hub")).distinct(), label)
    if not is_empty(open_):
        at = open_.join(classes.select("node", "profile"), "node").select("entry", "node", "comp", "n", "profile")
        found = at.repartition("entry").sortWithinPartitions("entry").mapInArrow(cross_pairs(percent), "a long, b long").distinct()
        edges = compare(stored(found, "ngram-tried"))
        label = label if is_empty(edges) else relabelled(label, edges)
        # Last, in what large entries leave open, all pairs that sizes and profiles allow. Large entries of a group of
        # near copies hold much the same nodes: entries that overlap are treated as one, so a pair is made once.
        open_ = open_entries(open_.filter(F.col("k") > SMALL).select("entry", "node"), label)
        if not is_empty(open_):
            first = open_.groupBy("entry").agg(F.min("node").alias("first"))
            group = connected_components(open_.join(first, "entry").select("first", "node"), "first", "node").withColumnRenamed("component", "group")
            rows_ = open_.select("node", "comp", "n").distinct().join(group, "node").join(classes.select("node", "profile"), "node")
            rows_ = stored(rows_, "ngram-groups")
            # All of a group but its largest component, with all of it: those in the largest are connected already.
            largest = rows_.groupBy("group", "comp").agg(F.count("*").alias("k")).groupBy("group").agg(F.max(F.struct("k", "comp"))["comp"].alias("most"))
            # Sets that can link are in the same or in neighbouring bands of their size.
            rows_ = rows_.withColumn("band", F.floor(F.log("n") / np.log(100 / percent) + 1e-9)).join(largest, "group")
            mine = rows_.filter("comp <> most").drop("most")
            theirs = rows_.drop("most").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
            spread = in_blocks(mine, theirs, ["group", "band"], ["node"], PART, OTHERS)
            found = spread.groupBy("group", "band", "part", "block").applyInArrow(far_pairs(percent), "a long, b long")
            edges = compare(stored(found.distinct(), "ngram-tried"))
            label = label if is_empty(edges) else relabelled(label, edges)
    # From nodes to rows: a component's smallest id.
    groups = classes.select("name", "node", "class_id").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = groups.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = stored(groups.join(least, "component").select("name", "class_id", "component_id"), "ngram-named")
    out = rows.join(named, "name", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id"))


@tidied
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents of smallest id in their component; rows with a null id stay."""
    found = ngram_components(docs, id_col, text_col, percent)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(stored(gone, "ngram-gone"), docs[f"`{id_col}`"] == F.col("_gone"), "left_anti")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents", "doc_id", "text")).drop("class_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT sh FROM s GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT s.* FROM s SEMI JOIN c ON s.sh = c.sh),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM k a JOIN k b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(id, reach) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.id = w.doc_id
"""
