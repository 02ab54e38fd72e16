"""Toxicity scores from the nearest labelled examples by exact weighted TF-IDF cosine over a block-max inverted index.

1. Examples: labelled rows of the folds that may be learned from, at most about ``examples`` of them, by a hash of the
   id. Terms: every word of theirs. Inverse document frequencies come from every document; each is multiplied by how
   far the word's document counts tell the labels of the examples apart (the phi coefficient, 0 to 1), so common words
   do not drown telling ones and no word is left out.
2. The index holds, for each term, postings by block of BLOCK examples and the largest weight in each block. A query
   bounds its cosine with any example of a block by the block's largest weights, opens the blocks of the highest bounds
   and then all whose bound reaches the k-th best cosine: the result is that of a full scan.
3. The k neighbours vote with weights 1 / (distance + SOFTEN). Votes of the examples themselves, each without itself and
   weighted by counts without itself, give an isotonic calibration. Neighbours and cosines are returned as evidence.

The examples are bounded by a documented parameter, and their words with them, so the index does not grow with the
corpus; document frequencies and scores cover all rows and whole texts.

Defined results. Null and empty texts, like texts that share no telling word with an example, have no neighbours and
get the share of toxic examples without neighbours. Equal cosines go by the smaller example id. Null ids are scored and match no label; labels
with a null id or value are ignored; an example id that repeats with different texts gives several examples. Without
any example every score is 0. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import fold, share, stored, table, tidied
from lipika.llm.counting import CHUNKS, cell_counts
from lipika.llm.isotonic import pool_adjacent, probability

EXAMPLES = 4000
K = 15
BLOCK = 64
#: Blocks that a query opens at first.
FIRST = 4
#: Terms that are counted together.
RUN = 1_000_000
SOFTEN = 0.05
#: ASCII letters in lower case, digits and non-ASCII bytes as they are, anything else a space.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, y, text) as (id, y, distinct words, counts)."""
    for b in batches:
        found = [Counter(words(t.as_py())) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:2], pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
            ["id", "y", "words", "counts"],
        )


def telling(n0: np.ndarray, n1: np.ndarray, all0: float, all1: float) -> np.ndarray:
    """Phi coefficient, without its sign, of words in n0 of all0 and n1 of all1 examples of the labels; 0 where a label has none."""
    has, total = n0 + n1, all0 + all1
    spread = all0 * all1 * has * (total - has)
    return np.abs(n1 * (all0 - n0) - n0 * (all1 - n1)) / np.sqrt(np.where(spread > 0, spread, np.inf))


def vector(text: str | None, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts) of a whole text; terms count from 1."""
    found = Counter(map(place.get, words(text))) if place else Counter()
    found.pop(None, None)
    at = np.fromiter(found.keys(), np.int64, len(found))
    order = np.argsort(at)
    return at[order], np.fromiter(found.values(), np.int64, len(found))[order]


def document_counts(docs: DataFrame, terms: list[bytes], text_col: str) -> np.ndarray:
    """Documents per term, over all rows."""

    def found(column: pa.Array) -> Iterator[np.ndarray]:
        if not place:
            place.update({w: i + 1 for i, w in enumerate(shared())})
        held, size = [], 0
        for t in column:
            held.append(vector(t.as_py(), place)[0].astype(np.uint64))
            size += len(held[-1])
            if size >= RUN:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)

    shared, place = share(docs.sparkSession, terms), {}
    cells = max(CHUNKS, 1 << len(terms).bit_length())
    return cell_counts(docs.select(docs[f"`{text_col}`"]), found, cells)[: len(terms) + 1]


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one span after the other."""
    n = end - start
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(start - (ends - n), n)


class Index:
    """Postings by (term, block) with the largest weight of each; examples are ordered so that like ones share blocks."""

    def __init__(self, ids: list, ys: list[float], vectors: list[tuple[list[int], list[int]]], idf: np.ndarray, k: int = K, block: int = BLOCK):
        self.idf, self.k, self.block = idf, k, block
        weighted = [self.weigh(t, c) for t, c in vectors]
        bare = [i for i, (t, _) in enumerate(vectors) if not len(t)]
        prior = (sum(ys) / len(ys)) if ys else 0.0
        self.empty = (sum(ys[i] for i in bare) + prior) / (len(bare) + 1)
        order = sorted(
            (i for i, (t, _) in enumerate(vectors) if len(t)),
            key=lambda i: ([int(t) for t in np.asarray(vectors[i][0])[np.argsort(-weighted[i], kind="stable")[:8]]], ids[i]),
        )
        self.ids = np.array([ids[i] for i in order], dtype=object)
        self.rank = np.argsort(np.argsort(np.array([ids[i] for i in order], dtype=np.int64), kind="stable")) if order else np.zeros(0, np.int64)
        self.y = np.array([ys[i] for i in order])
        self.blocks = -(-len(order) // block)
        # Postings by (term, place); a run of them is a term's part in a block.
        n = np.array([len(vectors[i][0]) for i in order], np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(np.asarray(vectors[i][0], np.int64) for i in order)])
        weight = np.concatenate([np.zeros(0), *(weighted[i] for i in order)])
        place = np.repeat(np.arange(len(order)), n)
        some = np.flatnonzero(weight > 0)
        some = some[np.lexsort((place[some], term[some]))]
        term, self.place, self.weight = term[some], place[some].astype(np.int32), weight[some]
        head = np.ones(len(term), bool)
        head[1:] = (term[1:] != term[:-1]) | (self.place[1:] // block != self.place[:-1] // block)
        first = np.flatnonzero(head)
        self.part = np.append(first, len(term))
        self.in_block = self.place[first] // block
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.start = np.searchsorted(term[first], np.arange(len(idf) + 1))
        self.curve: np.ndarray | None = None

    def weigh(self, terms, counts, idf=None) -> np.ndarray:
        """Unit TF-IDF weights; ``idf`` in place of the index's for these terms."""
        if not len(terms):
            return np.zeros(0)
        w = (1 + np.log(np.asarray(counts, float))) * (self.idf[np.asarray(terms)] if idf is None else idf)
        size = np.sqrt((w**2).sum())
        return w / size if size else w

    def nearest(self, terms, counts, but=None, idf=None) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples, nearest first, without the example of id ``but``."""
        terms, q = np.asarray(terms, np.int64), self.weigh(terms, counts, idf)
        first, last = self.start[terms], self.start[terms + 1]
        part, weight = spans(first, last), np.repeat(q, last - first)
        block = self.in_block[part]
        bound = np.bincount(block, weight * self.most[part], minlength=self.blocks)
        turn = np.argsort(-bound, kind="stable")
        sims, places, kth = np.zeros(0), np.zeros(0, np.int64), -1.0
        for now in (turn[:FIRST], turn[FIRST:]):
            now = now[(bound[now] > 0) & (bound[now] >= kth - 1e-12)]
            if not len(now):
                continue
            chosen = np.zeros(self.blocks, bool)
            chosen[now] = True
            mine = np.flatnonzero(chosen[block])
            p = part[mine]
            n = self.part[p + 1] - self.part[p]
            at = spans(self.part[p], self.part[p + 1])
            got = np.bincount(self.place[at], np.repeat(weight[mine], n) * self.weight[at], minlength=len(self.ids))
            if but is not None:
                got[self.ids == but] = 0
            # Only what may be among the k best is rounded and sorted.
            at = np.flatnonzero(got > max(0.0, np.partition(got, -self.k)[-self.k] - 1e-9) if len(got) > self.k else got > 0)
            at = at[got[at] >= 5e-13]
            sims, places = np.concatenate([sims, np.round(got[at], 12)]), np.concatenate([places, at])
            best = np.lexsort((self.rank[places], -sims))[: self.k]
            sims, places = sims[best], places[best]
            if len(sims) == self.k:
                kth = sims[-1]
        return places, sims

    def vote(self, places: np.ndarray, sims: np.ndarray) -> float:
        w = 1 / (1 - np.minimum(sims, 1) + SOFTEN)
        return float((w * self.y[places]).sum() / w.sum()) if len(places) else float(self.empty)

    def calibrate(self, ids: list, ys: list[float], vectors, idfs: list) -> None:
        """From the examples' own votes; ``idfs`` are the weights of each one's terms without it."""
        found = [(*self.nearest(t, c, but=i, idf=w), y) for i, y, (t, c), w in zip(ids, ys, vectors, idfs, strict=True)]
        raw = [(self.vote(places, sims), y) for places, sims, y in found if len(places)]
        bare = [y for places, _, y in found if not len(places)]
        self.empty = (sum(bare) + (sum(ys) / len(ys) if ys else 0.0)) / (len(bare) + 1)
        if raw:
            x, inverse = np.unique(np.round([r for r, _ in raw], 3), return_inverse=True)
            y = np.bincount(inverse, [v for _, v in raw])
            self.curve = pool_adjacent(x, y, np.bincount(inverse).astype(float))

    def score(self, terms, counts) -> tuple[float, list]:
        """(probability, evidence as [(id, cosine), ...])"""
        places, sims = self.nearest(terms, counts) if len(terms) and len(self.ids) else ((), ())
        if not len(places):
            return float(self.empty), []
        p = self.vote(places, sims)
        if self.curve is not None:
            p = float(probability(self.curve, np.array([p]))[0])
        return p, [(self.ids[i], float(s)) for i, s in zip(places[:3], sims[:3], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", folds=5, held=0, examples=EXAMPLES, k=K) -> tuple[Index, list[bytes]]:
    """(index, terms)"""
    known = labels.select(labels[f"`{id_col}`"].alias("lid"), labels[f"`{label_col}`"].cast("double").alias("y"))
    known = known.filter((fold(F.col("lid"), folds) != held) & F.col("y").isin(0.0, 1.0))
    n = known.count()
    share = min(1.0, examples / max(n, 1))
    pick = F.crc32(F.concat(F.lit("example:"), F.col("lid").cast("string")).cast("binary")) < F.lit(int(share * 2**32))
    # About ``examples`` rows of an id and a number: a proven bound for the broadcasts.
    known = known.filter(pick).groupBy("lid").agg(F.max("y").alias("y"))
    chosen = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).join(F.broadcast(known), F.col("id") == F.col("lid"))
    kind = chosen.schema["id"].dataType.simpleString()
    rows = stored(chosen.select("id", "y", "text"), "toxic-examples").mapInArrow(bags, f"id {kind}, y double, words array<binary>, counts array<int>")
    rows = rows.toArrow()  # the examples
    ids, ys = rows["id"].to_pylist(), rows["y"].to_numpy()
    n = pc.list_value_length(rows["words"]).to_numpy().astype(np.int64)
    coded = pc.list_flatten(rows["words"]).combine_chunks().dictionary_encode()
    every, counts = coded.dictionary.to_pylist(), pc.list_flatten(rows["counts"]).to_numpy()
    order = sorted(range(len(every)), key=every.__getitem__)
    terms = [every[i] for i in order]
    number = np.zeros(len(terms), np.int64)
    number[order] = np.arange(1, len(terms) + 1)
    term, end = number[coded.indices.to_numpy()], np.cumsum(n)
    vs = []
    for i, j in zip(end - n, end, strict=True):
        by = np.argsort(term[i:j])
        vs.append((term[i:j][by], counts[i:j][by]))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], vs[i][0].tolist(), vs[i][1].tolist()))
    ids, ys, vs = [ids[i] for i in order], ys[order], [vs[i] for i in order]
    per = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(v[0] for v, y in zip(vs, ys, strict=True) if y == label)]), minlength=len(terms) + 1) for label in (0, 1)]
    all0, all1 = float((ys == 0).sum()), float((ys == 1).sum())
    df = document_counts(docs, terms, text_col)
    idf = np.log(1 + docs.count() / np.maximum(df, 1))
    index = Index(ids, ys.tolist(), vs, idf * telling(*per, all0, all1), k)
    without = [idf[t] * telling(per[0][t] - (1 - y), per[1][t] - y, all0 - (1 - y), all1 - y) for (t, _), y in zip(vs, ys, strict=True)]
    index.calibrate(ids, ys.tolist(), vs, without)
    return index, terms


@tidied
def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", folds=5, held=0, **kw) -> DataFrame:
    """Per row: id, held_out, score, predicted, evidence (nearest examples and their cosines)."""
    index, terms = fit(docs, labels, id_col, text_col, folds=folds, held=held, **kw)
    shared = share(docs.sparkSession, (index, terms))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, terms = shared()
        place = {w: i + 1 for i, w in enumerate(terms)}
        for b in batches:
            got = [index.score(*vector(t.as_py(), place)) for t in b.column(1)]
            evidence = pa.array([[{"id": i, "similarity": s} for i, s in e] for _, e in got], pa.list_(pa.struct([("id", b.schema.field(0).type), ("similarity", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in got], pa.float64()), evidence], ["id", "score", "evidence"])

    out = docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"]).mapInArrow(run, f"id {kind}, score double, evidence array<struct<id:{kind},similarity:double>>")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence",
    )


@tidied
def without_toxic(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """The rows of ``docs`` whose score is below one half; each row is judged by its own text, none is moved."""
    index, terms = fit(docs, labels, id_col, text_col, **kw)
    shared = share(docs.sparkSession, (index, terms))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, terms = shared()
        place = {w: i + 1 for i, w in enumerate(terms)}
        for b in batches:
            yield b.filter(pa.array([index.score(*vector(t.as_py(), place))[0] < 0.5 for t in b.column(at)], pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots do not pass
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
