"""Mix sources to target weights by Pareto order sampling, DataFrame and SQL functions only.

A source with target / size = c + f takes c whole copies of each document (certain) and a fixed number of words more,
f of its size, by Pareto order sampling with unequal probabilities: a document's inclusion odds are f / (1 - f) times
the root of its size over the source's mean size, so that among those taken once more longer documents, which hold more
context, are likelier. Documents are ranked by (u / (1 - u)) / odds, random odds divided by inclusion odds, with u a
hash of the id, and taken from the front until the words are reached; the document that crosses the mark is taken if
that ends nearer. Sample sizes are fixed.

A rank within a source is never a window over the source: words are summed per (source, bin) of the rank, a prefix sum
over the bins finds the bin that holds the mark, that bin is binned once more, and only one small cell is sorted.

Defined results. Null text has size 0, which counts as 1 for the odds; null ids and null sources are ordinary values (a null source ranks last). Equal
ranks go by id, then size. Rows that repeat an id are separate rows. Empty tables give no rows. Where every size is 0,
targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lipika.llm.common import WORD_RE, stored, table, tidied

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BINS = 4096


def uniform(doc_id: Column, seed: str) -> Column:
    """48 hash bits of seed and id, strictly inside (0, 1): (h + 0.5) / 2^48."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source its size and target: shares by weight, capped at ``cap`` times the size, the excess shared again.

    Closed form: in order of cap / weight, a source is capped if its share of what is left exceeds its cap. The
    windows run over one aggregated row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)) + 1)
    order = W.orderBy("room", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    per = per.withColumn("weight", weight).withColumn("room", cap * F.col("source_size") / F.col("weight"))
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(W.partitionBy()),
            "used": cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "left": F.sum("weight").over(after),
        }
    ).withColumn("level", (F.col("total") - F.col("used")) / F.col("left"))
    # Up to the first source whose share fits, sources are capped; that source's level holds for all that follow.
    per = per.withColumn("fits", F.col("level") <= F.col("room"))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(upto)
    target = F.when(first.isNull(), (cap * F.col("source_size")).cast("double")).otherwise(first * F.col("weight"))
    return per.select("source", "docs", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _ranked(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Add the source's target and marks, and the row's place in its source's ranking and the bins of it."""
    larger = F.sqrt(F.greatest("size", F.lit(1)) * F.col("docs") / F.greatest("source_size", F.lit(1)))
    odds = F.when(F.col("f") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")) * larger))
    place = F.col("odds") / (1 + F.col("odds"))  # same order as the odds, inside [0, 1]
    b1 = F.least(F.floor(F.col("place") * BINS), F.lit(BINS - 1))
    b2 = F.least(F.floor((F.col("place") * BINS - F.col("b1")) * BINS), F.lit(BINS - 1))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).withColumn("odds", odds).withColumn("place", place)
    return rows.withColumn("b1", b1).withColumn("b2", b2)


def _mark(cells: DataFrame, b: str, done: Column) -> DataFrame:
    """The bin that the mark falls in: the last one that starts below it; and the words before that bin."""
    upto = W.partitionBy("s").orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", done + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    return cells.filter(F.col("before") < F.col("extra")).groupBy("s").agg(F.max(F.struct(b, "before")).alias("m"))


def _decide(sized: DataFrame, weights, cap) -> tuple[DataFrame, DataFrame]:
    """(targets and marks, a row per source; the rows of the marks' cells that are taken once more)"""
    ratio = F.col("target") / F.greatest("source_size", F.lit(1))
    targets = source_targets(sized, weights, cap).withColumns(
        {"copies": F.floor(ratio), "f": ratio - F.floor(ratio), "extra": F.col("target") - F.floor(ratio) * F.col("source_size")}
    )
    targets = stored(targets.withColumnRenamed("source", "s"), "mix-targets")

    def with_mark(found: DataFrame, bin: str, n: int) -> DataFrame:
        m = found.select(F.col("s").alias(f"s{n}"), F.col(f"m.{bin}").alias(f"at{n}"), F.col("m.before").alias(f"w{n}"))
        return stored(targets.join(m, F.col("s").eqNullSafe(F.col(f"s{n}")), "left").drop(f"s{n}"), "mix-targets")

    cells = _ranked(sized, targets).filter("f > 0").groupBy("s", "b1").agg(F.sum("size").alias("words"), F.first("extra").alias("extra"))
    targets = with_mark(_mark(cells, "b1", F.lit(0)), "b1", 1)
    cells = _ranked(sized, targets).filter("b1 = at1").groupBy("s", "b2").agg(
        F.sum("size").alias("words"), F.first("extra").alias("extra"), F.first("w1").alias("w1")
    )
    targets = with_mark(_mark(cells, "b2", F.col("w1")), "b2", 2)
    upto = W.partitionBy("s").orderBy("odds", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("w2") + F.coalesce(F.sum("size").over(upto), F.lit(0))
    edge = _ranked(sized, targets).filter("b1 = at1 AND b2 = at2").withColumn("start", start)
    # Whole documents up to the mark; the one that crosses it only if half of it or more lies before the mark.
    edge = edge.filter(2 * (F.col("extra") - F.col("start")) >= F.col("size"))
    edge = edge.groupBy(F.col("id").alias("eid"), F.col("s").alias("es"), F.col("size").alias("esize")).agg(F.count("*").alias("n"))
    return targets, stored(edge, "mix-edge")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> dict[str, Column]:
    size = F.coalesce(F.regexp_count(docs[f"`{text_col}`"], F.lit(WORD_RE)), F.lit(0)).cast("long")
    return {"id": docs[f"`{id_col}`"], "source": docs[f"`{source_col}`"], "size": size, "u": uniform(docs[f"`{id_col}`"], seed)}


def _copies(rows: DataFrame, targets: DataFrame, edge: DataFrame, cap: int) -> DataFrame:
    """Add ``times``, how often the mix takes a row. Rows of one id and size in a mark's cell are taken alike."""
    rows = _ranked(rows, targets)
    rows = rows.join(edge, F.col("id").eqNullSafe(F.col("eid")) & F.col("s").eqNullSafe(F.col("es")) & (F.col("size") == F.col("esize")), "left")
    front = (F.col("b1") < F.col("at1")) | ((F.col("b1") == F.col("at1")) & (F.col("b2") < F.col("at2")))
    more = F.coalesce(front, F.lit(False)) | F.col("n").isNotNull()
    return rows.withColumn("times", F.least(F.col("copies") + more.cast("int"), F.lit(cap)).cast("int"))


@tidied
def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, cap=CAP, seed="mix") -> DataFrame:
    """Per row: id, size, source_size, target, taken (words taken, copies times size)."""
    sized = stored(docs.select(*(c.alias(n) for n, c in _sized(docs, id_col, text_col, source_col, seed).items())), "mix-sized")
    targets, edge = _decide(sized, weights, cap)
    out = _copies(sized, targets, edge, cap)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


@tidied
def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, cap=CAP, seed="mix") -> DataFrame:
    """The documents that the mix takes, each as often as it takes them, with all columns and whole texts.

    The decision for a row follows from its source's marks, so texts are not moved. Documents of size 0 are not taken.
    """
    parts = _sized(docs, id_col, text_col, source_col, seed)
    sized = stored(docs.select(*(c.alias(n) for n, c in parts.items())), "mix-sized")
    targets, edge = _decide(sized, weights, cap)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in parts.items()))
    out = _copies(rows.filter("size > 0"), targets, edge, cap).filter("times > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs,
               CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM d GROUP BY source),
lev AS (SELECT *, 3 * source_size / weight AS room,
               (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                 / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM per),
tgt AS (SELECT source, source_size, docs, coalesce(weight * first_value(CASE WHEN level <= room THEN level END IGNORE NULLS) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3.0::DOUBLE * source_size) AS target FROM lev),
r AS (SELECT d.*, source_size, target, docs, floor(target / greatest(source_size, 1)) AS copies, target / greatest(source_size, 1) - floor(target / greatest(source_size, 1)) AS f
      FROM d JOIN tgt ON d.source IS NOT DISTINCT FROM tgt.source),
o AS (SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f) * sqrt(greatest(size, 1) * docs / greatest(source_size, 1))) END AS odds FROM r),
c AS (SELECT *, target - copies * source_size AS extra,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o)
SELECT doc_id, size, source_size, target,
       CAST(least(copies + CASE WHEN f > 0 AND start < extra AND 2 * (extra - start) >= size THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken
FROM c
"""
