"""Shared helpers: reading tables, scratch tables in the shared folder, ASCII lower-casing, fold hashes."""

from __future__ import annotations

import atexit
import contextlib
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of the contracts: a run of anything but the six ASCII white-space characters.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one table of ``sf_dir``; a column is looked up by its exact name, so extra columns never clash."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(df[f"`{c}`"] for c in columns)) if columns else df


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where that setting is absent, a single machine (tests) gets a temporary folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lipika-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/lipika/{label}-{uuid.uuid4().hex}"
    (_open[-1] if _open else _kept).append(path)
    return path


#: A job's shuffle files go when it ends; for jobs whose plan is not run again.
CLEAN_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Scratch paths of the operator calls that are under way, innermost last; and those that results still read.
_open: list[list[str]] = []
_kept: list[str] = []


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for a block of code."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts the lineage and survives a lost executor.

    The job's shuffle files go with the job's end, for nothing reads them once the table is written.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    with settings(spark, CLEAN_SHUFFLES):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def paths_read(df: DataFrame) -> list[str]:
    """The folders and files that a DataFrame's plan reads."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation":
            relation = leaves.apply(i).relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                roots = relation.location().rootPaths()
                found += [roots.apply(j).toString() for j in range(roots.size())]
    return found


def tidied(operator):
    """For a function that returns a DataFrame: of the scratch tables it made, those that the result does not read go.

    What the result reads stays until the caller's own ``tidied`` or ``settled`` call ends, or the program does.
    """

    @wraps(operator)
    def run(*args, **kw):
        _open.append([])
        try:
            out = operator(*args, **kw)
        except BaseException:
            (_open[-1] if _open else _kept).extend(_open.pop())
            raise
        made = _open.pop()
        read = [_bare(p) + "/" for p in paths_read(out)]
        for path in made:
            if any(p.startswith(_bare(path) + "/") for p in read):
                (_open[-1] if _open else _kept).append(path)
            else:
                remove(out.sparkSession, path)
        return out

    return run


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Store what ``make`` returns and delete every scratch table made for it."""
    _open.append([])
    try:
        out = stored(make(), label)
    finally:
        made = _open.pop()
    keep = made.pop()
    for path in made:
        remove(out.sparkSession, path)
    (_open[-1] if _open else _kept).append(keep)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the scratch tables that these read and nothing reads any more."""
    for df in tables:
        for path in map(_bare, paths_read(df)):
            for made in (*_open, _kept):
                for mine in [m for m in made if _bare(m) == path]:
                    made.remove(mine)
                    remove(df.sparkSession, mine)


def _bare(path: str) -> str:
    """A path without the ways to write its scheme."""
    return re.sub("^file:/*", "/", path)


@atexit.register
def _clear() -> None:
    """Delete the tables that results still read when the program ends; without a session there is no way to."""
    spark = SparkSession.getActiveSession()
    if spark:
        with contextlib.suppress(Exception):
            for path in _kept:
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bucket_count(df: DataFrame) -> int:
    """Buckets to deal packed rows of ``df`` into: by its size in bytes as the planner knows it, some for each shuffle partition at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 50 else min(max(least, size >> 24), 1 << 30)


def dealt(mine: DataFrame, theirs: DataFrame, keys: list[str], row: list[str], n: int, m: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with a part and a block: each pair of rows of equal keys is in one (keys, part, block).

    There are about ``n`` rows of the first and ``m`` of the second table in each, whatever the number of rows of a key.
    Rows are dealt by their columns ``row``; rows whose key the other table lacks go.
    """
    count = lambda df, k, name: df.groupBy(keys).agg(F.ceil(F.count("*") / k).cast("int").alias(name))
    deal = count(mine, n, "_parts").join(count(theirs, m, "_blocks"), keys)
    own = lambda k: F.pmod(F.xxhash64(*row), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    a = mine.join(deal, keys).withColumn("part", own("_parts")).withColumn("block", every("_blocks"))
    b = theirs.join(deal, keys).withColumn("block", own("_blocks")).withColumn("part", every("_parts"))
    return a.drop("_parts", "_blocks"), b.drop("_parts", "_blocks")


def in_blocks(mine: DataFrame, theirs: DataFrame, keys: list[str], row: list[str], n: int, m: int) -> DataFrame:
    """The dealt rows of both tables, which have the same columns, told apart by ``mine``."""
    a, b = dealt(mine, theirs, keys, row, n, m)
    names = [*mine.columns, "part", "block", "mine"]
    return a.withColumn("mine", F.lit(True)).select(names).unionByName(b.withColumn("mine", F.lit(False)).select(names))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in; other text maps just the 26 letters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def share(spark: SparkSession, value):
    """Broadcast an object of this package by value; call the result on an executor to get it, made once per worker."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(made=[]):  # noqa: B006
        if not made:
            made.append(pickle.loads(sent.value))
        return made[0]

    return get


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()
