"""What the corpus operators share: session settings, shared folders, column names, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.session import importable

#: Bytes that Spark hands to a Python worker at once, long documents apart. Bounds a worker's memory; a session setting,
#: lowered if it is larger, which changes no result.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make sure that checkpoint() has a folder. The folder named by
    ``spark.checkpoint.dir`` is used. Without one, a local master (tests) gets a folder of its own; a cluster has no
    folder that all executors share, and the operator fails."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(\d+)\s*([kmg]?)", spark.conf.get(key).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    sc = importable(spark).sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="velum-"))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder that driver and executors share."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder that is no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it an execution's shuffle files go when it ends, not when the driver's heap happens to be collected. For many
    executions, each of which ends in a checkpoint or a value."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: extra columns can't clash with what an operator adds."""
    return df.select(*[df[c].alias(k) for k, c in columns.items()])


def keep_where(df: DataFrame, verdict: Column) -> DataFrame:
    """The rows of ``df``, with its columns, for which ``verdict`` (true or false) holds. The verdict is a column of
    its own first, so that a Python function in it runs once."""
    c = fresh(df, "keep_row")
    return df.withColumn(c, verdict).where(F.col(c)).select(*[F.col(f"`{x}`") for x in df.columns])


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow array; null as ''."""
    return [x if x is not None else "" for x in column.to_pylist()]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v longs): rows (node, root), root the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al. 2014) until the edges no longer change. Every
    round is a minimum per node, combined before the shuffle, joined back to the edges; AQE splits the partition of a
    hub. Rounds end with checkpoint(), so that the loss of an executor costs one round. Only counts and sums come to
    the driver. No edges: no rows.
    """

    def star(e: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
        """Edges (v, m) of the v of N(u) that ``keep`` allows, m the least of u and N(u); and rows (u, m)."""
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return e.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")), least

    spark = edges.sparkSession
    prepare(spark)
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, "v > u")[0].where("u <> v").distinct()
        small, least = star(large, "v < u")
        small = small.unionAll(least.select("u", F.col("m").alias("v")))
        e = small.where("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components had not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
