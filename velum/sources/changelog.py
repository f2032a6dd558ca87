"""A table kept as a log of changes: a batch costs what its own rows cost, and reading merges.

A batch is written to a folder of its own and then named by a small commit file, so that one that is lost half way is
written again to the same place and counts once. Reading takes the last compacted version and the batches after it, and
the newest row of each key. Compacting writes that as a new version when the batches since the last one have as many rows
as it has, so that every row is rewritten a bounded number of times for each doubling of the table. Old versions and
batches go after that, but for the version before, which readers may still be reading.

All folders are read and written by Spark, so they may be in any store that Spark knows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velum.sources.stores import drop, there

#: Batches since the last version that are merged on every read before a new version is written, at least.
FEW_BATCHES = 4
#: A column of the stored files: the batch that a row came with.
_BATCH = "velum_from_batch"


@dataclass(frozen=True)
class Committed:
    """What the commit files say: rows by batch, and rows by version; a version holds all batches up to its number."""

    batches: dict[int, int]
    versions: dict[int, int]

    @property
    def base(self) -> int | None:
        return max(self.versions, default=None)

    def after_base(self) -> dict[int, int]:
        base = self.base
        return {n: rows for n, rows in self.batches.items() if base is None or n > base}


def committed(spark: SparkSession, path: str) -> Committed:
    """The names of the commit files, which hold all there is to know: batch-<number>-<rows> and version-<number>-<rows>."""
    files, folder = there(spark, f"{path}/commits")
    found: dict[str, dict[int, int]] = {"batch": {}, "version": {}}
    if files.exists(folder):
        for status in files.listStatus(folder):
            kind, _, rest = status.getPath().getName().partition("-")
            number, _, rows = rest.partition("-")
            if kind in found and number.isdigit() and rows.isdigit():
                found[kind][int(number)] = int(rows)
    return Committed(found["batch"], found["version"])


def _commit(spark: SparkSession, path: str, kind: str, number: int, rows: int) -> None:
    known = getattr(committed(spark, path), {"batch": "batches", "version": "versions"}[kind]).get(number)
    if known is not None and known != rows:
        _forget(spark, path, kind, number, known)
    files, name = there(spark, f"{path}/commits/{kind}-{number}-{rows}")
    files.create(name, True).close()


def _forget(spark: SparkSession, path: str, kind: str, number: int, rows: int) -> None:
    files, name = there(spark, f"{path}/commits/{kind}-{number}-{rows}")
    files.delete(name, False)


def append(batch: DataFrame, path: str, number: int) -> None:
    """Batch ``number`` of the table at ``path``; the same number again takes the place of what it was."""
    spark, folder = batch.sparkSession, f"{path}/log/{number}"
    batch.withColumn(_BATCH, F.lit(number).cast("long")).write.mode("overwrite").parquet(folder)
    _commit(spark, path, "batch", number, spark.read.parquet(folder).count())


def _merged(spark: SparkSession, path: str, key: str, modified: str, known: Committed) -> DataFrame | None:
    """The newest row of each key, with the batch that it came with; of equally new ones that of the earliest batch, then
    the largest as JSON."""
    folders = [f"{path}/log/{n}" for n in sorted(known.after_base())]
    if known.base is not None:
        folders.append(f"{path}/base/{known.base}")
    if not folders:
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(*folders)
    own = F.to_json(F.struct(*[c for c in rows.columns if c != _BATCH]))
    return rows.groupBy(F.col(key).alias("k")).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(modified), -F.col(_BATCH), own)).alias("r")).select("r.*")


def read(spark: SparkSession, path: str, key: str, modified: str) -> DataFrame | None:
    """The table as it is: the newest row of each key by ``modified``; None before the first batch. Of equally new rows
    the one that came first counts; columns that came later are null in older rows."""
    found = _merged(spark, path, key, modified, committed(spark, path))
    return None if found is None else found.drop(_BATCH)


def compact(spark: SparkSession, path: str, key: str, modified: str) -> int | None:
    """Write what reading would give as a version, named after the last batch; that number, or None if there is nothing
    to do."""
    known = committed(spark, path)
    own = known.after_base()
    if not own:
        return None
    number, folder = max(own), f"{path}/base/{max(own)}"
    _merged(spark, path, key, modified, known).write.mode("overwrite").parquet(folder)
    _commit(spark, path, "version", number, spark.read.parquet(folder).count())
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions, and the batches that the oldest of these holds."""
    known = committed(spark, path)
    kept = sorted(known.versions)[-max(1, keep) :]
    for n, rows in known.versions.items():
        if n not in kept:
            _forget(spark, path, "version", n, rows)
            drop(spark, f"{path}/base/{n}")
    for n, rows in known.batches.items():
        if kept and n <= kept[0]:
            _forget(spark, path, "batch", n, rows)
            drop(spark, f"{path}/log/{n}")


def apply(batch: DataFrame, path: str, number: int, key: str, modified: str, few: int = FEW_BATCHES) -> None:
    """Append a batch, and compact where the batches since the last version have as many rows as it has."""
    append(batch, path, number)
    spark = batch.sparkSession
    known = committed(spark, path)
    own = known.after_base()
    if len(own) >= few and sum(own.values()) >= known.versions.get(known.base, 0):
        compact(spark, path, key, modified)
        vacuum(spark, path)


def sync_batches(stream: DataFrame, path: str, checkpoint: str, key: str, modified: str, few: int = FEW_BATCHES) -> StreamingQuery:
    """A change feed applied batch by batch to the table at ``path``, the newer row of each key winning; runs through
    what is there and ends."""
    return stream.writeStream.foreachBatch(lambda batch, number: apply(batch, path, number, key, modified, few)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- folders as sources ---------------------------------------------------------------------------------------------

_ENVELOPE = "version string, lastModified long, payload string"
_CHUNKS = "store string, i int, n int, lastModified long, chunk string"


def folder_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """A folder of envelopes (JSON files, written whole by each device) as a stream: file, version, lastModified,
    payload. The source's offsets say which files have been read, so that a restart goes on after the last batch."""
    rows = spark.readStream.schema(_ENVELOPE).option("maxFilesPerTrigger", files_a_batch).json(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), "version", "lastModified", "payload").where("version is not null and lastModified is not null")


def chunk_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """A folder of chunked values as a stream of rows (store, i, n, lastModified, chunk), for ``assembled``."""
    return spark.readStream.schema(_CHUNKS).option("maxFilesPerTrigger", files_a_batch).json(path).where("store is not null and i >= 0 and i < n")


def assembled(chunks: DataFrame) -> DataFrame:
    """(store, lastModified, value) of the newest write of each store: its chunks in order, a missing one empty. Stale
    chunks, of older writes or beyond the newest one's number, don't count; repeated ones count once."""
    newest = chunks.groupBy("store").agg(F.max("lastModified").alias("newest"))
    own = chunks.join(newest, "store").where(F.col("lastModified") == F.col("newest")).groupBy("store", "lastModified", "i").agg(F.max("chunk").alias("chunk"))
    put = own.groupBy("store", "lastModified").agg(F.array_sort(F.collect_list(F.struct("i", "chunk"))).alias("c"))
    return put.select("store", "lastModified", F.array_join(F.transform("c", lambda x: x["chunk"]), "").alias("value"))


__all__ = ["Committed", "append", "apply", "assembled", "chunk_stream", "committed", "compact", "folder_stream", "read", "sync_batches", "vacuum"]
