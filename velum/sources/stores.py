"""Stores and codecs for configuration: sync codes, chunked values, backups, and encrypted key-value tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import crypto
from velum.operators.reconcile import prune

CHUNK = 5000


def sync_code(version: Column, last_modified: Column, payload: Column) -> Column:
    """A payload as text to carry around: base64 of its JSON."""
    return F.base64(F.encode(F.to_json(F.struct(version.alias("version"), last_modified.alias("lastModified"), payload.alias("payload"))), "UTF-8"))


def read_sync_code(code: Column) -> Column:
    """struct<version, lastModified, payload>; null where version or time is missing."""
    s = F.from_json(F.make_valid_utf8(F.try_to_binary(code, F.lit("base64")).cast("string")), "version string, lastModified long, payload string")
    return F.when(s["version"].isNotNull() & s["lastModified"].isNotNull(), s)


def to_chunks(df: DataFrame, key: str, value: str, size: int = CHUNK) -> DataFrame:
    """(key, i, n, chunk): values in chunks of ``size`` characters. Empty values have one empty chunk."""
    n = F.greatest(F.ceil(F.length(value) / size).cast("int"), F.lit(1))
    return df.where(F.col(value).isNotNull()).select(key, value, n.alias("n")).select(key, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "n", value).select(key, "i", "n", F.substr(value, F.col("i") * size + 1, F.lit(size)).alias("chunk"))


def from_chunks(chunks: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, value): chunks put together in order; a missing one counts as empty, one at or after n is stale."""
    own = chunks.where("i < n").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "chunk"))).alias("c"))
    return own.select(key, F.array_join(F.transform("c", lambda x: x["chunk"]), "").alias(value))


def backup(spark: SparkSession, tables: dict[str, DataFrame], path: str, key: bytes | None = None) -> None:
    """Write tables as JSON lines (name, row), each row encrypted if there is a key."""
    rows = None
    for name, df in tables.items():
        row = F.to_json(F.struct(*df.columns))
        own = df.select(F.lit(name).alias("name"), (crypto.encrypt(row, key) if key else row).alias("row"), F.lit(key is not None).alias("encrypted"))
        rows = own if rows is None else rows.unionByName(own)
    rows.write.mode("errorifexists").json(path)


def restore(spark: SparkSession, path: str, name: str, schema: str, key: bytes | None = None) -> DataFrame:
    """One table of a backup. Rows that the key doesn't open are null and left out."""
    rows = spark.read.schema("name string, row string, encrypted boolean").json(path).where(F.col("name") == name)
    opened = crypto.decrypt(F.col("row"), key) if key else F.lit(None).cast("string")
    return rows.select(F.from_json(F.when(F.col("encrypted"), opened).otherwise(F.col("row")), schema).alias("r")).where("r is not null").select("r.*")


def write_secure(df: DataFrame, path: str, key: bytes | None) -> None:
    """A table (name, value) with its values encrypted. Without a key nothing is written: it fails closed."""
    if not key:
        raise ValueError("a key is needed to write secure values")
    df.select("name", crypto.encrypt(F.col("value"), key).alias("value"), F.lit(True).alias("encrypted")).write.mode("overwrite").parquet(path)


def read_secure(spark: SparkSession, path: str, key: bytes | None) -> DataFrame:
    """The table (name, value); values are null without the right key. Values still in plain text are read as they are."""
    rows = spark.read.parquet(path)
    opened = crypto.decrypt(F.col("value"), key) if key else F.lit(None).cast("string")
    return rows.select("name", F.when(F.col("encrypted"), opened).otherwise(F.col("value")).alias("value"))


def rekey(rows: DataFrame, old: bytes, new: bytes) -> DataFrame:
    """Values under a new key, those in plain text included. Values that the old key doesn't open stay."""
    plain = F.when(F.col("encrypted"), crypto.decrypt(F.col("value"), old)).otherwise(F.col("value"))
    return rows.withColumn("value", F.coalesce(crypto.encrypt(plain, new), F.col("value"))).withColumn("encrypted", F.lit(True))


MAPPING = "id string, real string, substitute string, category string, case_sensitive boolean, enabled boolean, created_at timestamp"


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Exported dictionary rules (JSON lines or arrays), with what is missing filled in: a new id, the time, enabled."""
    rows = spark.read.schema(MAPPING).json(path, multiLine=True).where("real is not null")
    filled = {"id": F.coalesce("id", F.uuid()), "category": F.coalesce("category", F.lit("general")), "case_sensitive": F.coalesce("case_sensitive", F.lit(False)), "enabled": F.coalesce("enabled", F.lit(True)), "created_at": F.coalesce("created_at", F.current_timestamp())}
    return rows.withColumns(filled)


def pull_if_newer(spark: SparkSession, path: str, last_modified: int) -> DataFrame:
    """The payloads (version, lastModified, payload) of a folder or file that are newer than what is here. The test of
    time is pushed into the scan."""
    rows = spark.read.schema("version string, lastModified long, payload string").json(path)
    return rows.where(F.col("version").isNotNull() & (F.col("lastModified") > last_modified))


def sync_decision(here: Column, there: Column, pushed: Column) -> tuple[Column, Column]:
    """pull and push of a cycle, by the times of change here and there and of the last push: what is newer there is
    pulled first, and pushed back unless that was the state at the last push."""
    pull = F.coalesce(there > here, F.lit(False))
    now = F.when(pull, there).otherwise(here)
    return pull.alias("pull"), (pushed.isNull() | (now > pushed)).alias("push")


def save_snapshot(tables: dict[str, DataFrame], path: str, at: int, source: str, keep: int = 10) -> int:
    """Save tables as a snapshot of the folder ``path`` at a time in milliseconds; older ones beyond ``keep`` are deleted
    (under 1 keeps all). The result is its id."""
    spark = next(iter(tables.values())).sparkSession
    known = snapshots(spark, path)
    ident = (known.agg(F.max("id")).first()[0] or 0) + 1 if known is not None else 1
    rows = [df.select(F.lit(name).alias("name"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in tables.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    every.write.parquet(f"{path}/data/id={ident}")
    spark.createDataFrame([(ident, at, source)], "id long, ts long, source string").coalesce(1).write.parquet(f"{path}/log/id={ident}")
    if keep >= 1:
        every = snapshots(spark, path)
        for old in every.join(prune(every, keep).select("id"), "id", "left_anti").collect():
            delete_snapshot(spark, path, old.id)
    return ident


def snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, ts, source) of what is saved, the newest first; None if there is nothing."""
    if not exists(spark, f"{path}/log"):
        return None
    return spark.read.schema("ts long, source string, id long").parquet(f"{path}/log").select("id", "ts", "source").orderBy(F.desc("ts"), F.desc("id"))


def read_snapshot(spark: SparkSession, path: str, ident: int, name: str, schema: str) -> DataFrame:
    """One table of a snapshot."""
    rows = spark.read.parquet(f"{path}/data/id={ident}").where(F.col("name") == name)
    return rows.select(F.from_json("row", schema).alias("r")).select("r.*")


def roll_back(spark: SparkSession, path: str, ident: int, schemas: dict[str, str], at: int) -> dict[str, DataFrame]:
    """The tables of a snapshot, which are saved as the newest one with the source ``rollback``."""
    tables = {name: read_snapshot(spark, path, ident, name, schema) for name, schema in schemas.items()}
    save_snapshot(tables, path, at, "rollback", 0)
    return tables


def delete_snapshot(spark: SparkSession, path: str, ident: int) -> None:
    for part in ("log", "data"):
        drop(spark, f"{path}/{part}/id={ident}")


def clear_snapshots(spark: SparkSession, path: str) -> None:
    for part in ("log", "data"):
        drop(spark, f"{path}/{part}")


def there(spark: SparkSession, uri: str) -> tuple:
    """The file system that a URI is in, and its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    files, path = there(spark, uri)
    return files.exists(path) and len(files.listStatus(path)) > 0


def drop(spark: SparkSession, uri: str) -> None:
    files, path = there(spark, uri)
    files.delete(path, True)


def config_changes(changes: DataFrame) -> DataFrame:
    """What a change feed of stored values (seq, key, value: JSON) tells: the newest value of each key that isn't
    encrypted; a key whose newest value is encrypted is locked and tells nothing."""
    newest = changes.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    sealed = F.coalesce(F.get_json_object("value", "$.encrypted") == "true", F.lit(False))
    return newest.where(~sealed & F.col("value").isNotNull())


def seal(payload: Column, key: bytes, version: Column, last_modified: Column) -> Column:
    """An encrypted payload with its version and time in the open: JSON."""
    return F.to_json(F.struct(F.lit(True).alias("encrypted"), crypto.encrypt(payload, key).alias("payload"), version.alias("version"), last_modified.alias("lastModified")))


def unseal(envelope: Column, key: bytes | None) -> Column:
    """struct<state, payload, version, lastModified>. States: plain, open, locked (no key), wrong key, damaged."""
    e = F.from_json(envelope, "encrypted boolean, payload string, version string, lastModified long")
    opened = crypto.decrypt(e["payload"], key) if key else F.lit(None).cast("string")
    sealed = F.coalesce(e["encrypted"], F.lit(False))
    state = F.when(e["payload"].isNull(), "damaged").when(~sealed, "plain").when(F.lit(key is None), "locked").when(opened.isNull(), "wrong key").otherwise("open")
    return F.struct(state.alias("state"), F.when(sealed, opened).otherwise(e["payload"]).alias("payload"), e["version"].alias("version"), e["lastModified"].alias("lastModified"))
