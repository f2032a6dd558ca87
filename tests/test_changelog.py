import json
import random

import pytest
from pyspark.sql import functions as F

from velum.sources import changelog as log

KIND = "id string, v string, m int"


def newest(batches):
    """By plain loops: the newest row of each key, the first of equally new ones."""
    out = {}
    for rows in batches:
        best = {}
        for r in rows:
            if r[0] not in best or (r[2], json.dumps(r[1])) > (best[r[0]][2], json.dumps(best[r[0]][1])):
                best[r[0]] = r
        for k, r in best.items():
            if k not in out or r[2] > out[k][2]:
                out[k] = r
    return sorted(out.values(), key=str)


def rows_of(spark, path):
    return sorted((tuple(r) for r in log.read(spark, path, "id", "m").collect()), key=str)


def some(rng, n):
    return [(rng.choice([*"abcdef", None]), rng.choice("xyz"), rng.randrange(6)) for _ in range(n)]


def test_batches_merge_on_read(spark, tmp_path):
    rng, path, batches = random.Random(1), f"file://{tmp_path}/t", []
    assert log.read(spark, path, "id", "m") is None and log.compact(spark, path, "id", "m") is None
    for number in range(9):
        batches.append(some(rng, rng.randrange(1, 9)))
        log.apply(spark.createDataFrame(batches[-1], KIND), path, number, "id", "m", few=3)
        assert rows_of(spark, path) == newest(batches)
    known = log.committed(spark, path)
    assert known.versions and len(known.after_base()) < 9 and len(known.versions) <= 2
    log.compact(spark, path, "id", "m")
    log.vacuum(spark, path, keep=1)
    assert rows_of(spark, path) == newest(batches) and log.committed(spark, path).batches == {}


def test_a_lost_batch_is_run_again(spark, tmp_path):
    path, first, second = f"file://{tmp_path}/t", [("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "2", 2)]
    log.append(spark.createDataFrame(first, KIND), path, 0)
    # written, but lost before its commit: it isn't there
    spark.createDataFrame(second, KIND).withColumn("velum_from_batch", F.lit(1).cast("long")).write.parquet(f"{path}/log/1")
    assert rows_of(spark, path) == newest([first])
    for _ in range(2):  # and lost after it
        log.apply(spark.createDataFrame(second, KIND), path, 1, "id", "m", few=1)
        assert rows_of(spark, path) == newest([first, second])
    log.append(spark.createDataFrame(second[:1], KIND), path, 2)
    log.append(spark.createDataFrame([], KIND), path, 2)
    assert rows_of(spark, path) == newest([first, second]) and log.committed(spark, path).batches.get(2) == 0


def test_a_batch_costs_its_own_rows(spark, tmp_path):
    """No file of earlier batches is written again until as many rows have come as there are."""
    path = f"{tmp_path}/t"
    log.apply(spark.range(20_000).selectExpr("string(id) as id", "'v' as v", "1 as m"), f"file://{path}", 0, "id", "m", few=1)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "base").rglob("*.parquet")}
    for number in range(1, 7):
        log.apply(spark.createDataFrame([("1", f"n{number}", number + 1)], KIND), f"file://{path}", number, "id", "m", few=2)
    assert before and {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "base").rglob("*.parquet")} == before
    got = log.read(spark, f"file://{path}", "id", "m")
    assert got.count() == 20_000 and got.where("id = '1'").first().v == "n6"


def test_new_columns(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    log.append(spark.createDataFrame([("a", "1", 1)], KIND), path, 0)
    log.append(spark.createDataFrame([("b", "1", 1, True)], KIND + ", w boolean"), path, 1)
    assert sorted(map(tuple, log.read(spark, path, "id", "m").collect())) == [("a", "1", 1, None), ("b", "1", 1, True)]


def test_a_stream_that_restarts(spark, tmp_path):
    path, feed, batches = f"file://{tmp_path}/t", tmp_path / "feed", []
    rng = random.Random(6)
    for k in range(5):
        batches.append(some(rng, 6))
        spark.createDataFrame(batches[-1], KIND).coalesce(1).write.parquet(f"{feed}/{k}")
        stream = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").parquet(str(feed))
        log.sync_batches(stream, path, f"{tmp_path}/c", "id", "m", few=2).awaitTermination(120)
        assert rows_of(spark, path) == newest(batches)
    assert len(log.committed(spark, path).versions) >= 1


def test_a_job_that_fails_and_goes_on(spark, tmp_path, monkeypatch):
    path, feed = f"file://{tmp_path}/t", tmp_path / "feed"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 4)], KIND).coalesce(1).write.parquet(f"{feed}/0")
    stream = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").parquet(str(feed))

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(log, "_commit", broken)
    with pytest.raises(Exception, match="lost"):
        log.sync_batches(stream, path, f"{tmp_path}/c", "id", "m").awaitTermination(120)
    monkeypatch.undo()
    assert log.read(spark, path, "id", "m") is None
    log.sync_batches(stream, path, f"{tmp_path}/c", "id", "m").awaitTermination(120)
    assert rows_of(spark, path) == [("a", "1", 1), ("b", "1", 4)]


def test_folders_as_streams(spark, tmp_path):
    folder = tmp_path / "devices"
    folder.mkdir()
    write = lambda name, *rows: (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    write("a.json", {"version": "1", "lastModified": 5, "payload": "old"})
    write("b.json", {"version": "1", "lastModified": 7, "payload": "new"}, {"lastModified": 9, "payload": "no version"})

    def drain():
        stream = log.folder_stream(spark, str(folder)).selectExpr("version as id", "payload as v", "lastModified as m")
        log.sync_batches(stream, f"file://{tmp_path}/t", f"{tmp_path}/c", "id", "m").awaitTermination(120)
        return [r.v for r in log.read(spark, f"file://{tmp_path}/t", "id", "m").collect()]

    assert drain() == ["new"]
    write("c.json", {"version": "1", "lastModified": 8, "payload": "newer"})
    assert drain() == ["newer"] and log.committed(spark, f"file://{tmp_path}/t").batches.keys() == {0, 1}


def test_chunks_from_a_stream(spark, tmp_path):
    folder = tmp_path / "chunks"
    folder.mkdir()
    rows = [("s", 1, 3, 9, "b"), ("s", 0, 3, 9, "a"), ("s", 2, 5, 4, "stale"), ("s", 0, 3, 9, "a"), ("t", 0, 1, 1, ""), ("u", 7, 3, 1, "beyond"), (None, 0, 1, 1, "x")]
    (folder / "a.json").write_text("\n".join(json.dumps(dict(zip(("store", "i", "n", "lastModified", "chunk"), r, strict=True))) for r in rows))
    query = log.chunk_stream(spark, str(folder)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, log.assembled(spark.read.parquet(f"{tmp_path}/out")).collect())) == [("s", 9, "ab"), ("t", 1, "")]
