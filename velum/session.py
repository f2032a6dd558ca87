"""Session helpers that every operator with Python workers needs."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package also where its folder isn't on their path already."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def checkpoints(spark: SparkSession) -> SparkSession:
    """Make sure that checkpoint() has a folder: the one named by ``spark.checkpoint.dir``. Without one a local master
    (tests) gets a folder of its own; a cluster has none that all executors share, and this fails."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="velum-"))
    return spark


#: Bytes of files that Spark hands to a Python worker at once, larger files apart.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> SparkSession:
    """Bound the Arrow batches of files or texts; a session setting, lowered if it is larger, which changes no result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(\d+)\s*([kmg]?)", spark.conf.get(key).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > most:
        spark.conf.set(key, str(most))
    return spark
