"""Streams: rewriting messages, revealing answers, counting per tab, and quiet periods.

Everything but the session dictionary works on batches too; the dictionary on batches is ``velum.operators.asof``. The dictionary and the counters keep state by key and need
the RocksDB state store.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from velum.plans import outbound

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def rewrite_messages(messages: DataFrame, config: outbound.Config, text_col: str = "text") -> DataFrame:
    """Stateless: struct<text, events, modified> in ``result``."""
    return outbound.substitute_all(messages, config, text_col, "result")


def settled(rows: DataFrame, key: str, ts: str, gap: str, ordinal: str) -> DataFrame:
    """The last row before each quiet period of ``gap``: (key, began, ended, last columns). On streams give ``rows`` a
    watermark first."""
    values = [c for c in rows.columns if c not in (key, ts)]
    w = F.session_window(ts, gap)
    out = rows.groupBy(key, w.alias("w")).agg(F.max_by(F.struct(*values), F.struct(F.col(ts), F.col(ordinal))).alias("last"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n", "last.*")


def tumbling(rows: DataFrame, keys: list[str], ts: str, width: str, lateness: str | None = None) -> DataFrame:
    """Counts by window, an extension that the request stream doesn't have by itself."""
    rows = rows.withWatermark(ts, lateness) if lateness else rows
    return rows.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("began"), "n")


class _TabCounter(StatefulProcessor):
    """Replacements since the last navigation of a tab."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        n = self.total.get()[0] if self.total.exists() else 0
        part = pd.concat([p[["seq", "is_nav", "amount"]] for p in rows])  # a key's rows may come in several chunks
        resets = part.loc[part["is_nav"], "seq"]
        if len(resets):
            n, part = 0, part[part["seq"] > resets.max()]
        n += int(part["amount"].sum())
        self.total.update((n,))
        yield pd.DataFrame({"tab": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def tab_counters(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stream (tab, seq, is_nav, amount) to updates (tab, n). The count of a tab that is still for ``ttl_ms`` is
    forgotten."""
    return rows.groupBy("tab").transformWithStateInPandas(_TabCounter(ttl_ms), "tab string, n long", "Update", "ProcessingTime" if ttl_ms else "None")


class _Dictionary(StatefulProcessor):
    """What a session has emitted, by the substitute in lower case; later messages are turned back by it."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.emitted = handle.getMapState("emitted", "source string", "target string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        known = {k[0]: v[0] for k, v in self.emitted.iterator()} if self.emitted.exists() else {}
        pairs = None
        # a key's rows may come in several chunks: order holds over all of them
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if r.kind == "emitted":
                if r.source and r.target:
                    known[r.source.lower()], pairs = r.target, None
                    self.emitted.updateValue((r.source.lower(),), (r.target,))
                continue
            text = r.text or ""
            pairs = pairs if pairs is not None else sorted(known.items(), key=lambda p: (-len(p[0]), p[0]))
            for source, target in pairs:
                text = re.sub(re.escape(source), lambda m, t=target: t, text, flags=re.I)
            out.append((key[0], r.seq, text))
        yield pd.DataFrame(out, columns=["session", "seq", "text"])

    def close(self) -> None:
        pass


def reveal_stream(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stream (session, seq, kind, source, target, text): rows of kind ``emitted`` fill the session's dictionary, others
    are messages, which come out as (session, seq, text) turned back by what was emitted before. What was emitted more
    than ``ttl_ms`` ago is forgotten. A session's rows in one micro-batch are held together in its task."""
    return rows.groupBy("session").transformWithStateInPandas(_Dictionary(ttl_ms), "session string, seq long, text string", "Append", "ProcessingTime" if ttl_ms else "None")
