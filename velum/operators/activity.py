"""Activity: logs, counters per tab, devices, and classes of clients and states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.ranges import running


def log_rows(messages: DataFrame, result_col: str, columns: Sequence[str]) -> DataFrame:
    """One row a replacement event: ``columns``, direction, original, replaced, category, pattern."""
    return messages.select(*columns, F.lit("outbound").alias("direction"), F.inline(F.col(f"{result_col}.events")))


def recent(log: DataFrame, n: int, ts: str = "ts", ident: str = "id") -> DataFrame:
    """The newest n rows, a top-k."""
    return log.orderBy(F.desc(ts), F.desc(ident)).limit(n)


def badge_counts(log: DataFrame, tab: str, ts: str, ident: str, is_nav: Column, amount: Column) -> DataFrame:
    """(tab, epoch, n): replacements of each tab since its last navigation; an epoch begins with each navigation. Epochs
    are running totals over ranges of the log's order, so that a busy tab is many tasks' work."""
    rows = log.select(tab, ts, ident, is_nav.cast("int").alias("is_nav"), F.when(is_nav, F.lit(0)).otherwise(amount).alias("amount"))
    epochs = running(rows, [tab], [ts, ident], {"epoch": (F.sum, F.col("is_nav"))})
    return epochs.groupBy(tab, "epoch").agg(F.sum("amount").cast("long").alias("n"))


def browser(user_agent: Column) -> Column:
    """Firefox, Chrome, Safari or Edge, in this order: an Edge that names Chrome is Chrome."""
    out = F.lit("Unknown")
    for name in ("Edge", "Safari", "Chrome", "Firefox"):
        out = F.when(user_agent.contains(name), name).otherwise(out)
    return out


def device_name(user_agent: Column, platform: Column) -> Column:
    return F.concat(browser(user_agent), F.lit(" on "), F.coalesce(platform, F.lit("Unknown")))


def recent_devices(devices: DataFrame, last_sync: str = "last_sync") -> DataFrame:
    return devices.orderBy(F.coalesce(last_sync, F.lit(0)).desc())


def app_state(enabled: Column, configured: Column, reveal: Column) -> Column:
    return F.when(~enabled, "disabled").when(~configured, "unconfigured").when(reveal, "reveal").otherwise("active")


def shown(value: Column, category: Column, width: int = 30) -> Column:
    """For display: passwords as dots, longer values cut."""
    return F.when(category == "password", F.lit("•" * 8)).when(F.length(value) > width, F.concat(F.left(value, F.lit(width - 3)), F.lit("..."))).otherwise(value)


def escaped(value: Column) -> Column:
    """For HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def normal_domain(domain: Column) -> Column:
    """With a scheme and without a final slash."""
    d = F.trim(domain)
    return F.regexp_replace(F.when(d.rlike("^[a-z]+://"), d).otherwise(F.concat(F.lit("https://"), d)), r"/+\z", "")


def add_domains(known: DataFrame, new: DataFrame) -> DataFrame:
    """Normal forms of both, each once."""
    return known.unionByName(new).select(normal_domain(F.col("domain")).alias("domain")).distinct()
