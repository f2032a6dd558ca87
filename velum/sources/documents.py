"""Uploaded files: what kind they are, the text in them, and rewriting it in place.

Plain text is decoded by Spark. PDF, DOCX and XLSX need Python for their containers; their texts are then changed as
columns, like any other, and packed again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.names import unused
from velum.session import small_batches
from velum.sources.containers import MOST_INFLATED, Skipped, entries, pdf_text, repacked

# Extensions of text files.
TEXT = ("txt", "csv", "tsv", "json", "md", "markdown", "log", "yaml", "yml", "toml", "ini", "cfg", "conf", "xml", "html", "htm", "css", "js", "ts", "py", "rb", "go", "rs", "java", "c", "cpp", "h", "hpp", "sh", "bash", "zsh", "ps1", "bat", "sql", "r", "swift", "kt", "scala", "pl", "php", "lua", "vim", "env", "gitignore")
PREVIEW_EVENTS = 20
_PARTS = re.compile(r"word/(document|header\d*|footer\d*|comments|endnotes|footnotes)\.xml|xl/sharedStrings\.xml|xl/worksheets/sheet\d+\.xml")


def kind(path: Column, mime: Column | None = None) -> Column:
    """pdf, docx, xlsx, text or unknown; by the extension, else by the MIME type."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    mime = F.coalesce(mime if mime is not None else F.lit(""), F.lit(""))
    return (
        F.when(ext.isin("pdf", "docx", "xlsx"), ext)
        .when(ext.isin(*TEXT), "text")
        .when(mime.contains("pdf"), "pdf")
        .when(mime.contains("wordprocessingml"), "docx")
        .when(mime.contains("spreadsheetml"), "xlsx")
        .when(mime.startswith("text/") | mime.contains("json") | mime.contains("xml"), "text")
        .otherwise("unknown")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and kind of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", kind(F.col("path")).alias("kind"))


def read_parts(files: DataFrame, limit: int = MOST_INFLATED) -> DataFrame:
    """``files`` (path, kind, content, ...) with struct<parts: array<struct<part, text>>, reason> in ``read`` for PDF, DOCX
    and XLSX files; the reason says why there are no parts, and is null if there are. No file fails the job, and none is
    inflated to more than ``limit`` bytes."""

    @F.pandas_udf(f"struct<parts:{_PARTS_KIND},reason:string>")
    def find(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = [_parts_of(k, c, limit) for k, c in zip(kinds, contents, strict=True)]
        return pd.DataFrame({"parts": [p for p, _ in rows], "reason": [r for _, r in rows]})

    small_batches(files.sparkSession)
    (read,) = unused(files, "read")
    return files.withColumn(read, find("kind", "content"))


_PARTS_KIND = "array<struct<part:string,text:string>>"


def _parts_of(kind_: str, content: bytes | None, limit: int) -> tuple[list[dict], str | None]:
    if content is None:
        return [], "no content"
    try:
        if kind_ == "pdf":
            text = pdf_text(content, limit)
            return ([{"part": "", "text": text}], None) if text else ([], "no text")
        parts = entries(content, _PARTS.fullmatch, limit)
        return [{"part": n, "text": x} for n, x in parts], None if parts else "no text"
    except Skipped as e:
        return [], str(e)


def _texts(files: DataFrame, limit: int) -> DataFrame:
    """(path, kind, part, text, reason): a row a part, or one with the reason why there is none."""
    plain = files.where("kind = 'text' and content is not null").select("path", "kind", F.lit("").alias("part"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("reason"))
    packed = read_parts(files.where("kind in ('pdf', 'docx', 'xlsx')").select("path", "kind", "content"), limit)
    packed = packed.select("path", "kind", F.expr("inline_outer(read.parts)"), "read.reason")
    unknown = files.where("kind is null or kind not in ('pdf', 'docx', 'xlsx', 'text') or kind = 'text' and content is null")
    none = unknown.select("path", "kind", F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("text"), F.when(F.col("kind") == "text", "no content").otherwise("unknown type").alias("reason"))
    return plain.unionByName(packed).unionByName(none)


def extract(files: DataFrame, limit: int = MOST_INFLATED) -> DataFrame:
    """(path, kind, part, text): the whole of a text file or PDF, or each part of an office file. Unknown kinds and
    files without text, or whose text can't be had, have no row; ``skipped`` says why."""
    return _texts(files, limit).where("text is not null").select("path", "kind", "part", "text")


def skipped(files: DataFrame, limit: int = MOST_INFLATED) -> DataFrame:
    """(path, kind, reason) of the files that have no text to change: unknown type, no content, no text, not a container,
    encrypted entry, unknown compression, doubled name, damaged entry, too large when inflated."""
    return _texts(files, limit).where("reason is not null").select("path", "kind", "reason")


def rewrite(files: DataFrame, change: Callable[[DataFrame], DataFrame], rewrite_xml: Callable[[DataFrame], DataFrame], limit: int = MOST_INFLATED) -> DataFrame:
    """(path, filename, content, status, reason): files with their texts changed. ``change`` and ``rewrite_xml`` take
    (path, kind, part, text) and add new_text. A PDF becomes a text file; files that stay the same, and with a reason
    those that have no text to change, are passed through. Rows that repeat a path are taken to be the same file."""
    read = _texts(files, limit)
    found = read.where("text is not null").select("path", "kind", "part", "text")
    plain = change(found.where("kind in ('text', 'pdf')"))
    office = rewrite_xml(found.where("kind in ('docx', 'xlsx')"))
    new = plain.unionByName(office).where("new_text <> text").groupBy("path", "part").agg(F.max("new_text").alias("new_text"))
    new = new.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("part", "new_text"))).alias("parts"))

    @F.pandas_udf("binary")
    def pack(kinds: pd.Series, contents: pd.Series, parts: pd.Series) -> pd.Series:
        def one(k: str, c: bytes, p: object) -> bytes:
            if p is None:
                return c
            p = dict(p)
            return p[""].encode() if k in ("text", "pdf") else repacked(c, p)

        return pd.Series([one(k, c, p) for k, c, p in zip(kinds, contents, parts, strict=True)], dtype=object)

    joined = files.join(new, "path", "left")
    told = read.groupBy("path").agg(F.max("reason").alias("reason"))
    name = F.element_at(F.split("path", "/"), -1)
    status = F.when(F.col("parts").isNotNull(), "rewritten").when(F.col("reason").isNull(), "unchanged").otherwise("skipped")
    filename = F.when((F.col("kind") == "pdf") & F.col("parts").isNotNull(), F.concat(F.regexp_replace(name, r"(?i)\.pdf\z", ""), F.lit(".txt"))).otherwise(name)
    return joined.join(told, "path", "left").select("path", filename.alias("filename"), pack("kind", "content", "parts").alias("content"), status.alias("status"), F.when(F.col("parts").isNull(), F.col("reason")).alias("reason"))


def preview(result: Column, text: Column, top: int = PREVIEW_EVENTS) -> Column:
    """What a change to a file would be: lengths before and after, the number of replacements and the first of them."""
    return F.struct(F.length(text).alias("length_before"), F.length(result["text"]).alias("length_after"), F.size(result["events"]).alias("n_replacements"), F.slice(result["events"], 1, top).alias("first_replacements"))
