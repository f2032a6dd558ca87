"""Bulk import of dictionaries: mapping tables, value lists, password and address exports.

Lines come as (line_no, line). A header is one line and is read by the driver; everything else stays distributed. The
first of equal values counts, by the line it stands on.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velum.functions.ranges import ranks

# Words that mark a header of a mapping table, and hosts that say nothing about a person.
HEADER_WORDS = ("real", "substitute", "fake", "original", "replacement", "from", "to", "value", "category", "type")
COMMON_HOSTS = ("google.com", "facebook.com", "twitter.com", "x.com", "amazon.com", "apple.com", "microsoft.com", "github.com", "youtube.com", "reddit.com", "netflix.com", "linkedin.com", "instagram.com", "wikipedia.org", "stackoverflow.com", "accounts.google.com", "login.microsoftonline.com")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, without blank lines at their ends. Files are read by splits: a line's number
    is its place in its split and the number of lines in the splits before, of which only counts are shuffled."""
    read = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    rows = read.withColumn("n", F.row_number().over(Window.partitionBy("path", "split").orderBy("at")))
    filled = F.col("line").rlike(r"\S")
    splits = rows.groupBy("path", "split").agg(F.count("*").alias("lines"), F.min(F.when(filled, F.col("n"))).alias("first"), F.max(F.when(filled, F.col("n"))).alias("last"))
    ahead = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("lines").over(ahead), F.lit(0)))
    ends = splits.groupBy("path").agg(F.min(F.col("before") + F.col("first")).alias("top"), F.max(F.col("before") + F.col("last")).alias("bottom"))
    placed = rows.join(splits.select("path", "split", "before"), ["path", "split"]).withColumn("n", F.col("before") + F.col("n")).join(ends, "path")
    line = F.when(F.col("n") == F.col("top"), F.regexp_replace("line", r"^\s+", "")).otherwise(F.col("line"))
    line = F.when(F.col("n") == F.col("bottom"), F.regexp_replace(line, r"\s+\z", "")).otherwise(line)
    return placed.where(F.col("n").between(F.col("top"), F.col("bottom"))).select("path", (F.col("n") - F.col("top")).cast("int").alias("line_no"), line.alias("line"))


def detect_format(filename: Column, first_line: Column, has_separator: Column) -> Column:
    """password, bitwarden, autofill, mapping or list: by the file's name, else by its header, else by separators."""
    name, head = F.lower(filename), F.lower(first_line)
    return (
        F.when(name.contains("password") | name.contains("logins"), "password")
        .when(name.contains("bitwarden"), "bitwarden")
        .when(name.contains("autofill") | name.contains("address"), "autofill")
        .when(head.contains("username") | head.contains("password") | head.contains("login"), "password")
        .when(head.contains("bitwarden") | head.contains("folder,favorite"), "bitwarden")
        .when(has_separator, "mapping")
        .otherwise("list")
    )


def formats(lines: DataFrame) -> DataFrame:
    """(path, format) of files read by ``read_lines``."""
    by_file = lines.groupBy("path").agg(F.min_by("line", "line_no").alias("first"), F.bool_or(F.col("line").rlike("[,\t]")).alias("separated"))
    return by_file.select("path", detect_format(F.element_at(F.split("path", "/"), -1), F.col("first"), F.col("separated")).alias("format"))


def guess_category(value: Column) -> Column:
    """email, phone, ssn, address, name or general; the first rule that fits. A single capitalised word of 3 to 20
    characters is general, and a number in the form of an SSN is taken for a phone number."""
    street = r"(?i)[0-9]{1,5}\s+[A-Za-z0-9_]+\s+(st|street|ave|avenue|blvd|dr|drive|rd|road|ln|lane)"
    return (
        F.when(value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"), "email")
        .when(value.rlike(r"^[\d\s()+.-]{7,}\z"), "phone")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}\z"), "ssn")
        .when(value.rlike(street), "address")
        .when(value.rlike(r"(?i)^[a-z][a-z0-9._-]*\z") & F.length(value).between(3, 20), "general")
        .when(value.rlike(r"^[A-Z][a-z]+(\s[A-Z][a-z]+)*\z"), "name")
        .otherwise("general")
    )


def cells(line: Column, n: int, sep: str = ",") -> Column:
    """The first ``n`` cells of a line as a struct c0, c1, …; doubled quotes within quotes are one."""
    schema = ", ".join(f"c{k} string" for k in range(n))
    return F.from_csv(line, F.lit(schema), {"sep": sep, "quote": '"', "escape": '"', "maxColumns": str(max(1 << 16, 2 * n))})


def _cell(k: int) -> Column:
    return F.trim(F.coalesce(F.col(f"c.c{k}"), F.lit("")))


def _header(lines: DataFrame) -> tuple[str, list[str]]:
    first = lines.where("line_no = 0").first()
    if first is None:
        return "", []
    return first["line"], [x.strip().lower() for x in next(csv.reader([first["line"]]), [])]


def _index(headers: list[str], test: Callable[[str], bool]) -> int:
    return next((k for k, h in enumerate(headers) if h and test(h)), -1)


def mapping_rows(lines: DataFrame) -> DataFrame:
    """(real, substitute, category, needs_mapping) of a table with the columns real, substitute and maybe category."""
    head, _ = _header(lines)
    sep = "\t" if "\t" in head else ","
    low = lambda k: F.lower(_cell(k))
    is_header = (F.col("line_no") == 0) & (low(0).isin(*HEADER_WORDS) | low(1).isin(*HEADER_WORDS))
    rows = lines.where(F.col("line").contains(sep)).select("line_no", cells(F.col("line"), 3, sep).alias("c")).where(~is_header & (_cell(0) != ""))
    category = F.when(low(2) != "", low(2)).otherwise(guess_category(_cell(0)))
    return rows.select(_cell(0).alias("real"), _cell(1).alias("substitute"), category.alias("category"), (_cell(1) == "").alias("needs_mapping"))


def value_rows(lines: DataFrame) -> DataFrame:
    """(kind, real, category) of a list: emails, phones and names go to the identity, the rest to the mappings."""
    v = lines.select(F.trim("line").alias("real")).where(F.length("real") >= 2).withColumn("category", guess_category(F.col("real")))
    kind = F.when(F.col("category") == "email", "emails").when(F.col("category") == "phone", "phones").when(F.col("category") == "name", "names").otherwise("mappings")
    return v.select(kind.alias("kind"), "real", "category")


def _first_lines(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("line_no").alias("line_no"))


def _accounts(rows: DataFrame, user: int, password: int, url: int) -> DataFrame:
    """(kind, real, substitute, category, case_sensitive, line_no) of rows of cells."""
    nothing = rows.select("line_no", F.lit("").alias("real")).where("false")
    column = lambda k: nothing if k < 0 else rows.select("line_no", _cell(k).alias("real")).where("real <> ''")
    users = column(user).withColumn("kind", F.when(F.col("real").contains("@"), "emails").when(F.length("real") >= 3, "usernames")).where("kind is not null")
    users = _first_lines(users, "kind", "real").select("kind", "real", F.lit("").alias("substitute"), F.lit(None).cast("string").alias("category"), F.lit(False).alias("case_sensitive"), "line_no")
    secret = ranks(_first_lines(column(password).where("length(real) >= 4"), "real"), "line_no", "real", name="number")
    secret = secret.select(F.lit("mappings").alias("kind"), "real", F.concat(F.lit("[REDACTED-PASSWORD-"), F.col("number").cast("string"), F.lit("]")).alias("substitute"), F.lit("password").alias("category"), F.lit(True).alias("case_sensitive"), "line_no")
    hosts = column(url).select("line_no", host(F.col("real")).alias("real")).where(F.col("real").isNotNull() & ~F.col("real").isin(*COMMON_HOSTS))
    hosts = _first_lines(hosts, "real").select(F.lit("mappings").alias("kind"), "real", F.lit("").alias("substitute"), F.lit("domain").alias("category"), F.lit(False).alias("case_sensitive"), "line_no")
    return users.unionByName(secret).unionByName(hosts)


def host(url: Column) -> Column:
    """The host of a URL in lower case; null if it isn't one."""
    h = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(h != "", h)


def _rows(lines: DataFrame, headers: list[str]) -> DataFrame:
    return lines.where("line_no > 0").select("line_no", cells(F.col("line"), max(1, len(headers))).alias("c"))


def password_rows(lines: DataFrame) -> DataFrame:
    """What a browser's or 1Password's export of accounts holds."""
    _, h = _header(lines)
    user = _index(h, lambda x: x in ("username", "login_username", "user"))
    password = _index(h, lambda x: x in ("password", "login_password"))
    url = _index(h, lambda x: x in ("url", "login_uri", "origin", "web site"))
    return _accounts(_rows(lines, h), user, password, url)


def bitwarden_rows(lines: DataFrame) -> DataFrame:
    _, h = _header(lines)
    return _accounts(_rows(lines, h), _index(h, lambda x: "username" in x), _index(h, lambda x: "password" in x), _index(h, lambda x: "uri" in x or "url" in x))


# Header synonyms of address exports.
AUTOFILL = {
    "name": ("name", "full name", "first name", "last name", "given name", "family name"),
    "email": ("email", "e-mail", "email address"),
    "phone": ("phone", "phone number", "tel", "telephone"),
    "address": ("address", "street", "address line 1", "street address"),
}


def autofill_rows(lines: DataFrame) -> DataFrame:
    """(kind, real, type, line_no): first and last names (a full name is split at its first space), emails, phones and
    addresses, each value of a kind once. Without a column of first names, last names of their own count too."""
    _, h = _header(lines)
    rows = _rows(lines, h)
    find = {k: _index(h, lambda x, t=t: any(s in x for s in t)) for k, t in AUTOFILL.items()}
    first = _index(h, lambda x: x in ("first name", "given name"))
    last = _index(h, lambda x: x in ("last name", "family name"))
    out = []

    def take(k: int, kind: str, name_type: str | None) -> None:
        if k >= 0:
            seen = _first_lines(rows.select("line_no", _cell(k).alias("real")).where("real <> ''"), "real")
            out.append(seen.select(F.lit(kind).alias("kind"), "real", F.lit(name_type).cast("string").alias("type"), "line_no"))

    take(first, "names", "first")
    take(last, "names", "last")
    if find["name"] >= 0 and first < 0:
        seen = _first_lines(rows.select("line_no", _cell(find["name"]).alias("real")).where("real <> ''"), "real").withColumn("w", F.split("real", r"\s+"))
        parts = F.when(F.size("w") >= 2, F.array(F.struct(F.col("w")[0].alias("real"), F.lit("first").alias("type")), F.struct(F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " ").alias("real"), F.lit("last").alias("type")))).otherwise(F.array(F.struct(F.col("real").alias("real"), F.lit("first").alias("type"))))
        out.append(seen.select(parts.alias("p"), "line_no").select(F.lit("names").alias("kind"), F.inline("p"), "line_no").select("kind", "real", "type", "line_no"))
    take(find["email"], "emails", None)
    take(find["phone"], "phones", None)
    take(find["address"], "mappings", None)
    if not out:
        return lines.select(F.lit("").alias("kind"), F.lit("").alias("real"), F.lit(None).cast("string").alias("type"), "line_no").where("false")
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def summary(rows: DataFrame) -> DataFrame:
    """(kind, n, n_without_substitute) of imported rows."""
    s = F.coalesce("substitute", F.lit("")) if "substitute" in rows.columns else F.lit("")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(s == "").alias("n_without_substitute"))


def apply_to_mappings(mappings: DataFrame, imported: DataFrame, columns: Sequence[str] = ("real", "substitute", "category", "case_sensitive")) -> DataFrame:
    """The dictionary with the imported mappings added, enabled, their case kept."""
    new = imported.where("kind = 'mappings'").select(*columns).withColumn("enabled", F.lit(True))
    return mappings.select(*columns, "enabled").unionByName(new)
