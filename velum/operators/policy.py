"""Organisation policy: mappings that everyone gets, and compliance of profiles with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def org_rows(required: DataFrame, org_id: str) -> DataFrame:
    """Required mappings (real, substitute, category, case_sensitive) as dictionary rules, always enabled."""
    return required.select(
        F.concat(F.lit(f"org-{org_id}-"), F.col("real")).alias("id"),
        "real",
        "substitute",
        F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("org")).alias("category"),
        F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive"),
        F.lit(True).alias("enabled"),
        F.lit(True).alias("org_required"),
        F.lit(org_id).alias("org_id"),
    )


def overlay(personal: DataFrame, required: DataFrame, org_id: str) -> DataFrame:
    """The organisation's rules, then the personal ones for other real values (in any case)."""
    org = org_rows(required, org_id)
    taken = org.select(F.lower("real").alias("taken"))
    rest = personal.join(taken, F.lower(personal["real"]) == F.col("taken"), "left_anti")
    columns = ["id", "real", "substitute", "category", "case_sensitive", "enabled"]
    return org.unionByName(rest.select(*columns).withColumns({"org_required": F.lit(False), "org_id": F.lit(None).cast("string")}))


def _complete(pairs: str) -> Column:
    return F.exists(pairs, lambda p: (F.coalesce(p["real"], F.lit("")) != "") & (F.coalesce(p["substitute"], F.lit("")) != ""))


def compliance(profiles: DataFrame, categories: Sequence[str], catch_all: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """compliant, missing, configured (arrays of names) over the active profiles (of each group), from whether values
    are there, never from the values. ``domain`` is met by any active profile."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    tests = {
        "name": lambda: _complete("names"),
        "email": lambda: _complete("emails") | ~empty("catch_all_email"),
        "username": lambda: _complete("usernames"),
        "hostname": lambda: _complete("hostnames"),
        "phone": lambda: _complete("phones"),
        "domain": lambda: F.lit(True),
    }
    checks = {c: tests.get(c, lambda: F.lit(False))() for c in categories}
    if catch_all:
        checks["catch-all email"] = ~empty("catch_all_email")
    active = F.coalesce("active", F.lit(False))
    met = profiles.groupBy(*by).agg(*[F.coalesce(F.bool_or(active & F.coalesce(t, F.lit(False))), F.lit(False)).alias(f"met_{k}") for k, t in enumerate(checks.values())])
    pick = lambda want: F.filter(F.array(*[F.when(F.col(f"met_{k}") == want, F.lit(c)) for k, c in enumerate(checks)]), lambda x: x.isNotNull())
    out = met.select(*by, pick(False).alias("missing"), pick(True).alias("configured"))
    return out.select(*by, (F.size("missing") == 0).alias("compliant"), "missing", "configured")


def newer_policy(current: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered policies with id and name whose version is above the current one of the same organisation."""
    valid = offered.where((F.col("org_id") != "") & (F.col("org_name") != ""))
    now = current.select("org_id", F.col("version").alias("current_version"))
    return valid.join(now, "org_id", "left").where(F.col("version") > F.coalesce("current_version", F.lit(-1))).drop("current_version")


def invite_code(url: Column, org_id: Column) -> Column:
    return F.base64(F.encode(F.to_json(F.struct(url.alias("url"), org_id.alias("orgId"))), "UTF-8"))


def read_invite(code: Column) -> Column:
    return F.from_json(F.decode(F.unbase64(code), "UTF-8"), "url string, orgId string")


POLICY = "orgId string, orgName string, version int, requiredMappings array<struct<real:string,substitute:string,category:string,caseSensitive:boolean>>, requiredSecretPatterns array<struct<name:string,regex:string,redact:string>>, sharedIdentityRules struct<requireCatchAllEmail:boolean,requiredCategories:array<string>>, disableTamperProtection boolean"


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Policies from JSON files; those without id or name are left out."""
    rows = spark.read.schema(POLICY).json(path, multiLine=True).where((F.col("orgId") != "") & (F.col("orgName") != ""))
    return rows.select(F.col("orgId").alias("org_id"), F.col("orgName").alias("org_name"), F.coalesce("version", F.lit(0)).alias("version"), F.col("requiredMappings").alias("required_mappings"), F.col("requiredSecretPatterns").alias("required_secret_patterns"), F.col("sharedIdentityRules").alias("shared_identity_rules"))


def required_mappings(policies: DataFrame) -> DataFrame:
    """(org_id, real, substitute, category, case_sensitive), one row a required mapping."""
    rows = policies.select("org_id", F.inline("required_mappings"))
    return rows.withColumnRenamed("caseSensitive", "case_sensitive")


def required_patterns(policies: DataFrame) -> list[dict]:
    """Rows for ``secrets.custom`` of one organisation's policies."""
    rows = policies.select(F.inline("required_secret_patterns")).toLocalIterator()
    return [{"name": r["name"], "pattern": r["regex"], "redact": r["redact"]} for r in rows]
