"""The outbound pipeline: identity, dictionary, secrets, detection; over texts, JSON values, forms and pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from velum.functions import events
from velum.functions.jsontext import is_json, parts, put_together, strings
from velum.functions.names import unused
from velum.functions.regex import hits, rewrite
from velum.operators import detect, dictionary, secrets, smart
from velum.sources import documents

# Keys of JSON objects whose values are never changed, and URLs that are never touched.
SKIP_KEYS = ("model", "id", "parent_message_id", "conversation_id", "organization_id", "uuid", "token", "api_key", "key", "authorization", "cookie", "csrf", "nonce", "hash", "Content-Type", "content-type", "Accept", "accept", "User-Agent", "user-agent", "x-request-id")
SKIP_URL = r"(?i)\.(js|css|png|jpg|jpeg|gif|svg|woff2?|ttf|ico)(\?|\z)|/analytics/|/telemetry/|/log/|google-analytics|sentry"
MIN_STRING = 2

# The defaults.

@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    show_highlights: bool = True
    reveal_mode: bool = False
    secret_scanning: bool = True
    auto_detect: bool = True
    detect_proper_nouns: bool = False
    auto_redact_detected: bool = True
    auto_add_detected: bool = False
    max_log_entries: int = 200
    custom_domains: tuple = ()
    categories: tuple = ()
    browser_sync: bool = False


@dataclass(frozen=True)
class Config:
    identity: smart.Identity = field(default_factory=smart.Identity)
    mappings: tuple = ()
    settings: Settings = field(default_factory=Settings)
    secrets: tuple = secrets.SECRETS

    def configured(self) -> bool:
        """Whether there is anything to do. If not, secrets aren't redacted either."""
        i = self.identity
        return bool(self.mappings or i.emails or i.names or i.usernames or i.hostnames or i.phones or i.catch_all_email)

    def active(self) -> bool:
        return self.settings.enabled and self.configured()


def substitute_all(docs: DataFrame, config: Config, text_col: str = "text", result_col: str = "result") -> DataFrame:
    """``docs`` with struct<text, events, modified> in ``result_col``. One projection over the scan: no shuffle. Nothing
    configured, or disabled: texts pass unchanged."""
    stages = []
    if config.active():
        stages = smart.stages(config.identity) + dictionary.stages(config.mappings)
    out = events.apply(docs, text_col, stages, result_col)
    if config.active():
        if config.settings.secret_scanning and config.secrets:
            out = out.withColumn(result_col, events.after(F.col(result_col), lambda t: secrets.redact(t, config.secrets)))
        if config.settings.auto_detect and config.settings.auto_redact_detected:
            out = events.extend(out, [detect.stage(config.identity, config.settings.detect_proper_nouns)], result_col)
    r = F.col(result_col)
    return out.withColumn(result_col, F.struct(r["text"].alias("text"), r["events"].alias("events"), (F.size(r["events"]) > 0).alias("modified")))


def stage_counts(docs: DataFrame, config: Config, text_col: str = "text") -> DataFrame:
    """``docs`` with n_smart, n_explicit, n_secrets (events of each stage) and n_warnings (findings in the result, which
    are reported, not redacted)."""
    out = events.apply(docs, text_col, smart.stages(config.identity), "s1")
    out = events.apply(out.withColumn("t1", F.col("s1.text")), "t1", dictionary.stages(config.mappings), "s2")
    out = out.withColumn("s3", secrets.redact(F.col("s2.text"), config.secrets))
    out = out.withColumn("s4", detect.findings(F.col("s3.text"), config.identity))
    n = lambda c: F.size(c).cast("long")
    return out.withColumns({"n_smart": n("s1.events"), "n_explicit": n("s2.events"), "n_secrets": n("s3.events"), "n_warnings": n("s4")}).drop("s1", "t1", "s2", "s3", "s4")


def skipped_url(url: Column) -> Column:
    """Static files, analytics, telemetry and logs."""
    return F.coalesce(url.rlike(SKIP_URL), F.lit(False))


def intercepted(method: Column, url: Column, body: Column) -> Column:
    return F.upper(F.coalesce(method, F.lit("GET"))).isin("POST", "PUT", "PATCH") & body.isNotNull() & (body != "") & ~skipped_url(url)


def substitute_form(form: DataFrame, config: Config, key: str) -> DataFrame:
    """Rows of forms (``key``, field, filename, mime, value, content) after the pipeline, and whether each changed: text
    fields of two characters or more are rewritten in ``value``, files in ``content`` by their kind, with the name that
    they have then. Other fields and files pass unchanged."""
    fields = form.where("filename is null")
    fields = substitute_all(fields, config, "value", "form_result")
    long = F.length("value") >= MIN_STRING
    fields = fields.select(key, "field", "filename", "mime", F.when(long, F.col("form_result.text")).otherwise(F.col("value")).alias("value"), "content", (F.coalesce(long, F.lit(False)) & F.col("form_result.modified")).alias("changed"))
    files = form.where("filename is not null").withColumn("path", F.to_json(F.struct(key, "field", "filename")))
    change = lambda d: d.withColumn("new_text", F.col("r.text")).drop("r")
    plain = lambda d: change(substitute_all(d, config, "text", "r"))
    xml = lambda d: substitute_markup(d, config, "text", "new_text")
    done = documents.rewrite(files.select("path", "content", documents.kind(F.col("filename"), F.col("mime")).alias("kind")), plain, xml)
    done = done.select("path", F.col("content").alias("new_content"), F.col("filename").alias("new_name"), (F.col("status") == "rewritten").alias("changed"))
    renamed = F.when(F.col("changed") & F.lower("filename").endswith(".pdf"), F.regexp_replace("filename", r"(?i)\.pdf\z", ".txt")).otherwise(F.col("filename"))
    files = files.join(done, "path").select(key, "field", renamed.alias("filename"), "mime", "value", F.col("new_content").alias("content"), "changed")
    return fields.unionByName(files)


# --- JSON -----------------------------------------------------------------------------------------------------------


def walk(column: Column, kind: DataType, change: Callable[[Column], Column], key: str | None = None) -> Column:
    """The column with ``change`` applied to every string of two characters or more at any depth of its known type;
    keys of the skip list keep their values."""
    if key in SKIP_KEYS:
        return column
    if isinstance(kind, StringType):
        return F.when(F.length(column) >= MIN_STRING, change(column)).otherwise(column)
    if isinstance(kind, StructType):
        fields = [walk(column[f.name], f.dataType, change, f.name).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: walk(x, kind.elementType, change))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        return F.transform_values(column, lambda k, v: F.when(k.isin(*SKIP_KEYS), v).otherwise(walk(v, kind.valueType, change)))
    return column


def _substitute_each(d: DataFrame, config: Config, states_col: str) -> DataFrame:
    """The pipeline on every element of an array of states."""
    if not config.active():
        return d
    d = events.extend_each(d, smart.stages(config.identity) + dictionary.stages(config.mappings), states_col)
    if config.settings.secret_scanning and config.secrets:
        redact = lambda t: secrets.redact(t, config.secrets)
        d = d.withColumn(states_col, F.transform(states_col, lambda s: events.after(s, redact)))
    if config.settings.auto_detect and config.settings.auto_redact_detected:
        d = events.extend_each(d, [detect.stage(config.identity, config.settings.detect_proper_nouns)], states_col)
    return d


def substitute_bodies(docs: DataFrame, config: Config, body_col: str, result_col: str = "body_out") -> DataFrame:
    """``docs`` with their bodies rewritten: JSON of any shape by its strings, other text of over two characters whole.

    All in the JVM, in one projection: a JSON's strings pass through the pipeline as an array column and go back in
    place. Values under keys of the skip list stay, at any depth. A changed JSON has no white space outside its strings;
    its numbers and other strings keep their spelling. A JSON that is a string itself stays, as do bodies without any
    replacement, nulls among them."""
    kept, as_json, taken, states = unused((*docs.columns, result_col), "kept_body", "is_json", "parts_of_body", "states_of_body")
    b = F.col(kept)
    d = docs.withColumn(kept, F.col(body_col)).withColumn(as_json, is_json(b))
    d = d.withColumn(taken, F.when(F.col(as_json), parts(b, SKIP_KEYS)))
    found = F.when(F.col(as_json), strings(F.col(taken))).when(F.length(b) > MIN_STRING, F.array(b)).otherwise(F.array().cast("array<string>"))
    long_ = lambda t: F.when(F.length(t) >= MIN_STRING, t).otherwise(F.lit(""))
    d = d.withColumn(states, F.transform(found, lambda t: events.state(long_(t))))
    d = _substitute_each(d, config, states)
    changed = F.exists(states, lambda s: F.size(s["events"]) > 0)
    new = F.transform(states, lambda s: F.when(F.size(s["events"]) > 0, s["text"]))
    out = F.when(~changed, b).when(F.col(as_json), put_together(F.col(taken), new)).otherwise(F.col(states)[0]["text"])
    return d.withColumn(result_col, out).drop(kept, as_json, taken, states)


# --- markup ---------------------------------------------------------------------------------------------------------


_RUN = ">[^<]+<"
_inner = lambda m: F.substr(m, F.lit(2), F.length(m) - 2)
_counts = lambda m: F.length(F.regexp_replace(_inner(m), r"^\s+|\s+\z", "")) >= MIN_STRING


def rewrite_markup(markup: Column, change: Callable[[Column], Column]) -> Column:
    """Each run of text between tags, of two characters or more besides white space, changed on its own."""
    new = lambda m: F.when(_counts(m), F.concat(F.lit(">"), change(_inner(m)), F.lit("<"))).otherwise(m)
    return rewrite(markup, _RUN, new)


def substitute_markup(docs: DataFrame, config: Config, markup_col: str, result_col: str) -> DataFrame:
    """``docs`` with their markup after the pipeline in ``result_col``: the same runs, as an array column."""
    d = docs.withColumn("runs_of_markup", hits(F.col(markup_col), _RUN))
    d = d.withColumn("states_of_markup", F.transform("runs_of_markup", lambda m: events.state(F.when(_counts(m), _inner(m)).otherwise(F.lit("")))))
    d = _substitute_each(d, config, "states_of_markup")
    new = F.zip_with("runs_of_markup", "states_of_markup", lambda m, s: F.when(s["text"] != "", F.concat(F.lit(">"), s["text"], F.lit("<"))).otherwise(m))
    between = F.split(markup_col, _RUN, -1)
    parts = F.zip_with(F.slice(between, F.lit(1), F.size("runs_of_markup")), new, lambda g, m: F.concat(g, m))
    return d.withColumn(result_col, F.concat(F.array_join(parts, ""), F.element_at(between, -1))).drop("runs_of_markup", "states_of_markup")


__all__ = ["Config", "Settings", "intercepted", "rewrite_markup", "skipped_url", "stage_counts", "substitute_all", "substitute_bodies", "walk"]
