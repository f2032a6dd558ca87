"""Queries over configuration: dictionaries and profiles edited, merged and resolved, imports, files, keys and states.

As in ``record_queries``, rows are derived from the tables by expressions that both engines read.
"""

from __future__ import annotations

import io
import warnings
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import crypto, structure
from velum.operators import activity, policy, reconcile, smart
from velum.operators.dictionary import Mapping
from velum.plans import outbound
from velum.plans.catalog import register, table
from velum.sources import documents, importer, stores

# --- editing --------------------------------------------------------------------------------------------------------


@register("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN 'new' ELSE c_name END AS v FROM customer WHERE c_custkey % 5 <> 2
    UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 4 = 3 AND c_custkey > 0""")
def mapping_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows changed and added, then some removed."""
    c = table(spark, sf_dir, "customer")
    rows = c.selectExpr("c_custkey as id", "c_name as v")
    changes = c.where("c_custkey % 4 = 1").selectExpr("c_custkey as id", "'new' as v").unionByName(c.where("c_custkey % 4 = 3 and c_custkey > 0").selectExpr("-c_custkey as id", "'new' as v"))
    return reconcile.remove(reconcile.upsert(rows, changes, "id"), c.where("c_custkey % 5 = 2").selectExpr("c_custkey as id"), "id")


@register("SELECT DISTINCT 'https://site' || (c_custkey % 90) || '.example' AS domain FROM customer UNION SELECT DISTINCT 'http://n' || c_nationkey FROM customer")
def domains_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    known = c.selectExpr("concat(' site', c_custkey % 90, '.example/', if(c_custkey % 2 = 0, '/', '')) as domain")
    return activity.add_domains(known, c.selectExpr("concat('http://n', c_nationkey) as domain"))


@register("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS shown FROM pages""")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", activity.escaped(F.col("html")).alias("shown"))


@register("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'disabled' WHEN event_id % 3 = 0 THEN 'unconfigured' WHEN value > 50 THEN 'reveal' ELSE 'active' END AS state FROM events")
def app_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", activity.app_state(F.col("event_id") % 5 != 0, F.col("event_id") % 3 != 0, F.col("value") > 50).alias("state"))


@register(r"""SELECT page_id FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'post' WHEN 1 THEN 'PUT' WHEN 2 THEN NULL ELSE 'Patch' END AS method, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'b' END AS body FROM pages)
    WHERE method IS NOT NULL AND body <> '' AND NOT regexp_matches(url, '(?i)\.(js|css|png|jpg|jpeg|gif|svg|woff2?|ttf|ico)(\?|$)|/analytics/|/telemetry/|/log/|google-analytics|sentry')""")
def requests_intercepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").selectExpr("page_id", "url", "case page_id % 4 when 0 then 'post' when 1 then 'PUT' when 2 then null else 'Patch' end as method", "if(page_id % 7 = 0, '', 'b') as body")
    return p.where(outbound.intercepted(F.col("method"), F.col("url"), F.col("body"))).select("page_id")


@register("SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text || ' Subst eve any@x', 'subst', 'the', 'gi'), 'eve', 'Ann', 'gi'), 'any@x', '[catch-all]', 'gi') AS shown FROM conversations")
def reveal_by_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = smart.Identity(names=(("Ann", "eve", "first"),), catch_all_email="any@x")
    shown = smart.reveal(F.concat("text", F.lit(" Subst eve any@x")), [Mapping("the", "subst")], identity)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", shown.alias("shown"))


# --- merging --------------------------------------------------------------------------------------------------------

def _profiles(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Profiles of a side: 0 the ancestor, 1 local, 2 remote."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as n", "cast(s_suppkey as string) as id")
    changed = lambda every: f"{k} > 0 and n % {every + k} = 0"
    there = {0: "n % 10 <> 7", 1: "n % 10 <> 8", 2: "n % 10 <> 9"}[k]
    phones = {0: "true", 1: "n % 2 <> 0", 2: "if(n % 3 = 0, cast(null as boolean), true)"}[k]
    return s.where(there).selectExpr("id", f"if({changed(1)}, concat('name', {k}), 'name') as name", f"array('a', if({changed(2)}, 'x{k}', 'b')) as emails", f"named_struct('names', not ({changed(3)}), 'phones', {phones}) as enabled")


_SIDES_SQL = """s AS (SELECT s_suppkey AS n, s_suppkey % 10 <> 7 AS ia, s_suppkey % 10 <> 8 AS il, s_suppkey % 10 <> 9 AS ir,
        CASE WHEN s_suppkey % 2 = 0 THEN 'name1' ELSE 'name' END AS ln, CASE WHEN s_suppkey % 3 = 0 THEN 'name2' ELSE 'name' END AS rn,
        CASE WHEN s_suppkey % 3 = 0 THEN 'x1' ELSE 'b' END AS le, CASE WHEN s_suppkey % 4 = 0 THEN 'x2' ELSE 'b' END AS re,
        s_suppkey % 4 <> 0 AS lf, s_suppkey % 5 <> 0 AS rf, s_suppkey % 2 <> 0 AS lp, CASE WHEN s_suppkey % 3 <> 0 THEN TRUE END AS rp FROM supplier),
    j AS (SELECT *, '{"id":"' || n || '","name":"name","emails":["a","b"],"enabled":{"names":true,"phones":true}}' AS aj,
        '{"id":"' || n || '","name":"' || ln || '","emails":["a","' || le || '"],"enabled":{"names":' || lf || ',"phones":' || lp || '}}' AS lj,
        '{"id":"' || n || '","name":"' || rn || '","emails":["a","' || re || '"],"enabled":{"names":' || rf || coalesce(',"phones":' || rp, '') || '}}' AS rj FROM s)"""
_PROFILE_CONFLICTS_SQL = """SELECT n || '.name' AS id, 'identity.profiles[' || n || '].name' AS path, '"' || ln || '"' AS local_value, '"' || rn || '"' AS remote_value, '"name"' AS ancestor_value FROM j WHERE ia AND il AND ir AND n % 6 = 0
    UNION ALL SELECT n || '.emails', 'identity.profiles[' || n || '].emails', '["a","x1"]', '["a","x2"]', '["a","b"]' FROM j WHERE ia AND il AND ir AND n % 12 = 0
    UNION ALL SELECT n || '.enabled.phones', 'identity.profiles[' || n || '].enabled.phones', 'false', NULL, 'true' FROM j WHERE ia AND il AND ir AND n % 6 = 0
    UNION ALL SELECT n::VARCHAR, 'identity.profiles[' || n || ']', CASE WHEN il THEN lj END, CASE WHEN ir THEN rj END, CASE WHEN ia THEN aj END FROM j WHERE (NOT ia AND lj <> rj) OR (NOT il AND aj <> rj) OR (NOT ir AND aj <> lj)"""


@register(f"WITH {_SIDES_SQL} {_PROFILE_CONFLICTS_SQL}")
def profile_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conflicts: of fields, of lists, of flags, and of whole profiles that one side deleted or that are new twice."""
    return reconcile.merge_profiles(*(_profiles(spark, sf_dir, k) for k in range(3)))[1]


def _configuration(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as n")
    changed = {0: "false", 1: "n % 2 = 0", 2: "n % 3 = 0"}[k]
    mappings = n.selectExpr("cast(n as string) as id", f"if({changed}, concat('m{k}-', n), 'm') as real")
    settings = n.selectExpr("concat('k', n) as key", f"if({changed}, '{k}', '0') as value")
    return mappings, settings, _profiles(spark, sf_dir, k)


@register(f"""WITH {_SIDES_SQL} SELECT 0 AS part, 'mappings[' || n_nationkey || ']' AS path, '{{"real":"m1-' || n_nationkey || '"}}' AS local_value, '{{"real":"m2-' || n_nationkey || '"}}' AS remote_value FROM nation WHERE n_nationkey % 6 = 0
    UNION ALL SELECT 1, 'settings.k' || n_nationkey, '1', '2' FROM nation WHERE n_nationkey % 6 = 0
    UNION ALL SELECT 2, path, local_value, remote_value FROM ({_PROFILE_CONFLICTS_SQL})""")
def configuration_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of all parts."""
    _, found = reconcile.merge_data(*(_configuration(spark, sf_dir, k) for k in range(3)))
    return found.select("part", "path", "local_value", "remote_value")


@register(f"""WITH {_SIDES_SQL} SELECT 'mappings' AS part, n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey % 6 = 0 THEN 'm2-' || n_nationkey WHEN n_nationkey % 2 = 0 THEN 'm1-' || n_nationkey WHEN n_nationkey % 3 = 0 THEN 'm2-' || n_nationkey ELSE 'm' END AS value FROM nation
    UNION ALL SELECT 'settings', 'k' || n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN '2' WHEN n_nationkey % 2 = 0 THEN '1' WHEN n_nationkey % 3 = 0 THEN '2' ELSE '0' END FROM nation
    UNION ALL SELECT 'identity', n::VARCHAR, concat_ws('/', CASE WHEN rn <> 'name' THEN rn ELSE ln END, CASE WHEN re <> 'b' THEN re ELSE le END, lf AND rf, CASE WHEN rp IS NULL THEN 'none' ELSE lp::VARCHAR END) FROM s WHERE ia AND il AND ir
    UNION ALL SELECT 'identity', n::VARCHAR, concat_ws('/', rn, re, rf, CASE WHEN rp IS NULL THEN 'none' ELSE rp::VARCHAR END) FROM j WHERE NOT ia OR (NOT il AND aj <> rj)""")
def configuration_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conflict settled for the remote value, whatever part it is in; profiles that remote deleted go."""
    parts, found = reconcile.merge_data(*(_configuration(spark, sf_dir, k) for k in range(3)))
    choice = found.select("path", F.when(F.col("part") == 0, F.concat(F.lit('{"id":"'), "id", F.lit('",'), F.substr("remote_value", F.lit(2)))).otherwise(F.col("remote_value")).alias("value"))
    done = reconcile.resolve_data(parts, choice)
    mappings = done["mappings"].selectExpr("'mappings' as part", "id", "real as value")
    settings = done["settings"].selectExpr("'settings' as part", "key as id", "value")
    profiles = done["identity"].selectExpr("'identity' as part", "id", "concat_ws('/', name, emails[1], string(enabled.names), coalesce(string(enabled.phones), 'none')) as value")
    return mappings.unionByName(settings).unionByName(profiles)


def _nested(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Customers of a side, with a map of maps and a JSON text. Each side spells them in its own order; local changes every
    third, remote every fourth in the depth."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_nationkey as n")
    there = {0: "id % 7 <> 0", 1: "id % 5 <> 0", 2: "id % 11 <> 0"}[k]
    v = {0: "n", 1: "if(id % 3 = 0, n + 100, n)", 2: "if(id % 4 = 0, n + 200, n)"}[k]
    maps = {0: f"map('p', map('x', {v}, 'y', 1), 'q', map('z', 2))", 1: f"map('q', map('z', 2), 'p', map('y', 1, 'x', {v}))", 2: f"map('q', map('z', 2), 'p', map('x', {v}, 'y', 1))"}[k]
    text = {0: f"""concat('{{"d": {{"w":[', {v}, ', 1.50], "u": null}}, "t": "\\u00e9"}}')""", 1: f"""concat('{{"t":"é","d":{{"u":null,"w":[', {v}, '.0,1.5]}}}}')""", 2: f"""concat('{{"d":{{"w":[', {v}, 'e0,15e-1],"u":null}},"t":"é"}}')"""}[k]
    return c.where(there).selectExpr("id", f"{maps} as m", f"{text} as j")


_NESTED_SQL = """c AS (SELECT c_custkey AS id, c_custkey % 7 <> 0 AS ia, c_custkey % 5 <> 0 AS il, c_custkey % 11 <> 0 AS ir, c_nationkey AS a,
        CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS l, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 200 ELSE c_nationkey END AS r FROM customer)"""


@register(f"""WITH {_NESTED_SQL} SELECT id, v AS depth_two, v::DOUBLE AS in_json FROM (SELECT id, CASE WHEN NOT ia THEN CASE WHEN il THEN l WHEN ir THEN r END WHEN NOT il AND NOT ir THEN NULL
    WHEN NOT il THEN CASE WHEN a <> r THEN r END WHEN NOT ir THEN CASE WHEN a <> l THEN l END WHEN a = l THEN r ELSE l END AS v FROM c) WHERE v IS NOT NULL""")
def structural_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with maps in maps and JSON texts merged: what is only spelled differently is unchanged, and goes if the other
    side deleted it."""
    m = reconcile.merge(*(_nested(spark, sf_dir, k) for k in range(3)), ["id"], json=["j"])
    return m.selectExpr("id", "m['p']['x'] as depth_two", "double(get_json_object(j, '$.d.w[0]')) as in_json")


@register(f"""WITH {_NESTED_SQL} SELECT id::VARCHAR AS id, 'rows[' || id || ']' AS path, CASE WHEN il THEN l END AS local_x, CASE WHEN ir THEN r END AS remote_x, CASE WHEN ia THEN a END AS ancestor_x
    FROM c WHERE (il AND ir AND l <> r AND (NOT ia OR (a <> l AND a <> r))) OR (ia AND il AND NOT ir AND a <> l) OR (ia AND ir AND NOT il AND a <> r)""")
def structural_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.conflicts(*(_nested(spark, sf_dir, k) for k in range(3)), ["id"], "rows", ["j"])
    x = lambda c: F.get_json_object(f"{c}_value", "$.m.p.x").cast("int").alias(f"{c}_x")
    return found.select("id", "path", x("local"), x("remote"), x("ancestor"))


@register(f"""WITH {_NESTED_SQL} SELECT id AS key, (CASE WHEN NOT ia THEN l WHEN a = l THEN r ELSE l END)::DOUBLE AS value, (NOT ia OR (a <> l AND a <> r)) AND l <> r AND NOT (NOT ia AND l = r) AS conflict FROM c WHERE il AND ir AND id % 7 <> 0""")
def structural_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings whose values are JSON objects: equal whatever the order of keys, the spaces and the spelling of numbers."""
    side = lambda k: _nested(spark, sf_dir, k).where("id % 5 <> 0 and id % 11 <> 0 and id % 7 <> 0").selectExpr("string(id) as key", "j as value")
    m = reconcile.merge_settings(*(side(k) for k in range(3)))
    return m.select(F.col("key").cast("long").alias("key"), F.get_json_object("value", "$.d.w[0]").cast("double").alias("value"), "conflict")


@register(f"""WITH {_NESTED_SQL} SELECT a AS x, count(*) AS n FROM (SELECT a FROM c WHERE ia UNION ALL SELECT l FROM c WHERE il UNION ALL SELECT r FROM c WHERE ir) GROUP BY a""")
def structural_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all sides grouped by the forms of their maps and JSON texts."""
    rows = _nested(spark, sf_dir, 0).unionByName(_nested(spark, sf_dir, 1)).unionByName(_nested(spark, sf_dir, 2))
    kind = rows.schema["m"].dataType
    grouped = rows.groupBy(structure.form(F.col("m"), kind).alias("m"), structure.json_form(F.col("j")).alias("j")).agg(F.count("*").alias("n"))
    return grouped.select(F.get_json_object("j", "$.d.w[0]").cast("int").alias("x"), "n")


# --- imports and files ----------------------------------------------------------------------------------------------


@register("""WITH a AS (SELECT c_custkey AS n, 'user' || (c_custkey % 40) || '@mail.example' AS who, 'pw' || (c_custkey % 25) AS pw FROM customer)
    SELECT 'emails' AS kind, count(DISTINCT who) AS n, count(DISTINCT who) AS n_without_substitute FROM a UNION ALL SELECT 'mappings', count(DISTINCT pw) FILTER (WHERE length(pw) >= 4), 0 FROM a""")
def import_bitwarden_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of 60 columns, of which the last two count."""
    blank = ",".join("x" for _ in range(58))
    lines = table(spark, sf_dir, "customer").selectExpr("c_custkey + 1 as line_no", f"concat('{blank}', ',user', c_custkey % 40, '@mail.example,pw', c_custkey % 25) as line")
    head = ",".join(f"c{k}" for k in range(58)) + ",login_username,login_password"
    lines = spark.createDataFrame([(0, head)], "line_no long, line string").unionByName(lines)
    return importer.summary(importer.bitwarden_rows(lines))


@register("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'password' WHEN 1 THEN 'bitwarden' WHEN 2 THEN 'mapping' ELSE 'list' END AS format FROM nation""")
def import_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "concat('/x/', case n_nationkey % 4 when 0 then 'Logins' when 1 then 'bitwarden' else 'f' end, '-', n_nationkey, '.csv') as path", "explode(array(0, 1)) as line_no")
    lines = n.withColumn("line", F.expr("case when n_nationkey % 4 = 2 and line_no = 1 then 'a,b' else string(n_nationkey) end"))
    return importer.formats(lines).select(F.regexp_extract("path", r"-(\d+)", 1).cast("int").alias("n_nationkey"), "format")


@register("""SELECT s_suppkey, 'pdf' AS kind, s_name || chr(10) || '(' || s_suppkey || ')' AS text FROM supplier UNION ALL SELECT s_suppkey, 'text', 'plain ' || s_name FROM supplier""")
def files_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files, and PDFs whose streams show a name and, with escapes, a number."""
    s = table(spark, sf_dir, "supplier")
    pdf = F.concat(F.lit("%PDF\nstream\nBT ("), "s_name", F.lit(") Tj (\\050"), F.col("s_suppkey").cast("string"), F.lit("\\)) ' ET\nendstream"))
    files = s.select(F.concat(F.lit("/f/"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("path"), pdf.cast("binary").alias("content"))
    files = files.unionByName(s.select(F.concat(F.lit("/f/"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("plain "), "s_name").cast("binary").alias("content")))
    found = documents.extract(files.withColumn("kind", documents.kind(F.col("path"))))
    return found.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("s_suppkey"), "kind", "text")


def _office_file(variant: int, name: str) -> bytes:
    """A document that says a name, in one of the ways in which such files come."""
    if variant == 5:
        return b"no container"
    out = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        warnings.simplefilter("ignore")
        part = "other.xml" if variant == 6 else "word/document.xml"
        z.writestr(part, f"<w:t>acme {name}</w:t>" + "<w:p/>" * (5000 if variant == 4 else 0))
        z.writestr(part if variant == 3 else "media.bin", b"acme")
    data = bytearray(out.getvalue())
    for mark, flags in ((b"PK\1\2", 8), (b"PK\3\4", 6)):
        at = data.find(mark)
        data[at + flags] |= variant == 1
        if variant == 2:
            data[at + flags + 2] = 97
    return bytes(data)


@register("""SELECT s_suppkey, CASE WHEN k = 0 THEN 'rewritten' WHEN k = 7 THEN 'unchanged' ELSE 'skipped' END AS status, CASE WHEN k = 0 THEN '<w:t>zeta ' || s_name || '</w:t>' END AS text,
    CASE k WHEN 1 THEN 'encrypted entry' WHEN 2 THEN 'unknown compression' WHEN 3 THEN 'doubled name' WHEN 4 THEN 'too large when inflated' WHEN 5 THEN 'not a container' WHEN 6 THEN 'no text' END AS reason FROM (SELECT *, s_suppkey % 8 AS k FROM supplier)""")
def files_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office files of all kinds: rewritten, unchanged, or skipped with a reason; what was rewritten is read again."""

    @F.pandas_udf("binary")
    def made(variants: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_office_file(v, n) for v, n in zip(variants, names, strict=True)], dtype=object)

    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name", "s_suppkey % 8 as k")
    files = s.select(F.concat(F.lit("/f/"), F.col("s_suppkey").cast("string"), F.lit(".docx")).alias("path"), made(F.col("k"), F.when(F.col("k") == 7, "none").otherwise(F.col("s_name"))).alias("content")).withColumn("kind", F.lit("docx"))
    new = lambda d: d.withColumn("new_text", F.when(F.col("text").contains(" none<"), F.col("text")).otherwise(F.replace("text", F.lit("acme"), F.lit("zeta"))))
    done = documents.rewrite(files, new, new, limit=4096)
    again = documents.extract(done.where("status = 'rewritten'").withColumn("kind", F.lit("docx"))).select("path", "text")
    return done.join(again, "path", "left").select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("s_suppkey"), "status", "text", "reason")


@register("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'file' ELSE 'field' END AS kind, CASE WHEN s_suppkey % 3 = 2 THEN 'x' ELSE 'see <T> ' || s_name END AS value, s_suppkey % 3 <> 2 AS changed FROM supplier")
def form_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of text files and of text fields."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("see the "), "s_name").alias("t"))
    form = s.select("s_suppkey", F.lit("f").alias("field"), F.when(F.col("s_suppkey") % 3 == 0, "a.txt").alias("filename"), F.lit(None).cast("string").alias("mime"), F.when(F.col("s_suppkey") % 3 == 1, F.col("t")).when(F.col("s_suppkey") % 3 == 2, "x").alias("value"), F.when(F.col("s_suppkey") % 3 == 0, F.col("t").cast("binary")).alias("content"))
    done = outbound.substitute_form(form, outbound.Config(mappings=(Mapping("the", "<T>"),)), "s_suppkey")
    return done.select("s_suppkey", F.when(F.col("filename").isNotNull(), "file").otherwise("field").alias("kind"), F.coalesce("value", F.col("content").cast("string")).alias("value"), "changed")


# --- keys and states ------------------------------------------------------------------------------------------------


@register("SELECT c_custkey, c_name AS opened, CAST(NULL AS VARCHAR) AS wrong FROM customer")
def password_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of three salts, opened by the password alone."""
    c = table(spark, sf_dir, "customer")
    sealed = [crypto.encrypt_with_password(F.col("c_name"), "secret", bytes([k]) * crypto.SALT) for k in range(3)]
    v = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, sealed[0]).when(F.col("c_custkey") % 3 == 1, sealed[1]).otherwise(sealed[2]).alias("v"))
    return v.select("c_custkey", crypto.decrypt_with_password(F.col("v"), "secret").alias("opened"), crypto.decrypt_with_password(F.col("v"), "other").alias("wrong"))


@register("SELECT n_nationkey, n_name AS value, TRUE AS moved FROM nation")
def keys_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of which half is still in plain text, under a new key."""
    old, new = (crypto.derive_key(p, b"0123456789abcdef") for p in ("old", "new"))
    half = F.col("n_nationkey") % 2 == 0
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(half, crypto.encrypt(F.col("n_name"), old)).otherwise(F.col("n_name")).alias("value"), half.alias("encrypted"))
    moved = stores.rekey(rows, old, new)
    return moved.select("n_nationkey", crypto.decrypt(F.col("value"), new).alias("value"), "encrypted").withColumnRenamed("encrypted", "moved")


@register("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'plain' WHEN n_nationkey % 3 = 1 THEN 'open' ELSE 'damaged' END AS state, CASE WHEN n_nationkey % 3 < 2 THEN n_name END AS payload FROM nation")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = crypto.derive_key("k", b"0123456789abcdef")
    n = table(spark, sf_dir, "nation")
    plain = F.to_json(F.struct(F.col("n_name").alias("payload")))
    e = n.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, plain).when(F.col("n_nationkey") % 3 == 1, stores.seal(F.col("n_name"), key, F.lit("1"), F.lit(5))).otherwise(F.lit("{}")).alias("e"))
    u = e.select("n_nationkey", stores.unseal(F.col("e"), key).alias("u"))
    return u.select("n_nationkey", "u.state", "u.payload")


@register("SELECT n_nationkey::VARCHAR AS org_id FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 0")
def policies_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    now = n.selectExpr("cast(n_nationkey as string) as org_id", "n_name as org_name", "2 as version")
    there = n.selectExpr("cast(n_nationkey as string) as org_id", "if(n_nationkey % 2 = 0, n_name, '') as org_name", "if(n_nationkey % 3 = 0, 3, 2) as version")
    return policy.newer_policy(now, there).select("org_id")


@register("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE ELSE n_nationkey > 10 END AS needed, CASE n_nationkey % 3 WHEN 0 THEN 'Password, never asks again' WHEN 1 THEN 'Password, biometric unlock, asks every time' ELSE 'Authenticator app, asks every 7 days' END AS said FROM nation""")
def auth_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    ttl = F.when(k == 0, -1).when(k == 1, 0).otherwise(7)
    now = F.lit("2024-01-20").cast("timestamp")
    verified = now - F.make_interval(days=F.when(F.col("n_nationkey") > 10, 8).otherwise(3))
    said = crypto.auth_text(F.when(k == 2, "totp").otherwise("password"), F.when(k == 1, F.lit("biometric unlock").isNotNull()).otherwise(F.lit(False)), ttl)
    return table(spark, sf_dir, "nation").select("n_nationkey", crypto.needs_auth(verified, ttl, now).alias("needed"), said.alias("said"))


@register("""SELECT n_nationkey, n_nationkey % 4 = 0 AS pull, n_nationkey % 2 = 0 AS push FROM nation""")
def sync_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull what is newer there; push what changed here since the last push, or was never pushed."""
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "10 as here", "if(n_nationkey % 4 = 0, 11, 10) as there", "case when n_nationkey % 2 = 1 then 10 when n_nationkey % 4 = 0 then null else 9 end as pushed")
    return n.select("n_nationkey", *stores.sync_decision(F.col("here"), F.col("there"), F.col("pushed")))


@register("""SELECT event_type AS key, arg_max(concat('{"v":', event_id, '}'), event_id) AS value, max(event_id) AS seq FROM events GROUP BY event_type HAVING max(event_id) % 2 = 0""")
def config_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest stored value of each key; every odd one is encrypted, and then its key tells nothing."""
    e = table(spark, sf_dir, "events").selectExpr("event_id as seq", "event_type as key", """if(event_id % 2 = 0, concat('{"v":', event_id, '}'), '{"encrypted":true,"payload":"x"}') as value""")
    return stores.config_changes(e)


@register("""SELECT s_nationkey AS team, min(s_suppkey) FILTER (WHERE act AND ca <> '') AS first_row, count(*) FILTER (WHERE act) AS n_pairs FROM (SELECT *, s_suppkey % 2 = 0 AS act, CASE WHEN s_suppkey % 3 = 0 THEN 'c' || s_suppkey ELSE '' END AS ca FROM supplier) GROUP BY s_nationkey HAVING count(*) FILTER (WHERE act) > 0""")
def active_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the active profiles of each team in order, and the first catch-all address that isn't empty."""
    p = table(spark, sf_dir, "supplier").selectExpr("s_nationkey as team", "s_suppkey as ordinal", "s_suppkey % 2 = 0 as active", "array(named_struct('real', string(s_suppkey), 'substitute', 'x')) as emails", "if(s_suppkey % 3 = 0, concat('c', s_suppkey), '') as catch_all_email")
    m = smart.merged_profiles(p, ["team"], "ordinal", ["emails"])
    return m.select("team", F.substr("catch_all_email", F.lit(2)).cast("long").alias("first_row"), F.size("emails").cast("long").alias("n_pairs"))
