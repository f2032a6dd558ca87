"""Queries over records: imports, reconciliation, policy, activity, stores and streams run as batches.

The tables have no dictionaries or configurations, so these queries derive them from customers, suppliers, orders,
events and pages by expressions that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import crypto
from velum.operators import activity, dictionary, policy, reconcile
from velum.plans.catalog import register, table
from velum.sources import importer, stores
from velum.streaming import sessions

# --- imports --------------------------------------------------------------------------------------------------------

_CATEGORY_SQL = r"""CASE WHEN regexp_matches({v}, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email' WHEN regexp_matches({v}, '^[\d\s()+.-]{{7,}}$') THEN 'phone' WHEN regexp_matches({v}, '^\d{{3}}-\d{{2}}-\d{{4}}$') THEN 'ssn'
    WHEN regexp_matches({v}, '(?i)\d{{1,5}}\s+\w+\s+(st|street|ave|avenue|blvd|dr|drive|rd|road|ln|lane)') THEN 'address'
    WHEN regexp_matches({v}, '(?i)^[a-z][a-z0-9._-]*$') AND length({v}) BETWEEN 3 AND 20 THEN 'general' WHEN regexp_matches({v}, '^[A-Z][a-z]+(\s[A-Z][a-z]+)*$') THEN 'name' ELSE 'general' END"""
_VALUE = """case c_custkey % 8 when 0 then c_name when 1 then concat('user', c_custkey, '@mail.example') when 2 then concat('+1 555 ', 1000000 + c_custkey)
    when 3 then concat(c_custkey % 900, ' Oak Street') when 4 then 'Ann Lee Miller' when 5 then concat('u.', c_custkey) when 6 then 'x' else concat('Value ', c_custkey) end"""


@register(f"SELECT c_custkey, v, {_CATEGORY_SQL.format(v='v')} AS category FROM (SELECT c_custkey, {_VALUE} AS v FROM customer)")
def guess_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_VALUE).alias("v"))
    return c.select("c_custkey", "v", importer.guess_category(F.col("v")).alias("category"))


@register(f"""SELECT kind, "real", category FROM (SELECT v AS "real", {_CATEGORY_SQL.format(v='v')} AS category, CASE {_CATEGORY_SQL.format(v='v')} WHEN 'email' THEN 'emails' WHEN 'phone' THEN 'phones' WHEN 'name' THEN 'names' ELSE 'mappings' END AS kind
    FROM (SELECT {_VALUE} AS v FROM customer) WHERE length(v) >= 2)""")
def import_value_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line_no"), F.expr(f"concat(' ', {_VALUE}, ' ')").alias("line"))
    return importer.value_rows(lines)


def _with_header(lines: DataFrame, header: str) -> DataFrame:
    return lines.sparkSession.createDataFrame([(0, header)], "line_no long, line string").unionByName(lines)


@register(f"""SELECT v AS "real", CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('S "', c_custkey, '", x') END AS substitute,
    CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE {_CATEGORY_SQL.format(v='v')} END AS category, c_custkey % 3 = 0 AS needs_mapping FROM (SELECT *, {_VALUE} AS v FROM customer)""")
def import_mapping_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = f"""concat({_VALUE}, ',', case when c_custkey % 3 = 0 then '' else concat('"S ""', c_custkey, '"", x"') end, case when c_custkey % 2 = 0 then concat(',', c_mktsegment) else '' end)"""
    lines = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("line_no"), F.expr(line).alias("line"))
    return importer.mapping_rows(_with_header(lines, "Real,Substitute"))


_ACCOUNT = """SELECT c_custkey + 1 AS n, case when c_nationkey % 2 = 0 then concat('user', c_custkey % 40, '@mail.example') else concat('u', c_custkey % 60) end AS who,
    concat('pw', c_custkey % 25) AS pw, concat('https://Site', c_nationkey, '.Example.org/login?x=', c_custkey) AS url FROM customer"""


@register(f"""WITH a AS ({_ACCOUNT}) SELECT 'emails' AS kind, who AS "real", '' AS substitute FROM a WHERE contains(who, '@') GROUP BY who
    UNION ALL SELECT 'usernames', who, '' FROM a WHERE NOT contains(who, '@') AND length(who) >= 3 GROUP BY who
    UNION ALL SELECT 'mappings', pw, concat('[REDACTED-PASSWORD-', row_number() OVER (ORDER BY min(n)), ']') FROM a WHERE length(pw) >= 4 GROUP BY pw
    UNION ALL SELECT 'mappings', lower(regexp_extract(url, '^https://([^/]+)', 1)), '' FROM a GROUP BY 2""")
def import_password_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey + 1 as line_no", "case when c_nationkey % 2 = 0 then concat('user', c_custkey % 40, '@mail.example') else concat('u', c_custkey % 60) end as who", "concat('pw', c_custkey % 25) as pw", "concat('https://Site', c_nationkey, '.Example.org/login?x=', c_custkey) as url")
    lines = a.select("line_no", F.concat_ws(",", "url", "who", "pw").alias("line"))
    return importer.password_rows(_with_header(lines, "url,username,password")).select("kind", "real", "substitute")


@register("""WITH a AS (SELECT concat('First', s_nationkey, ' Last', s_suppkey % 10, ' Jr') AS name, concat('m', s_suppkey % 30, '@x.org') AS mail, concat('555 ', s_nationkey) AS tel FROM supplier)
    SELECT 'names' AS kind, split_part(name, ' ', 1) AS "real", 'first' AS type FROM (SELECT DISTINCT name FROM a) UNION ALL
    SELECT 'names', split_part(name, ' ', 2) || ' Jr', 'last' FROM (SELECT DISTINCT name FROM a) UNION ALL
    SELECT DISTINCT 'emails', mail, NULL FROM a UNION ALL SELECT DISTINCT 'phones', tel, NULL FROM a""")
def import_autofill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "supplier").selectExpr("s_suppkey + 1 as line_no", "concat('First', s_nationkey, ' Last', s_suppkey % 10, ' Jr,m', s_suppkey % 30, '@x.org,555 ', s_nationkey) as line")
    return importer.autofill_rows(_with_header(lines, "Full Name,E-mail,Telephone")).select("kind", "real", "type")


@register("SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host FROM pages WHERE lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) NOT IN ('', 'google.com', 'github.com', 'x.com')")
def host_extract_anti_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(importer.host(F.col("url")).alias("host"))
    return hosts.where(F.col("host").isNotNull() & ~F.col("host").isin(*importer.COMMON_HOSTS)).distinct()


# --- reconciliation -------------------------------------------------------------------------------------------------

_SIDES = {
    "a": "select c_custkey as id, c_name as v, c_mktsegment as w from customer where c_custkey % 7 <> 0",
    "l": "select c_custkey as id, case when c_custkey % 3 = 0 then concat(c_name, 'L') when c_custkey % 15 = 1 then concat(c_name, 'X') else c_name end as v, c_mktsegment as w from customer where c_custkey % 5 <> 0",
    "r": "select c_custkey as id, case when c_custkey % 4 = 0 then concat(c_name, 'R') when c_custkey % 15 = 1 then concat(c_name, 'X') else c_name end as v, c_mktsegment as w from customer where c_custkey % 11 <> 0",
}


def _sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    table(spark, sf_dir, "customer").createOrReplaceTempView("velum_customer")
    return [spark.sql(q.replace("from customer", "from velum_customer")) for q in _SIDES.values()]


_JOINED = f"""WITH a AS ({_SIDES['a']}), l AS ({_SIDES['l']}), r AS ({_SIDES['r']}),
    j AS (SELECT coalesce(a.id, l.id, r.id) AS id, a.id IS NOT NULL AS ia, l.id IS NOT NULL AS il, r.id IS NOT NULL AS ir, a.v AS av, l.v AS lv, r.v AS rv, coalesce(a.w, l.w, r.w) AS w FROM a FULL JOIN l ON a.id = l.id FULL JOIN r ON coalesce(a.id, l.id) = r.id)"""


@register(f"""{_JOINED} SELECT id, v, w FROM (SELECT id, w, CASE WHEN NOT ia AND il THEN lv WHEN NOT ia THEN rv WHEN NOT il AND NOT ir THEN NULL WHEN NOT il THEN CASE WHEN av <> rv THEN rv END
    WHEN NOT ir THEN CASE WHEN av <> lv THEN lv END WHEN av = lv THEN rv ELSE lv END AS v FROM j) WHERE v IS NOT NULL""")
def merge_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.merge(*_sides(spark, sf_dir), ["id"])


@register(f"""{_JOINED} SELECT id::VARCHAR AS id, concat('mappings[', id, ']') AS path, CASE WHEN il THEN to_json({{'v': lv, 'w': w}})::VARCHAR END AS local_value, CASE WHEN ir THEN to_json({{'v': rv, 'w': w}})::VARCHAR END AS remote_value, CASE WHEN ia THEN to_json({{'v': av, 'w': w}})::VARCHAR END AS ancestor_value
    FROM j WHERE (il AND ir AND lv <> rv AND (NOT ia OR (av <> lv AND av <> rv))) OR (ia AND il AND NOT ir AND av <> lv) OR (ia AND ir AND NOT il AND av <> rv)""")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.conflicts(*_sides(spark, sf_dir), ["id"])


@register(f"""{_JOINED}, m AS (SELECT id, w, CASE WHEN NOT ia AND il THEN lv WHEN NOT ia THEN rv WHEN NOT il AND NOT ir THEN NULL WHEN NOT il THEN CASE WHEN av <> rv THEN rv END
    WHEN NOT ir THEN CASE WHEN av <> lv THEN lv END WHEN av = lv THEN rv ELSE lv END AS v FROM j)
    SELECT id, CASE WHEN id % 6 = 0 THEN 'chosen' ELSE v END AS v, w FROM m WHERE v IS NOT NULL AND id % 6 <> 1""")
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = reconcile.merge(*_sides(spark, sf_dir), ["id"])
    value = F.when(F.col("id") % 6 == 0, F.to_json(F.struct("id", F.lit("chosen").alias("v"), "w")))
    choices = merged.where("id % 6 <= 1").select(F.concat(F.lit("mappings["), F.col("id").cast("string"), F.lit("]")).alias("path"), value.alias("value"))
    return reconcile.resolve(merged, choices, "id")


@register("""SELECT n_nationkey AS key, array_to_string(CASE WHEN n_nationkey % 2 = 0 THEN ['d', 'b'] ELSE list_distinct_first END, ',') AS domains FROM (SELECT n_nationkey, ['b', concat('x', n_regionkey), 'a'] AS list_distinct_first FROM nation)""")
def merge_settings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of list settings, local first: what the ancestor had doesn't count."""
    n = table(spark, sf_dir, "nation")
    local = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("d"))).otherwise(F.array(F.lit("b"), F.concat(F.lit("x"), F.col("n_regionkey").cast("string"))))
    remote = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("b"), F.lit("d"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    side = lambda c: n.select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.to_json(c).alias("value"))
    keys = [f"k{i}" for i in range(25)]
    m = reconcile.merge_settings(side(F.array(F.lit("gone"))), side(local), side(remote), keys)
    return m.select(F.substr("key", F.lit(2)).cast("int").alias("key"), F.array_join(F.from_json("value", "array<string>"), ",").alias("domains"))


@register("""SELECT o_orderkey, array_to_string(CASE WHEN a = l THEN r WHEN a = r THEN l ELSE [CASE WHEN a[1] = l[1] THEN r[1] ELSE l[1] END, CASE WHEN a[2] = l[2] THEN r[2] ELSE l[2] END] END, ',') AS merged,
    a <> l AND a <> r AND ((a[1] <> l[1] AND a[1] <> r[1] AND l[1] <> r[1]) OR (a[2] <> l[2] AND a[2] <> r[2] AND l[2] <> r[2])) AS conflict
    FROM (SELECT o_orderkey, ['p', 'q'] AS a, [CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'p' END, CASE WHEN o_orderkey % 5 = 0 THEN 'y' ELSE 'q' END] AS l, [CASE WHEN o_orderkey % 4 = 0 THEN 'z' ELSE 'p' END, CASE WHEN o_orderkey % 7 = 0 THEN 'y' ELSE 'q' END] AS r FROM orders)""")
def merge_array_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "array('p', 'q') as a", "array(if(o_orderkey % 3 = 0, 'x', 'p'), if(o_orderkey % 5 = 0, 'y', 'q')) as l", "array(if(o_orderkey % 4 = 0, 'z', 'p'), if(o_orderkey % 7 = 0, 'y', 'q')) as r")
    m = o.select("o_orderkey", reconcile.merge_array(F.col("a"), F.col("l"), F.col("r")).alias("m"))
    return m.select("o_orderkey", F.array_join("m.merged", ",").alias("merged"), "m.conflict")


@register("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, loc)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS loc FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1) GROUP BY o_custkey""")
def lww_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (-F.col("o_orderkey")).alias("back"))
    newest = lambda parity: reconcile.latest(o.where(F.col("o_orderkey") % 2 == parity), ["o_custkey"], ["o_orderdate", "back"]).drop("back")
    return reconcile.last_writer_wins(newest(0), newest(1), ["o_custkey"], "o_orderdate")


@register("SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def snapshot_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return reconcile.prune(o, 3, ["o_custkey"], "o_orderdate", "o_orderkey")


@register("SELECT user_id AS device, max(ts) AS last_sync, count(*) AS n_syncs FROM events WHERE event_type <> '' GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 25")
def devices_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 25 devices seen last."""
    e = table(spark, sf_dir, "events").where("event_type <> ''")
    return e.groupBy(F.col("user_id").alias("device")).agg(F.max("ts").alias("last_sync"), F.count("*").alias("n_syncs")).orderBy(F.desc("last_sync"), "device").limit(25)


@register("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_seen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return reconcile.first_seen(e, "user_id", "event_id")


# --- policy ---------------------------------------------------------------------------------------------------------


@register("""WITH req AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS r, concat('ORG', c_custkey) AS s, CASE WHEN c_custkey % 3 = 0 THEN 'team' END AS cat FROM customer WHERE c_acctbal < 0)
    SELECT concat('org-o1-', r) AS id, r AS "real", s AS substitute, coalesce(cat, 'org') AS category, TRUE AS enabled, TRUE AS org_required FROM req
    UNION ALL SELECT c_custkey::VARCHAR, c_name, concat('S', c_custkey), 'general', c_custkey % 2 = 0, FALSE FROM customer WHERE lower(c_name) NOT IN (SELECT lower(r) FROM req)""")
def org_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    required = c.where("c_acctbal < 0").selectExpr("if(c_custkey % 2 = 0, upper(c_name), c_name) as real", "concat('ORG', c_custkey) as substitute", "if(c_custkey % 3 = 0, 'team', null) as category", "cast(null as boolean) as case_sensitive")
    personal = c.selectExpr("cast(c_custkey as string) as id", "c_name as real", "concat('S', c_custkey) as substitute", "'general' as category", "false as case_sensitive", "c_custkey % 2 = 0 as enabled")
    return policy.overlay(personal, required, "o1").select("id", "real", "substitute", "category", "enabled", "org_required")


@register("""WITH t AS (SELECT c_nationkey AS team, bool_or(act AND c_custkey % 50 = 3) AS nm, bool_or(act AND c_custkey % 60 = 7) AS em, bool_or(act) AS dom, bool_or(act AND c_custkey % 40 = 9) AS ca FROM (SELECT *, c_custkey % 2 = 1 AS act FROM customer) GROUP BY c_nationkey)
    SELECT team, nm AND (em OR ca) AND dom AND ca AS compliant, concat_ws(',', CASE WHEN NOT nm THEN 'name' END, CASE WHEN NOT (em OR ca) THEN 'email' END, CASE WHEN NOT dom THEN 'domain' END, CASE WHEN NOT ca THEN 'catch-all email' END) AS missing FROM t""")
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = "array<struct<real:string,substitute:string>>"
    p = table(spark, sf_dir, "customer").selectExpr("c_nationkey as team", "c_custkey % 2 = 1 as active", "array(named_struct('real', 'a', 'substitute', if(c_custkey % 50 = 3, 'b', ''))) as names", f"if(c_custkey % 60 = 7, array(named_struct('real', 'a', 'substitute', 'b')), cast(null as {pair})) as emails", "if(c_custkey % 40 = 9, 'x@y', '') as catch_all_email", *[f"cast(null as {pair}) as {k}" for k in ("usernames", "hostnames", "phones")])
    found = policy.compliance(p, ["name", "email", "domain"], True, ["team"])
    return found.select("team", "compliant", F.array_join("missing", ",").alias("missing"))


@register("SELECT n_nationkey, concat('https://p/', n_nationkey) AS url, n_name AS org FROM nation")
def invite_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", policy.invite_code(F.concat(F.lit("https://p/"), F.col("n_nationkey").cast("string")), F.col("n_name")).alias("code"))
    r = n.select("n_nationkey", policy.read_invite(F.col("code")).alias("r"))
    return r.select("n_nationkey", "r.url", F.col("r.orgId").alias("org"))


# --- activity -------------------------------------------------------------------------------------------------------


@register("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def activity_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's newest 200 rows, which is its cap."""
    return activity.recent(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), 200, "ts", "event_id")


@register("""WITH e AS (SELECT user_id AS tab, event_id % 9 = 0 AS nav, event_id % 4 AS amount, sum(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM events)
    SELECT tab, epoch, sum(CASE WHEN nav THEN 0 ELSE amount END)::BIGINT AS n FROM e GROUP BY tab, epoch""")
def badge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("tab"), "ts", "event_id")
    return activity.badge_counts(e, "tab", "ts", "event_id", F.col("event_id") % 9 == 0, F.col("event_id") % 4)


@register("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high, count(*) FILTER (WHERE props LIKE '%7%') AS n_seven FROM events GROUP BY event_type")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.count_if(F.col("props").contains("7")).alias("n_seven"))


@register("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN repeat(chr(8226), 8) WHEN length(p_name || p_type) > 12 THEN left(p_name || p_type, 9) || '...' ELSE p_name || p_type END AS shown,
    CASE WHEN p_partkey % 4 = 0 THEN 'Firefox' WHEN p_partkey % 4 = 1 THEN 'Chrome' WHEN p_partkey % 4 = 2 THEN 'Safari' ELSE 'Unknown' END || ' on X' AS device FROM part""")
def display_and_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("p_partkey") % 5 == 0, "password").otherwise("x")
    agent = F.element_at(F.array(*[F.lit(x) for x in ("a Firefox Edge", "b Chrome Safari Edge", "c Safari", "curl")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", activity.shown(F.concat("p_name", "p_type"), category, 12).alias("shown"), activity.device_name(agent, F.lit("X")).alias("device"))


# --- stores ---------------------------------------------------------------------------------------------------------


@register("""SELECT doc_id, i::INTEGER AS i, greatest(ceil(length(text) / 5000.0), 1)::INTEGER AS n, substr(text, i * 5000 + 1, 5000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil(length(text) / 5000.0), 1)::BIGINT)) AS i FROM documents)""")
def sync_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.to_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("SELECT doc_id, text FROM documents")
def sync_chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = stores.to_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 700)
    return stores.from_chunks(chunks, "doc_id", "text")


@register("SELECT conv_id, turn, '1' AS version, conv_id * 1000 AS last_modified, text AS payload FROM conversations")
def sync_code_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = stores.sync_code(F.lit("1"), F.col("conv_id") * 1000, F.col("text"))
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", stores.read_sync_code(code).alias("r"))
    return r.select("conv_id", "turn", "r.version", F.col("r.lastModified").alias("last_modified"), "r.payload")


@register("SELECT c_custkey, c_name AS opened, TRUE AS is_other, CAST(NULL AS VARCHAR) AS wrong FROM customer")
def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted and opened again; the nonce is random, so only what comes back can be compared."""
    key, other = (crypto.derive_key(p, b"0123456789abcdef") for p in ("right", "wrong"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", crypto.encrypt(F.col("c_name"), key).alias("sealed"))
    return c.select("c_custkey", crypto.decrypt(F.col("sealed"), key).alias("opened"), (F.col("sealed") != F.col("c_name")).alias("is_other"), crypto.decrypt(F.col("sealed"), other).alias("wrong"))


@register("SELECT * FROM (VALUES (59, '287082'), (1111111109, '081804'), (1111111111, '050471'), (1234567890, '005924'), (2000000000, '279037')) v(seconds, code)")
def totp_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = spark.createDataFrame([(59,), (1111111109,), (1111111111,), (1234567890,), (2000000000,)], "seconds int")
    return times.select("seconds", crypto.totp_codes(F.lit("GEZDGNBVGY3TQOJQGEZDGNBVGY3TQOJQ"), F.col("seconds").cast("long")).alias("code"))


# --- streams as batches ---------------------------------------------------------------------------------------------


@register("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS began, count(*) AS n, arg_max(event_id, (ts, event_id)) AS event_id FROM s GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    found = sessions.settled(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "30 minutes", "event_id")
    return found.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), "n", "event_id")


@register("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS began, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.tumbling(table(spark, sf_dir, "events"), ["event_type"], "ts", "1 hour")


@register("SELECT event_id, concat('REAL', user_id % 50, ' and sub-', user_id % 50 + 1) AS revealed FROM events")
def reveal_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages turned back by the pairs of their own user, and by no other's."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id")
    number = lambda n: (F.col("session") % 50 + n).cast("string")
    pairs = e.select("session").distinct().select("session", F.concat(F.lit("SUB-"), number(0), F.lit(" ")).alias("source"), F.concat(F.lit("REAL"), number(0), F.lit(" ")).alias("target"))
    messages = e.withColumn("text", F.concat(F.lit("sub-"), number(0), F.lit(" and sub-"), number(1)))
    return dictionary.reveal_by_session(messages, pairs).select("event_id", "revealed")
