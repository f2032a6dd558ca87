import hashlib
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from velum.functions import crypto
from velum.operators import activity
from velum.operators.dictionary import Mapping
from velum.plans import outbound
from velum.sources import changelog, documents, importer, stores
from velum.streaming import sessions


def lines(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "line_no int, line string")


def test_mapping_table(spark):
    got = importer.mapping_rows(lines(spark, "Real,Substitute,Category", '"Smith, ""J""",X,Person', "a@b.co,", ",skip", "one")).collect()
    assert sorted(map(tuple, got)) == [('Smith, "J"', "X", "person", False), ("a@b.co", "", "email", True)]
    assert importer.mapping_rows(lines(spark, "a\tb", "c,d\te")).count() == 2


def test_accounts(spark):
    rows = ("url,username,password", "https://Mail.Example.org/x,me@x.org,hunter22", "https://github.com,ab,hunter22", "bad url,bob,abc", "https://mail.example.org,bob,other-pass")
    got = {(r.kind, r.real, r.substitute, r.category) for r in importer.password_rows(lines(spark, *rows)).collect()}
    assert got == {("emails", "me@x.org", "", None), ("usernames", "bob", "", None), ("mappings", "hunter22", "[REDACTED-PASSWORD-1]", "password"), ("mappings", "other-pass", "[REDACTED-PASSWORD-2]", "password"), ("mappings", "mail.example.org", "", "domain")}
    b = importer.bitwarden_rows(lines(spark, "folder,favorite,login_uri,login_username,login_password", ",,https://z.io,carol,pass1234"))
    assert b.count() == 3 and importer.summary(b).where("kind = 'mappings'").first().n == 2
    assert importer.apply_to_mappings(spark.createDataFrame([("a", "b", "c", False, True)], "real string, substitute string, category string, case_sensitive boolean, enabled boolean"), b).where("case_sensitive").count() == 1


def test_autofill_and_lists(spark):
    got = sorted((r.kind, r.real, str(r.type)) for r in importer.autofill_rows(lines(spark, "Full Name,E-mail,Tel,Street", "Ann van Dyk,a@b.co,555 1234567,1 Oak St", "Ann van Dyk,a@b.co,,", "Cher,,,")).collect())
    assert got == [("emails", "a@b.co", "None"), ("mappings", "1 Oak St", "None"), ("names", "Ann", "first"), ("names", "Cher", "first"), ("names", "van Dyk", "last"), ("phones", "555 1234567", "None")]
    got = {(r.kind, r.real) for r in importer.value_rows(lines(spark, "x@y.zz", "+1 555 123 4567", "Ann Lee", "Ann", "z", "123-45-6789", "12 Oak Street")).collect()}
    assert got == {("emails", "x@y.zz"), ("phones", "+1 555 123 4567"), ("names", "Ann Lee"), ("mappings", "Ann"), ("phones", "123-45-6789"), ("mappings", "12 Oak Street")}


def test_formats(spark, tmp_path):
    for name, text in {"my-passwords.csv": "a", "bitwarden.csv": "x", "addresses.csv": "x", "e.csv": "Login,x\n", "f.csv": "folder,favorite\n", "g.txt": "a\tb", "h.txt": "plain\nlist\n\n"}.items():
        (tmp_path / name).write_text(text)
    read = importer.read_lines(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.format for r in importer.formats(read).collect()}
    assert got == {"my-passwords.csv": "password", "bitwarden.csv": "bitwarden", "addresses.csv": "autofill", "e.csv": "password", "f.csv": "bitwarden", "g.txt": "mapping", "h.txt": "list"}


def test_codecs(spark, tmp_path):
    df = spark.createDataFrame([(1, "é" * 12001), (2, ""), (3, "abc")], "k int, v string")
    chunks = stores.to_chunks(df, "k", "v")
    assert chunks.where("k = 1").count() == 3 and {r.k: r.value for r in stores.from_chunks(chunks, "k").collect()} == {r.k: r.v for r in df.collect()}
    assert {r.value for r in stores.from_chunks(chunks.where("not (k = 1 and i = 1)"), "k").where("k = 1").collect()} == {"é" * 7001}
    c = df.select(stores.read_sync_code(stores.sync_code(F.lit("1"), F.lit(5), F.col("v"))).alias("c")).collect()
    assert sorted(r.c.payload for r in c) == sorted(r.v for r in df.collect())
    assert spark.range(1).select(stores.read_sync_code(F.base64(F.lit(b"{}"))).alias("c")).first().c is None
    key, other = crypto.derive_key("pw", b"s" * 16, 10), crypto.derive_key("no", b"s" * 16, 10)
    for k in (None, key):
        path = f"{tmp_path}/b{k is None}"
        stores.backup(spark, {"t": df, "u": df.limit(1)}, path, k)
        assert stores.restore(spark, path, "t", "k int, v string", k).count() == 3
    assert stores.restore(spark, f"{tmp_path}/bFalse", "t", "k int, v string", other).count() == 0
    kv = df.selectExpr("cast(k as string) name", "v value")
    stores.write_secure(kv, f"{tmp_path}/kv", key)
    assert sorted(stores.read_secure(spark, f"{tmp_path}/kv", key).collect()) == sorted(kv.collect())
    assert {r.value for r in stores.read_secure(spark, f"{tmp_path}/kv", None).collect()} == {None}
    again = stores.rekey(spark.read.parquet(f"{tmp_path}/kv"), key, other)
    assert again.select(crypto.decrypt(F.col("value"), other).alias("v")).where("v = 'abc'").count() == 1
    with pytest.raises(ValueError):
        stores.write_secure(kv, f"{tmp_path}/x", None)


def test_keys_and_codes(spark):
    assert crypto.derive_key("password", b"salt", 1).hex() == "120fb6cffcf8b32c43e7225256c4f837a86548c92ccc35480805987cb70be17b"
    secret = "GEZDGNBVGY3TQOJQGEZDGNBVGY3TQOJQ"
    assert [crypto.totp(secret, t, 8) for t in (59, 1111111109, 2000000000)] == ["94287082", "07081804", "69279037"]
    df = spark.createDataFrame([(secret, 59), (None, 1)], "s string, t long")
    assert [r.c for r in df.select(crypto.totp_codes(F.col("s"), F.col("t")).alias("c")).collect()] == ["287082", None]
    ok = lambda t: df.limit(1).select(crypto.totp_valid(F.col("s"), F.lit("287082"), F.lit(t)).alias("v")).first().v
    assert ok(59) and ok(89) and ok(29) and not ok(120)
    salt = b"0" * 16
    v = df.limit(1).select(crypto.encrypt_with_password(F.lit("text"), "pw", salt).alias("v"))
    assert v.select(crypto.decrypt_with_password(F.col("v"), "pw").alias("x")).first().x == "text"
    assert v.select(crypto.decrypt_with_password(F.col("v"), "px").alias("x")).first().x is None
    h = crypto.admin_hash("root", salt)
    assert crypto.may("disable", "root", salt, h) and not crypto.may("disable", "x", salt, h) and not crypto.may("disable", "root", salt, h, True) and crypto.may("look", None, salt, h)
    t = spark.sql("select timestamp'2024-01-01' v, timestamp'2024-01-05' n")
    got = t.select(*[crypto.needs_auth(F.col("v"), F.lit(d), F.col("n")).alias(f"d{k}") for k, d in enumerate((-1, 0, 3, 7))]).first()
    assert tuple(got) == (False, True, True, False)


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return out.getvalue()


def test_files(spark, tmp_path):
    stream = zlib.compress(b"BT (Hello acme \\(x\\)) Tj [(ac) -5 (me)] TJ (next) ' ET")
    pdf = b"%PDF\n<< /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nstream\n(plain) Tj\nendstream"
    files = {
        "a.txt": b"acme text", "b.pdf": pdf, "c.docx": office({"word/document.xml": "<w:t>acme co</w:t><w:t id='acme'>x</w:t>", "word/media.bin": "acme"}),
        "d.xlsx": office({"xl/sharedStrings.xml": "<t>none here</t>"}), "e.bin": b"acme", "f.docx": b"broken",
    }
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    read = documents.read_files(spark, str(tmp_path))
    assert documents.pdf_text(pdf) == "Hello acme (x)acme\nnext\nplain"
    config = outbound.Config(mappings=(Mapping("acme", "zeta"),))
    change = lambda df: outbound.substitute_all(df, config, "text", "r").select("path", "kind", "part", "text", F.col("r.text").alias("new_text"))
    xml = lambda df: df.withColumn("new_text", outbound.rewrite_markup(F.col("text"), lambda t: F.replace(t, F.lit("acme"), F.lit("zeta"))))
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.rewrite(read, change, xml).collect()}
    assert {k: r.status for k, r in got.items()} == {"a.txt": "rewritten", "b.pdf": "rewritten", "c.docx": "rewritten", "d.xlsx": "unchanged", "e.bin": "skipped", "f.docx": "skipped"}
    assert bytes(got["a.txt"].content) == b"zeta text" and got["b.pdf"].filename == "b.txt" and b"zeta" in bytes(got["b.pdf"].content) and bytes(got["e.bin"].content) == b"acme"
    z = zipfile.ZipFile(io.BytesIO(bytes(got["c.docx"].content)))
    assert z.testzip() is None and z.read("word/document.xml") == b"<w:t>zeta co</w:t><w:t id='acme'>x</w:t>" and z.read("word/media.bin") == b"acme"


def test_activity(spark):
    log = spark.createDataFrame([("t", 1, False, 2), ("t", 2, True, 9), ("t", 3, False, 1), ("t", 4, False, 4), ("u", 1, False, 7)], "tab string, seq int, nav boolean, n int")
    got = {(r.tab, r.epoch): r.n for r in activity.badge_counts(log, "tab", "seq", "seq", F.col("nav"), F.col("n")).collect()}
    assert got == {("t", 0): 2, ("t", 1): 5, ("u", 0): 7}
    ua = spark.createDataFrame([("Chrome Edge",), ("Safari",), ("x",)], "ua string")
    assert [r.n for r in ua.select(activity.device_name(F.col("ua"), F.lit("P")).alias("n")).collect()] == ["Chrome on P", "Safari on P", "Unknown on P"]
    row = spark.range(1).select(activity.shown(F.lit("pw"), F.lit("password")), activity.shown(F.lit("x" * 31), F.lit("a")), activity.escaped(F.lit("<a b='c'>&")), activity.normal_domain(F.lit("x.org//")), activity.app_state(F.lit(True), F.lit(True), F.lit(True))).first()
    assert tuple(row) == ("•" * 8, "x" * 27 + "...", "&lt;a b=&#39;c&#39;&gt;&amp;", "https://x.org", "reveal")


def drain(df, mode, name, checkpoint):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_streams_with_state(spark, tmp_path):
    sessions.use_rocksdb(spark)
    src = f"{tmp_path}/in"
    kind = "session string, seq long, kind string, source string, target string, text string"
    spark.createDataFrame([("a", 1, "emitted", "Max", "Bob", None), ("a", 2, "message", None, None, "hi MAX"), ("b", 1, "message", None, None, "Max")], kind).write.parquet(f"{src}/1")
    spark.createDataFrame([("a", 3, "emitted", "max power", "Robert", None), ("a", 4, "message", None, None, "max power, max")], kind).write.parquet(f"{src}/2")
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(src)
    got = sorted(map(tuple, drain(sessions.reveal_stream(stream), "append", "revealed", f"{tmp_path}/c1").collect()))
    assert got == [("a", 2, "hi Bob"), ("a", 4, "Robert, Bob"), ("b", 1, "Max")]
    kind = "tab string, seq long, is_nav boolean, amount long"
    spark.createDataFrame([("t", 1, False, 3), ("t", 2, True, 0), ("t", 3, False, 2), ("u", 1, False, 1)], kind).write.parquet(f"{tmp_path}/tabs")
    got = drain(sessions.tab_counters(spark.readStream.schema(kind).parquet(f"{tmp_path}/tabs")), "update", "tabs", f"{tmp_path}/c2")
    assert sorted(map(tuple, got.collect())) == [("t", 2), ("u", 1)]


def test_change_feed_and_settled_rows(spark, tmp_path):
    kind = "id string, v string, m long"
    spark.createDataFrame([("1", "a", 1), ("1", "b", 3), ("2", "c", 1)], kind).write.parquet(f"{tmp_path}/feed/1")
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/feed")
    changelog.sync_batches(stream, f"{tmp_path}/out", f"{tmp_path}/c", "id", "m").awaitTermination(120)
    spark.createDataFrame([("1", "old", 2), ("2", "new", 5)], kind).write.parquet(f"{tmp_path}/feed/2")
    changelog.sync_batches(stream, f"{tmp_path}/out", f"{tmp_path}/c", "id", "m").awaitTermination(120)
    assert sorted(map(tuple, changelog.read(spark, f"{tmp_path}/out", "id", "m").collect())) == [("1", "b", 3), ("2", "new", 5)]
    rows = spark.sql("select * from values ('k', timestamp'2024-01-01 00:00:00', 1), ('k', timestamp'2024-01-01 00:00:05', 2), ('k', timestamp'2024-01-01 00:01:00', 3) as t(key, ts, v)")
    assert sorted((r.v, r.n) for r in sessions.settled(rows, "key", "ts", "10 seconds", "v").collect()) == [(2, 2), (3, 1)]
    config = outbound.Config(mappings=(Mapping("acme", "zeta"),))
    spark.createDataFrame([("acme",)], "text string").write.parquet(f"{tmp_path}/msg")
    out = sessions.rewrite_messages(spark.readStream.schema("text string").parquet(f"{tmp_path}/msg"), config).select("result.text")
    assert [r.text for r in drain(out, "append", "msgs", f"{tmp_path}/c3").collect()] == ["zeta"]
    assert hashlib.sha256(b"").hexdigest()


def test_exports_of_any_width(spark):
    head = ",".join(["x"] * 198 + ["username", "password"])
    lines = spark.createDataFrame([(0, head), (1, ",".join(["v"] * 198 + ['"a ""b"", c@d"', "secret"]))], "line_no int, line string")
    got = {(r.kind, r.real) for r in importer.password_rows(lines).collect()}
    assert got == {("emails", 'a "b", c@d'), ("mappings", "secret")}


def test_lines_of_large_files_are_numbered_over_their_splits(spark, tmp_path):
    text = "\n \n\t first \r\n" + "\r\n".join(f"line {k} {'é' * 40}" for k in range(2000)) + "\n last\t\n\n \n"
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = importer.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = [(r.line_no, r.line) for r in read.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = text.strip().replace("\r\n", "\n").split("\n")
    assert [n for n, _ in got] == list(range(2002)) and [x for _, x in got] == want


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/history"
    table = lambda *v: {"mappings": spark.createDataFrame([(x,) for x in v], "real string"), "settings": spark.createDataFrame([("k", v[0])], "key string, value string")}
    assert stores.snapshots(spark, path) is None
    ids = [stores.save_snapshot(table(f"a{k}", "b"), path, at, "edit", keep=3) for k, at in enumerate((10, 20, 20, 5))]
    assert ids == [1, 2, 3, 4] and [r.id for r in stores.snapshots(spark, path).collect()] == [3, 2, 1]
    back = stores.roll_back(spark, path, 2, {"mappings": "real string", "settings": "key string, value string"}, 30)
    assert sorted(r.real for r in back["mappings"].collect()) == ["a1", "b"] and back["settings"].first().value == "a1"
    assert [(r.id, r.source) for r in stores.snapshots(spark, path).collect()][0] == (4, "rollback")
    stores.delete_snapshot(spark, path, 3)
    assert [r.id for r in stores.snapshots(spark, path).collect()] == [4, 2, 1]
    stores.clear_snapshots(spark, path)
    assert stores.snapshots(spark, path) is None


def test_config_changes(spark):
    feed = spark.createDataFrame([(1, "mappings", "[1]"), (3, "mappings", "[2]"), (2, "identity", '{"a":1}'), (4, "identity", '{"encrypted":true}'), (5, "settings", None)], "seq int, key string, value string")
    assert [tuple(r) for r in stores.config_changes(feed).collect()] == [("mappings", "[2]", 3)]


def test_escapes_of_pdf_strings():
    assert documents.pdf_text(b"stream\n(a\\18b \\050\\)\\9) Tj\nendstream") == "a\x018b ()9" or documents.pdf_text(b"stream\n(a\\18b) Tj\nendstream") == "a\x018b"


def test_chunks_of_a_key_keep_their_order():
    import pandas as pd

    class Total:
        n = (7,)

        def exists(self):
            return True

        def get(self):
            return self.n

        def update(self, v):
            self.n = v

    counter = sessions._TabCounter(None)
    counter.total = Total()
    chunks = [pd.DataFrame({"seq": s, "is_nav": nav, "amount": a}) for s, nav, a in (([5, 1], [False, False], [5, 1]), ([3, 4], [True, False], [9, 4]), ([2], [True], [0]))]
    assert [tuple(x.iloc[0]) for x in counter.handleInputRows(("t",), iter(chunks), None)] == [("t", 9)]


def test_forms_of_office_files(spark):
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", "<w:t>Ann the one</w:t><w:t> </w:t>")
    rows = [(1, "f", "a.docx", None, None, raw.getvalue()), (1, "note", None, None, "the", None), (1, "n", None, None, None, None), (2, "g", "x.bin", None, None, b"\x00")]
    form = spark.createDataFrame(rows, "id long, field string, filename string, mime string, value string, content binary")
    done = {r.field: r for r in outbound.substitute_form(form, outbound.Config(mappings=(Mapping("the", "<T>"),)), "id").collect()}
    assert [done[k].changed for k in ("f", "note", "n", "g")] == [True, True, False, False] and done["note"].value == "<T>" and bytes(done["g"].content) == b"\x00"
    with zipfile.ZipFile(io.BytesIO(bytes(done["f"].content))) as z:
        assert z.read("word/document.xml").decode() == "<w:t>Ann <T> one</w:t><w:t> </w:t>"
