"""The registered queries of the corpus operators: each applies its operator, with production parameters, to its
whole table. DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm import centroids, convtrie, decontam, langid, licenses, linelabels, media, piece_bpe, sharding, simhash, tokenfiles, toxicity, viterbi
from velum.plans.catalog import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(documents(spark, sf_dir), shards=8)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return sharded.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.array_join("expressions", "; ").alias("expressions"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_tokenfiles(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    with open(path or vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return tokenfiles.token_files(documents(spark, sf_dir), tokenizer, end_id=1)


def piece_model(path: str | None = None) -> bytes:
    with open(path or vocabulary("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op9_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return piece_bpe.round_trip(documents(spark, sf_dir), piece_model(path))


def op10_tokencounts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return viterbi.token_counts(documents(spark, sf_dir), viterbi.as_unigram(piece_model(path)))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the labels of all lines of all documents. A null text has no words."""
    found = linelabels.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumn("boilerplate", F.array_join("boilerplate", ","))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight centroids of all embeddings, ten rounds. Other lengths, nulls and non-finite components are left out."""
    return centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all rebuilt conversations. Null roles and texts are empty, null turns first, null ids left out."""
    return convtrie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_toxicity, op3_simhash, op4_decontamination, op5_sharding, op6_langid, op7_licenses, op8_tokenfiles, op9_sentencepiece, op10_tokencounts, op11_quality, op12_centroids, op13_prefixtrie, pipeline)}


_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format(t="text")}, []) AS w FROM documents),
    b AS (SELECT cast(item_id AS VARCHAR) AS item, {_WORDS.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
    windows AS (SELECT item, n, i AS j, array_to_string(list_slice(w, i + 1, i + n), ' ') AS win FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
    found AS (SELECT p.doc_id, p.n, p.i, x.item FROM places p JOIN windows x ON p.n = x.n AND p.win = x.win),
    hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
    spot AS (SELECT p.doc_id, x.item, p.i, x.j, p.n FROM places p JOIN windows x ON p.n = x.n AND p.win = x.win),
    run AS (SELECT doc_id, item, min(i) AS i, min(j) AS j, count(*) + n - 1 AS words FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, n, i - j ORDER BY i) AS island FROM spot) GROUP BY doc_id, item, n, i - j, island),
    longest AS (SELECT doc_id, words, i, item, j FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, i, item, j) = 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
    words::BIGINT AS longest_words, i::BIGINT AS longest_start, item AS longest_item, j::BIGINT AS longest_item_start
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)"""


def _centroids_sql(size: int, scale: int, count: int, rounds: int) -> str:
    """Lloyd's rounds, one CTE for the assignment and one for the new centroids of each."""
    distance = f"list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) for i in range(1, {size + 1})])::BIGINT"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * e::DOUBLE)::BIGINT for e in embedding] AS x FROM embeddings WHERE len(embedding) = {size} AND len([1 for e in embedding if e IS NOT NULL AND isfinite(e)]) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS j, x FROM (SELECT x, sha256('3:' || vec_id::VARCHAR) AS h FROM v) QUALIFY j < {count})",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, vec_id, v.x, j, {distance} AS d FROM v, c{k} AS c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT j, list(f ORDER BY i) AS x FROM (SELECT j, i, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS f FROM (SELECT j, unnest(x) AS e, unnest(range({size})) AS i FROM a{k}) GROUP BY j, i) GROUP BY j)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.j, coalesce([e::BIGINT for e in m{k}.x], c.x) AS x FROM c{k} AS c LEFT JOIN m{k} USING (j))")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, a.j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{rounds} AS a JOIN c{rounds} AS c USING (j)"""


OP12_SQL = _centroids_sql(centroids.SIZE, centroids.SCALE, centroids.CENTROIDS, centroids.ROUNDS)

#: CRC-32 of a number in decimal: each character is followed by eight steps of one bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for ch in string_split(conv_id::VARCHAR, '')])),
        lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""

OP13_SQL = f"""WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    r AS MATERIALIZED (SELECT c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS w FROM (SELECT *, {_CRC32} % 6 AS h FROM t) AS c LEFT JOIN t AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
    p AS MATERIALIZED (SELECT conv_id, len(w) AS turns, d AS depth, md5(list_slice(w, 1, d)::VARCHAR || d::VARCHAR) AS k, md5(list_slice(w, 1, d - 1)::VARCHAR || (d - 1)::VARCHAR) AS up, CASE WHEN d > 0 THEN len(w[d].text) ELSE 0 END AS chars FROM (SELECT *, unnest(range(len(w) + 1)) AS d FROM r)),
    n AS MATERIALIZED (SELECT k, any_value(up) AS up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256 FROM p GROUP BY k, depth),
    kids AS MATERIALIZED (SELECT up AS k, count(*) AS n FROM n WHERE depth > 0 GROUP BY up),
    sums AS (SELECT a.k, sum(x.saved) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM p AS a JOIN n AS x ON x.conv_id = a.conv_id AND x.depth >= a.depth LEFT JOIN kids ON kids.k = x.k GROUP BY a.k)
    SELECT n.conv_id, n.depth::BIGINT AS depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, sums.saved::BIGINT AS saved_tokens, n.ends_sha256
    FROM n LEFT JOIN n AS u ON u.k = n.up LEFT JOIN kids ON kids.k = n.k JOIN sums ON sums.k = n.k"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op12_centroids": OP12_SQL, "op13_prefixtrie": OP13_SQL}
