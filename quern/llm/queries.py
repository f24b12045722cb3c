"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, decontamination, fingerprints, lines, minhash, packing, quality, resampling, rollups, sharding, suffixes, toxicity
from .common import Stored, fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "host_rejected")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest_lines(_table(spark, sf_dir, "documents"), least_bytes=lines.LEAST_BYTES)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents counted with one public vocabulary; those labelled toxic deleted; German ones revised to the counts of
    the vocabulary for many languages. The last batch is committed twice."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    store = rollups.Rollup(spark, fresh_path(spark, "rollup"))
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    # Texts are counted before any join, so only ids and counts are shuffled.
    first = Stored(rollups.count_tokens(docs, "byte_bpe_50k@1", keep=["doc_id"]), "counts").df
    many = Stored(rollups.count_tokens(docs.where("lang = 'de'"), "byte_bpe_multi_50k@1", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id"]), "counts").df
    store.commit("load", rollups.inserts(first))
    store.commit("delete-toxic", rollups.deletes(first.join(toxic, "doc_id", "left_semi")))
    old, new = (c.join(toxic, "doc_id", "left_anti") for c in (first.where("lang = 'de'"), many))
    for _ in range(2):
        store.commit("revise-de", rollups.revisions(old, new))
    return store.totals()


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_repeats(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=3, percent=85)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_line_dedup, op4_bpe, op5_token_counts, op6_sharding, op7_suffix_dedup, op8_minhash, op9_fingerprints, op10_toxicity, op11_resampling, op12_clusters, op13_decontamination)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
win AS (SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM d WHERE len(ws) >= 3)),
rep AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w) AS c FROM win),
cov AS (SELECT rid, count(DISTINCT p + o) AS n FROM rep, (VALUES (0), (1), (2)) AS t(o) WHERE c > 1 GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
s AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
f AS (SELECT source, rule, count(*) AS n, sum(CAST(bad AS INT)) AS f FROM (
  SELECT source, unnest(['short', 'repeats', 'symbols', 'dup_lines']) AS rule, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > word_chars, 10 * n_dup_lines > 3 * n_lines]) AS bad FROM b WHERE source IS NOT NULL) GROUP BY source, rule),
m AS (SELECT rule, sum(f) / sum(n) AS m FROM f GROUP BY rule),
v AS (SELECT rule, m, greatest((sum(n * pow(f / n - m, 2)) - count(*) * m * (1 - m)) / sum(n), 0) AS v FROM f JOIN m USING (rule) GROUP BY rule, m),
k AS (SELECT rule, m, least(10000, greatest(1, coalesce(CASE WHEN v > 0 THEN m * (1 - m) / v END - 1, 10000))) AS k FROM v),
h AS (SELECT source, max((f + k * m) / (n + k)) > 0.5 AS bad FROM f JOIN k USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept, n_lines, coalesce(bad, false) AS host_rejected
FROM b LEFT JOIN h USING (source)
"""

OP3_SQL = """
WITH l AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
w AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
r AS (SELECT doc_id, k, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
later AS (SELECT doc_id, k, 1 AS h FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY a ORDER BY doc_id, k) AS nth FROM r WHERE strlen(a) >= 100) WHERE nth > 1
  UNION ALL SELECT doc_id, k, 2 FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, k) AS nth FROM r WHERE strlen(a) + strlen(b) >= 100) WHERE nth > 1
  UNION ALL SELECT doc_id, k, 3 FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS nth FROM r WHERE c IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, k + o AS k FROM later, (VALUES (0), (1), (2)) AS t(o) WHERE o < h),
runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before <> k - 1) AS runs FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone) GROUP BY doc_id),
kept AS (SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.k IS NULL), '') AS text, count(w.k) AS n_lines FROM l LEFT JOIN w USING (doc_id, pos) LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.k = w.k GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(runs, 0) AS BIGINT) AS n_runs, sha256(text) AS kept_sha256 FROM kept LEFT JOIN runs USING (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

OP11_SQL = f"""
WITH RECURSIVE step AS (SELECT i, i AS c, 0 AS n FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, {_BIT}, n + 1 FROM step WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE n = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_ITEM_WORDS} AS ws FROM documents), b AS (SELECT {_ITEM_WORDS} AS ws FROM benchmark),
df AS (SELECT rid, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM b),
h AS (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST(('0x' || substr(hex(encode(f)), 2 * i + 1, 2)) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM bf), tab),
dh AS (SELECT rid, bucket FROM df JOIN h USING (f)),
s AS (SELECT bucket, count(*) AS s FROM dh GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket),
a AS (SELECT (SELECT count(*) FROM dh) AS s_all, (SELECT count(*) FROM bf) AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), a),
w AS (SELECT rid, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dh JOIN g USING (bucket) GROUP BY rid),
r AS (SELECT rid, doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST(('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8)) AS BIGINT) AS h FROM d LEFT JOIN w USING (rid)),
k AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
e AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS nth, count(*) OVER () AS n FROM k WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN nth <= 25 * e.n // 100 THEN nth END AS BIGINT) AS rank FROM k LEFT JOIN e USING (rid)
"""


def _op12_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    parts = [
        f"v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INT) AS c, v AS m FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT rid, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r})")
        parts.append(f"a{r} AS (SELECT rid, min(d) AS d, CAST(arg_min(c, (d, c)) AS INT) AS c FROM d{r} GROUP BY rid)")
        if r < rounds:
            parts.append(f"e{r} AS (SELECT c, i, CAST(sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*) AS BIGINT) // count(*) AS x FROM a{r} JOIN v USING (rid), (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY c, i)")
            parts.append(f"n{r} AS (SELECT c, list(CAST(x AS BIGINT) ORDER BY i) AS m FROM e{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS (SELECT c, coalesce(n{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN n{r} USING (c))")
    return f"""WITH {', '.join(parts)}, i AS (SELECT c, sum(d) AS cluster_inertia, sum(sum(d)) OVER () AS inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia, CAST(inertia AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} USING (c) JOIN i USING (c)"""


OP13_SQL = f"""
WITH i AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark), d AS (SELECT row_number() OVER () AS rid, doc_id, {_ITEM_WORDS} AS ws FROM documents),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS w FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
dw AS (SELECT rid, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
m AS (SELECT rid, p, n, item_id FROM dw JOIN iw USING (n, w)),
h AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) AS p FROM (SELECT DISTINCT rid, p, n FROM m)) GROUP BY rid),
x AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), '') AS k FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN x USING (rid)
"""

#: SQL has no tokenizers, so op5_token_counts has none; its test counts with the library.
ORACLE_SQL = {"op1_quality_rules": OP1_SQL, "op3_line_dedup": OP3_SQL, "op11_resampling": OP11_SQL, "op12_clusters": _op12_sql(), "op13_decontamination": OP13_SQL}

