"""Registered queries over the reference tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import tokens as T
from .functions import vectors as V
from .operators import evaluation, indexing, mixing, modalities, running
from .plans import supervision

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HASH = "CAST(('0x' || left(md5('42-' || {k}), 15)) AS BIGINT)"
_RENDER = """
turns AS (SELECT conv_id, turn, role, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS tag, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM conversations),
pieces AS (SELECT conv_id, turn, role, list_concat([CAST(tag AS BIGINT)], CASE WHEN role = 'user' THEN list_transform(range(1 + conv_id % 4), lambda i: CAST(9 AS BIGINT)) ELSE [] END, list_transform(ws, lambda w: CAST(('0x' || left(md5(w), 7)) AS BIGINT) + 1000), [CAST(4 AS BIGINT)]) AS ids FROM turns),
masked AS (SELECT *, CASE WHEN role IN ('system', 'user') THEN list_transform(ids, lambda x: CAST(-100 AS BIGINT)) ELSE ids END AS lab FROM pieces),
samples AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS input_ids, flatten(list(lab ORDER BY turn)) AS labels FROM masked GROUP BY conv_id)
"""
_CSV = "array_to_string({c}, ',')"


def _csv(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query(f"WITH {_RENDER} SELECT conv_id, {_CSV.format(c='input_ids')} AS input_ids, {_CSV.format(c='labels')} AS labels FROM samples")
def chat_supervision(spark, sf_dir):
    """Rendered conversations with expanded attachments and masked labels."""
    return supervision.supervised(_t(spark, sf_dir, "conversations")).select("conv_id", _csv("input_ids"), _csv("labels"))


@query(f"""WITH {_RENDER}, e AS (SELECT conv_id, unnest(input_ids) AS id, generate_subscripts(input_ids, 1) - 1 AS p FROM samples),
a AS (SELECT conv_id, p, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS nth FROM e WHERE id = 9)
SELECT conv_id, CAST(nth // (1 + conv_id % 4) AS BIGINT) AS ord, CAST(min(p) AS BIGINT) AS start, CAST(max(p) + 1 AS BIGINT) AS stop FROM a GROUP BY ALL""")
def token_ranges(spark, sf_dir):
    """Half-open token ranges of every attachment (T4)."""
    s = supervision.supervised(_t(spark, sf_dir, "conversations"))
    return s.select("conv_id", F.posexplode("token_ranges").alias("ord", "r")).select("conv_id", F.col("ord").cast("long").alias("ord"), "r.start", F.col("r.end").alias("stop"))


def _collated_sql(side: str) -> str:
    fill = "list_transform(range(w - len({c})), lambda i: CAST({v} AS BIGINT))"
    both = (lambda c, v: f"list_concat({c}, {fill.format(c=c, v=v)})") if side == "right" else (lambda c, v: f"list_concat({fill.format(c=c, v=v)}, {c})")
    pos = "list_concat(range(len(input_ids)), list_transform(range(w - len(input_ids)), lambda i: CAST(0 AS BIGINT)))" if side == "right" else "list_concat(list_transform(range(w - len(input_ids)), lambda i: CAST(0 AS BIGINT)), range(len(input_ids)))"
    return f"""WITH {_RENDER}, n AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS i FROM samples), b AS (SELECT *, i // 16 AS batch_id, i % 16 AS batch_idx, max(len(input_ids)) OVER (PARTITION BY i // 16) AS w FROM n)
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(batch_idx AS BIGINT) AS batch_idx, conv_id, array_to_string({both('input_ids', 0)}, ',') AS input_ids, array_to_string({both('labels', -100)}, ',') AS labels, array_to_string({pos}, ',') AS position_ids FROM b"""


@query(_collated_sql("right"))
def collate_right(spark, sf_dir):
    """Batches of 16, padded on the right, with position ids."""
    out = supervision.collated(supervision.supervised(_t(spark, sf_dir, "conversations")))
    return out.select("batch_id", "batch_idx", "conv_id", _csv("input_ids"), _csv("labels"), _csv("position_ids"))


@query(_collated_sql("left"))
def collate_left(spark, sf_dir):
    """The same padded on the left."""
    out = supervision.collated(supervision.supervised(_t(spark, sf_dir, "conversations")), side="left")
    return out.select("batch_id", "batch_idx", "conv_id", _csv("input_ids"), _csv("labels"), _csv("position_ids"))


@query("""WITH p AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS by_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 'mcq' AS data_source, 'assistant' AS role, text AS content, 'math' AS ability, 'rule' AS style, reply AS ground_truth, 'train' AS split FROM p WHERE role = 'user' AND by_role = 'assistant'""")
def rl_records(spark, sf_dir):
    """Reinforcement-learning records from answered user turns."""
    r = supervision.rl_records(_t(spark, sf_dir, "conversations"), "mcq", "train")
    return r.select("conv_id", "turn", "data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability", "reward_model.style", "reward_model.ground_truth", "split")


@query("SELECT conv_id, turn, CASE WHEN len(text) > 0 THEN CAST(len(lower(text)) - len(replace(lower(text), 'a', '')) AS DOUBLE) / len(text) ELSE 0 END AS score FROM conversations")
def letter_reward(spark, sf_dir):
    """Share of a letter as reward."""
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", X.letter_reward(F.col("text")).alias("score"))


@query("""WITH made AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role || ' no answer' WHEN 1 THEN 'x Answer: **' || text WHEN 2 THEN 'Answer: q Answer: ' || role ELSE text || 'Answer: A, or Answer: ' END AS said FROM conversations),
parts AS (SELECT conv_id, turn, string_split(replace(said, '**', ''), 'Answer: ') AS p FROM made)
SELECT conv_id, turn, CASE WHEN len(p) = 1 OR p[-1] = '' THEN '?' ELSE p[-1][1] END AS answer FROM parts""")
def answer_extraction(spark, sf_dir):
    """The character after the last answer mark (X1, X2) of generations made from turns."""
    t = _t(spark, sf_dir, "conversations")
    made = F.when(F.col("turn") % 4 == 0, F.concat("role", F.lit(" no answer"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("x Answer: **"), "text"))
    made = made.when(F.col("turn") % 4 == 2, F.concat(F.lit("Answer: q Answer: "), "role")).otherwise(F.concat("text", F.lit("Answer: A, or Answer: ")))
    return t.select("conv_id", "turn", X.extract_answer(made).alias("answer"))


@query("""SELECT b.item_id, chr(10) || '"' || b.text || chr(10) || 'A. yes' || chr(10) || 'B. no' || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'C. both' ELSE '' END AS prompt, CAST(CASE WHEN item_id % 2 = 0 THEN 3 ELSE 2 END AS INT) AS n_options FROM benchmark b""")
def mcq_prompts(spark, sf_dir):
    """Multiple-choice prompts with the options that aren't null."""
    b = _t(spark, sf_dir, "benchmark").withColumn("c", F.when(F.col("item_id") % 2 == 0, "both"))
    return b.select("item_id", X.mcq_prompt(F.col("text"), [("A", F.lit("yes")), ("B", F.lit("no")), ("C", F.col("c"))]).alias("prompt"), F.when(F.col("c").isNull(), 2).otherwise(3).alias("n_options"))


@query("""WITH r AS (SELECT doc_id % 5 <> 0 AS answered, doc_id % 5 <> 0 AND quality = toxic AS hit, 4 + doc_id % 2 AS n FROM labels)
SELECT count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE) AS accuracy, count(*) FILTER (WHERE hit) / CAST(count(*) FILTER (WHERE answered) AS DOUBLE) AS precision_, avg(1.0 / CAST(n AS DOUBLE)) AS baseline FROM r""")
def answer_accuracy(spark, sf_dir):
    """Accuracy, precision over the answered and the guessing baseline (A5-A7); a fifth of the rows has no answer."""
    rows = _t(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 5 == 0, "?").otherwise(F.col("toxic").cast("string")).alias("a"), F.col("quality").cast("string").alias("t"), (4 + F.col("doc_id") % 2).alias("n"))
    return evaluation.answer_metrics(rows, "a", "t", "n").withColumnRenamed("precision", "precision_")


_REPORT = """WITH s AS (SELECT unnest([0, 1, 2]) AS label), c AS (SELECT label, count(*) FILTER (WHERE quality = label AND toxic = label) AS hit, count(*) FILTER (WHERE toxic = label) AS said, count(*) FILTER (WHERE quality = label) AS support FROM s, labels GROUP BY label),
r AS (SELECT label, coalesce(hit / nullif(said, 0), 0.0) AS "precision", coalesce(hit / nullif(support, 0), 0.0) AS recall, support FROM c), f AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0.0) AS f1 FROM r)"""


@query(f"{_REPORT} SELECT label, round(\"precision\", 9) AS \"precision\", round(recall, 9) AS recall, support, round(f1, 9) AS f1 FROM f")
def classification_report(spark, sf_dir):
    """Per-class precision, recall, F1 and support over fixed labels."""
    r = evaluation.classification_report(_t(spark, sf_dir, "labels"), "quality", "toxic", [0, 1, 2])
    return r.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"{_REPORT} SELECT round(avg(\"precision\"), 9) AS macro_precision, round(avg(f1), 9) AS macro_f1, round(sum(recall * support) / sum(support), 9) AS weighted_recall, CAST(sum(support) AS BIGINT) AS support FROM f")
def report_averages(spark, sf_dir):
    """Macro and weighted means of the report."""
    r = evaluation.report_averages(evaluation.classification_report(_t(spark, sf_dir, "labels"), "quality", "toxic", [0, 1, 2]))
    return r.select(*(F.round(c, 9).alias(c) for c in ("macro_precision", "macro_f1", "weighted_recall")), "support")


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM events")
def running_mean(spark, sf_dir):
    """Running mean in a group (A10)."""
    return evaluation.running_mean(_t(spark, sf_dir, "events"), "value", "user_id", "event_id").select("user_id", "event_id", F.round("running_mean", 6).alias("running_mean"))


@query("""WITH r AS (SELECT event_id, sum(CAST(value AS DECIMAL(18, 4))) OVER w AS s, count(value) OVER w AS n FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CAST(s AS DOUBLE) AS running_sum, n AS running_count, CAST(s AS DOUBLE) / n AS running_mean FROM r""")
def running_totals(spark, sf_dir):
    """Running sum, count and mean over all events as one group, in exact decimals (A10)."""
    e = _t(spark, sf_dir, "events").select("event_id", "value")
    r = running.running(e, "value", None, F.col("event_id"), stretch=4096, exact="decimal(18,4)")
    return r.select("event_id", F.col("running_sum").cast("double").alias("running_sum"), "running_count", "running_mean")


@query("SELECT round(avg(m), 6) AS mean FROM (SELECT avg(value) AS m FROM events GROUP BY event_id // 64)")
def mean_of_batch_means(spark, sf_dir):
    """Unweighted mean of batch means."""
    e = _t(spark, sf_dir, "events").withColumn("b", F.floor(F.col("event_id") / 64))
    return evaluation.mean_of_batch_means(e, "value", "b").select(F.round("mean", 6).alias("mean"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format(k='doc_id')}, doc_id) - 1 AS \"index\" FROM documents")
def seeded_shuffle(spark, sf_dir):
    """Seeded order with a dense index."""
    return indexing.shuffled(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT CAST(floor(n * 0.7) AS BIGINT) AS a, CAST(floor(n * 0.2) AS BIGINT) AS b, CAST(floor(n * 0.1) AS BIGINT) AS c, n FROM n),
z AS (SELECT a + CASE WHEN n - a - b - c > 0 THEN 1 ELSE 0 END AS a, b + CASE WHEN n - a - b - c > 1 THEN 1 ELSE 0 END AS b FROM s), o AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format(k='doc_id')}, doc_id) - 1 AS i FROM documents)
SELECT doc_id, CASE WHEN i < a THEN 'train' WHEN i < a + b THEN 'test' ELSE 'val' END AS split FROM o, z""")
def three_way_split(spark, sf_dir):
    """Seeded split into 0.7, 0.2 and 0.1."""
    return indexing.split(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", [("train", 0.7), ("test", 0.2), ("val", 0.1)])


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i >= (n // 7) * 2 + least(2, n % 7) AND i < (n // 7) * 3 + least(3, n % 7)""")
def contiguous_shard(spark, sf_dir):
    """Shard 2 of 7 in order."""
    return indexing.shard(_t(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 7, 2)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 7 = 2")
def strided_shard(spark, sf_dir):
    """Every seventh row from the third on."""
    return indexing.shard(_t(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 7, 2, contiguous=False)


@query("""WITH d AS (SELECT i AS draw, CAST(('0x' || left(md5('42-' || i), 8)) AS BIGINT) / 4294967296.0 AS u FROM (SELECT unnest(range(CAST((SELECT count(*) + 1 FROM documents) AS BIGINT))) AS i)),
s AS (SELECT draw, CASE WHEN u < CAST(0.5 AS DOUBLE) THEN 'en' WHEN u < CAST(0.75 AS DOUBLE) THEN 'fr' WHEN u < CAST(0.875 AS DOUBLE) THEN 'de' ELSE 'es' END AS source_name FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY draw) - 1 AS nth FROM s),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS nth, count(*) OVER (PARTITION BY lang) AS c FROM documents),
stop AS (SELECT min(draw) AS stop FROM n JOIN (SELECT DISTINCT lang, c FROM r) x ON x.lang = n.source_name WHERE nth = c - 1)
SELECT r.doc_id, n.source_name, n.draw FROM n JOIN r ON r.lang = n.source_name AND r.nth = n.nth, stop WHERE n.draw <= stop""")
def weighted_interleave(spark, sf_dir):
    """Interleave all languages by weights 4 : 2 : 1 : 1 up to the draw that takes the last row of one."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    sources = [(x, d.where(F.col("lang") == x), w) for x, w in (("en", 4.0), ("fr", 2.0), ("de", 1.0), ("es", 1.0))]
    return mixing.interleave(sources, "doc_id").select("doc_id", "source_name", "draw")


@query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 20")
def class_cap(spark, sf_dir):
    """First 20 rows of each class."""
    return mixing.cap_per_class(_t(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 20)


@query(f"SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_HASH.format(k='doc_id')}, doc_id) AS n FROM labels) WHERE n <= (SELECT count(*) FROM labels WHERE quality = 0)")
def class_balance(spark, sf_dir):
    """Classes sampled down to the size of class 0."""
    return mixing.balance(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 0)


@query("SELECT doc_id, toxic AS v FROM labels UNION ALL SELECT doc_id, quality AS v FROM labels")
def concatenation(spark, sf_dir):
    """All rows of two tables."""
    lab = _t(spark, sf_dir, "labels")
    return mixing.concat([lab.select("doc_id", F.col("toxic").alias("v")), lab.select("doc_id", F.col("quality").alias("v"))])


@query("SELECT doc_id, arg_max(v, o) AS v FROM (SELECT doc_id, toxic AS v, 0 AS o FROM labels UNION ALL SELECT doc_id, quality + 5 AS v, 1 AS o FROM labels WHERE doc_id % 2 = 0) GROUP BY doc_id")
def last_wins(spark, sf_dir):
    """The last row of a key wins."""
    lab = _t(spark, sf_dir, "labels")
    rows = lab.select("doc_id", F.col("toxic").alias("v"), F.lit(0).alias("o")).unionByName(lab.where("doc_id % 2 = 0").select("doc_id", (F.col("quality") + 5).alias("v"), F.lit(1).alias("o")))
    return mixing.last_wins(rows, "doc_id", "o").select("doc_id", "v")


_SAMPLES = """m AS (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN [doc_id] ELSE [doc_id, doc_id - 1] END) AS value, generate_subscripts(CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN [doc_id] ELSE [doc_id, doc_id - 1] END, 1) AS pos FROM documents)"""


def _samples(spark, sf_dir):
    item = lambda v: F.struct(F.lit("image").alias("type"), v.cast("string").alias("value"))
    none = F.filter(F.array(item(F.col("doc_id"))), lambda x: F.lit(False))
    return _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, none).when(F.col("doc_id") % 3 == 1, F.array(item(F.col("doc_id")))).otherwise(F.array(item(F.col("doc_id")), item(F.col("doc_id") - 1))).alias("modalities"))


@query(f"WITH {_SAMPLES}, j AS (SELECT m.doc_id, string_agg(coalesce(CAST(l.quality AS VARCHAR), '-'), ',' ORDER BY pos) AS payloads FROM m LEFT JOIN labels l ON l.doc_id = m.value GROUP BY m.doc_id) SELECT d.doc_id, coalesce(payloads, '') AS payloads FROM documents d LEFT JOIN j USING (doc_id)")
def registry_merge(spark, sf_dir):
    """Attachments looked up in a registry, order and empty lists kept."""
    reg = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), F.col("quality").cast("string").alias("payload"))
    merged = modalities.merge_registry(_samples(spark, sf_dir), reg)
    return merged.select("doc_id", F.array_join(F.transform("modalities", lambda m: F.coalesce(m["value"], F.lit("-"))), ",").alias("payloads"))


@query(f"WITH {_SAMPLES} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT m.doc_id FROM m LEFT JOIN labels l ON l.doc_id = m.value WHERE coalesce(l.quality, 0) < 1)")
def valid_samples(spark, sf_dir):
    """Samples whose attachments are all there and valid; those without any stay."""
    reg = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), (F.col("quality") + 1).alias("height"))
    return modalities.valid_samples(_samples(spark, sf_dir), reg).select("doc_id")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, list_max(v) AS top, list_position(v, list_max(v)) - 1 AS argmax, v FROM e)
SELECT vec_id, round(n, 6) AS norm, CAST(argmax AS INT) AS argmax, round(exp(top - top) / list_sum(list_transform(v, lambda x: exp(x - top))), 6) AS top_softmax, round(top + ln(list_sum(list_transform(v, lambda x: exp(x - top)))) - v[1], 6) AS loss, round(list_max(list_transform(v, lambda x: x / top)), 6) AS scaled FROM n""")
def vector_functions(spark, sf_dir):
    """Norm, argmax, softmax, cross-entropy and division by the maximum."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select(
        "vec_id", F.round(F.sqrt(V.dot(F.col("v"), F.col("v"))), 6).alias("norm"), V.argmax(F.col("v")).alias("argmax"), F.round(F.array_max(V.softmax(F.col("v"))), 6).alias("top_softmax"),
        F.round(V.cross_entropy(F.col("v"), F.lit(0)), 6).alias("loss"), F.round(F.array_max(V.divide_by_max(F.col("v"))), 6).alias("scaled"),
    )


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS n FROM e)
SELECT vec_id, CAST(n AS INT) AS n, CAST(i AS INT) AS i FROM r WHERE n <= 3""")
def top_k(spark, sf_dir):
    """Three largest values of each vector."""
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(V.top_k(F.col("embedding"), 3)).alias("n", "s")).select("vec_id", (F.col("n") + 1).alias("n"), F.col("s.index").alias("i"))


@query("""WITH e AS (SELECT vec_id // 16 AS b, vec_id % 16 AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT x.b, x.i, y.i AS j, list_dot_product(x.v, list_transform(y.v, lambda e, k: e * (k % 3))) * 10 AS s FROM e x JOIN e y USING (b)),
c AS (SELECT b, ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) AS l FROM s GROUP BY b, i UNION ALL SELECT b, ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) AS l FROM s GROUP BY b, j) SELECT b AS batch, round(avg(l), 6) AS loss FROM c GROUP BY b""")
def contrastive_loss(spark, sf_dir):
    """Contrastive loss of batches of 16 vectors against scaled ones, mean of rows and columns."""
    e = _t(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("batch"), (F.col("vec_id") % 16).alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    e = e.withColumn("r", F.transform("v", lambda x, k: x * ((k + 1) % 3)))
    s = evaluation.batch_similarity(e, "batch", "i", "v", "r", 10.0)
    return evaluation.contrastive_loss(s, "batch").select("batch", F.round("loss", 6).alias("loss"))


@query("SELECT page_id, replace(url, '_', '-') AS kebab, regexp_replace(url, '^.*/', '') AS base, CASE WHEN starts_with(url, '/') THEN url ELSE '/b/' || url END AS joined, CASE WHEN contains(url, '1') THEN 0 WHEN contains(url, '2') THEN 1 ELSE 2 END AS label FROM (SELECT page_id, lower(url) AS url FROM pages)")
def path_functions(spark, sf_dir):
    """Names, joins and priority labels of paths."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("url"))
    return p.select("page_id", X.kebab(F.col("url")).alias("kebab"), X.base_name(F.col("url")).alias("base"), X.join_path(F.lit("/b"), F.col("url")).alias("joined"), X.first_match(F.col("url"), [("1", 0), ("2", 1)], 2).alias("label"))


@query(f"""WITH {_RENDER}, c AS (SELECT conv_id, input_ids[1:32] AS ids, labels[1:32] AS lab FROM samples) SELECT conv_id, {_CSV.format(c='ids')} AS input_ids, {_CSV.format(c='lab')} AS labels,
array_to_string(list_transform(ids, lambda x: 1), ',') AS attention_mask, array_to_string(range(len(ids)), ',') AS position_ids FROM c""")
def truncated_rows(spark, sf_dir):
    """Ids, labels, mask and positions cut to one length together."""
    s = T.truncated(supervision.supervised(_t(spark, sf_dir, "conversations")).withColumn("position_ids", T.position_ids(F.col("attention_mask"))), 32)
    return s.select("conv_id", *(_csv(c) for c in T.SEQUENCES))


@query(f"WITH {_RENDER} SELECT conv_id, CAST(len(input_ids) AS BIGINT) AS n_tokens, CAST(len(list_filter(labels, lambda x: x <> -100)) AS BIGINT) AS n_trained, {_CSV.format(c='input_ids[1:32]')} AS head FROM samples")
def truncated_samples(spark, sf_dir):
    """Lengths, trained tokens and the right-truncated ids."""
    s = supervision.supervised(_t(spark, sf_dir, "conversations"))
    return s.select("conv_id", F.size("input_ids").cast("long").alias("n_tokens"), F.size(F.filter("labels", lambda x: x != T.IGNORE)).cast("long").alias("n_trained"), F.array_join(F.transform(T.truncate(F.col("input_ids"), 32), lambda x: x.cast("string")), ",").alias("head"))
