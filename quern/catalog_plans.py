"""Registered queries of tokenisation, batches, attachments, captions, evaluation and scalar functions, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .catalog import _HASH, _RENDER, _csv, _t, query
from .functions import common as C
from .functions import text as X
from .functions import vectors as V
from .operators import batched, evaluation, indexing, mixing, modalities
from .plans import captions, supervision
from .plans import tokenization as K
from .sources.readers import spread
from .sources.scratch import Stored

MARK = "<|attachment|>"


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_md5 = lambda c: F.md5(c.cast("binary"))
_narrow = lambda ids: (F.col(ids) if isinstance(ids, str) else ids).cast("array<int>")  # noqa: E731 - half the bytes on the way to Python
_NONE = "array<struct<type:string,value:string,num_embeddings:bigint>>"


def _digests(tokenised, template, *keys):
    """Keys, md5 of the decoded text and of its trained part, and the number of ignored tokens."""
    tok = K.Tokens(_vocabulary(), (*template.extra, MARK))
    tokenised = Stored(tokenised.select(*keys, "input_ids", "labels"), "tokenised").df
    trained = F.transform(F.filter(F.arrays_zip("input_ids", "labels"), lambda x: x["labels"] != -100), lambda x: x["input_ids"])
    ignored = F.size(F.filter("labels", lambda x: x == -100)).cast("long")
    texts = tok.decode_each({"text": _narrow("input_ids"), "trained": _narrow(trained)}, False)
    return tokenised.select(*keys, _md5(texts["text"]).alias("text"), _md5(texts["trained"]).alias("trained"), ignored.alias("n_ignored"))


def _llama_sql(keep: str = "true") -> str:
    turn = f"'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(text, '{K.WHITE_SPACE}') || '<|eot_id|>'"
    return f"'<|begin_of_text|>' || coalesce(string_agg({turn}, '' ORDER BY turn) FILTER (WHERE {keep}), '')"


@query(f"SELECT conv_id, md5({_llama_sql()}) AS text, md5({_llama_sql("role = 'assistant'")}) AS trained FROM conversations GROUP BY conv_id")
def chat_llama(spark, sf_dir):
    """Header templates with a real vocabulary: what is decoded, and what is trained after masking."""
    c = supervision.conversations_of(_t(spark, sf_dir, "conversations"))
    c = c.select("conv_id", F.lit(None).cast("string").alias("text"), "messages", F.lit(None).cast(_NONE).alias("modalities"))
    return _digests(K.tokenize_samples(c, _vocabulary(), K.LLAMA, MARK), K.LLAMA, "conv_id").drop("n_ignored")


@query(f"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN 'developer' ELSE role END AS role, text FROM conversations),
o AS (SELECT *, CASE role WHEN 'system' THEN 61 WHEN 'developer' THEN 63 WHEN 'user' THEN 65 ELSE 67 END AS n FROM t), p AS (SELECT *, '<SPECIAL_' || n || '>' || trim(text, '{K.WHITE_SPACE}') || '<SPECIAL_' || (n + 1) || '>' AS piece FROM o)
SELECT conv_id, md5('<s>' || string_agg(piece, '' ORDER BY turn)) AS text, md5('<s>' || coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS trained FROM p GROUP BY conv_id""")
def chat_apertus(spark, sf_dir):
    """Special-token templates with system, developer and user spans masked."""
    t = _t(spark, sf_dir, "conversations").withColumn("role", F.when((F.col("role") == "system") & (F.col("conv_id") % 2 == 0), "developer").otherwise(F.col("role")))
    c = supervision.conversations_of(t).select("conv_id", F.lit(None).cast("string").alias("text"), "messages", F.lit(None).cast(_NONE).alias("modalities"))
    return _digests(K.tokenize_samples(c, _vocabulary(), K.APERTUS, MARK), K.APERTUS, "conv_id").drop("n_ignored")


@query(f"""SELECT 'd' || doc_id AS key, md5(CASE WHEN doc_id % 3 = 1 THEN '{MARK}{MARK}' ELSE '' END || text) AS text, md5(text) AS trained, CAST(CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS BIGINT) AS n_ignored FROM documents
UNION ALL SELECT 'c' || conv_id, md5({_llama_sql()}), md5({_llama_sql("role = 'assistant'")}), NULL FROM conversations GROUP BY conv_id""")
def mixed_samples(spark, sf_dir):
    """Texts and conversations in one table, told apart by row and kept together by key."""
    one = F.array(F.struct(F.lit("image").alias("type"), F.lit("v").alias("value"), F.lit(2).cast("long").alias("num_embeddings")))
    marked = F.col("doc_id") % 3 == 1
    d = spread(_t(spark, sf_dir, "documents")).select(F.concat(F.lit("d"), "doc_id").alias("key"), F.when(marked, F.concat(F.lit(MARK), "text")).otherwise(F.col("text")).alias("text"), F.when(marked, one).alias("modalities"))
    c = supervision.conversations_of(_t(spark, sf_dir, "conversations")).select(F.concat(F.lit("c"), "conv_id").alias("key"), "messages")
    out = _digests(K.tokenize_samples(mixing.concat([d, c]), _vocabulary(), K.LLAMA, MARK), K.LLAMA, "key")
    return out.withColumn("n_ignored", F.when(F.startswith("key", F.lit("d")), F.col("n_ignored")))


@query("SELECT doc_id, md5(text) AS decoded FROM documents")
def token_round_trip(spark, sf_dir):
    """Whole texts to ids and back."""
    tok = K.Tokens(_vocabulary())
    d = spread(_t(spark, sf_dir, "documents").select("doc_id", "text"), 4)
    return d.select("doc_id", _md5(tok.decode(tok.encode(F.col("text"), chained=True), chained=True)).alias("decoded"))


@query("SELECT conv_id, turn, unicode(text) - 33 AS first_id FROM conversations WHERE unicode(text) BETWEEN 33 AND 126")
def token_lookup(spark, sf_dir):
    """Ids of tokens by a join with the vocabulary; its first ids are the visible ASCII characters in order."""
    t = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.left("text", F.lit(1)).alias("token"))
    found = t.join(F.broadcast(K.Tokens(_vocabulary()).vocabulary(spark)), "token").where(F.ascii("token").between(33, 126))
    return found.select("conv_id", "turn", F.col("id").cast("int").alias("first_id"))


_BYTE = "CASE WHEN b <= 32 THEN 256 + b WHEN b BETWEEN 127 AND 160 THEN 162 + b WHEN b = 173 THEN 323 ELSE b END"


@query(f"""WITH b AS (SELECT conv_id, turn, list_transform(range(octet_length(encode(text))), lambda i: CAST(('0x' || substr(hex(encode(text)), 2 * i + 1, 2)) AS INT)) AS bs FROM conversations)
SELECT conv_id, turn, md5(array_to_string(list_transform(bs, lambda b: chr({_BYTE})), '')) AS tokens, TRUE AS same FROM b WHERE len(bs) > 0""")
def vocabulary_lookup(spark, sf_dir):
    """Every token of whole texts by joins with the vocabulary: ids to tokens, which spell the text in the vocabulary's letters, and tokens back to ids."""
    tok = K.Tokens(_vocabulary())
    words = F.broadcast(tok.vocabulary(spark))  # a vocabulary has a fixed size
    ids = Stored(_t(spark, sf_dir, "conversations").select("conv_id", "turn", tok.encode(F.col("text")).alias("ids")), "ids").df.select("conv_id", "turn", F.posexplode("ids").alias("pos", "id"))
    there = ids.join(words, "id").join(words.withColumnRenamed("id", "back"), "token")
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "")
    return there.groupBy("conv_id", "turn").agg(_md5(spelt).alias("tokens"), F.bool_and(F.col("id") == F.col("back")).alias("same"))


@query(f"SELECT conv_id, md5({_llama_sql("role <> 'assistant'")} || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)) AS text, CAST(0 AS BIGINT) AS n_trained FROM conversations GROUP BY conv_id")
def chat_prompts(spark, sf_dir):
    """Conversations without the replies, ended by the tag that asks for one: nothing is trained."""
    c = supervision.conversations_of(_t(spark, sf_dir, "conversations"))
    asked = F.filter("messages", lambda m: m["role"] != "assistant")
    c = c.select("conv_id", F.lit(None).cast("string").alias("text"), asked.alias("messages"), F.lit(None).cast(_NONE).alias("modalities"))
    made = Stored(K.tokenize_samples(c, _vocabulary(), K.LLAMA, MARK, generation_prompt=True), "prompts").df
    tok, ends = K.Tokens(_vocabulary(), (*K.LLAMA.extra, MARK)), len(K.Tokens(_vocabulary(), (*K.LLAMA.extra, MARK)).ids_of(K.LLAMA.generation)) + 1
    trained = F.size(F.filter("labels", lambda x: x != -100)) - ends  # the text's own first token and the tag that asks
    return made.select("conv_id", _md5(tok.decode(_narrow("input_ids"), False)).alias("text"), trained.cast("long").alias("n_trained"))


_PLACES = f"""WITH {_RENDER}, n AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS i FROM samples),
b AS (SELECT conv_id, CAST(i // 16 AS BIGINT) AS batch_id, i % 16 AS batch_idx, input_ids, max(len(input_ids)) OVER (PARTITION BY i // 16) - len(input_ids) AS gap FROM n),
e AS (SELECT conv_id, batch_id, batch_idx, unnest(input_ids) AS id, generate_subscripts(input_ids, 1) - 1 + gap AS position FROM b),
a AS (SELECT conv_id, batch_id, batch_idx, CAST(position AS BIGINT) AS position, (row_number() OVER (PARTITION BY conv_id ORDER BY position) - 1) // (1 + conv_id % 4) AS nth FROM e WHERE id = 9),
p AS (SELECT *, CASE WHEN nth % 2 = 0 THEN 'image' ELSE 'volume' END AS type, conv_id || '-' || nth AS value FROM a)"""


def _batched(spark, sf_dir):
    s = supervision.supervised(_t(spark, sf_dir, "conversations"))
    item = lambda r, i: F.struct(F.when(i % 2 == 0, "image").otherwise("volume").alias("type"), F.concat(F.col("conv_id"), F.lit("-"), i).alias("value"), (r["end"] - r["start"]).alias("num_embeddings"))
    rows = K.padded(s.withColumn("modalities", F.transform("token_ranges", item)), "conv_id", 16, "left")
    return K.with_ranges(rows, supervision.ATTACHMENT)


@query(f"{_PLACES} SELECT conv_id, CAST(nth AS INT) AS nth, min(position) AS start, max(position) + 1 AS stop FROM p GROUP BY conv_id, nth")
def padded_ranges(spark, sf_dir):
    """Token ranges of attachments after padding on the left."""
    return _batched(spark, sf_dir).select("conv_id", F.posexplode("modalities").alias("nth", "m")).select("conv_id", "nth", "m.token_range.start", F.col("m.token_range.end").alias("stop"))


@query(f"{_PLACES} SELECT batch_id, type, CAST(batch_idx AS BIGINT) AS batch_idx, CAST(nth AS INT) AS nth, position FROM p")
def embedding_places(spark, sf_dir):
    """A row for every place an attachment's embeddings take, by type."""
    return K.positions_by_type(_batched(spark, sf_dir))


@query(f"{_PLACES} SELECT batch_id, type, string_agg(value, ',' ORDER BY batch_idx, nth) AS \"values\" FROM (SELECT DISTINCT batch_id, batch_idx, nth, type, value FROM p) GROUP BY batch_id, type")
def stacked_values(spark, sf_dir):
    """Attachments of each type in a batch, in order (A1)."""
    return K.stacks(_batched(spark, sf_dir)).select("batch_id", "type", F.array_join("values", ",").alias("values"))


@query(f"{_PLACES} SELECT batch_id, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM p GROUP BY batch_id")
def batch_types(spark, sf_dir):
    """Distinct types of a batch (A2)."""
    return K.batch_types(_batched(spark, sf_dir)).select("batch_id", F.array_join("types", ",").alias("types"))


@query("""SELECT vec_id // 64 AS batch_id, vec_id % 64 // 8 AS batch_idx, vec_id % 8 AS position, CASE WHEN label = 0 THEN embedding[2] * 2 ELSE CAST(embedding[1] AS DOUBLE) END AS x FROM embeddings""")
def scattered_embeddings(spark, sf_dir):
    """Embeddings put over tokens at their places."""
    at = lambda e: e.select((F.col("vec_id") / 64).cast("long").alias("batch_id"), (F.col("vec_id") % 64 / 8).cast("long").alias("batch_idx"), (F.col("vec_id") % 8).alias("position"), "vector")
    e = _t(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    put = e.where("label = 0").withColumn("vector", F.array((F.col("embedding")[1] * 2).cast("double")))
    return K.scatter(at(e.withColumn("vector", F.slice("v", 1, 1))), at(put)).select("batch_id", "batch_idx", "position", F.col("vector")[0].alias("x"))


@query("""WITH p AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS by_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'conversations' AS data_source, 'assistant' AS role, text AS content, 'math' AS ability, 'rule' AS style, reply AS ground_truth, reply AS response, 'train' AS split, row_number() OVER (ORDER BY conv_id, turn) - 1 AS "index" FROM p WHERE role = 'user' AND by_role = 'assistant'""")
def rl_map(spark, sf_dir):
    """Reinforcement-learning records with split and row number, the response beside them."""
    pairs = indexing.with_index(supervision.answered_turns(_t(spark, sf_dir, "conversations")), F.col("conv_id"), "turn", name="nth")
    r = supervision.rl_map(pairs, "conversations", "train", "nth")
    return r.select("data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability", "reward_model.*", "response", "extra_info.*")


@query("""SELECT item_id, '/img/' || item_id || '.jpg' AS image, md5(chr(10) || '"<|reserved_special_token_0|> ' || text || chr(10) || 'A. yes' || chr(10) || 'B. no' || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'E. both' ELSE '' END || chr(10)
|| 'Let''s think step by step. Detail your reasoning before answering carefully. Your final answer should have the following format:' || chr(10) || chr(10) || '<reasoning leading to the answer>' || chr(10) || 'Answer: <letter>' || chr(10) || chr(10) || 'The <letter> is chosen amongst the possible options (A, B, C, D or E)' || chr(10)) AS request,
CAST(CASE WHEN item_id % 2 = 0 THEN 5 ELSE 4 END AS INT) AS n_options FROM benchmark""")
def mcq_requests(spark, sf_dir):
    """Whole multiple-choice requests, image paths and numbers of options."""
    b = _t(spark, sf_dir, "benchmark").withColumn("e", F.when(F.col("item_id") % 2 == 0, "both"))
    request = X.mcq_request(F.col("text"), [("A", F.lit("yes")), ("B", F.lit("no")), ("E", F.col("e"))])
    return b.select("item_id", X.image_path(F.lit("/img"), F.col("item_id")).alias("image"), _md5(request).alias("request"), X.option_count(F.col("e")).alias("n_options"))


def _captioned(spark, sf_dir):
    item = lambda v: F.struct(F.lit("image").alias("type"), v.alias("value"))
    return _t(spark, sf_dir, "pages").select("page_id", F.array(item(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/abs/"), "page_id")).otherwise(F.concat(F.lit("p"), "page_id")))).alias("modalities"), F.concat(F.lit("<attachment>"), "url", F.lit(" <attachment>")).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/abs/' ELSE 'data/p' END || page_id AS image_path, url || ' ' AS caption FROM pages")
def caption_pairs(spark, sf_dir):
    """First image's path and cleaned caption, all else dropped."""
    return captions.caption_pairs(_captioned(spark, sf_dir), "data/set.jsonl", keep=("page_id",))


@query("""WITH w AS (SELECT page_id, list_transform(list_filter(string_split(replace(html, '<', ' <'), ' '), lambda w: w <> ''), lambda w: CAST(('0x' || left(md5(w), 7)) AS BIGINT) + 1000)[1:128] AS ids FROM pages)
SELECT page_id, array_to_string(list_concat(ids, list_transform(range(128 - len(ids)), lambda i: CAST(0 AS BIGINT))), ',') AS input_ids, CAST(least(128, len(ids)) AS BIGINT) AS n FROM w""")
def caption_tokens(spark, sf_dir):
    """Captions cut and padded to one length."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.lit("x").alias("image_path"), F.replace("html", F.lit("<"), F.lit(" <")).alias("caption"))
    t = captions.tokenized_captions(p, supervision.word_ids)
    return t.select("page_id", _csv("input_ids"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))


_TYPED = """m AS (SELECT doc_id, unnest(range(doc_id % 4)) AS i FROM documents)"""


def _typed(spark, sf_dir):
    item = lambda i: F.struct(
        F.when(i % 2 == 0, "image").otherwise("volume").alias("type"), (F.col("doc_id") + i).cast("string").alias("value"),
        F.when(i == 0, F.col("doc_id") % 7).alias("num_embeddings"), F.lit("gone").alias("note"),
    )
    some = F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4 - 1), item)
    return _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, some).alias("modalities"))


@query(f"WITH {_TYPED} SELECT doc_id, string_agg(CASE WHEN i = 0 THEN doc_id % 7 WHEN i % 2 = 0 THEN 256 ELSE 2048 END, ',' ORDER BY i) AS counts, string_agg(CASE WHEN i % 2 = 0 THEN 'clip' ELSE 'cube' END, ',' ORDER BY i) AS processors FROM m GROUP BY doc_id")
def type_tables(spark, sf_dir):
    """Numbers of embeddings and processors by type."""
    kinds = modalities.distinct_types(["image", "volume"])
    counts = modalities.embedding_counts(F.col("modalities"), dict(zip(kinds, (256, V.VOLUME_PATCHES), strict=True)))
    s = _typed(spark, sf_dir).where("modalities is not null")
    return s.select("doc_id", F.array_join(F.transform(counts, lambda x: x.cast("string")), ",").alias("counts"), F.array_join(modalities.looked_up_types(F.col("modalities"), {"image": "clip", "volume": "cube"}), ",").alias("processors"))


@query(f"WITH {_TYPED} SELECT doc_id, string_agg(CASE WHEN i % 2 = 0 THEN 'i' || (doc_id + i) ELSE 'v' || (doc_id + i) END, ',' ORDER BY i) AS \"values\" FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id")
def processed_attachments(spark, sf_dir):
    """Attachments processed by their type's function, in place."""
    done = modalities.process_by_type(_typed(spark, sf_dir), {"image": lambda v: F.concat(F.lit("i"), v), "volume": lambda v: F.concat(F.lit("v"), v)})
    return done.select("doc_id", F.array_join(F.transform("modalities", lambda m: m["value"]), ",").alias("values"))


@query(f"WITH {_TYPED} SELECT doc_id, string_agg(doc_id + i, ',' ORDER BY i) FILTER (WHERE i % 2 = 0) AS images FROM m GROUP BY doc_id")
def image_lists(spark, sf_dir):
    """Values of the attachments of one type."""
    s = _typed(spark, sf_dir).where("modalities is not null")
    return s.select("doc_id", F.array_join(captions.image_paths(F.col("modalities")), ",").alias("images"))


@query(f"WITH {_TYPED}, j AS (SELECT m.doc_id, string_agg(CASE WHEN i % 2 = 0 THEN 'image' ELSE 'volume' END || ':' || length(d.text) || ':' || coalesce(CASE WHEN i = 0 THEN CAST(m.doc_id % 7 AS VARCHAR) END, '-'), ',' ORDER BY i) AS l FROM m JOIN documents d ON d.doc_id = (m.doc_id + i) % (SELECT count(*) FROM documents) GROUP BY m.doc_id) SELECT doc_id, l FROM documents LEFT JOIN j USING (doc_id)")
def strict_registry(spark, sf_dir):
    """Attachments looked up strictly; only the allowed fields stay, a null list stays null."""
    d = _t(spark, sf_dir, "documents")
    n = d.count()
    s = _typed(spark, sf_dir).withColumn("modalities", F.transform("modalities", lambda m: m.withField("value", (m["value"].cast("long") % n).cast("string"))))
    registry = d.select(F.col("doc_id").cast("string").alias("path"), F.length("text").alias("payload"), F.lit(9).alias("height"))
    merged = modalities.merge_registry(modalities.check_if(s, True, registry), registry, strict=True)
    shown = lambda m: F.concat_ws(":", m["type"], m["value"].cast("string"), F.coalesce(m["num_embeddings"].cast("string"), F.lit("-")))
    return merged.select("doc_id", F.array_join(F.transform("modalities", shown), ",").alias("l"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, quality FROM labels), b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, label % 2 AS t FROM embeddings)
SELECT a.i AS "index", a.quality, CAST(b.t AS INT) AS t FROM a JOIN b USING (i)""")
def positional_join(spark, sf_dir):
    """Rows of two tables side by side by place, as far as the shorter goes."""
    a, b = _t(spark, sf_dir, "labels").select("doc_id", "quality"), _t(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).cast("int").alias("t"))
    return indexing.zip_rows(a, b, F.col("doc_id"), F.col("vec_id")).select("index", "quality", "t")


@query("SELECT count(*) FILTER (WHERE label = 0) AS healthy, count(*) FILTER (WHERE label = 1) AS ill, count(*) AS total FROM embeddings")
def label_counts(spark, sf_dir):
    """Rows of each label, and all (A4)."""
    return evaluation.label_counts(_t(spark, sf_dir, "embeddings"), "label", {"healthy": 0, "ill": 1})


@query("SELECT conv_id, bool_and(role <> 'system') AS finished FROM conversations GROUP BY conv_id")
def all_finished(spark, sf_dir):
    """Whether all of a group is finished."""
    return evaluation.all_finished(_t(spark, sf_dir, "conversations").withColumn("f", F.col("role") != "system"), "conv_id", "f")


@query("SELECT count(*) AS before, count(*) FILTER (WHERE n_chars > 500) AS after, count(*) - count(*) FILTER (WHERE n_chars > 500) AS dropped FROM documents")
def filter_counts(spark, sf_dir):
    """Rows before and after a filter."""
    return evaluation.counted_filter(_t(spark, sf_dir, "documents"), F.col("n_chars") > 500)


@query("SELECT count(*) AS before, count(*) FILTER (WHERE n_chars > 500) AS after, CAST(sum(CASE WHEN n_chars > 500 THEN length(text) END) AS BIGINT) AS chars FROM documents")
def observed_counts(spark, sf_dir):
    """Rows before and after a filter, counted on the way of the job that uses what it keeps."""
    kept, before, after = evaluation.observed_filter(_t(spark, sf_dir, "documents"), F.col("n_chars") > 500)
    chars = kept.agg(F.sum(F.length("text")).alias("chars")).first().chars
    return spark.createDataFrame([(before.get["before"], after.get["after"], chars)], "before long, after long, chars long")


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64))) AS BIGINT) AS total, len(list_filter(embedding, lambda x: x > 0)) AS positive, len(list_filter(embedding, lambda x: x > 0)) > 30 AS most FROM embeddings")
def batched_map(spark, sf_dir):
    """A NumPy callable over batches of rows, arrays as offsets and values, and a batched filter."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def totals(c):
        v = c["embedding"]
        scaled, starts = np.floor(v.values.astype(float) * 64).astype(np.int64), v.offsets[:-1]
        return {"vec_id": c["vec_id"], "total": np.add.reduceat(scaled, starts), "positive": np.add.reduceat((v.values > 0).astype(np.int64), starts)}

    done = batched.map_batches(e, totals, "vec_id long, total long, positive long", size=128)
    most = batched.filter_batches(done, lambda c: c["positive"] > 30).select("vec_id", F.lit(True).alias("most"))
    return done.join(most, "vec_id", "left").select("vec_id", "total", "positive", F.coalesce("most", F.lit(False)).alias("most"))


@query("SELECT avg(CAST(quality = toxic AS INT)) AS accuracy FROM labels")
def equal_share(spark, sf_dir):
    """Mean of equality."""
    return evaluation.expert_accuracy(_t(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def first_rows(spark, sf_dir):
    """The first rows of an order."""
    return indexing.first_rows(_t(spark, sf_dir, "documents").withColumn("less", -F.col("n_chars")), 50, "less", "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id OFFSET 123")
def resumed_rows(spark, sf_dir):
    """Rows from an offset on."""
    return indexing.rows_from(_t(spark, sf_dir, "documents").select("doc_id"), 123, F.col("doc_id"))


_SEEDED = f"SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format(k='doc_id')}, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents"


@query(f"SELECT doc_id, CASE WHEN i < ceil(n / 10.0) THEN 'test' ELSE 'train' END AS split FROM ({_SEEDED})")
def test_share_split(spark, sf_dir):
    """A tenth for the test, rounded up."""
    return indexing.train_test(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", test=0.1)


@query(f"SELECT doc_id, CASE WHEN i < n - CAST(floor(n * 0.8) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM ({_SEEDED})")
def train_share_split(spark, sf_dir):
    """Four fifths for training, rounded down, one split for inputs and labels alike."""
    return indexing.train_test(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", train=0.8)


@query("SELECT lang, w / sum(w) OVER () AS share FROM (SELECT lang, CAST(count(*) AS DOUBLE) AS w FROM documents GROUP BY lang)")
def weight_shares(spark, sf_dir):
    """Weights over their sum."""
    w = _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return mixing.weight_shares(w).select("lang", "share")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 8) AS v, CAST(('0x' || left(md5('7-' || vec_id), 8)) AS BIGINT) / 4294967296.0 AS u FROM embeddings),
p AS (SELECT vec_id, u, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e), s AS (SELECT vec_id, u, k, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM p), c AS (SELECT vec_id, u, sum(p) OVER (PARTITION BY vec_id ORDER BY k) AS c FROM s)
SELECT vec_id, CAST(least(63, count(*) FILTER (WHERE c <= u)) AS INT) AS "index" FROM c GROUP BY vec_id""")
def drawn_indices(spark, sf_dir):
    """A draw from each row's softmax at a temperature (M1-M3)."""
    e = _t(spark, sf_dir, "embeddings")
    u = F.conv(F.left(F.md5(F.concat(F.lit("7-"), F.col("vec_id").cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))
    return e.select("vec_id", V.draw(V.softmax(F.col("embedding"), 0.125), u).alias("index"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id)) AS v, vec_id % 3 AS k FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x, round(sqrt(list_sum(list_transform(v, lambda x: pow(x / sqrt(list_dot_product(v, v)), 2)))), 6) AS norm,
round(2 * v[1] + 3 * v[2], 4) AS mixed, v[1 + (130 + k) % 64] AS refilled FROM e""")
def vector_forms(spark, sf_dir):
    """Unit length, weighted sums and cyclic refill."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id"))).alias("v"))
    unit = V.l2_normalize(F.col("v"))
    mixed = V.weighted_sum(F.array(F.slice("v", 1, 1), F.slice("v", 2, 1)), F.array(F.lit(2.0), F.lit(3.0)))
    return e.select("vec_id", F.round(unit[0], 6).alias("x"), F.round(F.sqrt(V.dot(unit, unit)), 6).alias("norm"), F.round(mixed[0], 4).alias("mixed"), F.get(V.cyclic_resize(F.col("v"), 200), (130 + F.col("vec_id") % 3).cast("int")).alias("refilled"))


@query("""WITH t AS (SELECT item_id, 1 + item_id % 3 AS tiles FROM benchmark) SELECT item_id, tiles, CAST(tiles * 256 AS BIGINT) AS n, CAST(coalesce(sum(tiles) OVER (PARTITION BY item_id // 16 ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(tiles) OVER (PARTITION BY item_id // 16 ORDER BY item_id) AS BIGINT) AS stop,
array_to_string(list_transform(range(tiles * 2), lambda i: item_id * 10 + i), ',') AS joined FROM t""")
def tile_offsets(spark, sf_dir):
    """Segments of tiles in a stack, their patches, and their embeddings in one list."""
    t = _t(spark, sf_dir, "benchmark").select("item_id", (1 + F.col("item_id") % 3).alias("tiles"), F.floor(F.col("item_id") / 16).alias("stack"))
    tile = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: F.array(F.col("item_id") * 10 + 2 * k, F.col("item_id") * 10 + 2 * k + 1))
    return K.tile_segments(t, "stack", "item_id", "tiles").select("item_id", "tiles", V.tile_patches(F.col("tiles"), 448, 28).alias("n"), "start", "stop", F.array_join(F.transform(V.join_tiles(tile), lambda x: x.cast("string")), ",").alias("joined"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d-%H-%M') AS stamp FROM events")
def minute_stamps(spark, sf_dir):
    """Times as file-name stamps."""
    return _t(spark, sf_dir, "events").select("event_id", X.minute_stamp(F.col("ts")).alias("stamp"))


@query("SELECT conv_id, turn, CAST(length(lower(text)) - length(replace(lower(text), 'a', '')) AS DOUBLE) / length(text) AS score, CAST(0 AS DOUBLE) AS acc, 'Maybe' AS pred FROM conversations")
def letter_scores(spark, sf_dir):
    """The reward's whole struct."""
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", X.letter_score(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'none' ELSE 'none' END AS v FROM pages")
def map_defaults(spark, sf_dir):
    """A map's value or a default, for missing and for null (JS2)."""
    table = F.create_map(F.when(F.col("page_id") % 3 == 1, "other").otherwise(F.lit("k")), F.when(F.col("page_id") % 3 == 0, "x"))
    return _t(spark, sf_dir, "pages").select("page_id", C.get_or(table, "k", "none").alias("v"))


@query("""SELECT page_id, array_to_string(string_split(url, '/')[4:], '/') AS below, regexp_replace(url, '/[^/]*$', '') AS dir, upper(replace(url, '-', '_')) AS shouted, CASE WHEN page_id % 2 = 0 THEN 'h:1' ELSE 'h' END AS host, CAST(CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id BETWEEN 1 AND 65535 THEN page_id END ELSE 80 END AS INT) AS port FROM pages""")
def path_parts(spark, sf_dir):
    """Lower folders, folder names, names in upper case, hosts and ports."""
    p = _t(spark, sf_dir, "pages")
    address = X.host_port(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("h:1:"), "page_id")).otherwise(F.lit("h")), 80)
    return p.select("page_id", X.below(F.col("url")).alias("below"), X.dir_name(F.col("url")).alias("dir"), X.shouted(F.col("url")).alias("shouted"), address["host"].alias("host"), address["port"].alias("port"))
