"""Tokenisation of texts and conversations with a tokenizer file, label masks by template, batches and their attachments."""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.common import fresh
from ..operators.indexing import batches
from ..operators.modalities import embedding_counts
from ..sources.scratch import Stored


@dataclass(frozen=True)
class Template:
    """Text around the turns of a conversation. ``turns`` has what opens and closes a role's turn, ``masked`` the tags
    between which labels are ignored, ``extra`` further special tokens."""

    begin: str
    turns: dict[str, tuple[str, str]] = field(hash=False)
    masked: tuple[tuple[str, str], ...]
    extra: tuple[str, ...]
    generation: str


#: The characters that count as white space at the ends of a message.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Tags of the two template families.
HEADER, HEADER_END, TURN_END = "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"
_header = lambda role: f"{HEADER}{role}{HEADER_END}"
LLAMA = Template(
    "<|begin_of_text|>", {r: (_header(r) + "\n\n", TURN_END) for r in ("system", "user", "assistant")},
    ((_header("system"), TURN_END), (_header("user"), TURN_END)), ("<|begin_of_text|>", HEADER, HEADER_END, TURN_END), _header("assistant") + "\n\n",
)
_special = lambda n: f"<SPECIAL_{n}>"
APERTUS_ROLES = {"system": (61, 62), "developer": (63, 64), "user": (65, 66), "assistant": (67, 68)}
APERTUS = Template(
    "<s>", {r: (_special(a), _special(b)) for r, (a, b) in APERTUS_ROLES.items()},
    tuple((_special(a), _special(b)) for r, (a, b) in APERTUS_ROLES.items() if r != "assistant"), ("<s>", *(_special(n) for n in range(61, 69))), _special(67),
)
TEMPLATES = {"llama": LLAMA, "apertus": APERTUS}


#: Bytes of text and ids that a task hands to the tokenizer at a time, unless one row has more: what it makes of them takes
#: some hundred times the room.
SLICE_BYTES, SLICE_IDS = 1 << 19, 1 << 17


def _slices(rows: pa.Array | pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.Array | pa.RecordBatch]:
    """``rows`` in order, cut where their sizes (null: none) would sum up to more than ``most``; a larger row is alone."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield rows.slice(start, stop - start)
        start = stop


@functools.lru_cache(maxsize=8)
def _tokenizer(path: str, specials: tuple[str, ...]):
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in specials])
    return tok


def _in_task(path: str, specials: tuple[str, ...]):
    """The tokenizer with one thread: a task has a core, and threads of its own would take the other tasks'."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _tokenizer(path, specials)


def _encoded_slices(tok, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of the texts, their numbers of ids, and their ids one after the other."""
    for part in _slices(texts, pc.binary_length(texts), SLICE_BYTES):
        found = [e.ids for e in tok.encode_batch_fast([t or "" for t in part.to_pylist()], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        yield part, sizes, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))


def _listed(texts: pa.Array, sizes: list[np.ndarray], ids: list[np.ndarray]) -> pa.Array:
    ends, flat = np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64), np.concatenate([np.zeros(0, np.int32), *ids], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=texts.is_null())


def _encoded(tok, texts: pa.Array) -> pa.Array:
    parts = list(_encoded_slices(tok, texts))
    return _listed(texts, [p[1] for p in parts], [p[2] for p in parts])


def _decoded_slices(tok, rows: pa.RecordBatch, skip_special: bool) -> Iterator[list[pa.Array]]:
    """The texts of every column of ids, for slices of the rows."""
    sizes = functools.reduce(pc.add, (pc.list_value_length(c).fill_null(0).cast(pa.int64()) for c in rows.columns))
    for part in _slices(rows, sizes, SLICE_IDS):
        found = []
        for c in part.columns:
            flat, ends = c.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0, *pc.list_value_length(c).fill_null(0).to_pylist()]).tolist()
            texts = tok.decode_batch([flat[a:b] for a, b in itertools.pairwise(ends)], skip_special_tokens=skip_special)
            found.append(pa.array(texts, pa.string(), mask=c.is_null().to_numpy(zero_copy_only=False)))
        yield found


def _decoded(tok, rows: pa.Array, skip_special: bool) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.string()), *(found for (found,) in _decoded_slices(tok, pa.RecordBatch.from_arrays([rows], ["ids"]), skip_special))])


@dataclass(frozen=True)
class Tokens:
    """A tokenizer file with special tokens added in order; the path is read on the executors too."""

    path: str
    specials: tuple[str, ...] = ()

    def id_of(self, token: str) -> int:
        """Id of one token of the vocabulary; an unknown one is an error."""
        found = _tokenizer(self.path, self.specials).token_to_id(token)
        if found is None:
            raise ValueError(f"not in the vocabulary: {token}")
        return found

    def ids_of(self, tag: str) -> list[int]:
        return _tokenizer(self.path, self.specials).encode(tag, add_special_tokens=False).ids

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """(token, id) of every token, for joins."""
        return spark.createDataFrame(list(_tokenizer(self.path, self.specials).get_vocab().items()), "token string, id long")

    def encode(self, text: Column, chained: bool = False) -> Column:
        """Ids of a text; null of a null one. Marked as not deterministic, so that the planner computes it once, by itself.
        A task holds the ids of a slice of its texts; with ``chained`` those of an Arrow batch, which a Python function
        around this one then gets in the same process."""
        path, specials = self.path, self.specials

        @F.arrow_udf("array<bigint>")
        def ids(texts: pa.Array) -> pa.Array:
            return _encoded(_in_task(path, specials), texts)

        @F.arrow_udf("array<bigint>")
        def sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                for part, sizes, flat in _encoded_slices(_in_task(path, specials), texts):
                    yield _listed(part, [sizes], [flat])

        return (ids if chained else sliced).asNondeterministic()(text)

    def decode(self, ids: Column, skip_special: bool = True, chained: bool = False) -> Column:
        """Text of ids; null of null. A task holds the texts of a slice of its rows; with ``chained``, which goes around
        an encoding of that kind, those of an Arrow batch."""
        if not chained:
            return self.decode_each({"text": ids}, skip_special)["text"]
        path, specials = self.path, self.specials

        @F.arrow_udf("string")
        def text(rows: pa.Array) -> pa.Array:
            return _decoded(_in_task(path, specials), rows, skip_special)

        return text(ids)

    def decode_each(self, ids: dict[str, Column], skip_special: bool = True) -> Column:
        """A struct of the texts of several columns of ids, made in one process slice by slice; null of null."""
        path, specials, names = self.path, self.specials, list(ids)

        @F.arrow_udf(f"struct<{', '.join(f'{n}: string' for n in names)}>")
        def texts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                columns = [columns] if isinstance(columns, pa.Array) else list(columns)
                for found in _decoded_slices(_in_task(path, specials), pa.RecordBatch.from_arrays(columns, names), skip_special):
                    yield pa.StructArray.from_arrays(found, names)

        return texts(*ids.values())


def render(messages: Column, template: Template, generation_prompt: bool = False) -> Column:
    """The conversation as one text; a role that the template hasn't is an error. Contents are stripped of
    all white space at both ends."""
    opens, closes = (F.create_map(*(F.lit(x) for r, t in template.turns.items() for x in (r, t[k]))) for k in (0, 1))
    opened = lambda m: F.coalesce(F.try_element_at(opens, m["role"]), F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(m["role"], F.lit("null")))).cast("string"))
    turn = lambda m: F.concat(opened(m), F.trim(F.coalesce(m["content"], F.lit("")), F.lit(WHITE_SPACE)), F.element_at(closes, m["role"]))
    return F.concat(F.lit(template.begin), F.array_join(F.transform(messages, turn), ""), F.lit(template.generation if generation_prompt else ""))


def tokenize_samples(samples: DataFrame, path: str, template: Template = LLAMA, attachment: str = "<|attachment|>", defaults: dict[str, int] | None = None, generation_prompt: bool = False) -> DataFrame:
    """``samples`` with input_ids, attention_mask and labels.

    A row with ``text`` is a plain text, else one with ``messages`` a conversation, else an error. Attachment tokens are
    expanded to the numbers of embeddings of ``modalities`` (null counts as none) and never trained in texts; in
    conversations the template's masked spans aren't trained. Rows keep what else they have, so order plays no part.
    """
    tok = Tokens(path, (*template.extra, attachment))
    mark = tok.id_of(attachment)
    rendered = F.when(F.col("text").isNotNull(), F.col("text")).when(F.col("messages").isNotNull(), render(F.col("messages"), template, generation_prompt))
    rendered = rendered.otherwise(F.raise_error(F.lit("a sample needs a text or messages")).cast("string"))
    counts = F.coalesce(embedding_counts(F.col("modalities"), defaults or {"": 0}), F.array().cast("array<bigint>"))
    out = samples.withColumn("input_ids", tok.encode(rendered)).withColumn("input_ids", T.expand_attachments(F.col("input_ids"), counts, mark))
    labels = F.col("input_ids")
    for left, right in template.masked:
        labels = T.mask_between(labels, F.col("input_ids"), tok.ids_of(left), tok.ids_of(right))
    plain = F.transform("input_ids", lambda x: F.when(x == mark, F.lit(T.IGNORE).cast("long")).otherwise(x))
    return out.withColumn("labels", F.when(F.col("text").isNotNull(), plain).otherwise(labels)).withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1).cast("long")))


def padded(samples: DataFrame, key: str, size: int = 16, side: str = "right", pad_id: int = 0) -> DataFrame:
    """``samples`` with batch_id and batch_idx in the order of ``key``, every batch padded to its longest row.

    Samples are made once and stored with a row number; batches are numbered on keys and row numbers alone. So null keys
    (which come first) and repeated ones are rows like others.
    """
    (uid,) = fresh(samples, "uid")
    made = Stored(samples.withColumn(uid, F.monotonically_increasing_id()), "samples").df
    numbered = batches(made.select(key, uid), F.col(key), size, uid).drop(key)
    rows = made.join(numbered, uid).drop(uid).withColumn("width", F.max(F.size("input_ids")).over(Window.partitionBy("batch_id")))
    for name, fill in (("input_ids", pad_id), ("attention_mask", 0), ("labels", T.IGNORE)):
        rows = rows.withColumn(name, T.pad(F.col(name), F.col("width"), fill, side))
    return rows.drop("width").withColumn("position_ids", T.position_ids(F.col("attention_mask")))


def with_ranges(padded_rows: DataFrame, mark: int) -> DataFrame:
    """Each attachment's token_range in the padded ids, so that padding on the left moves it. Attachments and ranges go
    together by place, as far as the shorter list goes; a null list has none."""
    counts = F.transform("modalities", lambda m: m["num_embeddings"].cast("long"))
    ranges = T.token_ranges(F.col("input_ids"), counts, mark)
    both = F.transform("modalities", lambda m, i: F.struct(*(m[c].alias(c) for c in _fields(padded_rows)), F.get(ranges, i).alias("token_range")))
    return padded_rows.withColumn("modalities", both)


def _fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema["modalities"].dataType.elementType.fields if f.name != "token_range"]


def attachments(rows: DataFrame) -> DataFrame:
    """batch_id, batch_idx, nth and the fields of every attachment of padded rows."""
    return rows.select("batch_id", "batch_idx", F.posexplode("modalities").alias("nth", "m")).select("batch_id", "batch_idx", "nth", "m.*")


def stacks(rows: DataFrame) -> DataFrame:
    """batch_id, type, values: the attachments of each type in a batch, by row and place. A batch is of a fixed size."""
    listed = F.array_sort(F.collect_list(F.struct("batch_idx", "nth", "value")))
    return attachments(rows).groupBy("batch_id", "type").agg(F.transform(listed, lambda x: x["value"]).alias("values"))


def batch_types(rows: DataFrame) -> DataFrame:
    return attachments(rows).groupBy("batch_id").agg(F.array_sort(F.collect_set("type")).alias("types"))


def positions_by_type(rows: DataFrame) -> DataFrame:
    """batch_id, type, batch_idx, nth, position: a row for every place that an attachment's embeddings take."""
    places = F.explode(T.range_positions(F.array("token_range"))).alias("position")
    return attachments(rows).select("batch_id", "type", "batch_idx", "nth", places)


def scatter(tokens: DataFrame, embeddings: DataFrame, vector: str = "vector") -> DataFrame:
    """``tokens`` (batch_id, batch_idx, position, vector) with the vectors that ``embeddings`` has for a place instead."""
    at = ["batch_id", "batch_idx", "position"]
    put = embeddings.select(*at, F.col(vector).alias("__put"))
    return tokens.join(put, at, "left").withColumn(vector, F.coalesce("__put", vector)).drop("__put")


def tile_segments(samples: DataFrame, stack: str, order: str, tiles: str) -> DataFrame:
    """``samples`` with start and stop: where each sample's tiles lie in its stack. A stack is of a fixed size."""
    upto = F.sum(tiles).over(Window.partitionBy(stack).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")
    return samples.withColumn("stop", upto).withColumn("start", F.col("stop") - F.col(tiles))
