"""Attachments of samples: lookups in registries, validity, per-type tables.

Samples keep their identity by a row number taken before attachments are exploded, so null and repeated keys are fine and
no column is a key. A row's other columns travel with its first attachment only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import fresh
from .mixing import last_wins

#: Fixed value: fields that an attachment keeps after a merge.
ALLOWED = ("num_embeddings", "token_range", "type", "value")


def exploded(samples: DataFrame, modalities: str = "modalities") -> DataFrame:
    """uid, rest, pos, m: one row an attachment with its place; a sample without any keeps one row of nulls. ``rest`` has
    all columns of the sample, on its first row."""
    base = samples.select(F.monotonically_increasing_id().alias("uid"), F.struct(*(samples[c] for c in samples.columns)).alias("rest"))
    each = base.select("uid", "rest", F.posexplode_outer(f"rest.{modalities}").alias("pos", "m"))
    return each.withColumn("rest", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("rest")))


def _looked_up(each: DataFrame, registry: DataFrame, path: str, columns: list[str], order: list[str], unique: bool = False) -> DataFrame:
    """``each`` with hit and v (a struct of the registry's columns). A path that stands in the registry twice has one row:
    the last in ``order``, or without an order the last in the scan. A ``unique`` registry has each path once
    and is joined as it is, in the partitioning that it has."""
    if unique:
        one = registry.where(F.col(path).isNotNull()).select(F.col(path).cast("string").alias("__path"), F.struct(*columns).alias("v"))
    else:
        found = registry.select(F.col(path).cast("string").alias("path"), F.struct(*columns).alias("v"), F.struct(*(order or [F.monotonically_increasing_id()])).alias("o"))
        one = last_wins(found.where(F.col("path").isNotNull()), "path", "o").select(F.col("path").alias("__path"), "v")
    return each.join(one, F.col("m.value").cast("string") == F.col("__path"), "left").withColumn("hit", F.col("__path").isNotNull()).drop("__path")


def merge_registry(samples: DataFrame, registry: DataFrame, value: str = "payload", modalities: str = "modalities", strict: bool = False, path: str = "path", order: list[str] | None = None, unique: bool = False) -> DataFrame:
    """``samples`` with each attachment's value replaced by what ``registry`` (path, value) has for it, in place and order.

    Of an attachment's fields those in ALLOWED stay. A miss gives null or, if strict, an error. Null and empty lists, null
    attachments and repeated rows stay as they are; of a path's several rows the last in ``order`` counts.
    """
    fields = [f.name for f in samples.schema[modalities].dataType.elementType.fields if f.name in ALLOWED and f.name != "value"]
    found = _looked_up(exploded(samples, modalities), registry, path, [value], order or [], unique)
    payload = F.col(f"v.{value}")
    if strict:
        missed = F.raise_error(F.concat(F.lit("not in the registry: "), F.coalesce(F.col("m.value").cast("string"), F.lit("null"))))
        payload = F.when(F.col("hit"), payload).otherwise(missed.cast(registry.schema[value].dataType))
    item = F.when(F.col("m").isNotNull(), F.struct(*(F.col(f"m.{f}").alias(f) for f in fields), payload.alias("value")))
    listed = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", item.alias("item")))), lambda a, b: a["pos"] - b["pos"])
    merged = found.groupBy("uid").agg(F.first("rest", ignorenulls=True).alias("rest"), listed.alias("l"))
    return merged.select(*(F.when(F.col(f"rest.{c}").isNotNull(), F.transform("l", lambda x: x["item"])).alias(c) if c == modalities else F.col(f"rest.{c}").alias(c) for c in samples.columns))


def valid_samples(samples: DataFrame, registry: DataFrame, modalities: str = "modalities", min_height: int | None = 1, path: str = "path", height: str = "height", unique: bool = False) -> DataFrame:
    """Samples whose every attachment is in ``registry`` (path, height) with a greater height, or with ``min_height`` None
    just in it. Samples without attachments stay; each row is judged for itself."""
    found = _looked_up(exploded(samples, modalities), registry, path, [height] if min_height is not None else [path], [], unique)
    good = F.col("hit") if min_height is None else F.col("hit") & F.coalesce(F.col(f"v.{height}") > min_height, F.lit(False))
    judged = found.groupBy("uid").agg(F.first("rest", ignorenulls=True).alias("rest"), F.bool_and(F.col("pos").isNull() | good).alias("ok"))
    return judged.where("ok").select("rest.*")


def check_if(samples: DataFrame, check: bool, registry: DataFrame, **options) -> DataFrame:
    """valid_samples where a configuration asks for it."""
    return valid_samples(samples, registry, **options) if check else samples


def _table(of: dict) -> Column:
    return F.create_map(*(F.lit(x) for k, v in of.items() for x in (k, v)))


def embedding_counts(modalities: Column, defaults: dict[str, int]) -> Column:
    """num_embeddings of each attachment: its own, else its type's default, else an error."""
    return F.transform(modalities, lambda m: F.coalesce(m["num_embeddings"], F.try_element_at(_table(defaults), m["type"]), F.raise_error(F.lit("no number of embeddings")).cast("int")).cast("long"))


def looked_up_types(modalities: Column, processors: dict[str, str]) -> Column:
    """What a short table has for each attachment's type; a type that isn't in it is an error."""
    return F.transform(modalities, lambda m: F.coalesce(F.try_element_at(_table(processors), m["type"]), F.raise_error(F.concat(F.lit("no processor for type "), m["type"])).cast("string")))


def distinct_types(types: list[str]) -> list[str]:
    """The types, which must differ from each other."""
    twice = sorted({t for t in types if types.count(t) > 1})
    if twice:
        raise ValueError(f"types are given twice: {', '.join(twice)}")
    return types


def of_type(modalities: Column, kind: str) -> Column:
    return F.filter(modalities, lambda m: m["type"] == kind)


def with_value(modality: Column, value: Column) -> Column:
    """A copy of an attachment with another value."""
    return modality.withField("value", value)


def process_by_type(samples: DataFrame, processors: dict, modalities: str = "modalities") -> DataFrame:
    """Each attachment's value replaced by its type's column function of it; a type without one is an error.

    ``processors`` maps types to functions from a column to a column: built-in expressions or vectorised UDFs. All must
    give one type. Attachments are exploded, so a UDF runs over whole batches, and listed again in order.
    """
    each = exploded(samples, modalities)
    value = reduce(lambda w, kv: w.when(F.col("m.type") == kv[0], kv[1](F.col("m.value"))), processors.items(), F.when(F.lit(False), None))
    known = F.col("m").isNull() | F.col("m.type").isin(*processors)
    item = F.when(known, F.col("m").withField("value", value)).otherwise(F.raise_error(F.concat(F.lit("no processor for type "), F.col("m.type"))))
    each = each.select("uid", "rest", "pos", F.when(F.col("m").isNotNull(), item).alias("item"))
    listed = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "item"))), lambda a, b: a["pos"] - b["pos"])
    merged = each.groupBy("uid").agg(F.first("rest", ignorenulls=True).alias("rest"), listed.alias("l"))
    return merged.select(*(F.when(F.col(f"rest.{c}").isNotNull(), F.transform("l", lambda x: x["item"])).alias(c) if c == modalities else F.col(f"rest.{c}").alias(c) for c in samples.columns))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` if it has the columns, else an error that names the missing ones."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df
