"""Image and caption pairs for contrastive training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T
from ..functions.images import pixel_values
from ..sources.readers import rgb_pixels

LENGTH, PAD = 128, 0
#: Side, means and deviations of the image encoder's input.
SIZE, MEAN, STD = 224, [0.48145466, 0.4578275, 0.40821073], [0.26862954, 0.26130258, 0.27577711]


def first_image_path(dataset: str, modalities: Column) -> Column:
    """Path of the first attachment of a row: below the dataset's folder where the dataset is a JSONL file."""
    value = F.get(modalities, F.lit(0))["value"]
    return X.join_path(F.lit(dataset.rsplit("/", 1)[0] if "/" in dataset else ""), value) if dataset.endswith(".jsonl") else value


def image_paths(modalities: Column) -> Column:
    return F.transform(F.filter(modalities, lambda m: m["type"] == "image"), lambda m: m["value"])


def caption_pairs(rows: DataFrame, dataset: str, image_column: str = "modalities", caption_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, image_path and caption (without attachment marks); nothing else stays."""
    nested = rows.schema[image_column].dataType.typeName() == "array"
    path = first_image_path(dataset, F.col(image_column)) if nested else F.col(image_column)
    return rows.select(*keep, path.alias("image_path"), X.clean_caption(F.col(caption_column)).alias("caption"))


def tokenized_captions(pairs: DataFrame, tokenize: Callable[[Column], Column], length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """``pairs`` without the caption, with input_ids and attention_mask of exactly ``length``: longer captions are cut."""
    cut = pairs.withColumn("input_ids", T.truncate(tokenize(F.col("caption")), length)).drop("caption")
    cut = cut.withColumn("attention_mask", T.pad(F.transform("input_ids", lambda x: F.lit(1).cast("long")), F.lit(length), 0))
    return cut.withColumn("input_ids", T.pad(F.col("input_ids"), F.lit(length), pad))


def image_text_pairs(pairs: DataFrame, images: DataFrame, tokenize: Callable[[Column], Column], length: int = LENGTH, pad: int = PAD, size: int = SIZE, mean: list[float] = MEAN, std: list[float] = STD) -> DataFrame:
    """``pairs`` (image_path, caption and more) with pixel_values, input_ids and attention_mask in place of path and caption.

    ``images`` is read_images' table with paths as the pairs have them, each once. A pair whose image isn't there or can't
    be decoded goes, as a filter before training would have it; several pairs may share an image. Tokens are made before
    the join and pixels are resized behind it, so each is made once a pair, and the join carries an image's own bytes.
    """
    good = images.where("height > 0").select(F.col("path").alias("image_path"), "height", "width", "channels", "pixels")
    texts = pairs.select(*(c for c in pairs.columns if c != "caption"), T.truncate(tokenize(F.col("caption")), length).alias("input_ids"))
    both = texts.join(good, "image_path").withColumn("rgb", rgb_pixels(F.col("pixels"), F.col("channels"))).drop("pixels", "channels")
    both = both.withColumn("pixel_values", pixel_values(F.col("rgb"), F.col("height"), F.col("width"), size, mean, std)).drop("rgb", "height", "width", "image_path")
    both = both.withColumn("attention_mask", T.pad(F.transform("input_ids", lambda x: F.lit(1).cast("long")), F.lit(length), 0))
    return both.withColumn("input_ids", T.pad(F.col("input_ids"), F.lit(length), pad))
