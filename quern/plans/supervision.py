"""From conversations to padded, label-masked batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from .tokenization import padded

#: Ids of the plain test tokenizer: tags by role, the end of a turn, the attachment token, and words above those.
ROLE_TAGS = {"system": 1, "user": 2, "assistant": 3}
END, ATTACHMENT, PAD, WORDS = 4, 9, 0, 1000


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id and messages (role, content) in turn order."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(listed.alias("l")).select("conv_id", F.transform("l", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def word_ids(text: Column) -> Column:
    """A deterministic tokenizer for tests: a word is 1000 plus the first 7 digits of its md5."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.left(F.md5(w.cast("binary")), F.lit(7)), 16, 10).cast("long") + WORDS)


def render(messages: Column) -> Column:
    """Token ids of a conversation: role tag, an attachment token in user turns, words, end of turn."""
    tags = F.create_map(*(F.lit(x) for k, v in ROLE_TAGS.items() for x in (k, v)))
    one = lambda m: F.concat(
        F.array(F.coalesce(F.try_element_at(tags, m["role"]), F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(m["role"], F.lit("null")))).cast("int")).cast("long")), F.when(m["role"] == "user", F.array(F.lit(ATTACHMENT).cast("long"))).otherwise(F.array().cast("array<bigint>")), word_ids(m["content"]), F.array(F.lit(END).cast("long"))
    )
    return F.flatten(F.transform(messages, one))


def supervised(turns: DataFrame) -> DataFrame:
    """conv_id, input_ids, attention_mask, labels, token_ranges: attachments expanded, system and user spans masked."""
    c = conversations_of(turns)
    raw = c.select("conv_id", render(F.col("messages")).alias("ids"), F.size(F.filter("messages", lambda m: m["role"] == "user")).alias("users"))
    counted = raw.withColumn("counts", F.when(F.col("users") > 0, F.array_repeat((1 + F.pmod("conv_id", F.lit(4))).cast("long"), F.col("users"))).otherwise(F.array().cast("array<bigint>")))
    grown = counted.select("conv_id", "counts", T.expand_attachments(F.col("ids"), F.col("counts"), ATTACHMENT).alias("input_ids"))
    masked = T.mask_between(F.col("input_ids"), F.col("input_ids"), [ROLE_TAGS["system"]], [END])
    labels = T.mask_between(masked, F.col("input_ids"), [ROLE_TAGS["user"]], [END])
    return grown.select("conv_id", "input_ids", F.transform("input_ids", lambda x: F.lit(1).cast("long")).alias("attention_mask"), labels.alias("labels"), T.token_ranges(F.col("input_ids"), F.col("counts"), ATTACHMENT).alias("token_ranges"))


def collated(samples: DataFrame, size: int = 16, side: str = "right") -> DataFrame:
    """batch_id, batch_idx and the padded columns with position_ids; every batch is as long as its longest row."""
    return padded(samples, "conv_id", size, side, PAD).select("batch_id", "batch_idx", "conv_id", "input_ids", "attention_mask", "labels", "position_ids")


def rl_map(rows: DataFrame, data_source: str, split: str, index: str, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """``rows`` (prompt, response and what else they have) as reinforcement-learning records: data_source, prompt as one
    message, ability, reward_model and extra_info (split, index); the response column stays beside them."""
    return rows.withColumns({
        "data_source": F.lit(data_source), "prompt": F.array(F.struct(F.lit("assistant").alias("role"), F.col(prompt).alias("content"))), "ability": F.lit("math"),
        "reward_model": F.struct(F.lit("rule").alias("style"), F.col(response).alias("ground_truth")), "extra_info": F.struct(F.lit(split).alias("split"), F.col(index).cast("long").alias("index")),
    })


def answered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, response: user turns that the next turn, an assistant's, answers."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("response", F.lead("text").over(w)).withColumn("by", F.lead("role").over(w)).where("role = 'user' and by = 'assistant'")
    return pairs.select("conv_id", "turn", F.col("text").alias("prompt"), "response")


def rl_records(turns: DataFrame, data_source: str, split: str) -> DataFrame:
    """User turns answered by the next turn, as reinforcement-learning records."""
    made = rl_map(answered_turns(turns), data_source, split, "turn")
    return made.select("conv_id", "turn", "data_source", "prompt", "ability", "reward_model", F.col("extra_info.split").alias("split"))
