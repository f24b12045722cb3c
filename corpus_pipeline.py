"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import Stored
from quern.llm.lines import LEAST_BYTES, remove_lines
from quern.llm.minhash import one_of_each
from quern.llm.packing import pack
from quern.llm.quality import accepted
from quern.llm.suffixes import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their host's verdict rejects go. Null and empty texts have no words, so the base rule
    rejects them; a null host has no verdict; repeated rows and null ids are judged like others, whole texts of any length."""
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go: of three lines or more, or of 100 bytes or more. Rows of which no word is
    left go as well; null and empty texts have no lines and stay. Null ids count as the first, texts under one id are ordered
    by a hash, and rows that agree in both are one document, so both stay. A text's lines may be any number."""
    return remove_lines(docs, least_bytes=LEAST_BYTES)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more) stays. Rows are judged by id and
    text: repeated rows count once, and an id at two texts may stay for one of them. Rows with a null id stay."""
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier as well go. Texts under 100 bytes, null and empty ones stay as they are;
    rows of which nothing is left go. Null ids count as the first; of rows that agree in id and text, and have 100 bytes,
    one stays. Whole texts of any length are judged."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left: a row for each piece, where null and empty texts have one end token. Null and
    repeated ids are rows like others; a long text is cut into as many pieces as it needs."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: Signatures, induced sorting and tokenisation aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        done = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()  # nothing reads it any more
        before, docs = done, done.df
    return docs
