"""Literal cases of token, text and source functions."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import tokens as T
from quern.functions import vectors as V
from quern.sources import readers, writers
from quern.streaming import progress


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def ids(*xs):
    return F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.array().cast("array<bigint>")


def test_tokens(spark):
    assert one(spark, T.expand_attachments(ids(1, 2, 9, 3), ids(2), 9)) == [1, 2, 9, 9, 3]
    assert one(spark, T.expand_attachments(ids(1, 9), ids(), 9)) == [1, 9]
    with pytest.raises(Exception, match="differ in number"):
        one(spark, T.expand_attachments(ids(1, 9, 9), ids(2), 9))
    assert [tuple(r) for r in one(spark, T.token_ranges(ids(1, 9, 9, 2, 9, 9, 9), ids(2, 3), 9))] == [(1, 3), (4, 7)]
    seq = ids(9, 1, 2, 7, 7, 3, 1, 2, 8, 3, 5)
    assert one(spark, T.mask_between(seq, seq, [1, 2], [3])) == [9] + [-100] * 9 + [5]
    with pytest.raises(Exception, match="closed"):
        one(spark, T.mask_between(ids(1, 2, 7), ids(1, 2, 7), [1, 2], [3]))
    assert one(spark, T.position_ids(ids(0, 0, 1, 1, 1))) == [0, 0, 0, 1, 2]
    assert one(spark, T.pad(ids(5, 6), F.lit(4), 0, "left")) == [0, 0, 5, 6]
    assert one(spark, T.pad(ids(5, 6), F.lit(4), 0)) == [5, 6, 0, 0]


def test_text(spark):
    for given, want in (("x Answer: B y Answer: **C**", "C"), ("none", "?"), ("Answer: B ... Answer: ", "?")):
        assert one(spark, X.extract_answer(F.lit(given))) == want
    assert one(spark, X.letter_reward(F.lit("Banana"))) == 0.5
    assert one(spark, X.letter_reward(F.lit(""))) == 0
    assert one(spark, X.join_path(F.lit("/b"), F.lit("x.png"))) == "/b/x.png"
    assert one(spark, X.join_path(F.lit("/b"), F.lit("/abs/x.png"))) == "/abs/x.png"
    assert tuple(one(spark, X.host_port(F.lit("h:80"), 1))) == ("h", 80)
    assert one(spark, V.weighted_sum(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(2.0), F.lit(1.0)))) == [5.0, 8.0]
    assert one(spark, V.cyclic_resize(F.array(F.lit(1.0), F.lit(2.0)), 3)) == [1.0, 2.0, 1.0]


def test_jsonl_and_stream(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.jsonl").write_text('{"text": "a"}\n\nnot json\n[1]\n{"text": null}\n')
    got = readers.read_jsonl(spark, str(p), "text string").collect()
    assert [(r.text, r.malformed) for r in got] == [("a", False), (None, True), (None, True), (None, True), (None, False)]
    writers.write_jsonl(spark.range(1).select("id", F.lit(None).cast("string").alias("x")), str(tmp_path / "out"))
    written = [line for f in (tmp_path / "out").glob("part*") for line in f.read_text().splitlines()]
    assert [json.loads(line) for line in written] == [{"id": 0, "x": None}]
    g = tmp_path / "gen"
    g.mkdir()
    for n, t in (("a", "Answer: A"), ("b", "none")):
        (g / f"{n}.json").write_text(json.dumps({"text": t}) + "\n")
        progress.score_answers(progress.stream_jsonl(spark, str(g), "text string"), str(tmp_path / "scored"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.answer for r in spark.read.parquet(str(tmp_path / "scored")).collect()) == ["?", "A"]
