"""Scan order, running totals, interleaving, batches and long token sequences against brute force."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from quern.functions import tokens as T
from quern.operators import mixing
from quern.operators import running as R
from quern.plans import tokenization as K
from quern.sources import readers, writers
from quern.sources import scan_order as scan


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_running(spark, stretch):
    rng = random.Random(stretch)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, 1, 2, 3, 4]), i, rng.choice([None, 1.0, 2.5, -3.0]), "x") for i in range(200)]
    rows += [("none", i, 200 + i, None, "x") for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o long, tie long, v double, __part string").repartition(5)
    first = lambda x: (x is not None, x or 0)  # noqa: E731  nulls come first
    for group in ("g", None):
        got = {r.tie: r for r in R.running(df, "v", group, F.col("o"), "tie", stretch=stretch).collect()}
        assert len(got) == len(rows)
        for key in {r[0] for r in rows} if group else {None}:
            seen = []
            for r in sorted((r for r in rows if not group or r[0] == key), key=lambda r: (first(r[1]), r[2])):
                seen += [] if r[3] is None else [r[3]]
                x = got[r[2]]
                assert (x.running_sum, x.running_count, x.running_mean) == (sum(seen) if seen else None, len(seen), sum(seen) / len(seen) if seen else None)


def test_running_spreads_one_group(spark):
    """A group of all rows is summed up by as many tasks as there are stretches."""
    df = spark.range(10_000).withColumn("g", F.lit(1))
    out = R.running(df, "id", "g", F.col("id"), stretch=500, exact="decimal(20,0)")
    parts = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert max(r["count"] for r in parts) < 10_000 * 0.6
    assert out.agg(F.sum(F.col("running_sum") - F.expr("id * (id + 1) / 2"))).first()[0] == 0
    assert R.running(df.limit(0), "id", "g", F.col("id")).count() == 0


@pytest.mark.parametrize("blocks", [500_000, 0])
def test_numbered_lines_of_unequal_files(spark, tmp_path, blocks):
    sizes = {"a.txt": 3, "b.txt": 4000, "c.txt": 0, "d.txt": 1, "e.txt": 700}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" for i in range(n)))
    want = [f"{name} {i} {'x' * (i % 50)}" for name, n in sizes.items() for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = scan.numbered_scan(spark, str(tmp_path), broadcast_blocks=blocks).collect()
        assert [r.value for r in sorted(got, key=lambda r: r.row)] == want
        assert sorted(r.row for r in got) == list(range(len(want)))
        two = scan.numbered_scan(spark, [f"{tmp_path}/e.txt", f"{tmp_path}/a.txt", f"{tmp_path}/c.txt"], name="Value2")
        assert [r.value for r in sorted(two.collect(), key=lambda r: r.Value2)] == [w for w in want if w[0] == "e"] + want[:3]
        assert scan.numbered_scan(spark, f"{tmp_path}/c.txt").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbered_formats(spark, tmp_path):
    df = spark.range(1000).select("id", F.lit("f").alias("file2"))
    df.repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "p"))
    got = scan.numbered_scan(spark, str(tmp_path / "p"), "parquet")
    assert got.columns == ["id", "file2", "file", "row"] and got.where("row <> id").count() == 0 and got.count() == 1000
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    df.repartitionByRange(3, "id").sortWithinPartitions("id").write.json(str(tmp_path / "j"))
    assert scan.numbered_scan(spark, str(tmp_path / "j"), "json", "id long").where("row <> id").count() == 0


def test_answers_in_lines_and_files(spark, tmp_path):
    rows = [(i, "ABCD?"[i % 5]) for i in range(1000)]
    df = spark.createDataFrame(rows, "i long, __i string").repartition(4)
    for line in (1, 7, 1 << 16):
        writers.write_answers(df, str(tmp_path / "a"), "__i", "i", line=line)
        assert sorted((r["index"], r.answer) for r in readers.read_answers(spark, str(tmp_path / "a")).collect()) == rows
    (tmp_path / "one.txt").write_text("AB\n\nC?")
    assert sorted((r["index"], r.answer) for r in readers.read_answers(spark, str(tmp_path / "one.txt")).collect()) == [(0, "A"), (1, "B"), (2, "C"), (3, "?")]
    with pytest.raises(Exception, match="one character"):
        writers.write_answers(df.withColumn("__i", F.lit("AB")), str(tmp_path / "b"), "__i", "i")


def draws(weights, seed=42):
    total, i = sum(weights), 0
    while True:
        u, at, k = int(hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:8], 16) / 2**32, 0.0, len(weights) - 1
        for j, w in enumerate(weights[:-1]):
            at += w / total
            if u < at:
                k = j
                break
        yield k
        i += 1


@pytest.mark.parametrize("stretch", [1, 5, 1 << 16])
def test_interleave(spark, stretch):
    for sizes, weights in (((30, 10, 20), (1, 1, 2)), ((5,), (3,)), ((1, 50), (1, 9)), ((4, 0), (1, 1))):
        tables = [spark.createDataFrame([(k * 1000 + i if i else None, "c") for i in range(n)], "id long, nth string") for k, n in enumerate(sizes)]
        got = mixing.interleave([(f"s{k}", t, float(w)) for k, (t, w) in enumerate(zip(tables, weights, strict=True))], "id", stretch=stretch).collect()
        used, want = [0] * len(sizes), []
        for i, k in enumerate(draws(weights)):
            if min(sizes) == 0:
                break
            want.append((i, f"s{k}", k * 1000 + used[k] if used[k] else None))
            used[k] += 1
            if used[k] == sizes[k]:
                break
        assert sorted((r.draw, r.source_name, r.id) for r in got) == want


def test_batches_keep_every_row(spark):
    rows = [(k, [1] * n, [2] * n, [1] * n) for k, n in ((None, 3), (1, 1), (1, 5), (2, 2), (None, 4))]
    df = spark.createDataFrame(rows, "k long, input_ids array<bigint>, labels array<bigint>, attention_mask array<bigint>").repartition(3)
    got = K.padded(df, "k", 2).collect()
    assert sorted((str(r.k), sum(r.attention_mask)) for r in got) == sorted((str(k), n) for k, n, *_ in [(r[0], len(r[1])) for r in rows])
    assert sorted((r.batch_id, r.batch_idx) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert {r.k for r in got if r.batch_id == 0} == {None}
    for b in range(3):
        assert len({len(r.input_ids) for r in got if r.batch_id == b}) == 1
    assert K.padded(df.limit(0), "k").count() == 0


def test_contents_are_stripped(spark):
    m = F.array(*(F.struct(F.lit("user").alias("role"), F.lit(c).alias("content")) for c in ("\thi \n", "　a b ", None, " \n")))
    text = spark.range(1).select(K.render(m, K.LLAMA, True).alias("t")).first().t
    opened = lambda r: f"<|start_header_id|>{r}<|end_header_id|>\n\n"
    assert text == "<|begin_of_text|>" + "".join(f"{opened('user')}{c}<|eot_id|>" for c in ("hi", "a b", "", "")) + opened("assistant")


def masked(ids, left, right):
    out = list(ids)
    for s in range(len(ids)):
        if ids[s : s + len(left)] == left:
            e = next(e for e in range(s, len(ids)) if ids[e : e + len(right)] == right)
            out[s : e + len(right)] = [-100] * (e + len(right) - s)
    return out


def test_token_functions_on_any_sequence(spark):
    rng, rows = random.Random(1), []
    for k in range(300):
        ids = [rng.choice([1, 2, 3, 4, 9]) for _ in range(rng.randint(0, 25))]
        rows.append((k, [*ids, 3, 4, 5], [rng.randint(0, 1) for _ in ids], [rng.randint(0, 3) for _ in range(ids.count(9))]))
    df = spark.createDataFrame(rows, "k long, ids array<bigint>, mask array<bigint>, counts array<bigint>")
    ids, grown = F.col("ids"), T.expand_attachments(F.col("ids"), F.col("counts"), 9)
    got = {r.k: r for r in df.select("k", T.mask_between(ids, ids, [1, 2], [3, 4]).alias("two"), T.mask_between(ids, ids, [1], [3]).alias("one"), T.mask_between(ids, ids, [4], [4]).alias("same"), T.position_ids(F.col("mask")).alias("p"), grown.alias("x"), T.token_ranges(grown, F.col("counts"), 9).alias("r")).collect()}
    for k, row, mask, counts in rows:
        g, left = got[k], iter(counts)
        assert (g.two, g.one, g.same) == (masked(row, [1, 2], [3, 4]), masked(row, [1], [3]), masked(row, [4], [4]))
        assert g.p == [sum(mask[: i + 1]) - 1 if m else 0 for i, m in enumerate(mask)]
        assert g.x == [y for x in row for y in ([9] * next(left) if x == 9 and counts else [x])]
        at = [i for i, x in enumerate(g.x) if x == 9]
        assert [(r.start, r.end) for r in g.r if r.end is not None and r.start is not None and r.end > r.start] == [(at[sum(counts[:i])], at[sum(counts[:i])] + n) for i, n in enumerate(counts) if n]


def test_thousands_of_spans_in_a_row(spark):
    """8,000 spans in each of four rows: under a second once the code is compiled."""
    long = spark.range(4).select(F.flatten(F.array_repeat(F.array(*(F.lit(x).cast("long") for x in (1, 7, 7, 3, 8, 9))), 8000)).alias("ids")).withColumn("counts", F.array_repeat(F.lit(2).cast("long"), 8000)).cache()
    for c in (T.mask_between(F.col("ids"), F.col("ids"), [1], [3]), T.expand_attachments(F.col("ids"), F.col("counts"), 9), T.token_ranges(F.col("ids"), F.transform("counts", lambda x: x - 1), 9), T.position_ids(F.transform("ids", lambda x: F.when(x == 7, 1).otherwise(0)))):
        out, took = long.select(F.sum(F.size(c))), []
        for _ in range(3):
            began = time.time()
            assert out.first()[0] > 0
            took.append(time.time() - began)
        assert min(took) < 1, took
    long.unpersist()
