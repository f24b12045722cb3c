"""Operators on nulls, ties, repeated rows, empty tables and clashing names; literal cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import images as I  # noqa: E741
from quern.functions import tokens as T
from quern.functions import vectors as V
from quern.operators import evaluation, indexing, mixing, modalities
from quern.plans import supervision
from quern.sources import readers, registries, writers

ITEM = "array<struct<type:string,value:string,token_range:struct<start:long,end:long>,note:string>>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.fixture(scope="module")
def samples(spark):
    a = lambda v: ("image", v, (1, 3), "n")
    rows = [(None, [a("p"), a("q")], "x"), (1, [a("q"), a("p")], "y"), (1, [a("q"), a("p")], "y"), (1, [], "z"), (2, None, "w"), (3, [a("none"), None], "v"), (4, [a(None)], "u")]
    return spark.createDataFrame(rows, f"key long, modalities {ITEM}, __path string").repartition(3)


def test_merge_keeps_every_row(spark, samples):
    registry = spark.createDataFrame([("p", "P1", 1), ("p", "P2", 2), ("q", "Q", 1), (None, "N", 1)], "path string, payload string, nth int")
    got = modalities.merge_registry(samples, registry, order=["nth"])
    assert got.columns == samples.columns
    assert [f.name for f in got.schema["modalities"].dataType.elementType.fields] == ["type", "token_range", "value"]
    shown = sorted((str(r.key), r["__path"], None if r.modalities is None else [m and m.value for m in r.modalities]) for r in got.collect())
    assert shown == sorted([("None", "x", ["P2", "Q"]), ("1", "y", ["Q", "P2"]), ("1", "y", ["Q", "P2"]), ("1", "z", []), ("2", "w", None), ("3", "v", [None, None]), ("4", "u", [None])], key=lambda r: (r[0], r[1]))
    with pytest.raises(Exception, match="not in the registry"):
        modalities.merge_registry(samples, registry, strict=True).collect()
    assert modalities.merge_registry(samples.limit(0), registry).count() == 0


def test_valid_samples_judges_each_row(spark, samples):
    registry = spark.createDataFrame([("p", 5), ("q", 1), ("q", 7)], "path string, height int")
    assert sorted(r["__path"] for r in modalities.valid_samples(samples, registry).collect()) == ["w", "x", "y", "y", "z"]
    assert sorted(r["__path"] for r in modalities.valid_samples(samples, registry.where("height <> 5")).collect()) == ["w", "z"]
    assert modalities.check_if(samples, False, registry) is samples


def test_types(spark, samples):
    with pytest.raises(ValueError, match="twice: a"):
        modalities.distinct_types(["a", "b", "a"])
    with pytest.raises(Exception, match="no processor"):
        modalities.process_by_type(samples, {"ct": F.upper}).collect()
    assert {m.value for r in modalities.process_by_type(samples, {"image": F.upper}).collect() for m in r.modalities or [] if m} == {"P", "Q", "NONE", None}
    assert modalities.require_columns(samples, "key") is samples
    with pytest.raises(ValueError, match="missing: text"):
        modalities.require_columns(samples, "text")


def test_index_spreads_ties_and_keeps_columns(spark):
    df = spark.createDataFrame([(k, i, "b") for i, k in enumerate([5, 5, None, 1, 5, None, 5])], "k long, __key long, __bucket string").repartition(4)
    for parts in (1, 5):
        got = sorted(indexing.with_index(df, F.col("k"), "__key", parts=parts).collect(), key=lambda r: r["index"])
        assert [r["index"] for r in got] == list(range(7))
        assert [(r.k, r["__key"]) for r in got] == [(None, 2), (None, 5), (1, 3), (5, 0), (5, 1), (5, 4), (5, 6)]
    assert indexing.with_index(df.limit(0), F.col("k")).columns == ["k", "__key", "__bucket", "index"]
    assert indexing.with_index(df.limit(0), F.col("k")).count() == 0
    assert indexing.rows_from(df, 5, F.col("k"), "__key").count() == 2
    parts = [indexing.shard(df, F.col("k"), 3, i, "__key").count() for i in range(3)]
    assert parts == [3, 2, 2]


def test_splits_and_balance(spark):
    df = spark.range(11).withColumn("label", F.col("id") % 2)
    assert {r["split"]: r["count"] for r in indexing.train_test(df, "id", test=0.1).groupBy("split").count().collect()} == {"test": 2, "train": 9}
    assert {r["split"]: r["count"] for r in indexing.train_test(df, "id", train=0.8).groupBy("split").count().collect()} == {"test": 3, "train": 8}
    assert mixing.balance(df, "label", "id", 1).groupBy("label").count().agg(F.min("count"), F.max("count")).first()[:] == (5, 5)
    with pytest.raises(ValueError, match="no row"):
        mixing.balance(df, "label", "id", 9)


def test_vectors(spark):
    v = F.array(*(F.lit(float(x)) for x in (3, 4, 0)))
    assert one(spark, V.l2_normalize(v)) == pytest.approx([0.6, 0.8, 0.0])
    assert one(spark, V.softmax(v)) == pytest.approx(list(np.exp([3, 4, 0]) / np.exp([3, 4, 0]).sum()))
    assert one(spark, V.cross_entropy(v, F.lit(1))) == pytest.approx(float(np.log(np.exp([3, 4, 0]).sum()) - 4))
    p = F.array(*(F.lit(x) for x in (0.25, 0.5, 0.25)))
    assert [one(spark, V.draw(p, F.lit(u))) for u in (0.0, 0.2, 0.25, 0.74, 0.75, 0.999, 1.0)] == [0, 0, 1, 1, 2, 2, 2]
    long = spark.range(20).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("double")).alias("v"))
    assert long.select(F.size(V.softmax(F.col("v"))), F.size(T.position_ids(F.transform("v", lambda x: F.lit(1))))).distinct().first()[:] == (20_000, 20_000)
    assert one(spark, T.position_ids(F.array(*(F.lit(x) for x in (0, 1, 0, 1, 1))))) == [0, 0, 0, 1, 2]
    assert one(spark, T.position_ids(F.array(F.lit(0), F.lit(0)))) == [0, 0]


def test_roles_and_reports(spark):
    turns = spark.createDataFrame([(1, 0, "tool", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="unknown role: tool"):
        supervision.supervised(turns).collect()
    assert evaluation.counted_filter(spark.range(5), F.when(F.col("id") > 2, F.col("id") > 3)).first()[:] == (5, 1, 4)


def test_images():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4):
        x = rng.integers(0, 256, (5, 7, n), np.uint8)
        png = I.encode_png(x)
        assert (I.decode_png(png) == x).all()
        assert I.header(png) == ("png", 7, 5)
    for kind in range(5):  # a line's filters
        line, up = rng.integers(0, 256, 12, np.uint8), rng.integers(0, 256, 12, np.uint8)
        raw = [0] * 3 + I._unfiltered(kind, line, up, 3).tolist()
        above = [0] * 3 + up.tolist()
        for i in range(3, 15):
            a, b, c = raw[i - 3], above[i], above[i - 3]
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            assert (raw[i] - [0, a, b, (a + b) // 2, paeth][kind]) % 256 == line[i - 3]
    assert I.header(b"GIF89a\x03\x00\x04\x00") == ("gif", 3, 4)
    assert I.header(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x06\x01\x00\x00\x00") == ("jpeg", 6, 5)
    assert I.header(b"") is I.header(None) is I.header(b"text") is None
    flat = I.prepared(np.full((9, 6, 3), 51, np.uint8), 4, [0.2] * 3, [0.5] * 3)
    assert flat.shape == (3, 4, 4)
    assert np.abs(flat).max() < 1e-9


def test_sources(spark, tmp_path):
    bad = writers.write_images(spark.createDataFrame([("../x", b"1"), ("a/b", b"2")], "path string, bytes binary"), str(tmp_path / "files")).collect()
    assert [r.path for r in bad] == ["../x"]
    found = registries.FileRegistry(spark, str(tmp_path / "files")).lookup().collect()
    assert [(r.path, bytes(r.payload)) for r in found] == [("a/b", b"2")]
    with pytest.raises(NotImplementedError):
        registries.registry_of("hdf5", spark, "x")
    with pytest.raises(ValueError, match="not a saved dataset"):
        readers.read_saved_dataset(spark, str(tmp_path / "files"))
    with pytest.raises(ValueError, match="one format"):
        readers.read_table(spark, str(tmp_path / "files"))
