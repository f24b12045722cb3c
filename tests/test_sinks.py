"""Sinks with a commit, saved datasets by record batch, batched maps, observed filters."""

import errno
import glob
import json
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from quern import catalog, catalog_sources  # noqa: F401
from quern.operators import batched, evaluation
from quern.sources import files, readers, saved, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def df(spark):
    return spark.range(2000).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), "id")).alias("s"), F.array("id", "id").alias("a"))


def test_saved_and_read_by_batch(spark, df, tmp_path):
    folder = str(tmp_path / "d")
    saved.write_saved(df, folder, 3, 100)
    names = [f"data-{i:05d}-of-00003.arrow" for i in range(3)]
    assert sorted(os.listdir(folder)) == [*names, "dataset_info.json", "state.json"]
    state = json.loads((tmp_path / "d" / "state.json").read_text())
    assert [x["filename"] for x in state["_data_files"]] == names
    assert json.loads((tmp_path / "d" / "dataset_info.json").read_text())["num_rows"] == 2000
    got = saved.read_saved(spark, folder, stretch=4000)
    assert got.count() == 2000 and not got.exceptAll(df).count()
    tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 3  # more than files
    some = saved.read_saved(spark, folder, ["s", "id"])
    assert some.columns == ["s", "id"] and not some.exceptAll(df.select("s", "id")).count()
    with pytest.raises(ValueError, match="not in the dataset: x"):
        saved.read_saved(spark, folder, ["x"])
    with pytest.raises(Exception, match="holds a dataset"):
        saved.write_saved(df, folder)


def test_failed_task_leaves_no_dataset(spark, df, tmp_path):
    bad = df.withColumn("x", F.when(F.col("id") == 1999, F.raise_error(F.lit("boom")).cast("int")))
    folder = tmp_path / "d"
    with pytest.raises(Exception, match="boom"):
        saved.write_saved(bad.repartition(4, "id"), str(folder))
    assert not folder.exists() or os.listdir(folder) == []
    saved.write_saved(df.limit(0), str(folder))
    empty = saved.read_saved(spark, str(folder))
    assert empty.count() == 0 and empty.columns == df.columns


def test_state_decides_which_files(spark, tmp_path):
    def put(name, ids):
        with pa.OSFile(str(tmp_path / name), "wb") as f, pa.ipc.new_stream(f, pa.schema([("id", pa.int64())])) as w:
            w.write_batch(pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64())}))

    put("b.arrow", [1, 2])
    put("a.arrow", [3])
    put("cache-x.arrow", [99])
    (tmp_path / "dataset_info.json").write_text("{}")
    with pytest.raises(ValueError, match="without state.json"):
        readers.read_table(spark, str(tmp_path), "arrow")
    (tmp_path / "state.json").write_text(json.dumps({"_data_files": [{"filename": "b.arrow"}, {"filename": "a.arrow"}]}))
    assert [os.path.basename(f) for f in saved.data_files(str(tmp_path))] == ["b.arrow", "a.arrow"]
    assert sorted(r.id for r in readers.read_table(spark, str(tmp_path)).collect()) == [1, 2, 3]
    (tmp_path / "state.json").write_text(json.dumps({"_data_files": [{"filename": "gone.arrow"}]}))
    with pytest.raises(ValueError, match="lacks gone.arrow"):
        readers.read_table(spark, str(tmp_path))


def test_dictionaries_and_changes_of_them(spark, tmp_path):
    kind = pa.dictionary(pa.int32(), pa.string())
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_stream(f, pa.schema([("s", kind), ("n", pa.int64())])) as w:
        for k in range(6):
            words = [f"w{k // 2}{i}" for i in range(3)]
            w.write_batch(pa.RecordBatch.from_arrays([pa.array([*words, None]).dictionary_encode().cast(kind), pa.array([k] * 4)], names=["s", "n"]))
    for n in ("dataset_info", "state"):
        (tmp_path / f"{n}.json").write_text("{}")
    want = sorted((f"w{k // 2}{i}" if i < 3 else "", k) for k in range(6) for i in range(4))
    for stretch in (1, 600, 1 << 20):
        assert sorted((r.s or "", r.n) for r in saved.read_saved(spark, str(tmp_path), stretch=stretch).collect()) == want
    assert {r.n for r in saved.read_saved(spark, str(tmp_path), ["n"]).collect()} == set(range(6))
    (tmp_path / "a.arrow").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception):  # noqa: B017
        saved.read_saved(spark, str(tmp_path)).collect()


def test_files_appear_whole_or_fail(spark, tmp_path):
    rows = [("a/b", b"1"), ("../x", b"2"), ("/etc/none", b"3"), (None, b"4"), ("n", None), ("e", b""), ("a/b/c", b"a file is in the way")]
    failed = writers.write_images(spark.createDataFrame(rows, "path string, bytes binary").coalesce(1), f"file:{tmp_path}/out")
    assert (tmp_path / "out/a/b").read_bytes() == b"1" and (tmp_path / "out/e").read_bytes() == b""
    assert {r.path for r in failed.collect()} == {"../x", "/etc/none", None, "n", "a/b/c"} and not (tmp_path / "x").exists()
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith(".aside")]
    again = writers.write_images(spark.createDataFrame([("a/b", b"new")], "path string, bytes binary"), f"{tmp_path}/out")
    assert again.count() == 0 and (tmp_path / "out/a/b").read_bytes() == b"new"
    assert writers.write_images(spark.createDataFrame([], "path string, bytes binary"), f"{tmp_path}/none").count() == 0


def test_failed_file_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") == 99, F.raise_error(F.lit("boom")).cast("binary")).otherwise(F.lit("x").cast("binary")).alias("bytes")).coalesce(1)
    with pytest.raises(Exception, match="boom"):
        writers.write_images(rows, str(tmp_path / "out"))
    assert not glob.glob(str(tmp_path / "out/f*")) and not glob.glob(str(tmp_path / "out/.aside*"))


@pytest.mark.parametrize("fails", ["open_output_stream", "move"])
def test_failing_store_isnt_a_rows_fault(tmp_path, monkeypatch, fails):
    class Full:
        store, left = pa.fs.LocalFileSystem(), 1

        def __getattr__(self, name):
            if name == fails and self.left:
                self.left = 0
                raise OSError(errno.ENOSPC, "No space left on device")
            return getattr(self.store, name)

    full = Full()
    monkeypatch.setattr(files, "store_of", lambda path: (full, path))
    batch = pa.RecordBatch.from_pydict({"path": ["a", "b"], "bytes": [b"1", b"2"]})
    with pytest.raises(OSError, match="No space left"):
        files.FileWriter(str(tmp_path)).write(iter([batch]))


@pytest.mark.parametrize("names", [["a.txt", "b.bin", "_c.txt", ".d.txt", "e._COPYING_", "x/f.txt", "_y/g.txt", "x/z/h {1}.txt"], ["k=1/a.txt", "k=2/b.bin", "k=2/_c.txt"]])
def test_empty_files_are_scanned_like_others(spark, tmp_path, names):
    for tree, data in (("full", b"1"), ("none", b"")):
        for n in names:
            (tmp_path / tree / n).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / tree / n).write_bytes(data)
    for folder in ("", "/*.txt") if "a.txt" in names else ("",):
        for pattern in (None, "*.txt", "[a-g].{txt,bin}"):
            for recursive in (False, True):
                full, none = ({(r.path, bytes(r.bytes)) for r in readers.read_files(spark, f"{tmp_path}/{tree}{folder}", pattern, recursive).collect()} for tree in ("full", "none"))
                assert full and none == {(p.replace("/full/", "/none/"), b"") for p, _ in full}
    assert {r.path for r in readers.empty_files(spark, f"{tmp_path}/none", None, True).collect()} == {r.path for r in readers.read_files(spark, f"{tmp_path}/none", None, True).collect()}


def test_empty_files_of_a_store_that_only_spark_opens(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for n, data in (("a.txt", b"1"), ("b.txt", b""), ("_c.txt", b""), ("x/d.txt", b"")):
        (tmp_path / n).write_bytes(data)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sinks.link./in", f"file://{tmp_path}")
    for recursive, want in ((False, {"a.txt", "b.txt"}), (True, {"a.txt", "b.txt", "x/d.txt"})):
        assert {r.path for r in readers.read_files(spark, "viewfs://sinks/in", "*.txt", recursive).collect()} == {f"viewfs://sinks/in/{n}" for n in want}


ODD = [(1, "a"), (2, ""), (3, None), (7, "x"), (14, ""), (21, None), (None, "n"), (None, None), (5, "one"), (5, "two"), (5, "two"), (28, "k"), (28, "k"), (-7, "m"), (-8, "mm")]


@pytest.mark.parametrize("rows", [ODD, [(7, "a"), (14, "")], []])
def test_file_sink_of_odd_documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["file_sink"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in catalog.QUERIES["file_sink"](spark, str(tmp_path)).collect())


def test_map_batches(spark, df):
    sizes = batched.map_batches(df.coalesce(1), lambda c: {"n": np.array([len(c["id"])]), "total": [int(c["a"].values.sum())]}, "n long, total long", size=300).collect()
    assert [r.n for r in sizes] == [300] * 6 + [200] and sum(r.total for r in sizes) == 2 * sum(range(2000))
    kept = batched.map_batches(df, lambda c: {"a": batched.Lists(c["a"].offsets, c["a"].values + 1), "s": c["s"]}, "a array<bigint>, s string", size=7)
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.select(F.transform("a", lambda x: x + 1).alias("a"), "s").collect()))
    sliced = batched.map_batches(df.where("id > 5").coalesce(1), lambda c: {"first": c["a"].values[c["a"].offsets[:-1]]}, "first long", size=11)
    assert sorted(r.first for r in sliced.collect()) == list(range(6, 2000))

    def fails(c):
        if (c["id"] == 1003).any():
            raise ValueError("no")
        return {"id": c["id"]}

    with pytest.raises(Exception, match="no"):
        batched.map_batches(df, fails, "id long").collect()
    one = df.coalesce(1)
    assert batched.map_batches(one, fails, "id long", 100, "drop").count() == 1900
    assert batched.map_batches(one, fails, "id long", 100, "rows").count() == 1999
    assert batched.map_batches(df.limit(0), fails, "id long").count() == 0
    assert batched.filter_batches(df, lambda c: c["id"] % 2 == 0, 13).count() == 1000
    for bad in ({"errors": "x"}, {"size": 0}):
        with pytest.raises(ValueError):
            batched.map_batches(df, fails, "id long", **bad)


def test_observed_filter_scans_once(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    kept, before, after = evaluation.observed_filter(spark.read.parquet(str(tmp_path / "t")), F.col("s").isNotNull())
    kept.write.parquet(str(tmp_path / "out"))
    assert (before.get["before"], after.get["after"]) == (2000, 1600) and plan(kept).count("FileScan") == 1
