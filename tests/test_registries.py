"""Archives by member, registries by need and by place, Bloom filters: literal cases and plans."""

import io
import os
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import images as I  # noqa: E741
from quern.plans import captions
from quern.sources import archives, payloads, ranges, readers, registries, volumes
from quern.sources.bloom import Bloom


def tar(path, named):
    with tarfile.open(path, "w") as t:
        t.addfile(tarfile.TarInfo("folder"))
        for n, b in named:
            info = tarfile.TarInfo(n)
            info.size = len(b)
            t.addfile(info, io.BytesIO(b))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tars(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tars")
    files = {a: [(f"x/{a}{i}.txt", f"{a}{i} ".encode() * i) for i in range(30)] for a in "bac"}
    for a, named in files.items():
        tar(folder / f"{a}.tar", named)
    tar(folder / "d.tar", [("long/" + "n" * 200, b"last")])  # a name that needs a header of its own
    return str(folder), [m for a in "abc" for m in [("folder", b""), *files[a]]] + [("folder", b""), ("long/" + "n" * 200, b"last")]


def test_members_in_order_with_their_places(spark, tars):
    folder, want = tars
    index = archives.ArchiveIndex.build(spark, folder)
    got = index.members().orderBy("number").collect()
    assert [(r.number, r.name) for r in got] == [(i, n) for i, (n, _) in enumerate(want)]
    for r in got:
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert f.read(r.size) == want[r.number][1]


def test_filters_reach_the_source(spark, tars):
    folder, want = tars
    read = archives.ArchiveIndex.build(spark, folder).read()
    some = read.where("number between 25 and 35 and name like 'x/%'")
    assert "PushedFilters: [GreaterThanOrEqual(number,25), LessThanOrEqual(number,35)]" in some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert sorted((r.number, bytes(r.bytes)) for r in some.collect()) == [(i, want[i][1]) for i in range(25, 36) if want[i][0] != "folder"]
    for condition, numbers in (("number in (3, 64, 1000)", [3, 64]), ("number = 5 and number in (5, 6)", [5]), ("number > 90 and number < 93", [91, 92]), ("number < 0", []), ("number is null", []), ("number >= 0", range(len(want)))):
        assert sorted((r.number, r.name, bytes(r.bytes)) for r in read.where(condition).collect()) == [(i, *want[i]) for i in numbers], condition


def test_partitions_hold_only_what_is_asked_for(spark, tars):
    index = archives.ArchiveIndex.build(spark, tars[0])
    index.read()
    reader = archives.ArchiveReader(index.path, 40)
    assert len(reader.partitions()) > 20
    list(reader.pushFilters([archives.In(("number",), (2, 70)), archives.GreaterThan(("number",), 1)]))
    parts = reader.partitions()
    assert [(os.path.basename(a), wanted) for p in parts for a, _, _, _, wanted in p.stretches] == [("a.tar", [2]), ("c.tar", [70])]
    assert [b.column(0).to_pylist() for p in parts for b in reader.read(p)] == [[2], [70]]
    assert len(archives.ArchiveReader(index.path, 1 << 30).partitions()) == 1  # small archives share a task


def test_zip_packed_and_plain_and_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/", b"")
        z.writestr("plain", b"abc" * 10)
        z.writestr("packed", b"abc" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("none", b"", zipfile.ZIP_DEFLATED)
    index = archives.ArchiveIndex.build(spark, str(tmp_path), "*.zip")
    assert {r.name: bytes(r.bytes) for r in index.read().collect()} == {"plain": b"abc" * 10, "packed": b"abc" * 1000, "none": b""}
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("bz", b"x" * 99, zipfile.ZIP_BZIP2)
    with pytest.raises(Exception, match="isn't read"):
        archives.ArchiveIndex.build(spark, str(tmp_path), "*.zip")
    tar(tmp_path / "out.tar", [("../x", b"1")])
    with pytest.raises(Exception, match="leaves the archive"):
        archives.ArchiveIndex.build(spark, str(tmp_path), "out.tar")


def test_archives_beyond_two_gigabytes(spark, tmp_path):
    """A sparse archive of 3 GB: its last member is found by headers and read alone."""
    big = 3 << 30
    first, last = tarfile.TarInfo("big"), tarfile.TarInfo("small")
    first.size, last.size = big, 5
    with open(tmp_path / "a.tar", "wb") as f:
        f.write(first.tobuf(tarfile.GNU_FORMAT))
        f.seek(big, 1)
        f.write(last.tobuf(tarfile.GNU_FORMAT) + b"hello".ljust(512, b"\0") + b"\0" * 1024)
    index = archives.ArchiveIndex.build(spark, str(tmp_path))
    assert [(r.name, bytes(r.bytes)) for r in index.read().where("number = 1").collect()] == [("small", b"hello")]


def test_no_archives(spark, tmp_path):
    tar(tmp_path / "x.other", [])
    index = archives.ArchiveIndex.build(spark, str(tmp_path))
    assert index.members().count() == index.read().count() == 0


ITEM = "array<struct<type:string,value:string>>"


def test_archive_registry_reads_last(spark, tars):
    folder, want = tars
    registry = registries.registry_of("wids", spark, folder)
    rows = [(1, [("image", "3"), ("image", "70")]), (1, [("image", "3")]), (None, []), (2, None), (3, [("image", "5000")]), (4, [("image", None), None])]
    samples = spark.createDataFrame(rows, f"key long, modalities {ITEM}")
    assert sorted(str(r.key) for r in registry.check(samples).collect()) == ["1", "1", "2", "None"]
    got = registries.merged(samples, registry, strict=False)
    shown = [(str(r.key), None if r.modalities is None else [m and m.value and bytes(m.value) for m in r.modalities]) for r in got.collect()]
    assert sorted(map(repr, shown)) == sorted(map(repr, [("1", [want[3][1], want[70][1]]), ("1", [want[3][1]]), ("None", []), ("2", None), ("3", [None]), ("4", [None, None])]))
    with pytest.raises(Exception, match="not in the registry"):
        registries.merged(samples, registry).collect()
    text = plan(got)
    assert text.index("MapInArrow") < text.index("Exchange")  # the fetch stands above all shuffles


def test_table_registry_joins_by_place(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 200).cast("string").alias("path"), F.concat(F.lit("v"), "id").cast("binary").alias("bytes"), "id")
    payloads.write_registry(rows.unionByName(rows.limit(3).withColumn("path", F.lit(None).cast("string"))), "payload_test", 4, F.col("id"), location=str(tmp_path / "t"))
    try:
        assert spark.table("payload_test").count() == 200
        registry = registries.registry_of("table", spark, "payload_test")
        item = lambda c: F.struct(F.lit("t").alias("type"), c.cast("string").alias("value"))
        samples = spark.range(300).select("id", F.array(item(F.col("id")), item(F.col("id") % 7)).alias("modalities"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        got = registry.merge(samples)
        want = {i: [f"v{i + 200}" if i < 200 else None, f"v{i % 7 + 200}"] for i in range(300)}
        assert {r.id: [m.value and m.value.decode() for m in r.modalities] for r in got.collect()} == want
        text = plan(got)
        scan = text[: text.index("FileScan parquet spark_catalog.default.payload_test")].split("\n")[-6:]
        join = max(i for i, line in enumerate(scan) if "Join" in line or "+-" in line)
        assert not any("Exchange" in line for line in scan[join:]), text  # the registry's side isn't shuffled
        assert "ReadSchema: struct<path:string,_tmp_metadata_row_index:bigint>" in text  # places, no payloads
        assert registry.check(samples).count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.sql("DROP TABLE payload_test")


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pictures")
    good = I.encode_png(np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 4, 3))
    files = {"good.png": good, "low.png": I.encode_png(np.zeros((1, 4, 3), np.uint8)), "cut.png": good[:-20], "bad.png": good[:45] + bytes([good[45] ^ 255]) + good[46:], "text.png": b"no image", "empty.png": b"", "deep/also.png": good}
    files |= {f"unused{i}.png": good for i in range(40)}
    for name, data in files.items():
        os.makedirs(os.path.dirname(folder / name), exist_ok=True)
        (folder / name).write_bytes(data)
    return str(folder)


def test_only_referenced_files_are_opened(spark, pictures):
    registry = registries.registry_of("path", spark, pictures)
    item = lambda v: ("image", v)
    rows = [(i, [item(n)]) for i, n in enumerate(["good.png", "low.png", "cut.png", "bad.png", "text.png", "empty.png", "missing.png", "deep/also.png"])]
    rows += [(20, []), (21, None), (22, [item("good.png"), item("deep/also.png")]), (23, [item("good.png"), item("low.png")]), (24, [item(None)])]
    samples = spark.createDataFrame(rows, f"key long, modalities {ITEM}")
    heads = registry.headers(samples).collect()
    assert sum(r.opened for r in heads) == len(heads) == 6  # of the eight referenced one isn't there, and one is empty, which a listing leaves out
    assert all(r.bytes_read <= registries.HEADER for r in heads)
    assert sorted(r.key for r in registry.check(samples).collect()) == [0, 7, 20, 21, 22]
    assert sorted(r.key for r in registry.with_headers(samples).collect()) == [0, 1, 2, 3, 7, 20, 21, 22, 23]
    assert registry.check(samples.limit(0)).count() == 0


def test_verified_png_by_pieces():
    rng = np.random.default_rng(0)
    data = I.encode_png(rng.integers(0, 255, (40, 30, 3)).astype(np.uint8))
    read = lambda d: lambda offset, size: d[offset : offset + size]
    for step in (1, 7, 1 << 20):
        assert I.verified_png(read(data), step) == 40
    assert I.verified_png(read(data[:-12])) is None and I.verified_png(read(b"")) is None
    for i in range(8, len(data) - 12, 97):
        assert I.verified_png(read(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])) is None
    few = data[:8] + I.encode_png(np.zeros((2, 30, 3), np.uint8))[8:]
    short = few.replace(few[16:24], data[16:24])  # a header that promises more lines
    crc = zlib.crc32(short[12:29]).to_bytes(4)
    assert I.verified_png(read(short[:29] + crc + short[33:])) is None


def test_pixels_are_red_first(spark, tmp_path):
    px = np.array([[[255, 0, 10], [1, 2, 3]], [[0, 255, 0], [9, 8, 7]]], np.uint8)
    (tmp_path / "a.png").write_bytes(I.encode_png(px))
    (tmp_path / "grey.png").write_bytes(I.encode_png(px[:, :, :1]))
    (tmp_path / "clear.png").write_bytes(I.encode_png(np.dstack([px, np.full((2, 2), 255, np.uint8)])))
    (tmp_path / "bad.png").write_bytes(b"x")
    got = {os.path.basename(r.path): r.p for r in readers.read_images(spark, str(tmp_path)).select("path", readers.rgb_pixels(F.col("pixels"), F.col("channels")).alias("p")).collect()}
    assert got["a.png"] == got["clear.png"] == px.tobytes() and got["bad.png"] is None
    assert got["grey.png"] == np.repeat(px[:, :, :1], 3, axis=2).tobytes()


def test_bloom_drops_most_and_loses_none(spark):
    keys = spark.range(0, 20_000, 2).select(F.col("id").cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    bloom = Bloom(keys, "k")
    found = spark.range(20_000).select(F.col("id").cast("string").alias("k")).where(bloom.may_have(F.col("k")))
    even, odd = found.where("k % 2 = 0").count(), found.where("k % 2 = 1").count()
    assert even == 10_000 and odd < 300
    assert Bloom(keys.limit(0), "k").bits == 16 and keys.where(Bloom(keys.limit(0), "k").may_have(F.col("k"))).count() == 0


def test_ranges_count_what_they_open(tmp_path):
    for i in range(ranges.OPEN_FILES + 5):
        (tmp_path / str(i)).write_bytes(b"0123456789")
    r = ranges.Ranges()
    assert [r.get(f"file:{tmp_path}/{i}", 3, 4) for i in (0, 0, 1)] == [b"3456"] * 3 and (r.opened, r.read) == (2, 12)
    for i in range(ranges.OPEN_FILES + 5):
        r.get(f"{tmp_path}/{i}", 0, 1)
    assert len(r.files) == ranges.OPEN_FILES
    with pytest.raises(ValueError, match="4 of 9 bytes"):
        r.member(f"{tmp_path}/0", 6, 9, 9, "stored")
    r.close()


def jvm_image(spark, path, kind, width, height):
    """An image that the JVM encodes: grey levels that rise to the right."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 5)
    for x in range(width):
        for y in range(height):
            image.setRGB(x, y, (x * 20 % 256) * 0x010101)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


def test_other_formats_are_decoded_by_the_source(spark, tmp_path, monkeypatch):
    for kind in ("jpg", "gif", "bmp"):
        jvm_image(spark, tmp_path / f"good.{kind}", kind, 9, 6)
        jvm_image(spark, tmp_path / f"low.{kind}", kind, 9, 1)
        (tmp_path / f"cut.{kind}").write_bytes((tmp_path / f"good.{kind}").read_bytes()[:26])
    registry = registries.registry_of("path", spark, str(tmp_path))
    names = [f"{n}.{k}" for n in ("good", "low", "cut") for k in ("jpg", "gif", "bmp")]
    samples = spark.createDataFrame([(n, [("image", n)]) for n in names], f"key string, modalities {ITEM}")
    heads = {r.path: (r.format, r.width, r.height) for r in registry.headers(samples).collect()}
    assert heads["good.jpg"] == ("jpeg", 9, 6) and heads["good.gif"] == ("gif", 9, 6) and heads["low.bmp"] == ("bmp", 9, 1)
    for most in (registries.DECODE_PATHS, 2):  # by their paths, and with the whole folder
        monkeypatch.setattr(registries, "DECODE_PATHS", most)
        assert sorted(r.key for r in registry.check(samples).collect()) == ["good.bmp", "good.gif", "good.jpg"]


def test_pairs_of_pixels_and_ids(spark, tmp_path):
    for kind in ("jpg", "png"):
        jvm_image(spark, tmp_path / f"a.{kind}", kind, 8, 8)
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = [(1, "a.jpg", "one two three"), (2, "a.png", "one"), (3, "a.png", None), (4, "bad.png", "x"), (5, "gone.png", "x"), (6, None, "x")]
    pairs = spark.createDataFrame(rows, "id long, image_path string, caption string")
    images = readers.read_images(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    ids = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), " "), lambda w: F.length(w).cast("long"))
    made = captions.image_text_pairs(pairs, images, ids, length=2, pad=-1, size=8, mean=[0.5] * 3, std=[0.5] * 3)
    assert made.columns == ["id", "input_ids", "pixel_values", "attention_mask"]
    got = {r.id: r for r in made.collect()}
    assert sorted(got) == [1, 2, 3]
    assert [(got[i].input_ids, got[i].attention_mask) for i in (1, 2, 3)] == [([3, 3], [1, 1]), ([3, -1], [1, 0]), ([0, -1], [1, 0])]
    want = np.array([[x * 20 % 256 for x in range(8)]] * 8) / 255 * 2 - 1
    assert np.allclose(np.array(got[2].pixel_values).reshape(3, 8, 8), want)
    assert np.abs(np.array(got[1].pixel_values).reshape(3, 8, 8) - want).max() < 0.1  # a lossy format


def test_pixel_values_resize_and_cut(spark):
    px = np.full((9, 6, 3), 51, np.uint8)
    df = spark.createDataFrame([(1, bytearray(px.tobytes()), 9, 6), (2, None, None, None)], "id long, rgb binary, h int, w int")
    got = {r.id: r.v for r in df.select("id", I.pixel_values(F.col("rgb"), F.col("h"), F.col("w"), 4, [0.2] * 3, [0.5] * 3).alias("v")).collect()}
    assert got[2] is None and np.allclose(got[1], 0) and len(got[1]) == 48


def test_volumes_by_slab(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = {"c": rng.normal(size=(7, 3, 2)), "f": np.asfortranarray(rng.integers(-9, 9, (4, 5)).astype(np.int16)), "one": np.float32(2.5), "none": np.zeros((0, 4)), "flat": np.zeros((3, 0)), "big": np.arange(10, dtype=">i8"), "flags": np.array([True, False])}
    for name, a in made.items():
        np.save(tmp_path / f"{name}.npy", a)
    for slab in (1, 100, 1 << 20):
        got: dict = {}
        for r in volumes.read_volume_slabs(spark, str(tmp_path), slab=slab).collect():
            got.setdefault(os.path.basename(r.path)[:-4], []).append(r)
        assert set(got) == set(made) - {"none", "flat"}
        for name, rows in got.items():
            rows.sort(key=lambda r: r.start)
            assert [r.start for r in rows] == [0, *(r.stop for r in rows[:-1])] and tuple(rows[0].shape) == np.shape(made[name])
            assert [v for r in rows for v in r["values"]] == np.asarray(made[name], float).ravel(order="K").tolist()
        assert len(got["c"]) == {1: 7, 100: 4, 1 << 20: 1}[slab]
    for name, data in (("cut", (tmp_path / "c.npy").read_bytes()[:-1]), ("text", b"no array"), ("complex", None), ("objects", None)):
        if data is None:
            np.save(tmp_path / f"{name}.npy", np.array([1j]) if name == "complex" else np.array([{}], dtype=object), allow_pickle=True)
        else:
            (tmp_path / f"{name}.npy").write_bytes(data)
        with pytest.raises(Exception, match=f"{name}.npy"):
            volumes.read_volume_slabs(spark, str(tmp_path), f"{name}.npy").collect()
