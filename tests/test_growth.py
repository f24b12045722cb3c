"""What a task holds or reads at a time doesn't grow with its rows."""

import pyarrow as pa

from quern.plans import tokenization as K


class _Watched:
    """A tokenizer that notes how much it is handed at a time."""

    def __init__(self, tok):
        self.tok, self.most = tok, 0

    def encode_batch(self, texts, **options):
        self.most = max(self.most, sum(len(t.encode()) for t in texts))
        return self.tok.encode_batch(texts, **options)

    encode_batch_fast = encode_batch

    def decode_batch(self, rows, **options):
        self.most = max(self.most, sum(map(len, rows)))
        return self.tok.decode_batch(rows, **options)


def test_tokenizer_is_handed_bounded_slices():
    import public_tokenizers

    tok = K._tokenizer(public_tokenizers.path("byte_bpe_50k.json"), ("<|eot_id|>",))
    texts = [None, "", "é 日本 <|eot_id|>\n", *(f"line {i} of some words" * 40 for i in range(2500)), "x " * K.SLICE_BYTES, None]
    watched = _Watched(tok)
    ids = K._encoded(watched, pa.array(texts, pa.string()).slice(0))
    assert watched.most == 2 * K.SLICE_BYTES  # the row that is larger by itself
    assert ids.to_pylist() == [None if t is None else tok.encode(t, add_special_tokens=False).ids for t in texts]
    short = K._encoded(_Watched(tok), pa.array(texts[:-2], pa.string()))
    watched = _Watched(tok)
    back = K._decoded(watched, short, False)
    assert watched.most <= K.SLICE_IDS < len(short.flatten())
    assert back.to_pylist() == texts[:-2]
    assert K._encoded(tok, pa.array(texts[1:4], pa.string()).slice(1, 1)).to_pylist() == [tok.encode(texts[2], add_special_tokens=False).ids]
    assert K._decoded(tok, short.slice(1, 2), False).to_pylist() == texts[1:3]
    assert len(K._encoded(tok, pa.array([], pa.string()))) == len(K._decoded(tok, short.slice(0, 0), False)) == 0


def test_row_groups_are_read_once_a_window(tmp_path, monkeypatch):
    import random

    import pyarrow.parquet as pq

    from quern.sources import payloads

    file = f"{tmp_path}/a.parquet"
    pq.write_table(pa.table({"path": [str(i) for i in range(3000)], "bytes": [b"%d" % i * 50 for i in range(3000)]}), file, row_group_size=30)
    rows = [[{"file": file, "row": r}, None, {"file": file, "row": 2999 - r}] for r in random.Random(1).sample(range(3000), 3000)]
    batches = [pa.RecordBatch.from_pylist([{"k": i, "at": row} for i, row in part]) for part in (list(enumerate(rows))[s : s + 700] for s in range(0, 3000, 700))]

    def fetched(most):
        monkeypatch.setattr(payloads, "FETCH_BYTES", most)
        groups, seen, reads = payloads._Groups("bytes"), [], []
        for window in payloads._windows(iter(batches), 1, groups):
            was = groups.read
            listed = [row for _, part in window for row in part]
            assert [row for b, _ in window for row in b.column(1).to_pylist()] == listed
            got = {p: groups.get(*p) for p in sorted({(x["file"], x["row"]) for row in listed for x in row if x})}
            assert all(v == b"%d" % p[1] * 50 for p, v in got.items())
            assert sum(map(len, got.values())) < 2 * most
            seen += listed
            reads.append(groups.read - was)
        groups.close()
        assert seen == rows
        return reads

    assert fetched(64 << 20) == [100]  # by rows of 64 they were some thousands
    assert len(many := fetched(1 << 18)) > 2 and max(many) <= 100


def test_shards_stay_small(spark, tmp_path, monkeypatch):
    import glob

    from quern.sources import saved

    df = spark.range(5000).selectExpr("id", "repeat('x', 200) as text")
    saved.write_saved(df, f"{tmp_path}/few", 3)
    monkeypatch.setattr(saved, "SHARD_BYTES", 1 << 16)
    saved.write_saved(df, f"{tmp_path}/many", 3)
    assert len(glob.glob(f"{tmp_path}/few/*.arrow")) == 3
    assert len(glob.glob(f"{tmp_path}/many/*.arrow")) > 15
    for folder in ("few", "many"):
        assert sorted(saved.read_saved(spark, f"{tmp_path}/{folder}").collect()) == sorted(df.collect())


def test_ids_are_handed_on_by_slices(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = K._tokenizer(path, ())
    texts = [None, "", "é 日本\n", *(f"line {i} of some words" * 40 for i in range(1000)), "x " * K.SLICE_BYTES, None, "end"]
    watched, seen = _Watched(tok), 0
    for part, sizes, ids in K._encoded_slices(watched, pa.array(texts[:1000], pa.string())):
        assert watched.most <= K.SLICE_BYTES and len(sizes) == len(part) < 997 and len(ids) == sizes.sum()
        seen += len(part)
    assert seen == 1000
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    found = rows.select("k", K.Tokens(path).encode(F.col("t")).alias("a"), K.Tokens(path).encode(F.col("t"), chained=True).alias("b")).collect()
    expected = [None if t is None else tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [r.a for r in sorted(found)] == [r.b for r in sorted(found)] == expected


def test_single_files_are_read_by_few_tasks(spark, tmp_path):
    from quern.functions import images as I  # noqa: E741
    from quern.sources import readers

    for i in range(300):
        (tmp_path / f"{i}.png").write_bytes(I.encode_png(K.np.full((1, 1, 3), i % 256, K.np.uint8)) if i % 3 else b"no image")
    most = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(most)
    spark.conf.set(most, "1b")  # a task for each file
    try:
        files, images = readers.read_files(spark, str(tmp_path)), readers.read_images(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() == images.rdd.getNumPartitions() == max(4 * spark.sparkContext.defaultParallelism, 300 // 16) < 300
        assert {r.path.rsplit("/", 1)[1] for r in files.collect()} == {f"{i}.png" for i in range(300)}
        assert sorted(r.height for r in images.collect()) == [-1] * 100 + [1] * 200
    finally:
        spark.conf.set(most, was)


def test_texts_are_handed_on_by_slices(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = K._tokenizer(path, ())
    texts = [None, "", "é 日本\n", *(f"line {i} of some words" * 40 for i in range(1000)), None, "end"]
    ids = K._encoded(tok, pa.array(texts, pa.string()))
    both = pa.RecordBatch.from_arrays([ids, ids.cast(pa.list_(pa.int32()))], ["a", "b"])
    watched, parts = _Watched(tok), []
    for found in K._decoded_slices(watched, both, False):
        assert found[0] == found[1] and len(found[0]) < len(texts) // 2
        parts += found[0].to_pylist()
    assert parts == texts and watched.most <= K.SLICE_IDS // 2  # of each column
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    made = rows.select("k", K.Tokens(path).encode(F.col("t")).alias("ids"))
    each = K.Tokens(path).decode_each({"whole": F.col("ids"), "few": F.slice("ids", 1, 1).cast("array<int>")}, False)
    found = made.select("k", each["whole"].alias("a"), each["few"].alias("b"), K.Tokens(path).decode(F.col("ids"), False).alias("c"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") == 3  # one for the ids, one for both texts, one for the last
    found = sorted(found.collect())
    assert [r.a for r in found] == [r.c for r in found] == texts
    assert [r.b for r in found] == [None if i is None else tok.decode(i[:1], skip_special_tokens=False) for i in ids.to_pylist()]


def test_masked_labels_are_made_once_a_row(spark):
    from pyspark.sql import functions as F

    from quern.functions import tokens as T

    labels = F.reverse(F.reverse("ids"))
    for tag in (1, 2, 3):
        labels = T.mask_between(labels, F.col("ids"), [tag], [9])
    df = spark.createDataFrame([([1, 5, 9, 2, 6, 9, 4, 7, 9, 3, 9, 8],)], "ids array<bigint>").select(labels.alias("l"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") == 1  # else once for each span of the next mask
    assert df.first().l == [-100] * 6 + [4, 7, 9] + [-100] * 2 + [8]
