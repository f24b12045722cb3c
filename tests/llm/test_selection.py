"""Resampling, clustering and decontamination against brute force on small fixtures with nulls, ties, copies and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import clusters, decontamination, resampling
from quern.llm.words import word_blocks

DOCS = "doc_id long, text string, Tie string, key string, uid string, n_words string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 5 == 0 else f"Word{i}" for i in range(60)]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(50)]
    return [*made, made[0], made[1] + "!", None, "", " \n\t", "Éa-b_c d'e", "日本語 text、と ASCII", "x" * 3000, "ab " * 500, "\x00nul\x7fdel", *([made[2]] * 3)]


def items():
    t = texts()
    take = lambda s, a, b: ", ".join(words(s)[a:b]).replace("w", "W")
    long_one = max(t[:50], key=lambda x: len(words(x)))
    return [("a", take(long_one, 3, 40)), ("b", take(long_one, 20, 33) + ", unseen words"), ("c", "word7"), ("d", "Word1 w5é"), ("e", None), ("f", "--"), (None, take(t[4], 0, 12)), ("b", "日本語 text"), ("g", "nothing like this anywhere in the documents at all today my friend"), ("h", "AB ab ab ab ab ab ab ab ab ab ab"), ("a10", take(long_one, 3, 40)), ("i", "ab"), ("i", "ab")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 9 else None, t, "t", "k", "u", "n") for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (7, "another text under an id that is there", "t", "k", "u", "n")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(items(), "item_id string, text string").repartition(2)


def test_word_blocks_cut_anywhere():
    for text in (t or "" for t in texts()):
        for size in (1, 7, 1 << 20):
            assert [w.decode() for b in word_blocks(text.encode(), size) for w in b] == words(text)


def features(text):
    ws = words(text)
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


def brute_importance(rows, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (t_all := s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))  # noqa: E731, F841
    out = []
    for i, x in rows:
        fs = features(x)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = [(*r[:4], n + 1 if n < percent * len(able) // 100 else None) for n, r in enumerate(able)]
    return sorted(rank + [(*r[:4], None) for r in out if r[4] < least], key=repr)


def test_importance(docs, bench):
    rows, target = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()]
    for percent, least in ((25, 20), (100, 0), (0, 20)):
        got = resampling.importance(docs, bench, percent=percent, least_words=least).drop("tie").collect()
        assert sorted(map(tuple, got), key=repr) == brute_importance(rows, target, percent, least)


def test_long_runs_and_streams():
    """Runs of three words, over block ends, in streams of any size."""
    text = " ".join(f"w{i % 97}" for i in range(20_000)).encode()
    ws = text.split()
    want = Counter(zlib.crc32(b" ".join(ws[i : i + n])) % 999 for n in (1, 2, 3) for i in range(len(ws) - n + 1))
    resampling_blocks = resampling.word_blocks
    try:
        resampling.word_blocks = lambda data: resampling_blocks(data, 50)
        n, found = resampling.feature_buckets(text, 999, 3)
    finally:
        resampling.word_blocks = resampling_blocks
    assert n == 20_000 and Counter(found.tolist()) == want
    assert resampling.feature_buckets(b"one", 999, 1)[1].tolist() == [zlib.crc32(b"one") % 999]


def test_small_streams_count_alike(docs, monkeypatch):
    monkeypatch.setattr(resampling, "STREAM", 40)
    streams = resampling.bucket_streams(docs)
    assert streams.count() > 20
    want = Counter(zlib.crc32(f.encode()) % 10_000 for r in docs.collect() for f in features(r.text))
    assert {r.bucket: r.n for r in resampling.bucket_counts(streams).collect()} == want


def test_resample_keeps_rows_and_columns(docs, bench):
    got = resampling.resample(docs, bench, percent=40)
    drawn = {(r.doc_id, r.tie) for r in resampling.importance(docs, bench, percent=40).where("rank is not null").collect()}
    want = [tuple(r)[:-1] for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect() if (r.doc_id, r.h) in drawn]
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_resampling_of_empty_tables(docs, bench):
    assert resampling.importance(docs.limit(0), bench).count() == 0
    assert resampling.importance(docs, bench.limit(0)).count() == docs.count()
    assert resampling.resample(docs.limit(0), bench.limit(0)).count() == 0


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 63), min((1 << 63) - 1, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cs)]
    found = [(i, *near(v)) for i, v in kept]
    per = Counter()
    for _, d, j in found:
        per[j] += d
    most = (1 << 63) - 1
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, j, min(d, most), min(per[j], most), min(per.total(), most), sha[j]) for i, d, j in found), key=repr)


@pytest.mark.parametrize("large", [False, True])
def test_clusters(spark, large):
    rng = np.random.default_rng(1)
    rows = [(int(i) if i % 13 else None, rng.normal(size=4).round(2).tolist()) for i in range(120)]
    rows += [(500, [0.5, -0.5, 0.25, 0.0])] * 40  # one vector many times
    rows += [(501, None), (502, [1.0, 2.0]), (503, [1.0, None, 2.0, 3.0]), (504, [1.0, float("nan"), 0.0, 0.0]), (505, [float("inf"), 0.0, 0.0, 0.0]), (506, []), ((1 << 60) + 1, [1.0, 1.0, 1.0, 1.0])]
    if large:
        rows += [(600, [1e7, -1e7, 1.0, 0.0]), (601, [1e30, -1e30, 0.0, 0.0]), (602, [3e15, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for k, rounds in ((5, 3), (1, 1), (3, 0)):
        got = clusters.cluster(df, k=k, rounds=rounds, dimensions=4).collect()
        assert sorted(map(tuple, got), key=repr) == brute_clusters(rows, k, rounds, 4)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.cluster for r in clusters.cluster(df, k=16, dimensions=2).collect()} == {0}
    assert clusters.cluster(df.limit(0), dimensions=2).collect() == []
    assert clusters.cluster(df, dimensions=3).collect() == []


def brute_matches(rows, bench, window):
    out = []
    for i, t in rows:
        ws, hit, ids = words(t), set(), set()
        for name, text in bench:
            iw = words(text)
            n = min(window, len(iw))
            for a in range(len(iw) - n + 1) if iw else ():
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == iw[a : a + n]:
                        hit |= set(range(p, p + n))
                        ids.add(name or "")
        out.append((i, len(ws), len(hit), sorted(ids)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [250_000, 20])
def test_matches(docs, bench, block_words, monkeypatch):
    monkeypatch.setattr(decontamination, "LEAST_BITS", 10)
    for window in (10, 3):
        found = decontamination.find_matches(docs, bench, window=window, block_words=block_words).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found), key=repr)
        assert got == brute_matches([(r.doc_id, r.text) for r in docs.collect()], items(), window)
        assert all(r.n_hit == len({p for s in r.spans for p in range(s.start, s.stop)}) for r in found)


def test_small_shards_and_blocks_of_text(docs, bench, monkeypatch):
    blocks = decontamination.word_blocks
    known, found = decontamination._prepared(docs, bench, "doc_id", "text", "item_id", "text", 10)
    pairs = decontamination._unpacked(decontamination._bitmap(known.df.select(F.explode("pairs").alias("h")), 16))
    starts = decontamination._unpacked(decontamination._bitmap(known.df.select(F.explode("starts").alias("h")), 16))
    for t in texts():
        whole = decontamination.regions_of((t or "").encode(), pairs, starts)
        monkeypatch.setattr(decontamination, "word_blocks", lambda data: blocks(data, 9))
        assert decontamination.regions_of((t or "").encode(), pairs, starts) == whole
        monkeypatch.setattr(decontamination, "word_blocks", blocks)
    block = next(decontamination._blocks(known.df, 10, 250_000))
    one = decontamination._searched(found.df.coalesce(1), block, decontamination._hits, decontamination._HITS)
    want = sorted((r.uid, sorted(r["items"])) for r in one.collect())
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 5)
    small = decontamination._searched(found.df.coalesce(1), block, decontamination._hits, decontamination._HITS)
    assert want and sorted((r.uid, sorted(r["items"])) for r in small.collect()) == want


def test_suffix_order():
    rng = np.random.default_rng(2)
    for n, letters in ((0, 2), (1, 2), (60, 2), (60, 5)):
        t = rng.integers(0, letters, n)
        want = sorted(range(n), key=lambda i: t[i:].tolist())
        assert decontamination.suffix_order(t, n + 1).tolist() == want


def test_longest_matches(spark, docs, bench):
    got = {(r.item_id, r.at): r for r in decontamination.longest_matches(docs, bench).collect()}
    rows, want = [(r.doc_id, words(r.text)) for r in docs.collect()], {}
    for name, text in dict.fromkeys(items()):
        iw = words(text)
        n = min(10, len(iw))
        for a in range(len(iw) - n + 1) if iw else ():
            length = 0
            for _, ws in rows:
                for p in range(len(ws)):
                    k = 0
                    while p + k < len(ws) and a + k < len(iw) and ws[p + k] == iw[a + k]:
                        k += 1
                    length = max(length, k)
            if length >= n:
                want[name or "", a] = max(length, want.get((name or "", a), 0))
    assert {k: r.length for k, r in got.items()} == want and len(want) > 20
    text_of = {}
    for i, ws in rows:
        text_of.setdefault(i, []).append(ws)
    for (name, at), r in got.items():
        runs = [words(t)[at : at + r.length] for n, t in items() if (n or "") == name]
        assert any(ws[r.start : r.start + r.length] in runs for ws in text_of[r.doc_id])


def test_decontaminate_and_empty_tables(docs, bench):
    hit = {(r.doc_id, r.tie) for r in decontamination.find_matches(docs, bench).where("n_hit > 0").collect()}
    rest = decontamination.decontaminate(docs, bench)
    want = [tuple(r)[:-1] for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect() if (r.doc_id, r.h) not in hit]
    assert rest.columns == docs.columns and sorted(map(tuple, rest.collect()), key=repr) == sorted(want, key=repr)
    assert 0 < len(want) < docs.count()
    assert decontamination.find_matches(docs.limit(0), bench).count() == 0
    none = decontamination.find_matches(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.n_hit or r["items"] for r in none)
    assert decontamination.longest_matches(docs, bench.limit(0)).count() == 0


def test_very_long_texts(spark, bench):
    """Two million words, a word of two million letters, and no word at all among very long white space."""
    rows = [(1, "ab cd " * 1_000_000), (2, "é" * 2_000_000), (3, " " * 3_000_000)]
    long = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in decontamination.find_matches(long, spark.createDataFrame([("x", "cd ab cd"), ("y", "zz ab")], "item_id string, text string")).collect()}
    assert [got[i].n_words for i in (1, 2, 3)] == [2_000_000, 1, 0]
    assert got[1].n_hit == 1_999_999 and got[1]["items"] == ["x"] and got[2].n_hit == got[3].n_hit == 0
    found = {r.doc_id: r.n_features for r in resampling.importance(long, bench).collect()}
    assert found == {1: 3_999_999, 2: 1, 3: 0}
