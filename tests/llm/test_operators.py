"""The corpus operators against brute force, libraries and SQL on a small fixture with nulls, ties and copies."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe, components, fingerprints, lines, minhash, packing, quality, queries, rollups, sharding, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, HOST string, stats string"


def texts():
    rng = random.Random(3)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = [*base, base[0], base[0], base[3] + " tail", "", None, "   \n\n ", "one", "a\nb\nc\nd\na\nb\nc\nd", f"{base[5][:80]}\n{passage}", f"{passage} {base[6]}"]
    out += [b.replace("word1", "word2", 1) for b in base[:8]] + ["x" * 500, "ab " * 300, "l1\nl2\nl3\nl4 end", "z\nl1\nl2\nl3\n\nq"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 11 else None, t, "en", None if i % 9 == 0 else "hot" if i % 3 else "s", 0, "h", "s") for i, t in enumerate(texts())]
    rows.append(rows[4])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_sql_of_registered_queries(spark, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf_dir)
        cols = sorted(got.columns)
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()), name


def test_quality(docs, empty):
    def stats(t):
        w = t.encode().split()
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)}
        full = [x for x in t.split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), len(full) - len(set(full)), len(hit)

    got = quality.judge(docs, keep=["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == stats(r.text or ""), r
    again = quality.judge(docs, keep=["doc_id"], broadcast_hosts=-1, max_rate=0.2).groupBy("kept").count().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, quality.judge(docs, keep=["doc_id"], max_rate=0.2).groupBy("kept").count().collect()))
    assert quality.judge(empty).count() == 0


def test_accepted_keeps_columns_of_any_name(spark, docs):
    named = docs.withColumns({"HOST": F.lit("mine"), "n_words": F.lit(777), "Kept": F.lit("k"), "row": F.lit(1)})
    got = quality.accepted(named)
    assert got.columns == named.columns
    assert {(r.HOST, r.n_words, r.Kept, r.row) for r in got.collect()} == {("mine", 777, "k", 1)}
    want = quality.judge(docs, keep=["doc_id"]).where("kept").count()
    assert got.count() == want > 0
    with pytest.raises(ValueError, match="Kept, n_words"):
        quality.judge(named)


def test_host_rates_shrink_less_where_hosts_differ(spark):
    """Variance between hosts beyond what sampling explains sets the prior's strength."""
    rows = [(h, h == "bad" or (i < 2 and h == "mid")) for h in ("bad", "mid", "good", "fine") for i in range(20)]
    r = {x.host: x for x in quality.host_rates(spark.createDataFrame(rows, "host string, f boolean"), {"f": "f"}).collect()}
    m = 22 / 80
    v = sum(20 * (f / 20 - m) ** 2 for f in (20, 2, 0, 0)) / 80 - 4 * m * (1 - m) / 80
    k = max(1.0, m * (1 - m) / v - 1)
    assert abs(r["bad"].rate_f - (20 + k * m) / (20 + k)) < 1e-12
    assert r["bad"].host_rejected and not r["mid"].host_rejected
    same = spark.createDataFrame([(h, i % 2 == 0) for h in "ab" for i in range(10)], "host string, f boolean")
    assert {x.rate_f for x in quality.host_rates(same, {"f": "f"}).collect()} == {0.5}


def test_sharding(docs, empty):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    sizes = [0] * 4
    for r in rows:
        sizes[r.shard] += r.size
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in pairs(docs))
    assert max(sizes) - min(sizes) < 2 * max(r.size for r in rows)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_by_bytes(empty).count() == 0


def test_packing(docs, empty):
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t in pairs(docs):
        want.setdefault((i, tuple([*hf.encode(t, add_special_tokens=False).ids, 1])), 0)
    rows = packing.pack(docs, capacity=64, group_documents=30).collect()
    assert all(r.length <= 64 for r in rows)
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    crc = {(i, s, zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for i, ids in want for s in range(0, len(ids), 64)}
    assert {(r.doc_id, r.start, r.ids_crc32) for r in rows} == crc
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("name", ["word", "byte"])
def test_encoders_match_the_library(name):
    odd = ["", "  a  b\n\n c\t d", " lead", "trail ", "x<|endoftext|>y", "<|startoftext|> A  ΟΔΟΣ Σ ", "É é ́x ñ 12345 don't I'LL", "日本語 😀😀", "\xa0a\xa0 b c \x1c d\x85e", "a\r\nb \r\n c", "İstanbul ǅ ﬁ"]
    hf = Tokenizer.from_file(P.path(f"{name}_bpe_{'49k' if name == 'word' else '50k'}.json"))
    codec = bpe.Codec(P.path("word_bpe_49k.json")) if name == "word" else packing.Encoder(P.path("byte_bpe_50k.tiktoken"))
    for t in [*odd, *(x or "" for x in texts())]:
        e = hf.encode(t, add_special_tokens=False).ids
        got = codec(t) if name == "byte" else codec.encode(t)[0]
        assert np.frombuffer(got, "<u4").tolist() == e, t
        if name == "word":
            assert codec.encode(t)[1] == hf.decode(e, skip_special_tokens=False)


def test_encoders_take_very_long_texts():
    enc, codec = packing.Encoder(P.path("byte_bpe_50k.tiktoken")), bpe.Codec(P.path("word_bpe_49k.json"))
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    gap = " " * 3000 + "\n" * 1500
    for t in (f"a{gap}b c", f"{gap}<|endoftext|>{gap}", f"x {gap}  y{gap}", f"{gap} ", "\u2003" * 1200 + "é"):
        want = hf.encode(t, add_special_tokens=False).ids
        assert enc.ids(t).tolist() == enc._with_long_spaces(t).tolist() == want
    for t in (" " * 1_000_000, "x" * 1_000_000, "ab é " * 200_000):
        assert enc.count(t) > 0
        assert codec.encode(t)[0] == b"" or t.strip()


def test_bpe_query(docs, empty):
    hf = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((i is None, i, hashlib.sha256(np.array(hf.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i, t in pairs(docs) if i is not None)
    assert sorted((False, r.doc_id, r.ids_sha256) for r in bpe.encode_documents(docs, outputs=True).collect() if r.doc_id is not None) == want
    assert bpe.encode_documents(empty).count() == 0


@pytest.mark.parametrize("group", [20_000, 2])
def test_suffixes(docs, empty, group):
    rows = [(i, t) for i, t in pairs(docs)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), []
    for i, t in order:
        b = t.encode()
        cov = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cov[s : s + 100] = b"\1" * 100
            seen.add(w)
        want.append((str(i), len(b), sum(cov), hashlib.sha256(bytes(x for x, c in zip(b, cov, strict=True) if not c)).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.digest_repeats(docs, group=group, broadcast_grams=10**6 if group > 2 else -1).collect()]
    assert sorted(got) == sorted(want)
    assert suffixes.digest_repeats(empty).count() == 0
    assert suffixes.remove_repeats(docs).columns == docs.columns


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_minhash(docs, empty, n, percent):
    rows = pairs(docs)

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    for r in minhash.near_duplicates(docs, n=n, percent=percent).collect():
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(empty).count() == 0


def test_two_texts_under_one_id(spark):
    """Links follow texts, not ids: id 5 stands at a near copy of 3 and at a text of its own."""
    a = " ".join(f"w{i}" for i in range(100))
    near, own = a.replace("w50", "x50"), " ".join(f"v{i}" for i in range(100))
    rows = [(3, a), (5, near), (5, own), (7, own), (7, own), (9, None), (None, a), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(df, n=3, percent=85).collect())
    want = [("3", 98, "3", True), ("5", 98, "3", False), ("5", 98, "5", True), ("7", 98, "5", False), ("7", 98, "5", False), ("9", 0, "9", True), ("None", 98, "None", True), ("11", 0, "11", True)]
    assert got == sorted(want)
    left = sorted((str(r.doc_id), r.text) for r in minhash.one_of_each(df, n=3, percent=85).collect() if r.text)
    assert left == sorted([("3", a), ("5", own), ("None", a)])
    repeated = df.where("doc_id = 3").unionByName(df).withColumn("tag", F.lit("mine"))
    kept = minhash.one_of_each(repeated, n=3, percent=85)
    assert kept.columns == repeated.columns
    assert kept.where("doc_id = 3").count() == 1


def test_links_at_the_edge_of_sizes(spark):
    """A small set inside a large one, just linked and just not: sizes 85 and 100, 84 and 100."""
    w = [f"w{i}" for i in range(102)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:87])), (3, " ".join(w[:86]))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df.where("doc_id < 3"), n=3, percent=85).collect()}
    assert got == {1: 1, 2: 1}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df.where("doc_id <> 2"), n=3, percent=85).collect()}
    assert got == {1: 1, 3: 3}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def test_fingerprints(docs, empty):
    rows = sorted((t for t in pairs(docs) if t[0] is not None), key=lambda r: (-r[0], r[1]))
    rows += [p for p in pairs(docs) if p[0] is None]
    want = []
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    got = fingerprints.fingerprint_documents(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[0] == by[40] == by[41]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprints_are_near_the_exact_likeness(docs):
    """near_* against exact generalised Jaccard values: the mean square error is that of 64 samples or more, not of 20."""
    rows = sorted((t for t in set(pairs(docs)) if t[0] is not None), key=lambda r: (-r[0], r[1]))

    def exact(a, b):
        x, y = Counter(re.findall(r"[^ \t-\r]+", a)), Counter(re.findall(r"[^ \t-\r]+", b))
        return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0

    got, square, due, n = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}, 0, 0, 0
    for k, (i, t) in enumerate(rows[:-1]):
        nxt, half = rows[k + 1][1], len(t) // 2
        if i == 4 or rows[k + 1][0] == 4:  # the repeated row
            continue
        for near, want in ((got[i].near_edited, exact(t, t[: len(t) - half] + nxt[:half])), (got[i].near_next, exact(t, nxt))):
            assert abs(near - want) <= 5 * (want * (1 - want) / 64) ** 0.5 + 1e-9, (i, near, want)
            square, due, n = square + (near - want) ** 2, due + want * (1 - want) / 64, n + 1
    assert n > 80 and square < 2 * due
    assert all(len(r.fingerprint) >= 64 * 8 for r in got.values())


def test_sampling_collides_like_generalised_jaccard(spark):
    a, b = {k: 1 + k % 5 for k in range(40)}, {k: 1 + (k * 3) % 5 for k in range(20, 60)}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(60)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(60))
    rows = [(s, k, float(w)) for s, d in (("a", a), ("b", b)) for k, w in d.items()]
    df = spark.createDataFrame(rows, "s string, k long, w double").crossJoin(spark.range(4000).withColumnRenamed("id", "i"))
    m = df.groupBy("i").agg(*(F.min(F.when(F.col("s") == s, fingerprints.sample_value(F.col("k"), F.col("w"), F.col("i")))).alias(s) for s in "ab"))
    assert abs(m.agg(F.avg((F.col("a") == F.col("b")).cast("int"))).first()[0] - want) < 0.03


def test_a_text_of_very_many_lines(spark):
    t = "\n".join(f"line {i % 3000}" for i in range(64_000))
    got = lines.digest_lines(spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_lines, r.n_removed_lines, r.n_runs) for r in sorted(got)] == [(1, 64_000, 61_000, 1), (2, 64_000, 64_000, 1)]


def test_lines(docs, empty):
    assert lines.digest_lines(empty).count() == 0
    kept = {r.doc_id: r.text for r in lines.remove_lines(docs).collect()}
    at = {t: i for i, t in enumerate(texts()) if t}
    assert kept[at["a\nb\nc\nd\na\nb\nc\nd"]] == "a\nb\nc\nd"
    assert kept[at["z\nl1\nl2\nl3\n\nq"]] == "z\n\nq"


@pytest.mark.parametrize(("run", "least"), [(3, 100), (3, 20), (5, 5), (1, 100), (3, None)])
def test_lines_by_content(spark, docs, run, least):
    """Runs of fewer than ``run`` lines go by their bytes; a passage on one line and a text of two lines among them."""
    odd = ["é" * 49 + "x", "é" * 50, "aa\nbb\ncc\ndd\nee", "p\naa\nbb\nq", "p\n\naa\nq", "x" * 60 + "\n" + "y" * 60, "y" * 60 + "\n" + "x" * 60, "bb\ncc\ndd\nee\nff"]
    rows = [*pairs(docs), *((1000 + i, t) for i, t in enumerate([*odd, *(f"{t}\nz" for t in odd), "x" * 60 + "\n \n" + "y" * 60])), (3, "aa\nbb\ncc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tags = {(r.doc_id, r.text): r.tag for r in df.select("doc_id", "text", F.xxhash64("text").alias("tag")).collect()}
    seen, want = [set() for _ in range(run + 1)], {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, tags[r])):
        lines_of = [x for x in t.split("\n") if x.encode().split()]
        gone = set()
        for k in range(len(lines_of)):
            for h in range(1, min(run, len(lines_of) - k) + 1):
                w = tuple(lines_of[k : k + h])
                if w in seen[h] and (h == run or (least is not None and sum(len(x.encode()) for x in w) >= least)):
                    gone.update(range(k, k + h))
                seen[h].add(w)
        k, out = -1, []
        for x in t.split("\n"):
            k += bool(x.encode().split())
            if not x.encode().split() or k not in gone:
                out.append(x)
        want[i, t] = "\n".join(out), len(gone)
    got = sorted((str(r.doc_id), r.n_removed_lines, r.kept_sha256) for r in lines.digest_lines(df, run=run, least_bytes=least).collect())
    assert got == sorted((str(i), want[i, t][1], hashlib.sha256(want[i, t][0].encode()).hexdigest()) for i, t in rows)
    left = sorted((str(i), want[i, t][0]) for i, t in rows if not want[i, t][1] or want[i, t][0].encode().split())
    assert sorted((str(r.doc_id), r.text) for r in lines.remove_lines(df, run=run, least_bytes=least).collect()) == left


def _count(name):
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(P.path(f"{name}.tiktoken"), "rb"))}
    enc = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=packing.SPECIAL)
    return lambda t: len(enc.encode(t or "", allowed_special="all"))


def test_rollups(spark, docs, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    counts = rollups.count_tokens(docs, "w")
    one, want = _count("byte_bpe_50k"), Counter()
    for r in docs.collect():
        want[r.source, r.lang, "docs"] += 1
        want[r.source, r.lang, "tokens"] += one(r.text)
    assert [store.commit("a/../b", rollups.inserts(counts)) for _ in range(2)] == [True, False]
    first = sorted(map(str, store.totals().collect()))
    assert {(r.source, r.lang, k): r[k] for r in store.totals().collect() for k in ("docs", "tokens")} == want
    with pytest.raises(ValueError, match="other content"):
        store.commit("a/../b", rollups.deletes(counts))
    store.commit("c", rollups.deletes(counts))
    assert store.totals().count() == 0
    store.commit("empty", rollups.inserts(counts.limit(0)))
    store.commit("d", rollups.inserts(counts))
    assert sorted(map(str, store.compact(str(tmp_path / "s")).totals().collect())) == first


def test_a_commit_that_dies_leaves_the_old_totals(spark, docs, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "r"))
    counts = rollups.count_tokens(docs, "w")
    store.commit("a", rollups.inserts(counts))
    first = sorted(map(str, store.totals().collect()))
    boom = counts.withColumn("tokens", F.when(F.col("source") == "hot", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("tokens")))
    with pytest.raises(Exception, match="lost"):
        store.commit("b", rollups.inserts(boom))
    spark.range(3).write.parquet(str(tmp_path / "r" / "totals-left-behind"))  # totals that no log entry names
    assert sorted(map(str, store.totals().collect())) == first
    assert store.commit("b", rollups.inserts(counts)) is True


def test_token_counts_query(spark):
    sf = "/root/testdata/sf0.001"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic, one, many, want = {r.doc_id for r in lab if r.toxic == 1}, _count("byte_bpe_50k"), _count("byte_bpe_multi_50k"), Counter()
    for r in d:
        if r.doc_id not in toxic:
            name, count = ("byte_bpe_multi_50k@1", many) if r.lang == "de" else ("byte_bpe_50k@1", one)
            want[r.source, r.lang, name, "docs"] += 1
            want[r.source, r.lang, name, "tokens"] += count(r.text)
    got = queries.op5_token_counts(spark, sf).collect()
    assert {(r.source, r.lang, r.tokenizer, k): r[k] for r in got for k in ("docs", "tokens")} == want


def test_scores_against_the_formula(docs):
    """Noisy-or over sentences by its definition, the located sentence, ties at the threshold, nulls and empty texts."""
    model = toxicity.Model(-2.0, {"w:word1": 3.0, "4:word": 0.1, "6:word22": -0.5, "w:tail": 1.0})
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id, t): r for r, (i, t) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(pairs(docs), key=lambda p: str(p[0])), strict=True)}
    for (i, t), r in by.items():
        spots = [(m.start(), m.end()) for m in re.finditer(r"(?s).+?(?:[.!?]+(?=\s)|\n|$)", t) if m.group().strip()] or [(0, len(t))]
        left, best = 1.0, []
        for a, b in spots:
            words = [re.sub(r"^\W+|\W+$", "", w).lower() for w in t[a:b].split()]
            z = -2.0 + sum(3.0 * (w == "word1") + 0.1 * (w[:4] == "word") - 0.5 * (w[:6] == "word22") + 1.0 * (w == "tail") for w in words)
            p = 1 / (1 + np.exp(-z))
            left *= 1 - p
            best.append(p)
        assert abs(r.score - (1 - left)) < 1e-9, (i, t)
        assert r.predicted == int(r.score >= 0.5)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        if t.strip():
            assert abs(r.worst_score - max(best)) < 1e-9
    half = toxicity.Model(0.0, {})
    assert {(r.score, r.predicted) for r in toxicity.score(docs.where("text = 'one' or text = ''"), half).collect()} == {(0.5, 1)}


def test_training_finds_the_sentence(spark):
    rng = random.Random(5)
    words = [f"plain{c}" for c in "abcdefghijklmnop"]
    say = lambda: " ".join(rng.choice(words) for _ in range(6))
    rows, lab = [], []
    for i in range(400):
        s = [say() for _ in range(4)]
        if i % 3 == 0:
            s[i % 4] += " vile"
        rows.append((i, ". ".join(s) + "."))
        lab.append((i, int(i % 3 == 0)))
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    for r in toxicity.score(d, model).collect():
        assert r.predicted == int(r.doc_id % 3 == 0)
        if r.predicted:
            assert "vile" in rows[r.doc_id][1][r.worst_start : r.worst_end]
    twice = toxicity.train(d.unionByName(d.where("doc_id < 50").withColumn("text", F.lit("other"))), labels)
    assert twice == toxicity.train(d.where("doc_id < 50").withColumn("text", F.lit("other")).unionByName(d), labels)


def test_toxicity(spark, sf_dir, docs, empty):
    d, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(d, toxicity.train(d, lab)).join(lab, "doc_id").where("held_out").select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in got)
    assert right >= 0.97 * len(got)
    assert toxicity.score(docs, toxicity.Model()).count() == docs.count()
    assert toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}
