"""The pipeline's stages, each on what the stage before it kept."""

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf_dir).cache()
        if name != "packing":
            assert out.columns == docs.columns
            assert out.count() <= kept.count()
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            kept = out
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_repeated_passage_on_one_line_goes(spark, sf_dir):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, f"c\n{passage}"), (3, passage), (4, "a\nshort")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf_dir).collect()}
    assert got == {1: f"a\n{passage}\nb", 2: "c", 4: "a\nshort"}


def _quality(rows):
    def stats(t):
        w = t.encode().split()
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
        full = [x for x in t.split("\n") if x.encode().split()]
        n, rep, chars, marks = len(w), len(hit), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t)
        return {"short": n < 50, "repeats": 100 * rep > 50 * n, "symbols": 10 * marks > chars, "dup_lines": 10 * (len(full) - len(set(full))) > 3 * len(full)}

    found, hosts = [stats(t) for _, t, _ in rows], Counter(h for *_, h in rows if h is not None)
    total, bad = sum(hosts.values()), set()
    for rule in ("short", "repeats", "symbols", "dup_lines"):
        fails = Counter(h for (*_, h), s in zip(rows, found, strict=True) if s[rule] and h is not None)
        m = sum(fails.values()) / total
        v = max(0.0, (sum(n * (fails[h] / n - m) ** 2 for h, n in hosts.items()) - len(hosts) * m * (1 - m)) / total)
        k = min(10_000.0, max(1.0, m * (1 - m) / v - 1 if v else 10_000.0))
        bad |= {h for h, n in hosts.items() if (fails[h] + k * m) / (n + k) > 0.5}
    return [r for r, s in zip(rows, found, strict=True) if not s["short"] and not s["repeats"] and r[2] not in bad]


def _lines(rows):
    seen, out = [set() for _ in range(4)], []
    for i, t, h in rows:
        worded = [x for x in t.split("\n") if x.encode().split()]
        gone = set()
        for k in range(len(worded)):
            for n in range(1, min(3, len(worded) - k) + 1):
                w = tuple(worded[k : k + n])
                if w in seen[n] and (n == 3 or sum(len(x.encode()) for x in w) >= 100):
                    gone |= set(range(k, k + n))
                seen[n].add(w)
        at, left = -1, []
        for x in t.split("\n"):
            at += bool(x.encode().split())
            if not x.encode().split() or at not in gone:
                left.append(x)
        if not gone or "\n".join(left).encode().split():
            out.append((i, "\n".join(left), h))
    return out


def _near(rows):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, up = {i: shingles(t) for i, t, _ in rows}, {i: i for i, *_ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return [r for r in rows if root(r[0]) == r[0]]


def _bytes(rows):
    seen, out = set(), []
    for i, t, h in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(x for x, c in zip(b, gone, strict=True) if not c).decode(errors="ignore")
        if left or not any(gone):
            out.append((i, left, h))
    return out


def test_run_against_brute_force(spark):
    """The five stages over a whole small table, each on what the one before kept: pieces of the texts that are left."""
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    left = _bytes(_near(_lines(_quality(rows))))
    assert 0 < len(left) < len(rows)
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t, _ in left:
        ids = [*hf.encode(t, add_special_tokens=False).ids, 1]
        want |= {(i, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)}
    got = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, sf).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
