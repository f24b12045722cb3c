"""Results recomputed in full, replays, very long texts, several texts under one id, empty tables, clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import fingerprints, lines, minhash, quality, queries, rollups, sharding, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, doc string, tag string, gone string, key string, Uid string"
LONG = ["ab cd " * 300_000 + "end.", "é" * 900_000, "\n".join(f"line {i % 1000}" for i in range(100_000)), " " * 500_000]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", *"dtgku") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def mixed(spark):
    passage = "the same passage of well over one hundred bytes that stands in several documents of this small table, word for word. "
    rows = [(1, passage + "a"), (1, "b " + passage), (1, None), (2, ""), (None, passage * 2), (3, "x\ny\nz\nw"), (4, "x\ny\nz\nv"), (4, "x\ny\nz\nv"), (5, passage + "a")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def long(spark):
    return table(spark, list(enumerate(LONG)))


def test_shards_recomputed(spark, mixed):
    for n in (1, 3, 16):
        for docs in (mixed, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
            rows = sharding.shard_by_bytes(docs, n).collect()
            sizes = sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in rows)
            assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
            total, before = sum(s for _, s in sizes), 0
            placed = sorted(rows, key=lambda r: (r.shard, r.slot))  # the order that the shards cut
            assert [-1 if r.doc_id is None else r.doc_id for r in placed] == [i for i, _ in sizes]
            for r in placed:
                assert r.shard == min(n - 1, (2 * before + r.size) * n // (2 * total)) and r.law == "bytes" and r.grown_shard is None
                before += r.size
            for s in range(n):
                assert [r.slot for r in placed if r.shard == s] == list(range(sum(r.shard == s for r in placed)))


def brute_repeats(rows, width=100):
    """(id, bytes, removed, spans, rest) in the order of id and text, as the operator orders equal ids."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - width + 1):
            if b[p : p + width] in seen:
                cover[p] += 1
                cover[p + width] -= 1
            seen.add(b[p : p + width])
        hit = np.cumsum(cover[:-1]) > 0
        rest = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        out.append((i, len(b), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def test_repeats_with_their_spans(spark):
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    rows = [(1, base), (2, "x" + base[:120] + "yy" + base[130:250] + "z"), (3, base[20:130]), (4, "q" * 350), (5, None), (6, base[:99]), (7, base[:100] + base[100:200] + base[:100])]
    got = suffixes.digest_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)
    assert max(r.n_spans for r in got) >= 2


def test_several_texts_under_one_id(mixed):
    n = mixed.count()
    assert sharding.shard_by_bytes(mixed).count() == suffixes.digest_repeats(mixed).count() == n
    f = fingerprints.fingerprint_documents(mixed).collect()
    texts = sorted(len(r.text or "") for r in mixed.collect())
    assert sorted(r.n_chars for r in f) == texts and all(0 <= r.near_next <= 1 for r in f)
    near = minhash.near_duplicates(mixed, n=3, percent=85).collect()
    assert len(near) == n and {r.component_id for r in near if r.doc_id == 5} == {1}


def test_removals_keep_columns_of_any_name(mixed):
    kept = lines.remove_lines(mixed, least_bytes=lines.LEAST_BYTES)
    assert kept.columns == mixed.columns and {r.gone for r in kept.collect()} == {"g"}
    rest = suffixes.remove_repeats(mixed)
    assert rest.columns == mixed.columns and {(r.doc, r.tag, r.Uid) for r in rest.collect()} == {("d", "t", "u")}


def test_very_long_texts(spark, long):
    ids = list(range(len(LONG)))
    judged = {r.doc_id: r for r in quality.judge(long, keep=["doc_id"]).collect()}
    assert [judged[i].n_words for i in ids] == [600_001, 1, 200_000, 0] and judged[1].word_chars == 900_000 and judged[2].n_dup_lines == 99_000
    assert judged[0].base_failed and judged[3].base_failed
    assert sorted(r.size for r in sharding.shard_by_bytes(long).collect()) == sorted(len(t.encode()) + 1 for t in LONG)
    near = {r.doc_id: r for r in minhash.near_duplicates(long, n=3, percent=85).collect()}
    assert [near[i].n_shingles for i in ids] == [3, 1, 2000, 0] and all(near[i].component_id == i for i in ids)
    toxic = {r.doc_id: r for r in toxicity.score(long, toxicity.Model(-4.0, {"w:end": 9.0})).collect()}
    assert toxic[0].predicted == 1 and toxic[1].predicted == 0 and toxic[2].n_sentences == 100_000
    marks = fingerprints.fingerprint_documents(long).collect()
    assert sorted(r.n_chars for r in marks) == sorted(map(len, LONG))
    repeats = {r.doc_id: r for r in suffixes.digest_repeats(long).collect()}
    assert repeats[1].n_removed > 1_799_000
    assert repeats[3].n_removed == 500_000 - 1 and repeats[3].n_spans == 1
    counted = rollups.count_tokens(table(spark, [(0, LONG[0]), (1, LONG[1][:200_000])]), "w", keep=["doc_id"]).collect()
    assert {r.doc_id for r in counted} == {0, 1} and all(r.tokens > 10_000 for r in counted)


def test_symbols_and_empty_texts_of_the_base_rule(spark):
    got = {r.doc_id: r for r in quality.judge(table(spark, [(1, "#a *b $%&|<> c" + " w" * 60), (2, None), (3, "")]), keep=["doc_id"]).collect()}
    assert got[1].n_symbols == 8 and got[2].n_symbols == got[3].n_symbols == 0
    assert got[2].base_failed and got[3].base_failed and not got[2].kept


def test_empty_tables(spark, mixed):
    none = mixed.limit(0)
    assert toxicity.score(none, toxicity.Model()).count() == rollups.count_tokens(none, "w").count() == suffixes.digest_repeats(none).count() == 0
    assert lines.remove_lines(none).count() == suffixes.remove_repeats(none).count() == 0


def test_replays_after_compaction(spark, mixed, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "r"))
    counts = rollups.count_tokens(mixed, "w")
    for batch in ("a", "b"):
        assert store.commit(batch, rollups.inserts(counts))
    small = store.compact(str(tmp_path / "s"))
    first = sorted(map(tuple, small.totals().collect()), key=repr)
    assert first == sorted(map(tuple, store.totals().collect()), key=repr)
    for s in (small, small.compact(str(tmp_path / "t"))):
        assert [s.commit(b, rollups.inserts(counts)) for b in ("a", "b")] == [False, False]
        with pytest.raises(ValueError, match="other content"):
            s.commit("a", rollups.deletes(counts))
        assert sorted(map(tuple, s.totals().collect()), key=repr) == first
    with pytest.raises(ValueError, match="holds a store"):
        store.compact(str(tmp_path / "s"))
    assert rollups.Rollup(spark, str(tmp_path / "u")).compact(str(tmp_path / "v")).totals().count() == 0


def test_a_store_keeps_what_two_entries_name(spark, mixed, tmp_path):
    store, root = rollups.Rollup(spark, str(tmp_path / "r")), tmp_path / "r"
    counts = rollups.count_tokens(mixed, "w")
    for i in range(5):
        store.commit(f"b{i}", rollups.inserts(counts))
    assert len(list(root.glob("totals-*"))) == len(list(root.glob("batches-*"))) == len([p for p in (root / "log").iterdir() if p.suffix == ".json" and p.name[0] != "."]) == 2
    (root / "log" / "000000005.json").write_text('{"nth": 5, "ta')  # its writer died in it
    want = sorted(map(tuple, store.totals().collect()), key=repr)
    assert store.commit("b0", rollups.inserts(counts)) is False and sorted(map(tuple, store.totals().collect()), key=repr) == want
    assert store.commit("b5", rollups.deletes(counts)) and store.commit("b5", rollups.deletes(counts)) is False


def test_toxicity_beats_a_constant_answer_on_few_rows(spark, sf_dir):
    d, lab = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity.score(d, toxicity.train(d, lab)).join(lab, "doc_id").where("held_out").select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in got)
    assert right > max(sum(r.toxic == c for r in got) for c in (0, 1))


def test_fit_on_a_tiny_sample(monkeypatch):
    """The fitted parameters stand at a minimum of the weighted noisy-or likelihood, recomputed bag by bag."""
    monkeypatch.setattr(toxicity, "STEPS", 4000)
    rows = [(1, 2, [(1, [0]), (2, [1])]), (1, 0, [(1, [0, 1])]), (0, 3, [(1, [1])]), (0, 5, []), (0, 1, [(3, [1])])]
    model = toxicity.fit(rows, ["x", "y"])

    def loss(bias, x, y):
        total, w = 0.0, [(2 if label else 3) ** -0.5 for label, *_ in rows]
        for share, (label, quiet, cells) in zip(w, rows, strict=True):
            clean = (1 - 1 / (1 + np.exp(-bias))) ** quiet
            for times, c in cells:
                clean *= (1 - 1 / (1 + np.exp(-(bias + sum((x, y)[k] for k in c))))) ** times
            total -= share / sum(w) * np.log(1 - clean if label else clean)
        return total + toxicity.DECAY / 2 * (x * x + y * y)

    at = (model.bias, model.weights["x"], model.weights["y"])
    best = loss(*at)
    for k in range(3):
        for step in (-0.5, 0.5):
            assert loss(*(v + step * (i == k) for i, v in enumerate(at))) > best - 1e-6
    assert toxicity.fit([(1, 1, [])], []).weights == toxicity.fit([(0, 1, [])], []).weights == {}


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
