"""Scoring by a ledger: crashes at every step, replays, malformed lines, folding."""

import json

import pytest

from quern.streaming.progress import ScoreStore

SCHEMA = "id long, text string"


def lines(folder, name, ids, bad=()):
    folder.mkdir(exist_ok=True)
    good = [json.dumps({"id": i, "text": f"Answer: {'ABC'[i % 3]}"}) for i in ids]
    (folder / f"{name}.jsonl").write_text("\n".join([*good, *bad]) + "\n")


def found(store):
    return sorted((r.id, r.answer) for r in store.scored().collect()), sorted(r.line for r in store.bad().collect())


def want(*ids):
    return [(i, "ABC"[i % 3]) for i in sorted(ids)]


@pytest.fixture
def store(spark, tmp_path):
    return ScoreStore(spark, str(tmp_path / "store"), SCHEMA)


def test_each_line_once_whenever_it_dies(spark, tmp_path, store, monkeypatch):
    """Killed before the batch is published, and after it but before the stream's own commit."""
    run = lambda: store.run(str(tmp_path / "in"), str(tmp_path / "ck"), 1).awaitTermination()
    lines(tmp_path / "in", "a", range(5), ["not json", "[1]"])
    publish = store._publish
    for publishes in (False, True):
        def dies(*args, publishes=publishes):
            if publishes:
                publish(*args)
            raise RuntimeError("killed")

        monkeypatch.setattr(store, "_publish", dies)
        with pytest.raises(Exception, match="killed"):
            run()
        assert found(store) == ((want(*range(5)), ["[1]", "not json"]) if publishes else ([], []))
    monkeypatch.setattr(store, "_publish", publish)
    run()
    assert found(store) == (want(*range(5)), ["[1]", "not json"])
    lines(tmp_path / "in", "b", range(5, 9), [""])
    run()
    run()
    assert found(store) == (want(*range(9)), ["", "[1]", "not json"])
    assert store.progress() == {"batches": 2, "scored": 9, "bad": 3}


def test_folded_batches_stay_known(spark, tmp_path, store):
    for k in range(4):
        lines(tmp_path / f"in{k}", "x", [k], ["bad"] * (k == 1))
        assert store.add(spark.read.text(str(tmp_path / f"in{k}")), k)
        if k == 2:
            store.compact()
            assert found(store) == (want(0, 1, 2), ["bad"])
    assert [store.add(spark.read.text(str(tmp_path / "in0")), k) for k in (0, 2, 3)] == [False] * 3
    store.compact()
    store.compact()
    assert found(store) == (want(0, 1, 2, 3), ["bad"]) and store.progress() == {"batches": 4, "scored": 4, "bad": 1}
    assert not store.add(spark.read.text(str(tmp_path / "in0")), 1)


def test_two_writers_and_empty_batches(spark, tmp_path, store, monkeypatch):
    lines(tmp_path / "in", "x", [1])
    assert found(store) == ([], [])
    assert store.add(spark.read.text(str(tmp_path / "in")).limit(0), 0) and found(store) == ([], [])
    assert store.add(spark.read.text(str(tmp_path / "in")), 1)
    monkeypatch.setattr(store, "has", lambda batch: False)
    with pytest.raises(OSError, match="another writer"):
        store.add(spark.read.text(str(tmp_path / "in")), 1)
    assert found(store) == (want(1), [])
