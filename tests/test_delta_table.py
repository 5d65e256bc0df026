import os
import threading

import pytest

from vellum.sources.delta_table import DeltaTable
from vellum.sources.versions import Conflict, Versions

KIND = "document_id string, chunk_index int, text string"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def own(df):
    return sorted((r.document_id or "-", r.chunk_index, r.text) for r in df.collect())


def test_batches_replace_their_keys(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "t"))
    rows = lambda x: spark.createDataFrame(x, KIND)
    with pytest.raises(ValueError):
        table.read()
    assert table.remove(rows([("a", 0, "x")])) == 0
    table.replace(rows([("a", 0, "1"), ("a", 1, "2"), ("b/1", 0, "3"), (None, 0, "n")]))
    second = table.replace(rows([("a", 0, "new"), (None, 0, "m"), (None, 1, "m")]))
    table.remove(rows([("b/1", 0, "")]))
    assert own(table.read()) == [("-", 0, "m"), ("-", 1, "m"), ("a", 0, "new")]
    assert own(table.read(second)) == [("-", 0, "m"), ("-", 1, "m"), ("a", 0, "new"), ("b/1", 0, "3")]
    assert own(table.read(1)) == [("-", 0, "n"), ("a", 0, "1"), ("a", 1, "2"), ("b/1", 0, "3")]


def test_repeated_batch_is_there_once(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("a", 0, "1")], KIND)
    assert table.replace(rows, source="s", batch=0) == table.replace(rows, source="s", batch=0) == 1
    assert table.replace(rows, source="s", batch=1) == 2 and table.replace(rows, source="other", batch=0) == 3


def test_bytes_follow_the_batch(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "t"))
    big = spark.range(60_000).selectExpr("cast(id as string) document_id", "0 chunk_index", "sha2(cast(id as string), 256) text")
    table.replace(big)
    before = size(tmp_path)
    table.replace(big.limit(20))
    assert size(tmp_path) - before < before / 20
    plan = table.read()._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # the large run is not shuffled


def test_a_killed_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = DeltaTable(spark, str(tmp_path / "t"))
    rows = lambda x: spark.createDataFrame(x, KIND)
    table.replace(rows([("a", 0, "1")]))
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.replace(rows([("a", 0, "lost"), ("b", 0, "lost")]))
    assert own(DeltaTable(spark, str(tmp_path / "t")).read()) == [("a", 0, "1")]
    assert len(os.listdir(tmp_path / "t" / "runs")) == 2
    assert table.vacuum() == []  # young: its writer may live
    assert len(table.vacuum(min_age_seconds=0)) == 1 and own(table.read()) == [("a", 0, "1")]


def test_compaction_keeps_rows_and_old_versions(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "t"))
    expected = {}
    for n in range(7):
        batch = {f"d{k}": f"{n}" for k in range(n % 3, 12 if n == 0 else n % 3 + 2)}
        expected |= batch
        table.replace(spark.createDataFrame([(k, 0, v) for k, v in batch.items()], KIND))
        if n == 3:
            table.remove(spark.createDataFrame([("d9", 0, "")], KIND))
            expected.pop("d9")
        table.compact()
    state = table.versions.state()
    assert len(state["runs"]) <= 4
    want = sorted((k, 0, v) for k, v in expected.items())
    assert own(table.read()) == want
    while table.compact():
        pass
    table.vacuum(keep=1, min_age_seconds=0)
    assert own(table.read()) == want and len(os.listdir(tmp_path / "t" / "runs")) == len(table.versions.state()["runs"])


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    failed = []

    def write(name):
        try:
            DeltaTable(spark, path).replace(spark.createDataFrame([(name, 0, name)], KIND))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(f"w{n}",)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and {r[0] for r in own(DeltaTable(spark, path).read())} == {f"w{n}" for n in range(6)}
    assert Versions(spark, path).numbers() == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Conflict):
        Versions(spark, path).commit({"version": 6})
