import threading

import pytest

from vellum.sources.leases import LeasedTable, Lost


def keys(df):
    return {r[0] for r in df.collect()}


def docs(spark, n):
    return spark.createDataFrame([(f"d{k:03d}", k) for k in range(n)] + [(None, 0)], "document_id string, age int")


def results(table, fence, worker):
    return table.claimed(fence).selectExpr("document_id", f"'{worker}' as worker")


def test_a_dead_worker_and_its_late_results(spark, tmp_path):
    table, todo = LeasedTable(spark, str(tmp_path / "t")), docs(spark, 10)
    a = table.claim(todo, "a", most=4, now=0, seconds=10, order="age")
    b = table.claim(todo, "b", most=4, now=1, seconds=10, order="age")
    assert keys(table.claimed(a)) == {"d000", "d001", "d002", "d003"} and not keys(table.claimed(a)) & keys(table.claimed(b))
    late = results(table, a, "a").cache()
    late.count()
    table.beat(b, now=9, seconds=10)
    c = table.claim(todo, "c", most=10, now=12, seconds=10)  # a's lease has ended, b's goes on
    assert c > b > a and keys(table.claimed(c)) == {f"d{k:03d}" for k in (0, 1, 2, 3, 8, 9)}
    with pytest.raises(Lost):
        table.finish(a, late)
    table.finish(b, results(table, b, "b"))
    table.finish(c, results(table, c, "c").filter("document_id <> 'd009'"))  # done without a row
    assert {(r.document_id, r.worker) for r in table.read().collect()} == {(f"d{k:03d}", "b" if 4 <= k < 8 else "c") for k in range(9)}
    assert table.claim(todo, "a", most=5, now=50, seconds=1) is None
    with pytest.raises(Lost):
        table.beat(b, now=50, seconds=1)


def test_released_documents_are_free(spark, tmp_path):
    table, todo = LeasedTable(spark, str(tmp_path / "t")), docs(spark, 3)
    a = table.claim(todo, "a", most=9, now=0, seconds=100)
    assert table.claim(todo, "b", most=9, now=1, seconds=100) is None
    table.release(a)
    assert len(keys(table.claimed(table.claim(todo, "b", most=2, now=1, seconds=100)))) == 2


def test_claimers_at_once(spark, tmp_path):
    """Concurrent workers, each taking a few until none is left: every document is done once."""
    path, todo, failed = str(tmp_path / "t"), docs(spark, 12), []

    def work(name):
        try:
            table = LeasedTable(spark, path)
            while (fence := table.claim(todo, name, most=3, now=0, seconds=1000)) is not None:
                table.finish(fence, results(table, fence, name))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(f"w{n}",)) for n in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    done = [r.document_id for r in LeasedTable(spark, path).read().collect()]
    assert not failed and sorted(done) == sorted(set(done)) == [f"d{k:03d}" for k in range(12)]
