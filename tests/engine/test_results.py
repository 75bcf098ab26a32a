"""The checkpointed sink: kills between its steps, batches played again, seeds replaced, streams."""

import pytest

from tremolo.sources import results

SCHEMA = "run string, source_row long, sim double"


def rows(spark, *own):
    return spark.createDataFrame(list(own), SCHEMA)


def held(spark, path):
    return sorted(map(tuple, results.read(spark, path).collect()), key=str)


def test_batches_count_once_and_later_seeds_replace(spark, tmp_path):
    path = str(tmp_path / "r")
    first = rows(spark, ("a", 1, 0.1), ("a", 1, 0.2), ("a", 2, 0.3), (None, 1, 0.4), ("a", None, 0.5))
    assert results.append(first, path, 0, 4) and not results.append(first, path, 0, 4)
    assert held(spark, path) == sorted(map(tuple, first.collect()), key=str)
    assert results.append(rows(spark, ("a", 1, 0.9), (None, 1, 0.8)), path, 1, 2)
    want = sorted([("a", 1, 0.9), ("a", 2, 0.3), (None, 1, 0.8), ("a", None, 0.5)], key=str)
    assert held(spark, path) == want
    assert [tuple(r) for r in results.read(spark, path, ("a", 1)).collect()] == [("a", 1, 0.9)]
    assert [tuple(r) for r in results.read(spark, path, (None, 1)).collect()] == [(None, 1, 0.8)]
    plan = results.read(spark, path, ("a", 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    results.compact(spark, path, 8)
    assert len(results.ledger(spark, path)) == 1 and held(spark, path) == want
    assert not results.append(first, path, 0)  # played again after it was merged
    assert results.append(rows(spark), path, 2) and held(spark, path) == want
    assert results.append(rows(spark, ("a", 2, 0.0)), path, 3)
    assert ("a", 2, 0.0) in held(spark, path) and ("a", 2, 0.3) not in held(spark, path)
    results.compact(spark, path)
    assert len(held(spark, path)) == 4 and len(results.ledger(spark, path)) == 1


@pytest.mark.parametrize("step", ["before the files", "before the entry", "after the entry"])
def test_a_kill_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "r")
    results.append(rows(spark, ("a", 1, 0.1)), path, 0)
    batch = rows(spark, ("a", 1, 0.7), ("b", 5, 0.2))
    put, commit = results._put, results._commit

    def killed(*a, **b):
        raise RuntimeError("killed")

    def then_killed(*a, **b):
        commit(*a, **b)
        raise RuntimeError("killed")

    monkeypatch.setattr(results, "_put", killed if step == "before the files" else put)
    monkeypatch.setattr(results, "_commit", {"before the entry": killed, "after the entry": then_killed}.get(step, commit))
    with pytest.raises(RuntimeError):
        results.append(batch, path, 1)
    done = step == "after the entry"
    assert held(spark, path) == ([("a", 1, 0.7), ("b", 5, 0.2)] if done else [("a", 1, 0.1)])
    monkeypatch.undo()
    assert results.append(batch, path, 1) is not done
    assert held(spark, path) == [("a", 1, 0.7), ("b", 5, 0.2)]


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "r")
    assert results._commit(spark, path, "000000000000", batch=0) and not results._commit(spark, path, "000000000000", batch=0)


def test_a_stream_goes_on_after_a_failure(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows(spark, ("a", 1, 0.1), ("a", 2, 0.2)).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    put = results.sink(path, 2)

    def failing(batch, number):
        put(batch, number)
        raise RuntimeError("killed after the batch was taken over, before the stream knew")

    q = stream().writeStream.option("checkpointLocation", checkpoint).foreachBatch(failing).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(60)
    rows(spark, ("a", 2, 0.9), ("b", 1, 0.3)).coalesce(1).write.mode("append").parquet(source)
    assert results.follow(stream(), path, checkpoint, 2).awaitTermination(60)
    assert held(spark, path) == [("a", 1, 0.1), ("a", 2, 0.9), ("b", 1, 0.3)]
    assert results.follow(stream(), path, checkpoint, 2).awaitTermination(60)
    assert len(held(spark, path)) == 3


def test_nothing_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        results.read(spark, str(tmp_path / "none"))
