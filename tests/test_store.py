"""Tables that survive retries and dying writers."""
import os

import pytest
from pyspark.sql import functions as F

from contrail.sources.store import BatchTable, KeyedTable
from tests.conftest import rows


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_batch_counts_once(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path), ("k",))
    with pytest.raises(ValueError):
        table.read()
    table.append(frame(spark, ("a", 1), ("b", 2)), "one")
    table.append(frame(spark, ("a", 1), ("b", 2)), "one")      # a retry
    table.append(frame(spark, ("c", 3)), "two/../odd id")
    table.stage(frame(spark, ("x", 9)))                       # a writer that died
    assert rows(table.read()) == [("a", 1), ("b", 2), ("c", 3)]
    table.append(frame(spark, ("a", 7)), "one")               # a retry with other rows
    assert rows(table.read()) == [("a", 7), ("c", 3)]
    assert table.batches() == ["one", "two/../odd id"]
    before = len(files(tmp_path))
    table.vacuum()
    assert len(files(tmp_path)) == 2 < before
    assert rows(table.read()) == [("a", 7), ("c", 3)]
    table.append(frame(spark).where("false"), "empty")
    assert table.read().count() == 2
    table.append(frame(spark, ("z", 0)).withColumnRenamed("v", "w"), "other")
    with pytest.raises(ValueError):
        table.read()


def test_a_late_commit_of_a_batch_replaces_it(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path))
    slow = table.stage(frame(spark, ("a", 1)))
    table.append(frame(spark, ("a", 2)), "b")
    table.commit("b", slow)
    assert rows(table.read()) == [("a", 1)]


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=8)
    assert table.upsert(frame(spark, *[(str(i), i) for i in range(40)]), ["v"]) == 1
    first = table._manifest()["folders"]
    old = files(tmp_path)
    assert table.upsert(frame(spark, ("7", 100), ("7", 50), ("new", 1)), ["v"]) == 2
    second = table._manifest()["folders"]
    changed = {b for b in second if second[b] != first.get(b)}
    assert 1 <= len(changed) <= 2 and old <= files(tmp_path)
    want = sorted([(str(i), 100 if i == 7 else i) for i in range(40)] + [("new", 1)])
    assert rows(table.read()) == want
    assert rows(table.read(version=1)) == sorted((str(i), i) for i in range(40))
    assert table.upsert(frame(spark, ("7", 100)), ["v"]) == 3 and rows(table.read()) == want   # again
    table.vacuum(keep=2)
    assert table.versions() == [2, 3] and rows(table.read()) == want
    table.vacuum()
    assert rows(KeyedTable(spark, str(tmp_path), ["k"]).read()) == want
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path), ["v"]).read()


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=4)
    table.upsert(frame(spark, ("a", 1), ("b", 2)), ["v"])

    def die(name, content):
        raise RuntimeError("power cut")
    monkeypatch.setattr(table._folder, "publish", die)
    with pytest.raises(RuntimeError):
        table.upsert(frame(spark, ("a", 5), ("c", 6)), ["v"])
    monkeypatch.undo()
    assert rows(table.read()) == [("a", 1), ("b", 2)] and table.versions() == [1]
    table.upsert(frame(spark, ("a", 5), ("c", 6)), ["v"])
    assert rows(table.read()) == [("a", 5), ("b", 2), ("c", 6)]


def test_writers_that_meet_lose_nothing(spark, tmp_path, monkeypatch):
    table, other = (KeyedTable(spark, str(tmp_path), ["k"], buckets=2) for _ in range(2))
    table.upsert(frame(spark, ("a", 1)), ["v"])
    publish, met = table._folder.publish, []

    def late(name, content):
        if not met:
            met.append(other.upsert(frame(spark, ("b", 2), ("a", 9)), ["v"]))
        return publish(name, content)
    monkeypatch.setattr(table._folder, "publish", late)
    assert table.upsert(frame(spark, ("c", 3)), ["v"]) == 3 and met == [2]
    assert rows(table.read()) == [("a", 9), ("b", 2), ("c", 3)]


def test_inserts_keep_what_is_there_and_null_keys_match(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=4)
    table.insert_if_absent(frame(spark, ("a", 1), (None, 2)), ["v"])
    table.insert_if_absent(frame(spark, ("a", 5), (None, 6), ("b", 7), ("b", 8)), ["v"])
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {"a": 1, None: 2, "b": 8} and table.read().count() == 3
    table.upsert(frame(spark, (None, 0)), ["v"])
    assert {r.k: r.v for r in table.read().collect()}[None] == 0
    wide = frame(spark, ("z", 4)).withColumn("v", F.col("v").cast("long"))
    table.upsert(wide, ["v"])       # cast to the table's own types
    assert table.read().schema["v"].dataType.simpleString() == "int"
    empty = KeyedTable(spark, str(tmp_path / "none"), ["k"])
    assert empty.upsert(frame(spark, ("a", 1)).where("false"), ["v"]) == 1 and empty.read().count() == 0
