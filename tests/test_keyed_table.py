"""Merge-on-read table: updates, upserts, compaction, crashes, concurrent writers."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from trellis.operators.analyze import apply_patch
from trellis.operators.keyed_table import Conflict, KeyedTable

SCHEMA = "id long, name string, n long, tags array<string>"


def new(spark, rows, schema=SCHEMA, key=("id",), **kw):
    path = os.path.join(tempfile.mkdtemp(prefix="trellis-table-", dir="/tmp"), "t")
    return KeyedTable.create(spark, path, spark.createDataFrame(rows, schema), list(key), **({"buckets": 4} | kw))


def rows(t, version=None):
    return sorted((tuple(r) for r in t.read(version).collect()), key=repr)


def data_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_update_upsert_and_older_versions(spark):
    t = new(spark, [(1, "a", 1, ["x"]), (2, "b", 2, None), (2, "b again", 3, []), (None, "no key", 0, None)])
    first = rows(t)
    patch = spark.createDataFrame([(2, "B", None, 1), (2, "old", 9, 0), (5, "nobody", 1, 1), (None, "null", 1, 1)], "id int, name string, n int, at int")
    assert t.update(patch, newest_by="at") == 1
    assert rows(t) == sorted([(1, "a", 1, ["x"]), (2, "B", 2, None), (2, "B", 3, []), (None, "no key", 0, None)], key=repr)
    t.update(spark.createDataFrame([(2, None)], "id long, n long"), set_nulls=True)
    assert {r[:3] for r in rows(t) if r[0] == 2} == {(2, "B", None)}
    t.upsert(spark.createDataFrame([(5, 7), (1, 8)], "id long, n long"))
    assert (5, None, 7, None) in rows(t) and (1, "a", 8, ["x"]) in rows(t)  # the update before the key was there stays without effect
    t.update(spark.createDataFrame([(5, "five")], "id long, name string"))
    assert (5, "five", 7, None) in rows(t)
    assert rows(t, 0) == first and t.versions() == [0, 1, 2, 3, 4]
    before = rows(t)
    assert t.compact(share=0.0) == 5 and rows(t) == before and not t.manifest().patches
    assert rows(t, 4) == before
    gone = t.vacuum()
    assert gone and rows(t) == before and t.versions() == [5]


def test_patches_are_as_large_as_what_they_change(spark):
    """A patch of 1 % of the rows writes about 1 % of the bytes."""
    rnd = random.Random(1)
    big = spark.range(20_000).select("id", F.md5(F.concat(F.col("id").cast("string"), F.lit("a"))).alias("name"), (F.col("id") * 3).alias("n"), F.array(F.sha2(F.col("id").cast("string"), 256)).alias("tags"))
    path = os.path.join(tempfile.mkdtemp(prefix="trellis-table-", dir="/tmp"), "t")
    t = KeyedTable.create(spark, path, big, ["id"], buckets=4)
    size = data_bytes(path)
    patch = spark.createDataFrame([(i, f"p{i}") for i in rnd.sample(range(20_000), 200)], "id long, name string")
    t.update(patch)
    assert data_bytes(path) - size < 0.02 * size
    want = apply_patch(big, patch, ["id"], ["name"])
    assert t.read().exceptAll(want).count() == 0 and t.read().count() == 20_000
    assert t.compact(share=0.2) == 1  # few patches: nothing to fold in


def test_random_patches_equal_a_rewrite(spark):
    rnd = random.Random(7)
    now = {i: [f"v{i}", i] for i in range(40)}
    t = new(spark, [(i, v[0], v[1], None) for i, v in now.items()])
    for step in range(6):
        some = {rnd.randrange(60): (rnd.choice([f"s{step}", None]), rnd.choice([step, None])) for _ in range(15)}
        add = step % 2 == 1
        frame = spark.createDataFrame([(k, *v) for k, v in some.items()], "id long, name string, n long")
        (t.upsert if add else t.update)(frame)
        for k, (name, n) in some.items():
            if k in now or add:
                old = now.get(k, [None, None])
                now[k] = [old[0] if name is None else name, old[1] if n is None else n]
        if step == 3:
            t.compact(share=0.3)
        assert rows(t) == sorted(((k, v[0], v[1], None) for k, v in now.items()), key=repr)


def test_a_crash_before_the_manifest_changes_nothing(spark, monkeypatch):
    t = new(spark, [(1, "a", 1, None), (2, "b", 2, None)])
    before = rows(t)
    def crash(self, m):
        raise RuntimeError("lost")
    with monkeypatch.context() as patched:
        patched.setattr(KeyedTable, "_publish", crash)
        with pytest.raises(RuntimeError, match="lost"):
            t.update(spark.createDataFrame([(1, "never")], "id long, name string"))
    assert rows(t) == before and t.versions() == [0]
    assert [g for g in t.vacuum() if g.startswith("patch/")]
    assert rows(t) == before


def test_two_writers(spark, monkeypatch):
    """A patch goes on top of one that was published meanwhile; a compaction keeps patches that came after its start."""
    t = new(spark, [(i, "a", i, None) for i in range(8)])
    other = KeyedTable(spark, t.path)
    real, once = KeyedTable._publish, []
    def late(self, m):
        if not once:
            once.append(1)
            other.update(spark.createDataFrame([(1, "other"), (2, "other")], "id long, name string"))
        return real(self, m)
    monkeypatch.setattr(KeyedTable, "_publish", late)
    t.update(spark.createDataFrame([(1, "mine")], "id long, name string"))
    assert {r[0]: r[1] for r in rows(t) if r[0] in (1, 2)} == {1: "mine", 2: "other"} and t.versions() == [0, 1, 2]
    once.clear()
    monkeypatch.setattr(KeyedTable, "_publish", late)
    t.compact(share=0.0)
    assert {r[0]: r[1] for r in rows(t) if r[0] in (1, 2)} == {1: "other", 2: "other"} and t.manifest().patches
    monkeypatch.setattr(KeyedTable, "_publish", real)
    with pytest.raises(Conflict):
        t._publish(t.manifest(1))


def test_repeated_batch_and_empty_frames(spark):
    t = new(spark, [(1, "a", 1, None)])
    add = spark.createDataFrame([(1, "b")], "id long, name string")
    assert t.update(add, batch=("q", 3)) == 1 and t.update(add, batch=("q", 3)) == 1 and t.update(add, batch=("q", 2)) == 1
    assert t.update(add.limit(0), batch=("q", 4)) == 2 and rows(t) == [(1, "b", 1, None)]
    none = new(spark, [])
    assert rows(none) == [] and none.upsert(add) == 1 and rows(none) == [(1, "b", None, None)]
    two = new(spark, [(1, "x", 5, None), (1, "y", 6, None)], key=("id", "name"), files_per_bucket=3)
    two.update(spark.createDataFrame([(1, "y", 60)], "id long, name string, n long"))
    assert rows(two) == [(1, "x", 5, None), (1, "y", 60, None)]
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, t.path + "-none").read()
