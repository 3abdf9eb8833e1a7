"""Stores that several writers update."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from auditloom import constants as K
from auditloom.operators import cache, enrich
from auditloom.sources import versioned


@pytest.fixture
def path(tmp_path):
    return "file://" + str(tmp_path / "store")


def rows(spark, values):
    return spark.createDataFrame(values, "key string, stamp long, value string")


def stored(spark, path, version=None):
    return sorted((r.key, r.stamp, r.value) for r in versioned.current(spark, path, version).collect())


def test_the_latest_stamp_wins_whatever_the_order(spark, path):
    assert versioned.current(spark, path) is None and versioned.compact(spark, path) == 0
    versioned.vacuum(spark, path)
    first = rows(spark, [("a", 1, "x"), ("b", 5, "y"), (None, 1, "n"), ("c", 1, "p"), ("c", 1, "q")])
    assert versioned.upsert(first, path) == 1 and versioned.upsert(first, path) == 2
    versioned.upsert(rows(spark, [("a", 2, "new"), ("b", 4, "old"), ("d", 9, "z")]), path)
    wanted = [("a", 2, "new"), ("b", 5, "y"), ("c", 1, "p"), ("c", 1, "q"), ("d", 9, "z")]
    assert stored(spark, path) == wanted and stored(spark, path, 2) == [("a", 1, "x"), ("b", 5, "y"), ("c", 1, "p"), ("c", 1, "q")]
    versioned.compact(spark, path, oldest=2)
    assert stored(spark, path) == [r for r in wanted if r[1] >= 2]
    versioned.upsert(rows(spark, [("c", 0, "again")]), path)
    versioned.vacuum(spark, path)
    assert stored(spark, path) == sorted([*(r for r in wanted if r[1] >= 2), ("c", 0, "again")]) and len(versioned._versions(spark, path)) == 1
    with pytest.raises(ValueError, match="other columns"):
        versioned.upsert(rows(spark, []).drop("value"), path)


def test_writers_at_once(spark, path):
    with ThreadPoolExecutor(5) as pool:
        versions = list(pool.map(lambda n: versioned.upsert(rows(spark, [(k, n, f"{k}{n}") for k in "abc"] + [(f"own{n}", 1, "o")]), path), range(5)))
    assert sorted(versions) == [1, 2, 3, 4, 5]
    assert stored(spark, path) == [(k, 4, f"{k}4") for k in "abc"] + [(f"own{n}", 1, "o") for n in range(5)]


def test_a_write_during_a_compaction_stays(spark, path, monkeypatch):
    versioned.upsert(rows(spark, [("a", 1, "x")]), path)
    real, once = versioned._write, []

    def write(df, where):
        folder = real(df, where)
        if not once:
            once.append(1)
            versioned.upsert(rows(spark, [("a", 2, "y")]), where)
        return folder

    monkeypatch.setattr(versioned, "_write", write)
    versioned.compact(spark, path)
    assert stored(spark, path) == [("a", 2, "y")]
    once.clear()
    monkeypatch.setattr(versioned, "_write", lambda df, where: (real(df, where), once or (once.append(1), versioned.compact(spark, where)))[0])
    with pytest.raises(versioned.Conflict):
        versioned.compact(spark, path)
    assert stored(spark, path) == [("a", 2, "y")]


def test_two_caches_written_at_once_hold_a_key_once(spark, path):
    verdict = "key string, verdict struct<status:string,message:string>"
    one = spark.createDataFrame([("k1", ("PASS", "")), ("k2", ("ERROR", "")), ("k3", ("FAIL", "a"))], verdict)
    two = spark.createDataFrame([("k1", ("FAIL", "later")), ("k4", ("PASS", ""))], verdict)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda x: cache.write(x[0], path, now_ms=x[1]), ((one, 10), (two, 20))))
    cache.write(one, path, now_ms=10)
    got = {r.key: r.json for r in cache.read(spark, path).collect()}
    assert cache.read(spark, path).count() == 3 and set(got) == {"k1", "k3", "k4"} and "later" in got["k1"]
    cache.compact(spark, path, now_ms=30, ttl_ms=20)
    assert {r.key for r in cache.read(spark, path).collect()} == {"k1", "k4"}


def test_skills_of_a_stack_are_replaced(spark, path):
    make = lambda *names: spark.createDataFrame([(n,) for n in names], "skill string")
    assert enrich.stored_skills(spark, path, "go", 0) is None
    enrich.store_skills(make("a", "b"), path, "go", 1000)
    enrich.store_skills(make("c"), path, "go", 2000)
    enrich.store_skills(make("d"), path, "rust", 1500)
    read = lambda key, now: sorted(r.skill for r in enrich.stored_skills(spark, path, key, now).collect())
    assert read("go", 2500) == ["c"] and read("rust", 2500) == ["d"] and read("rust", 1500 + K.SKILLS_TTL_MS) == []
    enrich.compact_skills(spark, path, 1500 + K.SKILLS_TTL_MS)
    assert read("go", 0) == ["c"] and read("rust", 0) == []


def test_temporary_tables_go_and_kept_ones_pass_outwards(spark):
    from auditloom.sources import store

    there = lambda t: store._PATHS.get(t) is not None
    with store.temporary():
        outer = store.save(spark.range(3), "outer")
        with store.temporary():
            inner, kept = store.save(spark.range(4), "inner"), store.keep(store.save(spark.range(5), "kept"))
        assert there(outer) and there(kept) and not there(inner) and kept.count() == 5
        last = store.keep(store.save(spark.range(6), "last"))
    assert not there(outer) and not there(kept) and last.count() == 6
    with pytest.raises(RuntimeError), store.temporary():
        lost = store.save(spark.range(2), "lost")
        raise RuntimeError
    assert not there(lost) and store._SCOPES == []
