"""Reads that survive single files, and groups of calls that wait for each other."""

from __future__ import annotations

import os
import time

import pytest

from auditloom.operators import provider
from auditloom.sources.tables import read_listed, walk


def test_unreadable_vanished_and_huge_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "bad.py").write_bytes(b"ok \xff\xfe")
    (tmp_path / "folder").mkdir()
    with open(tmp_path / "huge.py", "wb") as f:
        f.truncate(1 << 30)
    (tmp_path / "empty.py").write_text("")
    paths = ["huge.py", "a.py", "gone.py", "folder", "bad.py", None, "empty.py", str(tmp_path / "a.py"), "/proc/self/mem"]
    df = spark.createDataFrame([(i, p, 5) for i, p in enumerate(paths)], "position int, path string, fault int")
    opened = os.stat(tmp_path / "huge.py").st_atime_ns
    got = [(r.content, r.size, r.skip_reason) for r in read_listed(df.drop("fault"), root=str(tmp_path)).orderBy("position").collect()]
    assert got[0] == (None, 1 << 30, "File too large (1 GB)") and os.stat(tmp_path / "huge.py").st_atime_ns == opened
    assert got[1] == got[7] == ("x = 1\n", 6, None) and got[4][0] == "ok ��" and got[6] == ("", 0, None)
    assert got[2] == got[5] == (None, None, "File not found")
    assert got[3][0] is got[8][0] is None and all(x[2] and "too large" not in x[2] for x in (got[3], got[8]))


def test_a_file_that_goes_or_grows_after_it_was_listed(spark, tmp_path):
    for name in ("stays.py", "goes.py", "grows.py"):
        (tmp_path / name).write_text("1")
    listed = walk(spark, str(tmp_path)).toPandas()
    (tmp_path / "goes.py").unlink()
    (tmp_path / "grows.py").write_text("2" * 100)
    got = {r.path: (r.content, r.skip_reason) for r in read_listed(spark.createDataFrame(listed), most=50, root=str(tmp_path)).collect()}
    assert got == {"stays.py": ("1", None), "goes.py": (None, "File not found"), "grows.py": (None, "File too large (51 B)")}


@pytest.mark.parametrize(("concurrency", "cores"), [(3, 4), (5, 2)])
def test_a_group_begins_when_the_last_one_has_ended(spark, tmp_path, monkeypatch, concurrency, cores):
    folder = str(tmp_path)
    context = type(spark.sparkContext)
    monkeypatch.setattr(context, "defaultParallelism", property(lambda self: cores))

    def answers(system, prompt):
        name, began = prompt.rsplit("\n", 1)[1], time.time()
        time.sleep(0.3 if int(name) % concurrency == 0 else 0.05)
        with open(f"{folder}/{name}", "w") as f:
            f.write(f"{began} {time.time()}")
        if name == "4":
            raise RuntimeError("no answer")
        return '{"status": "PASS"}'

    files = spark.createDataFrame([(f"f{i}", str(i), i) for i in range(concurrency * 3 + 1)], "path string, content string, position int").repartition(3)
    got = {r.path: r.status for r in provider.audit(files, [answers], "s", concurrency, "position").collect()}
    assert got == {f"f{i}": "ERROR" if i == 4 else "PASS" for i in range(concurrency * 3 + 1)}
    times = [tuple(map(float, open(f"{folder}/{i}").read().split())) for i in range(concurrency * 3 + 1)]
    groups = [times[i : i + concurrency] for i in range(0, len(times), concurrency)]
    for earlier, later in zip(groups, groups[1:], strict=False):
        assert min(b for b, _ in later) >= max(e for _, e in earlier)
    assert any(max(b for b, _ in g) < min(e for _, e in g) for g in groups[:3])
    assert provider.audit(files.limit(0), [answers], "s", concurrency, "position").collect() == []


def test_files_over_the_cap_are_never_opened(spark, tmp_path):
    """The source can't hold more than two gigabytes, so reading the sparse file would fail."""
    from auditloom.sources.tables import read_files

    (tmp_path / "a.py").write_text("x")
    with open(tmp_path / "huge.bin", "wb") as f:
        f.truncate(3 << 30)
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.skip_reason) for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("x", None), "huge.bin": (None, "File too large (3 GB)")}
