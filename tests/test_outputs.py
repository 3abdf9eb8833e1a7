"""Progress that is observed, and comments that are posted once."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from auditloom import config
from auditloom.operators.progress import Progress
from auditloom.plans.review import review
from auditloom.sources import posting

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RESULT = "path string, status string, issues array<struct<line:double,severity:string,message:string,suggestion:string>>"


def test_counts_of_a_review_equal_its_frames(spark):
    said = []
    rows = [("src/a.ts", "+ok\n"), ("src/b.ts", '+token = "abcdefgh1234"\n'), (".env", "+x"), ("src/c.ts", "Binary files a and b"), ("src/d.ts", "+l\n" * 150), ("src/e.ts", "+m\n")]
    settings = config.from_dict({"ai": {"max_diff_lines": 100, "max_files": 4}})
    progress = Progress(say=said.append)
    out = review(spark.createDataFrame(rows, "path string, patch string"), settings, progress=progress)
    assert progress.counts() == {}
    out.report.collect()
    got = progress.counts()
    plain = review(spark.createDataFrame(rows, "path string, patch string"), settings)
    statuses = [r.status for r in plain.results.collect()]
    assert got["listed"] == {"rows": 6, "rejected": 1} and got["capped"] == {"rows": 5, "skipped": 1}
    assert got["patches"] == {"rows": 4, "skipped": 1, "changed_lines": 152} and got["budget"] == {"rows": 3, "skipped": 1}
    assert got["redacted"] == {"rows": plain.inputs.count(), "redactions": 1} and plain.skipped.count() == 4
    assert got["results"] == {"rows": len(statuses), "pass": statuses.count("PASS"), "fail": statuses.count("FAIL"), "error": 0}
    progress.report()
    assert len(said) == 6 and said[0] == "listed: rows 6, rejected 1"
    with pytest.raises(ValueError, match="watched already"):
        progress.watch(out.inputs, "listed")


def test_quiet_progress_says_nothing(spark):
    said = []
    progress = Progress(quiet=True, say=said.append)
    progress.watch(spark.range(7), "all", total=F.sum("id")).collect()
    progress.report()
    assert said == [] and progress.counts() == {"all": {"rows": 7, "total": 21}}


def results(spark, n=20):
    issue = lambda i: [(float(i), "WARNING", f"m{i}", None), (1.0, "INFO", "é\n", "do")]
    return spark.createDataFrame([(f"f{i}", "FAIL" if i % 4 else "PASS", issue(i) if i % 3 else []) for i in range(n)], RESULT).repartition(4)


def posted(folder):
    return sorted(json.dumps(json.loads(line), sort_keys=True) for f in os.listdir(folder) for line in open(f"{folder}/{f}", encoding="utf-8"))


def test_comments_to_a_folder_and_to_a_callable(spark, tmp_path):
    wanted = sorted(json.dumps(r.asDict(), sort_keys=True) for r in posting.comments(results(spark)).collect())
    assert len(wanted) == 20 and "**INFO** é\n\n\n> do" in {json.loads(w)["body"] for w in wanted}
    folder = str(tmp_path / "out")
    posting.post(results(spark), folder)
    assert posted(folder) == wanted
    taken = str(tmp_path / "taken")

    def send(comment):
        with open(taken, "a") as f:
            f.write(json.dumps(comment, sort_keys=True) + "\n")

    posting.post(results(spark), str(tmp_path / "staging"), send)
    assert sorted(open(taken).read().splitlines()) == wanted and os.listdir(tmp_path / "staging") == []
    posting.post(results(spark).limit(0), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none") or os.listdir(tmp_path / "none") == []


def test_a_callable_that_fails_names_what_it_took(spark, tmp_path):
    def send(comment):
        raise RuntimeError("no network")

    with pytest.raises(Exception, match="0 comments were delivered"):
        posting.post(results(spark), str(tmp_path / "s"), send)
    assert os.listdir(tmp_path / "s") == []


RETRIED = """
import os, sys
sys.path.insert(0, {root!r})
os.environ["PYTHONPATH"] = {root!r}
from pyspark.sql import SparkSession
from auditloom.sources import posting
from tests.test_outputs import results
folder = {folder!r}

class Failing(posting.CommentWriter):
    def write(self, iterator):
        staged = super().write(iterator)
        try:
            os.close(os.open(folder + ".failed", os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return staged
        raise RuntimeError("lost after it staged its rows")

posting.CommentWriter = Failing
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
posting.post(results(spark), folder)
spark.stop()
"""


def test_a_task_that_fails_once_leaves_no_second_copy(spark, tmp_path):
    folder = str(tmp_path / "out")
    run = subprocess.run([sys.executable, "-c", RETRIED.format(root=ROOT, folder=folder)], capture_output=True, text=True, timeout=300, check=False)
    assert run.returncode == 0, run.stderr[-2000:]
    assert os.path.exists(folder + ".failed")
    assert posted(folder) == sorted(json.dumps(r.asDict(), sort_keys=True) for r in posting.comments(results(spark)).collect())
