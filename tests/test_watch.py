"""Work that ends in the middle of a job."""

import time
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnow.limits import LIMITS
from winnow.plans import ask, search
from winnow.plans.scorers import SqlScorer
from winnow.plans.watch import Stopped, Watch
from winnow.sources import store
from tests.test_search import PATHS, TIDES, case, found, table


def slow(mark, column):
    """Takes a minute for items whose column says "slow", and leaves a mark that it has begun."""

    @F.pandas_udf("double")
    def wait(p: pd.Series, which: pd.Series) -> pd.Series:
        if which.str.contains("slow").any():
            open(mark, "w").close()
            time.sleep(60)
        return p

    return lambda p: wait(p, column)


def ended(s, mark):
    """Runs the search; its job must end within a second of the mark, the plan of its result is put together after that."""
    finish, at = s._finish, []

    def timed(*args):
        at.append(time.time())
        return finish(*args)

    s._finish = timed
    f = s.run()
    assert at[-1] - mark.stat().st_mtime < 1 and time.time() - mark.stat().st_mtime < 3
    return f


def test_a_long_round_is_cut_short(spark, tmp_path):
    mark = tmp_path / "begun"
    p = slow(str(mark), F.when(F.col("path").startswith("lib/tide/"), "slow").otherwise(""))(case("path", PATHS))
    s = search.Search(table(spark, TIDES), "?", SqlScorer(p), cancelled=mark.exists)
    f = ended(s, mark)
    files, ranges, summary = found(f)
    assert summary == {"files_considered": 4, "directories_pruned": 1, "files_skipped": 0, "matches_found": 0, "results_limited": False, "status": "interrupted"}
    # entries that were listed and not judged are told of, those of whole rounds are not
    assert sorted((r.kind, r.code, r.path) for r in f.issues.collect()) == [("cancelled", "cancelled", f"lib/tide/{n}.go") for n in ("gauge", "gauge_check")]
    assert files == [] and ranges == {} and search.whole_report(s, f)


def test_files_of_whole_rounds_stay(spark, tmp_path):
    mark = tmp_path / "begun"
    unit = F.col("kind") == "unit"
    p = slow(str(mark), F.when(unit, "slow").otherwise(""))(F.when(unit, 0.9).otherwise(case("path", PATHS)))
    f = ended(search.Search(table(spark, TIDES), "?", SqlScorer(p), cancelled=mark.exists), mark)
    files, ranges, summary = found(f)
    assert files == [("lib/tide/gauge.go", 0.95), ("lib/tide/gauge_check.go", 0.7)] and ranges == {}
    assert summary["status"] == "interrupted" and summary["matches_found"] == 2
    assert sorted((r.kind, r.path) for r in f.issues.collect()) == [("cancelled", "lib/tide/gauge.go"), ("cancelled", "lib/tide/gauge_check.go")]


def test_a_deadline_before_reading(spark):
    s = search.Search(table(spark, TIDES), "?", SqlScorer(F.lit(0.9)), seconds=0.0)
    _, _, summary = found(s.run())
    assert summary["status"] == "interrupted" and summary["files_considered"] == 0 and s.requests == 0


def test_a_call_ends_after_its_seconds(spark, tmp_path):
    mark = tmp_path / "begun"
    files = spark.createDataFrame([(0, "a", "i", "one")], "ord long, path string, identity string, text string")
    p = slow(str(mark), F.lit("slow"))(F.lit(0.5))
    start = time.time()
    out = ask.ask_one(files, ["This?", "That?", "This?"], SqlScorer(p), replace(LIMITS, ask_seconds=4.0))
    assert time.time() - start < 5
    assert [tuple(r) for r in out.orderBy("ord").collect()] == [(i, q, None, "provider_unavailable") for i, q in enumerate(["This?", "That?", "This?"])]
    out = ask.ask_one(files, ["This?"], SqlScorer(p), cancelled=lambda: True)
    assert [r.error for r in out.collect()] == ["cancelled"]
    assert [r.p_yes for r in ask.ask_one(files, ["This?"], SqlScorer(F.lit(0.5))).collect()] == [0.5]


def test_other_jobs_and_other_errors_go_through(spark, tmp_path):
    with pytest.raises(Stopped, match="deadline"), Watch(spark, 0.5).over():
        while True:
            spark.range(10).count()
    assert spark.range(10).count() == 10
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"), Watch(spark, 60).over():
        spark.range(4).select(F.expr("1 / (id - id)")).collect()
    with pytest.raises(Stopped):
        with Watch(spark, 0.5).over():
            store.written(spark.range(4).select(slow(str(tmp_path / "x"), F.lit("slow"))(F.lit(1.0)).alias("p")), "half-done")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.folder(spark)}/winnow/half-done-*")
    assert len(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)) == 0
