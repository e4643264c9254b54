"""Requests whose answers are committed are not asked again."""

import os
from collections import Counter

import pandas as pd
import pytest

from winnow.operators import bookkeeping, names
from winnow.plans import ledger
from winnow.plans.scorers import ANSWERS


def asker(log, stop, failing=()):
    """Asks nobody: notes each request in a file, dies at request 13 while ``stop`` exists."""

    def ask(requests):
        def run(batches):
            for pdf in batches:
                rows = []
                for r in pdf.itertuples():
                    with open(log, "a") as f:
                        f.write(f"{r.state}\n")
                    if r.state == "s13" and os.path.exists(stop):
                        raise RuntimeError("the task is lost")
                    bad = r.state in failing
                    rows += [(r.batch, k, None if bad else int(r.state[1:]) / 100, "unavailable" if bad else None, 1 - i, 10, 1, "m") for i, k in enumerate(r.keys)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

        return requests.mapInPandas(run, ANSWERS)

    return ask


def requests_of(spark, n):
    rows = [(i, f"s{i}", ["a", "b"], ["is it?", "was it?"]) for i in range(n)] + [(1000, "s5", ["a", "b"], ["is it?", "was it?"])]
    return spark.createDataFrame(rows, "batch long, state string, keys array<string>, questions array<string>")


def test_a_run_that_died_asks_only_what_is_left(spark, tmp_path):
    log, stop, at = str(tmp_path / "log"), str(tmp_path / "stop"), str(tmp_path / "ledger")
    requests = requests_of(spark, 24)
    open(stop, "w").close()
    with pytest.raises(Exception, match="the task is lost"):
        ledger.answered(requests, asker(log, stop), at, most=4)
    committed = {r.request for r in spark.read.parquet(at).collect()}
    known = {r.state for r in requests.withColumn("request", ledger.request_id()).collect() if r.request in committed}
    os.remove(stop)
    got = ledger.answered(requests, asker(log, stop), at, most=4).collect()
    assert {(r.batch, r.key): r.p for r in got} == {(b, k): (5 if b == 1000 else b) / 100 for b in [*range(24), 1000] for k in "ab"} and len(got) == 50
    times = Counter(open(log).read().split())
    # a request that says what another says is asked with it
    assert set(times) == {f"s{i}" for i in range(24)} and all(times[s] == 1 for s in known)
    assert sum(times.values()) - 24 <= 12  # the slice that was lost
    before = sum(times.values())
    ledger.answered(requests, asker(log, stop), at, most=4).collect()
    assert len(open(log).read().split()) == before


def test_failures_are_asked_by_the_next_run(spark, tmp_path):
    log, stop, at = str(tmp_path / "log"), str(tmp_path / "stop"), str(tmp_path / "ledger")
    requests = requests_of(spark, 8)
    first = ledger.answered(requests, asker(log, stop, failing={"s3"}), at).collect()
    assert {r.batch for r in first if r.failure} == {3}
    second = ledger.answered(requests, asker(log, stop), at).collect()
    assert not any(r.failure for r in second) and len(second) == 18
    assert Counter(open(log).read().split())["s3"] == 2 and Counter(open(log).read().split())["s4"] == 1


def test_replies_in_json(spark):
    good = {"q1": 0.25, "q2": 1.0}
    bodies = ['{"answers":{"q1":0.25,"q2":1}}', '{"answers":{"q1":0.25,"q2":1,"q1":0.25}}', '{"answers":{"q1":0.25}}', '{"answers":{"q1":0.25,"q2":1,"q3":0}}', '{"answers":{"q1":0.25,"q2":1.01}}', '{"answers":{"q1":0.25,"q2":-0.1}}', '{"answers":{"q1":"0.25","q2":1}}', '{"answers":{"q1":null,"q2":1}}', '{"answers":[0.25,1]}', "{}", "no JSON", None, '{"answers":{"q1":true,"q2":1}}']
    rows = spark.createDataFrame([(i, b, ["q1", "q2"]) for i, b in enumerate(bodies)], "i int, body string, asked array<string>")
    got = [r.answers for r in bookkeeping.parsed_answers(rows).orderBy("i").collect()]
    assert got == [good] + [None] * (len(bodies) - 1)


def test_many_roots(spark):
    paths = ["a/b/c.txt", "a/b", "ab/c.txt", "a/x/y/z.txt", "q.txt"]
    roots = ["a", "a/b", "a/b", "a/x/y/z.txt", *[f"r{i}" for i in range(10_000)]]
    table = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    want = {"a/b/c.txt": "a/b", "a/b": "a/b", "ab/c.txt": None, "a/x/y/z.txt": "a/x/y/z.txt", "q.txt": None}
    assert {r.path: r.root for r in names.nearest_roots(table(paths, "path"), table(roots, "root")).collect()} == want
    assert {r.root for r in names.nearest_roots(table(paths, "path"), table([""], "root")).collect()} == {""}
