import os
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from winnow.limits import LIMITS
from winnow.operators import names
from winnow.sources import filetree, records
from winnow.streaming import budget


@pytest.fixture
def tree(tmp_path):
    files = {"README.md": "hi\n", "src/main.py": "x = 1\n", "src/.env": "A=1", "node_modules/x/i.js": "", "deploy.key": "k", "src/keep.log": "k", "src/drop.log": "d", "src/_u.txt": "u", ".git/config": "c", "img.bin": "a\0b", "latin.txt": b"caf\xe9", "key.txt": "-----BEGIN RSA PRIVATE KEY-----\n", ".gitignore": "*.log\n!keep.log\n/only/\n", "only/a.txt": "a", "sub/only/b.txt": "b", "sub/.ignore": "b2*\n", "sub/b2.txt": ""}
    for name, text in files.items():
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    (tmp_path / "outside.txt").write_text("o")
    os.symlink("../outside.txt", tmp_path / "t/out.txt")
    os.symlink("README.md", tmp_path / "t/link.md")
    os.symlink("src/.env", tmp_path / "t/env.txt")
    return tmp_path / "t"


def test_file_tree(spark, tree):
    filetree.register(spark)
    rows = {r.path: r for r in spark.read.format("winnow_files").option("path", str(tree)).load().collect()}
    kept = sorted(p for p, r in rows.items() if r.reason is None and r.kind == "file")
    assert kept == ["README.md", "img.bin", "key.txt", "latin.txt", "link.md", "src/_u.txt", "src/keep.log", "src/main.py", "sub/only/b.txt"]
    assert {p: rows[p].reason for p in ("src/.env", "node_modules", "deploy.key", ".git", "out.txt", "env.txt")} == {"src/.env": "hidden", "node_modules": "dependency", "deploy.key": "sensitive_name", ".git": "hidden", "out.txt": "symlink", "env.txt": "hidden"}
    assert {p: rows[p].status for p in ("README.md", "img.bin", "latin.txt", "key.txt")} == {"README.md": "ok", "img.bin": "binary", "latin.txt": "encoding", "key.txt": "private_key"}
    assert rows["link.md"].text == "hi\n" and "node_modules/x/i.js" not in rows and "only" not in rows


def test_resolve(tree):
    root = str(tree.resolve())
    assert filetree.resolve(f"{root}/link.md") == f"{root}/README.md" and filetree.resolve(f"{root}/a/../b/./c") == f"{root}/b/c"
    assert filetree.resolve(f"{root}/out.txt") == f"{tree.parent.resolve()}/outside.txt"
    os.symlink("loop", tree / "loop")
    assert filetree.resolve(f"{root}/loop") is None


def test_literal_prefixes(spark):
    from winnow.functions.text import is_format_or_bytes

    rows = spark.createDataFrame([(x,) for x in ("f'", "rb'", 'B"', '"""', "r'", "u'")], "s string")
    assert [r.hit for r in rows.select(is_format_or_bytes(F.col("s")).alias("hit")).collect()] == [True, True, True, False, False, False]


def test_globs(spark):
    assert names.glob_regex("a/*.rs") == r"^a/[^/]*\.rs$"
    cases = [("**/*.py", "a/b/c.py", True), ("**/*.py", "c.py", True), ("*.py", "a/c.py", False), ("a/**", "a/b/c", True), ("a/**", "a", False), ("a?c", "a/c", False), ("{a,b}.txt", "b.txt", True), ("[!a].txt", "b.txt", True), (r"\*.txt", "*.txt", True)]
    for pattern, path, hit in cases:
        assert spark.range(1).select(F.lit(path).rlike(names.glob_regex(pattern))).first()[0] == hit, pattern
    for bad in ("", "/a", "a/../b", ".."):
        with pytest.raises(ValueError):
            names.glob_regex(bad)
    prune = lambda d, p: spark.range(1).select(names.prunes(F.lit(d), p)).first()[0]
    assert prune("d", ["d/**"]) and prune("d", ["d/**/*"]) and prune("d", ["d/*"]) and not prune("d", ["d/*.rs"])


def test_records(tmp_path):
    t = 1_790_841_178.28299
    assert records.stamp(t) == "20261001T075258.282990Z"
    a, b = (records.allocate(tmp_path, "captures", t, "a b") for _ in range(2))
    assert a.name == "20261001T075258.282990Z-a_b" and b.name == a.name + "-1"
    command = records.start_capture(a, "echo hi; echo no >&2", "/x", t)
    os.system(command.replace("{\n", "( ").replace("\n}", " )"))
    shown, code = records.finish_capture(a, "3", t + 6.449)
    assert code == 3 and shown.decode().startswith("hi\n--- stderr\nno\nexit_code: 3\nstdout: 3 bytes ") and b"duration_seconds: 6.4" in shown
    (a / "stdout.log").write_bytes(b"x" * 2049)
    assert b"output not shown" in records.finish_capture(a, "soon", t)[0] and records.finish_capture(b, "soon", t)[1] == 1
    records.create(a / "new", b"1")
    with pytest.raises(FileExistsError):
        records.create(a / "new", b"2")
    assert str(records.state_root({"XDG_STATE_HOME": "/s"})) == "/s/winnow" and str(records.state_root({"XDG_STATE_HOME": "s", "HOME": "/h"})) == "/h/.local/state/winnow"


def test_admission():
    second = budget.SECOND
    held = [(0, 200_000)]
    assert budget.admit(held, second // 5, 100_000, LIMITS)[2] == pytest.approx(0.8)
    assert budget.admit(held, second, 100_000, LIMITS)[2] == 0
    full = [(30 * second, 0)] * 1200
    assert budget.admit(full, 60 * second, 0, LIMITS)[2] == 30 and budget.admit(full, 91 * second, 0, LIMITS)[2] == 0


def test_stream_agrees_with_the_batch(spark, sf, tmp_path):
    from winnow.operators.budget import rate_windows
    from winnow.plans.inputs import vattempts

    rows = vattempts(spark, sf).where("search < 10").withColumn("ts", F.col("ts").cast("timestamp")).select("search", "event_id", "ts", "tokens")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {r.event_id: (r.requests, r.window_tokens) for r in budget.decided(stream, str(tmp_path / "out"), replace(LIMITS, requests_per_minute=2)).collect()}
    want = {r.event_id: (r.requests, r.window_tokens) for r in rate_windows(rows).collect()}
    assert got == want and want


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Attempts that come after a restart meet those of the last minute before it, and none is decided twice."""
    from datetime import datetime, timedelta

    from winnow.operators.budget import rate_windows

    begin = datetime(2024, 5, 1)
    rows = [(i % 3, i, begin + timedelta(seconds=2.5 * i), 100 + i) for i in range(90)]
    schema = "search long, event_id long, ts timestamp, tokens long"
    folder, limits = str(tmp_path / "in"), replace(LIMITS, requests_per_minute=5)
    run = lambda: budget.decided(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "out"), limits)
    whole = spark.createDataFrame(rows, schema)
    whole.where("event_id < 40").coalesce(1).write.parquet(folder)
    assert run().count() == 40
    whole.where("event_id >= 40").coalesce(1).write.mode("append").parquet(folder)
    got = sorted((r.event_id, r.requests, r.window_tokens, r.wait_seconds > 0) for r in run().collect())
    want = sorted((r.event_id, r.requests, r.window_tokens, r.requests > 5) for r in rate_windows(whole).collect())
    assert got == want
    assert run().count() == 90


def test_pace_keeps_to_both_windows():
    from winnow.operators.pace import Pace

    clock = [0.0]
    pace = Pace(replace(LIMITS, requests_per_minute=3, tokens_per_second=100), now=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
    place = pace.admit(80)
    assert clock[0] == 0 and pace.wait(30) == pytest.approx(1.0) and pace.wait(20) == 0
    pace.correct(place, 10)  # what was used takes the estimate's place
    assert pace.wait(90) == 0
    pace.admit(90)
    pace.admit(90)
    assert clock[0] == pytest.approx(1.0)
    assert pace.admit(1, deadline=59.0) is None and pace.admit(1, deadline=90.0) is not None
    assert clock[0] == pytest.approx(60.0)
    pace.pause(5.0)
    assert pace.wait(0) >= 5.0
    half = Pace(replace(LIMITS, requests_per_minute=4, tokens_per_second=100), share=0.5, now=lambda: 0.0)
    assert half.requests == 2 and half.tokens == 50


def test_roots_as_given_and_as_resolved(spark, tmp_path):
    real, link = tmp_path / "real place", tmp_path / "link"
    real.mkdir()
    link.symlink_to(real)
    got = filetree.roots([f"file://{tmp_path}/link/", f"file://localhost{tmp_path}/real%20place", "https://x/y", "file://far/z", "here", str(link)])
    assert got == [str(link), str(real)]
    paths = spark.createDataFrame([(f"{link}/a",), (f"{real}/b",), (f"{tmp_path}/c",), (f"{real}x/d",), (str(link),)], "path string")
    assert {(r.path, r.root) for r in filetree.inside(paths, [f"file://{link}"]).collect()} == {(f"{link}/a", str(link)), (f"{real}/b", str(real)), (str(link), str(link))}


def test_deep_trees_are_read_to_their_end(spark):
    from winnow.plans.navigate import levels

    deep = ["/".join(["d"] * n) for n in range(1, 71)]
    entries = [(p, "directory", p.rpartition("/")[0]) for p in deep] + [(deep[-1] + "/f", "file", deep[-1])]
    df = spark.createDataFrame(entries, "path string, kind string, parent string")
    got = levels(df, df.select("path").selectExpr("path", "0.9D AS p"))
    assert got.count() == 71 and got.where("kind = 'file'").count() == 1
    assert {(r.path.count("/") + 1 == r.depth) for r in names.closure(df).collect()} == {True} and names.closure(df).count() == 71


def test_no_text_ends_a_worker(spark):
    from pyspark.sql import functions as F

    from winnow.functions import content
    from winnow.plans.search import snapshots

    texts = ["-----BEGIN " + "WORD " * 100_000, "-----BEGIN A B PRIVATE KEY-----", "-----BEGIN PRIVATE KEY PRIVATE KEY-----", "-----BEGIN  PRIVATE KEY-----", "-----BEGIN PRIVATE KEYS-----", " " * 1_000_000 + "a", "-----BEGIN " + "X" * 300_000]
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    got = [r[0] for r in df.orderBy("path").select(content.has_private_key(F.col("text"))).collect()]
    plain = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
    assert got == [bool(plain.search(t)) for t in texts] == [False, True, True, False, False, False, False]
    assert {r.path: r.status for r in snapshots(df).collect()} == {f"f{i}": "private_key" if k else "ok" for i, k in enumerate(got)}


def test_http_scorer(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from winnow.plans.scorers import HttpScorer

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            keys = list(body["questions"])
            mood = body["state"].get("mood")
            status = 500 if mood == "down" else 529 if mood == "busy" and len(keys) > 1 else 200
            self.send_response(status)
            self.send_header("retry-after", "0")
            self.end_headers()
            if status == 200:
                self.wfile.write(json.dumps({"model": "m", "answers": {k: {"type": "noul", "noul": 0.25} for k in keys}}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    busy = '{"mood": "busy", "items": [{"id": "n0", "path": "x"}, {"id": "n1", "path": "y"}, {"id": "n2", "path": "z"}]}'
    rows = [(1, '{"mood": "up"}', ["q0", "q1"], ["?", "?"]), (2, '{"mood": "down"}', ["q0"], ["?"]), (3, busy, ["q0", "q1", "q2"], ["?"] * 3)]
    df = spark.createDataFrame(rows, "batch long, state string, keys array<string>, questions array<string>")
    got = HttpScorer(f"http://127.0.0.1:{server.server_port}", "m").ask(df).collect()
    server.shutdown()
    assert sorted((r.batch, r.key, r.p, r.failure) for r in got) == [(1, "q0", 0.25, None), (1, "q1", 0.25, None), (2, "q0", None, "unavailable"), (3, "q0", 0.25, None), (3, "q1", 0.25, None), (3, "q2", 0.25, None)]
    # 3, then 2 and 1, then 1 and 1; those that stay overloaded are tried twice
    assert {b: sum(r.attempts for r in got if r.batch == b) for b in (1, 2, 3)} == {1: 1, 2: 1, 3: 7}
