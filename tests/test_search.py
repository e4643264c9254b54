import json
import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from winnow.limits import LIMITS
from winnow.operators import previews, sampled
from winnow.plans import ask, requests, search
from winnow.plans.scorers import Failed, HttpScorer, LookupScorer, SqlScorer, parse_answers

#: A tree of tide gauges: one directory that matters, one that does not, prose at the top.
TIDES = {
    "lib/tide/gauge.go": "package tide\n\nimport \"time\"\n\n// SEAL\nfunc Level(at time.Time) float64 { return 0 }\n\nvar zone = 3\n",
    "lib/tide/gauge_check.go": "package tide\n\nvar sample = 12\n",
    "lib/paint/brush.go": "package paint\n",
    "manual/tides.md": "# Tides\nWhen the water comes.\n",
    "NOTES.md": "notes\n",
}
PATHS = {"lib": 0.2, "lib/tide": 0.8, "lib/tide/gauge.go": 0.95, "lib/tide/gauge_check.go": 0.7}


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def case(column, values, default=0.05):
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def is_unit():
    return F.col("kind") == "unit"


def tide_scorer(units=None):
    own = case("name", units or {"Level": 0.9})
    unit = F.when(F.col("stage") == "relevance", own + 0.02).when(F.col("stage") == "scope", own).otherwise(0.0)
    return SqlScorer(F.when(is_unit(), unit).otherwise(case("path", PATHS)))


def found(f):
    files = [(r.path, round(r.score, 2)) for r in f.files.orderBy(F.col("score").desc(), "path").collect()]
    ranges = {}
    for r in f.ranges.orderBy("path", "rank").collect():
        ranges.setdefault(r.path, []).append((r.start_line, r.end_line, round(r.relevance, 2)))
    return files, ranges, f.summary.first().asDict()


def test_files_and_ranges(spark):
    files, ranges, summary = found(search.Search(table(spark, TIDES), "how high is the water?", tide_scorer()).run())
    assert files == [("lib/tide/gauge.go", 0.95), ("lib/tide/gauge_check.go", 0.7)]
    assert ranges == {"lib/tide/gauge.go": [(6, 6, 0.9)]}
    assert summary == {"files_considered": 4, "directories_pruned": 1, "files_skipped": 0, "matches_found": 2, "results_limited": False, "status": "complete"}


def test_limit_globs_and_reports(spark, tmp_path):
    own = search.Search(table(spark, TIDES), "how high?", tide_scorer(), exclude=["manual/**"])
    f = own.run(1)
    assert found(f)[2]["results_limited"] and found(f)[2]["matches_found"] == 2 and len(found(f)[0]) == 1
    search.write_report(f, f"file://{tmp_path}/report")
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert json.loads(text)["ranges"] == [{"start_line": 6, "end_line": 6, "relevance": 0.9}] and "SEAL" not in text
    with pytest.raises(Exception, match="(?i)exists"):
        search.write_report(f, f"file://{tmp_path}/report")
    whole = json.loads(search.whole_report(own, f, 1))
    assert whole["status"] == "complete" and whole["coverage"]["files_considered"] == 3 and whole["coverage"]["results_limited"]
    assert whole["matches"][0]["path"] == "lib/tide/gauge.go" and whole["matches"][0]["ranges"] == [{"start_line": 6, "end_line": 6, "relevance": 0.9}]
    assert "exclude pattern manual/**" in whole["exclusions"] and whole["constants"]["entries"] == 100_000 and whole["requests"] > 0 and whole["issues"] == []
    g = search.Search(table(spark, TIDES), "how high?", tide_scorer(), include=["**/*_check.go"], exclude=["manual/**"]).run()
    assert found(g)[2]["files_considered"] == 1
    with pytest.raises(ValueError):
        search.Search(table(spark, TIDES), " ", tide_scorer())


def test_stopped_searches_keep_what_they_have(spark):
    _, _, summary = found(search.Search(table(spark, TIDES), "?", tide_scorer(), cancelled=lambda: True).run())
    assert summary["status"] == "interrupted" and summary["matches_found"] == 0
    s = search.Search(table(spark, TIDES), "?", tide_scorer(), limits=replace(LIMITS, requests=2))
    files, ranges, summary = found(s.run())
    assert summary["status"] == "incomplete" and s.stop == "budget" and s.requests <= 2


def test_near_the_cap_what_fits_is_asked(spark):
    files = {f"a{i:02}.md": "x" * 900 for i in range(40)}
    s = search.Search(table(spark, files), "?", SqlScorer(F.lit(0.9)), limits=replace(LIMITS, navigation_bytes=6_000, requests=3))
    f = s.run(100)
    got = [p for p, _ in found(f)[0]]
    assert s.requests == 3 and s.stop == "budget" and 0 < len(got) < 40
    assert {r.path for r in f.issues.where("kind = 'budget'").collect()} >= set(files) - set(got)


def test_limit_of_entries(spark):
    files = {f"d{i}/e/f{k}.md": "x\n" for i in range(4) for k in range(5)}
    s = search.Search(table(spark, files), "?", SqlScorer(F.lit(0.9)), limits=replace(LIMITS, entries=8))
    f = s.run(100)
    assert s.listed == 8 and found(f)[2]["status"] == "incomplete"
    assert f.issues.where("kind = 'resource_limit'").count() > 0
    whole = search.Search(table(spark, files), "?", SqlScorer(F.lit(0.9))).run(100)
    assert found(whole)[2]["matches_found"] == 20 and found(whole)[2]["status"] == "complete"


LEDGER = "package tide\n\nfunc Flow() {\n\tEbb()\n}\n\nfunc Ebb() {}\n\nfunc Moon() {}\n"


def test_second_pass_adds_and_retracts(spark):
    first = case("name", {"Flow": 0.9, "Moon": 0.8})
    second = F.when((F.col("name") == "Flow") & F.col("stage").isin("relevance", "scope"), 0.85).when((F.col("name") == "Ebb") & (F.col("stage") == "reference"), 0.9).otherwise(0.05)

    class Scorer:
        def score(self, items, requests=None):
            if "second" not in items.columns:
                return items.withColumn("p", case("path", PATHS))
            return items.withColumn("p", F.when(F.col("second"), second).otherwise(first))

    _, ranges, summary = found(search.Search(table(spark, {"lib/tide/gauge.go": LEDGER}), "flow?", Scorer()).run())
    assert ranges["lib/tide/gauge.go"] == [(7, 7, 0.9), (3, 5, 0.85)] and summary["status"] == "complete"


KIN = {"sea/wave.py": "class Wave:\n    def move(self):\n        return 1\n", "shore/dunes/foam.py": "from sea.wave import Wave\n\n\nclass Foam(Wave):\n    def move(self):\n        return 2\n"}


def test_related_directory_is_found_again(spark):
    related = F.col("stage") == "relate"
    knows = F.col("text").contains("Foam(Wave)")
    p = F.when(is_unit(), 0.05).when(F.col("path").isin("sea", "sea/wave.py"), 0.9).when(related & knows, 0.7).otherwise(0.05)
    f, _, summary = found(search.Search(table(spark, KIN), "?", SqlScorer(p)).run())
    # only the samples of its file tell that the directory knows the class
    assert [x for x, _ in f] == ["sea/wave.py", "shore/dunes/foam.py"] and summary["directories_pruned"] == 1


def test_anchor_is_found_below_files_without_one(spark):
    files = {f"src/page{i}.md": "class x is meant\n" for i in range(9)}
    files |= {f"src/torn{i}.py": "class X(:\n" for i in range(9)} | {f"src/bare{i}.go": "package p // class\n" for i in range(3)}
    files |= {"src/zz.py": "import os\n\n\nclass Reef:\n    def run(self):\n        return 1\n", "src/long.py": "".join(f"class C{i:04}:\n    def f(self): pass\n" for i in range(600))}
    s = search.Search(table(spark, files), "?", SqlScorer(F.lit(0.1)))
    score = F.when(F.col("path") == "src/zz.py", 0.6).otherwise(0.9)
    candidates = s.files.select("path", score.alias("score"))
    assert s.anchor(candidates) == {"path": "src/zz.py", "classes": ["Reef"]}
    assert s.anchor(candidates.where("path <> 'src/zz.py'")) is None


class Server:
    """A model that answers by a function of the question and the state, and remembers what it was asked."""

    def __init__(self, answer, status=lambda body, n: 200):
        outer = self
        self.bodies, self.open, self.most, self.lock = [], 0, 0, threading.Lock()

        class Model(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["content-length"])))
                with outer.lock:
                    outer.bodies.append(body)
                    outer.open += 1
                    outer.most = max(outer.most, outer.open)
                    code = status(body, len(outer.bodies))
                self.send_response(code)
                self.send_header("retry-after", "0")
                self.end_headers()
                with outer.lock:
                    outer.open -= 1
                if code == 200:
                    said = {k: {"type": "noul", "noul": answer(q["instructions"], body["state"], k)} for k, q in body["questions"].items()}
                    self.wfile.write(json.dumps({"model": "tidal-1", "answers": said, "usage": {"input_tokens": 10, "output_tokens": 2}}).encode())

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.server.shutdown()


def by_path(question, state, key):
    if "declarations" in state:
        name = state["declarations"][int(key.lstrip("qscoperf"))]["name"]
        return 0.9 if name == "Level" and not key.startswith("ref") else 0.05
    return PATHS.get(state["items"][int(key[1:])]["path"], 0.05)


def test_search_asks_a_model(spark):
    with Server(by_path) as model:
        f = search.Search(table(spark, TIDES), "how high is the water?", HttpScorer(model.url, "m")).run()
        assert found(f)[0] == [("lib/tide/gauge.go", 0.95), ("lib/tide/gauge_check.go", 0.7)] and found(f)[1] == {"lib/tide/gauge.go": [(6, 6, 0.9)]}
        assert f.asked == {"requests": len(model.bodies), "input_tokens": 10 * len(model.bodies), "output_tokens": 2 * len(model.bodies), "model": "tidal-1"}
    first = [b for b in model.bodies if "items" in b["state"] and any(i["path"] == "lib" or i["path"] == "NOTES.md" for i in b["state"]["items"])]
    items = {i["path"]: i for b in first for i in b["state"]["items"]}
    assert items["lib/tide"]["childPreview"]["entries"] == [{"name": "gauge.go", "kind": "file"}, {"name": "gauge_check.go", "kind": "file"}] if "lib/tide" in items else True
    assert items["NOTES.md"]["filePreview"]["text"] == "notes\n"
    for b in model.bodies:
        want = requests.navigation("how high is the water?", [{k: v for k, v in i.items() if k != "id"} for i in b["state"]["items"]]) if "items" in b["state"] else None
        if want:
            assert b == json.loads(want.body("m"))
    units = [b for b in model.bodies if "declarations" in b["state"]]
    assert any("selectedEvidence" in b["state"] for b in units) and any("selectedEvidence" not in b["state"] for b in units)
    second = next(b for b in units if "selectedEvidence" in b["state"] and b["state"]["path"] == "lib/tide/gauge.go")
    assert "func Level" in second["state"]["selectedEvidence"][0]["source"] and {"q0", "scope0", "ref0"} <= set(second["questions"])
    assert second["state"]["source"] == TIDES["lib/tide/gauge.go"]


def test_related_pass_sends_anchor_and_samples(spark):
    def answer(question, state, key):
        if "declarations" in state:
            return 0.05
        item = state["items"][int(key[1:])]
        if "relationAnchor" in state:
            return 0.9 if state["relationAnchor"] == {"path": "sea/wave.py", "classes": ["Wave"]} and "Wave" in json.dumps(item) else 0.05
        return 0.9 if item["path"].startswith("sea") else 0.05

    with Server(answer) as model:
        f = search.Search(table(spark, KIN), "?", HttpScorer(model.url, "m")).run()
        assert [p for p, _ in found(f)[0]] == ["sea/wave.py", "shore/dunes/foam.py"]
    sampled_items = [i for b in model.bodies if "relationAnchor" in b["state"] for i in b["state"]["items"] if i["kind"] == "directory"]
    assert sampled_items[0]["childPreview"]["contentSamples"] == [{"name": "foam.py", "source": KIN["shore/dunes/foam.py"], "truncated": False}]


def test_failures_of_a_model(spark):
    def busy(body, n):
        if len(body["questions"]) > 2 and "items" in body["state"]:
            return 529  # only small requests pass
        return 500 if body["state"].get("path") == "lib/tide/gauge.go" else 200

    with Server(by_path, busy) as model:
        f = search.Search(table(spark, TIDES), "?", HttpScorer(model.url, "m")).run()
        files, ranges, summary = found(f)
        assert [p for p, _ in files] == ["lib/tide/gauge.go", "lib/tide/gauge_check.go"] and ranges == {} and summary["status"] == "incomplete"
        assert [(r.kind, r.code, r.path) for r in f.issues.collect()] == [("provider", "provider_unavailable", "lib/tide/gauge.go")]
    halves = [b["state"]["items"] for b in model.bodies if "items" in b["state"]]
    assert all([i["id"] for i in items] == [f"n{k}" for k in range(len(items))] for items in halves)
    with Server(by_path, lambda body, n: 401) as model:
        s = search.Search(table(spark, TIDES), "?", HttpScorer(model.url, "m"))
        assert found(s.run())[2]["status"] == "incomplete" and s.stop == "authentication" and len(model.bodies) <= 8
    late = HttpScorer("http://127.0.0.1:9", "m", seconds=0.0)
    one = spark.createDataFrame([(1, "{}", ["q0"], ["?"])], "batch long, state string, keys array<string>, questions array<string>")
    assert [(r.p, r.failure, r.attempts) for r in late.ask(one).collect()] == [(None, "timeout", 0)]


def test_at_most_so_many_in_flight(spark):
    rows = [(i, "{}", ["q0"], ["?"]) for i in range(60)]
    df = spark.createDataFrame(rows, "batch long, state string, keys array<string>, questions array<string>")
    with Server(lambda *a: 0.5) as model:
        out = HttpScorer(model.url, "m", limits=replace(LIMITS, concurrent=3)).ask(df).collect()
        assert len(out) == 60 and all(r.p == 0.5 for r in out) and model.most <= 3


def test_ask_sends_files_together(spark):
    files = spark.createDataFrame([(1, 0, "a", "i", "one"), (1, 1, "b", "j", "two")], "call long, ord long, path string, identity string, text string")
    with Server(lambda q, state, k: 0.75 if state["files"] == [{"path": "a", "content": "one"}, {"path": "b", "content": "two"}] and q == "Both?" else 0.25) as model:
        out = ask.ask(files, ["Both?", "Or?"], HttpScorer(model.url, "m", seconds=LIMITS.ask_seconds)).orderBy("ord").collect()
        assert [(r.question, r.p_yes) for r in out] == [("Both?", 0.75), ("Or?", 0.25)] and len(model.bodies) == 1


def test_files_too_large_for_a_request_are_judged_in_chunks(spark):
    text = "".join(f"line {i} of the log\n" for i in range(1500))
    limits = replace(LIMITS, navigation_bytes=16_000)
    seen = F.col("text").contains("line 1400 of")
    s = search.Search(table(spark, {"log.txt": text}), "?", SqlScorer(F.when(seen, 0.9).otherwise(0.05)), limits=limits)
    assert found(s.run())[0] == [("log.txt", 0.9)]
    pieces = sampled.chunk_previews("log.txt", text, limits)
    assert "".join(p["text"] for p in pieces) == text and all(p["previewBytes"] <= 12_000 and p["truncated"] for p in pieces)


def test_groups_are_halved_by_their_state(spark):
    text = "".join(f"func F{i}() {{\n{'// sea' * 20}\n}}\n" for i in range(60))
    evidence = [{"path": "e", "startLine": 1, "endLine": 2, "source": "x" * 3000}]
    limits = replace(LIMITS, state_bytes=12_000)
    files = table(spark, {"a.go": "package a\n" + text})
    plan = search.selection_plan(files, "?", evidence, limits).collect()
    states = [json.loads(r.state) for r in plan if r.state]
    assert len(states) > 1 and all(len(requests.dump(x).encode()) <= 12_000 or len(x["declarations"]) == 1 for x in states)
    one = search.selection_plan(files, "?", None).collect()
    names = lambda rows: [d["name"] for r in rows if r.state for d in json.loads(r.state)["declarations"]]
    assert names(plan) == names(one) and len({(r.batch, r.key) for r in plan}) == len(plan)
    assert {r.stage for r in plan} == {"relevance", "scope", "reference"} and {r.stage for r in one} == {"relevance", "scope"}


def test_previews(spark):
    long = "import os\n\n\n" + "".join(f"def wave_{i}(x):\n    return x + {i}\n\n\n" for i in range(900)) + "def crest(x):\n    return 'peak'\n"
    p = sampled.file_preview("sea.py", long, "where is crest?")
    assert p["truncated"] and p["range"] == "sampled source ranges" and "return 'peak'" in p["text"] and p["previewBytes"] <= 16_384
    assert p["declarations"][0]["name"] == "source" or p["declarations"][0]["name"] == "wave_0"
    assert p["declarationIndexTruncated"] and sampled.size(p) <= 32_000
    q = sampled.file_preview("sea.txt", "\"" * 20_000, "?")
    assert q["truncated"] and sampled.size(q["text"]) <= 24_000 and q["declarations"] == [] and q["extension"] == ".txt"
    assert not sampled.file_preview("a", "short", "?")["truncated"]
    entries = [(f"d/f{i:03}.go", "file", "d") for i in range(80)] + [("d", "directory", ""), ("x", "file", "")]
    df = spark.createDataFrame(entries, "path string, kind string, parent string")
    got = {r.path: json.loads(r.preview) for r in previews.directory_previews(df).collect()}
    assert got["d"]["truncated"] and got["d"]["sampledFiles"] == 64 and got["d"]["sampledExtensions"] == {".go": 64}
    assert got[""] == {"entries": [{"name": "d", "kind": "directory"}, {"name": "x", "kind": "file"}], "truncated": False, "sampledFiles": 1, "sampledDirectories": 1, "sampledExtensions": {"[no extension]": 1}}
    cut = sampled.with_samples({"entries": []}, [{"name": f"n{i}", "truncated": False, "source": "y" * 900} for i in range(60)])
    assert sampled.size(cut) <= 28_000 and all(s["truncated"] for s in cut["contentSamples"])


def test_request_keys_and_batches():
    d = [{"name": "f", "startLine": 1, "endLine": 2}]
    assert [k for k, _ in requests.evidence("q", "p", "s", d).questions] == ["q0", "scope0"]
    assert [k for k, _ in requests.evidence("q", "p", "s", d, []).questions] == ["q0", "scope0", "ref0"]
    ranged = requests.navigation("q", [{"path": "a.py", "kind": "file", "sourceRange": {"startLine": 3, "endLine": 9}}]).questions[0][1]
    assert ranged.startswith('Does source range 3-9 of "a.py" contain')
    items = [{"path": f"dir/file{i}.py", "kind": "file", "filePreview": {"source": "é\n" * (i * 37 % 900)}} for i in range(300)]
    got, dropped = requests.batches("why?", [*items, {"path": "big", "kind": "file", "filePreview": {"source": "x" * 40_000}}])
    want, batch = [], []
    for item in items:  # the measure itself, item by item
        if batch and (len(batch) >= 128 or requests.navigation("why?", [*batch, item]).measured() > 38_000):
            want.append(batch)
            batch = []
        batch.append(item)
    assert got == [*want, batch] and [x["path"] for x in dropped] == ["big"]


def test_answers():
    ok = '{"answers":{"a":{"type":"noul","noul":0.5},"b":{"type":"noul","noul":1}}}'
    assert parse_answers(ok, ["b", "a"]) == [1.0, 0.5]
    for bad in ("x", "{}", ok.replace("0.5", "1.5"), ok.replace('"noul","noul":1', '"other","noul":1'), '{"answers":{"a":{"type":"noul","noul":0.5},"a":{"type":"noul","noul":0.4},"b":{"type":"noul","noul":1}}}'):
        with pytest.raises(Failed):
            parse_answers(bad, ["a", "b"])
    for keys in (["a"], ["a", "b", "c"]):
        with pytest.raises(Failed):
            parse_answers(ok, keys)


def test_ask(spark):
    files = spark.createDataFrame([(1, 0, "alias", "i", "one"), (1, 1, "b", "j", "two"), (1, 2, "a", "i", "one"), (2, 0, "big", "k", "x" * 300_000)], "call long, ord long, path string, identity string, text string")
    assert [(r.call, r.path) for r in ask.sources(files).orderBy("call", "ord").collect()] == [(1, "alias"), (1, "b")]
    judgments = spark.createDataFrame([("ask", "1", "Same?", 0.25)], "stage string, path string, name string, p double")
    out = ask.ask(files, ["Same?", "Other", "Same?"], LookupScorer(judgments)).orderBy("call", "ord").collect()
    assert [(r.call, r.ord, r.question, r.p_yes, r.error) for r in out] == [(1, 0, "Same?", 0.25, None), (1, 1, "Other", 0.1, None), (1, 2, "Same?", 0.25, None)] + [(2, i, q, None, "input_too_large") for i, q in enumerate(["Same?", "Other", "Same?"])]
    assert "two" not in ask.record(files, ask.ask(files, ["Same?"], LookupScorer(judgments))).where("call = 1").first().json
    for bad in ([], [" "], ["x" * 3000], ["q"] * 65):
        with pytest.raises(ValueError):
            ask.ask(files, bad, LookupScorer(judgments))
