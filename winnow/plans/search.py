"""Relevance search over a collection of text files.

Rounds of listing and judging explore the tree from the root; files that score above the threshold
are candidates; a related class can bring pruned directories back; the candidates' declarations are
judged twice, the second time with the evidence of the first. Everything between two judgments is a
table, written once, since a judgment may cost money.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from winnow.functions import content as C
from winnow.functions import paths as P
from winnow.limits import LIMITS, Limits
from winnow.operators import bookkeeping, excerpts, grouping, languages, names, previews, ranking, sampled, units
from winnow.plans import requests
from winnow.plans.requests import dump
from winnow.plans.scorers import Scorer
from winnow.plans.watch import Stopped, Watch
from winnow.sources.store import discard, written

def joined(parts: list[DataFrame]) -> DataFrame:
    """Tables of the same columns in the same order as one."""
    return functools.reduce(DataFrame.union, parts)


UNITS = "path string, ord long, name string, start_line long, end_line long, byte_start long, byte_end long, source string"


def snapshots(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """path, text, sha256, bytes, status of files given as path and text."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    return files.select("path", text.alias("text"), F.sha2(text, 256).alias("sha256"), size.alias("bytes"), C.read_status(text, F.is_valid_utf8(text.cast("binary")), size, limits.file_bytes).alias("status"))


def selection_units(path: str, text: str, limits: Limits = LIMITS) -> list[units.Unit]:
    """The units that are judged: declarations, or small pieces where there are none; units over the
    bound in blocks of lines. A file with a giant line keeps byte-bounded units."""
    lines = units.Lines(text)
    giant = any(lines.end(i) - lines.start(i) > limits.unit_bytes + 1 for i in range(1, len(lines) + 1))
    found = languages.inspect(path, text, limits.unit_bytes if giant else max(limits.unit_bytes, len(lines.raw)), limits.inspected_bytes)
    if giant:
        return found.units
    own = found.units
    if found.mode == "text" or all(u.partial for u in own):
        own = units.split_source(text, limits.fallback_unit_bytes)
        for u in own:
            u.end_line = lines.at(max(u.byte_start, u.byte_end - 1))
    out = []
    for u in own:
        if len(lines.text(u.start_line, u.end_line).encode()) <= limits.unit_bytes:
            out.append(u)
            continue
        for a in range(u.start_line, u.end_line + 1, limits.block_lines):
            b = min(u.end_line, a + limits.block_lines - 1)
            out.append(units.Unit(u.name, a, b, lines.start(a), lines.end(b), True, u.headers))
    return out


def unit_table(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The units of each file (path, text), with their source."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            raw = row["text"].encode()
            for i, u in enumerate(selection_units(row["path"], row["text"], limits)):
                yield (row["path"], i, u.name, u.start_line, u.end_line, u.byte_start, u.byte_end, raw[u.byte_start : u.byte_end].decode("utf-8", "replace"))

    return mapped(files.select("path", "text"), UNITS, run)


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mapped(df: DataFrame, schema: str, run: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """Rows as dicts through a generator of tuples, in Arrow batches."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in run(r for batch in found for r in batch.to_pylist()):
            rows.append(row)
            held += sum(len(x) for x in row if isinstance(x, str))
            if len(rows) >= 4096 or held > 1 << 22:
                yield arrow_rows(rows, arrow)
                rows, held = [], 0
        if rows:
            yield arrow_rows(rows, arrow)

    return df.mapInArrow(batches, schema)


def evidence_table(chosen: DataFrame, files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """path, start_line, end_line, source of the excerpts around a file's chosen ranges; of Python
    methods their neighbours' too."""
    per = chosen.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "byte_start", "byte_end"))).alias("r"))

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            path, text = row["path"], row["text"]
            comments = languages.inspect(path, text, max(limits.unit_bytes, len(text.encode()))).comments
            ranges = [(d["start_line"], d["end_line"]) for d in row["r"]]
            if languages.mode_of(path) == "python":
                ranges += languages.python_neighbours(text, ranges)
            for x in excerpts.excerpts(text, ranges, comments, [(d["byte_start"], d["byte_end"]) for d in row["r"]], limits):
                yield (path, *x)

    return mapped(files.join(per, "path").select("path", "text", "r"), "path string, start_line long, end_line long, source string", run)


PLANNED = "stage string, path string, kind string, name string, text string, ord long, batch long, key string, state string, keys array<string>, questions array<string>"


def navigation_plan(items: DataFrame, query: str, stage: str, anchor: dict | None, limits: Limits = LIMITS) -> DataFrame:
    """The items (path, kind, text, preview, samples) as they are asked about, with their requests.

    Items of neighbouring paths share greedy batches. A file whose preview no request holds is asked
    about in chunks of its text; what no request holds at all has no batch. A request's state, keys
    and questions stand in the row of its first item.
    """

    def of(row: dict) -> dict:
        if row["kind"] == "file":
            return {"path": row["path"], "kind": "file", "filePreview": sampled.file_preview(row["path"], row["text"], query, limits)}
        preview = json.loads(row["preview"]) if row["preview"] else {"entries": [], "truncated": False, "sampledFiles": 0, "sampledDirectories": 0, "sampledExtensions": {}}
        if row["samples"] is not None:
            preview = sampled.with_samples(preview, row["samples"], limits)
        return {"path": row["path"], "kind": "directory", "childPreview": preview}

    def shown(item: dict) -> str:
        return item["filePreview"]["text"] if item["kind"] == "file" else dump(item["childPreview"])

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        own, number = requests.Batches(query, anchor, limits), TaskContext.get().partitionId() << 32

        def sent(batch: list[dict]) -> Iterator[tuple]:
            nonlocal number
            request = requests.navigation(query, batch, anchor)
            for i, item in enumerate(batch):
                first = (dump(request.state), [k for k, _ in request.questions], [q for _, q in request.questions]) if i == 0 else (None, None, None)
                yield (stage, item["path"], item["kind"], "", shown(item), 0, number, f"q{i}", *first)
            number += 1

        for row in rows:
            item = of(row)
            todo = [item]
            if not own.fits_alone(item) and item["kind"] == "file" and item["filePreview"]["sizeBytes"] <= limits.inspected_bytes:
                todo = [{"path": item["path"], "kind": "file", "filePreview": p} for p in sampled.chunk_previews(row["path"], row["text"], limits)]
            for x in todo:
                if not own.fits_alone(x):
                    yield (stage, x["path"], x["kind"], "", shown(x), 0, None, None, None, None, None)
                elif full := own.add(x):
                    yield from sent(full)
        if own.batch:
            yield from sent(own.batch)

    return mapped(items.repartitionByRange("path").sortWithinPartitions("path"), PLANNED, run)


def selection_plan(files: DataFrame, query: str, evidence: list[dict] | None, limits: Limits = LIMITS) -> DataFrame:
    """The units of files (path, text) as they are asked about, with a request for each group of units.

    A group whose state, evidence included, is too large is halved. Each unit is asked for its
    relevance and scope, and with evidence whether that refers to it.
    """
    stages = ["relevance", "scope", *(["reference"] if evidence is not None else [])]
    names = {"relevance": "q", "scope": "scope", "reference": "ref"}

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        number = TaskContext.get().partitionId() << 32
        for row in rows:
            path, lines = row["path"], units.Lines(row["text"])
            own = selection_units(path, row["text"], limits)
            place = {id(u): i for i, u in enumerate(own)}

            def request(group, path=path, lines=lines):
                said = [{"name": u.name, "startLine": u.start_line, "endLine": u.end_line} for u in group]
                return requests.evidence(query, path, grouping.context(lines, group, limits), said, evidence)

            for whole in grouping.groups(own, lines, limits):
                for group in grouping.halved(whole, lambda g: len(dump(request(g).state).encode()) > limits.state_bytes):
                    r = request(group)
                    first = (dump(r.state), [k for k, _ in r.questions], [q for _, q in r.questions])
                    for stage in stages:
                        for i, u in enumerate(group):
                            source = lines.raw[u.byte_start : u.byte_end].decode("utf-8", "replace")
                            yield (stage, path, "unit", u.name, source, place[id(u)], number, f"{names[stage]}{i}", *first)
                            first = (None, None, None)
                    number += 1

    return mapped(files.select("path", "text"), PLANNED, run)


@dataclass
class Found:
    """files: path, score, sha256; ranges: path, start_line, end_line, relevance, rank (no source
    text in either); issues: kind, code, path; summary: one row of counts; asked: requests, tokens and
    the model that answered, as far as the scorer tells. Of a search that was stopped these are plans
    over what it had written; else files, ranges and issues are tables."""

    files: DataFrame
    ranges: DataFrame
    issues: DataFrame
    summary: DataFrame
    asked: dict


class Search:
    """A search over files (path, text). It ends when ``cancelled`` says so or, with ``seconds``, so long
    after it was made, in the middle of a job too, with a result of what was written so far: the files of
    whole rounds, the ranges of a whole pass, and an issue for each entry that was listed and not judged.
    """

    def __init__(self, files: DataFrame, question: str, scorer: Scorer, include: list[str] = (), exclude: list[str] = (), limits: Limits = LIMITS, cancelled: Callable[[], bool] = lambda: False, seconds: float | None = None):
        if not question.strip():
            raise ValueError("the question is empty")
        self.question, self.scorer, self.limits = question, scorer, limits
        self.watch = Watch(files.sparkSession, seconds, cancelled)
        self.include, self.exclude = list(include), list(exclude)
        self.requests, self.listed, self.stop, self.unopened = 0, 0, None, None
        self.asked = {"requests": 0, "input_tokens": 0, "output_tokens": 0, "model": None}
        self.spark = files.sparkSession
        # what is known so far: judged files and directories of each round, a round that is not judged yet, units and their scores
        self.judged: list[DataFrame] = []
        self.folders: list[DataFrame] = []
        self.pending = self.pruned = self.candidates = self.units = self.first = self.second = None
        try:
            with self.watch.over():
                self._read(files)
        except Stopped:
            self.stop = "cancelled"
            empty = lambda schema: self.spark.createDataFrame([], schema)
            self.snapshots = empty("path string, text string, sha256 string, bytes long, status string")
            self.files = self.skipped = self.snapshots
            self.entries, self.previews = empty("path string, kind string, parent string"), empty("path string, preview string")

    def _read(self, files: DataFrame) -> None:
        limits = self.limits
        # names are tested before any content is read; a directory's reason holds for all below it
        above = F.exists(P.ancestors(F.col("path")), lambda d: names.directory_reason(d, self.exclude).isNotNull())
        kept = files.where(~above & names.file_reason(F.col("path"), self.include, self.exclude).isNull())
        self.snapshots = written(snapshots(kept, limits), "snapshots")
        self.files = self.snapshots.where("status = 'ok'")
        leaves = self.files.select(P.parent(F.col("path")).alias("d")).distinct()
        dirs = leaves.select(F.explode(F.concat(P.ancestors(F.col("d")), F.array("d"))).alias("path")).where("path <> ''").distinct()
        self.skipped = self.snapshots.where(F.col("status").isin("size_limit", "encoding", "unreadable", "changed"))
        self.entries = written(self.files.select("path", F.lit("file").alias("kind")).unionByName(dirs.select("path", F.lit("directory").alias("kind"))).select("path", "kind", P.parent(F.col("path")).alias("parent")), "entries")
        self.previews = written(previews.directory_previews(self.entries, limits), "previews")

    def judge(self, planned: DataFrame) -> DataFrame:
        """Planned items with p in place of what is shown of them, evaluated once; what is not asked about
        has none.

        A search near its cap of requests asks as many as it has left, in the order of their paths, and
        no more after them.
        """
        planned = written(planned, "planned")
        whole = planned.where("state IS NOT NULL").select("batch", "state", "keys", "questions")
        items = planned.drop("state", "keys", "questions")
        self.watch.check()
        left = 0 if self.stop else max(0, self.limits.requests - self.requests)
        wanted = 0 if self.stop else whole.count()
        if wanted > left:
            self.stop = "budget"
            whole = written(whole.orderBy("batch").limit(left), "last-requests")
        kept = [c for c in items.columns if c != "text"]
        if not min(left, wanted):
            return items.select(*kept, F.lit(None).cast("double").alias("p"))
        asked = items.join(whole.select("batch"), "batch", "left_semi")
        judged = written(self.scorer.score(asked, whole).drop("text"), "judged")
        self._count(judged, min(wanted, left))
        rest = items.where("batch IS NULL").unionByName(items.where("batch IS NOT NULL").join(whole.select("batch"), "batch", "left_anti"))
        rest = written(rest.select(*kept, F.lit(None).cast("double").alias("p")), "unasked")
        discard(planned)  # what was shown goes with it
        return judged.select(*kept, "p").unionByName(rest)

    def _count(self, judged: DataFrame, sent: int) -> None:
        """Attempts as the scorer counts them, retries among them; else the requests."""
        if "attempts" not in judged.columns:
            self.requests += sent
            self.asked["requests"] += sent
            return
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        r = judged.agg(total("attempts"), total("input_tokens"), total("output_tokens"), F.max("model").alias("model"), F.max((F.col("failure") == "unauthorized").cast("int")).alias("refused")).first()
        self.requests += r.attempts
        self.asked["requests"] += r.attempts
        self.asked["input_tokens"] += r.input_tokens
        self.asked["output_tokens"] += r.output_tokens
        self.asked["model"] = r.model or self.asked["model"]
        if r.refused and self.stop is None:
            self.stop = "authentication"

    def items(self, paths: DataFrame, stage: str, anchor: dict | None = None, samples: bool = False) -> DataFrame:
        """Entries (path, kind) as they are asked about: files by their previews, directories by what
        stands in them and, with ``samples``, by parts of their files."""
        # as many paths as the limit of entries lets a round list go to where the texts are; of more, both sides are shuffled
        sent = F.broadcast if paths.count() <= self.limits.entries else (lambda df: df)
        texts = self.files.select("path", "text").join(sent(paths.where("kind = 'file'")), "path")
        folders = paths.where("kind = 'directory'").join(self.previews, "path")  # one that has no preview is left alone
        shown = texts.unionByName(folders, allowMissingColumns=True)
        if samples:
            shown = shown.join(previews.directory_samples(self.entries, self.files, self.limits), "path", "left")
        else:
            shown = shown.withColumn("samples", F.lit(None).cast("array<struct<name:string,truncated:boolean,source:string>>"))
        return navigation_plan(shown.select("path", "kind", "text", "preview", "samples"), self.question, stage, anchor, self.limits)

    def _leave(self, directories: DataFrame) -> None:
        self.unopened = directories if self.unopened is None else self.unopened.unionByName(directories)

    def discover(self, seeds: DataFrame, stage: str, files: list[DataFrame], dirs: list[DataFrame], anchor: dict | None = None) -> None:
        """Adds the judged files and directories below the seeds (path), which are opened unjudged, to
        ``files`` and ``dirs``, round by round.

        A round opens the seeds and the directories in them, judges all files listed so and the
        directories one level further, and takes those above the threshold as the next seeds. At the
        limit of entries the last round is cut by path; directories left over, or not read to their end,
        are ``unopened``.
        """
        entries = self.entries
        while True:
            first = entries.join(seeds.select(F.col("path").alias("parent")), "parent", "left_semi")
            children = first.where("kind = 'directory'").select(F.col("path").alias("parent"))
            second = entries.join(children, "parent", "left_semi")
            listed = written(first.where("kind = 'file'").unionByName(second).select("path", "kind"), "listed")
            number = listed.count()
            if number > (left := max(0, self.limits.entries - self.listed)):
                whole, listed = listed, written(listed.orderBy("path").limit(left), "listed")
                self._leave(whole.join(listed, "path", "left_anti").select(P.parent(F.col("path")).alias("path")).distinct())
            self.listed += min(number, left)
            self.pending = listed
            judged = self.judge(self.items(listed, stage, anchor))
            # a file in chunks is as good as its best chunk
            best = written(judged.groupBy("path", "kind").agg(F.max("p").alias("p"), F.max(F.col("batch").isNull()).alias("too_large")), "best")
            files.append(best.where("kind = 'file'"))
            dirs.append(best.where("kind = 'directory'"))
            self.pending = None
            seeds = dirs[-1].where(F.col("p") > self.limits.threshold).select("path")
            if seeds.isEmpty():
                break
            if self.listed >= self.limits.entries:
                self._leave(seeds)
                break

    def anchor(self, candidates: DataFrame) -> dict | None:
        """The best candidate that declares a class, and its classes; all candidates are tried."""
        coded = candidates.where(F.substring_index("path", ".", -1).isin(*languages.EXTENSIONS))
        texts = coded.join(self.files.select("path", "text"), "path").select("path", F.col("score").cast("double").alias("score"), "text")
        most = self.limits.anchor_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for path, score, text in zip(*(batch.column(c).to_pylist() for c in ("path", "score", "text")), strict=True):
                    size = max(4, len(text.encode()))
                    own = languages.inspect(path, text, size, size).units if languages.mode_of(path) != "text" else []
                    classes = list(dict.fromkeys(u.name.removesuffix(".context").split(".")[0] for u in own if u.name.endswith(".context") or "." in u.name))
                    if classes and len(dump(classes).encode()) < most:
                        rows.append((path, score, classes))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
                types = [pa.string(), pa.float64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "score", "classes"])

        found = texts.mapInArrow(run, "path string, score double, classes array<string>")
        best = found.orderBy(F.col("score").desc(), "path").first()
        return {"path": best.path, "classes": list(best.classes)} if best else None

    def decide(self, files: DataFrame, evidence: list[dict] | None) -> DataFrame:
        """path, ord and the score of each unit in one pass over files (path, text)."""
        plan = selection_plan(files, self.question, evidence, self.limits)
        got = self.judge(plan.withColumn("second", F.lit(evidence is not None)))
        p = lambda s: F.max(F.when(F.col("stage") == s, F.col("p")))
        wide = got.groupBy("path", "ord").agg(p("relevance").alias("r"), p("scope").alias("s"), p("reference").alias("f"))
        whole = F.col("r").isNotNull() & F.col("s").isNotNull() & (F.lit(evidence is None) | F.col("f").isNotNull())
        return wide.select("path", "ord", F.when(whole, ranking.combine(F.col("r"), F.col("s"), F.coalesce("f", F.lit(0.0)))).alias("relevance"))

    def run(self, limit: int | None = None) -> Found:
        limit = self.limits.default_results if limit is None else limit
        if not 1 <= limit <= self.limits.most_results:
            raise ValueError(f"limit must be 1 to {self.limits.most_results}")
        try:
            with self.watch.over():
                self._explore()
                self._select()
                return self._finish(limit, written)
        except Stopped:
            self.stop = "cancelled"
        return self._finish(limit, lambda df, _: df)

    def _best(self, files: list[DataFrame]) -> DataFrame:
        """path and score of the files above the threshold; one that was judged twice has its best score."""
        over = joined(files).where(F.col("p") > self.limits.threshold)
        return ranking.best(over.withColumn("score", F.col("p")), ["path"], "score")

    def _explore(self) -> None:
        threshold = self.limits.threshold
        self.discover(self.spark.createDataFrame([("",)], "path string"), "navigate", self.judged, self.folders)
        self.pruned = joined(self.folders).where(F.col("p") <= threshold).select("path")
        self.candidates = written(self._best(self.judged), "candidates")
        anchor = None if self.pruned.isEmpty() else self.anchor(self.candidates)
        if not anchor:
            return
        again = self.judge(self.items(self.pruned.withColumn("kind", F.lit("directory")), "relate", anchor, samples=True))
        related = written(again.where(F.col("p") > threshold).select("path"), "related")
        if not related.isEmpty():
            self.discover(related, "relate", self.judged, [], anchor)
            self.candidates = written(self._best(self.judged), "candidates")

    def _chosen(self, candidates: DataFrame) -> DataFrame:
        return self.files.select("path", "text", "sha256", "bytes").join(F.broadcast(candidates), "path")

    def _select(self) -> None:
        limits = self.limits
        inspectable = self._chosen(self.candidates).where(F.col("bytes") <= limits.inspected_bytes)
        self.units = written(unit_table(inspectable, limits).drop("source"), "units")
        self.first = written(self.decide(inspectable, None), "first-pass")
        picked = self.units.join(self.first.where(F.col("relevance") > limits.threshold), ["path", "ord"])
        shown = written(evidence_table(picked, inspectable, limits), "evidence")
        # the evidence must fit one request; its size is one sum
        one = F.struct("path", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "source")
        total = shown.agg(F.coalesce(F.sum(F.octet_length(F.to_json(one)) + 1), F.lit(-1)).alias("n")).first().n + 1
        if 0 < total <= limits.evidence_bytes and not self.stop:
            evidence = [{"path": r.path, "startLine": r.start_line, "endLine": r.end_line, "source": r.source} for r in shown.orderBy("path", "start_line").collect()]  # bounded by the test above
            self.second = written(self.decide(inspectable, evidence), "second-pass")

    def _finish(self, limit: int, kept: Callable[[DataFrame, str], DataFrame]) -> Found:
        """The result of what is known, its parts by way of ``kept``."""
        limits = self.limits
        judged, folders = list(self.judged), list(self.folders)
        if self.pending is not None:
            unjudged = self.pending.selectExpr("path", "kind", "CAST(NULL AS DOUBLE) AS p", "false AS too_large")
            judged.append(unjudged.where("kind = 'file'"))
            folders.append(unjudged.where("kind = 'directory'"))
        if not judged:
            judged = folders = [self.spark.createDataFrame([], "path string, kind string, p double, too_large boolean")]
        files, dirs = joined(judged), joined(folders)
        candidates = self.candidates if self.stop != "cancelled" else self._best([files])
        pruned = dirs.where(F.col("p") <= limits.threshold) if self.pruned is None else self.pruned
        chosen = self._chosen(candidates)
        top = ranking.top_files(chosen.select("path", "score", "sha256"), limit)
        if self.first is None:
            ranked = self.spark.createDataFrame([], "path string, start_line long, end_line long, relevance double, rank long")
            unread = chosen.where(F.col("bytes") <= limits.inspected_bytes)
        else:
            decisions = self.first.withColumn("pass", F.lit(1))
            if self.second is not None:
                again = self.second.where("relevance IS NOT NULL").withColumn("pass", F.lit(2))
                decisions = ranking.latest(decisions.unionByName(again), ["path", "ord"], "pass", "relevance")
            ranges = self.units.join(decisions, ["path", "ord"]).where(F.col("relevance") > limits.threshold)
            ranked = ranking.ranked_ranges(ranges.select("path", "start_line", "end_line", "relevance"))
            ranked = kept(ranked.join(top.select("path"), "path", "left_semi"), "ranges")
            unread = self.first.where("relevance IS NULL").select("path").distinct()
        missing = {"cancelled": ("cancelled", "cancelled"), "budget": ("budget", "budget_exhausted"), "authentication": ("authentication", "provider_unavailable")}.get(self.stop, ("provider", "provider_unavailable"))
        told = lambda df, kind, code: df.selectExpr(f"{kind} AS kind", f"{code} AS code", "path")
        parts = [
            told(self.snapshots.where("status IN ('size_limit', 'encoding')"), "status", "IF(status = 'encoding', 'unsupported_encoding', 'input_too_large')"),
            told(chosen.where(F.col("bytes") > limits.inspected_bytes), "'inspection_limit'", "'input_too_large'"),
            told(files.union(dirs).where("p IS NULL"), f"IF(too_large, 'request_size', '{missing[0]}')", f"IF(too_large, 'input_too_large', '{missing[1]}')"),
            told(unread, f"'{missing[0]}'", f"'{missing[1]}'"),
        ]
        if self.unopened is not None:
            parts.append(told(self.unopened, "'resource_limit'", "'input_too_large'"))
        issues = kept(joined(parts), "issues")
        # all counts by one pass
        counted = joined([df.selectExpr(f"'{what}' AS what", "path") for what, df in (("file", files), ("pruned", pruned), ("skipped", self.skipped), ("match", candidates), ("issue", issues))])
        number = lambda what: F.count_if(F.col("what") == what)
        summary = counted.agg(
            F.count_distinct(F.expr("IF(what = 'file', path, NULL)")).alias("files_considered"), number("pruned").alias("directories_pruned"), number("skipped").alias("files_skipped"),
            number("match").alias("matches_found"), (number("match") > limit).alias("results_limited"),
            bookkeeping.status(number("issue") + int(self.stop is not None), F.lit(int(self.stop == "cancelled"))).alias("status"),
        )
        return Found(kept(top, "files"), ranked, issues, summary, dict(self.asked))


def report(found: Found, limits: Limits = LIMITS) -> DataFrame:
    """One row of JSON for each file with its best ranges, as it is shown; never source text."""
    shown = found.ranges.where(F.col("rank") <= limits.ranges_shown)
    wide = ranking.with_selections(found.files, shown)
    brief = F.transform("ranges", lambda r: F.struct(r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), r["relevance"].alias("relevance")))
    return wide.select("path", F.to_json(F.struct("path", "score", "sha256", brief.alias("ranges"))).alias("json"))


def whole_report(search: Search, found: Found, limit: int | None = None) -> str:
    """One JSON text of a search: matches (of which there are at most ``most_results``) with all that is
    known of its course; never source text."""
    limits = search.limits
    best = {}
    for r in found.ranges.where(F.col("rank") <= limits.ranges_shown).orderBy("path", "rank").collect():
        best.setdefault(r.path, []).append({"start_line": r.start_line, "end_line": r.end_line, "relevance": r.relevance})
    matches = [{"path": r.path, "relevance": r.score, "sha256": r.sha256, "ranges": best.get(r.path, [])} for r in found.files.orderBy(F.col("score").desc(), "path").collect()]
    counts = found.summary.first().asDict()
    issues = [r.asDict() for r in bookkeeping.issue_counts(found.issues).withColumnRenamed("n", "count").orderBy("kind", "code").collect()]
    return dump({
        "question": search.question, "include": search.include, "exclude": search.exclude, "limit": limits.default_results if limit is None else limit,
        "status": counts.pop("status"), "model": found.asked["model"], "matches": matches, "coverage": counts, "issues": issues,
        "exclusions": [*names.EXCLUSIONS, *(f"exclude pattern {p}" for p in search.exclude)], "constants": asdict(limits),
        "usage": {k: found.asked[k] for k in ("input_tokens", "output_tokens")}, "requests": found.asked["requests"],
    })


def write_report(found: Found, path: str) -> None:
    """Create a report; an existing one is never replaced."""
    report(found).select("json").write.mode("errorifexists").text(path)


__all__ = ["Found", "Search", "dump", "report", "whole_report", "write_report"]
