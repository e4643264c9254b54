"""Scorers: what says how likely the answer to a question is yes.

A scorer takes a table of items (stage, path, kind, name, text and others) and gives it back with a
probability ``p`` (null: no answer). Stages: navigate, relate, relevance, scope, reference, ask. With
the items come the requests that would ask a model about them: batch, state, keys, questions; an
item's question is the one of its ``batch`` and ``key``. Scorers that ask nobody need not look at them.
"""

from __future__ import annotations

import json
import os
import threading
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.limits import LIMITS, Limits
from winnow.operators.pace import Pace
from winnow.plans import ledger
from winnow.plans.requests import Request, halves
from winnow.sources.store import written


class Scorer(Protocol):
    def score(self, items: DataFrame, requests: DataFrame | None = None) -> DataFrame: ...


class SqlScorer:
    """A column expression over the items' columns."""

    def __init__(self, p: Column):
        self.p = p

    def score(self, items: DataFrame, requests: DataFrame | None = None) -> DataFrame:
        return items.withColumn("p", self.p.cast("double"))


class LookupScorer:
    """Judgments (stage, path, name, p) joined to the items; what is not judged gets ``default``."""

    def __init__(self, judgments: DataFrame, default: float = 0.1):
        self.judgments, self.default = judgments, default

    def score(self, items: DataFrame, requests: DataFrame | None = None) -> DataFrame:
        return items.join(self.judgments, ["stage", "path", "name"], "left").withColumn("p", F.coalesce("p", F.lit(self.default)))


class Failed(Exception):
    def __init__(self, failure: str):
        super().__init__(failure)
        self.failure = failure


def no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key stands twice")
    return out


def parse_answers(body: str, keys: list[str]) -> list[float]:
    """Probabilities in the order of the keys; anything missing, extra, twice or out of range fails."""
    try:
        answers = json.loads(body, object_pairs_hook=no_repeats)["answers"]
        if set(answers) != set(keys):
            raise ValueError("not the asked keys")
        out = []
        for k in keys:
            p = answers[k]["noul"]
            if answers[k]["type"] != "noul" or isinstance(p, bool) or not isinstance(p, (int, float)) or not 0 <= p <= 1:
                raise ValueError("not a probability")
            out.append(float(p))
        return out
    except (ValueError, KeyError, TypeError):
        raise Failed("invalid_response") from None


@dataclass
class Meter:
    """What the attempts for one request came to."""

    attempts: int = 0
    input_tokens: int = 0
    output_tokens: int = 0
    model: str | None = None


def reported(body: str) -> tuple[int | None, int | None, str | None]:
    """Input and output tokens and the model that an answer names, as far as it does."""
    try:
        said = json.loads(body)
        usage = said.get("usage") or {}
        model = said.get("model")
        return usage.get("input_tokens"), usage.get("output_tokens"), model if isinstance(model, str) else None
    except (ValueError, AttributeError):
        return None, None, None


def estimated_tokens(size: int, questions: int, limits: Limits = LIMITS) -> int:
    return min(size + limits.token_base + limits.token_question * questions, limits.token_cap)


def post(url: str, body: str, key: str, limits: Limits = LIMITS, pace: Pace | None = None, tokens: int = 0, meter: Meter | None = None, deadline: float | None = None) -> str:
    """One request with its retry: 429 and 529 are tried once more after the told or usual wait.

    Each attempt waits for its place in ``pace``; a 429 makes all that share it wait. None begins
    after ``deadline`` (of pace's clock), and an attempt's own time ends there too.
    """
    pace, meter = pace or Pace(limits), meter or Meter()
    for attempt in range(limits.attempts):
        place = pace.admit(tokens, deadline)
        if place is None:
            raise Failed("timeout")
        meter.attempts += 1
        left = limits.attempt_seconds if deadline is None else min(limits.attempt_seconds, deadline - pace.now())
        request = urllib.request.Request(url, body.encode(), {"content-type": "application/json", "authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(request, timeout=left) as r:
                text = r.read().decode()
            used, made, model = reported(text)
            if isinstance(used, int):
                pace.correct(place, used)
                meter.input_tokens += used
            meter.output_tokens += made if isinstance(made, int) else 0
            meter.model = model or meter.model
            return text
        except urllib.error.HTTPError as e:
            if e.code in (401, 403):
                raise Failed("unauthorized") from None
            if e.code == 400 and b"max_tokens_exceeded" in e.read():
                raise Failed("too_large") from None
            if e.code not in (429, 529):
                raise Failed("unavailable") from None
            try:
                wait = float(e.headers.get("retry-after", ""))
            except ValueError:
                wait = -1.0
            wait = wait if 0 <= wait < limits.attempt_seconds else limits.retry_seconds
            if e.code == 429:
                pace.pause(wait)
            if attempt + 1 == limits.attempts or (deadline is not None and pace.now() + wait >= deadline):
                raise Failed("overloaded" if e.code == 529 else "unavailable") from None
            if e.code == 529:
                pace.sleep(wait)
        except TimeoutError:
            raise Failed("unavailable" if deadline is None or pace.now() < deadline else "timeout") from None
        except (urllib.error.URLError, OSError):
            raise Failed("unavailable") from None
    raise Failed("unavailable")


ANSWERS = "batch long, key string, p double, failure string, attempts long, input_tokens long, output_tokens long, model string"


class HttpScorer:
    """Asks a model endpoint; works wherever a scorer does.

    The key comes from the environment of the executors and is never in a column. At most
    ``concurrent`` requests are in flight: they are dealt to so many tasks or fewer, each of which asks
    with its share of threads, of the minute's requests and of the second's tokens. A request about
    several entries that fails as overloaded is asked again in halves, numbered anew. What is billed
    is written once. ``seconds``: how long one table of requests may take, null for no end. ``ledger``: a
    shared table where answers are committed slice by slice, so that no committed request is asked again
    by a lost task or a later run (see ``winnow.plans.ledger``).
    """

    def __init__(self, url: str, model: str, key_variable: str = "WINNOW_MODEL_KEY", limits: Limits = LIMITS, seconds: float | None = None, ledger: str | None = None):
        self.url, self.model, self.variable, self.limits, self.seconds, self.ledger = url, model, key_variable, limits, seconds, ledger

    def ask(self, requests: DataFrame) -> DataFrame:
        """A row for each key of each request (batch, state, keys, questions): see ``ANSWERS``. Attempts,
        tokens and model stand in a request's first row."""
        url, model, variable, limits, seconds = self.url, self.model, self.variable, self.limits, self.seconds
        number = requests.count()
        if not number:
            return requests.sparkSession.createDataFrame([], ANSWERS)
        tasks = max(1, min(limits.concurrent, number, requests.sparkSession.sparkContext.defaultParallelism))
        threads = max(1, limits.concurrent // tasks)

        def one(state: dict, keys: list[str], questions: list[str], secret: str, pace: Pace, meter: Meter, deadline: float | None) -> list[tuple[float | None, str | None]]:
            own = Request(state, list(zip(keys, questions, strict=True)))
            tokens = estimated_tokens(own.measured(), len(keys), limits)
            try:
                return [(p, None) for p in parse_answers(post(url, own.body(model), secret, limits, pace, tokens, meter, deadline), keys)]
            except Failed as e:
                if e.failure == "overloaded" and len(keys) > 1 and len(state.get("items") or ()) == len(keys):
                    return [x for half in halves(state, keys, questions) for x in one(*half, secret, pace, meter, deadline)]
                return [(None, e.failure)] * len(keys)

        def run(batches):
            secret = os.environ.get(variable, "")
            pace = Pace(limits, 1 / tasks)
            deadline = pace.now() + seconds if seconds is not None else None
            refused = threading.Event()

            def whole(r) -> list[tuple]:
                meter = Meter()
                got = [(None, "unauthorized")] * len(r.keys) if refused.is_set() else one(json.loads(r.state), list(r.keys), list(r.questions), secret, pace, meter, deadline)
                if any(f == "unauthorized" for _, f in got):
                    refused.set()  # no other request is sent with a key that was refused
                first = (meter.attempts, meter.input_tokens, meter.output_tokens, meter.model)
                return [(r.batch, k, p, f, *(first if i == 0 else (0, 0, 0, None))) for i, (k, (p, f)) in enumerate(zip(r.keys, got, strict=True))]

            with ThreadPoolExecutor(threads) as pool:
                for pdf in batches:
                    rows = [x for got in pool.map(whole, list(pdf.itertuples(index=False))) for x in got]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

        return requests.select("batch", "state", "keys", "questions").repartition(tasks).mapInPandas(run, ANSWERS)

    def score(self, items: DataFrame, requests: DataFrame | None = None) -> DataFrame:
        if requests is None:
            raise ValueError("a model is asked by requests")
        answers = written(self.ask(requests), "asked") if self.ledger is None else ledger.answered(requests, self.ask, self.ledger)
        return items.join(answers, ["batch", "key"], "left")
