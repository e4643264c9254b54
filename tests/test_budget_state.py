"""What the rate budget asks of its state for each search."""

from types import SimpleNamespace

import pandas as pd

from winnow.limits import LIMITS
from winnow.streaming.budget import Budget


class Held:
    def __init__(self, calls, rows):
        self.calls, self.rows = calls, rows

    def exists(self):
        self.calls.append("exists")
        return bool(self.rows)

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = rows


def run(held, timers, frames):
    calls = []
    note = lambda name, out=None: lambda *a: calls.append(name) or out
    state = Held(calls, held)
    handle = SimpleNamespace(getListState=lambda *a: state, listTimers=note("list", iter(timers)), deleteTimer=note("delete"), registerTimer=note("register"))
    budget = Budget(LIMITS)
    budget.init(handle)
    out = pd.concat(budget.handleInputRows((7,), iter(frames), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    return out, state.rows, calls


def frame(*rows):
    return pd.DataFrame([(7, i, pd.Timestamp(t, unit="us"), n) for i, t, n in rows], columns=["search", "event_id", "ts", "tokens"])


def test_a_new_search_takes_three_calls_of_state():
    out, held, calls = run([], [], [frame((3, 2_000_000, 5), (1, 1_000_000, 4)), frame((2, 1_000_000, 6))])
    assert calls == ["get", "put", "register"]
    assert out[["search", "event_id", "requests", "window_tokens"]].values.tolist() == [[7, 1, 1, 4], [7, 2, 2, 10], [7, 3, 3, 5]]
    assert held == [(1_000_000, 4), (1_000_000, 6), (2_000_000, 5)]


def test_a_known_search_moves_its_timer():
    out, held, calls = run([(1_000_000, 4)], [61_001], [frame((9, 61_000_000, 1))])
    assert calls == ["get", "list", "delete", "put", "register"] and out.requests.tolist() == [1] and held == [(61_000_000, 1)]
