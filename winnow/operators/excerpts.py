"""Excerpts around selected ranges, grown over the comments that touch them."""

from __future__ import annotations

from winnow.limits import LIMITS, Limits
from winnow.operators.units import Lines

Span = tuple[int, int]


def merge(spans: list[Span]) -> list[Span]:
    """Overlapping and touching spans joined; empty ones go."""
    out: list[Span] = []
    for a, b in sorted(s for s in spans if s[1] > s[0]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def grow(lines: Lines, window: Span, comments: list[Span]) -> Span:
    """A window of lines with all comments that overlap it or have only blank lines between."""

    def blank(a: int, b: int) -> bool:
        return all(not lines.text(i, i).strip() for i in range(a, b + 1))

    while True:
        a, b = window
        for s, e in comments:
            touches = s <= b and e >= a
            if touches or (e < a and blank(e + 1, a - 1)) or (s > b and blank(b + 1, s - 1)):
                a, b = min(a, s), max(b, e)
        if (a, b) == window:
            return window
        window = (a, b)


def excerpts(text: str, ranges: list[Span], comments: list[Span], chosen: list[Span] = (), limits: Limits = LIMITS) -> list[tuple[int, int, str]]:
    """(start_line, end_line, source) of the windows around line ranges.

    A giant line is shown only where a chosen byte span covers it.
    """
    lines = Lines(text)
    last, spans, reaches_end = len(lines), [], False
    for a, b in ranges:
        a, b = grow(lines, (max(1, a - limits.window_lines), min(last, b + limits.window_lines)), comments)
        reaches_end |= b == last
        at = lines.start(a)
        for i in range(a, b + 1):
            s, e = lines.start(i), lines.end(i)
            if e - s > limits.unit_bytes:
                spans.append((at, s))
                spans += [(max(s, x), min(e, y)) for x, y in chosen if x < e and y > s]
                at = e
        spans.append((at, lines.end(b)))
    out = []
    for a, b in merge(spans):
        first, final = lines.at(a), lines.at(b - 1)
        if lines.start(first) == a and lines.end(final) == b:
            final = last if b == len(lines.raw) and reaches_end else final
            out.append((first, final, lines.text(first, final)))
        else:
            out.append((first, final, lines.raw[a:b].decode()))
    return out
