"""Cutting texts into units of bounded bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.limits import LIMITS


@dataclass
class Unit:
    name: str
    start_line: int
    end_line: int
    byte_start: int
    byte_end: int
    partial: bool
    headers: list[tuple[int, int]] = field(default_factory=list)


class Lines:
    """Byte offsets of a text's lines; lines end at LF and are numbered from 1."""

    def __init__(self, text: str):
        self.raw = text.encode()
        self.starts = [0]
        at = self.raw.find(b"\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = self.raw.find(b"\n", at + 1)

    def __len__(self) -> int:
        return len(self.starts)

    def start(self, line: int) -> int:
        return self.starts[line - 1]

    def end(self, line: int) -> int:
        return self.starts[line] if line < len(self.starts) else len(self.raw)

    def at(self, byte: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, byte)

    def text(self, first: int, last: int) -> str:
        """Without the final LF, unless the text's empty last line is among them."""
        part = self.raw[self.start(first) : self.end(last)]
        if part.endswith(b"\n") and last < len(self.starts):
            part = part[:-1]
        return part.decode("utf-8", "replace")


def text_units(lines: Lines, first: int, last: int, name: str, most: int, partial: bool = False) -> list[Unit]:
    """Lines first..last in pieces of at most ``most`` bytes.

    A piece ends after the last LF in reach, else at the last character boundary. All are partial
    unless there is one.
    """
    if most < 4:
        raise ValueError("a unit needs room for one character")
    raw, begin, end = lines.raw, lines.start(first), lines.end(last)
    cuts, at = [begin], begin
    while at < end:
        to = min(end, at + most)
        if to < end:
            while to > at and raw[to] & 0xC0 == 0x80:
                to -= 1
            to = raw.rfind(b"\n", at, to) + 1 or to
        cuts.append(to)
        at = to
    out, line = [], first
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = raw.count(b"\n", a, b)
        out.append(Unit(name, line, line + n - (raw[b - 1 : b] == b"\n"), a, b, partial or len(cuts) > 2))
        line += n
    if out and raw.endswith(b"\n") and last == len(lines):
        out[-1].end_line = last  # the empty line at the end has no bytes
    return out


def split_source(text: str, most: int) -> list[Unit]:
    lines = Lines(text)
    return text_units(lines, 1, len(lines), "source", most)


def split_texts(docs: DataFrame, most: int = LIMITS.fallback_unit_bytes, key: str = "doc_id") -> DataFrame:
    """key, ord, byte_start, byte_end, start_line, end_line, partial for each piece of each text."""
    schema = "ord long, byte_start long, byte_end long, start_line long, end_line long, partial boolean"

    def run(batches):
        for batch in batches:
            rows = [(k, i, u.byte_start, u.byte_end, u.start_line, u.end_line, u.partial) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, u in enumerate(split_source(t or "", most))]
            names = [key, "ord", "byte_start", "byte_end", "start_line", "end_line", "partial"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            types = [pa.int64()] * 6 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, {schema}")
