"""Groups of a file's units, and the source that goes along with each."""

from __future__ import annotations

from collections.abc import Iterator

from winnow.limits import LIMITS, Limits
from winnow.operators.units import Lines, Unit


def groups(units: list[Unit], lines: Lines, limits: Limits = LIMITS) -> list[list[Unit]]:
    """Consecutive units: at most ``group_units``, whose lines from first to last have at most
    ``group_bytes``; a unit may be longer by itself."""
    out: list[list[Unit]] = []
    for u in units:
        if out and len(out[-1]) < limits.group_units and len(lines.text(out[-1][0].start_line, u.end_line).encode()) <= limits.group_bytes:
            out[-1].append(u)
        else:
            out.append([u])
    return out


def whole_lines(lines: Lines, u: Unit) -> bool:
    first, last = lines.at(u.byte_start), lines.at(max(u.byte_start, u.byte_end - 1))
    return lines.start(first) == u.byte_start and lines.end(last) == u.byte_end


def context(lines: Lines, group: list[Unit], limits: Limits = LIMITS) -> str:
    """What a request shows around a group.

    A small file is shown whole, of others the opening and the lines around the group. Where a unit
    cuts a line, or a line in reach is giant, the units' own bytes stand alone.
    """
    first, last = max(1, group[0].start_line - limits.context_lines), min(len(lines), group[-1].end_line + limits.context_lines)
    opening = min(limits.opening_lines, len(lines))
    giant = any(lines.end(i) - lines.start(i) > limits.unit_bytes + 1 for i in {*range(1, opening + 1), *range(first, last + 1)})
    if giant or not all(whole_lines(lines, u) for u in group):
        own = (f"Source lines {u.start_line}-{u.end_line}; source bytes {u.byte_start}-{u.byte_end}:\n{lines.raw[u.byte_start : u.byte_end].decode('utf-8', 'replace')}" for u in group)
        return "\n".join(own)
    if len(lines.raw) <= limits.whole_file_bytes:
        return lines.raw.decode("utf-8", "replace")
    return f"Opening context:\n{lines.text(1, opening)}\nSource lines {first}-{last}:\n{lines.text(first, last)}"


def halved(group: list, too_large) -> Iterator[list]:
    """The group, or its halves and theirs while one of several is too large, in order."""
    if len(group) > 1 and too_large(group):
        half = -(-len(group) // 2)
        yield from halved(group[:half], too_large)
        yield from halved(group[half:], too_large)
    else:
        yield group
