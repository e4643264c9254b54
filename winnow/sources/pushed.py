"""Filters that a scan of a file tree takes over from Spark, and the folders that they rule out."""

from __future__ import annotations

import operator
from collections.abc import Iterable

from pyspark.sql import datasource as D

#: What is known of an entry before its content is read.
KNOWN = ("path", "kind", "parent", "depth", "bytes", "reason")
COMPARED = {D.EqualTo: operator.eq, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: operator.contains}


def column(f: D.Filter) -> str | None:
    """The column that a filter is on, if it is one that is known without content."""
    of = f.child if isinstance(f, D.Not) else f
    if not isinstance(of, (*COMPARED, D.In, D.IsNull, D.IsNotNull)):
        return None
    return of.attribute[0] if len(of.attribute) == 1 and of.attribute[0] in KNOWN else None


def holds(f: D.Filter, value) -> bool | None:
    """Whether a filter holds for a column's value; None where SQL has no answer, as for nulls."""
    if isinstance(f, D.Not):
        inner = holds(f.child, value)
        return None if inner is None else not inner
    if isinstance(f, (D.IsNull, D.IsNotNull)):
        return (value is None) == isinstance(f, D.IsNull)
    if value is None:
        return None
    if isinstance(f, D.In):
        return True if value in f.value else None if None in f.value else False
    return COMPARED[type(f)](value, f.value)


class Pushed:
    """The filters of a scan that are decided before content is read."""

    def __init__(self, filters: Iterable[D.Filter] = ()):
        self.filters = [f for f in filters if column(f)]

    def keeps(self, **entry) -> bool:
        """Whether an entry with these columns passes."""
        return all(holds(f, entry[column(f)]) for f in self.filters)

    def enters(self, folder: str) -> bool:
        """Whether anything below a folder can pass; a folder that is ruled out is not listed."""
        return all(self._reaches(f, folder) for f in self.filters)

    def _reaches(self, f: D.Filter, folder: str) -> bool:
        name, below = column(f), f"{folder}/" if folder else ""
        if isinstance(f, D.StringStartsWith) and name in ("path", "parent"):
            # a parent may be the folder itself, without the slash
            return below.startswith(f.value) or f.value.startswith(below) or (name == "parent" and folder.startswith(f.value))
        if isinstance(f, (D.EqualTo, D.In)) and name in ("path", "parent"):
            wanted = f.value if isinstance(f, D.In) else [f.value]
            return any(w is not None and (w.startswith(below) or (name == "parent" and w == folder)) for w in wanted)
        if isinstance(f, (D.EqualTo, D.LessThan, D.LessThanOrEqual)) and name == "depth":
            least = folder.count("/") + 2 if folder else 1
            return least < f.value if isinstance(f, D.LessThan) else least <= f.value
        return True
