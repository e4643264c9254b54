"""Rules on names and paths: globs, exclusions, roots, trees, record names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import paths as P
from winnow.sources.store import written


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob.

    "*" and "?" stay within a path part, "**" as a whole part crosses parts, [..] is a class, a
    backslash escapes. Empty patterns, a leading "/" and ".." parts are refused.
    """
    if not pattern or pattern.startswith("/") or ".." in pattern.split("/"):
        raise ValueError(f"not a usable pattern: {pattern!r}")
    parts = pattern.split("/")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last and i else ".*" if last else "(?:.*/)?"
            continue
        out += _part(part) + ("" if last else "/")
    return f"^{out}$"


def _part(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "\\" and i + 1 < len(part):
            out += re.escape(part[i + 1])
            i += 1
        elif c == "*":
            while part[i + 1 : i + 2] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := part.find("]", i + 2)) > 0:
            body = part[i + 1 : end]
            out += "[" + ("^/" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{" and (end := part.find("}", i)) > 0:
            out += "(?:" + "|".join(_part(x) for x in part[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def any_glob(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches; without patterns, false."""
    return path.rlike("|".join(glob_regex(p) for p in patterns)) if patterns else F.lit(False)


def prunes(path: Column, patterns: list[str]) -> Column:
    """Whether an exclude pattern takes a whole directory: it matches it, or it is a directory's
    pattern followed by "/**/*", "/**" or "/*"."""
    out = any_glob(path, patterns)
    heads = [p[: -len(end)] for p in patterns for end in ("/**/*", "/**", "/*") if p.endswith(end)]
    return out | any_glob(path, [h for h in dict.fromkeys(heads) if h])


def _first(rules: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for test, reason in reversed(rules):
        out = F.when(test, reason).otherwise(out)
    return out


#: What is left out of every search, by reason.
EXCLUSIONS = ("hidden", "vcs", "dependency", "sensitive_name", "protected", "symlink", "binary", "private_key")


def directory_reason(path: Column, exclude: list[str] = (), protected: list[str] = ()) -> Column:
    """Why a directory is left out, by the first rule that holds; null if it is kept."""
    name = P.basename(path)
    return _first([(name.isin(*protected) if protected else F.lit(False), "protected"), (name.startswith("."), "hidden"), (name.isin(*P.VCS), "vcs"), (name.isin(*P.DEPENDENCIES), "dependency"), (P.is_sensitive(name), "sensitive_name"), (prunes(path, list(exclude)), "exclude_pattern")])


def file_reason(path: Column, include: list[str] = (), exclude: list[str] = (), protected: list[str] = ()) -> Column:
    """Why a file is left out; without include patterns all are included."""
    name = P.basename(path)
    return _first([(name.isin(*protected) if protected else F.lit(False), "protected"), (name.startswith("."), "hidden"), (P.is_sensitive(name), "sensitive_name"), (any_glob(path, list(exclude)), "exclude_pattern"), (~any_glob(path, list(include)) if include else F.lit(False), "not_included")])


def containing_root(paths: DataFrame, roots: list[str]) -> DataFrame:
    """The longest root that holds each path; paths outside all roots go."""
    inside = [F.when((F.col("path") == r) | F.col("path").startswith(r.rstrip("/") + "/"), F.lit(r)) for r in sorted(roots, key=len, reverse=True)]
    return paths.withColumn("root", F.coalesce(*inside)).where("root IS NOT NULL")


def closure(entries: DataFrame) -> DataFrame:
    """path, depth of all entries reachable from the root by their parents.

    Level by level until one is empty, however deep the tree; a level is a written table.
    """
    rows = entries.where("path <> ''").select("path", "parent")
    level = rows.where("parent = ''").select("path", F.lit(1).cast("long").alias("depth"))
    out = front = written(level, "closure")
    while not front.isEmpty():
        above = front.select(F.col("path").alias("parent"), "depth")
        front = written(rows.join(above, "parent").select("path", (F.col("depth") + 1).alias("depth")), "closure")
        out = out.unionByName(front)
    return out


def record_names(rows: DataFrame, order: str, most: int = 1000) -> DataFrame:
    """A name for each record from (stamp, label): the n-th of equal ones gets "-n", up to ``most``."""
    n = F.row_number().over(Window.partitionBy("stamp", "label").orderBy(order)) - 1
    named = rows.withColumn("n", n).where(F.col("n") < most)
    return named.withColumn("name", F.concat(F.col("stamp"), F.lit("-"), F.col("label"), F.when(F.col("n") > 0, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""))).drop("n")


def nearest_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: for each path the longest root (a table's column ``root``) that is it or lies above it, or null.

    Each path asks for itself and its ancestors by equality, so any number of roots costs one join; the
    empty root holds every path. Repeated roots count once; equal paths are one row.
    """
    own = paths.select("path").distinct()
    above = own.select("path", F.explode(F.array_distinct(F.concat(P.ancestors(F.col("path")), F.array("path", F.lit(""))))).alias("root"))
    held = above.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return own.join(held, "path", "left")
