"""A folder of files as a Spark data source, for files that executors can reach.

``spark.read.format("winnow_files").option("path", root)`` gives one row for each entry: path, kind,
parent, depth, bytes, reason (why it is left out), status (of reading), sha256, text. Links are
followed only to regular files inside the root whose every name is allowed. Partitions hold about equal
bytes, so that a full folder is many and small folders share one. Filters on path, kind, parent, depth,
bytes and reason are decided before a file is opened, and folders that they rule out are not listed.
``write`` makes such a tree of rows (``treewriter``).
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
import urllib.parse
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from winnow.functions import paths as P
from winnow.limits import LIMITS
from winnow.operators import names
from winnow.sources.ignore import Rules
from winnow.sources.pushed import Pushed, column
from winnow.sources.treewriter import TreeWriter, local_path

SCHEMA = "path string, kind string, parent string, depth int, bytes long, reason string, status string, sha256 string, text string"
#: A partition's bytes and files, what an entry counts beside its bytes, the entries that the driver
#: looks at to plan partitions, and the pieces of what it has not looked at.
PARTITION_BYTES, PARTITION_FILES, ENTRY_BYTES, PLANNED_ENTRIES, SHARES = 64 << 20, 10_000, 4096, 1_000_000, 256
CONTROL = re.compile(rb"[\x00-\x08\x0b\x0e-\x1f\x7f]")
PRIVATE_KEY = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")


def sensitive(name: str) -> bool:
    low = name.lower()
    return low in P.SENSITIVE or low.startswith(".env.") or low.endswith(P.SENSITIVE_ENDS)


def name_reason(name: str, is_dir: bool) -> str | None:
    if name.startswith("."):
        return "hidden"
    if is_dir and name in P.VCS:
        return "vcs"
    if is_dir and name in P.DEPENDENCIES:
        return "dependency"
    return "sensitive_name" if sensitive(name) else None


def link_reason(root: Path, path: str) -> str | None:
    """Why a link is left out: its target must be a regular file inside the root, by allowed names."""
    try:
        target = (root / path).resolve(strict=True)
    except (OSError, RuntimeError):
        return "symlink"
    real = root.resolve()
    if not target.is_file() or not target.is_relative_to(real):
        return "symlink"
    parts = target.relative_to(real).parts
    return next((r for i, p in enumerate(parts) if (r := name_reason(p, i < len(parts) - 1))), None)


def resolve(path: str, most_links: int = 40) -> str | None:
    """An absolute path with links followed; parts that do not exist are kept. None beyond
    ``most_links`` links."""
    todo, done, links = [p for p in path.split("/") if p][::-1], "", 0
    while todo:
        part = todo.pop()
        if part == ".":
            continue
        if part == "..":
            done = done.rpartition("/")[0]
            continue
        here = f"{done}/{part}"
        try:
            target = os.readlink(here)
        except OSError:
            done = here
            continue
        links += 1
        if links > most_links:
            return None
        done = "" if target.startswith("/") else done
        todo += [p for p in target.split("/") if p][::-1]
    return done or "/"


def roots(given: list[str]) -> list[str]:
    """Folders named by path or file URI, each as given and as it resolves, without repeats.

    So a folder that is a link holds its own paths and its target's. URIs of other schemes or hosts,
    and relative paths, are passed over.
    """
    out: list[str] = []
    for x in given:
        uri = urllib.parse.urlsplit(x)
        if uri.scheme == "file" and uri.netloc in ("", "localhost"):
            path = urllib.parse.unquote(uri.path)
        else:
            path = x
        if path.startswith("/"):
            path = path.rstrip("/") or "/"
            out += [path, *filter(None, [resolve(path)])]
    return list(dict.fromkeys(out))


def inside(paths: DataFrame, given: list[str]) -> DataFrame:
    """The paths under any of the given roots, with the longest that holds each."""
    return names.containing_root(paths, roots(given))


def read_file(root: Path, path: str, most: int = LIMITS.file_bytes) -> tuple[str, str | None, str | None, int]:
    """(status, sha256, text, bytes); the file must be the same before and after the read."""
    full, flags = f"{root}/{path}", os.O_RDONLY | os.O_NONBLOCK | os.O_NOFOLLOW
    try:
        # few files are links
        try:
            fd = os.open(full, flags)
        except OSError:
            fd = os.open(os.path.realpath(full, strict=True), flags)
    except OSError:
        return "unreadable", None, None, 0
    with os.fdopen(fd, "rb", buffering=0) as f:
        before = os.fstat(fd)
        if not stat.S_ISREG(before.st_mode):
            return "special_file", None, None, 0
        if before.st_size > most:
            return "size_limit", None, None, before.st_size
        raw = b""
        while len(raw) <= most and (more := f.read(most + 1 - len(raw) if raw else before.st_size + 1)):
            raw += more
        after = os.fstat(fd)
    if (before.st_size, before.st_mtime_ns, before.st_ctime_ns) != (after.st_size, after.st_mtime_ns, after.st_ctime_ns) or len(raw) != after.st_size:
        return ("size_limit" if len(raw) > most else "changed"), None, None, len(raw)
    if CONTROL.search(raw):
        return "binary", None, None, len(raw)
    digest = hashlib.sha256(raw).hexdigest()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return "encoding", None, None, len(raw)
    if PRIVATE_KEY.search(raw):
        return "private_key", None, None, len(raw)
    return "ok", digest, text, len(raw)


def listing(root: Path, folder: str, rules: Rules, has: Callable[[str], bool] = lambda name: True) -> Iterator[tuple[str, bool, str | None]]:
    """(path, is directory, reason) of a folder's entries by name, of those that ``has`` takes; ignored
    ones do not appear."""
    with os.scandir(root / folder) as entries:
        found = sorted((e.name, e.is_symlink(), e.is_dir(follow_symlinks=False)) for e in entries if has(e.name))
    for name, is_link, is_dir in found:
        path = f"{folder}/{name}".lstrip("/")
        if rules.ignored(path, is_dir):
            continue
        reason = name_reason(name, is_dir)
        if reason is None and is_link:
            reason = link_reason(root, path)
        yield path, is_dir, reason


@dataclass(frozen=True)
class Piece:
    """What a task lists: a whole folder's entries and all below them, or its entries alone by name
    (first to last, both included) or by a share of their names' hashes; folders among these are left
    to their own pieces."""

    folder: str
    deep: bool = True
    first: str | None = None
    last: str | None = None
    share: tuple[int, int] | None = None

    def has(self, name: str) -> bool:
        if self.share:
            return zlib.crc32(os.fsencode(name)) % self.share[1] == self.share[0]
        return self.first is None or self.first <= name <= self.last


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.root = Path(local_path(path) if path.startswith("file:") else path)
        self.content = options.get("content", "true").lower() != "false"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.partition_files = int(options.get("partitionFiles", PARTITION_FILES))
        self.planned = int(options.get("plannedEntries", PLANNED_ENTRIES))
        self.pushed = Pushed()

    def pushFilters(self, filters: list) -> Iterator:
        """Filters on what is known without content are decided here, before a file is opened.

        Those on bytes are given back too, as a file's size is taken again when it is read.
        """
        self.pushed = Pushed(filters)
        return iter([f for f in filters if (c := column(f)) is None or c == "bytes"])

    def partitions(self) -> list[InputPartition]:
        """Pieces of about equal bytes. The driver looks at one folder at a time, from the top, until it
        has seen ``plannedEntries``; the folders left then are dealt whole, by hashes of their names into
        SHARES pieces in all or one a folder."""
        rules = Rules()
        rules.read(self.root, "")
        if not self.pushed.enters(""):
            return [Pieces([])]
        sized: list[tuple[int, int, Piece]] = []
        todo, left = deque([""]), self.planned
        while todo:
            folder = todo.popleft()
            found = self._peek(folder, left)
            if found is None:
                # few folders are left in many shares each, many in one
                shares = max(1, SHARES // (1 + len(todo)))
                part = 1 if shares > 1 else 8
                sized += [(self.partition_bytes // part, self.partition_files // part, Piece(f, True, share=(i, shares))) for f in (folder, *todo) for i in range(shares)]
                break
            left -= len(found)
            first, size, files = None, 0, 0
            for name, is_dir, n in found:
                first = name if first is None else first
                size, files = size + n + ENTRY_BYTES, files + 1
                if is_dir and name_reason(name, True) is None and self.pushed.enters(path := f"{folder}/{name}".lstrip("/")):
                    todo.append(path)
                if size >= self.partition_bytes or files >= self.partition_files:
                    sized.append((size, files, Piece(folder, False, first, name)))
                    first, size, files = None, 0, 0
            if first is not None:
                sized.append((size, files, Piece(folder, False, first, found[-1][0])))
        out: list[list[Piece]] = []
        size = files = 0
        for n, k, piece in sized:
            if not out or size + n > self.partition_bytes or files + k > self.partition_files:
                out.append([])
                size = files = 0
            out[-1].append(piece)
            size, files = size + n, files + k
        return [Pieces(p) for p in out] or [Pieces([])]

    def _peek(self, folder: str, most: int) -> list[tuple[str, bool, int]] | None:
        """(name, is directory, bytes) of a folder's entries by name; None if they are more than ``most``."""
        out: list[tuple[str, bool, int]] = []
        try:
            with os.scandir(self.root / folder) as entries:
                for e in entries:
                    if len(out) >= most:
                        return None
                    is_dir = e.is_dir(follow_symlinks=False)
                    try:
                        n = 0 if is_dir or not self.content else e.stat().st_size
                    except OSError:
                        n = 0
                    out.append((e.name, is_dir, n))
        except OSError:
            if not folder:
                raise
        return sorted(out)

    def read(self, partition: Pieces) -> Iterator[tuple]:
        for piece in partition.pieces:
            rules = Rules()
            rules.read(self.root, "")
            parts = piece.folder.split("/") if piece.folder else []
            ignored = False
            for i in range(len(parts)):
                ignored |= rules.ignored(above := "/".join(parts[: i + 1]), True)
                rules.read(self.root, above)
            try:
                entries = [] if ignored else list(listing(self.root, piece.folder, rules, piece.has))
            except OSError:
                entries = []  # the folder's own row says that it is unreadable
            for x in entries:
                yield from self._entry(*x, rules, piece.deep)

    def _entry(self, path: str, is_dir: bool, reason: str | None, rules: Rules, deep: bool) -> Iterator[tuple]:
        parent, depth = path.rpartition("/")[0], path.count("/") + 1
        known = {"path": path, "kind": "directory" if is_dir else "file", "parent": parent, "depth": depth, "reason": reason}
        if not is_dir:
            status = digest = text = None
            try:
                size = os.stat(f"{self.root}/{path}").st_size
            except OSError:
                size = 0
            if not self.pushed.keeps(**known, bytes=size):
                return
            if reason is None and self.content:
                status, digest, text, size = read_file(self.root, path)
            yield path, "file", parent, depth, size, reason, status, digest, text
            return
        below: list[tuple[str, bool, str | None]] = []
        status = None
        held = len(rules.layers)
        if reason is None:
            try:
                status = "unreadable" if rules.read(self.root, path) else None
                if deep:
                    below = list(listing(self.root, path, rules)) if self.pushed.enters(path) else []
                else:
                    os.scandir(self.root / path).close()
            except OSError:
                status = "unreadable"
        if self.pushed.keeps(**known, bytes=None):
            yield path, "directory", parent, depth, None, reason, status, None, None
        for x in below:
            yield from self._entry(*x, rules, deep)
        del rules.layers[held:]


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "winnow_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)
