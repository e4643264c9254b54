"""Ignore files: which paths below a folder their rules leave out."""

from __future__ import annotations

import re
from pathlib import Path

FILES = (".gitignore", ".ignore")


def rule(line: str) -> tuple[bool, bool, re.Pattern] | None:
    """(negated, directories only, pattern over paths relative to the file's folder)."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    parts = line.lstrip("/").split("/")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if len(c) > 1 and c[0] == "[" else re.escape(c.removeprefix("\\")) for c in re.findall(r"\[[^\]]+\]|\\.|.", part)) + ("" if last else "/")
    return negated, only_dirs, re.compile(out if anchored else f"(?:.*/)?{out}")


class Rules:
    """The rules of the ignore files met on the way down; the last rule that matches decides."""

    def __init__(self):
        self.layers: list[tuple[str, list]] = []

    def read(self, root: Path, folder: str) -> list[str]:
        """Add the ignore files of a folder; gives the names of those that cannot be read."""
        bad = []
        names = [*FILES, *((".git/info/exclude",) if not folder else ())]
        for name in names:
            path = root / folder / name
            try:
                if path.is_file():
                    rules = [r for line in path.read_text("utf-8").split("\n") if (r := rule(line))]
                    self.layers.append((folder, rules))
            except (OSError, UnicodeDecodeError, re.error):
                bad.append(f"{folder}/{name}".lstrip("/"))
        return bad

    def ignored(self, path: str, is_dir: bool) -> bool:
        out = False
        for folder, rules in self.layers:
            if folder and not path.startswith(folder + "/"):
                continue
            rest = path[len(folder) :].lstrip("/") if folder else path
            for negated, only_dirs, pattern in rules:
                if (is_dir or not only_dirs) and pattern.fullmatch(rest):
                    out = not negated
        return out
