"""Declarations of source files, with exact line ranges.

Python is read with its own parser. Go, Rust and the scripting family are read by a scanner: strings
and comments are blanked, brackets are matched, and what lies at one nesting depth is divided into
items. Unbalanced brackets or an unfinished string or comment make the whole file plain text.
"""

from __future__ import annotations

import ast
import bisect
import re
from dataclasses import dataclass, field

from winnow.limits import LIMITS
from winnow.operators.units import Lines, Unit, text_units

# Language by the last part of a path
EXTENSIONS = {"py": "python", "pyi": "python", "ts": "script", "cts": "script", "mts": "script", "js": "script", "cjs": "script", "mjs": "script", "tsx": "script", "jsx": "script", "go": "go", "rs": "rust"}
Range = tuple[int, int]


@dataclass
class Found:
    name: str
    lines: Range
    headers: list[Range] = field(default_factory=list)


class Unreadable(Exception):
    """Not valid source of its language, as far as the scanner can tell."""

    def __init__(self, comments: list[Range]):
        super().__init__("unreadable")
        self.comments = comments


def mode_of(path: str) -> str:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1], "text") if "." in path else "text"


# Python


def python_declarations(text: str) -> list[Found]:
    if re.search(r"\r(?!\n)", text):
        raise Unreadable([])
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        raise Unreadable([]) from None
    out: list[Found] = []
    defs = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)

    def first_line(n) -> int:
        return n.decorator_list[0].lineno if n.decorator_list else n.lineno

    def visit(n, prefix: str, headers: list[Range]) -> None:
        name, start, end = prefix + n.name, first_line(n), n.end_lineno
        members = [c for c in n.body if isinstance(c, defs)] if isinstance(n, ast.ClassDef) else []
        if not members:
            out.append(Found(name, (start, end), headers))
            return
        head = first_line(members[0]) - 1
        own = [*headers, (start, head)] if head >= start else headers
        at = start
        for m in members:
            if at < first_line(m):
                out.append(Found(f"{name}.context", (at, first_line(m) - 1), own))
            visit(m, f"{name}.", own)
            at = m.end_lineno + 1
        if at <= end:
            out.append(Found(f"{name}.context", (at, end), own))

    for n in tree.body:
        if isinstance(n, defs):
            visit(n, "", [])
    return out


def python_comments(text: str) -> list[Range]:
    return [(i, i) for i, line in enumerate(text.split("\n"), 1) if line.strip().startswith("#")]


def python_neighbours(text: str, chosen: list[Range], most: int = LIMITS.neighbour_lines) -> list[Range]:
    """For chosen methods: the short header of their class and the short methods beside them."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: set[Range] = set()
    for c in ast.walk(tree):
        if not isinstance(c, ast.ClassDef):
            continue
        start = lambda n: n.decorator_list[0].lineno if n.decorator_list else n.lineno
        methods = [(start(m), m.end_lineno) for m in c.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        for i, (a, b) in enumerate(methods):
            if any(a <= e and b >= s for s, e in chosen):
                head = (start(c), methods[0][0] - 1)
                near = [head, *methods[max(0, i - 1) : i], *methods[i + 1 : i + 2]]
                out |= {r for r in near if r[0] <= r[1] and r[1] - r[0] + 1 <= most}
    return sorted(r for r in out if not any(s <= r[0] and r[1] <= e for s, e in chosen))


# The scanner


class Source:
    """A text with its strings and comments blanked, and line numbers of offsets."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.comments: list[tuple[int, int]] = []
        self.code = self._blank()
        self._match()

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def comment_lines(self) -> list[Range]:
        return sorted({(self.line(a), self.line(max(a, b - 1))) for a, b in self.comments})

    def _blank(self) -> str:
        text, n = self.text, len(self.text)
        out = list(text)
        i = 0

        def blank(a: int, b: int) -> None:
            for k in range(a, b):
                if out[k] != "\n":
                    out[k] = " "

        def fail():
            raise Unreadable(self.comment_lines())

        while i < n:
            c = text[i]
            if text.startswith("//", i):
                end = text.find("\n", i)
                end = n if end < 0 else end
                self.comments.append((i, end))
                blank(i, end)
            elif text.startswith("/*", i):
                depth, end = 1, i + 2
                while depth and end < n:
                    if self.language == "rust" and text.startswith("/*", end):
                        depth, end = depth + 1, end + 2
                    elif text.startswith("*/", end):
                        depth, end = depth - 1, end + 2
                    else:
                        end += 1
                if depth:
                    fail()
                self.comments.append((i, end))
                blank(i, end)
            elif self.language == "rust" and (m := re.compile(r'b?r(#*)"').match(text, i)) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
                close = text.find('"' + m[1], m.end())
                if close < 0:
                    fail()
                end = close + 1 + len(m[1])
                blank(i, end)
                out[i] = "'"
            elif c == "'" and self.language == "rust":
                m = re.compile(r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])'").match(text, i)
                end = m.end() if m else i + 1  # a lifetime has no closing quote
                blank(i, end)
            elif c == "`":
                end = i + 1
                while end < n and text[end] != "`":
                    end += 2 if text[end] == "\\" and self.language == "script" else 1
                if end >= n:
                    fail()
                end += 1
                blank(i, end)
                out[i] = "'"
            elif c == '"' or (c == "'" and self.language != "rust"):
                end = i + 1
                while end < n and text[end] != c and (text[end] != "\n" or self.language == "rust"):
                    end += 2 if text[end] == "\\" else 1
                if end >= n or text[end] != c:
                    # an apostrophe in markup text is not a string
                    if c == "'" and self.language == "script":
                        i += 1
                        continue
                    fail()
                end += 1
                blank(i, end)
                out[i] = "'"
            else:
                end = i + 1
            i = end
        return "".join(out)

    def _match(self) -> None:
        pairs, stack = {")": "(", "]": "[", "}": "{"}, []
        self.close: dict[int, int] = {}
        for i, c in enumerate(self.code):
            if c in "([{":
                stack.append(i)
            elif c in pairs:
                if not stack or self.code[stack[-1]] != pairs[c]:
                    raise Unreadable(self.comment_lines())
                self.close[stack.pop()] = i
        if stack:
            raise Unreadable(self.comment_lines())

    def items(self, a: int, b: int, ends) -> list[tuple[int, int]]:
        """Spans of the items in [a, b): ``ends(start, i)`` says whether one ends with code[i]."""
        out, start, i = [], None, a
        while i < b:
            c = self.code[i]
            if start is None:
                if c.isspace() or c in ";,":
                    i += 1
                    continue
                start = i
            at = self.close.get(i, i) if c in "([{" else i
            if ends(start, at, b):
                out.append((start, at + 1))
                start = None
            i = at + 1
        if start is not None:
            out.append((start, len(self.code[:b].rstrip())))
        return [(s, s + len(self.code[s:e].rstrip())) for s, e in out]

    def lines(self, span: tuple[int, int]) -> Range:
        return self.line(span[0]), self.line(max(span[0], span[1] - 1))


def _next_code(code: str, at: int, b: int) -> str:
    m = re.compile(r"\s*(\S{0,3})").match(code, at, b)
    return m[1] if m else ""


# Go


def go_declarations(s: Source) -> list[Found]:
    code = s.code

    def ends(start: int, i: int, b: int) -> bool:
        if code[i] == ";":
            return True
        line_end = i + 1 >= b or re.compile(r"[ \t]*(?:\n|$)").match(code, i + 1, b) is not None
        return line_end and not code[i].isspace() and code[i] not in ",+-*/&|=(.<>:"

    out = []
    for span in s.items(0, len(code), ends):
        head = code[span[0] : span[1]]
        if m := re.match(r"package\s+(\w+)", head):
            name = f"package {m[1]}"
        elif m := re.match(r"func\s*\(([^)]*)\)\s*(\w+)", head):
            owner = (m[1].split() or [""])[-1].lstrip("*")
            name = f"{owner}.{m[2]}" if owner else m[2]
        elif m := re.match(r"func\s+(\w+)", head):
            name = m[1]
        elif m := re.match(r"(const|var|type)\b\s*", head):
            kind, at = m[1], m.end()
            if head[at : at + 1] == "(":
                rows = s.items(span[0] + at + 1, s.close[span[0] + at], ends)
            else:
                rows = [(span[0] + at, span[1])]
            names = []
            for x, y in rows:
                first = re.match(r"\w+" if kind == "type" else r"\w+(?:\s*,\s*\w+)*", code[x:y])
                names += re.findall(r"\w+", first[0]) if first else []
            name = ", ".join(names) or f"{kind}_declaration"
        else:
            name = "import_declaration" if head.startswith("import") else "source"
        out.append(Found(name, s.lines(span)))
    return out


# Rust

RUST_ITEM = re.compile(r"(?:pub\s*(?:\([^)]*\))?\s+)?(?:default\s+)?(?:(?:const|async|unsafe)\s+(?=fn|unsafe|extern|async|impl|trait|mod))*(?:extern\s*(?:'\s*)?(?=fn|\{))?(fn|struct|enum|union|trait|mod|type|const|static|impl|use|macro_rules!|extern\s+crate|)\s*(?:mut\s+)?")


def rust_declarations(s: Source) -> list[Found]:
    code = s.code
    comments = sorted(s.comments)

    def ends(start: int, i: int, b: int) -> bool:
        if code[start] == "#":
            return code[i] == "]"
        if code[i] == ";":
            return True
        return code[i] == "}" and "=" not in re.sub(r"[<>=!]=|=>|->", "", re.sub(r"<[^{}]*?>", "", _outer(code, start, i, s.close)))

    def name_of(span: tuple[int, int]) -> tuple[str, str]:
        head = code[span[0] : span[1]]
        m = RUST_ITEM.match(head)
        kind, rest = (m[1], head[m.end() :]) if m else ("", head)
        if kind == "impl":
            rest = re.sub(r"^\s*<[^{]*?>\s+", "", rest).split("{")[0].split(" where ")[0]
            target = re.split(r"\bfor\b", rest)[-1].strip()
            return "impl", target
        if head.startswith("extern") and not kind:
            return "extern", "foreign_mod_item"
        if kind == "use":
            return kind, "use_declaration"
        w = re.match(r"\w+", rest.strip())
        if not kind and (w2 := re.match(r"(\w+)\s*!", head)):
            return "macro", w2[1]
        return kind, w[0] if w else "source"

    out: list[Found] = []

    def visit(a: int, b: int, prefix: str, headers: list[Range]) -> None:
        spans = s.items(a, b, ends)
        owned = [*headers, *[s.lines(x) for x in spans if code[x[0] : x[0] + 2] == "#!"]]
        # attributes and comments in order with the items, to find what leads up to an item
        lead = sorted([(x, "attribute") for x in spans if code[x[0]] == "#" and code[x[0] + 1] != "!"] + [(c, "comment") for c in comments if a <= c[0] < b and not any(x[0] < c[0] < x[1] for x in spans)] + [(x, "inner" if code[x[0]] == "#" else "item") for x in spans if code[x[0]] != "#" or code[x[0] + 1] == "!"])
        for k, (span, what) in enumerate(lead):
            if what != "item":
                continue
            start = s.line(span[0])
            for j in range(k - 1, -1, -1):
                before, kind = lead[j]
                if kind not in ("attribute", "comment"):
                    break
                if kind == "comment" and j and lead[j - 1][1] in ("item", "inner") and s.line(lead[j - 1][0][1] - 1) == s.line(before[0]):
                    break  # a comment at the end of what stands before
                start = s.line(before[0])
            kind, name = name_of(span)
            opening = next((i for i in range(span[0], span[1]) if code[i] == "{" and i in s.close), None)
            body = (opening + 1, s.close[opening]) if kind in ("impl", "trait", "mod", "extern") and opening is not None else None
            if body and any(code[x[0]] != "#" for x in s.items(*body, ends)):
                header = (start, s.line(opening))
                own = [*owned, header]
                out.append(Found(f"{prefix}{name}.context", header, own))
                visit(*body, prefix if kind == "extern" else f"{prefix}{name}.", own)
            else:
                out.append(Found(f"{prefix}{name}", (start, s.lines(span)[1]), owned))

    visit(0, len(code), "", [])
    return out


def _outer(code: str, a: int, b: int, close: dict[int, int]) -> str:
    """The code of [a, b] outside its brackets."""
    out, i = [], a
    while i <= b:
        if code[i] in "([{" and i in close:
            i = close[i] + 1
            continue
        out.append(code[i])
        i += 1
    return "".join(out)


# Scripts

BLOCKS = re.compile(r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|enum|namespace|module|if|for|while|switch|try)\b|(?:export\s*)?\{")
NAMED = re.compile(r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|enum|namespace|module|type)\s+([\w$]+)")
VARIABLES = re.compile(r"(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+(?!enum\b)")
CONTINUES = tuple(".,?:+-*/%&|=<>()[")


def script_declarations(s: Source) -> list[Found]:
    code = s.code

    def ends(start: int, i: int, b: int) -> bool:
        c = code[i]
        if c == ";":
            return True
        nxt = _next_code(code, i + 1, b)
        newline = "\n" in code[i + 1 : i + 1 + len(code[i + 1 : b]) - len(code[i + 1 : b].lstrip())] or not nxt
        if c == "}" and BLOCKS.match(code, start) and not re.match(r"else\b|catch|finally|while|from\b|;", nxt):
            return not (code[start : start + 6] == "export" and nxt.startswith("fro"))
        return newline and not c.isspace() and c not in ",=+-*/&|<?:.([{" and not nxt.startswith(CONTINUES)

    def member_ends(start: int, i: int, b: int) -> bool:
        c = code[i]
        if c == "@":
            return False
        nxt = _next_code(code, i + 1, b)
        newline = "\n" in code[i + 1 : i + 1 + len(code[i + 1 : b]) - len(code[i + 1 : b].lstrip())] or not nxt
        if c == ";":
            return True
        if c == "}":
            return not nxt.startswith(("=", ",", ")"))
        return newline and not c.isspace() and c not in ",=+-*/&|<?:.(" and not nxt.startswith(CONTINUES) and not nxt.startswith("{") and not re.match(r"@[\w.$]+(\([^)]*\))?$", code[start : i + 1])

    out: list[Found] = []

    def name_of(head: str, member: bool) -> str:
        if member:
            m = re.match(r"(?:@[\w.$]+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|readonly|abstract|async|override|declare|accessor|get|set)\s+)*\*?\s*([#\w$]+)", head)
            return m[1] if m else "source"
        if m := NAMED.match(head):
            return m[1]
        if m := VARIABLES.match(head):
            depth, names, expect = 0, [], True
            for t in re.findall(r"[\w$]+|=>|[^\s\w$]", head[m.end() :]):
                if t in "([{":
                    depth += 1
                elif t in ")]}":
                    depth -= 1
                elif depth == 0 and t == ",":
                    expect = True
                elif expect and depth == 0 and re.match(r"[\w$]", t):
                    names.append(t)
                    expect = False
            return ", ".join(names) or "source"
        return "source"

    for span in s.items(0, len(code), ends):
        head = code[span[0] : span[1]]
        name = name_of(head, False)
        lines = s.lines(span)
        is_class = re.match(r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?class\b", head)
        opening = next((i for i in range(*span) if code[i] == "{" and i in s.close), None) if is_class else None
        members = s.items(opening + 1, s.close[opening], member_ends) if opening is not None else []
        if not members:
            out.append(Found(name, lines))
            continue
        first = s.line(members[0][0])
        own = [(lines[0], first - 1)] if first > lines[0] else []
        if own:
            out.append(Found(f"{name}.context", own[0], own))
        for m in members:
            out.append(Found(f"{name}.{name_of(code[m[0] : m[1]], True)}", s.lines(m), own))
    return out


READERS = {"go": go_declarations, "rust": rust_declarations, "script": script_declarations}


@dataclass
class Inspection:
    mode: str
    units: list[Unit]
    comments: list[Range]


def inspect(path: str, text: str, most: int = LIMITS.unit_bytes, most_parsed: int = LIMITS.inspected_bytes) -> Inspection:
    """A file's units: its declarations, cut where larger than ``most``, or plain pieces of text."""
    lines, mode = Lines(text), mode_of(path)
    found, comments = [], []
    if mode != "text" and len(lines.raw) <= most_parsed:
        try:
            if mode == "python":
                found = python_declarations(text)
                comments = python_comments(text)
            else:
                s = Source(text, mode)
                found, comments = READERS[mode](s), s.comment_lines()
        except Unreadable as e:
            comments = e.comments if mode == "script" else []
            return Inspection("text", text_units(lines, 1, len(lines), "source", most, True), comments)
    else:
        return Inspection("text", text_units(lines, 1, len(lines), "source", most, mode != "text"), [])
    units = []
    for f in found:
        a, b = f.lines
        if lines.end(b) - lines.start(a) > most:
            pieces = text_units(lines, a, b, f.name, most, True)
            for p in pieces:
                p.headers = f.headers
            units += pieces
        else:
            units.append(Unit(f.name, a, b, lines.start(a), lines.end(b), False, f.headers))
    if not units:
        units = text_units(lines, 1, len(lines), "source", most)
    return Inspection(mode, units, comments)
