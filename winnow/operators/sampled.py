"""Previews that need a loop: samples of long Python files and of a directory's files."""

from __future__ import annotations

import ast
import json
import re

from winnow.limits import LIMITS, Limits
from winnow.operators import languages
from winnow.operators.units import split_source

IDENTIFIER = re.compile(r"[^\W\d]\w*")


def size(value) -> int:
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode())


def clip(text: str, most: int) -> str:
    return text.encode()[:most].decode("utf-8", "ignore")


def file_preview(path: str, text: str, question: str, limits: Limits = LIMITS) -> dict:
    """What a request shows of a file: its beginning, shrunk until its JSON fits.

    Of a longer Python file parts of the whole are shown instead, and of a longer file in a known
    language its declarations are listed, as many as fit.
    """
    raw = text.encode()
    head = clip(text, limits.preview_bytes)
    while size(head) > limits.preview_json:
        head = head[: len(head) * 3 // 4]
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    out = {"sizeBytes": len(raw), "extension": f".{ext}" if dot and stem else "", "text": head, "previewBytes": len(head.encode()), "truncated": len(head) < len(text), "range": "opening bytes", "declarations": [], "declarationIndexTruncated": False}
    if not out["truncated"] or len(raw) > limits.inspected_bytes:
        return out
    if languages.mode_of(path) == "python" and (parts := python_preview(text, question, limits)) and len(parts.encode()) <= limits.preview_bytes and size(parts) <= limits.preview_json:
        out |= {"text": parts, "previewBytes": len(parts.encode()), "range": "sampled source ranges"}
    if languages.mode_of(path) != "text":
        units = languages.inspect(path, text, max(4, len(raw)), limits.inspected_bytes).units
        kept = [{"name": u.name, "startLine": u.start_line, "endLine": u.end_line} for u in units if not u.partial]
        out["declarations"] = kept
        spare = limits.declared_json - size(out | {"declarations": []})
        used = 0
        for i, d in enumerate(kept):
            used += size(d) + (1 if i else 0)
            if used > spare - 1:  # "true" for "false" is a byte shorter, the list loses its rest
                out |= {"declarations": kept[:i], "declarationIndexTruncated": True}
                break
    return out


def chunk_previews(path: str, text: str, limits: Limits = LIMITS) -> list[dict]:
    """Previews of all of a file's text in pieces, for a file whose own preview no request can hold."""
    raw, whole = text.encode(), file_preview(path, "", "", limits)
    out = []
    for u in split_source(text, limits.chunk_bytes):
        part = raw[u.byte_start : u.byte_end]
        out.append({"sizeBytes": len(raw), "extension": whole["extension"], "text": part.decode("utf-8", "replace"), "previewBytes": len(part), "truncated": True, "range": "sampled source ranges"})
    return out


def python_preview(text: str, question: str, limits: Limits = LIMITS) -> str | None:
    """Parts of a long Python file: its opening, what the question names, and windows of its rest.

    None if it is short or cannot be parsed.
    """
    if len(text.encode()) <= limits.preview_bytes:
        return None
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines, wanted, budget = text.split("\n"), set(IDENTIFIER.findall(question)), limits.preview_bytes
    parts, seen = [("opening", clip(text, budget // 4))], set()

    def add(label: str, a: int, b: int) -> None:
        body = "\n".join(lines[a - 1 : b])
        used = sum(len(p.encode()) + len(n) + 8 for n, p in parts)
        if (a, b) not in seen and used + len(body.encode()) + len(label) + 8 <= budget:
            seen.add((a, b))
            parts.append((label, body))

    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.name in wanted:
            body = n.body[1:] if ast.get_docstring(n) is not None and len(n.body) > 1 else n.body
            add(f"{n.name}, line {n.lineno}", n.lineno, max(n.lineno, body[0].lineno - 1))
            add(f"{n.name}, implementation", body[0].lineno, n.end_lineno)
    total = len(lines)
    for at in (total // 3, total * 2 // 3, total - 31):
        a = max(1, at)
        add(f"lines from {a}", a, min(total, a + 31))
    return "\n...\n".join(f"[{name}]\n{part}" for name, part in parts)


def with_samples(preview: dict, samples: list[dict], limits: Limits = LIMITS) -> dict:
    """A directory's preview with its files' samples, cut by fifths until the JSON fits or all are short."""
    out = [dict(s) for s in samples]
    while size(preview | {"contentSamples": out}) > limits.sampled_json and any(len(s["source"]) > limits.sample_chars for s in out):
        for s in out:
            s["source"] = s["source"][: max(len(s["source"]) * 4 // 5, limits.sample_chars)]
            s["truncated"] = True
    return preview | {"contentSamples": out}
