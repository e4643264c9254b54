"""Records of calls on a file system: exclusive folders, whole files, captures."""

from __future__ import annotations

import json
import os
import re
import shlex
import tempfile
from datetime import UTC, datetime
from pathlib import Path

from winnow.limits import LIMITS

KINDS = ("captures", "asks", "searches")
TRIES = 1000


def state_root(environment: dict[str, str] | None = None) -> Path:
    """An absolute XDG_STATE_HOME, else .local/state in the home folder."""
    env = os.environ if environment is None else environment
    base = env.get("XDG_STATE_HOME", "")
    return (Path(base) if base.startswith("/") else Path(env.get("HOME", "/")) / ".local/state") / "winnow"


def stamp(t: float) -> str:
    return datetime.fromtimestamp(t, UTC).strftime("%Y%m%dT%H%M%S.%fZ")


def rfc3339(t: float) -> str:
    return datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def allocate(root: Path, kind: str, t: float, label: str) -> Path:
    """A new folder <root>/<kind>/<stamp>-<label>; taken names get -1, -2 and so on."""
    if kind not in KINDS:
        raise ValueError(kind)
    base = f"{stamp(t)}-{re.sub('[^A-Za-z0-9_-]', '_', label)}"
    for n in range(TRIES):
        path = root / kind / (base if not n else f"{base}-{n}")
        path.parent.mkdir(parents=True, exist_ok=True)
        try:
            path.mkdir()
            return path
        except FileExistsError:
            continue
    raise FileExistsError(base)


def replace(path: Path, data: bytes) -> None:
    """The file has its old or its new content at any time."""
    fd, temporary = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def create(path: Path, data: bytes) -> None:
    """Fails if the file exists."""
    with open(path, "xb") as f:
        f.write(data)


def start_capture(folder: Path, command: str, cwd: str, t: float) -> str:
    """Write what is known at the start; gives the command whose output goes to the folder."""
    replace(folder / "metadata.json", json.dumps({"command": command, "cwd": cwd, "started_at": rfc3339(t), "started_at_unix": t}, indent=2, ensure_ascii=False).encode())
    return f"{{\n{command}\n}} >{shlex.quote(str(folder / 'stdout.log'))} 2>{shlex.quote(str(folder / 'stderr.log'))}"


def finish_capture(folder: Path, status: str, t: float) -> tuple[bytes, int]:
    """Add the end to the record; gives what is shown and the status. Never fails the command."""
    try:
        code = int(status)
    except ValueError:
        code = 1
    size = lambda n: (folder / n).stat().st_size if (folder / n).exists() else 0
    out_bytes, err_bytes = size("stdout.log"), size("stderr.log")
    seconds = None
    try:
        meta = json.loads((folder / "metadata.json").read_text())
        if isinstance(began := meta.get("started_at_unix"), (int, float)):
            seconds = int((t - began) * 10 + 0.5) / 10
        meta |= {"exit_code": code, "ended_at": rfc3339(t), "duration_seconds": seconds, "stdout_bytes": out_bytes, "stderr_bytes": err_bytes}
        replace(folder / "metadata.json", json.dumps(meta, indent=2, ensure_ascii=False).encode())
    except (OSError, ValueError, AttributeError):
        seconds = None
    shown = b""
    full = out_bytes + err_bytes <= LIMITS.shown_bytes
    if full:
        start = lambda n, most: (folder / n).read_bytes()[:most] if most else b""
        closed = lambda x: x if not x or x.endswith(b"\n") else x + b"\n"
        shown = start("stdout.log", out_bytes)
        if err_bytes:
            shown = closed(shown) + b"--- stderr\n" + start("stderr.log", err_bytes)
        shown = closed(shown)
    facts = [f"exit_code: {code}", f"stdout: {out_bytes} bytes {folder / 'stdout.log'}", f"stderr: {err_bytes} bytes {folder / 'stderr.log'}"]
    facts += [f"duration_seconds: {seconds}"] * (seconds is not None) + ["output not shown"] * (not full)
    return shown + "".join(f + "\n" for f in facts).encode(), code
