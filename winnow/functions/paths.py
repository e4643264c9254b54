"""Names, paths and URIs as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that are never read or listed.
VCS = (".git", ".hg", ".svn", ".bzr", "_darcs", "CVS")
DEPENDENCIES = ("node_modules", "vendor", "venv", ".venv", ".tox", "__pycache__", "dist", "build", "coverage", "target", ".next", ".nuxt", ".turbo")
SENSITIVE = ("credentials", "credentials.json", "secrets.json", "secrets.yaml", "secrets.yml", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".netrc", ".npmrc", ".pypirc", ".env")
SENSITIVE_ENDS = (".pem", ".key", ".p12", ".pfx")
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "cts": "typescript", "mts": "typescript", "js": "typescript", "cjs": "typescript", "mjs": "typescript", "tsx": "typescript", "jsx": "typescript", "go": "go", "rs": "rust"}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/"))).cast("long")


def extension(path: Column) -> Column:
    """From the last dot of the base name on, unless that dot is its first character."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def language(path: Column) -> Column:
    """By what follows the last dot of the whole path."""
    last = F.element_at(F.split(path, r"\."), -1)
    out = F.lit("text")
    for name in dict.fromkeys(LANGUAGES.values()):
        out = F.when(last.isin([k for k, v in LANGUAGES.items() if v == name]), F.lit(name)).otherwise(out)
    return F.when(path.contains("."), out).otherwise(F.lit("text"))


def is_sensitive(name: Column) -> Column:
    low = F.lower(name)
    out = low.isin(*SENSITIVE) | low.startswith(".env.")
    for end in SENSITIVE_ENDS:
        out = out | low.endswith(end)
    return out


def normalize(path: Column) -> Column:
    """An absolute path without empty, "." and ".." parts."""
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.regexp_replace(a, "/[^/]*$", "")).otherwise(F.concat(a, F.lit("/"), p))
    out = F.aggregate(F.split(path, "/"), F.lit(""), step)
    return F.when(out == "", F.lit("/")).otherwise(out)


def uri_path(uri: Column) -> Column:
    """The normalized path of a file URI on this host; null for others and for bad escapes.

    "+" stands for itself, so it is protected from the form decoding of the built-in.
    """
    rest = F.regexp_extract(uri, "^file://(?:localhost)?(/.*)$", 1)
    return F.when(rest != "", normalize(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))))


def ancestors(path: Column) -> Column:
    """All proper directories above a path, from the top one down."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
