"""Other scalar functions of the search and capture tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.limits import LIMITS, Limits

IDENTIFIER = r"[_\p{L}\p{Nl}][_\p{L}\p{N}]*"
# Failure of a model request -> code told to the caller.
FAILURE_CODES = {"unauthorized": "provider_unavailable", "unavailable": "provider_unavailable", "timed_out": "provider_unavailable", "overloaded": "provider_unavailable", "too_large": "input_too_large", "invalid_response": "invalid_provider_response", "cancelled": "cancelled", "budget_exhausted": "budget_exhausted"}
# Issue kind, code, whether a file counts as skipped, whether the search stops.
ISSUES = (
    ("unreadable", "source_unreadable", True, False),
    ("size_limit", "input_too_large", True, False),
    ("changed", "source_changed", True, False),
    ("encoding", "unsupported_encoding", True, False),
    ("authentication", "provider_unavailable", False, True),
    ("budget", "budget_exhausted", False, True),
    ("cancelled", "cancelled", False, True),
    ("provider", "provider_unavailable", False, False),
    ("request_size", "input_too_large", False, False),
    ("resource_limit", "input_too_large", False, False),
    ("inspection_limit", "input_too_large", False, False),
)


def sanitize_label(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_-]", "_")


def shell_quote(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def identifiers(s: Column) -> Column:
    """Distinct identifier tokens."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(IDENTIFIER), F.lit(0)))


def json_bytes(*columns: Column) -> Column:
    return F.octet_length(F.to_json(F.struct(*columns))).cast("long")


def token_estimate(size: Column, questions: Column, limits: Limits = LIMITS) -> Column:
    return F.least(size + limits.token_base + limits.token_question * questions, F.lit(limits.token_cap)).cast("long")


def retry_after(s: Column) -> Column:
    """Seconds of a retry-after header; null unless finite and not negative."""
    x = s.try_cast("double")
    return F.when((x >= 0) & (x < float("inf")) & ~F.isnan(x), x)


def status_class(status: Column, error_type: Column | None = None) -> Column:
    """What an HTTP status means for a request."""
    too_large = (error_type == "max_tokens_exceeded") if error_type is not None else F.lit(False)
    return F.when(status == 200, "ok").when(status.isin(401, 403), "unauthorized").when((status == 400) & too_large, "too_large").when(status.isin(429, 529), "retry").otherwise("unavailable")


def failure_code(failure: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in FAILURE_CODES.items():
        out = F.when(failure == k, v).otherwise(out)
    return out


def rewritten(command: Column, folder: Column) -> Column:
    """A command whose output goes to the record's files and whose status is kept."""
    out, err = F.concat(folder, F.lit("/stdout.log")), F.concat(folder, F.lit("/stderr.log"))
    return F.concat(F.lit("{\n"), command, F.lit("\n} >"), shell_quote(out), F.lit(" 2>"), shell_quote(err))


def is_format_or_bytes(literal: Column) -> Column:
    """Whether a Python string literal's prefix makes it a format or bytes string."""
    return literal.rlike("(?i)^[rub]*[fb]")
