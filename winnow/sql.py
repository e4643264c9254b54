"""The engine's functions by name in SQL.

``register(spark)`` makes temporary functions of a session. The scalar ones are SQL expressions with RETURN:
Catalyst puts their bodies in place of the calls, so that filters on them are pushed down as any others. The
table function ``winnow_text_units`` runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from winnow.functions import content as C
from winnow.functions import paths as P
from winnow.functions import text as X
from winnow.limits import LIMITS
from winnow.operators.units import split_source


def literal(s: str) -> str:
    """A pattern or text as a SQL literal, its backslashes as they stand."""
    return "r'" + s + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(xs) -> str:
    return ", ".join(literal(x) for x in xs)


def _byte(b: str, i: str) -> str:
    """Whether the byte at 0-based i continues a character."""
    return f"coalesce(conv(nullif(hex(substr({b}, {i} + 1, 1)), ''), 16, 10) & 192 = 128, false)"


def _language() -> str:
    last = r"element_at(split(path, r'\.'), -1)"
    names = dict.fromkeys(P.LANGUAGES.values())
    cases = " ".join(f"WHEN {last} IN ({_list(k for k, v in P.LANGUAGES.items() if v == n)}) THEN '{n}'" for n in names)
    return f"CASE WHEN NOT contains(path, '.') THEN 'text' {cases} ELSE 'text' END"


_RAW = "CAST(t AS BINARY)"
_HEAD = " ".join(f"WHEN n >= {k} AND NOT {_byte(_RAW, f'(n - {k})')} THEN n - {k}" for k in range(4))

#: Name: parameters, type, body.
FUNCTIONS = {
    "winnow_extension": ("path STRING", "STRING", r"regexp_extract(element_at(split(path, '/'), -1), r'^.+(\.[^.]*)$', 1)"),
    "winnow_language": ("path STRING", "STRING", _language()),
    "winnow_parent": ("path STRING", "STRING", "regexp_extract(path, '^(.*)/[^/]*$', 1)"),
    "winnow_depth": ("path STRING", "BIGINT", "CAST(IF(path = '', 0, size(split(path, '/'))) AS BIGINT)"),
    "winnow_is_sensitive": ("name STRING", "BOOLEAN", f"lower(name) IN ({_list(P.SENSITIVE)}) OR startswith(lower(name), '.env.')" + "".join(f" OR endswith(lower(name), '{e}')" for e in P.SENSITIVE_ENDS)),
    "winnow_is_binary": ("t STRING", "BOOLEAN", f"t RLIKE {literal(C.CONTROL)}"),
    "winnow_has_private_key": ("t STRING", "BOOLEAN", f"t RLIKE {literal(C.PRIVATE_KEY)}"),
    "winnow_read_status": ("t STRING", "STRING", f"CASE WHEN octet_length(t) > {LIMITS.file_bytes} THEN 'size_limit' WHEN winnow_is_binary(t) THEN 'binary' WHEN NOT is_valid_utf8(t) THEN 'encoding' WHEN winnow_has_private_key(t) THEN 'private_key' ELSE 'ok' END"),
    "winnow_sanitize_label": ("s STRING", "STRING", "regexp_replace(s, '[^A-Za-z0-9_-]', '_')"),
    "winnow_shell_quote": ("s STRING", "STRING", r"""concat("'", replace(s, "'", "'\\''"), "'")"""),
    "winnow_identifiers": ("s STRING", "ARRAY<STRING>", f"array_distinct(regexp_extract_all(s, {literal(X.IDENTIFIER)}, 0))"),
    "winnow_clip": ("t STRING, n INT", "STRING", f"IF(octet_length(t) <= n, t, decode(substr({_RAW}, 1, CASE {_HEAD} ELSE 0 END), 'UTF-8'))"),
    "winnow_byte_slice": ("t STRING, a BIGINT, z BIGINT", "STRING", f"decode(substr({_RAW}, CAST(a + 1 AS INT), CAST(z - a AS INT)), 'UTF-8')"),
    "winnow_token_estimate": ("size BIGINT, questions BIGINT", "BIGINT", f"least(size + {LIMITS.token_base} + {LIMITS.token_question} * questions, {LIMITS.token_cap})"),
    "winnow_retry_after": ("s STRING", "DOUBLE", "CASE WHEN try_cast(s AS DOUBLE) >= 0 AND try_cast(s AS DOUBLE) < double('infinity') THEN try_cast(s AS DOUBLE) END"),
    "winnow_failure_code": ("failure STRING", "STRING", "CASE " + " ".join(f"WHEN failure = '{k}' THEN '{v}'" for k, v in X.FAILURE_CODES.items()) + " END"),
    "winnow_utc_stamp": ("t TIMESTAMP_NTZ", "STRING", "date_format(t, \"yyyyMMdd'T'HHmmss.SSSSSS'Z'\")"),
    "winnow_rfc3339": ("t TIMESTAMP_NTZ", "STRING", "date_format(t, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"),
}


@arrow_udtf(returnType="doc_id long, ord long, byte_start long, byte_end long, start_line long, end_line long, partial boolean")
class TextUnits:
    """The pieces of texts: rows of (doc_id, text), in that order. A text is whole in its row, so the table needs
    no PARTITION BY and its texts no shuffle; with one the rows are the same. A null text has no pieces."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        out = pa.schema([(c, pa.int64()) for c in ("doc_id", "ord", "byte_start", "byte_end", "start_line", "end_line")] + [("partial", pa.bool_())])
        for i in range(rows.num_rows):
            key, text = rows.column(0)[i].as_py(), rows.column(1)[i].as_py()
            units = split_source(text or "", LIMITS.fallback_unit_bytes)
            n = len(units)
            columns = [[key] * n, range(n), [u.byte_start for u in units], [u.byte_end for u in units], [u.start_line for u in units], [u.end_line for u in units], [u.partial for u in units]]
            if n:
                yield pa.table([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("winnow_text_units", TextUnits)
