"""Canonical JSON text: sorted keys, no spaces, ASCII only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quoted(text: Column) -> Column:
    """JSON string literal with everything outside printable ASCII escaped; null for a null."""
    def escape(c):
        code = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        u = F.concat(F.lit("\\u"), F.substring(code, 1, 4), F.when(F.length(code) > 4, F.concat(F.lit("\\u"), F.substring(code, 5, 4))).otherwise(""))
        return (F.when(c == '"', '\\"').when(c == "\\", "\\\\").when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t")
                .when(c == "\b", "\\b").when(c == "\f", "\\f").when(c.between(" ", "~"), c).otherwise(u))
    slow = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)")), escape), "")
    body = F.when(text.rlike(r'^[ !#-\[\]-~]*\z'), text).otherwise(slow)
    return F.concat(F.lit('"'), body, F.lit('"'))


def canonical(fields: dict[str, Column], numbers: set[str] = frozenset()) -> Column:
    """Object text of the fields in key order; strings are quoted, numbers are not, nulls are `null`."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(fields[k].cast("string") if k in numbers else quoted(fields[k]), F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
