"""Lenient text expressions, written as Spark SQL.

Rules are SQL predicates: they stay inside the JVM and code generation, they can be
read as they are, and a rule costs one call to the JVM to set up. Bad input turns
into null rather than an error (ANSI mode is on, so a plain CAST would throw).
Arguments are SQL expressions of type string, unless said otherwise.
"""

from __future__ import annotations

# Unicode White_Space; Spark's own trim only knows U+0020.
WHITESPACE = "".join(
    chr(p)
    for p in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
# \z instead of $: Java's $ also matches before a trailing newline.
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INTEGER = r"^[+-]?[0-9]+\z"


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text(column: str) -> str:
    """Any column as string."""
    return f"CAST(`{column}` AS STRING)"


def stripped(x: str) -> str:
    return f"btrim({x}, {quoted(WHITESPACE)})"


def null_or_blank(x: str) -> str:
    """Most texts begin with a printable ASCII character, which a plain comparison settles."""
    return f"({x} IS NULL OR (NOT ({x} >= '!' AND {x} < '\x7f') AND {stripped(x)} = ''))"


def looks_like_iso_date(x: str) -> str:
    """Shape only: 2025-13-01 passes."""
    return f"{x} RLIKE {quoted(ISO_DATE)}"


def iso_date(x: str) -> str:
    """A calendar date written YYYY-MM-DD, else null.

    The pattern is checked first because a lenient cast alone would also take
    '2025', '2025-1-2' or a timestamp.
    """
    return f"CASE WHEN {x} RLIKE {quoted(ISO_DATE)} THEN try_cast({x} AS DATE) END"


def is_decimal(x: str) -> str:
    """A plain decimal literal; a cast alone would also take '1d', '0x1p3' or ' 5 '."""
    return f"({x} RLIKE {quoted(DECIMAL)})"


def decimal_number(x: str) -> str:
    return f"CASE WHEN {is_decimal(x)} THEN try_cast({x} AS DOUBLE) END"


def whole_number(x: str) -> str:
    return f"CASE WHEN {x} RLIKE {quoted(INTEGER)} THEN try_cast({x} AS BIGINT) END"


def decimal_comma(x: str) -> str:
    """'36,6' -> '36.6'; a thousands comma leaves two points and so no number."""
    return f"translate({x}, ',', '.')"


def outside(x: str, terms: list[str]) -> str:
    """Not one of the terms. Null stays null, so an empty cell never violates a codelist."""
    return f"{x} NOT IN ({', '.join(map(quoted, terms))})"


def joined(*parts: str) -> str:
    """Concatenation in which one null part makes the whole null."""
    return f"concat({', '.join(parts)})"
