"""JSON expressions written as Spark SQL: kinds of values and last-wins lookups.

``from_json`` with a string target loses the difference between a text and another
value that reads alike, so kinds are told by typed attempts on the *parent* text, or by variants,
which keep each value's kind. Beside short names, these run only for documents that are not well-formed.
"""

from __future__ import annotations

from .text import quoted

STRINGS = "MAP<STRING,STRING>"
LIST = "ARRAY<STRING>"


def _class(name: str) -> str:
    return quoted(f"<class '{name}'>")


def is_class(x: str, name: str) -> str:
    return f"{x} = {_class(name)}"


def class_of_variant(v: str) -> str:
    """Kind of a value, in the notation findings use as evidence."""
    # 'OBJECT<a: BIGINT>' -> 'OBJECT'; integers beyond 64 bits come as decimals without a fraction.
    kind = (
        f"regexp_replace(regexp_replace(schema_of_variant({v}), '^DECIMAL[(](19|[23][0-9]),0[)]', 'BIGINT'),"
        " '[<(].*', '')"
    )
    classes = {
        "OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BOOLEAN": "bool", "BIGINT": "int",
        "DECIMAL": "float", "DOUBLE": "float", "FLOAT": "float",
    }
    known = ", ".join(f"'{k}', {_class(c)}" for k, c in classes.items())
    return f"coalesce(try_element_at(map({known}), {kind}), {_class('NoneType')})"


def variant_is(v: str, kind: str) -> str:
    """Whether a variant is of a scalar kind that needs no look inside, such as STRING."""
    return f"coalesce(schema_of_variant({v}) = '{kind}', FALSE)"


def truthy_variant(v: str) -> str:
    """False for null, and for empty, zero or false values."""
    # As JSON a text has its quotes, so only numbers can be cast.
    return (
        f"{v} IS NOT NULL AND to_json({v}) NOT IN ('null', 'false', '\"\"', '[]', '{{}}')"
        f" AND coalesce(try_cast(to_json({v}) AS DOUBLE) <> 0, TRUE)"
    )


def text_of_variant(v: str) -> str:
    """A text as it is, True as findings write it, any other value as JSON."""
    return f"CASE WHEN to_json({v}) = 'true' THEN 'True' ELSE variant_get({v}, '$', 'string') END"


def class_of_field(parent: str, field: str) -> str:
    """Kind of ``parent[field]``. Containers are tried by type, so only scalars become variants."""

    def read(kind: str) -> str:
        return f"from_json({parent}, '`{field}` {kind}').`{field}`"

    return (
        f"CASE WHEN {read(STRINGS)} IS NOT NULL THEN {_class('dict')}"
        f" WHEN {read(LIST)} IS NOT NULL THEN {_class('list')}"
        f" ELSE {class_of_variant(read('VARIANT'))} END"
    )


def truthy_field(parent: str, field: str) -> str:
    """False for an absent, null, empty, zero or false value."""
    scalar = f"from_json({parent}, '`{field}` STRING').`{field}`"
    kind = class_of_field(parent, field)
    return (
        f"CASE {kind}"
        f" WHEN {_class('dict')} THEN size(from_json({parent}, '`{field}` {STRINGS}').`{field}`) > 0"
        f" WHEN {_class('list')} THEN size(from_json({parent}, '`{field}` {LIST}').`{field}`) > 0"
        f" WHEN {_class('str')} THEN length({scalar}) > 0"
        f" WHEN {_class('bool')} THEN {scalar} = 'true'"
        f" WHEN {_class('NoneType')} THEN FALSE"
        f" ELSE try_cast({scalar} AS DOUBLE) <> 0 END"
    )


def entry(pairs: str, key: str) -> str:
    """Value of a key in an array of (key, value); the last of repeated keys wins, as in any JSON reader."""
    return f"try_element_at(filter({pairs}, p -> p.key = {key}), -1).value"


def field(map_: str, key: str) -> str:
    """The same for a map, by plain access as long as no key repeats."""
    return (
        f"CASE WHEN size(array_distinct(map_keys({map_}))) = size({map_})"
        f" THEN try_element_at({map_}, {quoted(key)})"
        f" ELSE {entry(f'map_entries({map_})', quoted(key))} END"
    )


def unique_entries(pairs: str) -> str:
    """One (key, value) per key: placed where the key first occurs, holding its last value."""
    keys = f"transform({pairs}, p -> p.key)"
    return (
        f"CASE WHEN size(array_distinct({keys})) = size({pairs}) THEN {pairs}"
        f" ELSE transform(array_distinct({keys}), k -> try_element_at(filter({pairs}, q -> q.key = k), -1)) END"
    )
