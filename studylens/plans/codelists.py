"""Values of coded columns that a codelist table does not hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import outside, quoted, text
from ..operators.keyed import rows_of_keys
from ..operators.materialize import materialize
from ..operators.rowid import ROW_INDEX


# Up to this many terms are written into the filter itself.
INLINE_TERMS = 10_000


def codelist_violations(
    df: DataFrame, codelists: DataFrame, fields: Sequence[str], inline_terms: int = INLINE_TERMS
) -> DataFrame:
    """(row_index, field, value) for every value outside the codelist named like its column.

    Columns that are absent or have no codelist are skipped, and so are null values and null terms. Ordinary codelists become a
    hash-set filter in one narrow pass. Larger ones are compared with the distinct values,
    and the rows of the offending values are fetched afterwards.
    """
    fields = [f for f in fields if f in df.columns]
    terms = codelists.selectExpr("codelist AS field", "term AS value").filter(F.col("field").isin(fields) & F.col("value").isNotNull())
    few = terms.limit(inline_terms + 1).collect()
    if len(few) > inline_terms:
        return _against_many_terms(df, terms.distinct(), fields)
    allowed: dict[str, list[str]] = {}
    for field, value in few:
        allowed.setdefault(field, []).append(value)
    wrong = [
        f"CASE WHEN {outside(text(f), allowed[f])} THEN named_struct('field', {quoted(f)}, 'value', {text(f)}) END"
        for f in fields
        if f in allowed
    ]
    if not wrong:
        return df.filter("FALSE").selectExpr(ROW_INDEX, "'' AS field", "'' AS value")
    return df.selectExpr(ROW_INDEX, f"inline(array_compact(array({', '.join(wrong)})))")


def _against_many_terms(df: DataFrame, terms: DataFrame, fields: Sequence[str]) -> DataFrame:
    listed = {r["field"] for r in terms.select("field").distinct().collect()}  # at most len(fields) rows
    coded = [f for f in fields if f in listed]
    cells = ", ".join(f"{quoted(f)}, {text(f)}" for f in coded)
    values = df.selectExpr(ROW_INDEX, f"stack({len(coded)}, {cells}) AS (field, value)").filter("value IS NOT NULL")
    counts = values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("_rows"))
    offending = materialize(counts.join(terms, ["field", "value"], "left_anti"), "codelist-values")
    return rows_of_keys(values, offending, ["field", "value"], weight="_rows").select(ROW_INDEX, "field", "value")
