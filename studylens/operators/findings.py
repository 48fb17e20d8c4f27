"""The findings table, one row per issue, and the fused emitter that fills it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted

FINDINGS = T.StructType(
    [
        T.StructField("finding_type", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("usubjid", T.StringType()),
        T.StructField("evidence", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Hit:
    """One possible finding of a row, emitted where ``mask`` is true.

    ``mask``, ``row_index``, ``usubjid`` and ``evidence`` are SQL expressions, and so are
    ``field_sql`` and ``message_sql``, for texts that vary by row. The defaults describe
    a finding about the data set as a whole.
    """

    mask: str
    finding_type: str
    rule_id: str
    severity: str
    domain: str
    field: str
    message: str
    row_index: str = "-1"
    usubjid: str = "''"
    evidence: str = "''"
    field_sql: str | None = None
    message_sql: str | None = None

    def as_struct(self) -> str:
        values = [
            quoted(self.finding_type),
            quoted(self.rule_id),
            quoted(self.severity),
            quoted(self.domain),
            self.field_sql or quoted(self.field),
            self.message_sql or quoted(self.message),
            self.row_index,
            self.usubjid,
            self.evidence,
        ]
        typed = [
            f"'{f.name}', CAST({value} AS {f.dataType.simpleString()})"
            for f, value in zip(FINDINGS.fields, values, strict=True)
        ]
        return f"named_struct({', '.join(typed)})"


def found(hits: Sequence[Hit]) -> str:
    """SQL for the array of findings that a row gives rise to."""
    return f"array_compact(array({', '.join(f'CASE WHEN {h.mask} THEN {h.as_struct()} END' for h in hits)}))"


def emit(df: DataFrame, hits: Sequence[Hit], carry: Sequence[str] = ()) -> DataFrame:
    """All findings of all ``hits`` in one narrow pass over ``df``.

    A union of one filter per rule would scan the input once per rule. Here rows
    that break no rule are dropped by one codegen filter, and only the rest build
    the array of findings. The outer form of ``inline`` spares a second evaluation of
    that array, which Catalyst would add as a filter on its size.
    """
    if not hits:
        nothing = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in FINDINGS.fields]
        return df.filter("FALSE").selectExpr(*carry, *nothing)
    broken = " OR ".join(f"({h.mask})" for h in hits)
    return df.filter(broken).selectExpr(*carry, f"inline_outer({found(hits)})")


def unpack(df: DataFrame, notes: str, carry: Sequence[str]) -> DataFrame:
    """Findings kept in an array column, as rows; like ``emit``, without computing the array twice."""
    return df.selectExpr(*carry, f"inline_outer({notes})").filter("rule_id IS NOT NULL")


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDINGS)


def dataset_finding(
    spark: SparkSession, finding_type: str, rule_id: str, severity: str, domain: str, field: str, message: str, evidence: str = ""
) -> DataFrame:
    """One finding about a whole table (row -1)."""
    return spark.createDataFrame(
        [(finding_type, rule_id, severity, domain, field, message, -1, "", evidence)], FINDINGS
    )


def conform(df: DataFrame, domain: str | None = None) -> DataFrame:
    """Any findings-like table brought to the nine columns; what is missing is filled."""
    fill = {"domain": domain or "", "usubjid": "", "evidence": "", "row_index": -1}
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(fill.get(f.name))).cast(f.dataType).alias(f.name)
            for f in FINDINGS.fields
        ]
    )


def merge(spark: SparkSession, parts: Iterable[DataFrame | None]) -> DataFrame:
    """UNION ALL of findings tables; parts that are None or have no columns are left out."""
    kept = [p for p in parts if p is not None and p.columns]
    return reduce(DataFrame.unionByName, kept) if kept else no_findings(spark)


def summarize(findings: DataFrame) -> DataFrame:
    """Findings per domain, severity and rule."""
    return findings.groupBy("domain", "severity", "rule_id").agg(
        F.count(F.lit(1)).alias("n_findings"), F.countDistinct("usubjid").alias("n_subjects")
    )
