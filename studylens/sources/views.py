"""Study-shaped views over the benchmark tables: they give the rules real rows to judge.

The text is plain SQL that other engines read the same way, so a query and its
check start from the same rows. Every view takes in all rows of its table, or all
events of the types its domain stands for; remainders only plant faults.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# view -> (source table, columns, filter)
VIEWS = {
    "sdtm_dm": (
        "customer",
        """c_custkey AS row_index,
 CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 'STUDY001' END AS STUDYID,
 CASE WHEN c_custkey % 41 = 0 THEN '  ' WHEN c_custkey % 37 = 0 THEN 'S1' ELSE concat('S', CAST(c_custkey AS STRING)) END AS USUBJID,
 CASE WHEN c_custkey % 7 = 0 THEN 'X' WHEN c_custkey % 7 = 1 THEN 'U' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS SEX,
 CAST(CAST(floor(c_acctbal / 50) AS INT) AS STRING) AS AGE,
 CASE WHEN c_custkey % 11 = 0 THEN 'WEEKS' ELSE 'YEARS' END AS AGEU,
 CASE WHEN c_custkey % 17 = 0 THEN '2024-13-01' WHEN c_custkey % 43 = 0 THEN '2024/01/05' ELSE '2024-01-05' END AS RFSTDTC,
 CASE WHEN c_custkey % 19 = 0 THEN '2024-01-01' WHEN c_custkey % 23 = 0 THEN 'open' ELSE '2024-02-01' END AS RFENDTC""",
        "TRUE",
    ),
    "sdtm_vs": (
        "events",
        """event_id AS row_index,
 CASE WHEN event_id % 97 = 0 THEN NULL WHEN user_id % 13 = 0 THEN concat('X', CAST(user_id AS STRING)) ELSE concat('S', CAST(user_id AS STRING)) END AS USUBJID,
 CASE event_type WHEN 'click' THEN 'SYSBP' WHEN 'view' THEN 'HR' WHEN 'signup' THEN 'TEMP' ELSE 'GLUCOSE' END AS VSTESTCD,
 CASE WHEN event_id % 101 = 0 THEN 'abc' WHEN event_id % 103 = 0 THEN replace(CAST(value AS STRING), '.', ',') ELSE CAST(value AS STRING) END AS VSORRES,
 CASE WHEN event_id % 89 = 0 THEN 'kPa' WHEN event_type = 'click' THEN 'mmHg' WHEN event_type = 'view' THEN 'bpm' ELSE 'C' END AS VSORRESU,
 CASE WHEN event_id % 83 = 0 THEN '2024-13-01' WHEN user_id % 11 = 0 THEN '2024-01-15' ELSE substr(CAST(ts AS STRING), 1, 10) END AS VSDTC""",
        "event_type <> 'error'",
    ),
    "sdtm_ae": (
        "events",
        """event_id AS row_index,
 concat('S', CAST(user_id AS STRING)) AS USUBJID,
 CASE WHEN event_id % 29 = 0 THEN '  ' ELSE event_type END AS AETERM,
 CASE WHEN event_id % 43 = 0 THEN '2024-01-xx' ELSE substr(CAST(ts AS STRING), 1, 10) END AS AESTDTC,
 CASE WHEN event_id % 47 = 0 THEN '2023-12-31' WHEN event_id % 53 = 0 THEN 'ongoing' ELSE '2024-12-31' END AS AEENDTC,
 CASE WHEN event_id % 59 = 0 THEN 'Maybe' ELSE 'N' END AS AESER,
 CASE WHEN value > 100 THEN 'SEVERE' WHEN value > 50 THEN 'LOW' ELSE 'MILD' END AS AESEV""",
        "event_type = 'error'",
    ),
    "sdtm_cm": (
        "events",
        """event_id AS row_index,
 concat('S', CAST(user_id AS STRING)) AS USUBJID,
 CASE WHEN event_id % 61 = 0 THEN NULL ELSE event_type END AS CMTRT,
 CASE WHEN event_id % 67 = 0 THEN 'unk' ELSE substr(CAST(ts AS STRING), 1, 10) END AS CMSTDTC,
 CASE WHEN event_id % 71 = 0 THEN '2023-12-31' WHEN event_id % 73 = 0 THEN 'unk' ELSE '2024-01-20' END AS CMENDTC""",
        "event_type = 'purchase'",
    ),
    "visit_records": (
        "orders",
        """o_orderkey AS row_index,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_custkey % 120 AS STRING) END AS age,
 CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice / 2000) AS INT) AS STRING) END AS systolic_bp,
 CASE WHEN o_orderkey % 17 = 0 THEN '0' ELSE CAST(o_orderkey % 200 AS STRING) END AS treatment_dose,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS visit_date""",
        "TRUE",
    ),
}


def view_of(source: DataFrame, name: str) -> DataFrame:
    """The view over its source table, which may also be a stream."""
    _, columns, condition = VIEWS[name]
    return source.filter(condition).selectExpr(*[c.strip() for c in columns.split(",\n")])


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return view_of(spark.read.parquet(f"{folder}/{VIEWS[name][0]}.parquet"), name)


def view_sql(name: str) -> str:
    table, columns, condition = VIEWS[name]
    return f"SELECT {columns} FROM {table} WHERE {condition}"


def _items(columns: list[str]) -> str:
    return ",".join(f'{{"OID":"IT.{c}","name":"{c}"}}' for c in columns)


def study_documents(
    spark: SparkSession, folder: str, domains: list[str], block_rows: int = 100, records: dict[str, str] | None = None
) -> DataFrame:
    """Dataset-JSON documents (doc_id, doc) made of the views: one per block of row numbers.

    Blocks have a fixed number of row numbers, so documents stay small at any scale.
    ``records`` may give other SQL for a domain's records, to plant faults.
    """
    groups = []
    for domain in domains:
        rows = view(spark, folder, f"sdtm_{domain.lower()}")
        columns = [c for c in rows.columns if c != "row_index"]
        record = (records or {}).get(domain, f"to_json(array({', '.join(columns)}))")
        groups.append(
            rows.selectExpr(f"row_index div {block_rows} AS doc_id", "row_index", f"{record} AS record")
            .groupBy("doc_id")
            .agg(F.expr("array_sort(collect_list(named_struct('i', row_index, 'r', record)))").alias("records"))
            .selectExpr(
                "doc_id", f"{domains.index(domain)} AS place",
                f"concat('\"IG.{domain}\":{{\"name\":\"{domain}\",\"items\":[{_items(columns)}],\"itemData\":[',"
                " array_join(transform(records, x -> x.r), ','), ']}') AS body",
            )
        )
    bodies = reduce(DataFrame.unionByName, groups).groupBy("doc_id").agg(
        F.expr("array_sort(collect_list(named_struct('place', place, 'body', body)))").alias("bodies")
    )
    head = '{"creationDateTime":"2024-01-01T00:00:00","datasetJSONVersion":"1.1","clinicalData":{"itemGroupData":{'
    return bodies.selectExpr(
        "doc_id", f"concat('{head}', array_join(transform(bodies, b -> b.body), ','), '}}}}}}') AS doc"
    )
