"""Controlled terms kept outside the code."""

from __future__ import annotations

import json
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession


def read_codelists(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(codelist, term) from a JSON object of arrays; the built-in lists if no path is given."""
    if path is None:
        text = files("studylens.rules").joinpath("codelists.json").read_text("utf-8")
        lists = json.loads(text)
        return spark.createDataFrame([(c, t) for c, terms in lists.items() for t in terms], "codelist STRING, term STRING")
    whole = spark.read.text(path, wholetext=True)
    return whole.selectExpr("explode(from_json(value, 'MAP<STRING,ARRAY<STRING>>')) AS (codelist, terms)").selectExpr(
        "codelist", "explode(terms) AS term"
    )
