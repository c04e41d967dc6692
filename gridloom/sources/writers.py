"""Writers: delimited text in row order, quality reports and templates as JSON. All go through Spark, to any store."""

from __future__ import annotations

import json

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..operators import profile
from ..plans.table import Table, run_count
from ..plans.template import Template

BOM = "﻿"


def write_delimited(t: Table, path: str, sep: str = ",") -> None:
    """Part files that, one after the other, are one file: a byte order mark, the header, and the rows in order; null is
    the empty text, and quotes within a cell are doubled. Rows move once, to parts by range, sized by what is read."""
    spark = t.df.sparkSession
    options = {"sep": sep, "escape": '"', "nullValue": "", "emptyValue": "", "quoteAll": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.to_csv(F.struct(*(F.col(c).cast("string").alias(c) for c in t.columns)), options)
    names = spark.range(0, 1, 1, 1).select(F.concat(F.lit(BOM), F.to_csv(F.struct(*(F.lit(c).alias(f"c{i}") for i, c in enumerate(t.columns))), options)).alias("value"))
    rows = t.df.repartitionByRange(run_count(t.df), *t.sort).sortWithinPartitions(*t.sort) if t.order else t.df
    names.union(rows.select(line.alias("value"))).write.text(path)  # a union's parts keep their order


def write_csv(t: Table, path: str) -> None:
    write_delimited(t, path)


def write_tsv(t: Table, path: str) -> None:
    write_delimited(t, path, "\t")


def write_txt(t: Table, path: str) -> None:
    write_delimited(t, path, "\t")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([Row(value=text)]).coalesce(1).write.text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).filter("value != ''").first()[0]


def quality_report(t: Table, name: str, rules: profile.Rules = profile.Rules()) -> dict:
    """Profile, issues and counters, whose size depends on the columns only."""
    issues = profile.quality_issues(t, rules)
    return {
        "dataset": name, "columns": [r.asDict() for r in profile.profile_columns(t, rules).collect()],
        "issues": [r.asDict() for r in issues.collect()], "overview": profile.overview(issues).first().asDict(),
    }


def write_quality_report(t: Table, name: str, path: str, rules: profile.Rules = profile.Rules()) -> None:
    write_text(t.df.sparkSession, json.dumps(quality_report(t, name, rules), ensure_ascii=False, default=str), path)


def save_template(spark: SparkSession, template: Template, path: str) -> None:
    write_text(spark, template.to_json(), path)


def load_template(spark: SparkSession, path: str) -> Template:
    return Template.from_json(read_text(spark, path))
