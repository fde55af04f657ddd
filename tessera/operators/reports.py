"""Reports of benchmark scenarios: checks against limits and against an earlier run, as tables and published files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.metrics import check_thresholds
from tessera.plans.publish import Publication


def long_values(summary: DataFrame, scenario: str, metrics: list[str]) -> DataFrame:
    """(scenario, metric, value) of a summary with a column for each metric."""
    return summary.select(F.col(scenario).alias("scenario"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_v")).select("scenario", "_v.*")


def compare(values: DataFrame, spec: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """One row per (scenario, metric) of ``spec`` (scenario, metric, max, min).

    Columns: value, max, min, ``verdict`` (pass, fail, or unknown without a value), ``baseline`` and ``change`` against the earlier
    values (scenario, metric, value); null where there is none.
    """
    checked = check_thresholds(values, spec)
    if baseline is None:
        met = checked.withColumn("baseline", F.lit(None).cast("double"))
    else:
        met = checked.join(baseline.select("scenario", "metric", F.col("value").alias("baseline")), ["scenario", "metric"], "left")
    return met.withColumn("change", F.col("value") - F.col("baseline")).select("scenario", "metric", "value", "max", "min", "verdict", "baseline", "change")


def verdicts(report: DataFrame) -> DataFrame:
    """One row per scenario: the numbers of its checks and of those that failed or are unknown, and ``passed`` if none failed."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias({"fail": "failed", "unknown": "unknown"}[v])
    return report.groupBy("scenario").agg(F.count("*").alias("checks"), n("fail"), n("unknown")).withColumn("passed", F.col("failed") == 0)


def markdown(report: DataFrame) -> DataFrame:
    """One row per line (section, scenario, metric, line) of the report as tables of Markdown, to be sorted by the first three."""
    number = lambda c: F.coalesce(F.regexp_replace(F.round(c, 4).cast("string"), r"\.0$", ""), F.lit("-"))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    limit = F.when(F.col("max").isNotNull(), F.concat(F.lit("<= "), number(F.col("max")))).otherwise(F.concat(F.lit(">= "), number(F.col("min"))))
    change = F.coalesce(F.concat(F.when(F.col("change") >= 0, "+").otherwise(""), number(F.col("change"))), F.lit("-"))
    details = report.select(F.lit(3).alias("section"), "scenario", "metric", row("scenario", "metric", number(F.col("value")), limit, F.upper("verdict"), number(F.col("baseline")), change).alias("line"))
    totals = verdicts(report).select(F.lit(1).alias("section"), "scenario", F.lit("").alias("metric"), row("scenario", F.col("checks").cast("string"), F.col("failed").cast("string"), F.when(F.col("passed"), "PASS").otherwise("FAIL")).alias("line"))
    heads = ["| scenario | checks | failed | verdict |", "|---|---|---|---|", "| scenario | metric | value | limit | verdict | baseline | change |", "|---|---|---|---|---|---|---|"]
    spark = report.sparkSession
    fixed = spark.createDataFrame([(0, "", "a", heads[0]), (0, "", "b", heads[1]), (2, "", "a", ""), (2, "", "b", heads[2]), (2, "", "c", heads[3])], "section int, scenario string, metric string, line string")
    return fixed.union(totals).union(details)


def publish_report(spark: SparkSession, out: str, values: DataFrame, spec: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Publishes a benchmark's ``values``, ``checks`` (JSON) and ``report`` (Markdown, one file) at ``out``, instead of an earlier run, and returns the manifest.

    The values are what a later run takes as its baseline: ``read_values``.
    """
    run = Publication(spark, out, overwrite=True)
    report = compare(values, spec, baseline)
    values.select("scenario", "metric", "value").write.json(f"{run.folder}/values")
    report.write.json(f"{run.folder}/checks")
    markdown(report).orderBy("section", "scenario", "metric").select("line").coalesce(1).write.text(f"{run.folder}/report")
    return run.commit()


def read_values(spark: SparkSession, out: str) -> DataFrame:
    """(scenario, metric, value) of a published benchmark."""
    return spark.read.schema("scenario string, metric string, value double").json(f"{out.rstrip('/')}/values")
