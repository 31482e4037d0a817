"""Coverage, value counts, rule rates, scorecards and comparisons of audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completeness(df: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """group, field, present, total, pct: one pass over the rows, then one row for each field."""
    wide = df.groupBy(group).agg(F.count("*").alias("total"), *(F.count(f).alias(f) for f in fields))
    return wide.unpivot([group, "total"], list(fields), "field", "present").select(group, "field", "present", "total", F.round(F.col("present") * 100 / F.col("total"), 4).alias("pct"))


def value_counts(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """facet, value, n, pct of several columns."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets))).alias("x")).select("x.*")
    counts = long.groupBy("facet", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("facet")), 1))


def rule_rates(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, passed, total, rate of SQL conditions."""
    wide = df.agg(F.count("*").alias("total"), *(F.count_if(F.expr(c)).alias(k) for k, c in rules.items()))
    return wide.unpivot(["total"], list(rules), "rule", "passed").select("rule", "passed", "total", F.round(F.col("passed") / F.col("total"), 6).alias("rate"))


def field_statistics(coverage: DataFrame, least: int = 3) -> DataFrame:
    """Statistics of pct by field, for fields that at least `least` groups have."""
    r = lambda c, name: F.round(c, 4).alias(name)
    return coverage.groupBy("field").agg(F.count("pct").alias("sources"), r(F.avg("pct"), "mean"), r(F.min("pct"), "lo"), r(F.max("pct"), "hi"), r(F.stddev_samp("pct"), "sd"), F.count_if(F.col("pct") < 75).alias("below")).filter(F.col("sources") >= least)


def overall(weights: dict[str, float], required: Sequence[str] = ()) -> Column:
    """Weighted mean of the dimensions that are there; 0 if a required one is missing."""
    total = reduce(add, (F.coalesce(F.col(d), F.lit(0.0)) * w for d, w in weights.items()))
    mass = reduce(add, (F.when(F.col(d).isNull(), 0.0).otherwise(w) for d, w in weights.items()))
    missing = reduce(lambda a, b: a | b, (F.col(d).isNull() for d in required), F.lit(False))
    return F.when(missing, 0.0).otherwise(total / mass)


def grade(score: Column) -> Column:
    return F.when(score >= 93, "A").when(score >= 85, "B").when(score >= 75, "C").when(score >= 65, "D").otherwise("F")


def chi_square(df: DataFrame, column: str) -> DataFrame:
    """Statistic of the counts of a column against equal counts."""
    c = df.groupBy(column).agg(F.count("*").alias("n")).withColumn("m", F.avg("n").over(Window.partitionBy()))
    return c.agg(F.round(F.sum(F.pow(F.col("n") - F.col("m"), 2) / F.col("m")), 6).alias("chi_square"), F.count("*").alias("kinds"))


def deltas(before: DataFrame, after: DataFrame, key: str, threshold: float = 0.02) -> DataFrame:
    """Change of rate by key; a missing side counts as 0."""
    a, b = before.withColumnRenamed("rate", "_a"), after.withColumnRenamed("rate", "_b")
    change = F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))
    return a.join(b, key, "full").select(key, F.round(change, 6).alias("delta"), (change > threshold).alias("regression"))
