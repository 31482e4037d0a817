"""Pages, documents and votes derived from the driver tables, with the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import clip01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each line item: scores from quantity, tax, discount and price, layout from the line number."""
    n = F.col("l_linenumber") % 5
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("page"),
        F.col("l_suppkey").alias("source_id"),
        (F.col("l_quantity") / 50).alias("blur"),
        clip01(1 - F.col("l_tax") * 5).alias("contrast"),
        clip01(1 - F.col("l_discount") * 5).alias("noise"),
        F.least(F.lit(1.0), F.col("l_extendedprice") / 100000).alias("illumination"),
        (1 - (F.col("l_partkey") % 10) / 10).alias("artifacts"),
        F.when(n == 0, "complex").when(n == 1, "single_column").when(n == 2, "multi_column").when(n == 3, "three_column").otherwise("unknown").alias("layout_type"),
        (F.col("l_returnflag") == "R").alias("has_tables"),
        (F.col("l_returnflag") == "A").alias("has_figures"),
        (F.col("l_discount") >= 0.09).alias("has_dense_math"),
        ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)).alias("has_handwriting"),
        (F.col("l_suppkey") % 4 * 90).cast("int").alias("angle"),
        ((F.col("l_partkey") % 100) / 100).alias("orientation_confidence"),
        (F.col("l_tax") * 12.5).alias("warping"),
        F.col("l_quantity").alias("height"),
        F.col("l_extendedprice").alias("area"),
    )


PAGES = """
SELECT l_orderkey AS doc_id, l_linenumber AS page, l_suppkey AS source_id, l_quantity / 50 AS blur,
  greatest(0.0, least(1.0, 1 - l_tax * 5)) AS contrast, greatest(0.0, least(1.0, 1 - l_discount * 5)) AS noise,
  least(1.0, l_extendedprice / 100000) AS illumination, 1 - (l_partkey % 10) / 10 AS artifacts,
  CASE l_linenumber % 5 WHEN 0 THEN 'complex' WHEN 1 THEN 'single_column' WHEN 2 THEN 'multi_column' WHEN 3 THEN 'three_column' ELSE 'unknown' END AS layout_type,
  l_returnflag = 'R' AS has_tables, l_returnflag = 'A' AS has_figures, l_discount >= 0.09::DOUBLE AS has_dense_math,
  l_linestatus = 'F' AND l_quantity > 45 AS has_handwriting, (l_suppkey % 4 * 90)::INT AS angle,
  (l_partkey % 100) / 100 AS orientation_confidence, l_tax * 12.5::DOUBLE AS warping, l_quantity AS height, l_extendedprice AS area
FROM lineitem"""

SCORED = f"""
SELECT *, blur * 0.30::DOUBLE + noise * 0.25::DOUBLE + contrast * 0.20::DOUBLE + illumination * 0.15::DOUBLE + artifacts * 0.10::DOUBLE AS degradation,
  least(1.0::DOUBLE, CASE layout_type WHEN 'single_column' THEN 0.1::DOUBLE WHEN 'multi_column' THEN 0.4::DOUBLE WHEN 'three_column' THEN 0.6::DOUBLE WHEN 'complex' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END
    + (CASE WHEN has_tables THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN has_figures THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN has_dense_math THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN has_handwriting THEN 0.10::DOUBLE ELSE 0 END)) AS complexity
FROM ({PAGES})"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pdf_type and priority of each order."""
    level = F.substring("o_orderpriority", 1, 1)
    kind = F.when(level.isin("1", "2"), "born_digital").when(level == "3", "hybrid").otherwise("image_only")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), kind.alias("pdf_type"), (F.col("o_custkey") % 100 / 100).alias("script_confidence"), F.col("o_totalprice").alias("total"))


DOCS = """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'born_digital' WHEN o_orderpriority[1] = '3' THEN 'hybrid' ELSE 'image_only' END AS pdf_type,
  o_custkey % 100 / 100 AS script_confidence, o_totalprice AS total FROM orders"""

DOC_SCORES = f"""
SELECT doc_id, quantile_cont(degradation, 0.5) AS degradation, max(complexity) AS complexity, bool_or(has_tables) AS has_tables, bool_or(has_figures) AS has_figures,
  bool_or(has_handwriting) AS has_handwriting, bool_and(layout_type IN ('single_column', 'multi_column')) AS simple, count(*) AS n_pages
FROM ({SCORED}) GROUP BY doc_id"""

RISKS = f"""
SELECT *, least(1.0::DOUBLE, (1 - degradation) * 0.4::DOUBLE + complexity * 0.3::DOUBLE + CASE pdf_type WHEN 'image_only' THEN 0.2::DOUBLE WHEN 'hybrid' THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN has_handwriting THEN 0.1::DOUBLE ELSE 0 END) AS risk
FROM ({DOC_SCORES}) JOIN ({DOCS}) USING (doc_id)"""
