"""Page and document quality scores, extraction risk, and score comparisons, as columns. 1 is pristine throughout."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Discrepancy, QualityWeights


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def weighted(weights: tuple[tuple[str, float], ...]) -> Column:
    """Sum of columns times weights, in the order given."""
    return reduce(add, (F.col(name) * F.lit(w) for name, w in weights))


def degradation_score(w: QualityWeights = DEFAULT.quality) -> Column:
    return weighted(w.degradation)


def simplified_score(w: QualityWeights = DEFAULT.quality) -> Column:
    """The three-term score; skew plays no part in it."""
    return weighted(w.simplified)


def blended(classical: Column, overall: Column, w: QualityWeights = DEFAULT.quality) -> Column:
    return classical * w.blend[0] + overall * w.blend[1]


def structural_complexity(layout: Column, w: QualityWeights = DEFAULT.quality) -> Column:
    """Base by layout plus the features a page has, at most 1. A flag that is null counts as absent."""
    base = F.lit(w.layout_unknown)
    for name, value in reversed(w.layout_base):
        base = F.when(layout == name, value).otherwise(base)
    extra = reduce(add, (F.when(F.col(flag), value).otherwise(0.0) for flag, value in w.features))
    return F.least(F.lit(1.0), base + extra)


def document_scores(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """A document's degradation is the median of its pages', its complexity the largest."""
    scored = pages.withColumn("_d", degradation_score()).withColumn("_c", structural_complexity(F.col("layout_type")))
    return scored.groupBy(key).agg(
        F.percentile("_d", 0.5).alias("degradation"),
        F.max("_c").alias("complexity"),
        F.bool_or("has_tables").alias("has_tables"),
        F.bool_or("has_figures").alias("has_figures"),
        F.bool_or("has_handwriting").alias("has_handwriting"),
        F.bool_and(F.col("layout_type").isin("single_column", "multi_column")).alias("simple"),
        F.count("*").alias("n_pages"),
    )


def pre_ocr_risk(w: QualityWeights = DEFAULT.quality) -> Column:
    """Over degradation, complexity, pdf_type and has_handwriting of a document."""
    kind = F.when(F.col("pdf_type") == "image_only", w.risk_image_only).when(F.col("pdf_type") == "hybrid", w.risk_hybrid).otherwise(0.0)
    hand = F.when(F.col("has_handwriting"), w.risk_handwriting).otherwise(0.0)
    return F.least(F.lit(1.0), (1 - F.col("degradation")) * w.risk[0] + F.col("complexity") * w.risk[1] + kind + hand)


def blur_from_variance(variance: Column) -> Column:
    """Linear from a variance of 10 (0) to one of 500 (1)."""
    return clip01((variance - 10.0) / 490.0)


def discrepancies(model: str, classical: str, d: Discrepancy = DEFAULT.discrepancy) -> dict[str, Column]:
    """Comparison of two score structs with a field for each head; a missing score counts as 1."""
    diff = {h: F.abs(F.coalesce(F.col(f"{model}.{h}"), F.lit(1.0)) - F.coalesce(F.col(f"{classical}.{h}"), F.lit(1.0))) for h, _, _ in d.heads}
    total = sum(w for _, _, w in d.heads)
    mean = reduce(add, (diff[h] * w for h, _, w in d.heads)) / total
    largest = F.greatest(*diff.values())
    head = F.coalesce(*(F.when(diff[h] == largest, h) for h, _, _ in d.heads))
    over = F.array_compact(F.array(*(F.when(diff[h] >= t, h) for h, t, _ in d.heads)))
    return {"aggregate": mean, "largest": largest, "largest_head": head, "heads": over, "escalate": (F.size(over) >= 1) | (mean >= d.aggregate)}


def capture_method(score: Column, high: float = 0.6, middle: float = 0.4, camera: float = 0.3) -> Column:
    """How a page was captured, by how likely a scanner is."""
    return F.when(score > high, "scanner_flatbed").when(score > middle, "scanner_adf").when(score < camera, "camera_smartphone").otherwise("unknown")
