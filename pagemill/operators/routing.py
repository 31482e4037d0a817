"""Ordered rules that choose how a document is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Routing


def strategy(r: Routing = DEFAULT.routing) -> Column:
    """First rule that holds; over the columns of document_scores, pdf_type and risk."""
    return (
        F.when(F.col("has_tables") | F.col("has_figures"), "vision_structured")
        .when((F.col("risk") > r.risk) | F.col("has_handwriting"), "ocr_advanced")
        .when((F.col("pdf_type") == "born_digital") & (F.col("degradation") > r.fast_quality) & F.col("simple"), "ocr_fast")
        .when((F.col("pdf_type") == "image_only") & F.col("simple"), "vision_simple")
        .otherwise("ocr_advanced")
    )


def rationale(r: Routing = DEFAULT.routing) -> Column:
    return (
        F.when(F.col("has_tables") | F.col("has_figures"), F.concat_ws("+", F.when(F.col("has_tables"), "tables"), F.when(F.col("has_figures"), "figures")))
        .when((F.col("risk") > r.risk) | F.col("has_handwriting"), F.concat_ws("+", F.when(F.col("risk") > r.risk, "risk"), F.when(F.col("has_handwriting"), "handwriting")))
        .when((F.col("pdf_type") == "born_digital") & (F.col("degradation") > r.fast_quality) & F.col("simple"), "clean born-digital text")
        .when((F.col("pdf_type") == "image_only") & F.col("simple"), "simple scan")
        .otherwise(F.concat(F.lit("fallback for "), F.col("pdf_type")))
    )


def psm(r: Routing = DEFAULT.routing) -> tuple[Column, Column]:
    """Page segmentation mode and confidence, by the first rule that holds."""
    rules = (
        (F.col("orientation_confidence") < r.orientation, 1, 0.7),
        (F.col("is_sparse") & (F.col("element_count") < r.sparse_elements), 11, 0.8),
        (F.col("has_tables"), 6, 0.85),
        (F.col("layout_type") == "single_column", 6, 0.9),
        (F.col("layout_type") == "multi_column", 3, 0.9),
        (F.col("has_handwriting"), 6, 0.75),
    )
    mode, sure = F.lit(3), F.lit(0.6)
    for holds, m, c in reversed(rules):
        mode, sure = F.when(holds, m).otherwise(mode), F.when(holds, c).otherwise(sure)
    return mode, sure


def degradation_severity(low: float = 0.4) -> dict[str, Column]:
    """complex for a camera or at least two indicators; bleed-through is a reason but no indicator."""
    camera = F.col("capture").isin("smartphone", "camera")
    flags = {"low_quality": F.col("quality") < low, "shadows": F.col("has_shadows"), "warping": F.col("has_warping"), "handwriting": F.col("has_handwriting")}
    count = sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags.values()), F.lit(0))
    two = 0.70 + F.coalesce(F.least(F.abs(F.col("quality") - low) * 0.20, F.lit(0.10)), F.lit(0.0))
    sure = F.when(camera, F.least(F.lit(1.0), 0.90 + count * 0.025)).when(count == 0, 0.95).when(count == 1, 0.80).when(count == 2, two).otherwise(F.least(F.lit(1.0), 0.85 + (count - 3) * 0.05))
    reasons = F.array_compact(F.array(F.when(camera, "camera"), *(F.when(f, name) for name, f in flags.items()), F.when(F.col("has_bleed_through"), "bleed_through")))
    return {"severity": F.when(camera | (count >= 2), "complex").otherwise("simple"), "indicators": count, "confidence": sure, "reasons": reasons}


def escalation_reasons(r: Routing = DEFAULT.routing) -> Column:
    """Why a document goes to a vision-language model, in fixed order; over the columns of a document's first page and scores."""
    return F.array_compact(
        F.array(
            F.when(F.col("first_handwriting"), "handwriting"),
            F.when(1 - F.col("degradation") >= r.low_quality, "low_quality"),
            F.when(F.col("script_confidence") < r.script_confidence, "low_script_confidence"),
            F.when(F.col("severity") == "complex", "complex_degradation"),
            F.when(F.col("first_warping") > r.warping, "extreme_warping"),
            F.when((F.col("n_pages") >= 2) & (F.col("n_angles") > 1), "mixed_orientation"),
        )
    )


def teacher_device(of_document: Column, of_batch: Column, hours: Column, local: Column, remote: Column, cpu: Column, per_document: int = 10, per_batch: int = 100, per_month: float = 10.0) -> Column:
    """Device of the large model: a budget that is used up blocks it, then come the local one, the remote one, and the CPU where it's allowed."""
    spent = F.when(of_document >= per_document, "blocked: document").when(of_batch >= per_batch, "blocked: batch").when(hours >= per_month, "blocked: month")
    return spent.when(local, "cuda").when(remote, "modal").when(cpu, "cpu").otherwise("blocked: no device")


def student_device(local: Column, forced: Column | None = None) -> Column:
    """Device of the small model: the forced one, unless it's remote, else the local one, else the CPU."""
    plain = F.when(local, "cuda").otherwise("cpu")
    return plain if forced is None else F.when(forced == "modal", "blocked: local only").otherwise(F.coalesce(forced, plain))


def pdf_type(n_chars: Column, n_images: Column, least: int = 100, most: int = 500) -> Column:
    return F.when((n_chars > most) & (n_images == 0), "born_digital").when((n_chars < least) & (n_images > 0), "image_only").otherwise("hybrid")


def detector_confidence(votes: Column) -> Column:
    """point, lower, upper, variance, agreement, reason of the votes (language, confidence) of a text's detectors; votes of no confidence count for the language only.

    Mean and variance meet their thresholds rounded to nine digits, so that a sum's last bit doesn't decide.
    """
    sure = F.filter(F.transform(votes, lambda v: v["confidence"]), lambda c: c > 0)
    n = F.size(sure)
    total = F.aggregate(sure, F.lit(0.0), lambda a, c: a + c)
    mean = total / n
    var = F.aggregate(sure, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean)) / n
    agree = F.size(F.array_distinct(F.filter(F.transform(votes, lambda v: v["language"]), lambda x: x != "und"))) <= 1
    reason = F.when(F.size(votes) == 0, "no_detector_votes").when(n == 0, "zero_confidence_votes").when(F.round(mean, 9) < 0.6, "low_confidence").when(F.round(var, 9) > 0.3, "high_variance").when(~agree, "detector_disagreement")
    known = n > 0
    return F.struct(F.when(known, mean).alias("point"), F.when(known, F.array_min(sure)).otherwise(0.0).alias("lower"), F.when(known, F.array_max(sure)).alias("upper"), F.when(known, var).otherwise(1.0).alias("variance"), (known & agree).alias("agreement"), reason.alias("reason"))
