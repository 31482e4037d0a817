"""Boxes, paper sizes, resolution scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Paper sizes in millimetres, in the order in which ties are decided.
PAPERS = (
    ("A0", 841, 1189), ("A1", 594, 841), ("A2", 420, 594), ("A3", 297, 420), ("A4", 210, 297), ("A5", 148, 210), ("A6", 105, 148), ("B4", 250, 353), ("B5", 176, 250),
    ("LETTER", 215.9, 279.4), ("LEGAL", 215.9, 355.6), ("TABLOID", 279.4, 431.8), ("LEDGER", 431.8, 279.4), ("EXECUTIVE", 184.2, 266.7), ("HALF_LETTER", 139.7, 215.9),
)

#: Height in pixels and score.
KNOTS = ((0, 0.0), (16, 0.15), (24, 0.35), (32, 0.55), (48, 0.75), (64, 0.85), (96, 0.95))


def to_coco(a: Column, b: Column, c: Column, d: Column, form: str, width: float = 1.0, height: float = 1.0) -> tuple[Column, ...]:
    """x, y, width, height of a box given as coco, xyxy or yolo (centre and size as shares)."""
    if form == "coco":
        return a, b, c, d
    if form == "xyxy":
        return a, b, c - a, d - b
    return (a - c / 2) * width, (b - d / 2) * height, c * width, d * height


def from_coco(x: Column, y: Column, w: Column, h: Column, form: str, width: float = 1.0, height: float = 1.0) -> tuple[Column, ...]:
    if form == "coco":
        return x, y, w, h
    if form == "xyxy":
        return x, y, x + w, y + h
    return (x + w / 2) / width, (y + h / 2) / height, w / width, h / height


def paper_size(df: DataFrame, width_mm: Column, height_mm: Column, tolerance: float = 0.03) -> DataFrame:
    """df with paper and confidence: the nearest size whose sides both are within the tolerance, turned upright; null without one."""
    short, long = F.least(width_mm, height_mm), F.greatest(width_mm, height_mm)
    found = []
    for k, (name, a, b) in enumerate(PAPERS):
        s, g = float(min(a, b)), float(max(a, b))
        off = F.greatest(F.abs(short - s) / s, F.abs(long - g) / g)
        found.append(F.when(off <= tolerance, F.struct(off.alias("off"), F.lit(k).alias("k"), F.lit(name).alias("name"))))
    best = F.array_min(F.array_compact(F.array(*found)))
    return df.withColumn("_b", best).withColumns({"paper": F.col("_b.name"), "confidence": 1 - F.col("_b.off") / tolerance * 0.5}).drop("_b")


def resolution_score(height: Column) -> Column:
    """Linear between the knots, then 0.05 for each 200 pixels, at most 1; 0 below the first."""
    out = F.least(F.lit(1.0), 0.95 + (height - 96) / 200 * 0.05)
    for (x0, y0), (x1, y1) in reversed(tuple(zip(KNOTS, KNOTS[1:], strict=False))):
        out = F.when(height < x1, y0 + (height - x0) / (x1 - x0) * (y1 - y0)).otherwise(out)
    return F.when(height < KNOTS[0][0], 0.0).otherwise(out)


#: Buckets of heights in pixels, each up to its bound.
BUCKETS = ((16, "needs_major_upscale"), (32, "needs_light_upscale"), (48, "optimal"), (96, "good"))


def height_bucket(height: Column) -> Column:
    """The bucket that holds a height; what none holds is oversized."""
    out = F.lit("oversized")
    for bound, name in reversed(BUCKETS):
        out = F.when(height < bound, name).otherwise(out)
    return F.when(height < 0, "oversized").otherwise(out)


def resolution(df: DataFrame, key: str, height: str, area: str, counted: str) -> DataFrame:
    """key, score, char_height (median by area), p25, p75, cv, bucket, method, confidence, review. A row of df is a region; counted tells whether its characters were measured.

    Regions of a page are few, so its window and percentiles hold a page's rows only.
    """
    w = Window.partitionBy(key)
    run = df.withColumns({"_upto": F.sum(area).over(w.orderBy(height).rangeBetween(Window.unboundedPreceding, 0)), "_all": F.sum(area).over(w)})
    middle = F.min(F.when(F.col("_upto") >= F.col("_all") / 2, F.col(height)))
    mean = F.avg(height)
    cv = F.round(F.when(mean > 0, F.stddev_pop(height) / mean).otherwise(0.0), 9)
    a = run.groupBy(key).agg(F.count("*").alias("n"), F.max(counted).alias("by_count"), middle.alias("char_height"), F.percentile(height, 0.25).alias("p25"), F.percentile(height, 0.75).alias("p75"), cv.alias("cv"))
    sure = F.round(F.least(F.lit(1.0), F.col("n") / 10) * F.greatest(F.lit(0.0), 1 - F.col("cv")) * F.when(F.col("by_count"), 1.0).otherwise(0.8), 4)
    a = a.withColumn("sure", sure)
    few = F.col("n") < 3
    return a.select(key, resolution_score(F.col("char_height")).alias("score"), "char_height", "p25", "p75", "cv", height_bucket(F.col("char_height")).alias("bucket"), F.when(F.col("by_count"), "stage_1_2").otherwise("stage_1_only").alias("method"), F.when(few, F.least("sure", F.lit(0.3))).otherwise(F.col("sure")).alias("confidence"), (few | (F.col("sure") < 0.4) | (F.col("cv") > 0.5)).alias("review"))
