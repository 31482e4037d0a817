"""Queries of page scores, document risk and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import quality, routing
from .fixtures import DOC_SCORES, DOCS, PAGES, RISKS, SCORED, documents, pages, table


def _risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_scores(pages(spark, sf_dir)).join(documents(spark, sf_dir), "doc_id").withColumn("risk", quality.pre_ocr_risk())


@query(f"""
WITH r AS ({RISKS})
SELECT doc_id, n_pages, round(degradation, 4) AS degradation, round(complexity, 6) AS complexity, round(risk, 4) AS risk,
  CASE WHEN has_tables OR has_figures THEN 'vision_structured' WHEN risk > 0.6 OR has_handwriting THEN 'ocr_advanced'
    WHEN pdf_type = 'born_digital' AND degradation > 0.8 AND simple THEN 'ocr_fast' WHEN pdf_type = 'image_only' AND simple THEN 'vision_simple' ELSE 'ocr_advanced' END AS strategy,
  CASE WHEN has_tables OR has_figures THEN concat_ws('+', CASE WHEN has_tables THEN 'tables' END, CASE WHEN has_figures THEN 'figures' END)
    WHEN risk > 0.6 OR has_handwriting THEN concat_ws('+', CASE WHEN risk > 0.6 THEN 'risk' END, CASE WHEN has_handwriting THEN 'handwriting' END)
    WHEN pdf_type = 'born_digital' AND degradation > 0.8 AND simple THEN 'clean born-digital text' WHEN pdf_type = 'image_only' AND simple THEN 'simple scan'
    ELSE 'fallback for ' || pdf_type END AS rationale
FROM r""")
def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _risky(spark, sf_dir)
    return r.select("doc_id", "n_pages", F.round("degradation", 4).alias("degradation"), F.round("complexity", 6).alias("complexity"), F.round("risk", 4).alias("risk"), routing.strategy().alias("strategy"), routing.rationale().alias("rationale"))


@query(f"""SELECT doc_id, page, source_id, round(degradation, 9) AS degradation, round(blur * 0.4::DOUBLE + noise * 0.3::DOUBLE + contrast * 0.3::DOUBLE, 9) AS simplified,
  round((degradation) * 0.7::DOUBLE + illumination * 0.3::DOUBLE, 9) AS blended FROM ({SCORED})""")
def dqs_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = quality.degradation_score()
    return pages(spark, sf_dir).select("doc_id", "page", "source_id", F.round(full, 9).alias("degradation"), F.round(quality.simplified_score(), 9).alias("simplified"), F.round(quality.blended(full, F.col("illumination")), 9).alias("blended"))


@query(f"SELECT doc_id, round(degradation, 4) AS degradation, round(complexity, 6) AS complexity, has_tables, has_figures, has_handwriting, simple, n_pages FROM ({DOC_SCORES})")
def dqs_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_scores(pages(spark, sf_dir)).withColumns({"degradation": F.round("degradation", 4), "complexity": F.round("complexity", 6)})


@query(f"SELECT doc_id, pdf_type, round(risk, 4) AS risk FROM ({RISKS})")
def pre_ocr_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risky(spark, sf_dir).select("doc_id", "pdf_type", F.round("risk", 4).alias("risk"))


@query(f"SELECT layout_type, count(*) AS pages, round(avg(complexity), 6) AS mean_complexity, round(max(complexity), 6) AS max_complexity FROM ({SCORED}) GROUP BY layout_type")
def structural_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = quality.structural_complexity(F.col("layout_type"))
    return pages(spark, sf_dir).groupBy("layout_type").agg(F.count("*").alias("pages"), F.round(F.avg(c), 6).alias("mean_complexity"), F.round(F.max(c), 6).alias("max_complexity"))


_ELEMENTS = "(has_tables::INT + has_figures::INT + has_dense_math::INT + has_handwriting::INT + CASE WHEN layout_type = 'multi_column' THEN 2 ELSE 0 END)"


def _elements():
    """Elements on a page: a flag each; headers and footers count as two."""
    return sum((F.col(c).cast("int") for c in ("has_tables", "has_figures", "has_dense_math", "has_handwriting")), F.lit(0)) + F.when(F.col("layout_type") == "multi_column", 2).otherwise(0)


@query(f"""
WITH p AS (SELECT *, {_ELEMENTS} AS element_count, complexity < 0.2 AS is_sparse FROM ({SCORED})),
r AS (SELECT CASE WHEN orientation_confidence < 0.5 THEN 1 WHEN is_sparse AND element_count < 5 THEN 11 WHEN has_tables THEN 6 WHEN layout_type = 'single_column' THEN 6 WHEN layout_type = 'multi_column' THEN 3
  WHEN has_handwriting THEN 6 ELSE 3 END AS psm,
  CASE WHEN orientation_confidence < 0.5 THEN 0.7 WHEN is_sparse AND element_count < 5 THEN 0.8 WHEN has_tables THEN 0.85 WHEN layout_type = 'single_column' THEN 0.9 WHEN layout_type = 'multi_column' THEN 0.9
  WHEN has_handwriting THEN 0.75 ELSE 0.6 END::DOUBLE AS confidence FROM p)
SELECT psm, confidence, count(*) AS pages FROM r GROUP BY ALL""")
def psm_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).withColumn("element_count", _elements()).withColumn("is_sparse", quality.structural_complexity(F.col("layout_type")) < 0.2)
    mode, sure = routing.psm()
    return p.groupBy(mode.alias("psm"), sure.alias("confidence")).agg(F.count("*").alias("pages"))


_SEVERITY = f"""
SELECT *, CASE WHEN source_id % 7 = 0 THEN 'smartphone' WHEN source_id % 7 = 1 THEN 'fax' ELSE 'scanner' END AS capture, illumination < 0.1 AS has_shadows, warping > 0.75 AS has_warping, contrast < 0.65 AS has_bleed_through
FROM ({SCORED})"""
_SEVERITY = f"SELECT *, (degradation < 0.4)::INT + has_shadows::INT + has_warping::INT + has_handwriting::INT AS indicators, capture = 'smartphone' AS is_camera FROM ({_SEVERITY})"


def _severity_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    capture = F.when(F.col("source_id") % 7 == 0, "smartphone").when(F.col("source_id") % 7 == 1, "fax").otherwise("scanner")
    return pages(spark, sf_dir).withColumns({"capture": capture, "quality": quality.degradation_score(), "has_shadows": F.col("illumination") < 0.1, "has_warping": F.col("warping") > 0.75, "has_bleed_through": F.col("contrast") < 0.65})


@query(f"""
SELECT doc_id, page, source_id, CASE WHEN is_camera OR indicators >= 2 THEN 'complex' ELSE 'simple' END AS severity, indicators,
  round(CASE WHEN is_camera THEN least(1.0::DOUBLE, 0.9::DOUBLE + indicators * 0.025::DOUBLE) WHEN indicators = 0 THEN 0.95 WHEN indicators = 1 THEN 0.8
    WHEN indicators = 2 THEN 0.7::DOUBLE + least(abs(degradation - 0.4::DOUBLE) * 0.2::DOUBLE, 0.1::DOUBLE) ELSE least(1.0::DOUBLE, 0.85::DOUBLE + (indicators - 3) * 0.05::DOUBLE) END, 6) AS confidence,
  concat_ws(',', CASE WHEN is_camera THEN 'camera' END, CASE WHEN degradation < 0.4 THEN 'low_quality' END, CASE WHEN has_shadows THEN 'shadows' END, CASE WHEN has_warping THEN 'warping' END,
    CASE WHEN has_handwriting THEN 'handwriting' END, CASE WHEN has_bleed_through THEN 'bleed_through' END) AS reasons
FROM ({_SEVERITY})""")
def degradation_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = routing.degradation_severity()
    return _severity_input(spark, sf_dir).select("doc_id", "page", "source_id", s["severity"].alias("severity"), s["indicators"].alias("indicators"), F.round(s["confidence"], 6).alias("confidence"), F.array_join(s["reasons"], ",").alias("reasons"))


_VLM = f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, source_id, height, area) AS k FROM ({_SEVERITY})),
f AS (SELECT doc_id, has_handwriting AS first_handwriting, warping AS first_warping, is_camera OR indicators >= 2 AS complex_first, complexity AS first_complexity, has_tables AS first_tables, has_dense_math AS first_math FROM p WHERE k = 1),
a AS (SELECT doc_id, count(DISTINCT CASE WHEN orientation_confidence > 0.5 THEN angle END) AS n_angles FROM p GROUP BY doc_id)
SELECT r.*, f.* EXCLUDE (doc_id), a.n_angles, concat_ws(',', CASE WHEN first_handwriting THEN 'handwriting' END, CASE WHEN 1 - degradation >= 0.6 THEN 'low_quality' END,
  CASE WHEN script_confidence < 0.55 THEN 'low_script_confidence' END, CASE WHEN complex_first THEN 'complex_degradation' END, CASE WHEN first_warping > 0.75 THEN 'extreme_warping' END,
  CASE WHEN n_pages >= 2 AND n_angles > 1 THEN 'mixed_orientation' END) AS reasons
FROM ({RISKS}) r JOIN f USING (doc_id) JOIN a USING (doc_id)"""


def _escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _severity_input(spark, sf_dir).withColumn("severity", routing.degradation_severity()["severity"]).withColumn("complexity", quality.structural_complexity(F.col("layout_type")))
    first = F.min(F.struct("page", "source_id", "height", "area", "has_handwriting", "warping", "severity", "complexity", "has_tables", "has_dense_math")).alias("f")
    one = p.groupBy("doc_id").agg(first, F.count_distinct(F.when(F.col("orientation_confidence") > 0.5, F.col("angle"))).alias("n_angles"))
    one = one.select("doc_id", F.col("f.has_handwriting").alias("first_handwriting"), F.col("f.warping").alias("first_warping"), F.col("f.severity").alias("severity"), F.col("f.complexity").alias("first_complexity"), F.col("f.has_tables").alias("first_tables"), F.col("f.has_dense_math").alias("first_math"), "n_angles")
    return _risky(spark, sf_dir).join(one, "doc_id").withColumn("reasons", routing.escalation_reasons())


@query(f"SELECT doc_id, CASE WHEN reasons = '' THEN 'standard' ELSE 'vlm' END AS pipeline, reasons FROM ({_VLM})")
def vlm_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _escalated(spark, sf_dir).select("doc_id", F.when(F.size("reasons") > 0, "vlm").otherwise("standard").alias("pipeline"), F.array_join("reasons", ",").alias("reasons"))


@query(f"""SELECT doc_id, NOT (degradation >= 0.9 AND pdf_type = 'born_digital') AS ocr_enabled, CASE WHEN NOT first_tables THEN 'default' WHEN first_complexity >= 0.6 THEN 'accurate' ELSE 'fast' END AS table_mode,
  first_math AS formula_enrichment, concat_ws(',', CASE WHEN degradation >= 0.9 AND pdf_type = 'born_digital' THEN 'text_layer' END, CASE WHEN reasons <> '' THEN 'vlm' END,
  CASE WHEN first_tables AND first_complexity >= 0.6 THEN 'tables_accurate' WHEN first_tables THEN 'tables_fast' END, CASE WHEN first_math THEN 'formulas' END) AS rule_trace FROM ({_VLM})""")
def docling_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    skip = (F.col("degradation") >= 0.9) & (F.col("pdf_type") == "born_digital")
    exact = F.col("first_complexity") >= 0.6
    trace = F.array_compact(F.array(F.when(skip, "text_layer"), F.when(F.size("reasons") > 0, "vlm"), F.when(F.col("first_tables") & exact, "tables_accurate").when(F.col("first_tables"), "tables_fast"), F.when(F.col("first_math"), "formulas")))
    return _escalated(spark, sf_dir).select("doc_id", (~skip).alias("ocr_enabled"), F.when(~F.col("first_tables"), "default").when(exact, "accurate").otherwise("fast").alias("table_mode"), F.col("first_math").alias("formula_enrichment"), F.array_join(trace, ",").alias("rule_trace"))


@query("""
WITH e AS (SELECT event_id, ts, user_id, value, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS of_document, count(*) OVER (PARTITION BY date_trunc('day', ts), user_id % 50 ORDER BY ts, event_id) - 1 AS of_batch FROM events)
SELECT event_id, CASE WHEN of_document >= 2 THEN 'blocked: document' WHEN of_batch >= 6 THEN 'blocked: batch' WHEN user_id % 20 = 7 AND value >= 250 THEN 'blocked: month' WHEN user_id % 3 = 0 THEN 'cuda' WHEN user_id % 5 <> 0 THEN 'modal' WHEN user_id % 2 = 0 THEN 'cpu' ELSE 'blocked: no device' END AS device FROM e""")
def device_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of pages for a document and a batch and of hours for a month, then the local device, the remote one, and the CPU where that is allowed."""
    day, order = F.date_trunc("day", "ts"), ("ts", "event_id")
    of_document = F.row_number().over(Window.partitionBy("user_id", day).orderBy(*order)) - 1
    of_batch = F.count("*").over(Window.partitionBy(day, F.col("user_id") % 50).orderBy(*order)) - 1
    e = table(spark, sf_dir, "events").withColumns({"of_document": of_document, "of_batch": of_batch})
    hours = F.when(F.col("user_id") % 20 == 7, F.col("value") / 25).otherwise(0.0)
    u = F.col("user_id")
    return e.select("event_id", routing.teacher_device(F.col("of_document"), F.col("of_batch"), hours, u % 3 == 0, u % 5 != 0, u % 2 == 0, per_document=2, per_batch=6).alias("device"))


@query(f"""
WITH d AS (SELECT doc_id, page, source_id, abs(blur - contrast) AS d1, abs(contrast - noise) AS d2, abs(illumination - blur) AS d3, abs(noise - artifacts) AS d4, abs(artifacts - illumination) AS d5 FROM ({PAGES})),
m AS (SELECT *, (d1 * 1.2::DOUBLE + d2 + d3 * 0.8::DOUBLE + d4 + d5 * 0.9::DOUBLE) / 4.9::DOUBLE AS aggregate, greatest(d1, d2, d3, d4, d5) AS largest FROM d)
SELECT doc_id, page, source_id, round(aggregate, 9) AS aggregate, round(largest, 9) AS largest,
  CASE largest WHEN d1 THEN 'blur' WHEN d2 THEN 'contrast' WHEN d3 THEN 'skew' WHEN d4 THEN 'noise' ELSE 'compression' END AS largest_head,
  concat_ws(',', CASE WHEN d1 >= 0.25 THEN 'blur' END, CASE WHEN d2 >= 0.3 THEN 'contrast' END, CASE WHEN d3 >= 0.2 THEN 'skew' END, CASE WHEN d4 >= 0.35 THEN 'noise' END, CASE WHEN d5 >= 0.35 THEN 'compression' END) AS heads,
  d1 >= 0.25 OR d2 >= 0.3 OR d3 >= 0.2 OR d4 >= 0.35 OR d5 >= 0.35 OR aggregate >= 0.25 AS escalate FROM m""")
def discrepancy_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def heads(**of: str):
        return F.struct(*(F.col(c).alias(h) for h, c in of.items()))

    p = pages(spark, sf_dir).withColumns({"ml": heads(blur="blur", contrast="contrast", skew="illumination", noise="noise", compression="artifacts"), "cl": heads(blur="contrast", contrast="noise", skew="blur", noise="artifacts", compression="illumination")})
    d = quality.discrepancies("ml", "cl")
    return p.select("doc_id", "page", "source_id", F.round(d["aggregate"], 9).alias("aggregate"), F.round(d["largest"], 9).alias("largest"), d["largest_head"].alias("largest_head"), F.array_join(d["heads"], ",").alias("heads"), d["escalate"].alias("escalate"))


@query(f"""
WITH v AS (SELECT doc_id, angle, count(*) AS votes, avg(orientation_confidence) AS mean FROM ({PAGES}) GROUP BY ALL),
t AS (SELECT *, sum(votes) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, angle) AS k FROM v)
SELECT doc_id, angle, votes, round(mean * votes / total, 6) AS confidence, votes * 2 > total AS consensus FROM t WHERE k = 1""")
def orientation_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plurality of the pages' angles, ties to the smaller one; confidence is the winners' mean times their share."""
    v = pages(spark, sf_dir).groupBy("doc_id", "angle").agg(F.count("*").alias("votes"), F.avg("orientation_confidence").alias("mean"))
    best = v.groupBy("doc_id").agg(F.max(F.struct("votes", (-F.col("angle")).alias("a"), "mean")).alias("b"), F.sum("votes").alias("total"))
    return best.select("doc_id", (-F.col("b.a")).alias("angle"), F.col("b.votes").alias("votes"), F.round(F.col("b.mean") * F.col("b.votes") / F.col("total"), 6).alias("confidence"), (F.col("b.votes") * 2 > F.col("total")).alias("consensus"))


@query(f"""WITH s AS (SELECT doc_id, page, source_id, greatest(0.0, least(1.0, illumination * 0.25::DOUBLE + blur * 0.20::DOUBLE + artifacts * 0.20::DOUBLE + (1 - least(1.0, warping)) * 0.15::DOUBLE + contrast * 0.20::DOUBLE)) AS score FROM ({PAGES}))
SELECT doc_id, page, source_id, round(score, 9) AS score, CASE WHEN score > 0.6::DOUBLE THEN 'scanner_flatbed' WHEN score > 0.4::DOUBLE THEN 'scanner_adf' WHEN score < 0.3::DOUBLE THEN 'camera_smartphone' ELSE 'unknown' END AS capture FROM s""")
def capture_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = quality.clip01(F.col("illumination") * 0.25 + F.col("blur") * 0.20 + F.col("artifacts") * 0.20 + (1 - F.least(F.lit(1.0), F.col("warping"))) * 0.15 + F.col("contrast") * 0.20)
    s = pages(spark, sf_dir).select("doc_id", "page", "source_id", score.alias("score"))
    return s.select("doc_id", "page", "source_id", F.round("score", 9).alias("score"), quality.capture_method(F.col("score")).alias("capture"))


@query("""SELECT CASE WHEN n_chars > 500 AND doc_id % 3 = 0 THEN 'born_digital' WHEN n_chars < 100 AND doc_id % 3 > 0 THEN 'image_only' ELSE 'hybrid' END AS pdf_type, count(*) AS documents FROM documents GROUP BY 1""")
def classify_pdf_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Much text and no images: born digital; little text and images: a scan."""
    return table(spark, sf_dir, "documents").groupBy(routing.pdf_type(F.col("n_chars"), F.col("doc_id") % 3).alias("pdf_type")).agg(F.count("*").alias("documents"))


@query(f"SELECT doc_id, page, source_id, round(blur * 0.35::DOUBLE + noise * 0.25::DOUBLE + contrast * 0.25::DOUBLE + artifacts * 0.15::DOUBLE, 9) AS text_layer_quality FROM ({PAGES})")
def text_layer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.weighted((("blur", 0.35), ("noise", 0.25), ("contrast", 0.25), ("artifacts", 0.15)))
    return pages(spark, sf_dir).select("doc_id", "page", "source_id", F.round(q, 9).alias("text_layer_quality"))
