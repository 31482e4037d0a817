"""Label forest, conversions between label schemas, script classes and licenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical roots and the children of each parent.
ROOTS = ("CAPTION", "FOOTNOTE", "FORMULA", "LIST_ITEM", "PAGE_FOOTER", "PAGE_HEADER", "PICTURE", "SECTION_HEADER", "TABLE", "TEXT", "TITLE")
CHILDREN = {
    "CAPTION": ("FIGURE_CAPTION", "TABLE_CAPTION", "FORMULA_CAPTION", "TABLE_NAME", "FIGURE_NAME"),
    "FOOTNOTE": ("TABLE_FOOTNOTE", "REFERENCE"),
    "FORMULA": ("ISOLATE_FORMULA", "EQUATION"),
    "LIST_ITEM": ("LIST_TEXT", "REGION_LIST", "DOCUMENT_INDEX", "CATALOG", "ORDERED_LIST", "UNORDERED_LIST"),
    "PAGE_FOOTER": ("PAGE_FOOTER_D4LA", "PAGE_NUMBER"),
    "PAGE_HEADER": ("PAGE_HEADER_D4LA", "LETTERHEAD"),
    "PICTURE": ("FIGURE", "CHART"),
    "SECTION_HEADER": ("PARA_TITLE", "REGION_TITLE"),
    "TEXT": ("PLAIN_TEXT", "PARA_TEXT", "OTHER_TEXT", "CODE", "HANDWRITTEN_TEXT", "PARAGRAPH", "KEY_VALUE_REGION", "LETTER_DEAR", "LETTER_SIGN", "ABSTRACT", "AUTHOR", "DATE", "NUMBER", "QUESTION", "ANSWER", "REGION_KV"),
    "TITLE": ("DOC_TITLE",),
    "FORM": ("CHECKBOX_SELECTED", "CHECKBOX_UNSELECTED", "GRADING_SCALE", "EMPTY_VALUE"),
}
#: Native labels of schemas and what they mean.
SCHEMAS = {
    "docstructbench": {"title": "TITLE", "plain text": "PLAIN_TEXT", "abandon": "ABANDONED", "figure": "FIGURE", "figure_caption": "FIGURE_CAPTION", "table": "TABLE", "table_caption": "TABLE_CAPTION", "table_footnote": "TABLE_FOOTNOTE", "isolate_formula": "ISOLATE_FORMULA", "formula_caption": "FORMULA_CAPTION"},
    "publaynet": {"Text": "TEXT", "Title": "TITLE", "List": "LIST_ITEM", "Table": "TABLE", "Figure": "FIGURE"},
    "funsd": {"text": "TEXT", "header": "SECTION_HEADER", "form_field_question": "QUESTION", "form_field_answer": "ANSWER"},
    "doclaynet": {"Caption": "CAPTION", "Footnote": "FOOTNOTE", "Formula": "FORMULA", "List-item": "LIST_ITEM", "Page-footer": "PAGE_FOOTER", "Page-header": "PAGE_HEADER", "Picture": "PICTURE", "Section-header": "SECTION_HEADER", "Table": "TABLE", "Text": "TEXT", "Title": "TITLE"},
}
#: Scripts of each model class, others are OTHER.
SCRIPT_CLASSES = {"LATN": ("Latn", "Latf", "Latg"), "CYRL": ("Cyrl", "Cyrs"), "GREK": ("Grek",), "ARAB": ("Arab", "Aran"), "HEBR": ("Hebr",), "DEVA": ("Deva",), "BENG": ("Beng",), "TAML": ("Taml",), "TELU": ("Telu",), "HANS": ("Hans", "Hani"), "HANT": ("Hant",), "JPAN": ("Jpan", "Hrkt", "Hira", "Kana"), "KORE": ("Kore", "Hang"), "THAI": ("Thai",), "TIBT": ("Tibt",), "INDIC_OTHER": ("Gujr", "Knda", "Mlym", "Orya", "Sinh", "Guru"), "SE_ASIAN_OTHER": ("Khmr", "Laoo", "Mymr"), "UNKNOWN": ("Zzzz",)}


def walk(parents: DataFrame, most: int = 64) -> DataFrame:
    """label, root, depth: each label's way up the parents (label, parent; null for a root). A label whose way ends in a cycle or at one that isn't there has no root.

    One join for each level, over the labels that aren't at a root yet; ways that come back to a label are dropped, so the loop ends.
    """
    up = parents.select(F.col("label").alias("at"), F.col("parent"), F.lit(True).alias("known"))
    todo = parents.select("label", F.col("label").alias("at"), F.lit(0).alias("depth"), F.array("label").alias("path"))
    out = None
    for _ in range(most):
        step = todo.join(up, "at", "left")
        ends = step.filter(F.col("parent").isNull()).select("label", F.when(F.col("known"), F.col("at")).alias("root"), "depth")
        out = ends if out is None else out.unionByName(ends)
        on = step.filter(F.col("parent").isNotNull())
        back = F.array_contains("path", F.col("parent"))
        out = out.unionByName(on.filter(back).select("label", F.lit(None).cast("string").alias("root"), F.col("depth")))
        todo = on.filter(~back).select("label", F.col("parent").alias("at"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("parent")).alias("path"))
        if todo.isEmpty():
            break
    return out


def forest(spark: SparkSession) -> DataFrame:
    """label, parent of the fixed forest."""
    rows = [(r, None) for r in [*ROOTS, "FORM"]] + [(c, p) for p, cs in CHILDREN.items() for c in cs]
    return spark.createDataFrame(rows, "label string, parent string")


def ancestors(spark: SparkSession) -> DataFrame:
    """label, root, depth of the fixed forest."""
    return walk(forest(spark))


def schema_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, n, c) for s, m in SCHEMAS.items() for n, c in m.items()], "schema string, native string, canonical string")


def convert(df: DataFrame, label: str, source: str, target: str) -> DataFrame:
    """df with converted, confidence and lossy: by the hub label; several targets give the first and 1 / n; without one the root's; else (unmapped).

    The tables joined are the fixed ones above.
    """
    spark = df.sparkSession
    t = schema_table(spark)
    hub = t.filter(F.col("schema") == source).select(F.col("native").alias(label), "canonical")
    back = t.filter(F.col("schema") == target).groupBy("canonical").agg(F.min("native").alias("to"), F.count("*").alias("n"))
    up = ancestors(spark).select(F.col("label").alias("canonical"), "root")
    via = back.select(F.col("canonical").alias("root"), F.col("to").alias("to_root"))
    out = df.join(F.broadcast(hub), label, "left").join(F.broadcast(back), "canonical", "left").join(F.broadcast(up), "canonical", "left").join(F.broadcast(via), "root", "left")
    direct = F.col("to").isNotNull()
    return out.withColumns({"converted": F.coalesce("to", "to_root", F.lit("(unmapped)")), "confidence": F.when(direct, 1 / F.col("n")).when(F.col("to_root").isNotNull(), 1.0).otherwise(0.0), "lossy": ~direct & F.col("to_root").isNotNull()}).drop("canonical", "to", "n", "root", "to_root")


def script_class(script: Column) -> Column:
    out = F.lit("OTHER")
    for name, codes in SCRIPT_CLASSES.items():
        out = F.when(script.isin(*codes), name).otherwise(out)
    return out


#: Fixed rules over small letters with - for white space, in order; the first that matches holds. Restrictions come before grants, and a permissive form has to be the whole text.
LICENSES = (
    ("mixed", r"^mixed"),
    ("unspecified", r"^(unknown|unspecified|none|null)"),
    ("non_commercial", r"(^|[^a-z])nc([^a-z]|$)|non-?commercial"),
    ("unspecified", r"(^|[^a-z])nd([^a-z]|$)|no-?deriv"),
    ("copyleft_gpl", r"(^|[^l])gpl"),
    ("research_only", r"research|academic"),
    ("share_alike", r"(^|[^a-z])sa([^a-z]|$)|sharing|odbl"),
    ("generated", r"^generated"),
    ("public_domain", r"^(cc0(-1\.0)?|public-domain|pd)$"),
    ("permissive", r"^(mit|apache-2\.0|bsd-[23]-clause|isc|ofl-1\.1|unlicense|cc-by-(2\.0|2\.5|3\.0|4\.0)|cdla-permissive-[12]\.0)$"),
)
#: Classes that a release may hold.
RELEASABLE = ("permissive", "public_domain", "share_alike", "generated")


def license_class(raw: Column) -> Column:
    """Class of a license text; what no rule knows is unspecified, never permissive."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"\s+", "-")
    out = F.lit("unspecified")
    for name, rule in reversed(LICENSES):
        out = F.when(text.rlike(rule), name).otherwise(out)
    return out


def collapsed(name: Column) -> Column:
    """A dataset's name in small letters and digits only, so that spellings match."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def with_license(df: DataFrame, dataset: str, licenses: DataFrame) -> DataFrame:
    """df with license (raw) and license_class by the collapsed name; datasets called synthetic have generated ones. licenses: dataset, license, a row for each dataset."""
    known = licenses.select(collapsed(F.col("dataset")).alias("_name"), F.col("license").alias("_raw")).groupBy("_name").agg(F.min("_raw").alias("_raw"))
    joined = df.withColumn("_name", collapsed(F.col(dataset))).join(known, "_name", "left")
    raw = F.coalesce("_raw", F.when(F.col("_name").startswith("synth"), "generated"))
    return joined.withColumn("license", raw).withColumn("license_class", license_class(raw)).drop("_name", "_raw")


def degradation_groups(vector: Column) -> dict[str, Column]:
    """Largest value of each group of the 45 degradations. Fixed ranges."""
    ranges = {"blur": (0, 6), "noise": (6, 13), "geometric": (13, 19), "illumination": (19, 26), "compression": (26, 30), "physical": (30, 37), "text": (37, 42), "scanner": (42, 45)}
    return {k: F.array_max(F.slice(vector, a + 1, b - a)) for k, (a, b) in ranges.items()}


#: Runtime issue of each of the 45 degradations.
ISSUES = {"blur": (0, 1, 2, 3, 4, 5, 38, 39), "noise": (6, 7, 8, 9, 10, 11, 12, 26, 27, 28, 31, 32, 33, 36, 40, 41, 42, 43), "skew": (13,), "orientation": (14,), "perspective": (15, 16, 17, 18, 35), "low_contrast": (19, 20, 21, 22, 23, 24, 25, 30, 34, 37, 44), "low_dpi": (29,)}


def vector_issues(df: DataFrame, key: str, vector: str, threshold: float = 0.3, least: float = 0.5) -> DataFrame:
    """key, issue, score, n, severity: values of the threshold or more by their issue, kept if the largest reaches least."""
    issue = F.map_from_entries(F.array(*(F.struct(F.lit(i), F.lit(name)) for name, at in ISSUES.items() for i in at)))
    each = df.select(key, F.posexplode(vector).alias("i", "x")).filter(F.col("x") >= threshold).select(key, F.element_at(issue, F.col("i")).alias("issue"), "x")
    g = each.groupBy(key, "issue").agg(F.max("x").alias("score"), F.count("*").alias("n")).filter(F.col("score") >= least)
    s = F.col("score")
    return g.withColumn("severity", F.when(s >= 0.8, "critical").when(s >= 0.6, "high").when(s >= 0.4, "medium").otherwise("low"))
