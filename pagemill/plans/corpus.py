"""Queries of identities, splits, duplicates, coverage, audits and statistics over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import audit, splits
from .fixtures import table

_FRACTION = "('0x' || substr(sha256(text), 1, 16))::UBIGINT / 18446744073709551616.0::DOUBLE"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))


@query("SELECT doc_id, substr(sha256(concat_ws(':', source, doc_id::VARCHAR, sha256(text))), 1, 32) AS sample_id FROM documents")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", splits.sample_id(F.col("source"), F.col("doc_id").cast("string"), F.col("sha")).alias("sample_id"))


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


_SPLIT = f"CASE WHEN {_FRACTION} < 0.8 THEN 'train' WHEN {_FRACTION} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END"


@query(f"SELECT doc_id, round({_FRACTION}, 9) AS fraction, {_SPLIT} AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(splits.hash_fraction(F.col("sha")), 9).alias("fraction"), splits.hash_split(F.col("sha")).alias("split"))


@query(f"SELECT {_SPLIT} AS split, count(*) AS documents, count(DISTINCT text) AS texts FROM documents GROUP BY 1")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(splits.hash_split(F.col("sha")).alias("split")).agg(F.count("*").alias("documents"), F.count_distinct("sha").alias("texts"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return splits.leakage(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "sha").select("doc_id")


_ORDER = "sha256(concat('42:', doc_id))"


def _order():
    return F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256)


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(_docs(spark, sf_dir), "lang", _order()).select("doc_id", "lang", "split")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By position in each source, without a shuffle of the order."""
    return splits.stratified_split(_docs(spark, sf_dir), "source", F.col("doc_id")).select("doc_id", "split")


_ALLOC = """
SELECT lang, n, least(n, base + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS take FROM (
  SELECT *, 36 - sum(base) OVER () AS rest, row_number() OVER (ORDER BY quota - floor(quota) DESC, lang) AS k FROM (
    SELECT *, greatest(1, floor(quota)) AS base FROM (SELECT lang, n, n * 36 / sum(n) OVER () AS quota FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))))"""


@query(_ALLOC)
def audit_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.allocation(_docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")), "lang", 36)


@query(f"""WITH a AS ({_ALLOC}), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS k FROM documents)
SELECT doc_id, lang FROM r JOIN a USING (lang) WHERE k <= take""")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    takes = splits.allocation(docs.groupBy("lang").agg(F.count("*").alias("n")), "lang", 36)
    return splits.sample_per_stratum(docs, takes, "lang", _order()).select("doc_id", "lang")


_CODES = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN h ELSE xor(h, 5 << (doc_id % 20)::INT) END AS code FROM (SELECT doc_id, hash_n * 2654435761 % 1000000007 AS h FROM (SELECT doc_id, (doc_id // 3) * 7919 + 17 AS hash_n FROM documents))"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = (F.floor(F.col("doc_id") / 3) * 7919 + 17) * 2654435761 % 1000000007
    code = F.when(F.col("doc_id") % 3 == 0, h).otherwise(h.bitwiseXOR(F.call_function("shiftleft", F.lit(5).cast("long"), (F.col("doc_id") % 20).cast("int"))))
    return _docs(spark, sf_dir).select("doc_id", "source", "sha", code.alias("code"))


@query(f"WITH c AS ({_CODES}) SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.code, y.code))::INT AS distance FROM c x JOIN c y ON x.doc_id < y.doc_id AND bit_count(xor(x.code, y.code)) <= 5")
def near_dup_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of codes within five bits, through equal groups of bits instead of all pairs."""
    return splits.near_pairs(_codes(spark, sf_dir), "doc_id", "code")


@query(f"""WITH c AS (SELECT doc_id, code, source FROM ({_CODES}) JOIN documents USING (doc_id))
SELECT 'exact' AS kind, 'any' AS source, min(doc_id) AS a, max(doc_id) AS b, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1
UNION ALL SELECT 'near', x.source, x.doc_id, y.doc_id, bit_count(xor(x.code, y.code)) FROM c x JOIN c y ON x.source = y.source AND x.doc_id < y.doc_id AND bit_count(xor(x.code, y.code)) <= 5""")
def dedup_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts (first, last and number), and pairs of near codes of one source (distance)."""
    d = _codes(spark, sf_dir)
    exact = d.groupBy("sha").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    near = splits.near_pairs(d, "doc_id", "code", block="source")
    return exact.select(F.lit("exact").alias("kind"), F.lit("any").alias("source"), "a", "b", "n").unionByName(near.select(F.lit("near").alias("kind"), "source", "a", "b", F.col("distance").cast("long").alias("n")))


_FIELDS = ("quality", "toxic", "n_chars", "lang")
_LABELLED = "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query(" UNION ALL ".join(f"SELECT source, '{f}' AS field, count({f}) AS present, count(*) AS total, round(count({f}) * 100 / count(*), 4) AS pct FROM ({_LABELLED}) GROUP BY source" for f in _FIELDS))
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.completeness(_labelled(spark, sf_dir), "source", _FIELDS)


@query("SELECT facet, value, count(*) AS n, round(count(*) * 100 / any_value(total), 1) AS pct FROM (SELECT 'lang' AS facet, lang AS value, count(*) OVER () AS total FROM documents UNION ALL SELECT 'source', source, count(*) OVER () FROM documents) GROUP BY facet, value")
def value_counts_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.value_counts(table(spark, sf_dir, "documents"), ("lang", "source"))


@query("SELECT source, n, k FROM (SELECT source, n, row_number() OVER (ORDER BY n DESC, source)::INT AS k FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)) WHERE k <= 5")
def topn_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "source")))


_RULES = {"has_text": "n_chars > 0", "long_enough": "n_chars >= 100", "known_lang": "lang IN ('en', 'de', 'fr')", "short_id": "doc_id < 500", "has_point": "contains(text, '.')"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS passed, count(*) AS total, round(count(*) FILTER ({v}) / count(*), 6) AS rate FROM documents" for k, v in _RULES.items()))
def prescreening_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rule_rates(table(spark, sf_dir, "documents"), _RULES)


_COVER = f"SELECT source, field, pct FROM (SELECT source, unnest(['quality', 'toxic', 'n_chars']) AS field, unnest([avg((quality IS NOT NULL)::INT), avg((toxic = 0)::INT), avg((n_chars > 300)::INT)]) * 100 AS pct FROM ({_LABELLED}) GROUP BY source)"


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir)
    each = {"quality": F.col("quality").isNotNull(), "toxic": F.col("toxic") == 0, "n_chars": F.col("n_chars") > 300}
    wide = d.groupBy("source").agg(*((F.avg(c.cast("int")) * 100).alias(k) for k, c in each.items()))
    return wide.unpivot(["source"], list(each), "field", "pct")


@query(f"SELECT field, count(pct) AS sources, round(avg(pct), 4) AS mean, round(min(pct), 4) AS lo, round(max(pct), 4) AS hi, round(stddev_samp(pct), 4) AS sd, count(*) FILTER (pct < 75) AS below FROM ({_COVER}) GROUP BY field HAVING count(pct) >= 3")
def portfolio_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.field_statistics(_coverage(spark, sf_dir))


@query(f"SELECT field, count(*) AS sources FROM ({_COVER}) WHERE pct < 75 GROUP BY field HAVING count(*) >= 3")
def systemic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).filter("pct < 75").groupBy("field").agg(F.count("*").alias("sources")).filter("sources >= 3")


@query(f"SELECT source, round(max(CASE field WHEN 'quality' THEN pct END), 4) AS quality, round(max(CASE field WHEN 'toxic' THEN pct END), 4) AS toxic, round(max(CASE field WHEN 'n_chars' THEN pct END), 4) AS n_chars FROM ({_COVER}) GROUP BY source")
def portfolio_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["quality", "toxic", "n_chars"]
    wide = _coverage(spark, sf_dir).groupBy("source").pivot("field", fields).agg(F.max("pct"))
    return wide.select("source", *(F.round(f, 4).alias(f) for f in fields))


@query(f"""WITH d AS (SELECT source, avg((quality IS NOT NULL)::INT) * 100 AS field_coverage, avg((n_chars BETWEEN 50 AND 5000)::INT) * 100 AS field_validity, avg((toxic = 0)::INT) * 100 AS label_accuracy, CASE WHEN count(*) > 50 THEN 90.0 END AS confidence_quality FROM ({_LABELLED}) GROUP BY source),
s AS (SELECT source, CASE WHEN label_accuracy IS NULL THEN 0 ELSE (field_coverage * 0.15::DOUBLE + field_validity * 0.15::DOUBLE + label_accuracy * 0.2::DOUBLE + coalesce(confidence_quality, 0) * 0.2::DOUBLE) / (0.15::DOUBLE + 0.15::DOUBLE + 0.2::DOUBLE + CASE WHEN confidence_quality IS NULL THEN 0 ELSE 0.2::DOUBLE END) END AS overall FROM d)
SELECT source, round(overall, 4) AS overall, CASE WHEN overall >= 93 THEN 'A' WHEN overall >= 85 THEN 'B' WHEN overall >= 75 THEN 'C' WHEN overall >= 65 THEN 'D' ELSE 'F' END AS grade FROM s""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir).groupBy("source").agg((F.avg(F.col("quality").isNotNull().cast("int")) * 100).alias("field_coverage"), (F.avg(F.col("n_chars").between(50, 5000).cast("int")) * 100).alias("field_validity"), (F.avg((F.col("toxic") == 0).cast("int")) * 100).alias("label_accuracy"), F.when(F.count("*") > 50, 90.0).alias("confidence_quality"))
    overall = audit.overall({"field_coverage": 0.15, "field_validity": 0.15, "label_accuracy": 0.2, "confidence_quality": 0.2}, required=("label_accuracy",))
    return d.withColumn("o", overall).select("source", F.round("o", 4).alias("overall"), audit.grade(F.col("o")).alias("grade"))


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT round(sum(pow(n - m, 2) / m), 6) AS chi_square, count(*) AS kinds FROM c, (SELECT avg(n) AS m FROM c)")
def chi_square_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chi_square(table(spark, sf_dir, "documents"), "source")


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT round(-sum(n / t * ln(n / t)) / ln(count(*)), 6) AS diversity, count(*) AS kinds FROM c, (SELECT sum(n) AS t FROM c)")
def diversity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return p.agg(F.round(-F.sum(F.col("p") * F.log("p")) / F.log(F.count("*")), 6).alias("diversity"), F.count("*").alias("kinds"))


@query("""SELECT lang, source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)""")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("""SELECT coalesce(a.lang, b.lang) AS lang, round(coalesce(b.r, 0) - coalesce(a.r, 0), 6) AS delta, coalesce(b.r, 0) - coalesce(a.r, 0) > 0.02 AS regression
FROM (SELECT lang, avg((n_chars < 400)::INT) AS r FROM documents WHERE doc_id % 2 = 0 GROUP BY lang) a FULL JOIN (SELECT lang, avg((n_chars < 400)::INT) AS r FROM documents WHERE doc_id % 2 = 1 AND lang <> 'es' GROUP BY lang) b USING (lang)""")
def prescreening_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("fail", (F.col("n_chars") < 400).cast("int"))
    before, after = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1 AND lang <> 'es'")
    return audit.deltas(before.groupBy("lang").agg(F.avg("fail").alias("rate")), after.groupBy("lang").agg(F.avg("fail").alias("rate")), "lang")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('42:', doc_id))) AS k FROM documents) WHERE k <= 3")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seeded samples of each source."""
    k = F.row_number().over(Window.partitionBy("source").orderBy(_order()))
    return table(spark, sf_dir, "documents").withColumn("k", k).filter("k <= 3").select("source", "doc_id")
