"""Queries of calibration, agreement, correlation and detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import evaluation as E
from .fixtures import table

_SCORED = "SELECT l.doc_id, l.quality, l.toxic, (n_chars * 7919 % 1000) / 1000 AS score, (n_chars % 2)::INT AS predicted FROM labels l JOIN documents USING (doc_id)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", "quality", "toxic", (F.col("n_chars") * 7919 % 1000 / 1000).alias("score"), (F.col("n_chars") % 2).cast("int").alias("predicted"))


_BINS = f"""SELECT b.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n, coalesce(c, 0) AS confidence, coalesce(a, 0) AS accuracy FROM (SELECT unnest(range(10)) AS bin) b
LEFT JOIN (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS c, avg(quality) AS a FROM ({_SCORED}) GROUP BY 1) USING (bin)"""


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reliability_bins(_scored(spark, sf_dir), F.col("score"), F.col("quality"))


@query(f"SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM ({_BINS})")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir).withColumns({"confidence": F.round("confidence", 6), "accuracy": F.round("accuracy", 6)})


@query(f"SELECT round(sum(abs(confidence - accuracy) * n) / sum(n), 6) AS ece, round(max(CASE WHEN n > 0 THEN abs(confidence - accuracy) ELSE 0 END), 6) AS mce FROM ({_BINS})")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.calibration_error(_bins(spark, sf_dir))
    return e.select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query(f"""WITH b AS (SELECT toxic AS class, least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS c, avg(quality) AS a FROM ({_SCORED}) GROUP BY ALL),
e AS (SELECT class, sum(abs(c - a) * n) / sum(n) AS ece FROM b GROUP BY class) SELECT round(avg(ece), 6) AS macro_ece, count(*) AS classes FROM e""")
def multiclass_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _scored(spark, sf_dir).groupBy("toxic", F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("c"), F.avg("quality").alias("a"))
    e = b.groupBy("toxic").agg((F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n")) / F.sum("n")).alias("ece"))
    return e.agg(F.round(F.avg("ece"), 6).alias("macro_ece"), F.count("*").alias("classes"))


@query(f"SELECT quality, predicted, count(*) AS n FROM ({_SCORED}) GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_scored(spark, sf_dir), "quality", "predicted")


@query(f"""WITH s AS ({_SCORED}), c AS (SELECT k AS class, count(*) FILTER (quality = k) AS support, count(*) FILTER (predicted = k) AS said, count(*) FILTER (quality = k AND predicted = k) AS hits FROM s, (SELECT unnest([0, 1]) AS k) GROUP BY k),
r AS (SELECT class, support, CASE WHEN said > 0 THEN hits / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM c)
SELECT class, support, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM r""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.classification_report(_scored(spark, sf_dir), "quality", "predicted")


@query(f"""WITH s AS ({_SCORED}), t AS (SELECT count(*) AS t, avg((quality = predicted)::INT) AS po FROM s),
e AS (SELECT sum(x * y) AS xy FROM (SELECT quality AS c, count(*) AS x FROM s GROUP BY 1) JOIN (SELECT predicted AS c, count(*) AS y FROM s GROUP BY 1) USING (c))
SELECT round(po, 6) AS agreement, round((po - xy / (t * t)) / (1 - xy / (t * t)), 6) AS kappa FROM t, e""")
def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.kappa(_scored(spark, sf_dir), "quality", "predicted")


@query(f"""WITH s AS ({_SCORED}), b AS (SELECT score, sum(toxic) AS pos, sum(1 - toxic) AS neg FROM s GROUP BY score), u AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS under FROM b)
SELECT round(sum(pos * (under + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM u""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.auc(_scored(spark, sf_dir), "toxic", "score")


@query(f"""WITH s AS ({_SCORED}), b AS (SELECT score, sum(toxic) AS pos, sum(1 - toxic) AS neg FROM s GROUP BY score),
r AS (SELECT sum(pos) OVER w / sum(pos) OVER () AS tpr, sum(neg) OVER w / sum(neg) OVER () AS fpr FROM b WINDOW w AS (ORDER BY score DESC)) SELECT round(min(fpr), 6) AS fpr FROM r WHERE tpr >= 0.95""")
def fpr_at_tpr95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fpr_at_tpr(_scored(spark, sf_dir), "toxic", "score")


@query("""SELECT l_returnflag AS model, round(corr(l_quantity, l_extendedprice), 6) AS plcc, round(avg(abs(l_quantity - l_extendedprice / 1000)), 6) AS mae, round(sqrt(avg(pow(l_quantity - l_extendedprice / 1000, 2))), 6) AS rmse FROM lineitem GROUP BY 1""")
def arena_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = F.col("l_quantity"), F.col("l_extendedprice")
    m = {"plcc": E.pair_metrics(p, t)["plcc"]} | {k: v for k, v in E.pair_metrics(p, t / 1000).items() if k != "plcc"}
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(*(F.round(c, 6).alias(k) for k, c in m.items()))


@query("""WITH a AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM a)
SELECT round(corr(rx, ry), 6) AS srcc FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    r = E.average_rank(E.average_rank(a, "l_quantity"), "l_extendedprice")
    return r.agg(F.round(F.corr("l_quantity_rank", "l_extendedprice_rank"), 6).alias("srcc"))


@query("""SELECT supplier, score, row_number() OVER (ORDER BY score DESC, supplier)::INT AS rank FROM (SELECT l_suppkey AS supplier, round(avg(l_quantity), 6) AS score FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) QUALIFY rank <= 20""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.round(F.avg("l_quantity"), 6).alias("score"))
    top = means.orderBy(F.desc("score"), "supplier").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "supplier")))


_VOTES = "SELECT doc_id, 'a' AS source, quality::INT AS v FROM labels UNION ALL SELECT doc_id, 'b', CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END FROM labels UNION ALL SELECT doc_id, 'c', (doc_id % 2)::INT FROM labels"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.array(F.struct(F.lit("a").alias("source"), F.col("quality").alias("v")), F.struct(F.lit("b").alias("source"), F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("v")), F.struct(F.lit("c").alias("source"), (F.col("doc_id") % 2).cast("int").alias("v")))
    return table(spark, sf_dir, "labels").select("doc_id", F.inline(pair))


@query(f"WITH v AS ({_VOTES}) SELECT x.source AS a, y.source AS b, count(*) AS n, round(avg((x.v = y.v)::INT), 6) AS agreement FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.source < y.source GROUP BY ALL")
def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _votes(spark, sf_dir)
    x, y = (v.select("doc_id", F.col("source").alias(s), F.col("v").alias(f"v{s}")) for s in "ab")
    return x.join(y, "doc_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg((F.col("va") == F.col("vb")).cast("int")), 6).alias("agreement"))


@query(f"SELECT doc_id, count(DISTINCT v) AS kinds, string_agg(v::VARCHAR, ',' ORDER BY source) AS votes FROM ({_VOTES}) GROUP BY doc_id HAVING count(DISTINCT v) > 1")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _votes(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("v").alias("kinds"), F.array_sort(F.collect_list(F.struct("source", "v"))).alias("s")).filter("kinds > 1")
    return g.select("doc_id", "kinds", F.array_join(F.transform("s", lambda x: x["v"].cast("string")), ",").alias("votes"))


@query(f"""WITH c AS (SELECT doc_id, v, count(*) AS n FROM ({_VOTES}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY doc_id) AS t FROM c)
SELECT doc_id, v AS winner, round(n / t, 6) AS share FROM r WHERE k = 1""")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plurality, ties to the lower value."""
    c = _votes(spark, sf_dir).groupBy("doc_id", "v").agg(F.count("*").alias("n"))
    best = c.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("v")).alias("m"))).alias("b"), F.sum("n").alias("t"))
    return best.select("doc_id", (-F.col("b.m")).alias("winner"), F.round(F.col("b.n") / F.col("t"), 6).alias("share"))


@query("""SELECT l_orderkey AS doc_id, round(avg(l_tax), 9) AS mean, round(median(l_tax), 9) AS median, round(max(l_tax), 9) AS largest, round(sum(l_tax * l_quantity) / sum(l_quantity), 9) AS weighted, round(var_pop(l_tax), 9) AS variance FROM lineitem GROUP BY 1""")
def merge_soft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = F.col("l_tax"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(*(F.round(c, 9).alias(k) for k, c in {"mean": F.avg(x), "median": F.percentile(x, 0.5), "largest": F.max(x), "weighted": F.sum(x * w) / F.sum(w), "variance": F.var_pop(x)}.items()))


@query("""WITH v AS (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'N' THEN 'und' ELSE lower(l_returnflag) END AS language, CASE WHEN l_orderkey % 5 = 0 THEN 0.0 ELSE round(greatest(0.0, l_quantity / 25 - 0.4713), 6) END AS c FROM lineitem),
a AS (SELECT doc_id, avg(c) FILTER (c > 0) AS mean, min(c) FILTER (c > 0) AS lower, max(c) FILTER (c > 0) AS upper, var_pop(c) FILTER (c > 0) AS var, count(DISTINCT language) FILTER (language <> 'und') AS kinds FROM v GROUP BY doc_id)
SELECT doc_id, round(mean, 6) AS point, round(coalesce(lower, 0), 6) AS lower, round(coalesce(var, 1), 6) AS variance, mean IS NOT NULL AND kinds <= 1 AS agreement,
  CASE WHEN mean IS NULL THEN 'zero_confidence_votes' WHEN round(mean, 9) < 0.6::DOUBLE THEN 'low_confidence' WHEN round(var, 9) > 0.3::DOUBLE THEN 'high_variance' WHEN kinds > 1 THEN 'detector_disagreement' END AS reason FROM a""")
def detector_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.routing import detector_confidence

    sure = F.when(F.col("l_orderkey") % 5 == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.col("l_quantity") / 25 - 0.4713), 6))
    vote = F.struct(F.when(F.col("l_returnflag") == "N", "und").otherwise(F.lower("l_returnflag")).alias("language"), sure.alias("confidence"))
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(vote).alias("votes")).select("doc_id", detector_confidence(F.col("votes")).alias("c"))
    return c.select("doc_id", *(F.round(f"c.{k}", 6).alias(k) for k in ("point", "lower", "variance")), "c.agreement", "c.reason")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap_ci(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"])


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem")
    x, y, w, h = F.col("l_linenumber") * 60.0, F.col("l_suppkey") % 10 * 10.0, 10 + F.col("l_quantity"), 20 + F.col("l_tax") * 100
    base = l.select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 3).cast("int").alias("class"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (F.col("l_discount") * 10).alias("score"), "l_linestatus")
    truth = base.select("image", "class", F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("box"))
    d = F.col("score") * 8
    return base.filter("l_linestatus = 'O'").select("image", "class", "score", F.array(F.col("x") + d, "y", F.col("x") + F.col("w") + d, F.col("y") + F.col("h")).alias("box")), truth


@query()
def detection_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = _boxes(spark, sf_dir)
    return E.average_precision(E.match_detections(p, t), t).drop("threshold")


@query()
def detection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over ten thresholds, from 0.5 in steps of 0.05, and classes."""
    p, t = _boxes(spark, sf_dir)
    return E.mean_average_precision(p, t)


@query()
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.isotonic(table(spark, sf_dir, "events").withColumn("y", F.pmod(F.xxhash64("event_id"), F.lit(2)) + F.col("value") / 500), "value", "y")


@query("""SELECT l_shipmode, round(sum(z) / count(*), 6) AS z FROM (SELECT l_returnflag AS l_shipmode, abs(l_quantity - m) / s AS z FROM lineitem JOIN (SELECT l_linestatus, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1 HAVING count(*) >= 5) USING (l_linestatus)) GROUP BY 1""")
def zscore_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance from the category's mean in its deviations; categories of fewer than five rows have none."""
    l = table(spark, sf_dir, "lineitem")
    fit = l.groupBy("l_linestatus").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"), F.count("*").alias("n")).filter("n >= 5 AND s > 0")
    z = F.abs(F.col("l_quantity") - F.col("m")) / F.col("s")
    return l.join(fit, "l_linestatus").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.round(F.sum(z) / F.count("*"), 6).alias("z"))
