"""Queries of drift, performance, alerts, budgets, harvests, out-of-distribution scores and streams over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import alerts, drift
from ..operators.prefix import percentiles
from ..streaming import events as S
from .fixtures import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "reference").otherwise("current")
    return table(spark, sf_dir, "events").withColumn("half", half)


_EVENTS = "SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END AS half FROM events"
_HIST = f"""SELECT event_type, half, bin::INT AS bin, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / total AS p FROM (SELECT event_type, half, count(*) AS total, unnest(range(20)) AS bin FROM ({_EVENTS}) GROUP BY event_type, half)
LEFT JOIN (SELECT event_type, half, least(floor(greatest(0, least(500, value)) / 25), 19) AS bin, count(*) AS n FROM ({_EVENTS}) GROUP BY ALL) USING (event_type, half, bin)"""
_DIV = f"""SELECT event_type, greatest(0, sum(CASE WHEN c.p > 1e-10 THEN c.p * ln(c.p / greatest(r.p, 1e-10)) ELSE 0 END)) AS kl, greatest(0, sum(CASE WHEN r.p > 1e-10 THEN r.p * ln(r.p / greatest(c.p, 1e-10)) ELSE 0 END)) AS kl_back,
  sum((greatest(c.p, 1e-10) - greatest(r.p, 1e-10)) * ln(greatest(c.p, 1e-10) / greatest(r.p, 1e-10))) AS psi FROM (SELECT * FROM ({_HIST}) WHERE half = 'current') c JOIN (SELECT * FROM ({_HIST}) WHERE half = 'reference') r USING (event_type, bin) GROUP BY event_type"""


def _divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = drift.histogram(_events(spark, sf_dir), ["event_type", "half"], "value", 0.0, 500.0, 20)
    both = h.groupBy("event_type", "bin").agg(F.max(F.when(F.col("half") == "current", F.col("p"))).alias("c"), F.max(F.when(F.col("half") == "reference", F.col("p"))).alias("r"))
    c, r = F.col("c"), F.col("r")
    return both.groupBy("event_type").agg(drift.kl(c, r).alias("kl"), drift.kl(r, c).alias("kl_back"), drift.psi(r, c).alias("psi"))


@query(f"SELECT event_type, half, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS lo, max(value) AS hi, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {k}" for k, q in (("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))) + f" FROM ({_EVENTS}) GROUP BY ALL")
def drift_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = drift.statistics("value")
    return _events(spark, sf_dir).groupBy("event_type", "half").agg(*((c if k in ("lo", "hi") else F.round(c, 6)).alias(k) for k, c in s.items()))


@query(f"SELECT event_type, half, bin, n, round(p, 9) AS p FROM ({_HIST})")
def drift_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.histogram(_events(spark, sf_dir), ["event_type", "half"], "value", 0.0, 500.0, 20).withColumn("p", F.round("p", 9))


@query(f"SELECT event_type, round(kl, 6) AS kl, round((kl + kl_back) / 2, 6) AS symmetric_kl, round(psi, 6) AS psi FROM ({_DIV})")
def drift_kl_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence(spark, sf_dir).select("event_type", F.round("kl", 6).alias("kl"), F.round((F.col("kl") + F.col("kl_back")) / 2, 6).alias("symmetric_kl"), F.round("psi", 6).alias("psi"))


@query(f"SELECT event_type, CASE WHEN kl >= 0.30 OR psi >= 0.25 THEN 'critical' WHEN kl >= 0.15 OR psi >= 0.10 THEN 'warning' ELSE 'none' END AS severity FROM ({_DIV})")
def drift_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence(spark, sf_dir).select("event_type", drift.severity(F.col("kl"), F.col("psi")).alias("severity"))


_DAILY = "SELECT event_type, date_trunc('day', ts)::DATE AS day, avg(value) AS mean FROM events GROUP BY ALL"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))


_TREND = f"SELECT *, avg(mean) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS base FROM ({_DAILY})"


@query(f"""SELECT event_type, day::VARCHAR AS day, round(mean, 6) AS mean, round(base, 6) AS baseline, CASE WHEN base IS NULL THEN 'new' WHEN abs(mean - base) / base < 0.01 THEN 'stable' WHEN mean > base THEN 'improving'
  WHEN (base - mean) / base >= 0.05 THEN 'critical_drop' WHEN (base - mean) / base >= 0.03 THEN 'warning_drop' ELSE 'degrading' END AS trend FROM ({_TREND})""")
def performance_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's mean against the mean of the seven days before it."""
    d = _daily(spark, sf_dir).withColumn("k", F.unix_date("day"))
    d = d.withColumn("base", F.avg("mean").over(Window.partitionBy("event_type").orderBy("k").rangeBetween(-7, -1)))
    drop = (F.col("base") - F.col("mean")) / F.col("base")
    trend = F.when(F.col("base").isNull(), "new").when(F.abs(drop) < 0.01, "stable").when(drop < 0, "improving").when(drop >= 0.05, "critical_drop").when(drop >= 0.03, "warning_drop").otherwise("degrading")
    return d.select("event_type", F.col("day").cast("string").alias("day"), F.round("mean", 6).alias("mean"), F.round("base", 6).alias("baseline"), trend.alias("trend"))


@query(f"SELECT event_type, round(arg_max(mean, day), 6) AS current, round(min(mean), 6) AS lo, round(max(mean), 6) AS hi, round(avg(mean), 6) AS mean, count(*) AS days FROM ({_DAILY}) GROUP BY 1")
def dashboard_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).groupBy("event_type").agg(F.round(F.max_by("mean", "day"), 6).alias("current"), F.round(F.min("mean"), 6).alias("lo"), F.round(F.max("mean"), 6).alias("hi"), F.round(F.avg("mean"), 6).alias("mean"), F.count("*").alias("days"))


@query(f"""WITH w AS (SELECT event_type, day, mean - first_value(mean) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS delta, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k FROM ({_DAILY}))
SELECT event_type, day::VARCHAR AS day, CASE WHEN k < 2 THEN 'insufficient_data' WHEN delta > 2 THEN 'improving' WHEN delta < -2 THEN 'degrading' ELSE 'stable' END AS trend FROM w""")
def score_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last score against the first of the last three, as it was known on each day."""
    by = Window.partitionBy("event_type").orderBy("day")
    return _daily(spark, sf_dir).select("event_type", F.col("day").cast("string").alias("day"), drift.score_trend(F.col("mean"), by).alias("trend"))


@query("""SELECT event_id, CASE WHEN round(spent, 4) >= 30000 THEN 'blocked' WHEN round(spent, 4) >= 24000 THEN 'warning' ELSE 'ok' END AS state FROM (SELECT event_id, sum(value) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS spent FROM events)""")
def budget_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.running_cost(table(spark, sf_dir, "events"), "ts", "event_id", "value", "day").select("event_id", alerts.budget_state(F.round("spent", 4), 30000).alias("state"))


@query("""SELECT date_trunc('month', ts)::DATE::VARCHAR AS month, round(sum(value), 2) AS spent, round(greatest(0, 1000000 - sum(value)), 2) AS remaining, round(sum(value) / 1000000 * 100, 4) AS percent FROM events GROUP BY 1""")
def budget_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.sum("value")
    return table(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("month", "ts")).cast("string").alias("month")).agg(F.round(s, 2).alias("spent"), F.round(F.greatest(F.lit(0.0), 1000000 - s), 2).alias("remaining"), F.round(s / 1000000 * 100, 4).alias("percent"))


_COOL = """WITH RECURSIVE o AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT event_type, event_id, k, ts AS last, true AS emitted FROM o WHERE k = 1
  UNION ALL SELECT o.event_type, o.event_id, o.k, CASE WHEN o.ts - f.last >= INTERVAL 60 MINUTE THEN o.ts ELSE f.last END, o.ts - f.last >= INTERVAL 60 MINUTE FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1)
SELECT event_type, event_id FROM f WHERE emitted"""


@query(_COOL)
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return alerts.cooldown(e, ["event_type"], "ts", "event_id", 60).select("event_type", "event_id")


_LE = (10, 25, 50, 100, 250, 500)


@query(" UNION ALL ".join(f"SELECT event_type, {b} AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY event_type" for b in _LE))
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counts by upper bound, in one pass."""
    wide = table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(str(b)) for b in _LE))
    return wide.unpivot(["event_type"], [str(b) for b in _LE], "le", "n").withColumn("le", F.col("le").cast("int"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = percentiles(e, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])
    rest = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rest.join(p, "event_type").select("event_type", "mean", *(F.round(k, 6).alias(k) for k in ("p50", "p95", "p99")), "lo", "hi")


@query("""WITH t AS (SELECT user_id FROM events GROUP BY user_id ORDER BY min((ts, event_id)) LIMIT 20)
SELECT CASE WHEN user_id IN (SELECT user_id FROM t) THEN user_id::VARCHAR ELSE 'overflow' END AS guarded, count(*) AS n FROM events GROUP BY 1""")
def label_cardinality_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("label", F.col("user_id").cast("string"))
    return alerts.guard_labels(e, "label", ["ts", "event_id"], 20).groupBy("guarded").agg(F.count("*").alias("n"))


_HARVEST = "SELECT event_id, event_type, ts, CASE WHEN value / 500 >= 0.7 THEN 'high_entropy' WHEN (user_id % 100) / 100 <= 0.05 THEN 'low_agreement' WHEN event_type = 'click' THEN 'escalated' WHEN value < 50 THEN 'outlier' END AS reason FROM events"


def _harvested(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") / 500
    reason = alerts.harvest_reason(v, F.col("user_id") % 100 / 100 + 0.45, F.col("event_type") == "click", F.when(F.col("value") < 50, 0.0).otherwise(0.5))
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts", reason.alias("reason"))


@query(f"SELECT reason, count(*) AS n, min(event_id) AS first_event FROM ({_HARVEST}) WHERE reason IS NOT NULL GROUP BY 1")
def harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harvested(spark, sf_dir).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(source || '/' || lang), 'personal|private|confidential|pii|hipaa') THEN 'path' WHEN regexp_matches(lower(text), '" + "|".join(alerts.PII) + "') THEN 'metadata' ELSE 'clear' END AS status FROM documents")
def privacy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", alerts.privacy(F.concat_ws("/", "source", "lang"), F.col("text")).alias("status"))


@query(f"SELECT reason, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, count(*) AS n FROM ({_HARVEST}) WHERE reason IS NOT NULL GROUP BY ALL")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "approved").otherwise("rejected")
    return _harvested(spark, sf_dir).filter("reason is not null").groupBy("reason", status.alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS pending, count(*) >= 1000 AS trigger FROM ({_HARVEST}) WHERE reason IS NOT NULL AND event_id % 3 = 1 AND event_id NOT IN (SELECT o_orderkey FROM orders)")
def pending_retraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    left = _harvested(spark, sf_dir).filter("reason is not null and event_id % 3 = 1").join(used, "event_id", "left_anti")
    return left.agg(F.count("*").alias("pending"), (F.count("*") >= 1000).alias("trigger"))


@query()
def ood_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance by the shrunk precision, and whether it's above the 95th percentile of all."""
    e = table(spark, sf_dir, "embeddings")
    mean, precision = drift.shrunk_precision(e, "embedding", 64)
    d = e.select("vec_id", drift.mahalanobis(F.col("embedding"), mean, precision).alias("distance"))
    bound = percentiles(d, "distance", {"p": 0.95}).first()[0]
    return d.withColumn("outlier", F.col("distance") > bound)


_DIAG = """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY i)
SELECT vec_id, sqrt(sum((x - m) * (x - m) / v)) AS distance FROM x JOIN m USING (i) GROUP BY vec_id"""


@query(f"SELECT vec_id, round(distance, 4) AS distance, distance > (SELECT quantile_cont(distance, 0.95) FROM ({_DIAG})) AS outlier FROM ({_DIAG})")
def ood_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = [F.col("embedding")[i].cast("double") for i in range(64)]
    row = e.agg(*(F.avg(c) for c in x), *(F.var_pop(c) for c in x)).first()  # 128 numbers
    d = e.select("vec_id", drift.diagonal(F.col("embedding"), row[:64], row[64:]).alias("distance"))
    bound = percentiles(d, "distance", {"p": 0.95}).first()[0]
    return d.select("vec_id", F.round("distance", 4).alias("distance"), (F.col("distance") > bound).alias("outlier"))


def _name(base: str) -> str:
    return f"{base}_{uuid.uuid4().hex[:8]}"


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.finish(S.window_rates(S.source(spark, sf_dir)), _name("rates"), "complete")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.finish(S.sessions(S.source(spark, sf_dir)), _name("sessions"), "complete")
    return got.groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@query("SELECT count(*) AS users FROM (SELECT DISTINCT user_id FROM events)")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.finish(S.deduplicated(S.source(spark, sf_dir), ["user_id"]), _name("dedup"), "append")
    return got.agg(F.count("*").alias("users"))


@query(_COOL)
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finish(S.cooldown(S.source(spark, sf_dir)), _name("cooldown"), "append").select("event_type", "event_id")
