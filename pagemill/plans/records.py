"""Queries of sample records: checks, versions, comparisons, reviews, histories, and small rules over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars as S
from ..operators import records as R
from .fixtures import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _pick(values: list[str], k):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


@query("""SELECT doc_id, CASE WHEN doc_id % 97 / 96 < 0.2 THEN 'none' WHEN doc_id % 97 / 96 < 0.5 THEN 'mild' WHEN doc_id % 97 / 96 < 0.8 THEN 'moderate' ELSE 'severe' END AS severity,
  CASE WHEN doc_id % 13 = 0 THEN 'unassessed' WHEN doc_id % 97 / 96 >= 0.9 THEN 'hard_label' WHEN doc_id % 97 / 96 >= 0.7 THEN 'soft_label' WHEN doc_id % 97 / 96 >= 0.5 THEN 'active_learning' ELSE 'unreliable' END AS reliability,
  CASE WHEN doc_id % 101 < 75 THEN 'auto_accept' WHEN doc_id % 101 < 90 THEN 'low_weight' WHEN doc_id % 101 < 97.5 THEN 'tier2_trigger' ELSE 'hard_reject' END AS tier, round((5 - doc_id % 5) / 4, 6) AS defect FROM documents""")
def label_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    x = k % 97 / 96
    return _docs(spark, sf_dir).select("doc_id", S.severity_name(x).alias("severity"), S.reliability(F.when(k % 13 != 0, x)).alias("reliability"), S.acceptance_tier((k % 101).cast("double")).alias("tier"), F.round(S.mos_defect((k % 5).cast("double")), 6).alias("defect"))


_HEADS = ["255044462D312E37", "89504E470D0A1A0A", "FFD8FFE000104A46", "49492A0008000000", "524946461000000057454250", "424D3600000000000000360000002800000001", "00112233"]
_KINDS = ["pdf", "png", "jpeg", "tiff", "webp", "bmp", None]


@query("""SELECT kind, extension, error, count(*) AS files FROM (SELECT ['pdf', 'png', 'jpeg', 'tiff', 'webp', 'bmp', NULL][doc_id % 7 + 1] AS kind, ['.PDF', 'png', 'jpg', 'exe'][doc_id % 4 + 1] AS extension,
  CASE WHEN doc_id % 4 = 3 THEN 'unknown extension' WHEN doc_id % 5 = 0 THEN 'too short' WHEN doc_id % 7 = 6 THEN 'unknown content' WHEN doc_id % 7 = doc_id % 4 THEN NULL ELSE 'content is ' || ['pdf', 'png', 'jpeg', 'tiff', 'webp', 'bmp', ''][doc_id % 7 + 1] END AS error FROM documents WHERE doc_id % 5 > 0 OR doc_id % 7 <> 5) GROUP BY ALL""")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind by the first bytes and what the extension says; every fifth file is too short to tell."""
    k = F.col("doc_id")
    head = _pick(_HEADS, k)
    content = F.unhex(F.when(k % 5 == 0, head).otherwise(F.rpad(head, 64, "00")))
    f = _docs(spark, sf_dir).filter("doc_id % 5 > 0 OR doc_id % 7 <> 5").select(content.alias("c"), _pick([".PDF", "png", "jpg", "exe"], k).alias("extension"))
    return f.groupBy(S.file_type(F.col("c")).alias("kind"), "extension", S.extension_error(F.col("c"), F.col("extension")).alias("error")).agg(F.count("*").alias("files"))


_PATHS = ["/data/a/x.png", "/data/../etc/x", "/database/x", "/data", "x/y..z", "/data/b"]


@query("""SELECT path, NOT contains(path, '..') AND (path = '/data' OR starts_with(path, '/data/')) AS safe, count(*) AS n FROM (SELECT ['/data/a/x.png', '/data/../etc/x', '/database/x', '/data', 'x/y..z', '/data/b'][doc_id % 6 + 1] AS path FROM documents) GROUP BY ALL""")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _docs(spark, sf_dir).select(_pick(_PATHS, F.col("doc_id")).alias("path"))
    return p.groupBy("path", S.safe_path(F.col("path"), F.lit("/data/")).alias("safe")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id, [' Latin', 'CJK', 'traditional chinese', 'hindi ', 'Klingon', 'Arabic'][doc_id % 6 + 1] AS name, ['Latn', 'Hani', 'Hant', 'Deva', 'Zzzz', 'Arab'][doc_id % 6 + 1] AS script, ['en', 'ja', 'ar', 'xx', 'he'][doc_id % 5 + 1] AS language, ['Latn', 'Jpan', 'Arab', 'Zzzz', 'Hebr'][doc_id % 5 + 1] AS standard FROM documents),
f AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN script ELSE standard END AS whole FROM t)
SELECT name, script, language || '-' || CASE WHEN doc_id % 2 = 0 AND doc_id % 4 = 0 THEN whole || '-US' ELSE whole END AS tag,
  CASE WHEN whole = 'Latn' THEN 'latin' WHEN whole IN ('Hani', 'Hant', 'Jpan') THEN 'cjk' WHEN whole = 'Deva' THEN 'indic' WHEN whole = 'Arab' THEN 'arabic' WHEN whole = 'Hebr' THEN 'hebrew' ELSE 'other' END AS family, whole IN ('Arab', 'Hebr') AS rtl, count(*) AS documents FROM f GROUP BY ALL""")
def script_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    name = _pick([" Latin", "CJK", "traditional chinese", "hindi ", "Klingon", "Arabic"], k)
    script = S.legacy_script(name)
    info = S.language_script(_pick(["en", "ja", "ar", "xx", "he"], k), F.when(k % 2 == 0, script), F.when(k % 4 == 0, "US"))
    d = _docs(spark, sf_dir).select(name.alias("name"), script.alias("script"), info.alias("i"))
    return d.groupBy("name", "script", "i.tag", "i.family", "i.rtl").agg(F.count("*").alias("documents"))


@query("""SELECT doc_id, CASE WHEN s IS NULL THEN 'unknown' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS eta, least(1000 * pow(2, doc_id % 8), 30000)::BIGINT AS backoff_ms,
  ['b', 'model', 'c.d', 'x'][doc_id % 4 + 1] AS model FROM (SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN doc_id * 37 % 9000 END AS s FROM documents)""")
def texts_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return _docs(spark, sf_dir).select("doc_id", S.eta(F.when(k % 11 > 0, k * 37 % 9000)).alias("eta"), S.backoff_ms(k % 8).alias("backoff_ms"), S.model_name(_pick(["a/b", "model.onnx", "c.d.pt", "org/x"], k)).alias("model"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity BETWEEN 10 AND 40 AND l_tax BETWEEN 0.02 AND 0.06 AS inside, round((l_quantity + l_linenumber) / 2, 6) AS height, CASE WHEN l_quantity <= 12.5 THEN 0 WHEN l_quantity <= 25 THEN 1 WHEN l_quantity <= 37.5 THEN 2 ELSE 3 END::INT AS bin FROM lineitem""")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    l = table(spark, sf_dir, "lineitem").withColumn("box", F.struct(F.lit(10.0).alias("x"), F.lit(0.02).alias("y"), F.lit(30.0).alias("width"), F.lit(0.04).alias("height")))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = F.array(at(F.lit(0.0), F.lit(0.0)), at(F.lit(9.0), F.lit(0.0)), at(F.lit(9.0), n), at(F.lit(0.0), q))
    inside = F.when(F.col("l_tax") == 0.06, (q >= 10) & (q <= 40)).otherwise(S.holds_point("box", q, F.col("l_tax")))  # 0.02 + 0.04 isn't 0.06
    return l.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", inside.alias("inside"), F.round(S.polygon_height(quad), 6).alias("height"), S.nearest_bin(q, [6.25, 18.75, 31.25, 43.75]).alias("bin"))


@query("""SELECT source, round(-sum(p * ln(p)), 6) AS entropy, round(sum(p * ln(p / greatest(q, 1e-10))), 6) AS kl FROM (SELECT source, lang, n / sum(n) OVER (PARTITION BY source) AS p FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)) JOIN (SELECT lang, n / sum(n) OVER () AS q FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)) USING (lang) GROUP BY source""")
def map_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of a source against those of all, as maps of shares."""
    d = _docs(spark, sf_dir)
    shares = lambda g: F.map_from_entries(F.collect_list(F.struct("lang", "p"))).alias(g)
    n = d.groupBy("source", "lang").agg(F.count("*").alias("n"))
    of = n.join(n.groupBy("source").agg(F.sum("n").alias("t")), "source").withColumn("p", F.col("n") / F.col("t")).groupBy("source").agg(shares("p"))
    every = n.groupBy("lang").agg(F.sum("n").alias("n")).crossJoin(n.agg(F.sum("n").alias("t"))).withColumn("p", F.col("n") / F.col("t")).agg(shares("q"))  # one row
    return of.crossJoin(every).select("source", F.round(S.entropy(F.col("p")), 6).alias("entropy"), F.round(S.kl_of_maps(F.col("p"), F.col("q")), 6).alias("kl"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2024-01-02' WHEN 1 THEN '2024-01-02T03:04:05Z' WHEN 2 THEN '2024-01-02T03:04:05+02:00' WHEN 3 THEN '2024-01-02 03:04:05.25' ELSE '02.01.2024' END AS t, event_id % 7 AS v FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1704153600 WHEN 1 THEN 1704164645 WHEN 2 THEN 1704157445 WHEN 3 THEN 1704164645 ELSE -1 END::BIGINT AS seconds,
  array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'missing dataset_version' END, CASE WHEN event_id % 2 = 1 THEN 'invalid id' END, CASE WHEN event_id % 5 = 4 THEN 'invalid download_date' END, CASE WHEN v < 1 THEN 'invalid current_version' END], lambda x: x IS NOT NULL), ',') AS errors FROM s""")
def sample_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    at = _pick(["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05.25", "02.01.2024"], k)
    digest = F.sha2(k.cast("string"), 256)
    r = table(spark, sf_dir, "events").select("event_id", F.when(k % 2 == 1, F.lit("XYZ")).otherwise(F.substring(digest, 1, 32)).alias("id"), digest.alias("file_hash"), F.lit("d").alias("dataset_name"), F.when(k % 3 != 0, "1").alias("dataset_version"), F.lit("p").alias("original_path"), F.lit("f").alias("original_filename"), at.alias("download_date"), (k % 7 - 1).alias("current_version"))
    return r.select("event_id", F.coalesce(F.unix_timestamp(S.utc_time(F.col("download_date"))), F.lit(-1)).alias("seconds"), F.array_join(R.sample_errors(r), ",").alias("errors"))


@query("""SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'vector has not 45 values' END AS length_error, list_max(list_transform(embedding[1:45], lambda x: x::DOUBLE)) > 1 OR list_min(list_transform(embedding[1:45], lambda x: x::DOUBLE)) < 0 AS outside, vec_id % 6 = 0 AS box FROM embeddings""")
def enrichment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.transform(F.slice("embedding", 1, 45), lambda x: x.cast("double"))
    boxes = F.array(F.struct(F.when(F.col("vec_id") % 6 == 0, 0.0).otherwise(1.0).alias("width"), F.lit(2.0).alias("height")))
    errors = e.select("vec_id", R.enrichment_errors(F.when(F.col("vec_id") % 4 == 0, F.concat(v, F.array(F.lit(0.5)))).otherwise(v), boxes).alias("x"))
    return errors.select("vec_id", F.get(F.filter("x", lambda m: m.contains("has not")), 0).alias("length_error"), F.array_contains("x", "vector outside 0 to 1").alias("outside"), F.array_contains("x", "box without area").alias("box"))


@query("""SELECT user_id, arg_max(value, (ts, event_id)) AS latest, CASE WHEN user_id % 3 > 0 THEN round(arg_max(value, (ts, event_id)), 4) END AS current FROM events GROUP BY user_id""")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that a record's pointer names: the last one, or none for every third."""
    v = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(v.alias("v"))
    versions = F.transform("v", lambda x, i: F.struct((i + 1).alias("version"), x["value"].alias("value")))
    at = F.when(F.col("user_id") % 3 > 0, F.size("v")).otherwise(0)
    return e.select("user_id", F.element_at("v", -1)["value"].alias("latest"), F.round(R.current_enrichment(versions, at)["value"], 4).alias("current"))


@query("""SELECT schema_version, added, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT '1.2' AS schema_version, CASE WHEN event_id % 3 = 0 THEN 'from 1.0' ELSE 'from 1.1' END AS added, value FROM events WHERE event_id % 3 < 2 UNION ALL SELECT '1.2', 'own', value FROM events WHERE event_id % 3 = 2) GROUP BY ALL""")
def migrate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three versions in the newest one, each along its shortest way."""
    k = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select(F.when(k == 0, "1.0").when(k == 1, "1.1").otherwise("1.2").alias("schema_version"), F.when(k == 2, "own").alias("added"), F.when(k == 0, F.col("value") * 2).otherwise(F.col("value")).alias("value"))
    steps = {
        ("1.0", "1.1"): lambda d: d.withColumn("value", F.col("value") / 2).withColumn("added", F.lit("from 1.0")),
        ("1.1", "1.2"): lambda d: d.withColumn("added", F.coalesce("added", F.lit("from 1.1"))),
        ("1.2", "1.1"): lambda d: d.withColumn("added", F.lit(None).cast("string")),
    }
    return R.migrate(e, steps, "1.2").groupBy("schema_version", "added").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_SIDES = "SELECT doc_id, quality::VARCHAR AS v FROM labels"


@query("""WITH a AS (SELECT doc_id, quality::VARCHAR AS v FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || lang || ' ' ELSE quality::VARCHAR END AS v FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 2 = 0), c AS (SELECT doc_id, upper(lang) AS v FROM documents WHERE doc_id % 5 = 0)
SELECT 'v' AS field, n.a, n.b, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS compared, count(*) FILTER (lower(trim(x)) = lower(trim(y))) AS same FROM (
  SELECT 'a' AS a, 'b' AS b, a.v AS x, b.v AS y FROM a FULL JOIN b USING (doc_id) UNION ALL SELECT 'a', 'c', a.v, c.v FROM a FULL JOIN c USING (doc_id) UNION ALL SELECT 'b', 'c', b.v, c.v FROM b FULL JOIN c USING (doc_id)) n GROUP BY ALL""")
def label_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources of a label, named by paths, stems and ids, aligned and compared."""
    d, l = _docs(spark, sf_dir), table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    a = l.select(F.concat(F.lit("x/y/"), k.cast("string"), F.lit(".PNG")).alias("id"), F.col("quality").cast("string").alias("v"))
    b = d.join(l, "doc_id", "left").filter(k % 2 == 0).select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit(" "), "lang", F.lit(" "))).otherwise(F.col("quality").cast("string")).alias("v"))
    c = d.filter(k % 5 == 0).select(F.concat(k.cast("string"), F.lit(".jpg")).alias("id"), F.upper("lang").alias("v"))
    return R.agreement(R.aligned({"a": a, "b": b, "c": c}, "id", ["v"]), ["v"], ["a", "b", "c"])


@query("""WITH e AS (SELECT *, max(ts) OVER () AS now FROM events) SELECT event_id FROM e WHERE ts > now - INTERVAL 24 HOUR AND value >= 400""")
def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("severity", F.when(F.col("value") >= 400, "critical").otherwise("warning"))
    return R.recent(e.crossJoin(e.agg(F.max("ts").alias("now"))), F.col("now"), 24, "critical").select("event_id")  # one row


@query("""SELECT manifest_id, sample_id FROM (SELECT event_type AS manifest_id, event_id AS sample_id FROM events WHERE event_id % 4 = 0 OR event_id % 9 = 1 ORDER BY 1, 2 LIMIT 50)""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("manifest_id"), k.alias("sample_id"), F.when(k % 4 == 0, F.when(k % 8 == 0, "pending").otherwise("requires_review")).otherwise("approved").alias("privacy_status"), F.when(k % 9 == 1, "FLAGGED: face").otherwise("").alias("privacy_notes"))
    return R.for_review(s).select("manifest_id", "sample_id")


@query("""SELECT doc_id FROM documents ORDER BY sha256(concat('42:', doc_id)), doc_id LIMIT 25""")
def seeded_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.subset(_docs(spark, sf_dir), "doc_id", 25).select("doc_id")


@query("""SELECT source, doc_id, (k // 16)::INT AS sheet, (k % 16)::INT AS cell FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)""")
def contact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sheets(_docs(spark, sf_dir), "source", "doc_id", 16).select("source", "doc_id", "sheet", "cell")


@query("""WITH s AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, h::VARCHAR AS hour, (sum(n) OVER w)::BIGINT AS so_far, round(CASE WHEN h > first_value(h) OVER w THEN sum(n) OVER w / epoch(h - first_value(h) OVER w) END, 9) AS rate FROM s WINDOW w AS (PARTITION BY event_type ORDER BY h)""")
def scan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"h": F.date_trunc("hour", "ts"), "one": F.lit(1)})
    p = R.progress(e, "event_type", "h", "one")
    return p.select("event_type", F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hour"), "so_far", F.round("rate", 9).alias("rate"))


@query("""WITH s AS (SELECT source, count(*) AS total, count(l.doc_id) AS current, count(*) FILTER (toxic = 1) AS errors FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source) SELECT count(*) AS datasets, sum(total)::BIGINT AS items, sum(current)::BIGINT AS processed, sum(errors)::BIGINT AS errors, round(sum(current) / sum(total) * 100, 6) AS percent FROM s""")
def progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").withColumn("has", F.lit(1))
    s = _docs(spark, sf_dir).join(l, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("has").alias("current"), F.count_if(F.col("toxic") == 1).alias("errors"))
    return R.progress_summary(s).withColumn("percent", F.round("percent", 6))


@query("""SELECT suite, event_id, value FROM (SELECT event_type AS suite, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("suite"), F.struct("ts", "event_id").alias("timestamp"), "event_id", "value")
    return R.latest_runs(runs).select("suite", "event_id", "value")


@query("""SELECT l_orderkey AS doc_id, round(min(least(x, y)), 2) AS lowest, round((sum(x) + sum(y)) / (2 * count(*)), 2) AS mean, round(max(greatest(x, y)), 2) AS highest, count(*) AS images, count(*) FILTER (least(x, y) < 150) AS low, count(*) FILTER (least(x, y) < 150) > 0 AS upscale FROM (SELECT l_orderkey, l_quantity * 8 AS x, l_linenumber * 60.0 AS y FROM lineitem) GROUP BY 1""")
def pdf_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") * 8).alias("x"), (F.col("l_linenumber") * 60.0).alias("y"))
    return R.resolution_summary(l, "doc_id", "x", "y")


@query("""SELECT l_orderkey AS doc_id, round(avg(l_tax + 0.00003), 4) AS mos, CASE WHEN count(*) >= 2 THEN round(1 - abs(arg_min(l_tax, (l_linenumber, l_suppkey, l_partkey)) - list_sort(list({'n': l_linenumber, 's': l_suppkey, 'p': l_partkey, 't': l_tax}))[2].t), 4) ELSE 1.0 END AS agreement FROM lineitem GROUP BY 1""")
def score_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_tax"))), lambda x: x["l_tax"] + 0.00003)
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(s.alias("s")).select("doc_id", R.ensemble(F.col("s")).alias("e"))
    return g.select("doc_id", "e.mos", "e.agreement")


@query("""SELECT conv_id, coalesce(sum(CASE WHEN role = 'user' THEN n END), 0) / sum(n) AS asks, coalesce(sum(CASE WHEN role <> 'user' THEN n END), 0) / sum(n) AS tells FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a document's kinds, as a map, by the class that each kind belongs to."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").cast("double").alias("n"))
    g = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"), F.sum("n").alias("t"))
    m = R.remapped(F.col("m"), lambda k: F.when(k == "user", "asks").otherwise("tells"))
    return g.select("conv_id", *((F.coalesce(m[n], F.lit(0.0)) / F.col("t")).alias(n) for n in ("asks", "tells")))


@query("""SELECT l_orderkey AS doc_id, coalesce(max(l_tax) FILTER (l_returnflag = 'R'), 0) AS blur, coalesce(max(l_tax) FILTER (l_returnflag = 'A'), 0) AS skew, coalesce(max(l_tax) FILTER (l_returnflag = 'R'), 0) + coalesce(max(l_tax) FILTER (l_returnflag = 'A'), 0) AS total FROM lineitem GROUP BY 1""")
def issue_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "blur").when(F.col("l_returnflag") == "A", "skew").otherwise("unheard")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.struct(kind.alias("type"), F.col("l_tax").alias("confidence"))).alias("i"))
    v = g.select("doc_id", R.issues_to_vector(F.col("i")).alias("v"))
    return v.select("doc_id", F.get("v", 0).alias("blur"), F.get("v", 13).alias("skew"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""SELECT doc_id, array_to_string(list_filter(['--pipeline=' || CASE WHEN doc_id % 2 = 0 THEN 'standard' ELSE 'vlm' END, CASE WHEN doc_id % 2 = 1 THEN '--vlm-model=m' END, CASE WHEN doc_id % 3 = 0 THEN '--no-ocr' WHEN doc_id % 5 = 0 THEN '--force-ocr' END,
  CASE WHEN doc_id % 7 = 0 THEN '--ocr-engine=fast' END, '--ocr-lang=' || lang, CASE WHEN doc_id % 4 = 0 THEN '--psm=6' END, CASE WHEN doc_id % 6 = 0 THEN '--no-tables' ELSE '--table-mode=fast' END, CASE WHEN doc_id % 8 = 0 THEN '--enrich-code' END, CASE WHEN doc_id % 9 = 0 THEN '--enrich-formula' END, '--page-batch-size=4'], lambda x: x IS NOT NULL), ' ') AS args FROM documents""")
def reading_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    p = F.struct(F.when(k % 2 == 0, "standard").otherwise("vlm").alias("pipeline"), F.when(k % 2 == 1, "m").otherwise("").alias("vlm_model"), (k % 3 != 0).alias("ocr_enabled"), (k % 5 == 0).alias("ocr_force"), F.when(k % 7 == 0, "fast").otherwise("auto").alias("ocr_engine"), F.col("lang").alias("ocr_lang"), F.when(k % 4 == 0, 6).alias("psm"), (k % 6 != 0).alias("tables_enabled"), F.lit("fast").alias("table_mode"), (k % 8 == 0).alias("enrich_code"), (k % 9 == 0).alias("enrich_formula"), F.lit(4).alias("page_batch_size"))
    return _docs(spark, sf_dir).withColumn("p", p).select("doc_id", F.array_join(R.cli_args(F.col("p")), " ").alias("args"))


@query("""SELECT * FROM (VALUES ('blur_rmse', 0.04, 0.05, true), ('skew_mae', 0.7, 0.5, false), ('ssim', 0.9, 0.9, true), ('psnr', 29.0, 30.0, false)) t(metric, value, target, passed) WHERE (SELECT count(*) FROM region) > 0""")
def metric_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("blur_rmse", 0.04), ("skew_mae", 0.7), ("ssim", 0.9), ("psnr", 29.0), ("mood", 1.0)], "metric string, value double")
    return R.metric_targets(rows).select("metric", "value", "target", "passed")


@query("""WITH p AS (SELECT l_suppkey AS image, l_quantity > 25 AS t, l_quantity + l_tax * 100 > 28 AS f FROM lineitem), c AS (SELECT image, count(*) FILTER (t AND f) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (t AND NOT f) AS fn, count(*) AS n FROM p GROUP BY image)
SELECT image, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f, round((fp + fn) / n, 6) AS error_rate FROM c""")
def binarization_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.binarization(F.col("l_quantity") > 25, F.col("l_quantity") + F.col("l_tax") * 100 > 28)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image")).agg(*(F.round(c, 6).alias(k) for k, c in m.items()))


@query("""WITH r AS (SELECT l_linenumber AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem), s AS (SELECT g, sum(r) AS r, count(*) AS n FROM r GROUP BY g),
h AS (SELECT 12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1) AS h FROM s),
m AS (SELECT avg(l_tax) FILTER (l_quantity > 25) AS ma, var_samp(l_tax) FILTER (l_quantity > 25) AS va, count(*) FILTER (l_quantity > 25) AS na, avg(l_tax) FILTER (l_quantity <= 25) AS mb, var_samp(l_tax) FILTER (l_quantity <= 25) AS vb, count(*) FILTER (l_quantity <= 25) AS nb FROM lineitem)
SELECT round(h, 4) AS h, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 8) AS d FROM h, m""")
def group_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    d = R.group_difference(l, "l_tax", F.col("l_quantity") <= 25, F.col("l_quantity") > 25)
    return R.kruskal(l, "l_quantity", "l_linenumber").crossJoin(d).select(F.round("h", 4).alias("h"), F.round("d", 8).alias("d"))  # one row each


@query("""WITH q AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM documents) SELECT lang, ((n_chars > q[1])::INT + (n_chars > q[2])::INT + (n_chars > q[3])::INT) AS quartile, count(*) AS documents FROM documents, q GROUP BY ALL""")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quartile_of(_docs(spark, sf_dir), "n_chars").groupBy("lang", "quartile").agg(F.count("*").alias("documents"))


@query("""WITH r AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 10 = 0) SELECT count(*) FILTER (sha256(text) IN (SELECT h FROM r)) AS known, count(*) FILTER (sha256(text) NOT IN (SELECT h FROM r)) AS fresh, (SELECT count(DISTINCT source) FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 5)) AS pending FROM documents""")
def known_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether a registry of hashes knows them, and sources that aren't done."""
    d = _docs(spark, sf_dir).withColumn("h", F.sha2("text", 256))
    marked = R.registered(d, d.filter("doc_id % 10 = 0"), "h").agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("fresh"))
    left = R.pending(d, d.filter("doc_id < 5"), "source").agg(F.count("*").alias("pending"))
    return marked.crossJoin(left)  # one row each
