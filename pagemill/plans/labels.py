"""Queries of boxes, papers, resolution, label conversion, licenses, scripts and source priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geometry as G
from ..operators import taxonomy as T
from .fixtures import PAGES, pages, table


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round((l_linenumber * 10.0::DOUBLE + l_quantity / 2) / 1000, 9) AS cx, round((5.0::DOUBLE + l_tax * 500) / 1000, 9) AS cy, round(l_quantity / 1000, 9) AS w, round(l_tax, 9) AS h FROM lineitem")
def bbox_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From corners to centre and size as shares, by way of the hub format."""
    l = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_linenumber") * 10.0, F.lit(5.0)
    box = G.from_coco(*G.to_coco(x, y, x + F.col("l_quantity"), y + F.col("l_tax") * 1000, "xyxy"), "yolo", 1000.0, 1000.0)
    return l.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", *(F.round(c, 9).alias(n) for n, c in zip(("cx", "cy", "w", "h"), box, strict=True)))


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber * 20.0 AS x1, 0.0 AS y1, l_linenumber * 20.0 + l_quantity AS x2, 30.0 AS y2, l_linenumber AS n FROM lineitem),
p AS (SELECT a.k, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, a.x2 - a.x1 AS wa, b.x2 - b.x1 AS wb FROM b a JOIN b ON a.k = b.k AND b.n = a.n + 1)
SELECT k AS image, count(*) AS pairs, round(max(CASE WHEN w > 0 THEN w * 30 / (wa * 30 + wb * 30 - w * 30) ELSE 0 END), 6) AS largest FROM p GROUP BY k""")
def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evaluation import iou

    x = F.col("l_linenumber") * 20.0
    box = F.struct(x.alias("x1"), F.lit(0.0).alias("y1"), (x + F.col("l_quantity")).alias("x2"), F.lit(30.0).alias("y2"))
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    p = b.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("box").alias("a")).join(b.withColumnRenamed("box", "b"), ["l_orderkey", "l_linenumber"])
    return p.groupBy(F.col("l_orderkey").alias("image")).agg(F.count("*").alias("pairs"), F.round(F.max(iou("a", "b")), 6).alias("largest"))


_PAPERS = ", ".join(f"({k}, '{n}', {float(min(a, b))}::DOUBLE, {float(max(a, b))}::DOUBLE)" for k, (n, a, b) in enumerate(G.PAPERS))


@query(f"""WITH s(k, name, a, b) AS (VALUES {_PAPERS}), p AS (SELECT p_partkey, 100.0::DOUBLE + p_size * 5 AS w, (100.0::DOUBLE + p_size * 5) * (1.3::DOUBLE + p_partkey % 3 * 0.0571::DOUBLE) AS h FROM part),
o AS (SELECT p_partkey, k, name, greatest(abs(least(w, h) - a) / a, abs(greatest(w, h) - b) / b) AS off FROM p, s), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY off, k) AS n FROM o WHERE off <= 0.03)
SELECT p_partkey, name AS paper, round(1 - off / 0.03 * 0.5, 6) AS confidence FROM part LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (p_partkey)""")
def paper_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = 100.0 + F.col("p_size") * 5
    h = w * (1.3 + F.col("p_partkey") % 3 * 0.0571)
    return G.paper_size(table(spark, sf_dir, "part"), w, h).select("p_partkey", "paper", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH r AS (SELECT doc_id, height, sum(area) OVER (PARTITION BY doc_id ORDER BY height, area RANGE UNBOUNDED PRECEDING) AS upto, sum(area) OVER (PARTITION BY doc_id) AS total FROM ({PAGES}))
SELECT doc_id, min(height) AS weighted_median FROM r WHERE upto >= total / 2 GROUP BY doc_id""")
def weighted_median_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first height at which the running area reaches half of all."""
    w = Window.partitionBy("doc_id")
    r = pages(spark, sf_dir).withColumns({"upto": F.sum("area").over(w.orderBy("height", "area").rangeBetween(Window.unboundedPreceding, 0)), "total": F.sum("area").over(w)})
    return r.filter(F.col("upto") >= F.col("total") / 2).groupBy("doc_id").agg(F.min("height").alias("weighted_median"))


_SCORE = "CASE WHEN height < 0 THEN 0.0 " + " ".join(f"WHEN height < {x1} THEN {y0}::DOUBLE + (height - {x0}) / ({x1} - {x0}) * ({y1}::DOUBLE - {y0}::DOUBLE)" for (x0, y0), (x1, y1) in zip(G.KNOTS, G.KNOTS[1:], strict=False)) + " ELSE least(1.0, 0.95 + (height - 96) / 200 * 0.05) END"
_REGIONS = f"SELECT doc_id, 2 * height - 4 AS height, area, has_figures AS counted FROM ({PAGES})"


@query(f"""WITH p AS ({_REGIONS}), r AS (SELECT doc_id, height, sum(area) OVER (PARTITION BY doc_id ORDER BY height RANGE UNBOUNDED PRECEDING) AS upto, sum(area) OVER (PARTITION BY doc_id) AS total FROM p),
m AS (SELECT doc_id, min(height) AS height FROM r WHERE upto >= total / 2 GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n, bool_or(counted) AS counted, quantile_cont(height, 0.25) AS p25, quantile_cont(height, 0.75) AS p75, round(CASE WHEN avg(height) > 0 THEN stddev_pop(height) / avg(height) ELSE 0 END, 9) AS cv FROM p GROUP BY doc_id),
c AS (SELECT *, round(least(1.0::DOUBLE, n / 10) * greatest(0.0::DOUBLE, 1 - cv) * CASE WHEN counted THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END, 4) AS confidence FROM a JOIN m USING (doc_id))
SELECT doc_id, round({_SCORE}, 9) AS score, height AS char_height, p25, p75, cv, CASE WHEN height < 0 THEN 'oversized' WHEN height < 16 THEN 'needs_major_upscale' WHEN height < 32 THEN 'needs_light_upscale' WHEN height < 48 THEN 'optimal' WHEN height < 96 THEN 'good' ELSE 'oversized' END AS bucket,
  CASE WHEN counted THEN 'stage_1_2' ELSE 'stage_1_only' END AS method, CASE WHEN n < 3 THEN least(confidence, 0.3::DOUBLE) ELSE confidence END AS confidence, n < 3 OR confidence < 0.4 OR cv > 0.5 AS review FROM c""")
def resolution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("doc_id", (2 * F.col("height") - 4).alias("height"), "area", F.col("has_figures").alias("counted"))
    return G.resolution(p, "doc_id", "height", "area", "counted").withColumn("score", F.round("score", 9))


_NATIVES = list(T.SCHEMAS["docstructbench"]) + ["unknown"]
_MAP = ", ".join(f"('{s}', '{n}', '{c}')" for s, m in T.SCHEMAS.items() for n, c in m.items())
_UP = ", ".join([f"('{r}', '{r}', 0)" for r in [*T.ROOTS, "FORM"]] + [f"('{c}', '{p}', 1)" for p, cs in T.CHILDREN.items() for c in cs])


@query(f"""WITH t(schema, native, canonical) AS (VALUES {_MAP}), a(label, root, depth) AS (VALUES {_UP}), p AS (SELECT p_partkey, ({_NATIVES})[p_partkey % {len(_NATIVES)} + 1] AS native FROM part),
back AS (SELECT canonical, min(native) AS target, count(*) AS n FROM t WHERE schema = 'doclaynet' GROUP BY 1)
SELECT p.native, coalesce(b.target, c.target, '(unmapped)') AS converted, CASE WHEN b.target IS NOT NULL THEN 1 / b.n WHEN c.target IS NOT NULL THEN 1.0 ELSE 0.0 END AS confidence, b.target IS NULL AND c.target IS NOT NULL AS lossy, count(*) AS labels
FROM p LEFT JOIN (SELECT * FROM t WHERE schema = 'docstructbench') h ON p.native = h.native LEFT JOIN back b ON b.canonical = h.canonical LEFT JOIN a ON a.label = h.canonical LEFT JOIN back c ON c.canonical = a.root GROUP BY ALL""")
def taxonomy_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in _NATIVES))
    p = table(spark, sf_dir, "part").select(F.element_at(names, (F.col("p_partkey") % len(_NATIVES) + 1).cast("int")).alias("native"))
    return T.convert(p, "native", "docstructbench", "doclaynet").groupBy("native", "converted", "confidence", "lossy").agg(F.count("*").alias("labels"))


_PARENTS = "SELECT 's' || s_suppkey AS label, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 7 = 3 THEN 'n' || ((n_nationkey + 7) % 21) WHEN n_nationkey = 5 THEN 'lost' ELSE 'r' || n_regionkey END FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region"


@query(f"""WITH RECURSIVE p AS ({_PARENTS}), w(label, place, depth, path) AS (SELECT label, label, 0, [label] FROM p
  UNION ALL SELECT w.label, p.parent, w.depth + 1, list_append(w.path, p.parent) FROM w JOIN p ON p.label = w.place WHERE p.parent IS NOT NULL AND NOT list_contains(w.path, p.parent)),
e AS (SELECT label, arg_max(place, depth) AS place, max(depth) AS depth FROM w GROUP BY label)
SELECT e.label, CASE WHEN p.label IS NOT NULL AND p.parent IS NULL THEN e.place END AS root, e.depth::INT AS depth FROM e LEFT JOIN p ON p.label = e.place""")
def taxonomy_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Way of each supplier, nation and region up to a root; some nations stand in a cycle, one has a parent that isn't there."""
    k = F.col("n_nationkey")
    named = lambda c, letter: F.concat(F.lit(letter), F.col(c).cast("string"))
    nations = F.when(k % 7 == 3, F.concat(F.lit("n"), ((k + 7) % 21).cast("string"))).when(k == 5, "lost").otherwise(named("n_regionkey", "r"))
    parents = table(spark, sf_dir, "supplier").select(named("s_suppkey", "s").alias("label"), named("s_nationkey", "n").alias("parent"))
    parents = parents.unionByName(table(spark, sf_dir, "nation").select(named("n_nationkey", "n").alias("label"), nations.alias("parent")))
    return T.walk(parents.unionByName(table(spark, sf_dir, "region").select(named("r_regionkey", "r").alias("label"), F.lit(None).cast("string").alias("parent"))))


@query(f"SELECT * FROM (VALUES {_UP}) a(label, root, depth)")
def taxonomy_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ancestors(spark)


_LICENSES = ["MIT", "mit license", "LGPL v3", "GNU GPL v2", "CC BY-NC 4.0", "CC-BY-SA-4.0", "CC BY 4.0", "Apache-2.0", "research only", "Public Domain", "proprietary", "CC-BY-ND-4.0", "generated", "generated, NC only", "Limited use", "permitted with permission", "mixed (see files)", "Unknown", "ODbL", "CC0-1.0", "apache-2.0 with a non-commercial rider"]
_LICENSE = "CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(lower(trim(raw)), '\\s+', '-', 'g'), '{r}') THEN '{n}'" for n, r in T.LICENSES) + " ELSE 'unspecified' END"


@query(f"WITH p AS (SELECT ({_LICENSES})[p_partkey % {len(_LICENSES)} + 1] AS raw FROM part) SELECT raw, {_LICENSE} AS license, count(*) AS parts FROM p GROUP BY ALL")
def license_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*(F.lit(x) for x in _LICENSES)), (F.col("p_partkey") % len(_LICENSES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(raw.alias("raw")).groupBy("raw", T.license_class(F.col("raw")).alias("license")).agg(F.count("*").alias("parts"))


@query("""WITH l(dataset, license) AS (VALUES ('src_1', 'MIT'), ('SRC 2', 'CC-BY-NC-4.0'), ('Src-3', 'research only'))
SELECT coalesce(license, CASE WHEN n LIKE 'synth%' THEN 'generated' END) AS license, CASE license WHEN 'MIT' THEN 'permissive' WHEN 'CC-BY-NC-4.0' THEN 'non_commercial' WHEN 'research only' THEN 'research_only' ELSE CASE WHEN n LIKE 'synth%' THEN 'generated' ELSE 'unspecified' END END AS license_class, count(*) AS documents
FROM (SELECT CASE WHEN doc_id % 6 = 5 THEN 'synthset' ELSE 'src' || doc_id % 6 END AS n FROM documents) d LEFT JOIN l ON regexp_replace(lower(l.dataset), '[^a-z0-9]', '', 'g') = d.n GROUP BY ALL""")
def dataset_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("src_1", "MIT"), ("SRC 2", "CC-BY-NC-4.0"), ("Src-3", "research only")], "dataset string, license string")
    k = F.col("doc_id") % 6
    docs = table(spark, sf_dir, "documents").select(F.when(k == 5, "Synth-Set").otherwise(F.concat(F.lit("SRC_"), k.cast("string"))).alias("dataset"))
    return T.with_license(docs, "dataset", known).groupBy("license", "license_class").agg(F.count("*").alias("documents"))


@query("""WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS first, avg(length(text)) AS mean FROM conversations GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS kinds, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first, role) AS k FROM c)
SELECT conv_id, role AS dominant, round(n / total, 4) AS share, round(mean, 4) AS mean_length, kinds > 1 AS mixed FROM r WHERE k = 1""")
def script_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant kind of each document: most pages, ties to the first seen."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.avg(F.length("text")).alias("mean"))
    best = c.groupBy("conv_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "role", "n", "mean")).alias("b"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return best.select("conv_id", F.col("b.role").alias("dominant"), F.round(F.col("b.n") / F.col("total"), 4).alias("share"), F.round("b.mean", 4).alias("mean_length"), (F.col("kinds") > 1).alias("mixed"))


_SCRIPTS = ["Latn", "Hira", "Mymr", "Zzzz", "Ethi"]
_CLASS = "CASE " + " ".join(f"WHEN code IN ({', '.join(repr(c) for c in codes)}) THEN '{n}'" for n, codes in T.SCRIPT_CLASSES.items()) + " ELSE 'OTHER' END"


@query(f"WITH d AS (SELECT doc_id, ({_SCRIPTS})[doc_id % 5 + 1] AS code, (doc_id % 100) / 100 AS confidence FROM documents) SELECT code, {_CLASS} AS class, code IN ('Tibt', 'Ethi', 'Mymr') OR code = 'Zzzz' OR confidence < 0.5 AS escalate, count(*) AS documents FROM d GROUP BY ALL")
def script_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*(F.lit(x) for x in _SCRIPTS)), (F.col("doc_id") % 5 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select(code.alias("code"), (F.col("doc_id") % 100 / 100).alias("confidence"))
    escalate = F.col("code").isin("Tibt", "Ethi", "Mymr", "Zzzz") | (F.col("confidence") < 0.5)
    return d.groupBy("code", T.script_class(F.col("code")).alias("class"), escalate.alias("escalate")).agg(F.count("*").alias("documents"))


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'parser' WHEN l.quality IS NOT NULL THEN 'train' WHEN n_chars > 500 THEN 'vlm' ELSE 'dataset' END AS source, CASE WHEN d.doc_id % 4 = 0 THEN 0.95 WHEN l.quality IS NOT NULL THEN 0.90 WHEN n_chars > 500 THEN 0.75 ELSE 0.50 END::DOUBLE AS confidence
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source in order of priority that has a value, and its confidence."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    has = (("parser", 0.95, F.col("doc_id") % 4 == 0), ("train", 0.90, F.col("quality").isNotNull()), ("vlm", 0.75, F.col("n_chars") > 500), ("dataset", 0.50, F.lit(True)))
    best = F.coalesce(*(F.when(c, F.struct(F.lit(n).alias("source"), F.lit(x).alias("confidence"))) for n, x, c in has))
    return d.select("doc_id", best.alias("b")).select("doc_id", "b.source", "b.confidence")


_VECTOR = "SELECT vec_id, list_transform(embedding[1:45], lambda x: least(1.0, abs(x::DOUBLE))) AS v FROM embeddings"
_ISSUE = "CASE " + " ".join(f"WHEN i IN ({', '.join(map(str, at))}) THEN '{n}'" for n, at in T.ISSUES.items()) + " END"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 45), lambda x: F.least(F.lit(1.0), F.abs(x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))


@query(f"""WITH e AS (SELECT vec_id, unnest(v) AS x, unnest(range(45)) AS i FROM ({_VECTOR})), g AS (SELECT vec_id, {_ISSUE} AS issue, max(x) AS score, count(*) AS n FROM e WHERE x >= 0.1 GROUP BY ALL HAVING max(x) >= 0.2)
SELECT vec_id, issue, round(score, 6) AS score, n, CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM g""")
def iqa_vector_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.vector_issues(_vectors(spark, sf_dir), "vec_id", "v", 0.1, 0.2).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, " + ", ".join(f"round(list_max(v[{a + 1}:{b}]), 6) AS {k}" for k, (a, b) in {"blur": (0, 6), "noise": (6, 13), "geometric": (13, 19), "illumination": (19, 26), "compression": (26, 30), "physical": (30, 37), "text": (37, 42), "scanner": (42, 45)}.items()) + f" FROM ({_VECTOR})")
def degradation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", *(F.round(c, 6).alias(k) for k, c in T.degradation_groups(F.col("v")).items()))


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of 32 columns made of the bytes of each whole text, as a stand-in for a page; texts of up to 1,024 bytes are repeated and padded to 32 rows."""
    size = F.octet_length("text")
    height = F.greatest(F.lit(32), F.ceil(size / 32)).cast("int")
    filled = F.when(size > 1024, F.concat(F.col("text"), F.repeat(F.lit(" "), 31))).otherwise(F.concat(F.repeat("text", 4), F.repeat(F.lit(" "), 1024)))
    data = F.encode(filled, "UTF-8").substr(F.lit(1), height * 32)
    return table(spark, sf_dir, "documents").select("doc_id", F.struct(height.alias("height"), F.lit(32).alias("width"), data.alias("data")).alias("raster"))


@query()
def raster_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import raster

    return _rasters(spark, sf_dir).withColumn("s", raster.signals(F.col("raster"))).select("doc_id", "s.laplacian", "s.skew_degrees")


@query()
def raster_text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import raster

    rows = _rasters(spark, sf_dir).withColumn("s", raster.signals(F.col("raster")))
    return rows.select("doc_id", raster.has_text("s").alias("has_text"), raster.blank("s").alias("blank"), F.col("s.edge_density").alias("edge_density"))
