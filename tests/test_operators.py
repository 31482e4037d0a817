import numpy as np
from pyspark.sql import functions as F

from pagemill.operators import drift, evaluation, splits
from pagemill.sources import store


def test_average_precision_by_hand(spark):
    truth = spark.createDataFrame([(1, 0, [0.0, 0.0, 10.0, 10.0]), (2, 0, [0.0, 0.0, 10.0, 10.0])], "image long, class int, box array<double>")
    found = spark.createDataFrame([(1, 0, 0.9, [0.0, 0.0, 10.0, 10.0]), (1, 0, 0.8, [0.0, 0.0, 10.0, 10.0]), (3, 1, 0.5, [0.0, 0.0, 1.0, 1.0])], "image long, class int, score double, box array<double>")
    matches = evaluation.match_detections(found, truth)  # at 0.5
    assert {(r.image, r.score): r.hit for r in matches.collect()} == {(1, 0.9): True, (1, 0.8): False, (3, 0.5): False}
    assert abs(evaluation.average_precision(matches, truth).first().ap - 51 / 101) < 1e-9


def test_allocation_exceeds_target_with_many_strata(spark):
    counts = spark.createDataFrame([(str(k), 1) for k in range(40)], "s string, n long")
    assert all(r.take == 1 for r in splits.allocation(counts, "s", 36).collect())


def test_near_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 6)
    codes = [int(b) ^ int(sum(1 << int(x) for x in rng.choice(62, rng.integers(0, 7), replace=False))) for b in base for _ in range(8)]
    got = {(r.a, r.b) for r in splits.near_pairs(spark.createDataFrame(list(enumerate(codes)), "k long, c long"), "k", "c").collect()}
    assert got == {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bin(codes[i] ^ codes[j]).count("1") <= 5}


def test_isotonic_rises(spark):
    rows = [(float(k), float((k * 7) % 5 + k / 10)) for k in range(60)]
    fitted = [r.fitted for r in evaluation.isotonic(spark.createDataFrame(rows, "x double, y double"), "x", "y").orderBy("x").collect()]
    assert fitted == sorted(fitted)


def test_shrunk_precision_is_symmetric(spark):
    rows = [([float(x) for x in np.random.default_rng(k).normal(size=4)],) for k in range(50)]
    mean, precision = drift.shrunk_precision(spark.createDataFrame(rows, "v array<double>"), "v", 4)
    assert np.allclose(precision, precision.T) and np.all(np.linalg.eigvalsh(precision) > 0)


def test_sample_store(spark, tmp_path):
    s = store.SampleStore(spark, f"file://{tmp_path}/t")
    rows = spark.range(10).selectExpr("id", "cast(id as string) as name")
    s.write("My Set", rows)
    s.append("My Set", rows)
    s.write("other", rows.limit(3))
    s.write("none", rows.limit(0))
    assert s.datasets() == ["my_set", "other"] and s.read("My Set").count() == 20
    s.compact("My Set")
    spark.catalog.clearCache()
    assert {r.dataset_name: (r.files, r.rows) for r in s.stats().collect()} == {"my_set": (1, 20), "other": (1, 3)}
    assert s.delete("other") and s.datasets() == ["my_set"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"filename": "x", "v": 1}\nbad\n{"filename": "y", "v": 2}\n{"filename": "x", "v": 3}\n')
    assert {(r.filename, r.v) for r in store.read_jsonl(spark, str(tmp_path / "a.jsonl"), "filename string, v int").collect()} == {("x", 3), ("y", 2)}
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "p"}, {"id": 2, "file_name": "q"}], "annotations": [{"image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}], "categories": []}')
    got = {r.file_name: [b.category for b in r.boxes] for r in store.read_coco(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"p": ["unknown"], "q": []}


def test_raster_kernels():
    from pagemill.functions import raster

    flat = np.full((20, 30), 200.0)
    assert raster.laplacian(flat).var() == 0 and raster.edges(flat) == 0
    x = np.full((60, 60), 255.0)
    x[::10] = 0
    assert raster.skew(x) == 0.0 and raster.edges(x) > 0.1


def test_rasters_hold_whole_texts(spark, monkeypatch):
    from pagemill.plans import labels

    texts = ["short text", "", None, "a" * 1024, "b" * 1025, "é" * 3000 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(labels, "table", lambda *_: docs)
    got = {r.doc_id: r.raster for r in labels._rasters(spark, "").collect()}
    assert [got[k].height for k in (0, 1, 3, 4, 5)] == [32, 32, 32, 33, 188] and got[2].data is None
    assert all(len(got[k].data) == got[k].height * 32 for k in (0, 1, 3, 4, 5))
    assert all(bytes(got[k].data).rstrip() == texts[k].encode() for k in (3, 4, 5))
    assert {r.doc_id for r in labels.raster_laplacian(spark, "").collect()} == set(range(6))


def test_detector_variance_at_its_threshold(spark):
    from pagemill.operators.routing import detector_confidence

    # population variance 0.3, which a sum of doubles exceeds in its last bit
    votes = [("a", 0.0487), ("b", 0.1287), ("c", 0.8887), ("d", 1.3687)]
    for some in (votes, votes[::-1]):
        df = spark.createDataFrame([(some,)], "votes array<struct<language string, confidence double>>")
        c = df.select(detector_confidence(df.votes).alias("c")).first().c
        assert round(c.variance, 9) == 0.3 and c.reason == "detector_disagreement"


def test_diagonal_distance_stays_small(spark):
    from pagemill.operators.prefix import percentiles

    rows = [(k, [float((k * j) % 7) for j in range(64)]) for k in range(40)] + [(40, None), (41, [1.0, None] + [0.0] * 62)]
    mean, var = [1.0] * 64, [4.0] * 64
    df = spark.createDataFrame(rows, "k long, v array<float>").select("k", drift.diagonal(F.col("v"), mean, var).alias("d"))
    got = {r.k: r.d for r in df.collect()}
    assert got[40] is None and abs(got[41] - (62 / 4) ** 0.5) < 1e-12
    assert all(abs(got[k] - sum((x - 1) ** 2 / 4 for x in v) ** 0.5) < 1e-9 for k, v in rows[:40])
    bound = percentiles(df, "d", {"p": 0.95})
    assert abs(bound.first().p - np.quantile([d for d in got.values() if d is not None], 0.95)) < 1e-9
    # the bounds of the ranges don't each bring the distance with them into a filter
    assert len(bound._jdf.queryExecution().optimizedPlan().toString()) < 200_000
