import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import scalars as S
from pagemill.operators import evaluation as E
from pagemill.operators import prefix, records


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(x), int(n)) for g, x, n in zip(rng.integers(0, 3, 500), rng.integers(0, 90, 500), rng.integers(1, 5, 500), strict=True)]
    got = prefix.running_sums(spark.createDataFrame(rows, "g int, x double, n int"), "x", ["n"], ["g"], parts=7).collect()
    assert len(got) == 500 and all(r.upto_n == sum(n for g, x, n in rows if g == r.g and x <= r.x) for r in got)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=301).round(2)
    got = prefix.percentiles(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", {"a": 0.1, "b": 0.5, "c": 0.95, "d": 1.0, "e": 0.0}).first()
    assert np.allclose(list(got), np.percentile(x, [10, 50, 95, 100, 0]))


def test_isotonic_against_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 200, 600).astype(float)
    y = x / 50 + rng.normal(size=600)
    xs = np.unique(x)
    means, n = np.array([y[x == v].mean() for v in xs]), np.array([(x == v).sum() for v in xs])
    # the largest over beginnings of the smallest over ends of the mean between them
    want = [max(min(np.average(means[i : j + 1], weights=n[i : j + 1]) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]
    got = E.isotonic(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double"), "x", "y", parts=9).orderBy("x").collect()
    assert [r.x for r in got] == xs.tolist() and np.allclose([r.fitted for r in got], want)


def test_bootstrap_against_resampling(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = x + rng.normal(size=400)
    ranks = lambda v: np.argsort(np.argsort(v)).astype(float)
    picks = rng.integers(0, 400, (1000, 400))
    rx, ry = ranks(x), ranks(y)
    c = [np.corrcoef(rx[p], ry[p])[0, 1] for p in picks]
    got = E.bootstrap_ci(spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x double, y double"), "x", "y", ["k"]).first()
    assert np.allclose(list(got), [np.mean(c), *np.percentile(c, [2.5, 97.5])], atol=0.015)


def test_average_precision_against_force(spark):
    rng = np.random.default_rng(4)
    box = lambda: [float(v) for v in (lambda a: [*a, *(a + rng.integers(5, 15, 2))])(rng.integers(0, 20, 2))]
    truth = [(int(rng.integers(0, 12)), int(rng.integers(0, 2)), box()) for _ in range(60)]
    found = [(i, c, round(float(rng.random()), 3), [v + float(rng.integers(-2, 3)) for v in b]) for i, c, b in truth for _ in range(2)]
    found += [(int(rng.integers(0, 12)), int(rng.integers(0, 2)), round(float(rng.random()), 3), box()) for _ in range(30)]

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    def force(cls, least):
        free = [(i, b) for i, c, b in truth if c == cls]
        n, hits = len(free), []
        for i, _, s, b in sorted((f for f in found if f[1] == cls), key=lambda f: -f[2]):
            best = max((k for k, (j, _) in enumerate(free) if j == i), key=lambda k: overlap(b, free[k][1]), default=None)
            ok = best is not None and overlap(b, free[best][1]) >= least
            if ok:
                free.pop(best)
            hits.append((s, ok))
        curve = []
        for s in sorted({s for s, _ in hits}):
            some = [ok for t, ok in hits if t >= s]
            curve.append((sum(some) / n, sum(some) / len(some)))
        return sum(max((p for r, p in curve if r * 100 + 1e-9 >= k), default=0.0) for k in range(101)) / 101

    p, t = spark.createDataFrame(found, "image long, class int, score double, box array<double>"), spark.createDataFrame(truth, "image long, class int, box array<double>")
    got = {(r.threshold, r["class"]): r.ap for r in E.average_precision(E.match_detections(p, t, (0.5, 0.75)), t).collect()}
    assert set(got) == {(a, c) for a in (0.5, 0.75) for c in (0, 1)} and all(abs(v - force(c, a)) < 1e-9 for (a, c), v in got.items())
    assert abs(E.mean_average_precision(p, t).first().map - np.mean([force(c, a) for a in E.THRESHOLDS for c in (0, 1)])) < 1e-9


def test_normal_tail(spark):
    for z in (0.0, 0.5, -1.96, 3.0):
        assert abs(one(spark, S.normal_tail(F.lit(z)))[0] - math.erfc(abs(z) / math.sqrt(2))) < 2e-7


def test_lists_agree_whatever_their_order(spark):
    a, b = F.array(F.lit("X"), F.lit("y")), F.array(F.lit("Y"), F.lit("x"))
    assert one(spark, S.same_values(a, b), S.same_values(a, F.lit(None).cast("array<string>")), S.same_value(F.lit(None).cast("string"), F.lit("x"))) == (True, False, False)


def test_migration_paths():
    steps = [("1.0", "1.1"), ("1.1", "1.2"), ("1.0", "2.0"), ("2.0", "2.1")]
    assert records.migration_path(steps, "1.2", "2.1") == [("1.2", "1.1"), ("1.1", "1.0"), ("1.0", "2.0"), ("2.0", "2.1")]
    with pytest.raises(ValueError, match="no way"):
        records.migration_path(steps, "1.0", "3.0")


def test_dead_letters_are_set_aside(spark):
    good, bad = records.dead_letters(spark.createDataFrame([(1, None), (2, "boom")], "id int, error string"), F.col("error").isNotNull())
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [2]


def test_checksum_names_a_histogram(spark):
    import hashlib
    import json

    h, e = [0.25, 0.5, 0.25], [0.0, 1.0, 2.0, 3.5]
    got = one(spark, S.checksum(F.array(*map(F.lit, h)), F.array(*map(F.lit, e))))[0]
    assert got == hashlib.sha256(json.dumps({"histogram": h, "bin_edges": e}, sort_keys=True).encode()).hexdigest()[:16]
