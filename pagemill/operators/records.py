"""Sample records: checks, versions, registries, comparisons of label sources, reviews, histories."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import same_value, utc_time
from .prefix import percentiles


def problems(checks: dict[str, Column]) -> Column:
    """Messages of the checks that hold (a message, and when it applies), in order."""
    return F.array_compact(F.array(*(F.when(c, m) for m, c in checks.items())))


def sample_errors(df: DataFrame) -> Column:
    """What is wrong with a sample record: missing fields, ids and hashes that aren't hex digits, times that aren't ISO 8601, versions below 0."""
    required = ("id", "file_hash", "dataset_name", "dataset_version", "original_path", "original_filename", "download_date")
    have = set(df.columns)
    checks = {f"missing {f}": F.col(f).isNull() if f in have else F.lit(True) for f in required}
    rules: dict[str, tuple[str, Callable[[Column], Column]]] = {
        "invalid id": ("id", lambda c: ~c.rlike("^[0-9a-f]{32}$")),
        "invalid file_hash": ("file_hash", lambda c: ~c.rlike("^[0-9a-f]{64}$")),
        "invalid download_date": ("download_date", lambda c: utc_time(c).isNull()),
        "invalid created_at": ("created_at", lambda c: utc_time(c).isNull()),
        "invalid current_version": ("current_version", lambda c: c < 0),
    }
    checks |= {m: F.col(f).isNotNull() & rule(F.col(f)) for m, (f, rule) in rules.items() if f in have}
    return problems(checks)


def enrichment_errors(vector: Column, boxes: Column, size: int = 45) -> Column:
    """What is wrong with an enrichment: a vector of another length or outside 0 to 1, boxes without area."""
    return problems({
        f"vector has not {size} values": vector.isNotNull() & (F.size(vector) != size),
        "vector outside 0 to 1": F.coalesce(F.exists(vector, lambda v: v.isNull() | (v < 0) | (v > 1)), F.lit(False)),
        "box without area": F.coalesce(F.exists(boxes, lambda b: (b["width"] <= 0) | (b["height"] <= 0)), F.lit(False)),
    })


def current_enrichment(versions: Column, current: Column) -> Column:
    """The version that the pointer names, null without one or at 0."""
    return F.when(current > 0, F.get(F.filter(versions, lambda v: v["version"] == current), 0))


def migration_path(steps: Sequence[tuple[str, str]], start: str, goal: str) -> list[tuple[str, str]]:
    """Shortest way from a schema version to another over steps, which go either way; ValueError if there is none."""
    ways = {start: []}
    todo = [start]
    while todo:
        at = todo.pop(0)
        if at == goal:
            return ways[at]
        for a, b in [s for pair in steps for s in (pair, pair[::-1])]:
            if a == at and b not in ways:
                ways[b] = [*ways[at], (a, b)]
                todo.append(b)
    raise ValueError(f"no way from {start} to {goal}")


def migrate(df: DataFrame, steps: dict[tuple[str, str], Callable[[DataFrame], DataFrame]], goal: str, version: str = "schema_version") -> DataFrame:
    """Rows of any version in the goal's: each version's rows go along their shortest way. steps: for each direction a function of rows."""
    pairs = list({tuple(sorted(s)) for s in steps})
    known = sorted({v for s in steps for v in s} | {goal})
    out = []
    for v in known:  # versions are few
        rows = df.filter(F.col(version) == v)
        for step in migration_path(pairs, v, goal) if any(v in s for s in steps) else []:
            rows = steps[step](rows).withColumn(version, F.lit(step[1]))
        out.append(rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def aligned(sources: dict[str, DataFrame], key: str, fields: Sequence[str]) -> DataFrame:
    """Full alignment of label sources (key and fields; one row a key counts, the smallest) by the key without folder and ending: image, and <field>_<source>."""
    plain = F.lower(F.regexp_replace(F.regexp_extract(F.col(key).cast("string"), r"([^/]*)$", 1), r"\.[A-Za-z0-9]{2,4}$", ""))
    each = [df.groupBy(plain.alias("image")).agg(*(F.min(f).alias(f"{f}_{name}") for f in fields)) for name, df in sources.items()]
    return reduce(lambda a, b: a.join(b, "image", "full"), each)


def agreement(wide: DataFrame, fields: Sequence[str], names: Sequence[str]) -> DataFrame:
    """field, a, b, compared, same: how often two sources agree on a field, where both have it."""
    pairs = [(f, a, b) for f in fields for k, a in enumerate(names) for b in names[k + 1 :]]
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"{f}_{a}").isNotNull() & F.col(f"{f}_{b}").isNotNull()).alias("both"), same_value(F.col(f"{f}_{a}").cast("string"), F.col(f"{f}_{b}").cast("string")).alias("same")) for f, a, b in pairs))
    return wide.select(F.inline(each)).groupBy("field", "a", "b").agg(F.count_if("both").alias("compared"), F.count_if("same").alias("same"))


def registered(df: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """df with known: whether the registry (append-only; keys may repeat) holds the key."""
    return df.join(registry.select(key).distinct().withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def pending(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys that aren't done yet."""
    return every.select(key).distinct().join(done.select(key), key, "left_anti")


def dead_letters(results: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that went well, and those that failed, set aside with their error."""
    return results.filter(~F.coalesce(failed, F.lit(False))), results.filter(F.coalesce(failed, F.lit(False)))


def recent(alerts: DataFrame, now: Column, hours: int = 24, severity: str | None = None, ts: str = "ts") -> DataFrame:
    """Alerts of the last hours, of a severity if one is named."""
    rows = alerts.filter(F.col(ts) > now - F.expr(f"interval {hours} hours"))
    return rows if severity is None else rows.filter(F.col("severity") == severity)


def for_review(samples: DataFrame, limit: int = 50, flagged: bool = True) -> DataFrame:
    """The first samples that wait for a review or were flagged, by manifest and sample."""
    waits = F.col("privacy_status").isin("pending", "requires_review")
    wanted = waits | F.col("privacy_notes").startswith("FLAGGED:") if flagged else waits
    return samples.filter(wanted).orderBy("manifest_id", "sample_id").limit(limit)


def subset(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, by the hash of seed and key."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def sheets(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """df with sheet (from 0) and cell: rows of a group dealt to sheets of size, in order."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return df.withColumn("sheet", F.floor(k / size).cast("int")).withColumn("cell", (k % size).cast("int"))


def progress(df: DataFrame, by: str, ts: str, done: str) -> DataFrame:
    """by, ts, so_far, rate: running number of done rows of a dataset and the rows a second since its first; a row for each time."""
    steps = df.groupBy(by, ts).agg(F.sum(done).alias("n"))
    w = Window.partitionBy(by).orderBy(ts)
    so_far = F.sum("n").over(w)
    passed = F.unix_timestamp(ts) - F.unix_timestamp(F.first(ts).over(w))
    return steps.select(by, ts, so_far.alias("so_far"), F.when(passed > 0, so_far / passed).alias("rate"))


def progress_summary(states: DataFrame) -> DataFrame:
    """datasets, items, processed, errors, percent over rows (total, current, errors) of datasets."""
    t, c = F.sum("total"), F.sum("current")
    return states.agg(F.count("*").alias("datasets"), t.alias("items"), c.alias("processed"), F.sum("errors").alias("errors"), F.when(t > 0, c / t * 100).otherwise(0.0).alias("percent"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each suite."""
    return runs.groupBy("suite").agg(F.max_by(F.struct(*(c for c in runs.columns if c != "suite")), "timestamp").alias("r")).select("suite", "r.*")


def resolution_summary(images: DataFrame, key: str, x: str, y: str, least: float = 150.0) -> DataFrame:
    """key, lowest, mean, highest (dots an inch over both axes), images, low (images below least on an axis), upscale."""
    low, high = F.least(x, y), F.greatest(x, y)
    g = images.groupBy(key).agg(F.round(F.min(low), 2).alias("lowest"), F.round((F.sum(x) + F.sum(y)) / (2 * F.count("*")), 2).alias("mean"), F.round(F.max(high), 2).alias("highest"), F.count("*").alias("images"), F.count_if(low < least).alias("low"))
    return g.withColumn("upscale", F.col("low") > 0)


def ensemble(scores: Column) -> Column:
    """Mean of a list of scores, and 1 less the distance of the first two."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, v: a + v) / n
    return F.struct(F.round(mean, 4).alias("mos"), F.when(n >= 2, F.round(1 - F.abs(F.get(scores, 0) - F.get(scores, 1)), 4)).otherwise(1.0).alias("agreement"))


def remapped(shares: Column, name: Callable[[Column], Column]) -> Column:
    """A map with its keys renamed; shares of one new name add up."""
    entries = F.transform(F.map_entries(shares), lambda e: F.struct(name(e["key"]).alias("key"), e["value"].alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(0.0), lambda a, e: a + e["value"])))


#: Place of each issue in a vector of 45 degradations.
ISSUE_PLACES = {"blur": 0, "noise": 6, "skew": 13, "orientation": 14, "perspective": 15, "low_contrast": 19, "low_dpi": 29}


def issues_to_vector(issues: Column, size: int = 45) -> Column:
    """A vector with the highest confidence of each issue (type, confidence) at its place, 0 elsewhere."""

    def best_of(name: str) -> Column:
        return F.coalesce(F.array_max(F.transform(F.filter(issues, lambda x: x["type"] == name), lambda x: x["confidence"])), F.lit(0.0))

    best = {i: best_of(n) for n, i in ISSUE_PLACES.items()}
    return F.array(*(F.greatest(best[i], F.lit(0.0)) if i in best else F.lit(0.0) for i in range(size)))


def cli_args(p: Column) -> Column:
    """Command line of reading parameters; defaults are left out."""
    f = lambda c: p[c]
    text = lambda a, c: F.concat(F.lit(a), f(c).cast("string"))
    return F.array_compact(F.array(
        text("--pipeline=", "pipeline"), F.when(f("vlm_model") != "", text("--vlm-model=", "vlm_model")),
        F.when(~f("ocr_enabled"), "--no-ocr").when(f("ocr_force"), "--force-ocr"), F.when(f("ocr_engine") != "auto", text("--ocr-engine=", "ocr_engine")),
        F.when(f("ocr_lang") != "", text("--ocr-lang=", "ocr_lang")), text("--psm=", "psm"), F.when(~f("tables_enabled"), "--no-tables").otherwise(text("--table-mode=", "table_mode")),
        F.when(f("enrich_code"), "--enrich-code"), F.when(f("enrich_formula"), "--enrich-formula"), text("--page-batch-size=", "page_batch_size"),
    ))


def metric_targets(metrics: DataFrame) -> DataFrame:
    """metric, value, target, passed of the image metrics that have a target (fixed values); errors have to be at most theirs."""
    targets = {"blur_correlation": 0.85, "blur_rmse": 0.05, "skew_mae": 0.5, "deskew_success_rate": 0.99, "snr_improvement": 6.0, "psnr": 30.0, "ssim": 0.9, "f_measure": 0.95}
    table = F.create_map(*(F.lit(v) for pair in targets.items() for v in pair))
    rows = metrics.withColumn("target", table[F.col("metric")]).filter("target is not null")
    return rows.withColumn("passed", F.when(F.col("metric").isin("blur_rmse", "skew_mae"), F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target")))


def binarization(truth: Column, found: Column) -> dict[str, Column]:
    """precision, recall, f and error rate of binary pixels, over their rows; 0 where a denominator is."""
    n = lambda c: F.count_if(c).cast("double")
    tp, fp, fn = n(truth & found), n(~truth & found), n(truth & ~found)
    pr, rc = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return {"precision": pr, "recall": rc, "f": F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)), "error_rate": (fp + fn) / F.count("*")}


def group_difference(df: DataFrame, value: str, low: Column, high: Column) -> DataFrame:
    """Cohen's d of value between the rows of high and of low, with the pooled deviation; 0 without one."""
    m = {k: (F.avg(F.when(c, F.col(value))), F.var_samp(F.when(c, F.col(value))), F.count_if(c)) for k, c in (("a", high), ("b", low))}
    g = df.agg(*(x.alias(f"{n}{k}") for k, xs in m.items() for n, x in zip("mvn", xs, strict=True)))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return g.select(F.coalesce(F.try_divide(F.col("ma") - F.col("mb"), pooled), F.lit(0.0)).alias("d"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal and Wallis's H over groups, from ranks with ties averaged (without the correction for ties)."""
    from .evaluation import average_rank

    g = average_rank(df.select(value, group), value).groupBy(group).agg(F.sum(f"{value}_rank").alias("r"), F.count("*").alias("n"))
    t = g.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("t"))
    return t.select((12 / (F.col("t") * (F.col("t") + 1)) * F.col("s") - 3 * (F.col("t") + 1)).alias("h"))


def quartile_of(df: DataFrame, value: str) -> DataFrame:
    """df with quartile (0 to 3) by the exact quartiles of value."""
    p = percentiles(df, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return df.crossJoin(p).withColumn("quartile", sum(((F.col(value) > F.col(q)).cast("int") for q in ("q1", "q2", "q3")), F.lit(0))).drop("q1", "q2", "q3")  # one row
