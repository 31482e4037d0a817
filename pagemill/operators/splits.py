"""Content-addressed ids, splits, leakage and allocations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_id(dataset: Column, path: Column, file_hash: Column) -> Column:
    """First 32 hex digits of the SHA-256 of dataset:path:hash."""
    return F.substring(F.sha2(F.concat_ws(":", dataset, path, file_hash), 256), 1, 32)


def hash_fraction(sha: Column) -> Column:
    """First 8 bytes of a SHA-256 as an unsigned number, in 0 to 1."""
    return F.conv(F.substring(sha, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 18446744073709551616.0


def hash_split(sha: Column, train: float = 0.8, val: float = 0.1) -> Column:
    x = hash_fraction(sha)
    return F.when(x < train, "train").when(x < train + val, "val").otherwise("test")


def stratified_split(df: DataFrame, stratum: str, order: Column, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Shares of each stratum, rounded down, by the order of a hash; what is left is test. Adds split."""
    n = F.count("*").over(Window.partitionBy(stratum))
    k = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return df.withColumns({"_n": n, "_k": k}).withColumn("split", F.when(F.col("_k") <= F.floor(F.col("_n") * train), "train").when(F.col("_k") <= F.floor(F.col("_n") * train) + F.floor(F.col("_n") * val), "val").otherwise("test")).drop("_n", "_k")


def leakage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right holds too."""
    return left.join(right.select(key).distinct(), key, "left_semi")


def allocation(counts: DataFrame, stratum: str, total: int) -> DataFrame:
    """Largest remainders with at least one for each stratum: stratum, n, take. counts: a row for each stratum."""
    every = Window.partitionBy()
    share = counts.withColumn("quota", F.col("n") * total / F.sum("n").over(every))
    base = share.withColumn("base", F.greatest(F.lit(1), F.floor("quota")))
    order = Window.orderBy(F.desc(F.col("quota") - F.floor("quota")), stratum)
    left = base.withColumn("rest", total - F.sum("base").over(every)).withColumn("k", F.row_number().over(order))
    return left.select(stratum, "n", F.least(F.col("n"), F.col("base") + F.when(F.col("k") <= F.col("rest"), 1).otherwise(0)).alias("take"))


def sample_per_stratum(df: DataFrame, takes: DataFrame, stratum: str, order: Column) -> DataFrame:
    """The first rows of each stratum in the order of a hash, as many as takes says (stratum, take)."""
    k = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return df.withColumn("_k", k).join(takes.select(stratum, "take"), stratum).filter("_k <= take").drop("_k", "take")


def near_pairs(df: DataFrame, key: str, code: str, most: int = 5, groups: int = 8, block: str | None = None) -> DataFrame:
    """Pairs (a, b, distance) of 64-bit codes that differ in at most `most` bits, within a block if one is named.

    Bits that are the same in all codes are left out, the others are dealt over groups. Codes of a pair agree in at least groups - most of the groups, so rows
    meet by each choice of so many groups, and a pair is given where the choice is that of its first equal groups.
    """
    ones = df.agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned(F.col(code), i).bitwiseAND(1)).alias(f"b{i}") for i in range(64))).first()  # 65 numbers
    varied = [i for i in range(64) if 0 < (ones[f"b{i}"] or 0) < ones["n"]]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(sum(1 << i for i in varied[g::groups])) for g in range(groups)]
    choices = list(combinations(range(groups), groups - most))
    within = [F.col(block)] if block else []
    keys = F.array(*(F.struct(F.lit(k).alias("choice"), F.xxhash64(F.lit(k), *within, F.col(code).bitwiseAND(signed(sum(masks[g] & ((1 << 64) - 1) for g in c)))).alias("v")) for k, c in enumerate(choices)))
    rows = df.select(F.col(key).alias("k"), F.col(code).alias("c"), *(c.alias("g") for c in within), F.inline(keys))
    a, b = (rows.select(F.col("k").alias(x), F.col("c").alias(f"c{x}"), *(F.col("g").alias(f"g{x}") for _ in within), "choice", "v") for x in "ab")
    differ = F.col("ca").bitwiseXOR(F.col("cb"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= most)
    equal = F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: differ.bitwiseAND(F.get(F.array(*(F.lit(m) for m in masks)), i)) == 0)
    mine = F.get(F.array(*(F.array(*(F.lit(g) for g in c)) for c in choices)), F.col("choice"))
    same = F.col("ga") == F.col("gb") if block else F.lit(True)
    met = a.join(b, ["choice", "v"]).filter(close & same)
    return met.filter(F.slice(equal, 1, groups - most) == mine).select(*(F.col("ga").alias(block) for _ in within), "a", "b", F.bit_count(differ).alias("distance"))
