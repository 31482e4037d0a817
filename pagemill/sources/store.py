"""A table of samples, partitioned by dataset: replace, append, read, list, compact; and readers of label formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_name(dataset: str) -> str:
    """Small letters, digits, points and dashes; other characters become an underscore."""
    import re

    return re.sub(r"[^a-z0-9.-]+", "_", dataset.strip().lower()).strip("_")


class SampleStore:
    """Parquet below root, a folder dataset_name=... for each dataset."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _part(self, dataset: str) -> str:
        return f"{self.root}/dataset_name={safe_name(dataset)}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def write(self, dataset: str, samples: DataFrame) -> None:
        """Replace a dataset. An empty input writes nothing."""
        if not samples.isEmpty():
            samples.drop("dataset_name").write.mode("overwrite").parquet(self._part(dataset))

    def append(self, dataset: str, samples: DataFrame) -> None:
        samples.drop("dataset_name").write.mode("append").parquet(self._part(dataset))

    def read(self, dataset: str | None = None) -> DataFrame:
        """All samples, or those of a dataset; only its folder is read then."""
        all_rows = self.spark.read.parquet(self.root)
        return all_rows if dataset is None else all_rows.filter(F.col("dataset_name").isin(dataset, safe_name(dataset)))

    def datasets(self) -> list[str]:
        return [r.dataset_name for r in self.spark.read.parquet(self.root).select("dataset_name").distinct().orderBy("dataset_name").collect()]  # a row for each folder

    def stats(self) -> DataFrame:
        """dataset_name, files, bytes, rows."""
        rows = self.spark.read.parquet(self.root).select("dataset_name", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
        return rows.groupBy("dataset_name", "f", "s").agg(F.count("*").alias("n")).groupBy("dataset_name").agg(F.count("*").alias("files"), F.sum("s").alias("bytes"), F.sum("n").alias("rows"))

    def delete(self, dataset: str) -> bool:
        fs, p = self._fs(self._part(dataset))
        return fs.delete(p, True)

    def write_all(self, samples: DataFrame, dataset: str) -> None:
        """Write the samples of all datasets at once, a folder for each value of the column dataset; folders that are there are replaced."""
        name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(dataset).cast("string"))), "[^a-z0-9.-]+", "_"), "^_+|_+$", "")
        rows = samples.withColumn("dataset_name", name)
        rows.repartition("dataset_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_name").parquet(self.root)

    def compact(self, dataset: str, files: int = 1) -> int:
        """Rewrite a dataset into few files; its rows. The new files are complete before the old ones are moved aside, and these go only when the new ones are
        in place, so a crash leaves either of them whole."""
        part = self._part(dataset)
        new, old = (f"{self.root}/_{kind}_{safe_name(dataset)}" for kind in ("compact", "before"))
        self.spark.read.parquet(part).repartition(files).write.mode("overwrite").parquet(new)
        rows = self.spark.read.parquet(new).count()
        fs, p = self._fs(part)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs.delete(path(old), True)
        if not (fs.rename(p, path(old)) and fs.rename(path(new), p)):
            raise OSError(f"{part} couldn't be replaced; its files are in {old}")
        fs.delete(path(old), True)
        return rows


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str = "filename") -> DataFrame:
    """Rows of a JSONL file by name; malformed lines are left out, of several rows of a name the last by its line's content stays."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter("_corrupt_record is null").drop("_corrupt_record").groupBy(key).agg(F.max(F.struct(*[c for c in rows.columns if c not in (key, "_corrupt_record")])).alias("x")).select(key, "x.*")


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """file_name and boxes (category, bbox) of each image; an unknown category is called unknown."""
    schema = "images array<struct<id: long, file_name: string>>, annotations array<struct<image_id: long, category_id: int, bbox: array<double>>>, categories array<struct<id: int, name: string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    images = doc.select(F.inline("images")).withColumnRenamed("id", "image_id")
    boxes = doc.select(F.inline("annotations"))
    kinds = doc.select(F.inline("categories")).withColumnRenamed("id", "category_id")
    named = boxes.join(kinds, "category_id", "left").select("image_id", F.struct(F.coalesce("name", F.lit("unknown")).alias("category"), "bbox").alias("box"))
    return images.join(named, "image_id", "left").groupBy("file_name").agg(F.array_sort(F.collect_list("box")).alias("boxes"))


def read_labels(spark: SparkSession, path: str, form: str, schema: str | None = None, row_tag: str = "row") -> DataFrame:
    """A reader for each label format: csv, json, jsonl, text, parquet, xml, or path (labels in file names)."""
    r = spark.read.schema(schema) if schema else spark.read
    if form == "csv":
        return r.option("header", True).csv(path)
    if form == "json":
        return r.option("multiLine", True).json(path)
    if form == "jsonl":
        return r.json(path)
    if form == "text":
        return spark.read.text(path)
    if form == "xml":
        return r.format("xml").option("rowTag", row_tag).load(path)
    if form == "path":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
        return files.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), F.element_at(F.split("path", "/"), -1).alias("file_name"))
    return r.parquet(path)
