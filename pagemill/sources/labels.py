"""Labels of public datasets: what a folder's paths and tables say about its images, one declaration for each dataset.

A declaration holds constants, rules over the path of an image, where the corrected image of a distorted one stands, and a table of labels that is joined
by the image's name or stem. All of it is expressions over the listing of files, so a dataset of any size is read by the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a label row; others go to raw.
FIELDS = ("transcription", "language_code", "script_name", "iso15924_script_code", "writer_id")
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
SPLITS = ("train", "val", "validation", "test")


@dataclass(frozen=True)
class Paths:
    """Columns of an image's path below the dataset's folder."""

    parts: Column
    name: Column
    stem: Column
    parent: Column


Rule = Callable[[Paths], Column]


def part(*values: str) -> Rule:
    """The first part of the path that is one of values."""
    return lambda p: F.get(F.filter(p.parts, lambda x: x.isin(*values)), 0)


def after(*values: str) -> Rule:
    """The part behind the first one of values."""
    return lambda p: F.get(p.parts, F.array_position(p.parts, part(*values)(p)).cast("int"))


def at(k: int, least: int, *values: str) -> Rule:
    """Part k in small letters, of paths with so many parts, if it's one of values."""

    def rule(p: Paths) -> Column:
        x = F.when(F.size(p.parts) >= least, F.lower(F.get(p.parts, k)))
        return F.when(x.isin(*values), x) if values else x

    return rule


def found(where: str, pattern: str, group: int = 1) -> Rule:
    """A group of a pattern in name, stem or parent; null where it isn't found."""
    return lambda p: F.nullif(F.regexp_extract(getattr(p, where), pattern, group), F.lit(""))


def mapped(rule: Rule, values: dict[str, str], other: str | None = None) -> Rule:
    """What values have for a rule's result, else other."""

    def get(p: Paths) -> Column:
        out = F.lit(other)
        for a, b in values.items():
            out = F.when(rule(p) == a, b).otherwise(out)
        return out

    return get


def small(where: str) -> Rule:
    return lambda p: F.lower(getattr(p, where))


@dataclass(frozen=True)
class Table:
    """A table of labels: files below the dataset's folder, the column with the image's name, and the fields of other columns."""

    files: tuple[str, ...]
    form: str
    key: str
    fields: dict[str, str]
    by: str = "name"


@dataclass(frozen=True)
class Dataset:
    name: str
    aliases: tuple[str, ...] = ()
    constants: dict[str, str] = field(default_factory=dict)
    rules: dict[str, Rule] = field(default_factory=dict)
    table: Table | None = None
    #: Paths below the folder at which the ground truth of an image may stand; null for images that have none.
    truth: Callable[[Paths], Sequence[Column]] | None = None


def _below(folder: str) -> Callable[[Paths], Column]:
    return lambda p: F.concat(F.lit(folder + "/"), p.name)


_DISTORTED, _CORRECTED = ("src", "source", "distorted", "input", "warped"), ("public", "corrected", "target", "gt", "ground_truth", "ref")
_STAINED, _CLEAN = ("stained", "stain", "degraded", "input", "src"), ("clean", "ground_truth", "gt", "target", "ref", "reference")
_LATIN = {"language_code": "en", "script_name": "Latin", "iso15924_script_code": "Latn"}
_ARABIC = {"language_code": "ar", "script_name": "Arabic", "iso15924_script_code": "Arab"}
_HINDI = {"language_code": "hi", "script_name": "Devanagari", "iso15924_script_code": "Deva"}
_TIBETAN = {"language_code": "bo", "script_name": "Tibetan", "iso15924_script_code": "Tibt"}
_CAMERA = {"capture_method": "camera_smartphone"}
#: Language and script of the script classes in folder names.
SCRIPT_FOLDERS = {"Arabic": ("ar", "Arab"), "Bengali": ("bn", "Beng"), "Chinese": ("zh", "Hans"), "English": ("en", "Latn"), "Greek": ("el", "Grek"), "Gujrathi": ("gu", "Gujr"), "Hebrew": ("he", "Hebr"), "Hindi": ("hi", "Deva"), "Japanese": ("ja", "Jpan"), "Kannada": ("kn", "Knda"), "Korean": ("ko", "Kore"), "Oriya": ("or", "Orya"), "Punjabi": ("pa", "Guru"), "Russian": ("ru", "Cyrl"), "Tamil": ("ta", "Taml"), "Telegu": ("te", "Telu"), "Thai": ("th", "Thai"), "Tibetan": ("bo", "Tibt")}


def _script_folder(*splits: str) -> dict[str, Rule]:
    kind = after(*splits)
    known = lambda k: mapped(kind, {n: x[k] for n, x in SCRIPT_FOLDERS.items()})
    return {"split": lambda p: F.lower(part(*splits)(p)), "script_class": kind, "script_name": mapped(kind, {n: n for n in SCRIPT_FOLDERS}), "language_code": known(0), "iso15924_script_code": known(1)}


def _shadow(splits: tuple[str, ...]) -> dict[str, Rule]:
    kind = at(1, 3)
    return {"subset": mapped(at(0, 2, *splits), {s: "val" if s == "validation" else s for s in splits}), "image_type": mapped(kind, {"input": "shadow", "target": "ground_truth", "mask": "mask"}), "is_degraded": mapped(kind, {"input": "true", "target": "false"})}


def _sides(bad: tuple[str, ...], good: tuple[str, ...], name: str, bad_capture: str) -> dict[str, Rule]:
    kind = {**{x: name for x in bad}, **{x: "ground_truth" for x in good}}
    side = small("parent")
    return {"image_type": mapped(side, kind, "unknown"), "capture_method": mapped(side, {**{x: bad_capture for x in bad}, **{x: "scanner_flatbed" for x in good}}, "unknown"), "is_degraded": mapped(side, {**{x: "true" for x in bad}, **{x: "false" for x in good}})}


DATASETS = (
    Dataset("diqa-5000", (), {"base_document_origin": "born_digital"}, {
        "split": part("train", "val", "test"), "image_folder": part("ori", "res"),
        "is_synthetic_degradation": mapped(part("ori", "res"), {"res": "true"}, "false"),
        "capture_method": mapped(part("ori", "res"), {"ori": "camera_smartphone"}, "synthetic"),
        "distortion_source": mapped(part("ori", "res"), {"ori": "real_world"}, "algorithmic_enhancement"),
    }, Table(("*/*.csv",), "csv", "ori|res", {"overall": "overall", "sharpness": "sharpness", "color_fidelity": "color_fidelity", "paired_image": "res|ori"})),
    Dataset("warpdoc", (), {"source": "warpdoc", **_CAMERA, "correction_task": "dewarping", "is_degraded": "true"}, {
        "distortion_type": mapped(small("parent"), {x: x for x in ("fold", "curved", "incomplete", "random", "rotating", "perspective")}, "unknown"),
        "expected_degradations": mapped(small("parent"), {"fold": "fold,warping", "curved": "curved,warping", "incomplete": "incomplete_capture,perspective_distortion", "random": "warping,random_deformation", "rotating": "rotation,perspective_distortion", "perspective": "perspective_distortion"}, "perspective_distortion,warping"),
        "base_filename": lambda p: p.stem,
    }),
    Dataset("anyphotodoc6300", (), {"source": "anyphotodoc6300", **_CAMERA, "correction_task": "dewarping", "expected_degradations": "perspective_distortion,warping"}, {
        "image_type": mapped(small("parent"), {"flat": "ground_truth"}, "distorted"), "is_degraded": mapped(small("parent"), {"flat": "false"}, "true"),
        "distortion_variant": found("parent", r"(?i)^init_(\d+)"), "base_filename": lambda p: p.stem,
    }, truth=lambda p: [_below("flat")(p)]),
    Dataset("doc3d", (), {"capture_method": "synthetic", "correction_task": "dewarping", "is_synthetic": "true"}, {
        "warp_bucket": found("parent", r"^(\d+)$"),
        **{k: found("stem", r"^(?:\d+_)?(\d+)_(\d+)-(pp|tc|pr)_Page_(\d+)-([A-Za-z0-9]+)$", g) for g, k in ((1, "doc_id"), (2, "view_id"), (4, "page_id"), (5, "doc_code"))},
        "warp_type": lambda p: F.coalesce(found("stem", r"^(?:\d+_)?\d+_\d+-(pp|tc|pr)_Page_\d+-[A-Za-z0-9]+$")(p), F.lit("unknown")),
        "warp_type_label": mapped(found("stem", r"^(?:\d+_)?\d+_\d+-(pp|tc|pr)_Page_\d+-[A-Za-z0-9]+$"), {"pp": "plain_photo", "tc": "color_checker", "pr": "projected_rainbow"}, "unknown"),
        "base_filename": lambda p: p.stem,
    }),
    Dataset("docalign12k", (), {"source": "docalign12k", "capture_method": "synthetic", "correction_task": "alignment"}, {
        "image_type": mapped(at(0, 2), {"distorted_hard": "input_distorted", "flat": "ground_truth"}), "is_degraded": mapped(at(0, 2), {"distorted_hard": "true", "flat": "false"}), "distortion_type": mapped(at(0, 2), {"distorted_hard": "hard"}),
    }, truth=lambda p: [F.when((F.size(p.parts) >= 3) & (F.lower(F.get(p.parts, 0)) == "distorted_hard"), F.concat(F.lit("flat/"), F.get(p.parts, 1), F.lit("/"), p.name))]),
    Dataset("docreal", (), {"source": "docreal", "correction_task": "dewarping"}, {
        "image_type": mapped(small("parent"), {"distorted": "distorted", "scanned": "ground_truth"}), "capture_method": mapped(small("parent"), {"distorted": "camera_smartphone"}), "is_degraded": mapped(small("parent"), {"distorted": "true", "scanned": "false"}),
        "doc_id": lambda p: F.coalesce(found("stem", r"^(.+?)_(\d+)$")(p), p.stem), "variant": found("stem", r"^(.+?)_(\d+)$", 2),
    }, truth=lambda p: [F.when(F.lower(p.parent) == "distorted", F.concat(F.lit("scanned/"), F.nullif(F.regexp_extract(p.stem, r"^(.+?)_(\d+)$", 1), F.lit("")), F.lit(".png")))]),
    Dataset("drccbi", (), {"source": "drccbi", "correction_task": "dewarping"}, _sides(_DISTORTED, _CORRECTED, "distorted", "camera_smartphone"), truth=lambda p: [F.when(F.lower(p.parent).isin(*_DISTORTED), _below(x)(p)) for x in _CORRECTED]),
    Dataset("staindoc", (), {"source": "staindoc", "correction_task": "stain_removal"}, _sides(_STAINED, _CLEAN, "stained", "scanner_flatbed"), truth=lambda p: [F.when(F.lower(p.parent).isin(*_STAINED), _below(x)(p)) for x in _CLEAN]),
    Dataset("sd7k", (), {"source": "sd7k", **_CAMERA, "correction_task": "shadow_removal"}, _shadow(("train", "test")), truth=lambda p: [F.when(F.lower(F.get(p.parts, 1)) == "input", F.concat(F.get(p.parts, 0), F.lit("/target/"), p.name))]),
    Dataset("wsrd", (), {"source": "wsrd", **_CAMERA, "correction_task": "shadow_removal"}, _shadow(SPLITS), truth=lambda p: [F.when(F.lower(F.get(p.parts, 1)) == "input", F.concat(F.get(p.parts, 0), F.lit("/target/"), x)) for x in (p.name, F.concat(p.stem, F.lit(".jpg")), F.concat(p.stem, F.lit(".png")))]),
    Dataset("realdae", (), {"source": "realdae", **_CAMERA, "is_degraded": "true", "expected_degradations": "perspective_distortion,lighting_variation,shadow,blur"}, {
        "image_type": mapped(found("stem", "_(in|gt)$"), {"in": "input_degraded", "gt": "ground_truth"}), "base_name": found("stem", "^(.*)_(?:in|gt)$"), "subset": mapped(small("parent"), {s: s for s in SPLITS}),
    }, truth=lambda p: [F.when(p.stem.endswith("_in"), F.concat_ws("/", F.slice(p.parts, 1, F.size(p.parts) - 1), F.regexp_replace(p.stem, "_in$", "_gt.jpg")))]),
    Dataset("dibco", (), {}, {
        "dibco_year": lambda p: F.get(F.filter(p.parts, lambda x: x.rlike(r"^20\d{2}$")), 0),
        "document_type": lambda p: F.when(F.exists(p.parts, lambda x: F.lower(x).rlike("handwrit(ten|ing)")), "handwritten").when(F.exists(p.parts, lambda x: F.lower(x).contains("printed")), "printed"),
        "is_ground_truth": lambda p: F.when(F.exists(p.parts, lambda x: F.lower(x).rlike("gt|ground")), "true"),
    }),
    Dataset("cvsi", (), {}, _script_folder("Training", "Testing", "Validation")),
    Dataset("siw13", (), {}, _script_folder("Training", "Testing")),
    Dataset("nist-sd19", ("nist_sd19", "sd19"), {}, {
        "writer_id": lambda p: F.get(F.filter(p.parts, lambda x: x.startswith("hsf")), 0), "class_id": after("by_class"),
        "transcription": lambda p: F.coalesce(F.upper(found("stem", r"^([A-Za-z]|\d)_")(p)), found("parent", r"^(\d+)$")(p)), "sample_id": found("stem", r"_(\d+)$"),
    }),
    Dataset("tobacco800", (), {"source": "tobacco800", "domain": "administrative", "capture_method": "scanner_adf", "is_degraded": "true"}, {"potential_class": found("stem", "^([^_]+)_")}),
    Dataset("maths-handwriting", ("maths_handwriting", "math_handwriting"), {"content_type": "mathematical"}, {"split": part(*SPLITS)}),
    Dataset("popp-line", ("popp_line",), {**_LATIN, "language_code": "fr", "dataset": "popp-line", "production": "handwritten", "capture_method": "scanner_flatbed", "has_handwriting": "true", "text_scope": "line"}, {"split": part("train", "validation", "test")}),
    Dataset("signatr6k", ("signatr",), {}, {"split": part("train", "test", "validation"), "image_type": mapped(part("crop", "label"), {"crop": "signature", "label": "mask"}), "signature_id": lambda p: p.stem}, truth=lambda p: [F.when(p.parent == "crop", F.concat_ws("/", F.slice(p.parts, 1, F.size(p.parts) - 2), F.lit("label"), p.name))]),
    Dataset("multimodal_textbook", ("multimodal-textbook",), {"source": "multimodal_textbook", "domain": "educational", "capture_method": "born_digital", "document_type": "textbook", "expected_content": "text,figures,formulas,tables,captions", **_LATIN}, {"page_number": found("stem", r"(?i)(?:page|p)_?(\d+)"), "chapter": found("stem", r"(?i)(?:ch|chapter)_?(\d+)")}),
    Dataset("nara-1950-census", ("nara_1950_census",), {**_LATIN, "dataset": "nara-1950-census", "document_type": "census_enumeration_schedule", "content_type": "handwritten_form"}, {}),
    Dataset("omnidocbench", (), {"source": "omnidocbench", "format": "arrow_extracted"}, {"original_filename": lambda p: F.when(F.array_contains(p.parts, "extracted_images"), p.name)}),
    Dataset("openpecha-ocr-drutsa", (), _TIBETAN, {"source_id": lambda p: p.stem}),
    Dataset("tibhcr", (), _TIBETAN, {"split": part(*SPLITS), "character_class": lambda p: F.when(~p.parent.isin(*SPLITS, "images"), p.parent), "transcription": lambda p: F.when(~p.parent.isin(*SPLITS, "images"), p.parent)}),
    Dataset("yarmouk_ocr", (), _ARABIC, {"split": mapped(part("Training", "Testing", "Samples"), {"Training": "train", "Testing": "test", "Samples": "sample"})}),
    Dataset("hasyv2", ("hasy-v2", "hasy_v2", "hasy"), {"content_type": "mathematical_symbol"}, {}, Table(("classification-task/*/*.csv",), "csv", "path", {"symbol_id": "symbol_id", "latex": "latex", "user_id": "user_id"})),
    Dataset("iiit-hw-hindi", ("iiit_hw_hindi", "iiit-indic-hw-hindi"), {**_HINDI, "dataset": "iiit-hw-hindi", "production": "handwritten-cursive", "reading_direction": "left-to-right", "granularity": "word-level"}, {"split": found("stem", r"(?i)^iiit_hw_hindi_(train|validation|test)_(\d+)$"), "index": found("stem", r"(?i)^iiit_hw_hindi_(train|validation|test)_(\d+)$", 2)}, Table(("iiit_hw_hindi_groundtruth.tsv",), "tsv", "filename", {"transcription": "hindi_text"})),
    Dataset("khatt", ("khatt-arabic",), {**_ARABIC, "dataset": "khatt", "production": "handwritten-cursive", "reading_direction": "right-to-left", "capture_method": "scanner_flatbed"}, {k: found("stem", r"(?i)^([A-Z0-9]+)_Para(\d+)_(\d+)$", g) for g, k in ((1, "writer_id"), (2, "para_num"), (3, "segment"))}, Table(("khatt_groundtruth.tsv",), "tsv", "image_path", {"transcription": "arabic_text"}, "stem")),
    Dataset("hindi_ocr_synthetic", ("hindi-ocr-synthetic", "hindi-synth"), {**_HINDI, "is_synthetic": "true", "content_type": "text_line"}, {}, Table(("data_80k/data.csv", "data.csv"), "csv", "image_file", {"transcription": "text", "font_file": "font_file", "font_size": "font_size", "word_count": "word_count"})),
    Dataset("casia-hwdb2-line", ("casia_hwdb2_line", "hwdb2-line"), {"language_code": "zh", "script_name": "Hans", "iso15924_script_code": "Hans", "dataset": "casia-hwdb2-line", "production": "handwritten", "writing_system": "simplified-chinese"}, {"split": lambda p: F.coalesce(part("train", "validation", "test")(p), F.lit("unknown"))}, Table(("*/_index.jsonl",), "jsonl", "file_name", {"transcription": "text"})),
    Dataset("funsd", (), {"language_code": "en", "document_type": "form", "is_scanned": "true"}, {}, Table(("annotations/*.json", "*/annotations/*.json"), "form", "stem", {"transcription": "text"}, "stem")),
    Dataset("sroie", (), {}, {}, Table(("*.txt", "*/*.txt"), "quads", "stem", {"transcription": "text", "text_instances": "n"}, "stem")),
    Dataset("mlt19", ("mlt-2019", "icdar2019-mlt"), {}, {}, Table(("*.txt", "*/*.txt", "*/*/*.txt"), "tagged_quads", "stem", {"transcription": "text", "text_instances": "n", "languages": "languages"}, "stem")),
)
REGISTRY = {n: d for d in DATASETS for n in (d.name, *d.aliases)}


def dataset(name: str) -> Dataset:
    """The declaration of a dataset by any of its names; one that isn't known has no labels but its paths."""
    return REGISTRY.get(name.strip().lower(), Dataset(name))


def images(spark: SparkSession, root: str) -> DataFrame:
    """path below root of each image; only the listing is read, hidden paths are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    below = F.regexp_replace("path", "^.*?" + _quoted(root.split("://")[-1].strip("/")) + "/", "")
    return files.select(below.alias("path")).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES) & ~F.col("path").rlike(r"(^|/)\."))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def _label_table(spark: SparkSession, root: str, t: Table) -> DataFrame | None:
    """key and fields of a label table, one row for each key; None if no file is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{p}")
    there = [f"{root.rstrip('/')}/{p}" for p in t.files if (path(p).getFileSystem(conf).globStatus(path(p)) or [])]
    if not there:
        return None
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("stem")
    if t.form in ("csv", "tsv"):
        rows = spark.read.option("header", True).option("sep", "\t" if t.form == "tsv" else ",").csv(there)
    elif t.form == "jsonl":
        rows = spark.read.schema(", ".join(f"`{c}` string" for c in (t.key, *t.fields.values()))).json(there)
    elif t.form == "form":
        docs = spark.read.schema("form array<struct<text: string, label: string>>").option("multiLine", True).json(there)
        rows = docs.select(stem, F.array_join(F.filter(F.transform("form", lambda x: x["text"]), lambda x: x != ""), " ").alias("text"))
    else:
        lines = spark.read.text(there).select(stem, F.monotonically_increasing_id().alias("k"), F.split(F.trim("value"), ",").alias("p"))
        most = 8 if t.form == "quads" else 9
        good = lines.filter((F.size("p") > most) & F.forall(F.slice("p", 1, 8), lambda x: x.try_cast("double").isNotNull()))
        text = F.array_join(F.slice("p", most + 1, F.size("p")), ",")
        language = F.get("p", 8) if t.form == "tagged_quads" else F.lit(None).cast("string")
        read = good.select("stem", "k", F.when(text != "###", text).alias("text"), language.alias("language"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " ")
        rows = read.groupBy("stem").agg(joined.alias("text"), F.count("*").cast("string").alias("n"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    out = []
    for keys, swap in ((t.key.split("|"), False),) if "|" not in t.key else (([k], k != t.key.split("|")[0]) for k in t.key.split("|")):
        last = F.regexp_extract(F.col(f"`{keys[0]}`"), r"([^/]+)$", 1)
        key = F.regexp_replace(last, r"\.[^.]*$", "") if t.by == "stem" else last
        columns = {f: (c.split("|")[int(swap)] if "|" in c else c) for f, c in t.fields.items()}
        out.append(rows.select(key.alias("key"), *(F.col(f"`{c}`").cast("string").alias(f) for f, c in columns.items())))
    both = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    names = list(t.fields)
    return both.filter("key <> ''").groupBy("key").agg(F.min(F.struct(*names)).alias("x")).select("key", "x.*")


def read_dataset_labels(spark: SparkSession, root: str, name: str) -> DataFrame:
    """path, name, the FIELDS, and raw (map of all others that are there): the labels of every image below root."""
    d = dataset(name)
    parts = F.split("path", "/")
    last = F.element_at(parts, -1)
    p = Paths(parts, last, F.regexp_replace(last, r"\.[^.]*$", ""), F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("")))
    listed = images(spark, root)
    values: dict[str, Column] = {k: F.lit(v) for k, v in d.constants.items()}
    rows = listed.select("path", last.alias("name"), p.stem.alias("stem"), *(F.col("path").alias(c) for c in ()))
    rows = rows.withColumns({f"r_{k}": rule(p).cast("string") for k, rule in d.rules.items()}) if d.rules else rows
    for k in d.rules:
        values[k] = F.coalesce(F.col(f"r_{k}"), values[k]) if k in values else F.col(f"r_{k}")
    if d.truth is not None:
        wanted = listed.select("path", F.explode(F.array_compact(F.array(*d.truth(p)))).alias("truth"))
        there = wanted.join(listed.select(F.col("path").alias("truth")), "truth", "left").groupBy("path").agg(F.min(F.when(F.col("truth").isNotNull(), F.col("truth"))).alias("wanted"))
        have = wanted.join(listed.select(F.col("path").alias("truth")), "truth").groupBy("path").agg(F.min("truth").alias("t_path"))
        rows = rows.join(there.join(have, "path", "left"), "path", "left")
        values["has_ground_truth"] = F.when(F.col("wanted").isNotNull(), F.col("t_path").isNotNull().cast("string"))
        values["ground_truth_path"] = F.col("t_path")
    table = _label_table(spark, root, d.table) if d.table else None
    if table is not None:
        rows = rows.join(table.select(F.col("key").alias(d.table.by), *(F.col(f).alias(f"l_{f}") for f in d.table.fields)), d.table.by, "left")
        for f in d.table.fields:
            values[f] = F.coalesce(F.col(f"l_{f}"), values[f]) if f in values else F.col(f"l_{f}")
    rest = [k for k in values if k not in FIELDS]
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), values[k].alias("value")) for k in rest)) if rest else F.array().cast("array<struct<key: string, value: string>>")
    raw = F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))
    return rows.select("path", "name", *(values.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS), raw.alias("raw"))
