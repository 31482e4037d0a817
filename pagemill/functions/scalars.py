"""Small rules as columns: grades, names, file kinds, scripts, boxes, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes of file kinds, as offset and hex digits; all parts of an alternative have to be there. A bitmap needs the size of its header, too.
SIGNATURES = {
    "pdf": (((0, "255044462D"),),),
    "png": (((0, "89504E470D0A1A0A"),),),
    "jpeg": (((0, "FFD8FF"),),),
    "tiff": (((0, "49492A00"),), ((0, "4D4D002A"),)),
    "webp": (((0, "52494646"), (8, "57454250")),),
    "bmp": tuple(((0, "424D"), (14, f"{n:02X}000000")) for n in (12, 40, 52, 56, 64, 108, 124)),
}
#: Kind of file that an extension names.
EXTENSIONS = {"pdf": "pdf", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff", "tiff": "tiff", "webp": "webp", "bmp": "bmp"}
#: Scripts by their old names.
LEGACY_SCRIPTS = {"latin": "Latn", "cjk": "Hani", "chinese": "Hans", "simplified chinese": "Hans", "traditional chinese": "Hant", "japanese": "Jpan", "korean": "Kore", "arabic": "Arab", "hebrew": "Hebr", "cyrillic": "Cyrl", "greek": "Grek", "devanagari": "Deva", "hindi": "Deva", "bengali": "Beng", "tamil": "Taml", "telugu": "Telu", "thai": "Thai", "tibetan": "Tibt", "ethiopic": "Ethi", "armenian": "Armn", "georgian": "Geor", "khmer": "Khmr", "myanmar": "Mymr", "burmese": "Mymr", "lao": "Laoo", "unknown": "Zzzz"}
#: Default script of languages.
DEFAULT_SCRIPTS = {"en": "Latn", "es": "Latn", "fr": "Latn", "de": "Latn", "it": "Latn", "pt": "Latn", "zh": "Hans", "ja": "Jpan", "ko": "Kore", "hi": "Deva", "bn": "Beng", "ta": "Taml", "te": "Telu", "mr": "Deva", "gu": "Gujr", "kn": "Knda", "ml": "Mlym", "pa": "Guru", "ne": "Deva", "si": "Sinh", "ar": "Arab", "fa": "Arab", "ur": "Arab", "he": "Hebr", "ru": "Cyrl", "uk": "Cyrl", "el": "Grek", "th": "Thai", "km": "Khmr", "my": "Mymr", "lo": "Laoo", "bo": "Tibt", "dz": "Tibt", "am": "Ethi", "vi": "Latn", "id": "Latn", "ms": "Latn", "tr": "Latn", "sw": "Latn"}
#: Families of scripts.
FAMILIES = {"latin": ("Latn",), "cjk": ("Hans", "Hant", "Jpan", "Kore", "Hani", "Hang", "Hira", "Kana"), "arabic": ("Arab",), "hebrew": ("Hebr",), "indic": ("Deva", "Beng", "Taml", "Telu", "Gujr", "Knda", "Mlym", "Orya", "Sinh", "Guru", "Thai", "Khmr", "Mymr", "Laoo", "Tibt"), "cyrillic": ("Cyrl",), "greek": ("Grek",), "armenian": ("Armn",), "georgian": ("Geor",), "ethiopic": ("Ethi",)}


def chosen(x: Column, values: dict[str, str], other: str | None = None) -> Column:
    """values[x], else other."""
    table = F.create_map(*(F.lit(v) for pair in values.items() for v in pair))
    return F.coalesce(table[x], F.lit(other))


def severity_name(value: Column, steps: tuple[float, float, float] = (0.2, 0.5, 0.8)) -> Column:
    mild, moderate, severe = steps
    return F.when(value < mild, "none").when(value < moderate, "mild").when(value < severe, "moderate").otherwise("severe")


def reliability(confidence: Column, hard: float = 0.9, soft: float = 0.7, active: float = 0.5) -> Column:
    """What a label of a confidence is good for; without one it isn't assessed."""
    return F.when(confidence.isNull(), "unassessed").when(confidence >= hard, "hard_label").when(confidence >= soft, "soft_label").when(confidence >= active, "active_learning").otherwise("unreliable")


def acceptance_tier(percentile: Column) -> Column:
    """Bands of a percentile in 0 to 100."""
    return F.when(percentile < 75, "auto_accept").when(percentile < 90, "low_weight").when(percentile < 97.5, "tier2_trigger").otherwise("hard_reject")


def file_type(content: Column) -> Column:
    """Kind of a file by its first bytes, null if none fits."""
    out = F.lit(None).cast("string")
    for kind, alternatives in reversed(SIGNATURES.items()):
        fits = F.lit(False)
        for parts in alternatives:
            one = F.lit(True)
            for offset, digits in parts:
                one = one & (F.hex(F.call_function("substring", content, F.lit(offset + 1), F.lit(len(digits) // 2))) == digits)
            fits = fits | one
        out = F.when(fits, kind).otherwise(out)
    return out


def extension_error(content: Column, extension: Column, least: int = 18) -> Column:
    """Why a file's bytes don't fit its extension, null if they do."""
    wanted = chosen(F.lower(F.regexp_replace(extension, r"^\.", "")), EXTENSIONS)
    found = file_type(content)
    return F.when(wanted.isNull(), "unknown extension").when(F.length(content) < least, "too short").when(found.isNull(), "unknown content").when(found != wanted, F.concat(F.lit("content is "), found))


def safe_path(path: Column, base: Column | None = None) -> Column:
    """Whether a path holds no step upwards, and lies below base if there is one."""
    ok = ~path.contains("..")
    return ok if base is None else ok & ((path == F.rtrim(base, F.lit("/"))) | path.startswith(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))))


def same_value(a: Column, b: Column) -> Column:
    """Whether two texts agree, whatever their case and the blanks around them; null agrees with nothing."""
    return F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False))


def same_values(a: Column, b: Column) -> Column:
    """Whether two lists of texts agree, whatever their order and case."""
    low = lambda x: F.array_sort(F.transform(x, F.lower))
    return F.coalesce(low(a) == low(b), F.lit(False))


def legacy_script(name: Column) -> Column:
    return chosen(F.lower(F.trim(name)), LEGACY_SCRIPTS, "Zzzz")


def script_family(script: Column) -> Column:
    return chosen(script, {s: f for f, ss in FAMILIES.items() for s in ss}, "other")


def language_script(language: Column, script: Column, region: Column) -> Column:
    """language, script (the language's default if none is given), tag, family, whether it runs from right to left."""
    full = F.coalesce(script, chosen(language, DEFAULT_SCRIPTS, "Zzzz"))
    tag = F.when(script.isNotNull(), F.concat_ws("-", language, script, region)).otherwise(F.concat_ws("-", language, full))
    return F.struct(language.alias("language"), full.alias("script"), tag.alias("tag"), script_family(full).alias("family"), full.isin("Arab", "Hebr").alias("rtl"))


def model_name(model: Column) -> Column:
    """Last part of an id with slashes, else the id without its ending."""
    return F.when(model.contains("/"), F.element_at(F.split(model, "/"), -1)).otherwise(F.regexp_replace(model, r"(?<=.)\.[^.]*$", ""))


def eta(seconds: Column) -> Column:
    whole = F.floor(seconds)
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    text = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x), b.cast("string"), F.lit(y))
    return F.when(seconds.isNull(), "unknown").when(seconds < 60, F.concat(whole.cast("string"), F.lit("s"))).when(seconds < 3600, text(minutes, "m ", rest, "s")).otherwise(text(hours, "h ", minutes, "m"))


def backoff_ms(attempt: Column, base: int = 1000, most: int = 30000) -> Column:
    """Wait before an attempt, without the jitter of a quarter either way that a caller adds."""
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt), F.lit(most)).cast("long")


def holds_point(box: str, x: Column, y: Column) -> Column:
    """Whether a box (x, y, width, height) holds a point, its edges included."""
    b = F.col(box)
    return (b["x"] <= x) & (x <= b["x"] + b["width"]) & (b["y"] <= y) & (y <= b["y"] + b["height"])


def polygon_height(points: Column) -> Column:
    """Mean length of the left and right edge of four points (x, y), else how far the points reach."""
    d = lambda a, b: F.sqrt(F.pow(F.get(points, a)["x"] - F.get(points, b)["x"], 2) + F.pow(F.get(points, a)["y"] - F.get(points, b)["y"], 2))
    ys = F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) == 4, (d(3, 0) + d(2, 1)) / 2).otherwise(F.array_max(ys) - F.array_min(ys))


def nearest_bin(angle: Column, centers: list[float]) -> Column:
    """Number of the nearest centre, the first of several."""
    return F.array_min(F.array(*(F.struct(F.abs(angle - c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centers))))["k"]


def mos_defect(mos: Column) -> Column:
    """Opinion score of 1 to 5 as a defect of 1 to 0."""
    return (5.0 - mos) / 4.0


def entropy(shares: Column) -> Column:
    """Entropy in nats of a map of shares."""
    return F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def kl_of_maps(p: Column, q: Column, least: float = 1e-10) -> Column:
    """Divergence of two maps over the keys of the first; shares are `least` at least."""
    floor = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(least))
    return F.aggregate(F.map_keys(p), F.lit(0.0), lambda a, k: a + floor(p[k]) * F.log(floor(p[k]) / floor(q[k])))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, to about 1e-7 (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def utc_time(text: Column) -> Column:
    """A time of ISO 8601; without a zone it is UTC, null if it isn't one."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains("T"), text).otherwise(F.concat(F.regexp_replace(text, " ", "T"), F.when(F.length(text) <= 10, "T00:00:00Z").otherwise("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(zoned))


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def checksum(histogram: Column, edges: Column) -> Column:
    """16 hex digits that name a histogram: of its counts and edges as JSON with sorted keys."""
    joined = lambda x: F.array_join(F.transform(x, lambda v: v.cast("double").cast("string")), ", ")
    return F.substring(F.sha2(F.concat(F.lit('{"bin_edges": ['), joined(edges), F.lit('], "histogram": ['), joined(histogram), F.lit("]}")), 256), 1, 16)
