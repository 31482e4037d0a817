"""Text measures as columns: yields, densities, regularity, statistics, scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chars(text: Column) -> Column:
    """Characters without blanks and newlines."""
    return F.length(F.translate(text, " \n", ""))


def words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def text_yield(text: Column, width: Column, height: Column) -> Column:
    """Characters per megapixel; 0 without an area."""
    area = width * height / 1e6
    return F.when(area > 0, chars(text) / area).otherwise(0.0)


def word_density(text: Column, area: Column) -> Column:
    return F.when(area > 0, words(text) / area).otherwise(0.0)


def completeness(count: Column, regions: Column, per_region: int = 50) -> Column:
    """Share of the characters that so many regions should have, at most 1; without regions 1 if there is text."""
    return F.when(regions > 0, F.least(F.lit(1.0), count / regions / per_region)).otherwise(F.when(count > 0, 1.0).otherwise(0.0))


def ink(text: Column) -> Column:
    """Characters without blanks, newlines and tabs."""
    return F.length(F.translate(text, " \n\t", ""))


def layout_agreement(count: Column, regions: Column, area_ratio: Column) -> Column:
    """How well the characters fit the regions, of 100 characters each times their share of the area; without regions 1 if there is no text either, else 0.5."""
    expected = regions * 100.0 * F.greatest(F.lit(0.1), area_ratio * 10)
    fits = F.exp(-F.abs(F.log(F.greatest(count / expected, F.lit(0.01)))))
    return F.when((regions == 0) & (count == 0), 1.0).when(regions == 0, 0.5).otherwise(fits)


def yield_delta(after: Column, before: Column) -> Column:
    """Relative change of a text yield; the base is 1 at least."""
    return (after - before) / F.greatest(before, F.lit(1.0))


def score_agreement(score: Column, value: Column, most: Column) -> Column:
    """1 less the distance of a score from a value's share of the largest one; 0.5 if that isn't positive."""
    return F.when(most <= 0, 0.5).otherwise(1 - F.abs(score - F.least(F.lit(1.0), value / most)))


def ocr_proxies(text: Column, width: Column, height: Column, regions: Column, area: Column, area_ratio: Column, original_yield: Column | None = None, score: Column | None = None, most: Column | None = None) -> Column:
    """The nine measures of a text as one struct; those without an input are null."""
    y = text_yield(text, width, height)
    nothing = F.lit(None).cast("double")
    return F.struct(
        y.alias("text_yield"),
        word_density(text, area).alias("word_density"),
        completeness(ink(text), regions).alias("ocr_completeness"),
        block_entropy(text).alias("cjk_latin_consistency"),
        line_regularity(text).alias("line_regularity"),
        valid_char_rate(text).alias("valid_char_rate"),
        layout_agreement(ink(text), regions, area_ratio).alias("layout_text_agreement"),
        (nothing if original_yield is None else yield_delta(y, original_yield)).alias("ori_res_text_delta"),
        (nothing if score is None or most is None else score_agreement(score, y, most)).alias("score_agreement"),
    )


def line_regularity(text: Column) -> Column:
    """1 less the variation of the lengths of lines that aren't blank, in 0 to 1; 0.5 below three lines."""
    sizes = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.length(x).cast("double"))
    n = F.size(sizes)
    mean = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean
    return F.when(n < 3, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt(F.greatest(var, F.lit(0.0))) / mean)))


def valid_char_rate(text: Column) -> Column:
    """Share of letters, marks, numbers, punctuation and symbols in what isn't white space; 0 without any."""
    ink = F.regexp_replace(text, r"\s", "")
    good = F.length(F.regexp_replace(ink, r"[^\p{L}\p{M}\p{N}\p{P}\p{Sm}\p{Sc}]", ""))
    return F.when(F.length(ink) > 0, good / F.length(ink)).otherwise(0.0)


def block_entropy(text: Column) -> Column:
    """Shannon entropy over blocks of 256 code points, by the log of their number; 0 with one block or below two characters."""
    ink = F.regexp_replace(text, r"\s", "")
    blocks = F.transform(F.filter(F.split(ink, ""), lambda c: c != ""), lambda c: F.shiftright(F.ascii(c), 8))
    n = F.size(blocks)
    kinds = F.array_distinct(blocks)
    share = F.transform(kinds, lambda k: F.size(F.filter(blocks, lambda b: b == k)) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log(p))
    return F.when((n < 2) | (F.size(kinds) < 2), 0.0).otherwise(entropy / F.log(F.size(kinds)))


def pieces(text: Column, pattern: str) -> Column:
    """Parts between matches of a pattern that aren't blank."""
    return F.size(F.filter(F.split(text, pattern), lambda x: F.trim(x) != ""))


#: Scopes in order, and the most characters and words of each; the last scope has no bound.
SCOPES = ("character", "word", "phrase", "sentence", "paragraph", "page", "document")
CHARS_OF_SCOPE = (1, 20, 50, 200, 1000, 5000)
WORDS_OF_SCOPE = (0, 1, 5, 30, 200, 1000)
#: Order of all scopes; mixed and unknown can't be compared.
SCOPE_ORDER = ("character", "word", "phrase", "sentence", "line", "paragraph", "page", "document")


def ladder(x: Column, most: tuple, names: tuple) -> Column:
    """names[i] for the first bound that x doesn't exceed, the last name above all."""
    out = F.lit(names[-1])
    for bound, name in reversed(tuple(zip(most, names, strict=False))):
        out = F.when(x <= bound, name).otherwise(out)
    return out


def scope_of_chars(n: Column) -> Column:
    return ladder(n, CHARS_OF_SCOPE, SCOPES)


def scope_of_words(n: Column) -> Column:
    return ladder(n, WORDS_OF_SCOPE, SCOPES)


def compare_scopes(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the order of scopes; 0 if either is none of them."""
    order = F.array(*(F.lit(s) for s in SCOPE_ORDER))
    x, y = F.array_position(order, a), F.array_position(order, b)
    return F.when((x > 0) & (y > 0), F.signum(x - y)).otherwise(0).cast("int")


def density_bucket(n: Column) -> Column:
    """Half-open ranges of characters; below 5 and from 5000 there is no bucket."""
    return F.when((n >= 5) & (n < 30), "minimal").when((n >= 30) & (n < 150), "short").when((n >= 150) & (n < 500), "medium").when((n >= 500) & (n < 1500), "long").when((n >= 1500) & (n < 5000), "dense")


def strip_html(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def language_tag(tag: Column) -> dict[str, Column]:
    """Language, four-letter script and two-letter region of a BCP-47 tag."""
    parts = F.split(tag, "[-_]")
    rest = F.slice(parts, 2, 9)
    return {"language": F.lower(F.get(parts, 0)), "script": F.initcap(F.get(F.filter(rest, lambda p: p.rlike("^[A-Za-z]{4}$")), 0)), "region": F.upper(F.get(F.filter(rest, lambda p: p.rlike("^[A-Za-z]{2}$")), 0))}
