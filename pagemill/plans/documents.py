"""Queries of text measures over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from .fixtures import table

_CHARS = "length(replace(replace(text, ' ', ''), chr(10), ''))"
_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, {_CHARS}::BIGINT AS chars, round({_CHARS} / ((1000 + doc_id % 10 * 100) * 1500 / 1e6), 6) AS text_yield FROM documents")
def text_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.chars(F.col("text")).cast("long").alias("chars"), F.round(T.text_yield(F.col("text"), 1000 + F.col("doc_id") % 10 * 100, F.lit(1500)), 6).alias("text_yield"))


@query(f"SELECT doc_id, {_WORDS}::BIGINT AS words, round({_WORDS} / (1000.0::DOUBLE * (1 + doc_id % 7)), 6) AS word_density FROM documents")
def word_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).cast("long").alias("words"), F.round(T.word_density(F.col("text"), 1000.0 * (1 + F.col("doc_id") % 7)), 6).alias("word_density"))


@query("""
WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: length(x)::DOUBLE) AS s FROM documents),
m AS (SELECT doc_id, s, list_sum(s) / len(s) AS mean, list_sum(list_transform(s, lambda x: x * x)) / len(s) AS sq FROM l)
SELECT doc_id, round(CASE WHEN len(s) < 3 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - sqrt(greatest(sq - mean * mean, 0.0)) / mean)) END, 4) AS line_regularity FROM m""")
def line_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(T.line_regularity(F.col("text")), 4).alias("line_regularity"))


@query(r"""
WITH i AS (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS ink FROM documents)
SELECT doc_id, round(CASE WHEN length(ink) > 0 THEN length(regexp_replace(ink, '[^\p{L}\p{M}\p{N}\p{P}\p{Sm}\p{Sc}]', '', 'g')) / length(ink) ELSE 0 END, 6) AS valid_char_rate FROM i""")
def valid_char_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(T.valid_char_rate(F.col("text")), 6).alias("valid_char_rate"))


@query(r"""
WITH c AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\s', '', 'g'), '')) AS c FROM documents),
b AS (SELECT doc_id, unicode(c) >> 8 AS b, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total, count(*) AS kinds FROM b GROUP BY doc_id),
e AS (SELECT doc_id, -sum(n / total * ln(n / total)) AS e, any_value(kinds) AS kinds, any_value(total) AS total FROM b JOIN t USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN coalesce(total, 0) < 2 OR kinds < 2 THEN 0 ELSE e / ln(kinds) END, 6) AS block_entropy FROM documents d LEFT JOIN e USING (doc_id)""")
def block_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(T.block_entropy(F.col("text")), 6).alias("block_entropy"))


_INK = "length(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), ''))"
_AGREE = f"CASE WHEN doc_id % 5 = 0 AND {_INK} = 0 THEN 1.0 WHEN doc_id % 5 = 0 THEN 0.5 ELSE exp(-abs(ln(greatest({_INK} / (doc_id % 5 * 100.0::DOUBLE * greatest(0.1::DOUBLE, doc_id % 30 / 100 * 10)), 0.01::DOUBLE)))) END"
_COMPLETE = f"CASE WHEN doc_id % 5 > 0 THEN least(1.0, {_INK} / (doc_id % 5) / 50) WHEN {_INK} > 0 THEN 1.0 ELSE 0.0 END"


@query(f"SELECT doc_id, round({_AGREE}, 6) AS layout_text_agreement, round({_COMPLETE}, 6) AS completeness FROM documents")
def layout_text_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document has no region."""
    regions, n = F.col("doc_id") % 5, T.ink(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.round(T.layout_agreement(n, regions, F.col("doc_id") % 30 / 100), 6).alias("layout_text_agreement"), F.round(T.completeness(n, regions), 6).alias("completeness"))


_YIELD = f"{_CHARS} / ((1000 + doc_id % 10 * 100) * 1500 / 1e6)"


@query(f"""SELECT doc_id, round({_YIELD}, 6) AS text_yield, round({_WORDS} / (1000.0::DOUBLE * (1 + doc_id % 7)), 6) AS word_density, round({_COMPLETE}, 6) AS ocr_completeness, round({_AGREE}, 6) AS layout_text_agreement,
  round(({_YIELD} - doc_id % 900) / greatest(doc_id % 900, 1.0::DOUBLE), 6) AS ori_res_text_delta, round(1 - abs(doc_id % 11 / 10 - least(1.0, {_YIELD} / 5000.0::DOUBLE)), 6) AS score_agreement FROM documents""")
def ocr_proxy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of a page's text in one pass; those that have queries of their own are left out."""
    k = F.col("doc_id")
    m = T.ocr_proxies(F.col("text"), 1000 + k % 10 * 100, F.lit(1500), k % 5, 1000.0 * (1 + k % 7), k % 30 / 100, (k % 900).cast("double"), k % 11 / 10, F.lit(5000.0))
    names = ("text_yield", "word_density", "ocr_completeness", "layout_text_agreement", "ori_res_text_delta", "score_agreement")
    return _docs(spark, sf_dir).select("doc_id", m.alias("m")).select("doc_id", *(F.round(f"m.{n}", 6).alias(n) for n in names))


@query(f"""SELECT source, count(*) AS documents, round(avg({_CHARS}), 4) AS mean_chars, round(avg({_WORDS}), 4) AS mean_words, round(avg(length(text) / greatest({_WORDS}, 1)), 4) AS mean_word_length FROM documents GROUP BY source""")
def ocr_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.round(F.avg(T.chars(F.col("text"))), 4).alias("mean_chars"), F.round(F.avg(T.words(F.col("text"))), 4).alias("mean_words"), F.round(F.avg(F.length(F.col("text")) / F.greatest(T.words(F.col("text")), F.lit(1))), 4).alias("mean_word_length"))


@query(f"""SELECT doc_id, length(text)::BIGINT AS chars, {_WORDS}::BIGINT AS words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> ''))::BIGINT AS sentences,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS lines FROM documents""")
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.length(F.col("text")).cast("long").alias("chars"), T.words(F.col("text")).cast("long").alias("words"), T.pieces(F.col("text"), "[.!?]+").cast("long").alias("sentences"), T.pieces(F.col("text"), "\n").cast("long").alias("lines"))


@query("""
WITH o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS k, count(*) OVER () AS n FROM documents),
q AS (SELECT unnest([1, 2, 3]) AS q), p AS (SELECT DISTINCT q, n, least(n - 1, greatest(1, q * (n + 1) // 4)) AS j, q * (n + 1) AS t FROM q, o)
SELECT q AS quartile, round(((j + 1) * 4 - t) / 4 * a.n_chars + (t - j * 4) / 4 * b.n_chars, 4) AS n_chars FROM p JOIN o a ON a.k = j JOIN o b ON b.k = j + 1""")
def text_stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the corpus by the exclusive method: from the counts of each length, not from a sort of all rows in one task."""
    by = _docs(spark, sf_dir).groupBy("n_chars").agg(F.count("*").alias("c"))
    n = _docs(spark, sf_dir).count()
    from pyspark.sql import Window

    # one row for each distinct length
    upto = by.withColumn("hi", F.sum("c").over(Window.orderBy("n_chars"))).withColumn("lo", F.col("hi") - F.col("c"))
    rows = spark.range(1, 4).select(F.col("id").cast("int").alias("quartile"), (F.col("id") * (n + 1)).alias("t")).withColumn("j", F.least(F.lit(n - 1), F.greatest(F.lit(1), F.floor(F.col("t") / 4))))
    at = rows.join(upto, (F.col("j") > F.col("lo")) & (F.col("j") <= F.col("hi"))).select("quartile", "t", "j", F.col("n_chars").alias("a"))
    out = at.join(upto, (F.col("j") + 1 > F.col("lo")) & (F.col("j") + 1 <= F.col("hi")))
    return out.select("quartile", F.round(((F.col("j") + 1) * 4 - F.col("t")) / 4 * F.col("a") + (F.col("t") - F.col("j") * 4) / 4 * F.col("n_chars"), 4).alias("n_chars"))


_SCOPE = "CASE WHEN n <= 1 THEN 'character' WHEN n <= 20 THEN 'word' WHEN n <= 50 THEN 'phrase' WHEN n <= 200 THEN 'sentence' WHEN n <= 1000 THEN 'paragraph' WHEN n <= 5000 THEN 'page' ELSE 'document' END"
_WORD_SCOPE = "CASE WHEN w = 0 THEN 'character' WHEN w = 1 THEN 'word' WHEN w <= 5 THEN 'phrase' WHEN w <= 30 THEN 'sentence' WHEN w <= 200 THEN 'paragraph' WHEN w <= 1000 THEN 'page' ELSE 'document' END"


@query(f"SELECT doc_id, {_SCOPE} AS scope FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE n_chars % 61 END AS n FROM documents)")
def text_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).otherwise(F.col("n_chars") % 61)
    return _docs(spark, sf_dir).select("doc_id", T.scope_of_chars(n).alias("scope"))


@query(f"""WITH s AS (SELECT doc_id, {_SCOPE} AS a, {_WORD_SCOPE} AS b FROM (SELECT doc_id, n_chars AS n, {_WORDS} AS w FROM documents)), o AS (SELECT ['character', 'word', 'phrase', 'sentence', 'line', 'paragraph', 'page', 'document'] AS o)
SELECT doc_id, a AS scope, b AS scope_of_words, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE sign(list_position(o, a) - list_position(o, b)) END::INT AS order FROM s, o""".replace(" AS order", " AS compared"))
def scope_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes by characters and by words, and how they compare; each ninth is of mixed scope, which compares with none."""
    a, b = T.scope_of_chars(F.col("n_chars")), T.scope_of_words(T.words(F.col("text")))
    told = F.when(F.col("doc_id") % 9 == 0, "mixed").otherwise(b)
    return _docs(spark, sf_dir).select("doc_id", a.alias("scope"), b.alias("scope_of_words"), T.compare_scopes(a, told).alias("compared"))


@query("""SELECT lang, CASE WHEN n_chars >= 5 AND n_chars < 30 THEN 'minimal' WHEN n_chars >= 30 AND n_chars < 150 THEN 'short' WHEN n_chars >= 150 AND n_chars < 500 THEN 'medium' WHEN n_chars >= 500 AND n_chars < 1500 THEN 'long'
  WHEN n_chars >= 1500 AND n_chars < 5000 THEN 'dense' END AS bucket, count(*) AS documents FROM documents GROUP BY ALL""")
def text_density_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang", T.density_bucket(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("documents"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def strip_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned"))


@query("SELECT doc_id, lang AS language, CASE lang WHEN 'de' THEN 'Latn' WHEN 'fr' THEN 'Latf' END AS script, CASE WHEN doc_id % 2 = 0 THEN upper(lang) END AS region FROM documents")
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = F.when(F.col("lang") == "de", "-latn").when(F.col("lang") == "fr", "-LATF").otherwise("")
    tag = F.concat(F.upper("lang"), script, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("-"), F.col("lang"))).otherwise(""))
    return _docs(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in T.language_tag(tag).items()))
