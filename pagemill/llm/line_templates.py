"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

A line's tokens are its parts between white space; one with a digit is a variable field, <*>. The tree's leaves are keyed by the number of
tokens and the first DEPTH tokens. A line recurs if unlike documents hold it. Likeness is told by a line of the document that is away from
the line itself: of all lines that aren't blank and stand more than NEAR lines off, the one with the smallest MD5 (for documents of few lines the
whole text). Copies and near copies of a document mostly agree in it, so they don't make their lines recur, but a notice of one or a few lines does that was
pasted into many documents, whatever stands beside it, blank lines too. These lines are counted as contexts; contexts have to be at least half
of the distinct texts that hold the line.

Templates are (a) masked lines with at least min_contexts contexts, or long_contexts from long_tokens tokens on, and (b) in each leaf whose lines recur
together, the tokens that at least half of them have at a place, other places being variable too, if enough places are fixed and
the lines that fit have min_contexts contexts. Lines that fit a template are dropped, all but the first (smallest key, then place).

All statistics are over all lines. They're sums by a hash, pre-aggregated before each shuffle; texts are shuffled once, beside the list of the
lines to drop.

Defined results. Null text stays null, with no lines; empty text and blank lines stay as they are. Repeated rows (same key and text)
lose the same lines; rows that share a key but not the text are told apart by a hash of the text. Lines of any length. A null key: its lines
count, and go like others. Empty table: no rows. Extra columns pass through, whatever their names; columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

DEPTH = 3
VARIABLE = "<*>"


def masked(line):
    """A line's tokens joined by blanks, those with a digit as VARIABLE. Blank lines give an empty string."""
    plain = F.trim(F.regexp_replace(line, r"[\t\x0B\f\r ]+", " "))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(plain)


#: A context stands more than this many lines off.
NEAR = 2


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, row (hash of the text), pos, m (masked line), h (its hash), context (hash), for lines that aren't blank."""
    each = F.transform(F.split(F.col("text"), "\n"), lambda line, i: F.struct(i.alias("pos"), masked(line).alias("m")))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null").select("key", F.xxhash64("text").alias("row"), F.filter(each, lambda x: x["m"] != "").alias("ls"))
    # of so many lines one at least is more than NEAR lines off
    few = 2 * NEAR + 2
    by_digest = F.transform("ls", lambda x, i: F.struct(F.md5(F.encode(x["m"], "UTF-8")).alias("digest"), i.alias("i"), F.xxhash64(x["m"]).alias("h")))
    rows = rows.withColumn("least", F.when(F.size("ls") > few, F.slice(F.sort_array(by_digest), 1, few)))

    def line(x, i):
        off = F.get(F.filter("least", lambda y: F.abs(y["i"] - i) > NEAR), F.lit(0))["h"]
        return F.struct(x["pos"].alias("pos"), x["m"].alias("m"), F.xxhash64(x["m"]).alias("h"), F.coalesce(off, F.col("row")).alias("context"))

    return rows.select("key", "row", F.inline(F.transform("ls", line)))


def plain_lines(docs: DataFrame, text: str) -> DataFrame:
    """m of the lines that aren't blank. They are masked before the rows are made, or each use of m would mask them again."""
    return docs.select(F.explode(F.transform(F.split(F.col(text).cast("string"), "\n"), masked)).alias("m")).filter("m <> ''")


def leafed(found: DataFrame, min_tokens: int) -> DataFrame:
    """found with n (tokens) and leaf, null for lines of fewer than min_tokens."""
    tokens = F.split("m", " ")
    return found.withColumn("n", F.size(tokens)).withColumn("leaf", F.when(F.col("n") >= min_tokens, F.xxhash64("n", F.slice(tokens, 1, DEPTH))))


def recurrence(found: DataFrame, by: str, *more) -> DataFrame:
    """by, w (contexts), texts (distinct ones) and more aggregates over rows of (by, row, pos, context, and what they need), each step pre-aggregated.

    A text counts once, with the context of its first such line.
    """
    names = [f"more{k}" for k in range(len(more))]
    each = found.groupBy(by, "row").agg(F.min(F.struct("pos", "context"))["context"].alias("context"), *(f(c).alias(n) for n, (f, c) in zip(names, more, strict=True)))
    some = each.groupBy(by, "context").agg(F.count("*").alias("texts"), *(f(n).alias(n) for n, (f, _) in zip(names, more, strict=True)))
    return some.groupBy(by).agg(F.count("*").alias("w"), F.sum("texts").alias("texts"), *(f(n).alias(n) for n, (f, _) in zip(names, more, strict=True)))


#: Leaves of 8 bytes that may be broadcast; more of them are joined by a shuffle.
BROADCAST_LEAVES = 1_000_000


def _small(keys: DataFrame) -> DataFrame:
    """A table of keys of 8 bytes, to be broadcast unless they are too many."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_LEAVES else keys


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_contexts: int = 10, long_contexts: int = 3, long_tokens: int = 8, min_tokens: int = 5, fixed_share: float = 0.6) -> DataFrame:
    """key, row, pos of the lines to drop.

    Lines are kept as hashes; the text of a line is looked at again only in leaves whose lines recur.
    """
    all_lines = stored(leafed(lines(docs, key, text), min_tokens).select("key", "row", "pos", "h", "context", "leaf", (F.col("n") >= long_tokens).alias("long")), "lines")
    varied = F.col("w") * 2 >= F.col("texts")
    least = lambda c: F.when(F.col(c), long_contexts).otherwise(min_contexts)
    # plain counts first: most lines stand in one text, and what can't recur isn't sorted by its contexts
    often = all_lines.groupBy("h").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b"), F.max("long").alias("long")).filter((F.col("a") < F.col("b")) & (F.col("n") >= least("long")))
    some = all_lines.join(_small(stored(often.select("h"), "often")), "h", "left_semi")
    counted = recurrence(some.withColumn("at", F.struct("key", "row", "pos")), "h", (F.min, "at"), (F.max, "long"))
    recurring = counted.filter(varied & (F.col("w") >= least("more1"))).select("h", F.col("more0").alias("first"))

    # leaves: what differs from line to line beyond the masked fields
    wide = all_lines.filter("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b"), F.min("h").alias("c"), F.max("h").alias("d")).filter((F.col("a") < F.col("b")) & (F.col("c") < F.col("d")) & (F.col("n") >= min_contexts))
    grown = recurrence(all_lines.join(_small(stored(wide.select("leaf"), "wide")), "leaf", "left_semi"), "leaf")
    leaves = stored(grown.filter(varied & (F.col("w") >= min_contexts)).select("leaf"), "leaves")
    few = _small(leaves)
    weights = all_lines.join(few, "leaf").groupBy("leaf", "h").agg(F.count_distinct("context").alias("w"))
    texts = leafed(plain_lines(docs, text), min_tokens).withColumn("h", F.xxhash64("m")).filter("leaf is not null").join(few, "leaf").groupBy("leaf", "n", "h").agg(F.first("m").alias("m"))
    distinct = stored(texts.join(weights, ["leaf", "h"]), "leafed")
    places = distinct.select("leaf", "n", "w", F.posexplode(F.split("m", " ")).alias("place", "token"))
    mass = places.groupBy("leaf", "n", "place", "token").agg(F.sum("w").alias("w"))
    best = mass.groupBy("leaf", "n", "place").agg(F.max(F.struct("w", "token")).alias("best"), F.sum("w").alias("all"))
    fixed = best.filter((F.col("best.w") * 2 >= F.col("all")) & (F.col("best.token") != VARIABLE))
    templates = fixed.groupBy("leaf", "n").agg(F.map_from_entries(F.collect_list(F.struct("place", "best.token"))).alias("fixed")).filter(F.size("fixed") >= F.col("n") * fixed_share)
    fits = F.forall(F.map_entries("fixed"), lambda e: F.get(F.split("m", " "), e["key"]) == e["value"])
    fitting = stored(distinct.join(templates.select("leaf", "fixed"), "leaf").filter(fits).select("leaf", "h", "w"), "fitting")
    strong = fitting.groupBy("leaf").agg(F.sum("w").alias("all"), F.count("*").alias("n")).filter((F.col("all") >= min_contexts) & (F.col("n") > 1))
    general = fitting.join(strong, "leaf").select("h", "leaf")
    firsts = all_lines.select("h", "key", "row", "pos").join(general, "h").groupBy("leaf").agg(F.min(F.struct("key", "row", "pos")).alias("first"))

    verdict = recurring.select("h", "first").unionByName(general.join(firsts, "leaf").select("h", "first")).groupBy("h").agg(F.min("first").alias("first"))
    here = F.struct("key", "row", "pos")
    return all_lines.join(verdict, "h").filter(~here.eqNullSafe(F.col("first"))).select("key", "row", "pos")


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """docs with the lines dropped, n_lines (before) and n_dropped."""
    own = ("n_lines", "n_dropped")
    gone = dropped_lines(docs, key, text, **limits).groupBy("key", "row").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in own)).alias("doc"), F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("row"), F.col(text).cast("string").alias("plain"))
    joined = rows.alias("d").join(gone.alias("g"), F.col("d.key").eqNullSafe(F.col("g.key")) & (F.col("d.row") == F.col("g.row")), "left")
    parts = F.split("d.plain", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("g.gone"), i)), "\n")
    new = F.when(F.col("g.gone").isNull(), F.col("d.plain")).otherwise(kept)
    columns = [new.alias(c) if c == text else F.col(f"d.doc.`{c}`").alias(c) for c in docs.columns if c not in own]
    return joined.select(*columns, F.when(F.col("d.plain").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), F.when(F.col("g.gone").isNull(), 0).otherwise(F.size("g.gone")).alias("n_dropped"))


#: The same in DuckDB, over documents with unique keys: strings stand for the hashes.
ORACLE = r"""
WITH split_docs AS (
  SELECT doc_id, text, list_filter(list_transform(list_zip(range(0, len(string_split(text, chr(10)))), string_split(text, chr(10))),
    lambda x: {'pos': x[1], 'm': regexp_replace(trim(regexp_replace(x[2], '[\t\x0B\f\r ]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g')}), lambda x: x.m <> '') AS ls
  FROM documents WHERE text IS NOT NULL),
with_least AS (
  SELECT *, CASE WHEN len(ls) > 6 THEN list_sort(list_transform(range(1, len(ls) + 1), lambda i: {'digest': md5(ls[i].m), 'i': i, 'm': ls[i].m}))[1:6] END AS least FROM split_docs),
all_lines AS (
  SELECT doc_id, text, ls[i].pos AS pos, ls[i].m AS m, len(string_split(ls[i].m, ' ')) AS n,
    CASE WHEN least IS NULL THEN concat('text', text) ELSE concat('line', list_filter(least, lambda y: abs(y.i - i) > 2)[1].m) END AS context
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM with_least)),
by_text AS (SELECT m, n, text, arg_min(context, pos) AS context, min((doc_id, pos)) AS first FROM all_lines GROUP BY ALL),
recurring AS (
  SELECT m, min(first) AS first FROM by_text GROUP BY m, n
  HAVING count(DISTINCT context) >= CASE WHEN n >= 8 THEN 3 ELSE 10 END AND count(DISTINCT context) * 2 >= count(*)),
leafed AS (
  SELECT *, concat(n, ' ', array_to_string(string_split(m, ' ')[1:3], ' ')) AS leaf
  FROM all_lines WHERE n >= 5),
leaf_texts AS (SELECT leaf, text, arg_min(context, pos) AS context, min(m) AS a, max(m) AS b FROM leafed GROUP BY leaf, text),
leaves AS (SELECT leaf FROM leaf_texts GROUP BY leaf HAVING count(DISTINCT context) >= 10 AND count(DISTINCT context) * 2 >= count(*) AND min(a) < max(b)),
lines_of AS (SELECT leaf, n, m, count(DISTINCT context) AS w FROM leafed WHERE leaf IN (SELECT leaf FROM leaves) GROUP BY ALL),
places AS (SELECT leaf, n, w, i AS place, string_split(m, ' ')[i] AS token FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM lines_of)),
mass AS (SELECT leaf, n, place, token, sum(w) AS w FROM places GROUP BY ALL),
best AS (SELECT leaf, n, place, max((w, token)) AS best, sum(w) AS total FROM mass GROUP BY ALL),
fixed AS (SELECT leaf, n, place, best[2] AS token FROM best WHERE best[1] * 2 >= total AND best[2] <> '<*>'),
templates AS (SELECT leaf, n, list((place, token)) AS fixed FROM fixed GROUP BY ALL HAVING count(*) >= n * 0.6),
fitting AS (
  SELECT l.leaf, l.m, l.w FROM lines_of l JOIN templates t USING (leaf)
  WHERE len(list_filter(t.fixed, lambda e: string_split(l.m, ' ')[e[1]] <> e[2])) = 0),
strong AS (SELECT leaf FROM fitting GROUP BY leaf HAVING sum(w) >= 10 AND count(*) > 1),
general AS (SELECT m, leaf FROM fitting WHERE leaf IN (SELECT leaf FROM strong)),
firsts AS (SELECT leaf, min((doc_id, pos)) AS first FROM all_lines JOIN general USING (m) GROUP BY leaf),
verdict AS (SELECT m, min(first) AS first FROM (SELECT m, first FROM recurring UNION ALL SELECT m, first FROM general JOIN firsts USING (leaf)) GROUP BY m),
gone AS (SELECT doc_id, list(pos) AS gone FROM all_lines JOIN verdict USING (m) WHERE (doc_id, pos) <> first GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, d.text, g.gone, string_split(d.text, chr(10)) AS parts
  FROM documents d LEFT JOIN gone g USING (doc_id))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(parts) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE array_to_string(list_transform(list_filter(range(0, len(parts)), lambda i: NOT list_contains(gone, i)), lambda i: parts[i + 1]), chr(10)) END) AS kept_sha256
FROM kept
"""
