"""Exact self join of documents by Jaccard similarity of their word-shingle sets, with PartEnum signatures.

Sets fall into bands by size, each 1 / similarity times as wide as the one before. Similar sets are in the same or in neighbouring
bands, so a set takes part in the scheme of its band and in the one below. In a scheme two similar sets differ in at most k shingles;
the shingles' domain is split by a hash into n1 = k + 1 + slack parts, and every subset of n1 - k parts on which the two agree
shares its signatures. A signature is the hash of the part of a set that lies in one part of the domain. As similar sets share
at least n1 - k of n1 signatures, each set needs only its k + 1 rarest: the frequent ones, such as those that a passage
makes which very many documents share, bring no candidates. For every set, parts without shingles count as more frequent than all others, so
they are used only by sets that have more of them than slack: those keep all their parts with shingles, and leave slack empty ones out.

Only sets that may have a partner get signatures: those of fewer than 64 shingles, and those that share a band of min-hashes with another set (one
permutation, 120 bins, 60 bands of two for sets of up to 500 shingles, 40 bands of three for those of 320 or more). Sets of fewer than 64 that can be
similar to one of 64 or more have bands too, so that the larger one finds them. A similar pair fails to with a
probability below 1e-12, less than that of two 64-bit hashes of the corpus being equal; what passes costs time only.

Candidates are verified by their whole sets. In each signature's group every set is compared with the first of its salt, and those with the first of
all. Groups that hold several components then are joined to clusters, and clusters are compared completely, in blocks of bounded size and of sizes that can
be similar; pairs of blocks that are linked already through others are left out. So no link between components is lost, and no pairs are listed.

Documents of equal sets count as one node (a 64-bit hash of the set names it), so copies make no pairs.

Defined results. Null or empty text, or one without words: n_shingles 0, a component of its own. Repeated rows of a key: the key
is in one component. A null key takes no part in links; its row stays with a null component. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_shingles, components, drop_path, in_slices, mix64, shuffles_dropped, small_batches, store, stored


def bands(similarity_pct: int, up_to: int = 1 << 40) -> list[int]:
    """Smallest size of each band. Sets of sizes a <= b can be similar only if 100 a >= pct * b."""
    out = [1]
    while out[-1] < up_to:
        out.append(out[-1] * 100 // similarity_pct + 1)
    return out


def scheme(band: int, lows: list[int], similarity_pct: int) -> tuple[int, int]:
    """k and slack of the scheme of a band: the most shingles in which similar sets of this band, or of it and the next, differ."""
    hi = lows[band + 1] - 1
    other = min(lows[band + 2] - 1, hi * 100 // similarity_pct)
    k = (100 - similarity_pct) * (hi + other) // (100 + similarity_pct)
    return k, k // 12 + 1


def set_names(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit name of each set; the name is a sum over its shingles, so it depends on the set alone."""
    size = np.bincount(owner, minlength=n)
    total = np.zeros(n, np.uint64)
    np.add.at(total, owner, mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    return size, mix64(total ^ mix64(size.astype(np.uint64))).view(np.int64)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.large_binary()).to_pylist()


BINS = 120
#: Sets of fewer shingles pass the sieve whatever their bands are.
SMALL = 64


def sketch_bands(owner: np.ndarray, hashes: np.ndarray, size: np.ndarray, similarity_pct: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Set and hash of each band of min-hashes, for sets that can be similar to one of SMALL shingles or more.

    hashes are sorted in each set, so the first in a bin is its smallest.
    """
    n = len(size)
    which = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (which[1:] != which[:-1])
    value = np.zeros((n, 2 * BINS), np.uint64)
    filled = np.zeros((n, 2 * BINS), bool)
    for shift in (0, BINS):
        value[owner[first], which[first] + shift] = hashes[first]
        filled[owner[first], which[first] + shift] = True
    # an empty bin takes the value of the next filled one, mixed with the distance
    column = np.where(filled, np.arange(2 * BINS)[None, :], 4 * BINS)
    after = np.minimum.accumulate(column[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    some = size > 0
    after[~some] = 0
    value = mix64(np.take_along_axis(value, after, 1) + (after - np.arange(BINS)[None, :]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = []
    for r, use in ((2, (size >= SMALL * similarity_pct // 100) & (size < 500)), (3, size >= 320)):
        rows = np.flatnonzero(use)
        band = np.full((len(rows), BINS // r), np.uint64(r))
        for k in range(r):
            band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + value[rows][:, k::r])
        band = mix64(band + np.arange(BINS // r, dtype=np.uint64)[None, :])
        out.append((np.repeat(rows, BINS // r), band.ravel()))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity_pct: int = 80) -> DataFrame:
    """key, n_shingles, node (name of the set), bands (of min-hashes)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, 1)
            for a, b in in_slices(texts):
                owner, hashes = batch_shingles(texts[a:b], size)
                n, node = set_names(owner, hashes, b - a)
                of, band = sketch_bands(owner, hashes, n, similarity_pct)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(node), pa.ListArray.from_arrays(pa.array(cuts), pa.array(band[order].view(np.int64)))], names=["key", "n_shingles", "node", "bands"])

    return rows.mapInArrow(run, "key long, n_shingles long, node long, bands array<long>").withColumnRenamed("key", key)


def possible_nodes(keyed: DataFrame, key: str) -> DataFrame:
    """node and one key of each set that may be similar to another."""
    small = keyed.filter(f"n_shingles > 0 and n_shingles < {SMALL}").select("node", key)
    each = keyed.select("node", key, F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("band")
    return small.unionByName(each.join(shared, "band").select("node", key)).groupBy("node").agg(F.min(key).alias(key))


_BITS = 26


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((mix64(h + np.uint64(k)) >> np.uint64(64 - _BITS)).astype(np.int64) for k in (1, 2))


def key_bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """Bitmap of 2^_BITS bits (8 MB) with two bits for each key; a full one lets every key pass."""

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probe = np.unique(np.concatenate(_probes(batch.column(0).to_numpy().view(np.uint64))))
            word, first = np.unique(probe >> 5, return_index=True)
            mask = np.bitwise_or.reduceat(np.int64(1) << (probe & 31), first) if len(word) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"word": word.astype(np.int32), "mask": mask})

    with shuffles_dropped(keys.sparkSession):
        got = keys.select(F.col(key).cast("long")).mapInArrow(bits, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (_BITS - 5), "<u4")  # so many words at most come to the driver
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def with_keys(rows: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Rows (key, text) whose key is in the bitmap, and a few that it lets pass by chance."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for p in _probes(batch.column(0).to_numpy().view(np.uint64)):
                hit &= (shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            yield batch.filter(pa.array(hit))

    return rows.select("key", "text").mapInArrow(run, "key long, text string")


def whole_sets(docs: DataFrame, chosen: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """node and shingles of the nodes chosen; texts of other keys aren't looked at, but for a few that the bitmap lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(chosen, key))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).filter("key is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for p in _probes(batch.column(0).to_numpy().view(np.uint64)):
                hit &= (marks[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            some = batch.filter(pa.array(hit))
            texts = _texts(some, 1)
            for a, b in in_slices(texts):
                owner, hashes = batch_shingles(texts[a:b], size)
                n, node = set_names(owner, hashes, b - a)
                yield pa.RecordBatch.from_arrays([some.column(0).slice(a, b - a), pa.array(node), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["key", "node", "shingles"])

    found = rows.mapInArrow(run, "key long, node long, shingles array<long>").withColumnRenamed("key", key)
    return found.join(chosen, ["node", key]).dropDuplicates(["node"]).select("node", "shingles")


def _scheme_signatures(owner: np.ndarray, hashes: np.ndarray, size: np.ndarray, band: np.ndarray, k: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets given one after another and the scheme of each: set, signature, and spare.

    A signature is left out if it is one of the last spare ones of its set, ordered by spare (so that empty parts come last), then by frequency.
    """
    n1 = k + 1 + slack
    base = np.concatenate([[0], np.cumsum(n1)])
    part = (mix64(hashes ^ (band[owner].astype(np.uint64) + np.uint64(77))) % n1[owner].astype(np.uint64)).astype(np.int64) + base[owner]
    value = np.zeros(base[-1], np.uint64)
    np.add.at(value, part, mix64(hashes ^ np.uint64(0xA0761D6478BD642F)))
    filled = np.zeros(base[-1], bool)
    filled[part] = True
    of = np.repeat(np.arange(len(n1)), n1)
    where = np.arange(base[-1]) - base[of]
    empty = n1 - np.bincount(of[filled], minlength=len(n1))
    keep = filled | (empty > slack)[of]
    signature = mix64(value + mix64((band[of].astype(np.uint64) << np.uint64(40)) + where.astype(np.uint64)))
    spare = np.where(filled, np.maximum(0, slack - empty)[of], slack[of])
    return of[keep], signature[keep], spare[keep]


def signatures(sets: DataFrame, similarity_pct: int) -> DataFrame:
    """sig, node, scheme and spare of each set."""
    lows = np.array(bands(similarity_pct))
    table = np.array([scheme(i, lows.tolist(), similarity_pct) for i in range(len(lows) - 2)], np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                node = batch.column(0).to_numpy()
                n = batch.column(1).value_lengths().to_numpy().astype(np.int64)
                hashes = batch.column(1).flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(len(n)), n)
                own = np.searchsorted(lows, n, side="right") - 1
                for down in (0, 1):
                    ids = np.flatnonzero(own >= down)
                    if not len(ids):
                        continue
                    sel = (own >= down)[owner]
                    band = own[ids] - down
                    of, sig, spare = _scheme_signatures(np.searchsorted(ids, owner[sel]), hashes[sel], n[ids], band, *table[band].T)
                    yield pa.RecordBatch.from_pydict({"sig": sig.view(np.int64), "node": node[ids][of], "scheme": band[of].astype(np.int32), "spare": spare.astype(np.int32)})

    return sets.select("node", "shingles").mapInArrow(run, "sig long, node long, scheme int, spare int")


def candidate_groups(sigs: DataFrame) -> DataFrame:
    """sig, node of the signatures that count: shared ones, and of each set without its most frequent ones. A signature's sets never meet in a task: they're counted
    with partial sums, and the counts are joined."""
    counts = sigs.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    mine = Window.partitionBy("node", "scheme")  # a set has k + 1 + slack signatures at most
    ranked = sigs.join(counts, "sig").withColumn("rank", F.row_number().over(mine.orderBy("spare", "n", "sig"))).withColumn("all", F.count("*").over(mine))
    return ranked.filter(F.col("rank") <= F.col("all") - F.col("spare")).select("sig", "node").distinct()


def seed_pairs(groups: DataFrame, salts: int = 64) -> DataFrame:
    """Pairs (a, b) of nodes of a group: each with the first of its salt, and that with the first of all; both firsts are partial minima."""
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("node", "sig"), F.lit(salts)))
    near = salted.groupBy("sig", "salt").agg(F.min("node").alias("a"))
    far = near.groupBy("sig").agg(F.min("a").alias("first"))
    local = salted.join(near, ["sig", "salt"]).select("a", F.col("node").alias("b"))
    heads = near.join(far, "sig").select(F.col("first").alias("a"), F.col("a").alias("b"))
    return local.unionByName(heads).filter("a < b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity_pct: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar: 100 * intersection >= pct * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    fits = F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * similarity_pct
    return pairs.join(left, "a").join(right, "b").filter(fits).filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * similarity_pct).select("a", "b")


def block_links(nodes: list[np.ndarray], groups: list[np.ndarray], sizes: list[np.ndarray], flat: list[np.ndarray], similarity_pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs of sets of two blocks that are in different groups. Each block: nodes, groups, sizes, and the shingles of all sets."""
    common = np.intersect1d(flat[0], flat[1])
    tables = []
    for k in (0, 1):
        at = np.searchsorted(common, flat[k])
        inside = (at < len(common)) & (common[np.minimum(at, max(0, len(common) - 1))] == flat[k]) if len(common) else np.zeros(len(flat[k]), bool)
        m = np.zeros((len(nodes[k]), len(common)), np.float32)
        m[np.repeat(np.arange(len(nodes[k])), sizes[k])[inside], at[inside]] = 1
        tables.append(m)
    both = np.rint(tables[0] @ tables[1].T).astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - both
    i, j = np.nonzero((100 * both >= similarity_pct * union) & (groups[0][:, None] != groups[1][None, :]))
    return nodes[0][i], nodes[1][j]


def cluster_links(groups: DataFrame, found: DataFrame, sets: DataFrame, similarity_pct: int, block: int = 1 << 16) -> DataFrame:
    """Links (a, b) between components that meet in a group and weren't compared completely."""
    labelled = groups.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("node").alias("head")).filter("least < most")
    members = stored(labelled.join(mixed, "sig").select("node", "component", "head"), "mixed")
    cluster = components(members.select("node", "head"), "node", "head").select("node", F.col("component").alias("cluster"))
    named = members.select("node", "component").distinct().join(cluster, "node").join(sets, "node").withColumn("n", F.size("shingles"))
    # blocks of a cluster: bands of sizes, in which hashes deal the sets by the band's total; similar sets are in one band or in neighbouring ones
    banded = named.withColumn("band", F.floor(F.log("n") / float(np.log(100 / similarity_pct)) + 1e-9).cast("int"))
    many = banded.groupBy("cluster", "band").agg(F.ceil(F.sum("n") / block).alias("many"))
    placed = banded.join(many, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("many")))
    blocks = stored(placed.groupBy("cluster", "band", "block").agg(F.collect_list(F.struct("node", "component", "shingles")).alias("sets"), F.min("component").alias("least"), F.max("component").alias("most")), "blocks")
    one, two = (blocks.select("cluster", *(F.col(c).alias(f"{c}{k}") for c in ("band", "block", "sets", "least", "most"))) for k in (1, 2))
    able = ((F.col("band1") < F.col("band2")) | (F.col("block1") <= F.col("block2"))) & ~((F.col("least1") == F.col("most2")) & (F.col("most1") == F.col("least2")))
    pairs = one.withColumn("band2", F.explode(F.array(F.col("band1"), F.col("band1") + 1))).join(two, ["cluster", "band2"]).filter(able).select("sets1", "sets2")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                parts = []
                for k in (0, 1):
                    x = batch.column(k).slice(r, 1).flatten()
                    parts.append((x.flatten()[0].to_numpy(), x.flatten()[1].to_numpy(), x.flatten()[2].value_lengths().to_numpy().astype(np.int64), x.flatten()[2].flatten().to_numpy()))
                a, b = block_links(*(list(p) for p in zip(*parts, strict=True)), similarity_pct)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return pairs.mapInArrow(run, "a long, b long").filter("a <> b")


def linked_nodes(docs: DataFrame, keyed: DataFrame, similarity_pct: int, key: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Components over nodes, and the links that were verified. keyed: shingle_sets of docs."""
    spark = docs.sparkSession
    chosen = stored(possible_nodes(keyed, key), "chosen")
    sets, all_sets = store(whole_sets(docs, chosen, key, text, size), "sets")
    groups, all_groups = store(candidate_groups(signatures(sets, similarity_pct)), "groups")
    pairs, seeds = store(seed_pairs(groups), "pairs")
    links = stored(verified(pairs, sets, similarity_pct), "verified")
    drop_path(spark, seeds)
    found = components(links)
    more = stored(cluster_links(groups, found, sets, similarity_pct), "verified")
    drop_path(spark, all_sets)
    drop_path(spark, all_groups)
    if more.isEmpty():
        return found, links
    links = links.unionByName(more)
    return components(links), links


def jaccard_components(docs: DataFrame, similarity_pct: int = 80, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """key, n_shingles, node, component_id (smallest key reachable by links, itself included)."""
    keyed = stored(shingle_sets(docs, key, text, size, similarity_pct), "keyed")
    found, _ = linked_nodes(docs, keyed.filter(F.col(key).isNotNull()), similarity_pct, key, text, size)
    named = keyed.drop("bands").join(found, "node", "left").withColumn("component", F.when((F.col("n_shingles") > 0) & F.col(key).isNotNull(), F.coalesce("component", "node")))
    # the smallest key of a component is found before the rows are joined again, with partial sums: a component may hold most rows
    smallest = named.filter("component is not null").groupBy("component").agg(F.min(key).alias("component_id"))
    out = named.filter("component is not null").join(smallest, "component").select(key, "n_shingles", "node", "component_id")
    rest = named.filter("component is null").select(key, "n_shingles", "node", F.col(key).alias("component_id"))
    return out.unionByName(rest)


#: The query over documents in DuckDB, by all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM reach r JOIN links l ON r.other IN (l.a, l.b))
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
