"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("pagemill.llm")

from pyspark.sql import functions as F  # noqa: E402

from pagemill.llm import decontamination, line_templates, ngram_join, ordinal_quality, packing, passages, suffix_array, suffix_dedup, token_records, topk_search, toxicity  # noqa: E402
from pagemill.llm.tokens import ChunkEncoder, public_tokenizer  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, key string"
WORD, BYTE = public_tokenizer("word_bpe_49k.json"), public_tokenizer("byte_bpe_50k.json")


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 300)
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (40, 150, 260)]
    passage = " ".join(prose(2, 70))
    rows = [" ".join(base), " ".join(base), *near, "Intro " + passage + " outro", " ".join(prose(3, 90)) + " " + passage, None, "", "  \n ", "ab" * 400, "one two", "one two", "x", " ".join(prose(4, 12000)), "é\x85 ü　\n\n漢字 <|endoftext|>"]
    table = [(k, t, "en", "s", len(t or ""), 0.0, 1, "k") for k, t in enumerate(rows)]
    return spark.createDataFrame([*table, table[3], (None, "null key", "en", "s", 8, 0.0, 1, "k")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def ids_of(path, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    return [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunked_ids_are_the_tokenizers():
    rng = np.random.default_rng(0)
    parts = ["a", "B.", "don't", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "́", "ΑΣ", "12", ",", "<|endoftext|>", "<|EndOfText|>", "<|", "漢", "\x01", "　"]
    for path, dtype in ((WORD, "<u2"), (BYTE, "<u4")):
        texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(400)]
        encode = ChunkEncoder(path, dtype, cache_entries=60)
        texts += ["hi <|endoftext|> there", "<|startoftext|>a"]
        assert [np.frombuffer(x, dtype).tolist() for x in [*encode.batch(texts[:200]), *encode.batch(texts[200:])]] == ids_of(path, texts)


def test_checksums_and_framing():
    assert hex(int(token_records.Crc32c()([b"123456789"])[0])) == "0xe3069283"
    parts = [bytes(range(n % 256)) * (n // 40 + 1) for n in (0, 1, 3, 4, 5, 511, 512, 513, 3000)]
    framed = token_records.frame(parts)
    assert token_records.unframe(framed) == parts
    with pytest.raises(ValueError, match="checksum"):
        token_records.unframe([framed[5][:14] + b"?" + framed[5][15:]])


def test_records_round_trip(spark, docs, empty):
    got = token_records.encode_documents(spark, docs, WORD).orderBy("start").collect()
    want = [r for r in docs.collect()]
    assert [r.key for r in got] == sorted((r.doc_id for r in want), key=lambda k: -1 if k is None else k)
    at = 0
    texts = {r.doc_id: r.text for r in want}
    for r in got:
        x = [*ids(WORD, texts[r.key]), 1]
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert token_records.encode_documents(spark, empty, WORD).count() == 0


def test_packing_has_no_gaps(docs, empty):
    pieces = packing.pack(docs, BYTE, 64)
    got = pieces.orderBy("sequence_id", "offset").collect()
    at, streams = 0, {}
    for r in got:
        assert (r.sequence_id, r.offset) == divmod(at, 64) and len(r.ids) == 4 * r.length and r.length + r.offset <= 64
        at += r.length
        streams.setdefault(r.doc_id, []).append(r)
    for r in docs.dropDuplicates(["doc_id"]).collect():
        x = np.array([*ids(BYTE, r.text), 0], "<u4").tobytes()
        mine = sorted(streams[r.doc_id], key=lambda p: p.start)
        copies = 2 if r.doc_id == 3 else 1
        assert sum(p.length for p in mine) * 4 == copies * len(x)
        if copies == 1:
            assert b"".join(p.ids for p in mine) == x
    whole = packing.sequences(pieces, 64)
    assert whole.agg(F.sum("n_tokens")).first()[0] == at and whole.filter("n_tokens < 64").count() <= 1
    assert packing.pack(empty, BYTE).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_by_force(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            i, j = sorted((find(a), find(b)))
            root[j] = i
    return {k: find(k) for k in sets}


def test_ngram_join_is_exact(spark, docs, empty):
    sets = {r.doc_id: shingles(r.text) for r in docs.collect() if r.doc_id is not None}
    want = components_by_force(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got.pop(None) == (1, None)
    assert got == {k: (len(sets[k]), want[k]) for k in sets}
    assert ngram_join.jaccard_components(empty).count() == 0


def test_ngram_join_resolves_a_group_of_uneven_copies(spark):
    base = prose(9, 150)
    rows = []
    for k in range(60):
        rng = np.random.default_rng(k)
        words = list(base)
        for x in rng.choice(150, rng.integers(0, 16), replace=False):
            words[x] = f"n{k}x{x}"
        rows.append((k, " ".join(words)))
    sets = {k: shingles(t) for k, t in rows}
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_force(sets)


def test_ngram_join_links_across_the_borders_of_the_sieve(spark):
    rows = []
    for small, large in ((51, 63), (52, 64), (52, 65), (60, 70), (63, 64), (63, 78), (64, 80), (300, 319), (319, 320), (310, 380), (400, 500), (499, 500), (480, 560)):
        for seed in range(3):
            words = prose(1000 * seed + large + small, large + 4, 1 << 40)
            rows += [" ".join(words[: small + 4]), " ".join(words)]
    sets = {k: shingles(t) for k, t in enumerate(rows)}
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == components_by_force(sets) == {k: k - k % 2 for k in sets}


def test_ngram_join_links_small_sets_with_empty_parts(spark):
    # all four shingles of the first text lie in one of three parts, the fifth of the second in another
    words = prose(74, 9, 1 << 40)
    docs = spark.createDataFrame([(0, " ".join(words[:-1])), (1, " ".join(words))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {0: 0, 1: 0}


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(1, rng.choice([2, 3, 6]), rng.integers(0, 50))
        assert suffix_array.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("n", [31, 32, 33])
def test_suffix_array_sorted_by_the_cluster(spark, n):
    s = np.random.default_rng(n).integers(1, 3, n)
    text = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(s)], "pos long, sym long")
    got = [r.pos for r in suffix_array.ranks(text, n, small=20).orderBy("rank").collect()]
    assert got == suffix_array.suffix_array(s).tolist()


def without_repeats(rows, length=100):
    """By force: what is left of the texts of distinct keys, in order."""
    seen, out = set(), {}
    for k in sorted(rows, key=lambda k: -1 if k is None else k):
        x = rows[k]
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if x[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(x[p : p + length])
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out[k] = (len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def left(docs, **how):
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in suffix_dedup.cut(docs, **how).collect()]


def test_suffix_dedup_is_exact(docs, empty):
    want = without_repeats({r.doc_id: (r.text or "").encode() for r in docs.collect()})
    got = left(docs)
    assert len(got) == 18 and dict(got) == want
    assert suffix_dedup.cut(empty).count() == 0


@pytest.mark.parametrize("task_bytes", [1 << 20, 300])
def test_suffix_dedup_of_contexts_that_overlap_in_part(spark, task_bytes):
    # a common line among unlike words, cut off at either side, three times in one text, and in rows that stand twice
    line = " ".join(prose(50, 40))
    texts = [" ".join(prose(60 + k, 12)) + " " + line[k % 7 : len(line) - k % 5] + " " + " ".join(prose(90 + k, 12)) for k in range(14)] + [line * 3, "é" * 130, "é" * 90 + "x" + "é" * 60]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3], rows[14]], "doc_id long, text string")
    got = left(docs, task_bytes=task_bytes, small=100)
    assert len(got) == 20 and dict(got) == without_repeats({k: t.encode() for k, t in rows})


def test_suffix_dedup_cuts_long_texts_into_pieces(monkeypatch):
    from pagemill.llm import common

    text = " ".join(prose(5, 900)).encode()
    whole = suffix_dedup.anchors([b"x" * 300, text], 100)
    monkeypatch.setattr(suffix_dedup, "in_pieces", lambda texts, overlap: common.in_pieces(texts, overlap, 700))
    cut = suffix_dedup.anchors([b"x" * 300, text], 100)
    each = [{(t, w): (h, at) for t, lo, hi, h, at, _ in zip(*(x.tolist() for x in found), strict=True) for w in range(lo, hi + 1)} for found in (whole, cut)]
    assert each[0] == each[1]


def test_topk_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=8)], k % 3) for k in range(300)]
    bad = [(900, None, 0), (901, [1.0, None] * 4, 0), (902, [float("nan")] * 8, 0), (903, [float("inf")] * 8, 0), (904, [], 0), (None, [1.0] * 8, 0), rows[7], (950, [2.0, 1.0], 1)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, label int")
    x = np.floor(256 * np.array([r[1] for r in rows]))
    want = set()
    for q in range(0, 300, 50):
        s = x @ x[q]
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != q][:5]
        want |= {(q, r + 1, int(j), float(s[j])) for r, j in enumerate(order)}
    extra = df.withColumns({"id": F.lit(7), "rank": F.lit("x"), "score": F.lit(0), "v": F.lit(1)})
    for rows_, how in ((df, {}), (extra, {"queries": 2, "block": 64, "first": 2})):
        assert {tuple(r) for r in topk_search.topk(rows_, F.col("id") % 50 == 0, **how).collect()} == want
    assert topk_search.topk(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_topk_with_ties_and_many_queries(spark):
    x = np.random.default_rng(6).integers(-2, 3, (1500, 4)) / 256
    df = spark.createDataFrame([(k, row) for k, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.topk(df, F.col("id") % 1 == 0, queries=400, block=200).collect()}
    s = np.floor(256 * x) @ np.floor(256 * x).T
    np.fill_diagonal(s, -np.inf)
    for q in range(1500):
        best = np.lexsort((np.arange(1500), -s[q]))[:5]
        assert [got[q, r + 1] for r in range(5)] == [(int(j), float(s[q, j])) for j in best]


def test_decontamination_finds_changed_parameters(spark, empty):
    items = spark.createDataFrame([(1, "So Maria has 12 apples and gives 5 kg of them to Peter in the old market. How many apples does Maria have left after 3 days?"), (2, None), (3, "")], "item_id long, text string")
    texts = ["Well. So Anna has 40 apples and gives 7 miles of them to Karl in the old market. How many apples does Anna have left after 9 weeks? Bye.", "So Anna has 40 apples and gives 7 kg of them to Karl in the old market. How many apples does Otto have left after 9 days?", None, "", " ".join(prose(8, 200))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items, consistency=1.0).collect()] == [(0, 1)]
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_finds_short_items_and_items_without_words(spark):
    items = ["3 + 5 equals what", "photosynthesis", "12", "1 2 3 4 5 6 7 8", "Rome Paris 14 Berlin Madrid 15 London Oslo 16", "", "how many apples are left over"]
    texts = ["Well, 9 + 1 equals what in all?", "It is called photosynthesis by most.", "Take 12 of them.", "so: 1, 2, 3, 4, 5, 6, 7, 8 and on", "from Rome Paris 14 Berlin Madrid 15 London Oslo 16 on", "3 + 5 equals", "8 7 6 5 4 3 2 1", "3 + 5 equals what", "and how many apples are left over now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 0), (8, 6)]


def test_line_templates(spark, empty):
    body = [" ".join(prose(100 + k, 9)).translate(str.maketrans("0123456789", "abcdefghij")) for k in range(40)]
    rows = [(k, f"{body[k]}\nPage {k} of 40 printed on 2024-01-{k:02d}\n{body[-k - 1]} again\nvisit our site {'abcdefghij'[k % 10]}x{'abcdefghij'[k // 10]} for more offers now", k) for k in range(20)]
    rows += [(50, None, 1), (51, "", 1), (52, "only line", 1)]
    got = {r.doc_id: r for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines long")).collect()}
    assert len(got) == 23 and got[0].n_dropped == 0 and got[50].text is None and got[51].text == "" and got[52].text == "only line"
    assert all(got[k].n_dropped == 2 and got[k].text == f"{body[k]}\n{body[-k - 1]} again" for k in range(1, 20))
    assert line_templates.drop_lines(empty).count() == 0


def test_passages(docs, empty):
    got = passages.near_duplicate_passages(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 6}
    found = next(r for r in got if r.doc_id == 6)
    assert found.other == 5 and found.end - found.begin >= 68 and found.similarity >= 0.8
    assert passages.near_duplicate_passages(empty).count() == 0


def test_passages_with_words_inserted_or_deleted():
    span = 46
    lost = tried = 0
    for seed in range(120):
        n, edit = (60, 70, 80)[seed % 3], ("insert", "delete")[seed // 3 % 2]
        passage = prose(7000 + seed, n, 1 << 40)
        at = n // 2 + seed % 7 - 3
        changed = passage[:at] + (["new"] + passage[at:] if edit == "insert" else passage[at + 1 :])
        texts = [" ".join(prose(8000 + 2 * seed + k, 300, 1 << 40) + p + prose(9000 + 2 * seed + k, 300, 1 << 40)).encode() for k, p in enumerate((passage, changed))]
        one, two = (shingles(" ".join(p)) for p in (passage, changed))
        assert len(one & two) >= 0.8 * len(one | two) and min(len(one), len(two)) >= span
        of, f, low, c, high, before, after = (x.tolist() for x in passages.compact_windows(texts, 50, 5, 5))
        sides = [[(f[i], low[i], c[i], high[i], {before[i], after[i]} - {0}) for i in range(len(of)) if of[i] == k] for k in (0, 1)]
        met = [(*p[:4], *q[1:4]) for p in sides[0] for q in sides[1] if p[0] == q[0] and p[4] & q[4]]
        candidates = [c[1:] for c in passages.join_intervals(np.zeros(len(met), int), np.array(met).reshape(-1, 7), 2, span)]
        if not candidates:
            continue
        tried += 1
        a, b = ((passages._shingles([t], 5)[0] >> np.uint64(32)).astype(np.uint32) for t in texts)
        found = passages.like_passages(a, b, candidates, span, 0.8)
        # by brute force: each one found is similar, and one of them holds the passage but for the words at its ends that the edit leaves out
        for i, j, i2, j2, s in found:
            x, y = set(a[i:j].tolist()), set(b[i2:j2].tolist())
            assert s == len(x & y) / len(x | y) >= 0.8 and min(j - i, j2 - i2) >= span
        lost += not any(i <= 300 and 300 + len(one) <= j and i2 <= 300 and 300 + len(two) <= j2 for i, j, i2, j2, _ in found)
    assert tried >= 110 and lost == 0


def best_passage(x, y, span=46):
    """By force: whether some stretches of span shingles or a little more are similar, along any shift of words."""
    a, b = ([" ".join(t[i : i + 5]) for i in range(len(t) - 4)] for t in (x, y))
    place = {}
    for j, t in enumerate(b):
        place.setdefault(t, []).append(j)
    for shift in {j - i for i, t in enumerate(a) for j in place.get(t, ())}:
        lo, hi = max(0, -shift), min(len(a), len(b) - shift)
        same = np.cumsum([0] + [a[i] == b[i + shift] for i in range(lo, hi)])
        for n in (span, 60, 90):
            if hi - lo >= n and ((same[n:] - same[:-n]) >= 0.9 * n).any():
                return True
    return False


def test_passages_recall_beside_decoys(spark):
    """Families of a passage with substituted words in unlike documents, after documents that hold parts of it: links join what is alike for all pairs."""
    rng = np.random.default_rng(77)
    texts = []
    for family in range(8):
        passage = prose(500 + family, 100, 1 << 40)
        texts += [prose(10000 + 100 * family + k, 40, 1 << 40) + passage[k * 3 : k * 3 + (8, 24, 40)[k % 3]] + prose(20000 + 100 * family + k, 40, 1 << 40) for k in range(30)]
        for k in range(12):
            words = list(passage)
            for x in rng.choice(100, k % 3, replace=False):
                words[x] = f"n{family}x{k}x{x}"
            texts.append(prose(30000 + 100 * family + k, int(rng.integers(10, 120)), 1 << 40) + words[int(rng.integers(0, 20)) :] + prose(40000 + 100 * family + k, int(rng.integers(10, 120)), 1 << 40))
    order = np.concatenate([np.flatnonzero(np.arange(len(texts)) % 42 < 30), np.flatnonzero(np.arange(len(texts)) % 42 >= 30)])
    texts = [texts[k] for k in order]
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if set(texts[i]) & set(texts[j]) and best_passage(texts[i], texts[j])}
    got = passages.near_duplicate_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    root = {k: k for k in range(len(texts))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        a, b = texts[r.doc_id][r.begin : r.end], texts[r.other][r.other_begin : r.other_end]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        assert len(x & y) >= 0.8 * len(x | y) and min(len(a), len(b)) >= 50  # each row is right
        i, j = sorted((find(r.doc_id), find(r.other)))
        root[j] = i
    assert len(want) > 300 and sum(find(i) == find(j) for i, j in want) >= 0.95 * len(want)


def test_quality_orders_three_grades(spark, empty):
    rows, grades = [], []
    for k in range(240):
        words = prose(k, 60)
        g = k % 3
        rows.append((k, " ".join(w + "!!" if g == 0 or (g == 1 and i % 2) else w for i, w in enumerate(words))))
        grades.append((k, g))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, quality int")
    model = ordinal_quality.train(docs, labels.filter("doc_id % 4 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    held = ordinal_quality.score(docs, model).join(labels, "doc_id").filter("doc_id % 4 = 0")
    means = [r.m for r in held.groupBy("quality").agg(F.avg("expected_grade").alias("m")).orderBy("quality").collect()]
    assert means[0] < means[1] - 0.3 and means[1] < means[2] - 0.3
    assert ordinal_quality.train(docs, labels.limit(0)) is None and ordinal_quality.score(empty, None).count() == 0
    odd = ordinal_quality.score(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string"), model).collect()
    assert all(0 <= r.tail_prob <= 1 for r in odd)


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = toxicity.held_out_rows()
    model = toxicity.train(docs, labels, held)
    got = toxicity.score(docs, model).join(labels, "doc_id").filter(held).select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in got) >= 0.9 * len(got)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.train(docs, labels.limit(0), held).scores(["a"])[0] < 0.5


def test_pipeline_small(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
    assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).filter("n <> m").count() == 0
