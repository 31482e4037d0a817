"""The training-data operators and the stages of the pipeline on awkward rows, and against slow versions of what they say."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("pagemill.llm")

from pyspark.sql import functions as F  # noqa: E402

from pagemill.llm import common, decontamination, line_templates, ngram_join, ordinal_quality, passages, suffix_dedup, toxicity  # noqa: E402

WORDS = np.array([f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "so", "na", "pe") for b in ("ba", "di", "fo", "gu", "he", "ji", "ko", "lu")])


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


# ---------------------------------------------------------------- decontamination


def tokens_of(text):
    out, last = [], 0
    for m in re.finditer(r"(?:(?<=\d)[.,](?=\d)|[0-9A-Za-z\u0080-\U0010ffff])+", text or ""):
        t = m[0]
        begins = not out or re.search(r"[\n\r!.:?]", text[last : m.start()])
        if t[0].isdigit() and t[0].isascii():
            kind = "number"
        elif re.match(r"[A-Z][^A-Z0-9]", t) and not begins:
            kind = "name"
        elif out and out[-1][0] == "number" and t.lower() in decontamination.UNITS:
            kind = "unit"
        else:
            kind = "word"
        out.append((kind, t.lower()))
        last = m.end()
    return out


def windows_of(tokens, length, literal):
    for i in range(len(tokens) - length + 1):
        w = tokens[i : i + length]
        if literal or sum(k == "word" for k, _ in w) >= (3 if length >= 5 else 1):
            yield i, (literal, tuple(v if literal or k == "word" else k for k, v in w)), w


def contaminated_by_force(docs, items):
    found = set()
    for name, text in items:
        ts = tokens_of(text)
        size = min(5, len(ts))
        mine = list(windows_of(ts, size, False)) or list(windows_of(ts, size, True)) if size else []
        literal = bool(mine) and mine[0][1][0]
        where = defaultdict(list)
        for q, h, w in mine:
            where[h].append((q, w))
        for key, doc in docs:
            hits = [(p, h, w, q, v) for p, h, w in windows_of(tokens_of(doc), size, literal) for q, v in where.get(h, ())] if size else []
            for stretch in {s for p, *_ in hits for s in (p // len(ts), p // len(ts) - 1)}:
                some = [x for x in hits if x[0] // len(ts) in (stretch, stretch + 1)]
                if len({h for _, h, *_ in some}) < 0.8 * len(where):
                    continue
                pairs = {(p - q, k, b, a) for p, _, w, q, v in some for (k, b), (_, a) in zip(v, w, strict=True) if k != "word"}
                forth, back = Counter((s, k, b) for s, k, b, _ in pairs), Counter((s, k, a) for s, k, _, a in pairs)
                each = [n == 1 and all(back[s, k, a] == 1 for s2, k2, b2, a in pairs if (s2, k2, b2) == (s, k, b)) for (s, k, b), n in forth.items()]
                if not each or sum(each) >= 0.8 * len(each) - 1e-9:
                    found.add((key, name))
    return found


def test_decontamination_against_force(spark):
    rng = np.random.default_rng(1)
    items, docs = [], []
    for k in range(25):
        n = int(rng.integers(3, 30))
        shape = [rng.choice(["word", "number", "name"], p=[0.7, 0.15, 0.15]) for _ in range(n)]
        item = [str(rng.integers(2, 99)) if s == "number" else str(rng.choice(WORDS)).title() if s == "name" else str(rng.choice(WORDS)) for s in shape]
        items.append((k, " ".join(item) + "."))
        for change in range(5):
            new = list(item)
            values = {}
            for i, s in enumerate(shape):
                if s != "word" and change >= 1:
                    new[i] = values.setdefault(item[i], str(rng.integers(2, 99)) if s == "number" else str(rng.choice(WORDS)).title())
                if (change == 2 and rng.random() < 0.1) or (change == 3 and s != "word" and rng.random() < 0.6):
                    new[i] = str(rng.integers(100, 999)) if s == "number" else str(rng.choice(WORDS))
            if change == 4:
                new = new[: n // 2] + prose(k, 40).split() + new[n // 2 :]
            docs.append((len(docs), prose(1000 + len(docs), 15) + " " + " ".join(new) + ". " + prose(2000 + len(docs), 15)))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "é 1,000.5 " * 30)]
    want = contaminated_by_force(docs, items)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"hash": F.lit(1), "row": F.lit("x"), "values": F.lit(2), "item": F.lit(3)})
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 40 and got == want


def test_decontamination_of_repeated_rows_null_keys_and_long_texts(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = [(1, "so " + item), (1, "so " + item), (None, item + " yes"), (2, prose(3, 30000) + " " + item + " " + prose(4, 3000)), (3, " ".join(prose(k, 40) + " " + " ".join(item.split()[k : k + 5]) for k in range(8)))]
    got = sorted((r.doc_id or 0, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect())
    assert got == [(0, 7), (1, 7), (2, 7)]  # windows spread over the whole of a text don't count together


# ---------------------------------------------------------------- line templates


def test_line_templates_drop_notices_and_keep_near_copies(spark):
    notice = "all rights to this text are kept by whoever wrote it first\n\nplease ask before you print it anywhere at all"
    rows = [(k, "\n".join([prose(10 * k + j, 9) for j in range(9)][: 3 + k % 7]) + "\n\n" + notice + "\n\n" + prose(10 * k + 900, 9), "a", k) for k in range(6)]
    body = [prose(5000 + j, 9) for j in range(20)]
    for k in range(12):  # near copies of one text
        changed = list(body)
        changed[k] = prose(6000 + k, 9)
        rows.append((100 + k, "\n".join(changed), "a", k))
    rows += [(200, "word " * 20000 + "end", "a", 0), (None, prose(1, 9) + "\n" + notice, "a", 1), rows[2], (201, "\n\n", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n_dropped long").withColumns({"_row": F.lit(5), "gone": F.lit(6), "plain": F.lit(7), "key": F.lit(8)})
    got = line_templates.drop_lines(docs).collect()
    assert len(got) == len(rows) and all((r.row, r._row, r.gone, r.plain, r.key) == ("a", 5, 6, 7, 8) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[k].n_dropped == 0 for k in range(100, 112)) and by[200].n_dropped == 0 and by[201].text == "\n\n"
    assert sum(r.n_dropped == 2 for r in got if r.doc_id in (0, 1, 2, 3, 4, 5)) >= 6 and by[None].n_dropped == 0
    assert all("rights" not in by[k].text and prose(10 * k + 900, 9) in by[k].text for k in range(6))


# ---------------------------------------------------------------- quality


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = Counter()
    for k, w in enumerate(words):
        for lag in (1, 2, 3):
            if k >= lag and words[k - lag] == w:
                out["lag", lag] += 1 / len(words)
    out["distinct"] = len(set(words)) / len(words) if words else 0.0
    out["length"] = np.log1p(len(words)) / 10
    out["none"] = float(not words)
    return out


def test_quality_features_against_force():
    texts = [prose(k, 30) + " " + prose(k, 2) + " x x x" for k in range(20)] + [None, "", " \n", "one", "é é"]
    text, slot, value = ordinal_quality.features([t.encode() if t is not None else None for t in texts])
    base = 1 << ordinal_quality.LOG2_SHAPES
    for k, t in enumerate(texts):
        want = plain_features(t)
        got = Counter()
        for s, v in zip(slot[text == k], value[text == k], strict=True):
            got[int(s)] += v
        names = {base: ("lag", 1), base + 1: ("lag", 2), base + 2: ("lag", 3), base + 3: "distinct", base + 4: "length", base + 5: "none"}
        assert all(abs(got[s] - want[n]) < 1e-9 for s, n in names.items())
        assert abs(sum(v for s, v in got.items() if s < base) - (want["none"] == 0)) < 1e-9


def test_quality_fit_has_no_slope_left():
    rng = np.random.default_rng(0)
    n, d = 300, 6
    x = rng.normal(size=(n, d))
    grade = np.digitize(x @ rng.normal(size=d) + rng.logistic(size=n), [-1, 1])
    model = ordinal_quality.fit(np.repeat(np.arange(n), d), np.tile(np.arange(d), n), x.ravel(), grade, steps=3000, rate=0.02, decay=0.0)

    def loss(w, cut):
        edges = np.concatenate([[-np.inf], cut, [np.inf]])
        below = 1 / (1 + np.exp(-(edges[None, :] - (x @ w)[:, None])))
        return -np.log(below[np.arange(n), grade + 1] - below[np.arange(n), grade]).mean()

    w, cut = model.weights[:d], model.thresholds
    here = loss(w, cut)
    for k in range(d + 2):
        for step in (-0.02, 0.02):
            moved = loss(w + step * np.eye(d + 2)[k][:d], cut + step * np.eye(d + 2)[k][d:])
            assert moved >= here - 1e-5


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2
    model = ordinal_quality.train(docs, labels.filter(~odd))
    got = ordinal_quality.score(docs, model).join(labels.filter(odd), "doc_id").select("quality", "keep").collect()
    assert sum(bool(r.quality) == r.keep for r in got) >= 0.9 * len(got)


def test_quality_of_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, prose(1, 20)), (1, prose(1, 20)), (None, None), (2, prose(2, 30000))], "doc_id long, text string").withColumns({"rated": F.lit(1), "_rated": F.lit(2), "keep": F.lit("old"), "tail_prob": F.lit("old")})
    labels = spark.createDataFrame([(1, 0), (2, 1), (1, None), (None, 1)], "doc_id long, quality int")
    out = ordinal_quality.score(docs, ordinal_quality.train(docs, labels)).collect()
    assert len(out) == 4 and all((r.rated, r._rated) == (1, 2) and isinstance(r.keep, bool) and 0 <= r.tail_prob <= 1 for r in out)


# ---------------------------------------------------------------- toxicity


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    hit, wrong = np.array([0.7, 0.5, 0.6, 0.4]), np.array([0.02, 0.05, 0.01, 0.1])
    votes = rng.random((4000, 4)) < np.where(y[:, None], hit, wrong)
    copies = np.concatenate([votes, votes[:, 3:], votes[:, 3:]], 1)  # the worst voter three times
    copies = np.concatenate([copies, ~copies.any(1, keepdims=True)], 1)  # and one for the other class
    post, weight = toxicity.label_model(copies, np.array([1] * 6 + [0]), 0.2)
    best = np.where(votes, np.log(hit / wrong), np.log((1 - hit) / (1 - wrong))).sum(1) + np.log(0.2 / 0.8) >= 0
    assert ((post >= 0.5) == y).mean() >= (best == y).mean() - 0.03 and weight[3:6].max() < 0.8 * weight[:3].min()


def test_plain_words():
    assert toxicity.plain_words("You 1d10t! so stuuupid $tuff fine 2024") == "idiot stupid stuff oa"
    assert toxicity.manners("STOP THIS RIGHT now!!") == (True, True) and toxicity.manners("OK A B C") == (False, False)


def test_toxicity_of_awkward_rows(spark):
    bad = [(k, prose(k, 20) + " vile scum " + prose(k + 50, 20), 1) for k in range(60)]
    good = [(100 + k, prose(k + 300, 40), 0) for k in range(140)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in bad + good], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in bad + good] + [(5, None), (None, 1)], "doc_id long, toxic int")
    held = toxicity.held_out_rows()
    model = toxicity.train(docs, labels, held)
    odd = [(900, "vile scum " + prose(7, 30000)), (901, prose(8, 30)), (901, prose(8, 30)), (None, None), (902, "")]
    rows = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"score": F.lit("old"), "predicted": F.lit("old"), "label": F.lit(3)})
    out = toxicity.score(rows, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.label == 3 for r in out)
    assert [r.predicted for r in out if r.doc_id == 901] == [0, 0]
    checked = toxicity.score(docs, model).join(labels, "doc_id").filter(held).collect()
    assert sum(r.predicted == r.toxic for r in checked) >= 0.95 * len(checked)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs, labels.filter("toxic = 1"), held).scores(["a"])[0] > 0.9


# ---------------------------------------------------------------- passages


def test_passages_of_null_keys_repeated_rows_and_ties(spark):
    text = prose(1, 0) + " ".join(f"w{x}" for x in np.random.default_rng(2).integers(0, 1 << 40, 80))
    rows = [(3, text), (3, text), (None, text), (5, text), (4, "start " + text), (6, None), (7, ""), (8, "few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "f": F.lit(2), "begin": F.lit(3)})
    got = {(r.doc_id, r.begin, r.end, r.other) for r in passages.near_duplicate_passages(docs).collect()}
    assert got == {(5, 0, 80, 3), (4, 1, 81, 3)}


# ---------------------------------------------------------------- stages


@pytest.fixture(scope="module")
def corpus_pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages_of_awkward_rows(spark, corpus_pipeline, tmp_path):
    """Each stage on nulls, empty texts, repeated rows, null keys, a long text and columns named as the operators' own."""
    item = "how many apples are left when three of the boys have eaten half of them each"
    base = prose(50, 60)
    rows = [(1, base), (1, base), (2, base + " more"), (None, base), (None, "so " + item), (3, "well " + item), (4, None), (5, ""), (6, prose(51, 20000)), (7, prose(52, 40))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], schema).withColumns({c: F.lit("own") for c in ("keep", "score", "key", "row", "n_lines", "hash", "node", "doc", "component_id")})
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (6, 1), (7, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "line_dedup", "near_duplicates", "decontaminate"):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and all(r.keep == r.node == r.doc == "own" for r in out.collect())
        assert stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = sorted((r.doc_id or 0, r.text or "") for r in stages["near_duplicates"](spark, docs, str(tmp_path)).collect())
    assert [k for k, _ in kept] == [0, 0, 1, 3, 4, 5, 6, 7]
    left = [(r.doc_id, r.text) for r in stages["decontaminate"](spark, docs, str(tmp_path)).collect()]
    assert sorted(k for k, _ in left if k is not None) == [1, 1, 2, 4, 5, 6, 7] and not any(k is None for k, _ in left)
    same = stages["line_dedup"](spark, docs, str(tmp_path)).collect()
    assert len(same) == len(rows) and all(r.n_chars == len(r.text) for r in same if r.text is not None)
    pieces = stages["pack"](spark, docs, str(tmp_path))
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n < 1024").count() <= 1
    assert stages["pack"](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_quality_stage_keeps_what_the_model_says(spark, corpus_pipeline):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = ordinal_quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    tail = {r.doc_id: float(model.tail(model.scores([(r.text or "").encode()]))[0, -1]) for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()} == {k for k, p in tail.items() if p >= 0.5}


def test_passages_meet_every_partner(spark):
    """b is like a and like c, which are less alike: that b was verified with a doesn't take it away from c."""
    rng = np.random.default_rng(7)

    def words(n):
        return ["".join(map(chr, 97 + rng.integers(0, 16, 7))) for _ in range(n)]

    docs = []
    for g in range(40):
        passage = words(60)
        for j, edit in ((0, 20), (1, None), (2, 40)):
            own = [w if k != edit else words(1)[0] for k, w in enumerate(passage)]
            docs.append((3 * g + j, " ".join(words(40) + own + words(40))))
    got = {(r.other, r.doc_id) for r in passages.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert not any((3 * g, 3 * g + 2) in got for g in range(40))
    for a, b in ((0, 1), (1, 2)):
        assert sum((3 * g + a, 3 * g + b) in got for g in range(40)) >= 39


@pytest.mark.parametrize(("name", "dtype"), [("word_bpe_49k.json", "<u2"), ("byte_bpe_50k.json", "<u4")])
def test_chunks_are_made_of_words(name, dtype, monkeypatch):
    """Words of Latin letters, also beside marks and line breaks, need no text of their own; ids are those of the plain call."""
    from pagemill.llm.tokens import ChunkEncoder, public_tokenizer

    encode = ChunkEncoder(public_tokenizer(name), dtype)
    slow = []
    monkeypatch.setattr(encode, "_encode_chunks", lambda chunks, f=encode._encode_chunks: slow.extend(chunks) or f(chunks))
    plain = ["one two, three!!\nFour été.\nÉcole Straße&&& five"]
    odd = ["a\n\nb", "a\r\nb c.\r\n d", "x \ny's don't 'x' İx é.́ 日本.\n日 12.\n3 a.'s\nb\t\nc", " lead x_y.\n", "\nstart of.\n\tit"]
    got = encode.batch(plain)
    assert not slow
    want = [np.array(x.ids, dtype).tobytes() for x in encode.tokenizer.encode_batch_fast(plain + odd, add_special_tokens=False)]
    assert got + encode.batch(odd) == want


# ---------------------------------------------------------------- disk


def test_stored_tables_leave_no_shuffle_files(spark):
    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}

    before = shuffled()
    table = common.stored(spark.range(50_000).groupBy((F.col("id") % 9000).alias("k")).count().repartition(7, "k"))
    assert table.count() == 9000
    grown = spark.range(100).repartition(3).groupBy("id").count()
    assert not {p for p in shuffled() - before if p.stat().st_size > 10_000}
    assert grown.count() == grown.count() == 100


def test_bitmap_grows_with_its_hashes(spark):
    """6 million hashes had 2 of 64 million bits each, which let 3 in 100 others pass."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    hashes = np.arange(12_000_000, dtype=np.int64)
    marks = suffix_dedup._bits_of(spark.range(6_000_000).select(F.col("id").alias("h")))
    hit = suffix_dedup._passes(marks, hashes.view(np.uint64))
    assert hit[:6_000_000].all() and hit[6_000_000:].mean() < 0.015


def test_touching_intervals_are_one(spark):
    rows = [(1, 5, 0, 3), (1, 5, 4, 9), (1, 5, 20, 30), (1, 5, 22, 25), (1, 6, 4, 4), (2, 5, 7, 8)]
    got = {(r.key, r.row): (r.begins, r.ends) for r in suffix_dedup._merged(spark.createDataFrame(rows, "key long, row long, from long, to long")).collect()}
    assert got == {(1, 5): ([0, 20], [9, 30]), (1, 6): ([4], [4]), (2, 5): ([7], [8])}


def test_ngram_join_leaves_what_its_result_reads(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    text = prose(1, 200)
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, prose(2, 30))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert not {p.name.split("-")[0] for p in set(folder.iterdir()) - before} & {"sets", "groups", "pairs"}


def test_passages_name_classes_without_all_pairs(spark):
    """40 near copies of a text are a class of 40, not 780 pairs; the unlike text that holds half of it is none of them."""
    text = prose(3, 0).split() + [f"w{x}" for x in np.random.default_rng(4).integers(0, 1 << 40, 120)]
    docs = [(k, " ".join([w if i != 3 * k else f"n{k}" for i, w in enumerate(text)])) for k in range(40)] + [(99, " ".join(text[:30]) + " " + prose(5, 90))]
    got = passages.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} | {r.other for r in got} == set(range(40)) and {r.class_id for r in got} == {0}
    assert len({(r.doc_id, r.other) for r in got}) < 400


def test_passages_of_folded_texts_have_the_same_shingles():
    """What periods leave out takes no set of a passage's shingles away, and a folded text's passage names words of the whole one that have its set."""
    rng, span, folded = np.random.default_rng(11), 6, 0
    for _ in range(400):
        parts = []
        for _ in range(rng.integers(1, 5)):
            period = rng.integers(0, rng.choice([3, 1000]), rng.integers(1, 12)).tolist()
            parts += (period * 60)[: rng.integers(1, 60)]
        x = np.array(parts, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h, n, _, seams = passages._folded(x, np.array([len(x)]), np.array([0]), span)
        assert n.tolist() == [len(h)] and (len(h) < len(x)) == bool(seams)
        if seams:
            folded += 1
            got = [{(frozenset(y[i:j].tolist()), i, j) for i in range(len(y)) for j in range(i + span, len(y) + 1)} for y in (x, h)]
            assert {s for s, *_ in got[0]} == {s for s, *_ in got[1]}
            for s, i, j in got[1]:
                a, b = passages._unfolded(i, j, seams[0])
                assert 0 <= a and b <= len(x) and s == set(x[a:b].tolist())
    assert folded > 50


def test_passages_of_repeated_words_and_blocks(spark):
    """Texts that repeat a word or a block thousands of times have a few windows, and are found in full."""
    block = " ".join(f"b{x}" for x in np.random.default_rng(12).integers(0, 1 << 40, 39))
    docs = [(1, "again " * 6000), (2, prose(21, 60) + " again" * 3000), (3, f"{block} " * 200), (4, f"{prose(22, 60)} {block} {block} {block}"), (5, "once " * 60)]
    text, *_, before, after = passages.compact_windows([t.encode() for _, t in docs], 50, 5, 5)
    assert len(text) < 6000
    got = {(r.doc_id, r.other): r for r in passages.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {(2, 1), (4, 3)}
    assert got[2, 1].end == len(docs[1][1].split()) and got[2, 1].end - got[2, 1].begin >= 3000 and (got[2, 1].other_begin, got[2, 1].other_end) == (0, 6000)
    assert got[4, 3].end - got[4, 3].begin >= 117 and got[4, 3].similarity >= 0.8


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_of_words_and_marks(name, monkeypatch):
    """ids are those of the plain call; words of letters aren't taken apart, and no collection runs over the strings."""
    import gc

    from pagemill.llm import tokens

    encode = tokens.ChunkEncoder(tokens.public_tokenizer(name))
    odd = ["a, b. c! é, ü. ñ'! ’x a' 'a A, ,a a,, \nA, x\ny. Ā, ɏ, ɐ, 漢, a漢, 1, a1, \x01a, a\x01,", None, "", ", . a", "İ, ǅ, ª, º.", "don't, stop! I'll, we're. x'"]
    assert encode.batch(odd) == [encode._encode([x])[0] if x else b"" for x in odd]
    many = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17000))]
    taken = []
    pieces = tokens.ChunkEncoder._pieces
    monkeypatch.setattr(tokens.ChunkEncoder, "_pieces", staticmethod(lambda c: taken.append(c) or pieces(c)))
    before = [x["collections"] for x in gc.get_stats()]
    got = encode.batch(many)
    assert [x["collections"] for x in gc.get_stats()] == before and gc.isenabled() and not taken
    assert got == encode._encode(many)
