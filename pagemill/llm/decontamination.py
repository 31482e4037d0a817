"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and digits, in small letters. Numbers, names (a capitalised word inside a sentence) and units (after a number)
become typed placeholders, so a question and its re-parameterised copies have one template. Windows of five template tokens
with at least three words are hashed; windows of documents join those of benchmark items on the hash. A document is
contaminated by an item if a stretch of it, of twice the item's length, has enough of the item's windows, and if the slots of that stretch are
consistent: along an alignment each value of the item's slots stands for one value in the document, and no other value of the item does.
All slots of the windows found count, wherever in a window they stand. Stretches overlap by half, so an item's copy lies whole in one.

Documents are first passed through a bitmap of the benchmark's hashes, whose size is fixed (2 MB): it only saves rows, as what passes is
joined in full.

An item of fewer than five tokens is one window of all its tokens, with at least one word, and documents are cut into windows of its length as well. An
item that has no window with so many words is found by its literal values: its windows hold the values instead of placeholders. Documents
get windows only of the forms (length, literal or not) that the benchmark's items have.

Defined results. Null or empty text: no windows, never contaminated. Repeated rows of a key: each text is looked at by itself, and the key is reported once
for an item, with the best of them. An item without tokens is never found. Empty tables: no rows. A null key is reported like any other.
Extra columns are ignored, whatever their names. A text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, lower_ascii, mix64, small_batches, span_hashes, stored

WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Units of measure, in small letters (fixed values).
UNITS = (
    "mm cm dm m km mg g kg lb lbs oz ml cl l ms s sec min h hr hrs inch inches ft foot feet yard yards mile miles meter meters metre metres kilometer "
    "kilometers kilometre kilometres centimeter centimeters centimetre centimetres gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees"
).split()
_BITS = 24

_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[48:58] = _IN_TOKEN[65:91] = _IN_TOKEN[97:123] = _IN_TOKEN[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 58, 63]] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(span_hashes(data, ends - [len(u) for u in UNITS], ends))


def template_tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, kind, value hash and template hash of each token."""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    limits = np.cumsum([len(t or b"") + 1 for t in texts])
    inside = _IN_TOKEN[data]
    digit = _DIGIT[data]
    mark = np.flatnonzero((data[1:-1] == 46) | (data[1:-1] == 44)) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    inside[mark[digit[mark - 1] & digit[mark + 1]]] = True  # 3.5 and 1,000 are one number
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(limits, starts, side="right")
    n = len(starts)
    if n == 0:
        return owner, np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    value = span_hashes(lower_ascii(data), starts, ends)
    kind = np.zeros(n, np.int8)
    kind[digit[starts]] = NUMBER
    stops = np.concatenate([[0], np.cumsum(_STOP[data] & ~inside)])
    begins = np.ones(n, bool)
    begins[1:] = (stops[starts[1:]] > stops[ends[:-1]]) | (owner[1:] != owner[:-1])
    second = data[np.minimum(starts + 1, len(data) - 1)]
    kind[_UPPER[data[starts]] & ~begins & (ends - starts > 1) & ~_UPPER[second] & ~_DIGIT[second]] = NAME
    after = np.zeros(n, bool)
    after[1:] = (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])
    kind[after & (kind == WORD) & np.isin(value, _unit_hashes())] = UNIT
    template = np.where(kind == WORD, value, mix64(kind.astype(np.uint64) + np.uint64(1 << 60)))
    return owner, kind, value, template


def _windows_of(tokens: tuple[np.ndarray, ...], n_texts: int, length: int, literal: bool, size: int = 5, words: int = 3) -> tuple[np.ndarray, ...]:
    """Text, position, hash and first token's index of each window of a form (length, literal).

    A window of templates has at least `words` words, or one if it is shorter than size; a literal one holds values, whatever they are.
    """
    owner, kind, value, template = tokens
    n = len(owner)
    counts = np.bincount(owner, minlength=n_texts)
    place = np.arange(n) - np.searchsorted(owner, np.arange(n_texts))[owner] if n else np.zeros(0, np.int64)
    start = np.flatnonzero(counts[owner] - place >= length) if n else np.zeros(0, np.int64)
    h = np.full(len(start), np.uint64(literal))
    n_words = np.zeros(len(start), np.int64)
    for k in range(length):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + (value if literal else template)[start + k])
        n_words += kind[start + k] == WORD
    if not literal:
        keep = n_words >= (words if length >= size else 1)
        start, h = start[keep], h[keep]
    return owner[start], place[start], h, start


def _lists(values: np.ndarray, start: np.ndarray, length: int) -> pa.Array:
    """values[start[i] : start[i] + length] as lists."""
    flat = values[start[:, None] + np.arange(length)[None, :]].ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1, dtype=np.int32) * length), pa.array(flat))


def document_windows(rows: DataFrame, bitmap: np.ndarray, forms: list[tuple[int, bool]], size: int = 5) -> DataFrame:
    """key, row, pos, hash, values of the windows of whole texts whose hash is in the bitmap. rows: key, row, text."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = rows.sparkSession
    small_batches(spark)
    key_type = rows.schema["key"].dataType
    arrow = to_arrow_type(key_type)
    shared = spark.sparkContext.broadcast(bitmap)  # 2^_BITS bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            for a, b in in_slices(texts):
                tokens = template_tokens(texts[a:b])
                for length, literal in forms:
                    owner, pos, h, start = _windows_of(tokens, b - a, length, literal, size)
                    slot = h >> np.uint64(64 - _BITS)
                    hit = (marks[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    of = pa.array(owner[hit])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(of).cast(arrow), batch.column(1).slice(a, b - a).take(of), pa.array(pos[hit]), pa.array(h[hit].view(np.int64)), _lists(tokens[2].view(np.int64), start[hit], length)], names=["key", "row", "pos", "hash", "values"])

    return rows.select("key", "row", "text").mapInArrow(run, f"key {key_type.simpleString()}, row long, pos long, hash long, values array<long>")


def item_windows(benchmark: DataFrame, item: str, text: str, size: int = 5) -> DataFrame:
    """item, q, hash, item_values, kinds, n_tokens, length, literal: the windows of items, one form for each."""
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = benchmark.schema[item].dataType
    arrow = to_arrow_type(item_type)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for a, b in in_slices(texts):
                tokens = template_tokens(texts[a:b])
                n_tokens = np.bincount(tokens[0], minlength=b - a)
                done = np.zeros(b - a, bool)
                for literal in (False, True):
                    new = done.copy()
                    for length in range(1, size + 1):
                        owner, q, h, start = _windows_of(tokens, b - a, length, literal, size)
                        mine = (np.minimum(n_tokens, size) == length)[owner] & ~done[owner]
                        owner, q, h, start = owner[mine], q[mine], h[mine], start[mine]
                        new[owner] = True
                        n = len(owner)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(owner)).cast(arrow), pa.array(q), pa.array(h.view(np.int64)), _lists(tokens[2].view(np.int64), start, length), _lists(tokens[1].astype(np.int32), start, length), pa.array(n_tokens[owner]), pa.array(np.full(n, length, np.int32)), pa.array(np.full(n, literal))], names=["item", "q", "hash", "item_values", "kinds", "n_tokens", "length", "literal"])
                    done = new

    return benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"item {item_type.simpleString()}, q long, hash long, item_values array<long>, kinds array<int>, n_tokens long, length int, literal boolean")


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes' first _BITS bits. At most 2^_BITS / 32 words come to the driver, whatever the table's size."""
    slot = F.shiftrightunsigned("hash", 64 - _BITS)
    words = hashes.select(F.shiftright(slot, 5).cast("int").alias("word"), (slot % 32).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << (_BITS - 5), "<u4")
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", containment: float = 0.8, consistency: float = 0.8, size: int = 5) -> DataFrame:
    """key, item, containment, n_slots, consistency: a row for each document and item that it holds."""
    items = stored(item_windows(benchmark, item, text, size), "items")
    # 2 * size forms at most; without an item there is none, and one that finds nothing stands for it
    forms = sorted((r.length, r.literal) for r in items.select("length", "literal").distinct().collect()) or [(size, False)]
    total = items.groupBy("item").agg(F.countDistinct("hash").alias("n"))
    plain = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(plain).alias("row"), plain.alias("text"))
    found = document_windows(rows, bitmap_of(items), forms, size).join(items.drop("length", "literal"), "hash")
    # stretches of twice the item's tokens, which begin at each multiple of them
    stretch = F.floor(F.col("pos") / F.col("n_tokens"))
    found = stored(found.withColumn("stretch", F.explode(F.array(stretch, stretch - 1))), "found")
    place = ["key", "row", "item", "stretch"]
    share = found.groupBy(*place).agg(F.countDistinct("hash").alias("found")).join(total, "item").withColumn("containment", F.col("found") / F.col("n")).filter(F.col("containment") >= containment).select(*place, "containment")

    def same(*columns: str):
        return [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]

    # slots along an alignment: which values of the document stand for a value of the item, and the other way round
    kept = found.alias("a").join(share.alias("b"), same(*place), "left_semi").select("a.*")
    slot = F.transform("kinds", lambda kind, i: F.struct(kind.alias("kind"), F.get("item_values", i).alias("mine"), F.get("values", i).alias("theirs")))
    pairs = kept.select(*place, (F.col("pos") - F.col("q")).alias("shift"), F.inline(F.filter(slot, lambda x: x["kind"] != WORD))).distinct()
    along = [*place, "shift", "kind"]
    forth = pairs.groupBy(*along, "mine").agg(F.count("*").alias("n"), F.min("theirs").alias("theirs"))
    back = pairs.groupBy(*along, "theirs").agg(F.count("*").alias("n"))
    checked = forth.alias("a").join(back.alias("b"), same(*along, "theirs"), "left").select(*(F.col(f"a.{c}") for c in place), ((F.col("a.n") == 1) & (F.col("b.n") == 1)).cast("int").alias("one"))
    fits = checked.groupBy(*place).agg(F.count("*").alias("n_slots"), F.avg("one").alias("consistency"))
    joined = share.alias("a").join(fits.alias("b"), same(*place), "left").select("a.key", "a.item", "a.containment", F.coalesce("b.n_slots", F.lit(0)).alias("n_slots"), F.coalesce("b.consistency", F.lit(1.0)).alias("consistency"))
    best = joined.filter(F.col("consistency") >= consistency).groupBy("key", "item").agg(F.max(F.struct("containment", "consistency", "n_slots")).alias("best"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "best.containment", "best.n_slots", "best.consistency")
