"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades, ordered thresholds between them. x is hashed text: the
share of words of each written shape (runs of capitals, small letters and digits count once, signs as themselves), the shares of words
that repeat one of the three words before, the share of distinct words, and the length. The model is fitted on a bounded sample of
labelled rows (sample, the ones with the smallest hash of their key); every whole text is scored with it.

expected_grade is the mean grade; tail_prob is P(grade >= target); a document is kept if that reaches keep_at.

Defined results. Null or empty text, or one without words: its features are zero but for the intercept slots; it's scored as such.
Repeated rows: scored each. Null grades are left out of the fit. No labelled row, or a single grade: every document is kept with tail_prob 1.
Ties don't matter: scores depend on the text alone. Empty table: no rows. A text of any length is read whole. Extra columns of documents
pass through, whatever their names; those named expected_grade, tail_prob or keep are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, small_batches, span_hashes, word_spans

LOG2_SHAPES = 14
#: Slots after the shapes: words equal to the 1st, 2nd, 3rd before, share of distinct words, log length, no words.
EXTRA = 6
SIZE = (1 << LOG2_SHAPES) + EXTRA

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of many texts at once: text, slot, value; a slot may come several times, the values add up."""
    n = len(texts)
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    limits = np.cumsum([len(t or b"") + 1 for t in texts])
    starts, ends = word_spans(data)
    owner = np.searchsorted(limits, starts, side="right")
    words = np.bincount(owner, minlength=n).astype(float)
    kind = _CLASS[data]
    run = np.ones(len(kind), bool)
    run[1:] = kind[1:] != kind[:-1]
    at = np.concatenate([[0], np.cumsum(run)])
    # a word's first byte always begins a run, as white space stands before it
    slot = [(span_hashes(kind[run], at[starts], at[ends]) >> np.uint64(64 - LOG2_SHAPES)).astype(np.int64)]
    text, value = [owner], [1.0 / words[owner]]
    h = span_hashes(data, starts, ends)
    base = 1 << LOG2_SHAPES
    for lag in (1, 2, 3):
        same = np.flatnonzero((h[lag:] == h[:-lag]) & (owner[lag:] == owner[:-lag])) + lag if len(h) > lag else np.zeros(0, np.int64)
        text.append(owner[same])
        slot.append(np.full(len(same), base + lag - 1))
        value.append(1.0 / words[owner[same]])
    order = np.lexsort((h, owner))
    ho, oo = h[order], owner[order]
    new = np.ones(len(ho), bool)
    new[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
    distinct = np.bincount(oo[new], minlength=n)
    for k, x in ((3, distinct / np.maximum(words, 1)), (4, np.log1p(words) / 10), (5, (words == 0).astype(float))):
        text.append(np.arange(n))
        slot.append(np.full(n, base + k))
        value.append(x)
    return np.concatenate(text), np.concatenate(slot), np.concatenate(value)


@dataclass(frozen=True)
class OrdinalModel:
    grades: tuple[int, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def tail(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k + 1]) for each k, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        text, slot, value = features(texts)
        return np.bincount(text, self.weights[slot] * value, minlength=len(texts))


def fit(text: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood with Adam steps over all rows. Thresholds are a first one and positive gaps, so they stay in order."""
    grades = np.unique(grade)
    y = np.searchsorted(grades, grade)
    k = len(grades) - 1
    w, cut = np.zeros(SIZE), np.zeros(k)
    m, v = np.zeros(SIZE + k), np.zeros(SIZE + k)
    used = np.unique(slot)
    for t in range(1, steps + 1):
        edges = cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])
        s = np.bincount(text, w[slot] * value, minlength=len(y))
        below = 1 / (1 + np.exp(np.clip(s[:, None] - np.concatenate([[-40.0], edges, [40.0]])[None, :] + 0.0, -60, 60)))
        below[:, 0], below[:, -1] = 0, 1
        hi, lo = below[np.arange(len(y)), y + 1], below[np.arange(len(y)), y]
        # d log(hi - lo) / d score = -(1 - hi - lo), and the slopes by the two thresholds
        p = np.maximum(hi - lo, 1e-12)
        g_score = (1 - hi - lo) / len(y)
        g_edge = np.zeros(k + 2)
        np.add.at(g_edge, y + 1, -hi * (1 - hi) / p / len(y))
        np.add.at(g_edge, y, lo * (1 - lo) / p / len(y))
        g_edge = g_edge[1:-1]
        g_cut = np.array([g_edge.sum(), *(np.exp(c) * g_edge[i + 1 :].sum() for i, c in enumerate(cut[1:]))])
        g = np.concatenate([np.bincount(slot, -g_score[text] * -1 * value, minlength=SIZE) + decay * w, g_cut])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[used] -= step[:SIZE][used]
        cut -= step[SIZE:]
    return OrdinalModel(tuple(int(g) for g in grades), w, cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))]))


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", key: str = "doc_id", text: str = "text", sample: int = 8000) -> OrdinalModel | None:
    """Fit on at most sample labelled rows, chosen by a hash of the key; None if they don't hold two grades."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(key).alias("key"), F.col(grade).cast("int").alias("grade")).dropna().groupBy("key").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("key"), "key").limit(sample)
    # at most sample rows of 12 bytes
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key").select("text", "grade")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary()).to_pylist()
            for a, b in in_slices(texts):
                t, s, x = features(texts[a:b])
                cell, inverse = np.unique(t * SIZE + s, return_inverse=True)
                total = np.bincount(inverse, x).astype(np.float32)
                cuts = np.searchsorted(cell, np.arange(b - a + 1) * SIZE)
                slots = (cell % SIZE).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "grade": batch.column(1).slice(a, b - a),
                    "slots": [slots[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
                    "shares": [total[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
                })

    got = rows.mapInArrow(run, "grade int, slots binary, shares binary").toArrow()
    grades = got.column("grade").to_numpy()
    if len(set(grades.tolist())) < 2:
        return None
    slots = [np.frombuffer(x, np.int32) for x in got.column("slots").to_pylist()]
    shares = [np.frombuffer(x, np.float32) for x in got.column("shares").to_pylist()]
    return fit(np.repeat(np.arange(len(slots)), [len(x) for x in slots]), np.concatenate(slots), np.concatenate(shares).astype(float), grades)


def score(docs: DataFrame, model: OrdinalModel | None, target: int | None = None, keep_at: float = 0.5, text: str = "text") -> DataFrame:
    """docs with expected_grade, tail_prob and keep; columns of docs of these names are replaced."""
    small_batches(docs.sparkSession)
    own = ("expected_grade", "tail_prob", "keep")
    rows = docs.drop(*own)
    if model is None:
        return rows.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_prob": F.lit(1.0), "keep": F.lit(True)})
    goal = model.grades.index(model.grades[-1] if target is None else target) - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE doubles
    steps = np.diff(np.array(model.grades, float))

    @F.pandas_udf("expected_grade double, tail_prob double")
    def rate(column):
        import pandas as pd

        m = shared.value
        texts = [t.encode() if t is not None else None for t in column]
        s = np.concatenate([m.scores(texts[a:b]) for a, b in in_slices(texts)]) if texts else np.zeros(0)
        tails = m.tail(s)
        return pd.DataFrame({"expected_grade": m.grades[0] + tails @ steps, "tail_prob": tails[:, goal] if goal >= 0 else np.ones(len(s))})

    held = "rated"
    while held in docs.columns:
        held += "_"
    rated = rows.withColumn(held, rate(F.col(text).cast("string")))
    return rated.withColumns({"expected_grade": F.col(f"{held}.expected_grade"), "tail_prob": F.col(f"{held}.tail_prob"), "keep": F.col(f"{held}.tail_prob") >= keep_at}).drop(held)
