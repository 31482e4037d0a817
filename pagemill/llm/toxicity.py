"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

Voters are of several kinds, and each of them is right only so often:

* lexicon: each of the words that toxic rows hold far more often than others is a voter, and so are two or three such words in one text;
* byte patterns: lists of byte sequences inside words, dealt by their order of strength;
* obfuscation: a word that becomes one of the lexicon once digits and signs are read as letters and repeated letters once;
* manner: words in capitals, repeated exclamation marks;
* clean: a text without a word of the lexicon votes for the other class.

The label model sees the votes and the share of toxic rows, never a row's label: each voter's rate of votes in either class, by EM from the share of votes. A
voter that is silent says nothing. A voter's direction is given, its accuracy is estimated. Voters that mostly vote alike count as one; those that still agree given
the class are correlated, pair by pair, and each one's evidence is divided by one plus its correlations with the others. The classifier is logistic regression over hashed words and byte
sequences on the posterior labels, and a monotone calibration on labelled rows that neither voters nor fit have seen gives the score.

The lexicon is mined, and all is fitted, on a bounded sample of labelled rows (labelled: the rows with the smallest hash of their key); every whole text
is scored. Rows for which held_out holds are never used in a fit. Language, source and key aren't inputs of a score.

Defined results. Null or empty text, or one without words: the score of the intercept. Repeated rows: scored each. Null labels are left
out. No labelled row, or labels of one class: the score is the share of the known positives, 0 if none. Empty table: no rows.
Extra columns of documents pass through; columns named score or predicted are replaced. A text of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, mix64, small_batches, span_hashes, word_spans

LOG2 = 20
GRAM = 6
#: Voters of one word each, and voters of byte patterns.
LEXICON, PATTERNS = 60, 6
#: Digits and signs that are written for letters (fixed values).
LOOKS_LIKE = str.maketrans("013457@$!", "oieastasi")

_CLEAN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def distinct_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of many texts: (text, word) pairs, and each word's span in one byte array."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN) for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    limits = np.cumsum([len(t) + 1 for t in raw])
    starts, ends = word_spans(data)
    owner = np.searchsorted(limits, starts, side="right")
    h = span_hashes(data, starts, ends)
    _, first, word = np.unique(h, return_index=True, return_inverse=True)
    pair = np.unique(owner * max(1, len(first)) + word) if len(h) else np.zeros(0, np.int64)
    width = max(1, len(first))
    return pair // width, pair % width, data, starts[first], ends[first]


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of words: the word itself and its sequences of GRAM bytes, with a mark at either end. Word, slot."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - starts + 2
    base = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(base[-1], 1, np.uint8)
    inner = np.ones(base[-1], bool)
    inner[base[:-1]] = False
    inner[base[1:] - 1] = False
    of = np.repeat(np.arange(n), size)
    flat[inner] = data[(np.arange(base[-1]) - base[of] - 1 + starts[of])[inner]]
    h = span_hashes(flat, base[:-1], base[1:])
    words, slots = [np.arange(n)], [h]
    full = len(flat) - GRAM + 1
    if full > 0:
        at = np.flatnonzero(of[:full] == of[GRAM - 1 :])
        value = np.zeros(len(at), np.uint64)
        for k in range(GRAM):
            value = (value << np.uint64(8)) | flat[at + k].astype(np.uint64)
        words.append(of[at])
        slots.append(mix64(value + np.uint64(0x2545F4914F6CDD1D)))
    return np.concatenate(words), (np.concatenate(slots) >> np.uint64(64 - LOG2)).astype(np.int64)


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        text, word, data, starts, ends = distinct_words(texts)
        owner, slot = word_features(data, starts, ends)
        value = np.bincount(owner, self.weights[slot], minlength=len(starts))
        s = np.bincount(text, value[word], minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.slope * s + self.shift, -40, 40)))


def plain_words(text: str) -> str:
    """Words that hold digits, signs or a letter three times in a row, as they would be without: digits and signs read as letters, letters once."""
    odd = [w for w in text.lower().split() if not w.strip(".,;:!?").isalpha() or _RUN.search(w)]
    return " ".join(_RUN.sub(r"\1", _OTHER.sub("", w.strip(".,;:!?").translate(LOOKS_LIKE))) for w in odd)


_RUN, _OTHER = re.compile(r"(.)\1\1+"), re.compile(r"[^a-z\u00e0-\u024f]+")


def manners(text: str) -> tuple[bool, bool]:
    """Words in capitals, at least three of four letters and more; exclamation marks in a row."""
    return sum(len(w) >= 4 and w.isupper() for w in text.split()) >= 3, "!!" in text


def telling(rows: np.ndarray, slots: np.ndarray, label: np.ndarray, least: int = 4, precision: float = 0.8) -> np.ndarray:
    """Slots in at least `least` toxic rows, with this share of toxic rows at equal class sizes and as they are; the strongest first."""
    toxic = label == 1
    pos = np.bincount(slots[toxic[rows]], minlength=1 << LOG2)
    neg = np.bincount(slots[~toxic[rows]], minlength=1 << LOG2)
    a, b = (pos + 0.2) / (toxic.sum() + 1), (neg + 0.2) / ((~toxic).sum() + 1)
    good = np.flatnonzero((pos >= least) & (a / (a + b) >= precision) & (pos >= precision * (pos + neg)))
    return good[np.lexsort((good, -(a / b)[good], -(a - b)[good]))]


def holds(n: int, rows: np.ndarray, slots: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many of the wanted slots each of n rows holds."""
    mark = np.zeros(1 << LOG2, bool)
    mark[wanted] = True
    return np.bincount(rows[mark[slots]], minlength=n)


def label_model(votes: np.ndarray, toward: np.ndarray, prior: float, rounds: int = 40, same: float = 0.8, least: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the positive class, and the weight of each voter. votes: whether each voter votes for a row; toward: the class that it votes for.

    Voters for a class of a correlation above same are one voter from the start, or they'd be taken for the class; a row starts at the prior, and is moved by its
    votes. Votes are at least `least` times as frequent in their class as in the other one, as mining asks for, so the classes can't change places.
    """
    on = votes.astype(float)
    side = toward[:, None] == toward[None, :]

    def correlations(rest: np.ndarray) -> np.ndarray:
        scale = np.sqrt((rest**2).sum(0)) + 1e-9
        c = np.abs(rest.T @ rest) / np.outer(scale, scale)
        np.fill_diagonal(c, 0)
        return c

    alike = (correlations(on - on.mean(0)) > same) & side
    base = 1 / (1 + alike.sum(0))
    weight, many, against = base, on[:, toward == 1] @ base[toward == 1], on[:, toward == 0] @ base[toward == 0]
    post = np.clip((many + prior) / (many + against + 1), 0.02, 0.98)
    for r in range(rounds):
        yes, no = ((on.T @ p + 0.5) / (p.sum() + 1) for p in (post, 1 - post))
        yes, no = np.where(toward == 1, yes, np.minimum(yes, no / least)), np.where(toward == 1, np.minimum(no, yes / least), no)
        if r in (10, 25):  # correlations of pairs, given the class
            c = np.where(alike | ~side, 0, correlations(on - (post[:, None] * yes + (1 - post[:, None]) * no)))
            weight = base / (1 + np.where(c > 0.1, c, 0).sum(0))
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + on @ (np.log(yes / no) * weight), -30, 30)))
    return post, weight


def logistic(rows: np.ndarray, slots: np.ndarray, target: np.ndarray, steps: int = 150, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam over all rows; target is a probability. Only the slots that occur have weights, with a normal prior of variance 1."""
    decay = 1 / len(target)
    used, slot = np.unique(slots, return_inverse=True)
    w = np.zeros(len(used) + 1)
    w[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = np.bincount(rows, w[slot], minlength=len(target)) + w[-1]
        e = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - target
        g = np.append(np.bincount(slot, e[rows], minlength=len(used)), e.sum()) / len(target)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(1 << LOG2)
    full[used] = w[:-1]
    return full, float(w[-1])


def _calibration(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of y on s, by Newton steps with a weak prior on slope 1."""
    p = np.array([1.0, 0.0])
    x = np.stack([s, np.ones_like(s)], 1)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (q - y) + (p - [1, 0])
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), g)
        p = p - step / max(1.0, float(np.abs(step).max()))  # at most 1 at a time: a full step may overshoot
    return (float(p[0]), float(p[1])) if np.isfinite(p).all() and p[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, held_out, key: str = "doc_id", text: str = "text", label: str = "toxic", labelled: int = 8000) -> ToxicModel:
    """held_out: column over the key; rows for which it holds aren't used. At most labelled rows are."""
    small_batches(docs.sparkSession)
    known = labels.filter(~held_out).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropna().groupBy("key").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(labelled)
    # at most labelled rows of 12 bytes
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key").select("text", "label", F.xxhash64("key").alias("order"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in in_slices(texts):
                found = distinct_words(texts[a:b])
                doc, word, _, starts, _ = found
                owner, slot = word_features(*found[2:])
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(len(starts) + 1))
                own, slot = slot[: len(starts)], slot[order]  # the first ones are the words themselves
                plain = [plain_words(t or "") for t in texts[a:b]]
                doc2, word2, *rest = distinct_words(plain)
                own2 = word_features(*rest)[1][: len(rest[1])]
                out: dict[str, list] = {k: [] for k in ("slots", "words", "plain", "capitals", "marks")}
                for d in range(b - a):
                    mine = word[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
                    out["slots"].append(np.unique(np.concatenate([slot[cut[k] : cut[k + 1]] for k in mine] or [slot[:0]])).astype(np.int32).tobytes())
                    out["words"].append(np.unique(own[mine]).astype(np.int32).tobytes())
                    out["plain"].append(np.unique(own2[word2[np.searchsorted(doc2, d) : np.searchsorted(doc2, d, "right")]]).astype(np.int32).tobytes())
                    capitals, marks = manners(texts[a + d] or "")
                    out["capitals"].append(capitals)
                    out["marks"].append(marks)
                yield pa.RecordBatch.from_pydict({"label": batch.column(1).slice(a, b - a), "order": batch.column(2).slice(a, b - a)} | out)

    got = rows.mapInArrow(run, "label int, order long, slots binary, words binary, plain binary, capitals boolean, marks boolean").toArrow()
    got = got.take(pa.array(np.lexsort((got.column("label").to_numpy(), got.column("order").to_numpy()))))
    y = got.column("label").to_numpy()
    n = len(y)
    share = float((y == 1).sum() / max(1, n))
    if share in (0.0, 1.0):
        bound = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return ToxicModel(np.zeros(1 << LOG2), bound, 1.0, 0.0)

    def pairs(column: str) -> tuple[np.ndarray, np.ndarray]:
        each = [np.frombuffer(x, np.int32) for x in got.column(column).to_pylist()]
        return np.repeat(np.arange(n), [len(x) for x in each]), np.concatenate(each).astype(np.int64)

    fitted = np.arange(n) % 5 != 0  # a fifth of the rows is left for the calibration
    (rows_, slots), (of_word, words), (of_plain, plain) = pairs("slots"), pairs("words"), pairs("plain")
    index = np.cumsum(fitted) - 1

    def mined(of: np.ndarray, what: np.ndarray) -> np.ndarray:
        return telling(index[of[fitted[of]]], what[fitted[of]], y[fitted])

    lexicon, patterns = mined(of_word, words)[:LEXICON], mined(rows_, slots)
    hits = holds(n, of_word, words, lexicon)
    for_ = [holds(n, of_word, words, lexicon[k : k + 1]) > 0 for k in range(len(lexicon))] + [hits >= 2, hits >= 3]
    for_ += [holds(n, rows_, slots, patterns[k::PATTERNS]) > 0 for k in range(PATTERNS)]
    for_ += [holds(n, of_plain, plain, lexicon) > 0, *(got.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("capitals", "marks"))]
    votes, toward = np.stack([*for_, hits == 0], 1), np.array([1] * len(for_) + [0])
    post, _ = label_model(votes[fitted], toward, share)

    # slots that tell the classes apart by the posterior, and aren't in a row or two only
    at = fitted[rows_]
    row, slot = index[rows_[at]], slots[at]
    total = np.bincount(slot, minlength=1 << LOG2)
    mass = np.bincount(slot, post[row], minlength=1 << LOG2)
    z = np.abs(mass - total * post.mean()) / np.sqrt(np.maximum(total, 1) * post.mean() * (1 - post.mean()))
    use = ((total >= 3) & (z >= 2.5))[slot]
    weights, intercept = logistic(row[use], slot[use], post) if use.any() else (np.zeros(1 << LOG2), 0.0)

    rest = ~fitted
    s = np.bincount(rows_, weights[slots], minlength=n)[rest] + intercept
    slope, shift = _calibration(s, y[rest].astype(float)) if len(set(y[rest].tolist())) == 2 else (1.0, 0.0)
    return ToxicModel(weights, intercept, slope, shift)


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs with score and predicted; columns of docs of these names are replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^LOG2 doubles

    @F.pandas_udf("double")
    def rate(column):
        import pandas as pd

        texts = column.tolist()
        m = shared.value
        return pd.Series(np.concatenate([m.scores(texts[a:b]) for a, b in in_slices(texts)]) if texts else np.zeros(0))

    return docs.drop("score", "predicted").withColumn("score", rate(F.col(text).cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_rows(key: str = "doc_id"):
    """Rows whose crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
