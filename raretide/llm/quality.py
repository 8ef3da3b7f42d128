"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed features of the text gives a latent quality ``e``; ordered thresholds part the grades:
P(grade >= k) = sigmoid(e - t_k). All grades share the weights, so a few ratings of one grade still learn from the
rest. The expected grade and the tail probability P(grade >= wanted) select documents.

Features of a word: itself, its last bytes, its shape (cases, digits, symbols, length), and whether it repeats the
word before it. A text's latent quality is the mean of its words' weights and a term for its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raretide.llm import kernels as K
from raretide.llm import labelled

U = np.uint64
BITS = 15
#: Rows of the weight table: words, then last bytes, then shapes with the repeat mark, then length classes.
WORDS = 1 << BITS
ENDS = WORDS + (1 << 12)
SHAPES = ENDS + (1 << 10)
SIZE = SHAPES + 32
SCALE = 8.0


def _kinds() -> np.ndarray:
    out = np.full(256, 5, np.int64)  # symbols
    out[0x30:0x3A] = 4
    out[0x41:0x5B] = 1
    out[0x61:0x7B] = 2
    out[0x80:] = 3
    for c in b".,;:!?'\"()-":
        out[c] = 6
    return out


KINDS = _kinds()


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three rows of the weight table for each word, the first word of each text, and each text's length class."""
    words = K.Words(text, K.SPACES, K.SAME)
    n = np.diff(words.first)
    length = SHAPES + np.minimum(np.log2(n + 1).astype(np.int64), 31)
    if not len(words.start):
        return np.zeros((0, 3), np.int64), words.first, length
    h = words.hashes()
    raw, last = words.bytes, words.start + words.size - 1
    byte = lambda k: np.where(words.size > k, raw[np.maximum(last - k, 0)].astype(np.int64), 0)
    ends = ((byte(0) * 31 + byte(1)) * 31 + byte(2)) & 0xFFF
    head, second = KINDS[raw[words.start]], np.where(words.size > 1, KINDS[raw[np.minimum(words.start + 1, len(raw) - 1)]], 0)
    again = np.r_[False, h[1:] == h[:-1]]
    again[words.first[:-1][n > 0]] = False
    shape = (head * 7 + second) * 7 + KINDS[raw[last]]  # below 343
    shape = (shape * 2 + again) % (1 << 10)
    return np.stack([(h >> U(64 - BITS)).astype(np.int64), WORDS + ends, ENDS + shape], axis=1), words.first, length


class Model:
    def __init__(self, grades: int):
        self.weights = np.zeros(SIZE, np.float64)
        self.thresholds = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)

    def latent(self, text: pa.Array) -> np.ndarray:
        rows, first, length = features(text)
        sums = np.r_[0, np.cumsum(self.weights[rows].sum(1))]
        n = np.diff(first)
        return SCALE * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1) + self.weights[length]

    def tails(self, e: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, one column each."""
        return 1 / (1 + np.exp(-np.clip(e[:, None] - self.thresholds[None, :], -30, 30)))

    def fit(self, texts: list[str], y: np.ndarray, rounds: int, rate: float, decay: float) -> None:
        parts = [features(pa.array([t])) for t in texts]
        ids, of, value = [], [], []
        for i, (rows, _, length) in enumerate(parts):
            k, c = np.unique(rows, return_counts=True)
            ids += [k, length]
            value += [SCALE * c / max(1, len(rows)), np.ones(1)]
            of += [np.full(len(k) + 1, i)]
        ids, of, value = np.concatenate(ids), np.concatenate(of), np.concatenate(value)
        grades = len(self.thresholds) + 1
        counts = np.array([(y >= k).mean() for k in range(1, grades)])
        self.thresholds = -np.log(np.clip(counts, 1e-3, 1 - 1e-3) / (1 - np.clip(counts, 1e-3, 1 - 1e-3)))
        square, square_t = np.full(SIZE, 1e-8), np.full(grades - 1, 1e-8)
        for _ in range(rounds):
            e = np.bincount(of, self.weights[ids] * value, minlength=len(y))
            tail = np.c_[np.ones(len(y)), self.tails(e), np.zeros(len(y))]
            at = np.arange(len(y))
            high, low = tail[at, y], tail[at, y + 1]  # P(y = k) is their difference
            p = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            g = -(d_high - d_low) / len(y)  # of the loss by e
            gw = np.bincount(ids, value * g[of], minlength=SIZE) + decay * self.weights
            gt = np.zeros(grades - 1)
            for k in range(1, grades):
                gt[k - 1] = (d_high[y == k].sum() - d_low[y == k - 1].sum()) / len(y)
            square += gw**2
            square_t += gt**2
            self.weights -= rate * gw / np.sqrt(square)
            self.thresholds -= rate * gt / np.sqrt(square_t)
            self.thresholds = np.maximum.accumulate(self.thresholds)  # ordered


def fit(docs: DataFrame, labels: DataFrame, *, grades: int, grade: str, id_col: str = "doc_id", text_col: str = "text", per_grade: int = 2500, rounds: int = 150, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Fit on at most ``per_grade`` rated documents of each grade; ``grade`` is an SQL expression over the labels."""
    rows = labelled.sample(docs, labels, F.expr(grade), per_grade, grades, id_col=id_col, text_col=text_col)
    model = Model(grades)
    if rows:
        model.fit([r.text or "" for r in rows], np.array([r.y for r in rows]), rounds, rate, decay)
    return model


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in K.pieces(batches, "text", 1 << 19):
            tails = model.tails(model.latent(b.column("text")))
            ends = np.arange(len(tails) + 1, dtype=np.int32) * tails.shape[1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(tails.reshape(-1)))], names=["doc_id", "tails"])

    return run


def grade_quality(docs: DataFrame, labels: DataFrame, *, grades: int = 3, grade: str = "CASE WHEN quality = 1 THEN 2 - toxic ELSE quality END", wanted: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: doc_id, held_out, expected_grade, tails (P(grade >= 1), ...), tail, kept.

    tail is P(grade >= wanted); a document is kept if it is at least ``least``. Grades are 0 .. grades - 1; ratings
    outside are ignored. Null and empty texts are graded as texts without words. Without ratings every tail is that
    of the initial thresholds. Held-out documents are never learnt from. Repeated rows are graded alike; null
    identifiers are allowed. An empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, labels, grades=grades, grade=grade, id_col=id_col, text_col=text_col, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SIZE
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(_scores(shared), f"doc_id {kind}, tails array<double>")
    tail = F.get("tails", F.lit(wanted - 1))
    return out.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), F.aggregate("tails", F.lit(0.0), lambda a, x: a + x).alias("expected_grade"), "tails", tail.alias("tail"), (tail >= least).alias("kept"))
