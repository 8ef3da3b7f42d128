"""Toxicity by a small convolutional text classifier, trained in numpy: first on the driver, on few
labelled texts, then by all of them in blocks side by side.

A word's embedding is the sum of three hashed ones: of the whole word and of its first four and six bytes, so that
inflected forms share what they begin with. Filters of several widths run over the words of a whole text, and each
keeps its largest answer; a linear layer makes a score of these. Thresholds for flags are calibrated by language on a
part of the training labels; neither language nor source nor identifier enters the score itself.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raretide.llm import kernels as K
from raretide.llm import labelled

U = np.uint64
WIDTHS, FILTERS, SIZE = (1, 2, 3), 8, 16
BITS = (16, 13, 14)  # of the three embedding tables
PREFIXES = (4, 6)
GAP = max(WIDTHS)


def _prefix(words: K.Words, k: int) -> np.ndarray:
    """Hashes of the first k bytes of each word."""
    out = np.zeros(len(words.start), U)
    if len(out):
        with np.errstate(over="ignore"):
            for j in range(k):
                at = np.minimum(words.start + j, len(words.bytes) - 1)
                out = out * K.BASE + np.where(j < words.size, words.bytes[at].astype(U) + U(1), U(0))
    return K.mix(out)


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Three table rows for each word, and the first word of each text."""
    words = K.Words(text, K.NON_ALNUM)
    hashes = (words.hashes(), *(_prefix(words, k) for k in PREFIXES))
    return np.stack([(h >> U(64 - b)).astype(np.int32) for h, b in zip(hashes, BITS, strict=True)], axis=1), words.first


class Model:
    def __init__(self, seed: int):
        r = np.random.RandomState(seed)
        self.tables = [r.normal(0, 0.1, (1 << b, SIZE)).astype(np.float32) for b in BITS]
        self.filters = [r.normal(0, 0.25, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(0)

    def _laid(self, f: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings with a gap of zeros after each text, the place of each word, and the start of each text."""
        n = np.diff(first)
        place = np.arange(len(f)) + GAP * np.repeat(np.arange(len(n)), n)
        x = np.zeros((len(f) + GAP * (len(n) + 1), SIZE), np.float32)
        if len(f):
            x[place] = sum(t[f[:, i]] for i, t in enumerate(self.tables))
        return x, place, first[:-1] + GAP * np.arange(len(n))

    def pooled(self, x: np.ndarray, starts: np.ndarray, where: bool = False):
        """The largest answer of each filter in each text, at least 0; with ``where`` also its place."""
        rows = len(x) - GAP
        ends = np.r_[starts[1:], rows][: len(starts)]
        between = (ends[:, None] - np.arange(1, GAP + 1)).ravel()
        best, at = [], []
        for w, filt, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            c = sum(x[j : j + rows] @ filt[j] for j in range(w)) + bias
            c[between] = bias  # a window that begins in a gap must not see the next text
            top = np.maximum.reduceat(c, starts, axis=0)
            best.append(top)
            if where:
                at.append(np.stack([a + c[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)]))
        best = np.maximum(np.concatenate(best, axis=1), 0)
        return (best, at) if where else best

    def logits(self, text: pa.Array) -> np.ndarray:
        f, first = features(text)
        x, _, starts = self._laid(f, first)
        return self.pooled(x, starts) @ self.out + self.base

    def dense(self) -> np.ndarray:
        """All weights outside of the tables, in rows of SIZE."""
        flat = np.concatenate([*(p.ravel() for p in (*self.filters, *self.bias, self.out)), [self.base]]).astype(np.float32)
        return np.pad(flat, (0, -len(flat) % SIZE)).reshape(-1, SIZE)

    def move(self, change: np.ndarray) -> None:
        """Adds a change of the weights of ``dense``."""
        flat, at = change.ravel(), 0
        for p in (*self.filters, *self.bias, self.out):
            p += flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.base += np.float32(flat[at])

    def fit(self, texts: list[str], y: np.ndarray, epochs: int, seed: int, rate: float = 0.05, batch: int = 32, steps: int = 1500) -> None:
        epochs = max(epochs, -(-steps // -(-len(texts) // batch)))  # few texts are seen more often
        laid = [features(pa.array([t]))[0] for t in texts]
        r = np.random.RandomState(seed)
        dense = [*self.filters, *self.bias, self.out]
        square = [np.full_like(p, 1e-3) for p in dense]
        seen = [np.full(len(t), 1e-3, np.float32) for t in self.tables]
        base_square = 1e-3
        for epoch in range(epochs):
            step = rate * (1 - epoch / (epochs + 1))
            order = r.permutation(len(laid))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                f = np.concatenate([laid[j] for j in some])
                first = np.r_[0, np.cumsum([len(laid[j]) for j in some])]
                x, place, starts = self._laid(f, first)
                best, at = self.pooled(x, starts, True)
                p = 1 / (1 + np.exp(-np.clip(best @ self.out + self.base, -30, 30)))
                g = ((p - y[some]) / len(some)).astype(np.float32)
                gout, gbest = g @ best, np.outer(g, self.out) * (best > 0)
                back = np.zeros(len(x), np.int64) - 1
                back[place] = np.arange(len(place))
                grads, rows, vectors = [], [], []
                for k, (w, filt) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    gk = gbest[:, k * FILTERS : (k + 1) * FILTERS]
                    gf = np.zeros_like(filt)
                    for j in range(w):
                        for m in range(FILTERS):
                            spot = at[k][:, m] + j
                            gf[j, :, m] = gk[:, m] @ x[spot]
                            live = (back[spot] >= 0) & (gk[:, m] != 0)
                            rows.append(back[spot[live]])
                            vectors.append(np.outer(gk[live, m], filt[j, :, m]))
                    grads.append((gf, gk.sum(0)))
                for param, sq, grad in zip(dense, square, [*(a for a, _ in grads), *(b for _, b in grads), gout], strict=True):
                    sq += grad**2
                    param -= step * grad / np.sqrt(sq)
                base_square += float(g.sum()) ** 2
                self.base -= np.float32(step * g.sum() / np.sqrt(base_square))
                rows, vectors = np.concatenate(rows), np.concatenate(vectors)
                for k, (table, sq) in enumerate(zip(self.tables, seen, strict=True)):
                    ids, which = np.unique(f[rows, k], return_inverse=True)
                    total = np.zeros((len(ids), SIZE), np.float32)
                    np.add.at(total, which, vectors)
                    sq[ids] += (total**2).mean(1)
                    table[ids] -= step * total / np.sqrt(sq[ids])[:, None]


#: Logits are counted in bins of 1 / FINE between -SPAN and SPAN.
FINE, SPAN = 64, 32
UNIT = float(1 << 32)  # of changes of weights, so that their sums are exact in any order
TOGETHER = 8  # blocks of a task, whose changes of the same weights are added before they are shuffled


def _best_cut(bins: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> float | None:
    """The logit in the middle of the gap under the bin that a cut with the largest F1 takes last; None if one class is missing."""
    if not 0 < hits.sum() < rows.sum():
        return None
    order = np.argsort(-bins)
    bins, hit = bins[order], np.cumsum(hits[order])
    k = int((2 * hit / (np.cumsum(rows[order]) + hit[-1])).argmax())
    below = bins[k + 1] + 1 if k + 1 < len(bins) else bins[k] - 1
    return float((bins[k] + below) / 2 / FINE - SPAN)


def _changes(shared, seed: int, rate: float):
    """One pass over a block of texts from the shared weights: the changed rows of each table, and the other weights as table -1."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("doc_id")
        model, before = copy.deepcopy(shared.value), shared.value
        model.fit(list(block["text"].fillna("")), block["y"].to_numpy(np.float32), 1, seed, rate, steps=0)
        out = []
        for k, (new, old) in enumerate([(model.dense(), before.dense()), *zip(model.tables, before.tables, strict=True)]):
            change = np.rint((new.astype(np.float64) - old) * UNIT).astype(np.int64)
            ids = np.arange(len(change)) if k == 0 else np.flatnonzero(change.any(axis=1))
            out.append(pd.DataFrame({"k": k - 1, "id": ids} | {f"c{j}": change[ids, j] for j in range(SIZE)}))
        return pd.concat(out)

    return run


def _pass(model: Model, rows: DataFrame, seed: int, rate: float) -> None:
    """Every block of rows improves the model by itself; each weight moves by the mean of the blocks that changed it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    change = rows.groupBy("block").applyInPandas(_changes(shared, seed, rate), "k int, id long, " + ", ".join(f"c{j} long" for j in range(SIZE)))
    # a row for each row of the tables at most
    total = change.groupBy("k", "id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"c{j}").alias(f"c{j}") for j in range(SIZE))).toPandas()
    mean = total[[f"c{j}" for j in range(SIZE)]].to_numpy(np.float64) / UNIT / total["n"].to_numpy()[:, None]
    dense = np.zeros_like(model.dense())
    for k in range(-1, len(BITS)):
        at = total["k"].to_numpy() == k
        (dense if k < 0 else model.tables[k])[total["id"].to_numpy()[at]] += mean[at].astype(np.float32)
    model.move(dense)
    shared.destroy()


def _bins(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches, "text", 1 << 19):
            bins = np.floor((np.clip(shared.value.logits(b.column("text")), -SPAN, SPAN) + SPAN) * FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("y"), pa.array(bins)], names=["lang", "y", "bin"])

    return run


def _cuts(model: Model, rows: DataFrame) -> tuple[float, dict[str, float | None]]:
    """The best cut of all rows' logits, and that of each language."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    counted = rows.select("lang", "y", "text").mapInArrow(_bins(shared), "lang string, y int, bin long").groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("hits"))

    def cut(lang: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": lang["lang"].iloc[:1], "cut": [_best_cut(*(lang[c].to_numpy() for c in ("bin", "rows", "hits")))]}).astype({"cut": float})

    whole = counted.groupBy("bin").agg(F.sum("rows").alias("rows"), F.sum("hits").alias("hits")).toPandas()  # as many rows as bins
    own = {r.lang: None if r.cut is None or np.isnan(r.cut) else r.cut for r in counted.groupBy("lang").applyInPandas(cut, "lang string, cut double").collect()}
    shared.destroy()
    return _best_cut(*(whole[c].to_numpy() for c in ("bin", "rows", "hits"))) or 0.0, dict(sorted(own.items()))


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2500, epochs: int = 8, seed: int = 1, rounds: int = 2, block: int = 1024) -> tuple[Model, dict[str, float]]:
    """Train on all labelled documents that are not held out; a fifth of them calibrates.

    The driver begins with at most 2 * per_class of them; where there are more, ``rounds`` passes over all follow, in blocks of
    about ``block`` documents side by side, whose changes are averaged. Cuts come from counts of all calibrating documents. The
    score is shifted so that 0.5 is the best cut over all languages; the thresholds by language are on that scale.
    """
    n = labels.count()
    blocks = 1 + n // block
    rows = labelled.everything(docs, labels, F.col(label_col), blocks, -(-blocks // TOGETHER), n, id_col=id_col, text_col=text_col, more={"lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(""))})
    rows = rows.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0).persist(StorageLevel.DISK_ONLY)
    try:
        sizes = {(r.aside, r.y): r["count"] for r in rows.groupBy("aside", "y").count().collect()}
        both = lambda *kinds: all(any(sizes.get((a, y)) for a in kinds) for y in (0, 1))
        model = Model(seed)
        if not both(True, False):  # nothing to tell apart: every score is the one class seen, or 0
            model.out[:] = 0
            model.base = np.float32(30 if sizes and all(y == 1 for _, y in sizes) else -30)
            return model, {}
        learn = rows.filter("NOT aside") if both(False) else rows
        first = sorted(labelled.first(learn, per_class, 2).collect(), key=lambda r: r.doc_id)
        model.fit([r.text or "" for r in first], np.array([r.y for r in first], np.float32), epochs, seed)
        if len(first) < sum(n for (aside, _), n in sizes.items() if not (aside and both(False))):
            for k in range(rounds):
                _pass(model, learn, seed + k, 0.02 / (k + 1))
        shift, own = _cuts(model, rows.filter("aside") if both(True) else learn)
        model.base -= np.float32(shift)
        return model, {lang: 0.5 if cut is None else float(1 / (1 + np.exp(shift - cut))) for lang, cut in own.items()}
    finally:
        rows.unpersist()


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in K.pieces(batches, "text", 1 << 19):
            p = 1 / (1 + np.exp(-np.clip(model.logits(b.column("text")).astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(p)], names=["doc_id", "lang", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5), threshold, flagged.

    The score lies between 0 and 1 and depends on the text alone; null and empty texts get the score of no words.
    threshold is the language's own, 0.5 for languages without labels of both kinds; flagged compares with it.
    Labels are learnt from documents that are not held out. Without labels of both kinds every score is that of the
    kind there is, and near 0 without any. Repeated rows are scored alike; null identifiers are allowed and not held
    out. An empty table gives an empty result; other columns are not read.
    """
    model, cuts = fit(docs, labels, label_col=label_col, lang_col=lang_col, id_col=id_col, text_col=text_col, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(_scores(shared), f"doc_id {kind}, lang string, score double")
    own = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair)) if cuts else F.create_map().cast("map<string,double>")
    scored = scored.withColumn("threshold", F.coalesce(F.element_at(own, F.coalesce("lang", F.lit(""))), F.lit(0.5)))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
