"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms over all passages (consecutive runs of words) of all documents.
   Terms of more than a hundredth of them, and of four times as many as the mean term, carry a small weight, never none.
2. A randomised SVD of the TF-IDF matrix of those passages, in one distributed pass: every task adds up its part of
   Z = A'A Omega, blocks of Z are summed in a tree, and the driver factors the small matrix (single-pass Nystroem).
   The latent space is whitened, so that no frequent term dominates a cosine.
3. Benchmark items, taken in blocks of bounded size as the stated query set, meet the windows of all documents. A window
   is a candidate if its latent cosine reaches ``cosine``: a reworded passage, of which the judge then asks for
   ``paraphrase`` of the item's words in order. Windows of a smaller cosine are candidates for ``overlap`` of them only.
   Either share bounds what a window must hold: a subsequence of o * m of m words leaves r = m - o * m of them out, so
   that of the item's r + t rarest words t stand in the window. An inverted index of those words finds every window that
   can pass, and cosines are worked out for these; nothing that a scan of all windows would find is missed.
4. Candidates are judged on the words themselves: the longest common subsequence must hold that share of the item's
   words, and most of its answer, the words it ends with. Reworded copies pass, chance does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raretide.llm import kernels as K
from raretide.llm.workspace import Workspace

U = np.uint64
TERM_BITS = 14
TERMS = 1 << TERM_BITS
#: Rows of Z that are summed as one unit, and how many tasks' parts meet in one sum.
ROWS, FAN_IN = 1024, 64
#: Words of a block; windows start at block borders.
BLOCK = 2
#: Window lengths; an item is searched with the one nearest to its own length.
SCALES = (8, 16, 24, 32, 48, 64)
#: Blocks between the windows of a scale: the shorter they are, the more a word off the item counts.
STRIDES = {8: 1, 16: 1, 24: 2, 32: 4, 48: 6, 64: 8}
#: The least weight of a term, and the weight of a frequent one.
FLOOR = 0.1
#: The most frequent terms, which are multiplied as dense columns.
DENSE = 1024
#: Of the words that a judged window holds, so many are asked for by the index: t of r + t.
SEEDS = 4


def _words(text: pa.Array) -> tuple[K.Words, np.ndarray, np.ndarray]:
    words = K.Words(text, K.NON_ALNUM)
    h = words.hashes()
    return words, h, (h >> U(64 - TERM_BITS)).astype(np.int64)


def _runs(words: K.Words, size: int) -> np.ndarray:
    """Starts of consecutive runs of ``size`` words that tile each text."""
    n = -(-words.count // size)
    which = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return words.first[which] + j * size


def _frequencies(passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(TERMS, np.int64), 0
        for b in K.pieces(batches, "text"):
            words, _, term = _words(b.column("text"))
            starts = _runs(words, passage)
            of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(term)]))
            pairs = np.sort((of * TERMS + term).astype(np.uint32 if len(starts) < 1 << (32 - TERM_BITS) else np.int64))
            df += np.bincount(pairs[np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])] & (TERMS - 1), minlength=TERMS) if len(pairs) else 0
            total += len(starts)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[found, -1]), pa.array(np.r_[df[found], total])], names=["term", "n"])

    return run


def _projected(passage: int, model):
    """Each task's part of A'A Omega, as blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idf, omega, dense = model.value
        column = np.full(TERMS, -1)
        column[dense] = np.arange(len(dense))
        z = np.zeros(omega.shape, np.float64)
        weighted = (idf[:, None] * omega).astype(np.float32)
        for b in K.pieces(batches, "text", 1 << 18):
            words, _, term = _words(b.column("text"))
            starts = _runs(words, passage)
            if not len(starts):
                continue
            of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(term)]))
            square = np.add.reduceat(idf[term] ** 2, starts)  # of the row's norm; repeats within a passage are rare
            often = column[term] >= 0
            counts = np.bincount(of[often] * len(dense) + column[term[often]], minlength=len(starts) * len(dense)).reshape(len(starts), len(dense)).astype(np.float32)
            y = counts @ weighted[dense]
            term, of = term[~often], of[~often]
            if len(term):
                heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                y[of[heads]] += np.add.reduceat(weighted[term], heads, axis=0)
            y /= square[:, None]
            z[dense] += counts.T @ y
            if len(term):
                order = np.argsort(term.astype(np.uint16), kind="stable")
                sorted_term = term[order]
                first = np.flatnonzero(np.r_[True, sorted_term[1:] != sorted_term[:-1]])
                z[sorted_term[first]] += np.add.reduceat(y[of[order]], first, axis=0)
        z *= idf[:, None]
        for i in range(0, TERMS, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([i // ROWS]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([z[i : i + ROWS].astype(np.float32).tobytes()], pa.binary())], names=["block", "part", "z"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table.column("z"))
    return pa.table({"block": table.column("block")[:1], "part": pa.array([table.column("part")[0].as_py() // FAN_IN]), "z": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def weights(df: np.ndarray, total: int, common: float) -> np.ndarray:
    """Inverse document frequencies, none below FLOOR; unseen terms weigh most, frequent ones least."""
    usual = df.sum() / max(1, np.count_nonzero(df))
    idf = np.maximum(np.log((total + 1) / (df + 1)), FLOOR)
    return np.where(df > max(common * total, 4 * usual), FLOOR, idf).astype(np.float32)


class Latent:
    """The latent vector of a term: idf * v / s, as a table of TERMS rows; and how many passages hold it."""

    def __init__(self, table: np.ndarray, df: np.ndarray):
        self.table, self.df = table, df

    @staticmethod
    def fit(docs: DataFrame, passage: int, rank: int, common: float, seed: int, work: Workspace) -> Latent:
        counted = docs.mapInArrow(_frequencies(passage), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most TERMS + 1 rows
        n = {r.term: r.n for r in counted}
        total, df = n.get(-1, 0), np.array([n.get(i, 0) for i in range(TERMS)])
        idf = weights(df, total, common)
        omega = np.random.RandomState(seed).standard_normal((TERMS, rank)).astype(np.float32)
        if not total:
            return Latent(np.zeros((TERMS, rank), np.float32), df)
        model = docs.sparkSession.sparkContext.broadcast((idf, omega, np.sort(np.argsort(-df, kind="stable")[:DENSE])))  # its size is fixed: TERMS * (rank + 1) numbers
        parts = work.table(docs.mapInArrow(_projected(passage, model), "block long, part long, z binary"), "z")
        while True:
            parts = work.table(parts.groupBy("block", F.expr(f"part div {FAN_IN}")).applyInArrow(_added, "block long, part long, z binary"), "z")
            if not parts.agg(F.max("part")).first()[0]:
                break
        z = np.zeros((TERMS, rank))
        for r in parts.collect():  # TERMS * rank numbers
            z[r.block * ROWS : (r.block + 1) * ROWS] = np.frombuffer(r.z, np.float32).reshape(ROWS, rank)
        model.destroy()
        shift = 1e-6 * np.linalg.norm(z)
        z += shift * omega
        core = omega.T @ z
        low = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) / rank * np.eye(rank))
        v, s, _ = np.linalg.svd(np.linalg.solve(low, z.T).T, full_matrices=False)
        return Latent((idf[:, None] * v / np.maximum(s, 1e-9 * s[0])).astype(np.float32), df)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


#: The least words in common order that tell a reworded item, where ``overlap`` does not ask for fewer.
REWORDED = 10


def _need(m: int, overlap: float, paraphrase: float) -> tuple[int, int]:
    """Words in common order that an item of m words must have: at any cosine, and at a large one."""
    most = max(1, int(np.ceil(overlap * m - 1e-9)))
    return most, min(most, max(REWORDED, int(np.ceil(paraphrase * m - 1e-9))))


class Queries:
    """A block of benchmark passages, by scale."""

    def __init__(self, items: list[tuple[int, str]], latent: Latent, overlap: float, paraphrase: float):
        self.parts: list[tuple[int, np.ndarray]] = []  # item, word hashes
        kinds: list[np.ndarray] = []
        scales, vectors, seeds = [], [], []
        for item, text in items:
            _, h, term = _words(pa.array([text or ""]))
            longest = SCALES[-1]
            for at in range(0, max(1, len(h) - longest // 2), longest):  # a short rest belongs to the part before it
                end = at + longest if len(h) - at - longest > longest // 2 else len(h)
                if len(h[at:end]):
                    m = end - at
                    need = _need(m, overlap, paraphrase)[1]
                    rare = np.argsort(latent.df[term[at:end]], kind="stable")[: m - need + min(SEEDS, need)]
                    seeds += [(x, len(self.parts)) for x in np.unique(h[at:end][rare]).tolist()]
                    scales.append(min(SCALES, key=lambda s: abs(np.log(s / m))))
                    vectors.append(latent.table[term[at:end]].sum(0))
                    self.parts.append((item, h[at:end]))
                    kinds.append(np.unique(term[at:end])[:64])
        self.kinds, self.bits = kinds, None
        self.size = np.array([len(h) for _, h in self.parts])
        self.different = np.array([len(k) for k in kinds])
        needs = np.array([_need(m, overlap, paraphrase) for m in self.size.tolist()], int).reshape(-1, 2)
        self.need, self.reworded = needs[:, 0], needs[:, 1]
        self.asked = np.minimum(SEEDS, self.reworded)
        self.scale = np.array(scales)
        self.stride = np.array([STRIDES[s] * BLOCK for s in scales])
        self.vectors = _unit(np.stack(vectors)).astype(np.float32) if vectors else np.zeros((0, latent.table.shape[1]), np.float32)
        # the index: words in order, and the parts of each
        seeds.sort()
        self.seed, heads = np.unique(np.array([w for w, _ in seeds], U), return_index=True)
        self.of_seed = np.array([p for _, p in seeds], np.int64)
        self.heads = np.r_[heads, len(seeds)]
        self.may = np.zeros(TERMS, bool)
        self.may[(self.seed >> U(64 - TERM_BITS)).astype(np.int64)] = True

    def marks(self) -> np.ndarray:
        """Of each part, a bit for each of its first 64 different terms; a worker makes them once."""
        if self.bits is None:
            self.bits = np.zeros((len(self.kinds), TERMS), U)
            for i, k in enumerate(self.kinds):
                self.bits[i, k] = U(1) << np.arange(len(k)).astype(U)
        return self.bits


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        m = masks.get(w, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


#: Candidates that are filtered at once.
CHUNK = 2048


def _held(queries: Queries, part: np.ndarray, low: np.ndarray, high: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The most words of the part that a stretch [low, high) can hold in order, from the part's terms that stand in it.

    A common subsequence of n of m words leaves m - n of them out, and with each at most one different term.
    """
    out = np.zeros(len(part), np.int64)
    for i in range(0, len(part), CHUNK):
        p, a, b = part[i : i + CHUNK], low[i : i + CHUNK], high[i : i + CHUNK]
        at = a[:, None] + np.arange(int((b - a).max()))
        bit = queries.marks().take(p[:, None] * TERMS + term.take(at, mode="clip"))
        bit[at >= b[:, None]] = 0
        found = np.bitwise_or.reduce(bit, axis=1)
        out[i : i + CHUNK] = np.bitwise_count(found).astype(np.int64) - queries.different[p] + queries.size[p]
    return out


def _candidates(h: np.ndarray, term: np.ndarray, first: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part, text, start of the windows whose stretch holds as many of the part's rarest words as the judge's overlap implies."""
    at = np.flatnonzero(queries.may[term])
    k = np.searchsorted(queries.seed, h[at])
    known = queries.seed.take(k, mode="clip") == h[at]
    at, k = at[known], k[known]
    n = queries.heads[k + 1] - queries.heads[k]
    place = np.repeat(at, n)
    part = queries.of_seed[np.repeat(queries.heads[k] - np.cumsum(n) + n, n) + np.arange(len(place))]
    order = np.argsort(part.astype(np.uint16) if len(queries.size) < 1 << 16 else part, kind="stable")
    part, place = part[order], place[order]
    m, asked = queries.size[part], queries.asked[part]
    reach = np.maximum(queries.scale[part], m) + 2 * (m // 2)  # words of a stretch
    then = np.arange(len(part)) + asked - 1
    inside = then < len(part)
    then = np.where(inside, then, 0)
    doc = np.searchsorted(first, place, "right") - 1
    here = np.flatnonzero(inside & (part[then] == part) & (place[then] - place < reach) & (place[then] < first[doc + 1]))
    part, doc, begin, end, m = part[here], doc[here], place[here], place[then[here]], m[here]
    head, stride = first[doc], queries.stride[part]
    low = np.maximum(0, -((head - (end - np.maximum(queries.scale[part], m) - m // 2 + 1)) // stride))
    high = np.minimum((begin + m // 2 - head) // stride, (first[doc + 1] - 1 - head) // stride)
    n = np.maximum(0, high - low + 1)
    of = np.repeat(np.arange(len(n)), n)
    start = head[of] + (low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * stride[of]
    code = np.unique(part[of] * (len(h) + 1) + start)
    part, start = np.divmod(code, len(h) + 1)
    return part, np.searchsorted(first, start, "right") - 1, start


def _cosines(part: np.ndarray, start: np.ndarray, end: np.ndarray, term: np.ndarray, latent: Latent, queries: Queries) -> np.ndarray:
    """Latent cosines of parts and windows [start, end)."""
    out = np.zeros(len(part))
    for i in range(0, len(part), CHUNK):
        p, a, n = part[i : i + CHUNK], start[i : i + CHUNK], (end - start)[i : i + CHUNK]
        heads = np.cumsum(n) - n
        window = np.add.reduceat(latent.table[term[np.repeat(a - heads, n) + np.arange(n.sum())]], heads, axis=0)
        out[i : i + CHUNK] = np.einsum("ij,ij->i", _unit(window), queries.vectors[p])
    return out


def _leaks_of(text: pa.Array, latent: Latent, queries: Queries, cosine: float, answer: float) -> dict[tuple[int, int], tuple]:
    """(text, item) -> overlap, cosine, place of the best stretch, for each leak in the texts."""
    words, h, term = _words(text)
    if not len(h) or not len(queries.size):
        return {}
    part, doc, start = _candidates(h, term, words.first, queries)
    m = queries.size[part]
    low = np.maximum(words.first[doc], start - m // 2)
    high = np.minimum(words.first[doc + 1], start + np.maximum(queries.scale[part], m) + m // 2)
    held = _held(queries, part, low, high, term)
    some = np.flatnonzero(held >= queries.reworded[part])
    part, doc, start, low, high, held = part[some], doc[some], start[some], low[some], high[some], held[some]
    near = _cosines(part, start, np.minimum(start + queries.scale[part], words.first[doc + 1]), term, latent, queries)
    need = np.where(near >= cosine, queries.reworded[part], queries.need[part])
    some = np.flatnonzero(held >= need)
    part, doc, start, low, high, near, need = part[some], doc[some], start[some], low[some], high[some], near[some], need[some]
    best: dict[tuple[int, int], tuple] = {}
    for k in np.argsort(-near, kind="stable").tolist():
        item, item_words = queries.parts[part[k]]
        key, stretch = (int(doc[k]), item), h[low[k] : high[k]]
        if key in best and best[key][0] == 1.0:
            continue
        length = in_common(item_words, stretch)
        shared = length / len(item_words)
        if length >= need[k] and (key not in best or shared > best[key][0]):
            tail = item_words[-max(3, len(item_words) // 4) :]
            if in_common(tail, stretch) >= answer * len(tail):
                best[key] = (shared, float(near[k]), int(start[k] - words.first[doc[k]]))
    return best


def _search(model, cosine: float, answer: float):
    """One row for each leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, queries = model.value
        for b in K.pieces(batches, "text", 1 << 18):
            best = _leaks_of(b.column("text"), latent, queries, cosine, answer)
            if best:
                docs = pa.array([k[0] for k in best])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(docs), b.column("body").take(docs), pa.array([k[1] for k in best]), pa.array([v[0] for v in best.values()]), pa.array([v[1] for v in best.values()]), pa.array([v[2] for v in best.values()])],
                    names=["doc_id", "body", "item_id", "overlap", "cosine", "place"],
                )

    return run


def _judged(model, cosine: float, answer: float):
    """One row for each document, in one pass: how many items leak, and the item of the largest overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, queries = model.value
        for b in K.pieces(batches, "text", 1 << 18):
            count, top = [0] * b.num_rows, [None] * b.num_rows
            for (doc, item), (shared, _, _) in _leaks_of(b.column("text"), latent, queries, cosine, answer).items():
                count[doc] += 1
                top[doc] = max(top[doc] or (0.0, 0), (shared, -item))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(count, pa.int64()), pa.array([t and -t[1] for t in top], pa.int64()), pa.array([t and t[0] for t in top], pa.float64())],
                names=["doc_id", "n_items", "item_id", "overlap"],
            )

    return run


def leaked_items(docs: DataFrame, benchmark: DataFrame, work: Workspace, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", passage: int = 64, rank: int = 48, common: float = 0.01, overlap: float = 0.6, paraphrase: float = 0.45, cosine: float = 0.5, answer: float = 0.5, block: int = 512, seed: int = 9) -> DataFrame:
    """doc_id, body, item_id, overlap (part of the item's words in common order), cosine, place (word): one row for each leak."""
    source = _source(docs, id_col, text_col).filter("text IS NOT NULL")
    kind = source.schema["doc_id"].dataType.simpleString()
    out = None
    for model, _ in _blocks(source, benchmark, work, item_col, item_text_col, passage, rank, common, overlap, paraphrase, block, seed):
        found = work.table(source.mapInArrow(_search(model, cosine, answer), f"doc_id {kind}, body long, item_id long, overlap double, cosine double, place long"), "leaks")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, body long, item_id long, overlap double, cosine double, place long")
    return out


def _blocks(source: DataFrame, benchmark: DataFrame, work: Workspace, item_col: str, item_text_col: str, passage: int, rank: int, common: float, overlap: float, paraphrase: float, block: int, seed: int):
    """The query set in blocks of bounded size, in the order of its identifiers: (broadcast model and queries, whether it is all)."""
    name = F.col(item_col).cast("string")
    surrogate = -1 - F.shiftrightunsigned(F.xxhash64(name, F.col(item_text_col)), 1)
    items = benchmark.select(F.coalesce(name.try_cast("long"), surrogate).alias("item_id"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL").distinct()
    latent = after = None
    while True:
        part = items if after is None else items.filter((F.col("item_id") > after[0]) | ((F.col("item_id") == after[0]) & (F.col("text") > after[1])))
        rows = part.orderBy("item_id", "text").limit(block + 1).collect()
        if not rows:
            return
        whole = after is None and len(rows) <= block
        last, rows = len(rows) <= block, rows[:block]
        after = tuple(rows[-1])
        latent = latent or Latent.fit(source, passage, rank, common, seed, work)
        yield source.sparkSession.sparkContext.broadcast((latent, Queries([tuple(r) for r in rows], latent, overlap, paraphrase))), whole
        if last:
            return


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("body"), F.col(text_col).alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", passage: int = 64, rank: int = 48, common: float = 0.01, overlap: float = 0.6, paraphrase: float = 0.45, cosine: float = 0.5, answer: float = 0.5, block: int = 512, seed: int = 9) -> DataFrame:
    """One row per row of docs: doc_id, n_items, item_id (of the largest overlap), overlap, kept.

    kept is false for documents in which some benchmark item stands: at least ``overlap`` of its words in order, or
    ``paraphrase`` of them (and ten words) where the latent cosine of window and item reaches ``cosine``, and ``answer``
    of those it ends with, all within half its length of a window of its length. Windows start every few words. Words are
    runs of letters and digits, folded to lower case. An item that is longer than the largest window is searched in
    parts, and one found part counts. Null and empty texts, and an empty benchmark, leave everything kept; so do items
    without a text or words. An item whose identifier is null or no integer is searched like any other, under a negative
    number made from its identifier and text. Ties go to the smaller item. Rows that repeat an identifier are told apart
    by their texts; null identifiers are allowed. Other columns are not read.
    """
    with Workspace(docs.sparkSession, "decontam") as work:
        source = _source(docs, id_col, text_col)
        kind = source.schema["doc_id"].dataType.simpleString()
        for model, whole in _blocks(source.filter("text IS NOT NULL"), benchmark, work, "item_id", "text", passage, rank, common, overlap, paraphrase, block, seed):
            if whole:  # the usual case: one block of queries, and so one pass that judges every row where it stands
                judged = source.drop("body").mapInArrow(_judged(model, cosine, answer), f"doc_id {kind}, n_items long, item_id long, overlap double")
                return judged.withColumn("kept", F.col("n_items") == 0)
            break
        how = {"passage": passage, "rank": rank, "common": common, "overlap": overlap, "paraphrase": paraphrase, "cosine": cosine, "answer": answer, "block": block, "seed": seed}
        found = leaked_items(docs, benchmark, work, id_col=id_col, text_col=text_col, **how)
        best = found.groupBy("doc_id", "body").agg(F.countDistinct("item_id").alias("n_items"), F.max(F.struct("overlap", (-F.col("item_id")).alias("minus"))).alias("best"))
        best = work.keep(best.select(F.col("doc_id").alias("of"), F.col("body").alias("of_body"), "n_items", (-F.col("best.minus")).alias("item_id"), F.col("best.overlap").alias("overlap")))
    rows = _source(docs, id_col, text_col).drop("text")
    joined = rows.join(best, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("body") == F.col("of_body")), "left")
    return joined.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", "overlap", F.col("of_body").isNull().alias("kept"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, that decontaminate keeps."""
    with Workspace(docs.sparkSession, "decontam") as work:
        found = leaked_items(docs, benchmark, work, id_col=id_col, text_col=text_col, **how)
        bad = work.keep(found.select(F.col("doc_id").alias("of"), F.col("body").alias("of_body")).distinct())
    whole = docs.select(F.struct("*").alias("whole"))
    kept = whole.join(bad, F.col(f"whole.{id_col}").eqNullSafe(F.col("of")) & (F.xxhash64(F.col(f"whole.{text_col}")) == F.col("of_body")), "left_anti")
    return kept.select(*(F.col("whole").getField(c).alias(c) for c in docs.columns))
