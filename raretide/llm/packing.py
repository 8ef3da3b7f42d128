"""Mixture-controlled packing of tokenised documents into sequences of a fixed length.

Each source is a queue of documents, cut into chunks of at most ``quantum`` tokens. In every round a source earns
``length * share`` tokens of credit and sends the chunks its credit covers; what it could not send stays with it as a
deficit (deficit round-robin). A chunk whose end lies ``e`` tokens into its queue is therefore sent in round
``ceil(e / (length * share))``: the state that rounds and partitions hand on is a prefix sum of the queue, and the whole
schedule is a few aggregates over small rows. Rounds, sources within a round, and queue order give one stream of
tokens, which is cut every ``length`` tokens: all sequences are full but the last.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raretide.llm import kernels as K
from raretide.llm.workspace import Workspace

U = np.uint64
#: Rounds whose tokens are summed up as one block in the prefix sum over rounds.
BLOCK = 65536
#: Entries after which a worker's memo of encoded units starts anew.
MEMO = 1_000_000
#: Letters (bytes above ASCII are looked at again), then symbols; an apostrophe may bind letters to the tokenizer.
LETTERS_SYMBOLS = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
LETTER, SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SYMBOL[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class Memo:
    """Token ids of units of text, by two independent 64-bit hashes of a unit: an open-addressing table in arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.key = np.zeros((2, 1 << bits), U)
        self.entry = np.full(1 << bits, -1, np.int32)
        self.first, self.size = np.zeros(1 << bits - 1, np.int64), np.zeros(1 << bits - 1, np.int32)
        self.ids, self.used = np.zeros(1 << bits, np.uint32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each pair of hashes (2 x n), -1 where there is none."""
        out = np.full(h.shape[1], -1, np.int32)
        slot, left = (h[0] >> U(64 - self.bits)).astype(np.int64), np.arange(h.shape[1])
        while len(left):
            e = self.entry[slot]
            hit = (self.key[0, slot] == h[0, left]) & (self.key[1, slot] == h[1, left]) & (e >= 0)
            out[left[hit]] = e[hit]
            on = ~hit & (e >= 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot, left = (h[0] >> U(64 - self.bits)).astype(np.int64), np.arange(h.shape[1])
        while len(left):
            free = np.flatnonzero(self.entry[slot] < 0)
            at, who = np.unique(slot[free], return_index=True)
            taken = left[free[who]]
            self.key[:, at], self.entry[at] = h[:, taken], entry[taken]
            on = np.ones(len(left), bool)
            on[free[who]] = False
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """New, distinct pairs of hashes and the ids of each."""
        n = self.count + len(ids)
        if 2 * n > 1 << self.bits:
            live = np.flatnonzero(self.entry >= 0)
            key, entry = self.key[:, live], self.entry[live]
            self.bits = max(self.bits + 1, (2 * n).bit_length())
            self.key, self.entry = np.zeros((2, 1 << self.bits), U), np.full(1 << self.bits, -1, np.int32)
            self._place(key, entry)
            self.first, self.size = np.resize(self.first, 1 << self.bits - 1), np.resize(self.size, 1 << self.bits - 1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(flat)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[self.count : n], self.size[self.count : n] = self.used + np.cumsum(sizes) - sizes, sizes
        self._place(h, np.arange(self.count, n, dtype=np.int32))
        self.count, self.used = n, self.used + len(flat)


class Encoder:
    """Token ids of whole texts; equal to encoding each text at once.

    The tokenizer drops white space and never joins over it, so texts are encoded by their ASCII-space-free chunks. It
    folds ASCII letters, takes a run of them as one word, and symbols that follow as words of their own: such a chunk
    is two units, its folded letters and its symbols, any other chunk is one. Each different unit is encoded once.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.narrow = max(vocabulary.values()) < 1 << 16
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo = Memo()
        self.parts: dict[bytes, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's own, kept from task to task."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _single(self, chunks: list[bytes]) -> list[list[int]]:
        return [self.tokenizer.encode(c.decode(), add_special_tokens=False).ids for c in chunks]

    def _letters(self, chunks: list[bytes]) -> list[list[int]]:
        """Words of letters: encoded as one string, and parted at the tokens that end a word."""
        out = []
        for at in range(0, len(chunks), 1000):
            some = chunks[at : at + 1000]
            ids = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids
            ends = (np.flatnonzero(self.closing[ids]) + 1).tolist()
            if len(ends) != len(some) or ends[-1] != len(ids):
                out += self._single(some)
            else:
                out += [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        return out

    def _plain(self, words: list[bytes]) -> list[list[int]]:
        """Folded ASCII letters: one word each, which the tokenizer's model takes as it is."""
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(w.decode())] for w in words]

    def _other(self, chunks: list[bytes]) -> list[list[int]]:
        """Chunks that are not plain letters; letters beyond ASCII and the symbols after them are encoded apart."""
        if len(self.parts) > MEMO // 10:
            self.parts.clear()
        cut, letters, rest = [], set(), set()
        for c in chunks:
            found = LETTERS_SYMBOLS(c)
            stem, end = found.groups() if found and found[1].decode().isalpha() else (b"", c)
            cut.append((stem, end))
            if stem and stem not in self.parts:
                letters.add(stem)
            if end and end not in self.parts:
                rest.add(end)
        self.parts.update(zip(letters, self._letters(list(letters)), strict=True))
        self.parts.update(zip(rest, self._single(list(rest)), strict=True))
        return [(self.parts[stem] if stem else []) + (self.parts[end] if end else []) for stem, end in cut]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the end of each text's."""
        words = K.Words(texts, K.SPACES, K.SAME)
        raw, start, end = words.bytes, words.start, words.start + words.size
        other = np.flatnonzero(~LETTER[raw])  # bytes
        stem = np.minimum(np.r_[other, len(raw)][np.searchsorted(other, start)], end)
        odd = np.r_[0, np.cumsum(~SYMBOL[raw])]
        plain = (stem > start) & (odd[end] == odd[stem])
        two = plain & (stem < end)
        # units: the letters of a plain chunk and its symbols; any other chunk as it is
        at = np.repeat(np.arange(len(start)), 1 + two)
        second = np.r_[False, at[1:] == at[:-1]]
        low = np.where(second, stem[at], start[at])
        high = np.where(plain[at] & ~second, stem[at], end[at])
        letters = plain[at] & ~second
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[low[letters]] += 1  # no two begin or end at one place
        inside[high[letters]] -= 1
        words.bytes = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, K.LOWER[raw], raw)
        words.start, words.size = low, high - low
        h = np.stack([words.hashes(0), words.hashes(1)])
        if self.memo.count > MEMO:
            self.memo = Memo()
        entry = self.memo.find(h)
        while len(new := np.flatnonzero(entry < 0)):
            _, one = np.unique(h[0, new], return_index=True)
            new = new[one]
            data, ends = words.bytes.tobytes(), high[new].tolist()
            units = [data[i:j] for i, j in zip(low[new].tolist(), ends, strict=True)]
            plain_one = letters[new]
            for mine, learn in ((plain_one, self._plain), (~plain_one, self._other)):
                which = np.flatnonzero(mine)
                if len(which):
                    self.memo.add(h[:, new[which]], learn([units[i] for i in which.tolist()]))
            entry[entry < 0] = self.memo.find(h[:, entry < 0])
        n = self.memo.size[entry].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.memo.ids[np.repeat(self.memo.first[entry] - ends + n, n) + np.arange(int(n.sum()))]
        chunks = np.searchsorted(at, words.first[1:])  # units before the end of each text
        return ids, np.r_[0, ends][chunks]


def _tokens(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, encode = TaskContext.get().partitionId(), 0, Encoder.of(path)
        width = np.dtype("<u2" if encode.narrow else "<u4")
        for b in K.pieces(batches, "text", 1 << 19):
            ids, ends = encode(b.column("text"))
            n = len(ends)
            whole = np.insert(ids, ends, end_id).astype(width)
            offsets = np.r_[0, ends + np.arange(1, n + 1)]
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * width.itemsize).astype(np.int32).tobytes()), pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n, dtype=np.int64)), b.column("doc_id"), b.column("source"), pa.array(np.diff(offsets)), packed],
                names=["part", "row", "doc_id", "source", "doc_tokens", "ids"],
            )
            row += n

    return run


def _cut(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = "<u2" if Encoder.of(path).narrow else "<u4"
        for b in batches:
            for at in range(0, b.num_rows, 50):
                c = b.slice(at, 50)
                cuts = c.column("cuts")
                which = np.repeat(np.arange(len(cuts)), np.diff(cuts.offsets.to_numpy()))
                start, length, sequence, offset = (cuts.flatten().field(i).to_numpy() for i in range(4))
                ids = [np.frombuffer(x.as_buffer(), width).astype("<u4") for x in c.column("ids")]
                cut = [ids[w][s : s + n].tobytes() for w, s, n in zip(which, start, length, strict=True)]
                of = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id").take(of), c.column("source").take(of), pa.array(start), pa.array(length), pa.array(cut, pa.binary()), c.column("doc_tokens").take(of), pa.array(sequence), pa.array(offset)],
                    names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def pack(docs: DataFrame, tokenizer: str, *, length: int = 2048, quantum: int = 256, end_id: int = 1, shares: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its token ids and then ``end_id``; null and empty texts are that one id. Each id lies in exactly one
    piece, and offsets within a sequence have no gaps. ``shares`` (source, share > 0) are the target proportions; by
    default each source's own part of all tokens, so that every queue lasts to the end. Sources that it lacks, and
    null ones where it has no null, follow after all others. A queue that ends early leaves its credit to the rest.
    ``quantum`` (at most ``length``) bounds how far a source may run behind its target. Null sources are one queue;
    rows that repeat an identifier are packed as rows of their own. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    kinds = {c: t for c, t in source.dtypes}
    with Workspace(docs.sparkSession, "packing") as work:
        tokens = source.mapInArrow(_tokens(tokenizer, end_id), f"part int, row long, doc_id {kinds['doc_id']}, source {kinds['source']}, doc_tokens long, ids binary")
        tokens = work.keep(tokens)  # part and row name a document only as long as nothing computes them anew
        schedule = _schedule(tokens.drop("ids"), shares, length, quantum)
        cuts = work.keep(schedule.groupBy("part", "row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts")))
        pieces = tokens.join(cuts, ["part", "row"]).mapInArrow(_cut(tokenizer), f"doc_id {kinds['doc_id']}, source {kinds['source']}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
        return pieces


def _schedule(rows: DataFrame, shares: DataFrame | None, length: int, quantum: int) -> DataFrame:
    """part, row, start, length, sequence_id, offset of every piece."""
    by_part = rows.groupBy("source", "part").agg(F.sum("doc_tokens").alias("tokens"))
    totals = by_part.groupBy("source").agg(F.sum("tokens").alias("queue"))
    if shares is None:
        totals = totals.withColumn("share", F.col("queue").cast("double"))
    else:
        named = shares.groupBy(F.col("source").alias("named")).agg(F.max("share").cast("double").alias("share"))
        totals = totals.join(named, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
    whole = totals.agg(F.sum("share").alias("shares"), F.max(F.when(F.col("share") > 0, F.ceil(F.col("queue") / F.col("share")))).alias("last"))
    # one row: the sum of shares and a round after the last of the named sources
    totals = totals.join(whole, F.lit(True)).select("source", (length * F.col("share") / F.col("shares")).alias("credit"), F.coalesce(F.ceil(F.col("last") * F.col("shares") / length), F.lit(0)).alias("later"))
    passed = F.sum("tokens").over(W.partitionBy("source").orderBy("part")) - F.col("tokens")
    prefix = by_part.withColumn("passed", passed).join(totals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "tokens")
    prefix = prefix.withColumnsRenamed({"source": "of", "part": "in"})
    local = F.sum("doc_tokens").over(W.partitionBy("source", "part").orderBy("row")) - F.col("doc_tokens")
    queued = rows.withColumn("local", local).join(prefix, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    chunks = queued.select("part", "row", "source", "credit", "later", (F.col("passed") + F.col("local")).alias("before"), "doc_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(quantum).cast("long"))).alias("start"))
    chunks = chunks.withColumn("length", F.least(F.lit(quantum).cast("long"), F.col("doc_tokens") - F.col("start"))).withColumn("at", F.col("before") + F.col("start"))
    end = F.col("at") + F.col("length")
    sent = F.when(F.col("credit") > 0, F.ceil(end / F.col("credit"))).otherwise(F.col("later") + F.ceil(end / length))
    chunks = chunks.select("part", "row", "source", "start", "length", "at", sent.cast("long").alias("round"))
    rounds = chunks.groupBy("round").agg(F.sum("length").alias("tokens")).withColumn("block", F.expr(f"round div {BLOCK}"))
    blocks = rounds.groupBy("block").agg(F.sum("tokens").alias("tokens"))
    blocks = blocks.select("block", (F.sum("tokens").over(W.orderBy("block")) - F.col("tokens")).alias("base"))
    rounds = rounds.withColumn("inner", F.sum("tokens").over(W.partitionBy("block").orderBy("round")) - F.col("tokens"))
    rounds = rounds.join(blocks, "block").select("round", (F.col("base") + F.col("inner")).alias("base"))
    turn = W.partitionBy("round").orderBy("source", "at")
    stream = chunks.join(rounds, "round").withColumn("g", F.col("base") + F.sum("length").over(turn) - F.col("length"))
    cut = stream.select("*", F.explode(F.expr(f"sequence(g div {length}, (g + length - 1) div {length})")).alias("sequence_id"))
    low, high = F.greatest("g", F.col("sequence_id") * length), F.least(F.col("g") + F.col("length"), (F.col("sequence_id") + 1) * length)
    return cut.select("part", "row", (F.col("start") + low - F.col("g")).alias("start"), (high - low).alias("length"), "sequence_id", (low - F.col("sequence_id") * length).alias("offset"))
