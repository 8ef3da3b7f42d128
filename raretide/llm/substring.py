"""Removal of long passages that an earlier document already has, by compaction of a word-level de Bruijn graph.

Edges of the graph are all runs of ``window`` consecutive words (k-mers). They are never written one by one:

1. Within a document, neighbouring edges whose smallest ``seed``-word hash stands at the same place form one segment
   (a super-k-mer), named by two 64-bit hashes of its words. Equal edges have equal seeds, so equal paths give equal
   segments, and a segment stands for up to ``window - seed + 1`` edges.
2. One aggregate over segments gives the smallest and largest document that holds each, and its neighbours' names.
   Joins of repeated segments with their only successors, where those have no other predecessor, mark the
   nonbranching links; document ends count as branches. Linked segments of a document compact to one path.
3. Where a seed stands in several different segments the graph branches. Only there are single edges looked at: one
   copy of each such segment, taken from its source coordinates, is cut into edges, which are named by a BLAKE2b digest
   of their words, and their earliest documents are found.
4. Every compacted path is verified: the words at its source coordinates are read again, and the path counts only in
   documents whose own words have the same digest (128 bits).
5. Words of a document that a verified path or an edge covers which also starts in a smaller document go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raretide.llm import kernels as K
from raretide.llm.workspace import Workspace

U = np.uint64


def _first_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """For each place the index of the first minimum of the ``width`` values from there."""
    at = np.arange(len(v), dtype=np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = v[:-step], v[step:]
        take = left <= right
        v, at = np.where(take, left, right), np.where(take, at[:-step], at[step:])
        span += step
    return at


class Spans:
    """Two independent hashes of any run of words.

    Runs of 2, 4, 8 .. words are hashed pair by pair, a bijective mix at each step, once for all places; a run of any
    length is the chain of those that its length consists of.
    """

    def __init__(self, words: K.Words, longest: int):
        self.levels = []
        for which in (0, 1):
            level = [words.hashes(which)]
            for k in range(min(longest, max(1, len(level[0]))).bit_length() - 1):
                last, step = level[-1], 1 << k
                with np.errstate(over="ignore"):
                    level.append(K.mix(last[:-step] * K.BASE + last[step:]))
            self.levels.append(level)

    def __call__(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for level in self.levels:
            value, at = length.astype(U), start.copy()
            for k in range(len(level) - 1, -1, -1):
                has = np.flatnonzero(length >> k & 1)
                with np.errstate(over="ignore"):
                    value[has] = K.mix(value[has] * K.BASE2 + level[k][at[has]])
                at[has] += 1 << k
            out.append(value.view(np.int64))
        return tuple(out)


def _segments(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches, "text"):
            words = K.Words(b.column("text"), K.SPACES, K.SAME)
            h = words.hashes()
            if len(h) < window:
                continue
            grams, _ = K.rolling(h, seed, words.first)
            at = _first_minimum(grams, window - seed + 1)
            owner = words.text_of()
            ends = words.first[1:][owner]
            starts = np.flatnonzero(np.arange(len(at)) + window <= ends[: len(at)])
            if not len(starts):
                continue
            seeds = at[starts]
            head = np.flatnonzero(np.r_[True, (seeds[1:] != seeds[:-1]) | (owner[starts][1:] != owner[starts][:-1])])
            first, count = starts[head], np.diff(np.r_[head, len(starts)])
            key1, key2 = Spans(words, 2 * window - seed)(first, count + window - 1)
            doc = owner[first]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(doc)),
                    b.column("body").take(pa.array(doc)),
                    pa.array((first - words.first[doc]).astype(np.int32)),
                    pa.array(count.astype(np.int16)),
                    pa.array(grams[seeds[head]].view(np.int64)),
                    pa.array(key1),
                    pa.array(key2),
                ],
                names=["doc_id", "body", "place", "edges", "seed", "key1", "key2"],
            )

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _split(text: pa.StringScalar) -> list[bytes]:
    return (text.as_py() or "").encode().split()


def _edges(window: int):
    """Rows doc_id, text, cuts (array of place, edges, key1, key2) -> one row for each edge of the segments named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches, "text"):
            doc, key1, key2, nth, digests = [], [], [], [], []
            for i, (text, cuts) in enumerate(zip(b.column("text"), b.column("cuts"), strict=True)):
                words = _split(text)
                line = b" ".join(words)
                starts = np.cumsum([0, *(len(w) + 1 for w in words)])
                place, count, k1, k2 = (cuts.values.field(j).to_numpy() for j in range(4))
                row = np.repeat(np.arange(len(place)), count)
                j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = place[row] + j
                digests += [hashlib.blake2b(line[x:y], digest_size=16).digest() for x, y in zip(starts[first].tolist(), (starts[first + window] - 1).tolist(), strict=True)]
                doc.append(np.full(len(row), i))
                key1.append(k1[row])
                key2.append(k2[row])
                nth.append(j)
            if not digests:
                continue
            names = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(np.concatenate(doc))), pa.array(np.concatenate(key1)), pa.array(np.concatenate(key2)), pa.array(np.concatenate(nth).astype(np.int32)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())],
                names=["doc_id", "key1", "key2", "nth", "edge1", "edge2"],
            )

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, body, text, asked (array of place, size) -> the digest of the words at each of these coordinates."""
    for b in K.pieces(batches, "text"):
        which, place, size, digests = [], [], [], []
        for i, (text, asked) in enumerate(zip(b.column("text"), b.column("asked"), strict=True)):
            words = _split(text)
            for at, n in zip(asked.values.field(0).to_pylist(), asked.values.field(1).to_pylist(), strict=True):
                which.append(i)
                place.append(at)
                size.append(n)
                digests.append(_digest(words[at : at + n]))
        of = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("body").take(of), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(digests, pa.binary())], names=["source_id", "source_body", "source_place", "size", "digest"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, text, gone (array of start, end in words, digest of the source's words; or null) -> counts and what stays."""
    for b in K.pieces(batches, "text"):
        rows = []
        for text, gone in zip(b.column("text"), b.column("gone"), strict=True):
            words = _split(text)
            n = len(words)
            if gone.is_valid and len(gone):
                drop = np.zeros(n + 1, np.int32)
                for start, end, digest in zip(*(gone.values.field(i).to_pylist() for i in range(3)), strict=True):
                    if digest is None or digest == _digest(words[start:end]):
                        drop[start] += 1
                        drop[end] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
            kept = b" ".join(words)
            rows.append((n, n - len(words), kept.decode(), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """body tells rows apart that share an identifier."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("body"))


def repeated_passages(docs: DataFrame, work: Workspace, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = 8) -> DataFrame:
    """doc_id, body, start, end (words), source_id, digest: compacted runs of words of a document that a smaller one also has.

    Runs may overlap by less than ``window`` words; their union is what every repeated edge covers. source_id is the
    smallest document that holds the run's segments, and digest that of the words there; both are null where the run
    is a single edge, whose name is a digest itself.
    """
    source = _source(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    kind = source.schema["doc_id"].dataType.simpleString()
    segments = work.table(source.mapInArrow(_segments(window, seed), f"doc_id {kind}, body long, place int, edges short, seed long, key1 long, key2 long"), "segments")
    # equal segments have equal seeds: a seed within one document clears all its segments
    # (written first, so that the join stands alone in its stage and a hot seed's rows can be split)
    seeds = work.table(segments.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("seed"), "seeds")
    everything, segments = segments, work.table(segments.join(seeds, "seed"), "candidates")
    work.drop(everything)
    nodes = segments.groupBy("key1", "key2").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last_id"), F.min("seed").alias("seed"))
    nodes = work.table(nodes, "nodes")
    repeated = nodes.filter("source_id < last_id")
    # neighbours of repeated segments in their documents; 0: a document's end, or a segment that does not repeat
    by_doc = W.partitionBy("doc_id", "body").orderBy("place")
    found = segments.select("doc_id", "body", "place", "edges", "key1", "key2").join(repeated.select("key1", "key2", "source_id"), ["key1", "key2"])
    adjoins = F.col("place") + F.col("edges") == F.lead("place").over(by_doc)
    follows = F.lag(F.col("place") + F.col("edges")).over(by_doc) == F.col("place")
    found = found.withColumns({"after": F.when(adjoins, F.lead("key1").over(by_doc)).otherwise(0), "before": F.when(follows, F.lag("key1").over(by_doc)).otherwise(0)})
    found = work.table(found, "found")
    turns = found.groupBy("key1", "key2").agg(*(f(c).alias(f"{c}_{name}") for c in ("before", "after") for f, name in ((F.min, "lo"), (F.max, "hi"))))
    # a link holds where the only successor has this as its only predecessor
    ahead = turns.filter("after_lo = after_hi AND after_lo <> 0").select("key1", "key2", F.col("after_lo").alias("next"))
    behind = turns.filter("before_lo = before_hi AND before_lo <> 0").select(F.col("key1").alias("next"), F.col("before_lo").alias("key1"))
    linked = work.table(ahead.join(behind, ["next", "key1"]).select("key1", "key2").distinct().withColumn("linked", F.lit(True)), "linked")

    forks = nodes.groupBy("seed").agg(F.min("key1").alias("lo1"), F.max("key1").alias("hi1"), F.min("key2").alias("lo2"), F.max("key2").alias("hi2")).filter("lo1 <> hi1 OR lo2 <> hi2").select("seed")
    forked = nodes.join(forks, "seed").select("key1", "key2", F.col("source_id").alias("doc_id"))
    # source coordinates: the first place of the segment in its smallest document
    copies = segments.join(forked, ["key1", "key2", "doc_id"]).groupBy("key1", "key2", "doc_id").agg(F.min(F.struct("body", "place", "edges")).alias("at")).select("key1", "key2", "doc_id", "at.*")
    cuts = copies.groupBy("doc_id", "body").agg(F.collect_list(F.struct("place", "edges", "key1", "key2")).alias("cuts"))
    edges = source.join(cuts, ["doc_id", "body"]).mapInArrow(_edges(window), f"doc_id {kind}, key1 long, key2 long, nth int, edge1 long, edge2 long")
    edges = work.table(edges, "edges")
    earliest = edges.groupBy("edge1", "edge2").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")).filter("earliest < latest")
    earlier = edges.join(earliest, ["edge1", "edge2"]).filter("earliest < doc_id").groupBy("key1", "key2").agg(F.array_sort(F.collect_set("nth")).alias("nths"))
    earlier = work.table(earlier, "earlier")

    whole = found.select("doc_id", "body", "place", "edges", "key1", "key2", "source_id").filter("doc_id > source_id").join(linked, ["key1", "key2"], "left")
    ends_before = F.lag(F.col("place") + F.col("edges")).over(by_doc)
    starts = F.when((F.lag("linked").over(by_doc)) & (ends_before == F.col("place")) & (F.lag("source_id").over(by_doc) == F.col("source_id")), 0).otherwise(1)
    paths = whole.withColumn("starts", starts).withColumn("nth_path", F.sum("starts").over(by_doc))
    paths = paths.groupBy("doc_id", "body", "nth_path").agg(F.min("place").alias("start"), (F.max(F.col("place") + F.col("edges")) + window - 1).alias("end"), F.min("source_id").alias("source_id"), F.min_by(F.struct("key1", "key2"), "place").alias("path"))
    paths = paths.select("doc_id", "body", "start", "end", "source_id", "path.*", (F.col("end") - F.col("start")).cast("int").alias("size"))
    # the source coordinates of a path are those of its first segment: its links have no other successor there either
    at = found.filter("doc_id = source_id").groupBy("key1", "key2").agg(F.min(F.struct("body", "place")).alias("at")).select("key1", "key2", F.col("at.body").alias("source_body"), F.col("at.place").alias("source_place"))
    paths = work.table(paths.join(work.table(at, "sources"), ["key1", "key2"]), "paths")
    places = paths.select(F.col("source_id").alias("doc_id"), F.col("source_body").alias("body"), "source_place", "size").distinct()
    asked = places.groupBy("doc_id", "body", F.expr("source_place div 256")).agg(F.collect_list(F.struct("source_place", "size")).alias("asked")).select("doc_id", "body", "asked")
    coordinates = ["source_id", "source_body", "source_place", "size"]
    digests = work.table(source.join(asked, ["doc_id", "body"]).mapInArrow(_passages, f"source_id {kind}, source_body long, source_place int, size int, digest binary").dropDuplicates(coordinates), "digests")
    paths = paths.join(digests, coordinates).select("doc_id", "body", "start", "end", "source_id", "digest")
    single = segments.select("doc_id", "body", "place", "key1", "key2").join(earlier, ["key1", "key2"]).join(nodes.select("key1", "key2", "source_id"), ["key1", "key2"]).filter("doc_id = source_id")
    single = single.select("doc_id", "body", F.explode("nths").alias("nth"), "place").select("doc_id", "body", (F.col("place") + F.col("nth")).alias("start"), (F.col("place") + F.col("nth") + window).alias("end"), F.lit(None).cast(kind).alias("source_id"), F.lit(None).cast("binary").alias("digest"))
    return paths.unionByName(single)


def drop_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null and empty texts have none. A word goes if a run of ``window``
    words of its document covers it whose words also start in a document with a smaller identifier; runs are judged
    on the input. Shorter texts stay whole. Repeats within one document, or within rows that share an identifier, are
    not touched. Rows with a null identifier stay whole and are no
    source. Other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    with Workspace(docs.sparkSession, "substring") as work:
        found = repeated_passages(docs, work, id_col=id_col, text_col=text_col, window=window, seed=seed)
        gone = work.keep(found.groupBy("doc_id", "body").agg(F.collect_list(F.struct("start", "end", "digest")).alias("gone")))
    return _source(docs, id_col, text_col).join(gone, ["doc_id", "body"], "left").mapInArrow(_removed, f"doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
