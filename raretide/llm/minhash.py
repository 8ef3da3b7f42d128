"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star candidates.

One hash of each distinct shingle fills one bin of the signature; an empty bin copies the first filled bin of its own
fixed random order (optimal densification), so bins of two sets agree with the probability of their similarity.
Bands of the signature are bucket keys. Equal sets are one class, so copies never meet in a bucket. In a bucket every
member is compared with a centre only, the member with the fewest shingles of its own, so candidate pairs are linear in
members; each is confirmed on the full sets.

A star alone can miss a link between two members that are both unlike the centre. Two exact bounds leave little to look
for: shingles that no other member holds can be in no intersection, so that most documents have no room for any partner;
and of two similar sets the rarest shingles (a quarter and one of the larger, a seventh and one of the smaller) have one
in common. Every member carries the component that the stars' links have put it in as its label; members of different labels
that share a rare shingle are compared, those of the shingle's largest component with the others, never with one another.
A group whose stars have joined it, as templates with few changes are, makes no such pair at all. No link inside a bucket
is lost. What those last pairs cost grows with the square of a group only where its members stay apart: alike enough to
share nearly all shingles, yet under the similarity asked for.

With 40 bands of 5 bins a pair at similarity 0.75 shares no bucket with probability 2e-5, at 0.8 with 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raretide.llm import kernels as K
from raretide.llm.components import connected_components
from raretide.llm.workspace import Workspace

U = np.uint64
#: Bits of a set's parity map: bit k is the parity of the number of its shingles that fall there.
PARITY = 1024


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text shorter than a shingle is one, without words none."""
    words = K.Words(text)
    h = words.hashes()
    rolled, whole = K.rolling(h, width, words.first)
    out = []
    for i, n in enumerate(words.count):
        a, b = words.first[i], words.first[i + 1]
        if n >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif n:
            short, _ = K.rolling(h[a:b], int(n), np.array([0, n]), K.BASE2)  # another salt: never equal to a full shingle
            out.append(short ^ U(n))
        else:
            out.append(np.zeros(0, U))
    return out


class Signer:
    """Signatures of ``bands * rows`` bins and the bucket key of each band."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        order = np.argsort(np.random.RandomState(20).random_sample((self.bins, self.bins)), axis=1)
        self.rank = np.argsort(order, axis=1).astype(np.uint16)  # rank[i, j]: when bin i asks bin j

    def __call__(self, s: np.ndarray) -> np.ndarray:
        place = ((s >> U(32)) * U(self.bins) >> U(32)).astype(np.int64)  # grows with s: the first of a bin is its minimum
        heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        filled = place[heads]
        signature = np.empty(self.bins, U)
        signature[filled] = s[heads]
        if len(filled) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), filled, assume_unique=True)
            signature[empty] = s[heads][self.rank[np.ix_(empty, filled)].argmin(1)]
        with np.errstate(over="ignore"):
            rows = signature.reshape(self.bands, self.rows)
            out = np.arange(1, self.bands + 1).astype(U)
            for j in range(self.rows):
                out = out * K.BASE + rows[:, j]
        return K.mix(out)


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for b in K.pieces(batches, "text"):
            sets = shingle_sets(b.column("text"), width)
            n = np.array([len(s) for s in sets], np.int64)
            key = np.zeros((2, len(sets)), U)
            keys = np.zeros((int((n > 0).sum()), bands), U)
            with np.errstate(over="ignore"):
                for row, i in enumerate(np.flatnonzero(n)):
                    s = sets[i]
                    key[0, i], key[1, i] = s.sum(dtype=U), K.mix(s ^ K.BASE2).sum(dtype=U)
                    keys[row] = signer(s)
            ends = np.r_[0, np.cumsum((n > 0) * bands)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))],
                names=["doc_id", "n_shingles", "key1", "key2", "buckets"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches, "text"):
            sets = shingle_sets(b.column("text"), width)
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            bits = np.stack([np.packbits(np.bincount((s & U(PARITY - 1)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1) for s in sets]).view(np.int64)
            at = np.arange(len(sets) + 1, dtype=np.int32) * bits.shape[1]
            body = np.array([s.sum(dtype=U) for s in sets], U).view(np.int64)  # tells the sets of a repeated identifier apart
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), pa.array(body), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(pa.array(at), pa.array(bits.reshape(-1)))],
                names=["rep", "body", "items", "bits"],
            )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("u"))
    return both.filter(F.col("i") * 100 >= percent * (F.col("u") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, bands: int = 40, rows: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest identifier reachable by links), kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a set holds the distinct ``width``-word
    shingles as 64-bit hashes, one for the whole sequence where there are fewer words. Documents are linked at
    100 * intersection >= ``percent`` * union. Null and empty texts have empty sets and no links. Equal sets are one
    class, represented by its smallest identifier, so copies never meet in a bucket. Rows that repeat an identifier
    are one document, linked by any of its texts. Rows with a null identifier have no component and are kept. Other
    columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    with Workspace(spark, "minhash") as work:
        signed = work.table(source.mapInArrow(_signatures(width, bands, rows), f"doc_id {id_type}, n_shingles long, key1 long, key2 long, buckets array<long>"), "signed")
        real = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        same = ["key1", "key2", "n_shingles"]
        classes = work.table(real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("buckets").alias("buckets")), "classes")
        members = work.table(real.select("doc_id", *same).join(classes.filter("size > 1").select("rep", *same), same).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "members")
        lone = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
        shared = lone.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("bucket")
        met = work.table(lone.join(shared, "bucket"), "met")
        work.drop(classes)
        reps = work.table(met.select(F.col("rep").alias("doc_id")).distinct(), "reps")  # its size lets Spark choose the join
        sets = source.join(reps, "doc_id").withColumnRenamed("doc_id", "rep").mapInArrow(_sets(width), f"rep {id_type}, body long, items array<long>, bits array<long>")
        sets = work.table(sets, "sets")
        room = work.table(_room(sets, percent), "room")

        stars = work.table(_stars(met.join(room.drop("body", "bits"), ["rep", "n"])), "stars")
        work.drop(met)
        likely = _alike(stars.select("a", "b"), room, percent)
        links = work.table(_confirmed(likely, sets, percent), "links")
        labels = work.table(_labels(room, links, work), "labels")
        work.drop(stars)
        rare = work.table(_rare_items(sets, room.join(labels, "rep"), percent), "rare")
        pairs = work.table(_by_rare_items(rare, percent), "pairs")
        work.drop(rare)
        links = links.unionByName(work.table(_confirmed(pairs, sets, percent), "more"))
        work.drop(sets, room)
        final = connected_components(links.unionByName(members), work).withColumnRenamed("node", "doc_id")
        out = signed.select("doc_id", "n_shingles").join(final, "doc_id", "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        return work.keep(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _room(sets: DataFrame, percent: int) -> DataFrame:
    """rep, body, n, own, bits, least, most: the shingles that no other set has, and the sizes a partner can have.

    With ``c = n - own`` shingles left to share, 100 * i >= p * (n + m - i) needs m <= (100 + p) / p * c - n. Sets
    without room for any partner are absent.
    """
    items = sets.select("rep", "body", F.explode("items").alias("item"))
    own = items.groupBy("item").agg(F.count(F.lit(1)).alias("holders"), F.min(F.struct("rep", "body")).alias("of")).filter("holders = 1").groupBy("of.rep", "of.body").agg(F.count(F.lit(1)).alias("own"))
    room = sets.select("rep", "body", F.size("items").cast("long").alias("n"), "bits").join(own, ["rep", "body"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    most = f"least(({100 + percent} * (n - own)) div {percent} - n, (100 * n) div {percent})"
    return room.select("rep", "body", "n", "own", "bits", F.expr(f"({percent} * n + 99) div 100").alias("least"), F.expr(most).alias("most")).filter("most >= least")


def _stars(rows: DataFrame) -> DataFrame:
    """a, b, part: each member b of a bucket with its centre a, where the sizes leave both room for each other.

    The centre is the member with the smallest part of its own: of a group of reworked copies the one nearest to what
    they were made from.
    """
    centre = F.min(F.struct((F.col("own") / F.col("n")).alias("part"), "rep", "n", "least", "most")).alias("c")
    near = rows.join(rows.groupBy("bucket").agg(centre), "bucket").filter("rep <> c.rep AND n BETWEEN c.least AND c.most AND c.n BETWEEN least AND most")
    return near.groupBy(F.col("c.rep").alias("a"), F.col("rep").alias("b")).agg(F.min("c.part").alias("part"))


def _labels(room: DataFrame, links: DataFrame, work: Workspace) -> DataFrame:
    """rep, label: a number for the component that the links so far put a member in. Larger components have smaller numbers."""
    found = connected_components(links, work)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    own = room.select("rep").distinct().join(found.join(sizes, "component"), F.col("rep") == F.col("node"), "left")
    rank = F.lit(63).cast("long") - F.floor(F.log2(F.coalesce("size", F.lit(1)).cast("double"))).cast("long")
    return own.select("rep", F.shiftleft(rank, 50).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.coalesce("component", "rep")), 14)).alias("label"))


#: Sizes leave both sides of a pair x, y of different labels room for each other.
FITS = "x_label <> y_label AND x_n BETWEEN y_least AND y_most AND y_n BETWEEN x_least AND x_most"


def _side(rows: DataFrame, s: str) -> DataFrame:
    return rows.select("item", *(F.col(c).alias(f"{s}_{c}") for c in ("rep", "label", "n", "least", "most", "indexed", "bits")))


def _maps_agree(percent: int) -> Column:
    apart = sum((F.bit_count(F.get("x_bits", F.lit(i)).bitwiseXOR(F.get("y_bits", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    return apart * (100 + percent) <= (100 - percent) * (F.col("x_n") + F.col("y_n"))


def _alike(pairs: DataFrame, room: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parity maps let the sets be similar enough: where the maps differ, the sets differ.

    Of two sets at 100 * i >= p * u at most (100 - p) / (100 + p) of the sum of their sizes are in one of them only.
    """
    side = lambda node, s: room.select(F.col("rep").alias(node), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits"))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(_maps_agree(percent)).select("a", "b")


def _rare_items(sets: DataFrame, room: DataFrame, percent: int) -> DataFrame:
    """rep, label, n, least, most, bits, item, indexed, main: the rarest shingles of each set, among those of several labels.

    Two sets of sizes m <= n at similarity p share at least p * n and 2p / (1 + p) * m shingles (p as a part). In one
    order of all shingles, here from rare to frequent, the first n - p * n + 1 of the larger and the first
    m - 2p / (1 + p) * m + 1 of the smaller (indexed) therefore have one in common. main is one label of the
    shingle's, that of the most popular centre.
    """
    room = room.select("rep", "body", "n", "least", "most", "bits", "label")
    items = sets.join(room.select("rep", "body", "label"), ["rep", "body"]).select("body", "label", F.explode("items").alias("item"))
    held = items.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("holders"), F.min("label").alias("main"), F.max("label").alias("hi")).filter("main <> hi").drop("hi")
    # what sets of one label hold comes before all others in the order, but can be in no pair: it counts without being listed
    shared = items.select("item", "body").join(held, "item").groupBy("body").agg(F.array_sort(F.collect_list(F.struct("holders", "item", "main"))).alias("items"))
    alone = room.join(shared, "body").withColumn("alone", F.col("n") - F.size("items"))
    probe, index = f"n - ({percent} * n + 99) div 100 + 1 - alone", f"n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1 - alone"
    first = alone.filter(f"{probe} > 0").select("rep", "label", "n", "least", "most", "bits", F.explode(F.expr(f"transform(slice(items, 1, int({probe})), (x, i) -> struct(x.item AS item, i < {index} AS indexed, x.main AS main))")).alias("x"))
    return first.select("rep", "label", "n", "least", "most", "bits", "x.*")


def _by_rare_items(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of different labels that share a rare shingle; each shingle's main label is met by the others only.

    Sizes and parity maps are compared inside the join, so that it gives out next to nothing but links.
    """
    left, right = _side(rare.filter("label <> main"), "x"), _side(rare, "y")
    pairs = left.join(right, "item").filter(F.expr(f"{FITS} AND ((y_indexed AND y_n <= x_n) OR (x_indexed AND x_n <= y_n))") & _maps_agree(percent))
    return pairs.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates keeps. Rows that repeat an identifier share its fate."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).filter("NOT kept").select(F.col("doc_id").alias("of")).distinct()
    whole = docs.select(F.struct("*").alias("whole"))
    kept = whole.join(gone, F.col("whole").getField(id_col) == F.col("of"), "left_anti")
    return kept.select(*(F.col("whole").getField(c).alias(c) for c in docs.columns))
