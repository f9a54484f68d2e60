"""MinHash near-duplicates with circulant signatures.

A text's set is its distinct 5-word shingles.  Two permutations make the whole signature: the first
spreads shingle hashes over the slots of a ring, the second orders the ring, and coordinate k is the
least rank after turning that order by k places.  Rows of the signature are banded; documents that
share a band are compared on their full sets.

Large buckets are not expanded into pairs.  Each bucket links its members to one leader; buckets
whose members then lie in one component are done, the others get another leader.  Documents that
still share a bucket across components after ``STARS`` rounds get a long sketch (one bit of each of
many coordinates), and pairs of different components whose sketches allow the threshold are compared.

Cases: null and empty texts have empty sets and are linked with nothing; texts of fewer than five
words have one shingle, the whole sequence; rows that share a doc_id are one document whose links
are those of all its rows (a null doc_id counts as one id, the smallest); equal sets are one class
from the start; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, distinct, pieces, raw, store, texts, trimmed, word_hashes

SHINGLE = 5
#: Slots of the ring, rows of a band, and the share of pairs at the threshold that banding may miss.
RING = 1 << 20
BAND_ROWS = 7
MISS = 1e-5
#: Rounds of leaders before the rest is compared pair by pair; bits of the sketches that pick these pairs,
#: and the standard deviations by which the sketches of a pair at the threshold may differ more than expected.
STARS, SKETCH_BITS, SLACK = 2, 4096, 4.5
#: Bits of the map of ids that have a candidate; it only spares the shuffle texts that are not needed.
MAP_BITS = 1 << 23
#: Stands for a null id.
NO_ID = -(1 << 63)
_M = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words."""
    n = len(hashes) - length + 1
    out = hashes[:n].copy()
    for j in range(1, length):
        out *= _M
        out += hashes[j : j + n]
    out ^= out >> np.uint64(32)
    out *= _M
    out ^= out >> np.uint64(29)
    return out


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, from the hashes of its words."""
    if len(words) < SHINGLE:
        return run_hashes(words, len(words)) if len(words) else words
    return distinct(run_hashes(words, SHINGLE))


def text_sets(column: pa.Array) -> list[np.ndarray]:
    """Shingle sets of whole texts; A-Z count as a-z."""
    return [shingle_set(w) for w in word_hashes([t.lower() for t in raw(column)])]


def band_count(threshold: float) -> int:
    """Bands for which a pair at the threshold is missed with a chance of at most MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**BAND_ROWS))


class Circulant:
    """Signature coordinates from one spreading permutation and one order of the ring."""

    def __init__(self, length: int):
        order = np.random.default_rng(20).permutation(RING).astype(np.int32)
        self.turned = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:length]]), length)
        self.some = max(16, (1 << 18) // length)
        self.salt = np.arange(1, length // BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def least(self, shingles: np.ndarray) -> np.ndarray:
        """Coordinate k: the least rank of the set's slots, the order being turned by k places."""
        slots = (shingles * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 20)).astype(np.int64)
        out = self.turned[slots[: self.some]].min(axis=0)
        for i in range(self.some, len(slots), self.some):
            np.minimum(out, self.turned[slots[i : i + self.some]].min(axis=0), out=out)
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of BAND_ROWS coordinates."""
        rows = self.least(shingles).astype(np.uint64).reshape(-1, BAND_ROWS)
        key = self.salt.copy()
        for j in range(BAND_ROWS):
            key = (key ^ rows[:, j]) * _M
            key ^= key >> np.uint64(31)
        return key

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """One bit of each coordinate, as 64-bit words."""
        return np.packbits((self.least(shingles) & 1).astype(bool)).view(np.int64)


def signatures(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands array<long>) of every whole text."""
    length = band_count(threshold) * BAND_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(length)
        for batch in pieces(batches):
            size, name, keys = [], [], []
            for s in text_sets(batch.column(1)):
                size.append(len(s))
                name.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(circulant.keys(s) if len(s) else np.zeros(0, np.uint64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).astype(np.int64)))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).mapInArrow(trimmed(run), "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = text_sets(batch.column(1))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).astype(np.int64)))], names=["doc_id", "shingles"])

    return docs.mapInArrow(trimmed(run), "doc_id long, shingles array<long>")


def sketches(sets: DataFrame) -> DataFrame:
    """(doc_id, sketch array<long>) of SKETCH_BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(SKETCH_BITS)
        for batch in batches:
            found = [circulant.sketch(s.values.to_numpy(zero_copy_only=False).astype(np.uint64)).tolist() for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "sketch"])

    return sets.select("doc_id", "shingles").mapInArrow(trimmed(run), "doc_id long, sketch array<long>")


def alike(a: str, b: str, threshold: float):
    """Whether two sketches differ in no more bits than a pair at the threshold may."""
    p = (1 - threshold) / 2
    most = SKETCH_BITS * p + SLACK * math.sqrt(SKETCH_BITS * p * (1 - p))
    differ = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        differ = differ + F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i))))
    return differ <= most


def likely_rows(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be in ``needed``, by a bit map of fixed size: what is left is
    joined exactly."""
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    marked = needed.select(slot.alias("s")).select((F.col("s") / 32).cast("long").alias("word"), F.expr("shiftleft(1L, cast(s % 32 as int))").alias("bit"))
    bits = np.zeros(MAP_BITS // 32, np.uint32)
    for r in marked.groupBy("word").agg(F.bit_or("bit").alias("bit")).collect():  # at most MAP_BITS / 32 numbers
        bits[r["word"]] = r["bit"]
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            hit = (shared.value[s >> 5] >> (s & 31).astype(np.uint32)) & 1
            yield batch.select([0, 1]).filter(pa.array(hit.astype(bool)))

    return docs.withColumn("s", slot).mapInArrow(run, "doc_id long, text string")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have a Jaccard similarity of ``percent`` or more."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t")), "b")
    both = both.select("a", "b", F.size("s").alias("m"), F.size("t").alias("n"), F.size(F.array_intersect("s", "t")).alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("m") + F.col("n") - F.col("i"))).select("a", "b")


def joined_labels(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after further links (a, b), found on components, not on nodes."""
    to = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    mapped = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    merged = components(mapped)
    moved = label.join(merged.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left")
    return store(moved.select("node", F.coalesce("new", "component").alias("component")).union(merged), "labels")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``: documents are linked if
    100 * intersection >= percent * union of their sets; the smallest doc_id of a component is kept."""
    all_ = store(signatures(docs, percent / 100), "signatures")
    sized = all_.where("n_shingles > 0")
    # equal sets are one class, represented by its smallest id
    classes = store(sized.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    copies = sized.join(classes.where("n > 1"), "set_key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = sized.join(classes.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"], "left_semi")
    rows = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key")
    buckets = store(rows.join(shared, "key"), "buckets")

    needed = store(buckets.select(F.col("rep").alias("doc_id")).distinct(), "needed")
    likely = likely_rows(texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), needed)
    sets = store(shingle_sets(likely.join(needed, "doc_id", "left_semi")), "sets")
    similar_size = 100 * F.least("m", "n") >= percent * F.greatest("m", "n")

    label = None
    used = None
    for round_ in range(STARS + 1):
        # buckets whose members lie in more than one component
        if label is None:
            open_ = buckets.withColumn("label", F.col("rep"))
        else:
            open_ = buckets.join(label, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("label"))
            split = open_.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
            open_ = store(open_.join(split, "key"), "open")
        if open_.isEmpty():
            break
        if round_ < STARS:
            free = open_ if used is None else open_.join(used, ["key", "rep"], "left_anti")
            leaders = store(free.groupBy("key").agg(F.min(F.struct("label", "rep", "n")).alias("l")).select("key", "l.*"), "leaders")
            leaders = leaders.select("key", F.col("rep").alias("b"), F.col("label").alias("other"), F.col("n").alias("m"))
            pairs = open_.join(leaders, "key").where("label <> other").where(similar_size)
            used = leaders.select("key", F.col("b").alias("rep")) if used is None else used.union(leaders.select("key", F.col("b").alias("rep")))
        else:
            known = store(sketches(sets.join(open_.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")), "sketches")
            left = open_.join(known.withColumnRenamed("doc_id", "rep"), "rep")
            right = left.select("key", F.col("rep").alias("b"), F.col("label").alias("other"), F.col("n").alias("m"), F.col("sketch").alias("sketch_b"))
            pairs = left.join(right, (left["key"] == right["key"]) & (F.col("label") < F.col("other")) & similar_size & alike("sketch", "sketch_b", percent / 100))
        pairs = store(pairs.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct(), "pairs")
        new = store(confirmed(pairs, sets, percent), "links")
        if label is None:
            label = components(copies.union(new))
        elif not new.isEmpty():
            label = joined_labels(label, new)

    ids = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    label = components(copies) if label is None else label
    out = all_.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("node"), "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select(ids("doc_id").alias("doc_id"), "n_shingles", ids("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
