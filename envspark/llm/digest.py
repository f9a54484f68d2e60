"""Document fingerprints from improbable byte features.

Every window of ``WIDTH`` bytes has an entropy; how rare that entropy is among all windows of the
corpus ranks the window.  A window is a feature if it is the rarest (leftmost of equals) of at least
``POPULAR`` of the ``WIDTH`` stretches of ``WIDTH`` window positions around it.  Features go, in text
order, into a chain of Bloom filters of bounded load; two fingerprints are compared by the
overlap of bits beyond chance, normalised by the smaller load, filter by filter.

Cases: an empty (or null) text has the empty fingerprint, equal only to itself; a text of fewer than
``WIDTH`` bytes has one feature, the whole text; equal texts have equal fingerprints; texts of any
length give a chain as long as they need; rows that share a doc_id follow each other in the
order of their texts; a single document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, raw, texts, total_bytes
from .neardup import NO_ID

WIDTH = 16
POPULAR = 8
#: Steps of entropy whose frequencies are counted.
STEPS = 256
#: Bits of a filter, bits of a feature, and features of a filter.
FILTER_BITS = 2048
FEATURE_BITS = 5
LOAD = 160
#: Texts are laid out in buffers of about this many bytes, so far apart that no stretch meets two of them.
BUFFER = 1 << 18
GAP = 2 * WIDTH
#: Text bytes of a range of ids.
PART_BYTES = 16 << 20

#: c log2 c for the count c of a byte in a window, in units of 2^-40, so that sums are exact; and its steps.
_XLOGX = np.array([0] + [round(c * math.log2(c) * 2**40) for c in range(1, WIDTH + 1)], np.int64)
_STEP = np.diff(_XLOGX, prepend=0)


def _counts(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: how often its byte occurs in the WIDTH bytes that begin there (itself
    included), and in the WIDTH bytes that end there."""
    n = len(buffer)
    order = np.argsort(buffer, kind="stable")
    key = np.full(n + WIDTH, np.iinfo(np.int32).max, np.int32)  # byte, then place
    key[:n] = order + buffer[order].astype(np.int32) * (n + 2 * WIDTH)
    place, limit = np.arange(n, dtype=np.int32), key[:n] + (WIDTH - 1)
    last = place.copy()  # the last place of the same byte within the window, found by halving steps
    step = WIDTH // 2
    while step:
        last += (key[last + step] <= limit) * np.int32(step)
        step //= 2
    ahead, behind = np.empty(n, np.uint8), np.empty(n, np.uint8)
    ahead[order] = last - place + 1
    # place q is the first one whose window reaches back to it: count the windows that end before it
    ended = np.cumsum(np.bincount(last, minlength=n))
    behind[order] = place - np.concatenate([[0], ended[:-1]]) + 1
    return ahead, behind


def window_entropy(buffer: np.ndarray) -> np.ndarray:
    """Entropy step (0 to STEPS - 1) of the window at each place, from the entropy of the window
    before it: one byte leaves, one comes in."""
    n = len(buffer) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint8)
    ahead, behind = _counts(buffer)
    total = np.empty(n, np.int64)
    total[0] = _XLOGX[np.bincount(buffer[:WIDTH], minlength=256)].sum()
    np.subtract(_STEP[behind[WIDTH:]], _STEP[ahead[: n - 1]], out=total[1:])
    np.cumsum(total, out=total)
    scale = (STEPS - 1) / (WIDTH * math.log2(WIDTH) * 2**40)
    return np.rint((STEPS - 1) - total * scale).astype(np.uint8)


def _layout(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of texts with gaps, and where each text begins and ends."""
    size = np.array([len(t) for t in texts_], np.int64)
    begin = GAP + np.concatenate([[0], np.cumsum(size + GAP)[:-1]]) if len(size) else np.zeros(0, np.int64)
    buffer = np.frombuffer(b"\0" * GAP + b"".join(t + b"\0" * GAP for t in texts_), np.uint8)
    return buffer, begin, begin + size


def _inside(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places whose window lies in one text."""
    edge = np.zeros(n + 1, np.int32)
    long_enough = end - begin >= WIDTH
    np.add.at(edge, begin[long_enough], 1)
    np.add.at(edge, end[long_enough] - WIDTH + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def entropy_counts(texts_: list[bytes]) -> np.ndarray:
    """Windows of the texts for each entropy step."""
    buffer, begin, end = _layout(texts_)
    entropy = window_entropy(buffer)
    return np.bincount(entropy[_inside(len(entropy), begin, end)], minlength=STEPS)


def features(texts_: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of each text, in text order.  rank: of each entropy step, 0 the rarest."""
    buffer, begin, end = _layout(texts_)
    entropy = window_entropy(buffer)
    n = len(entropy)
    # rank above place: the least value of a stretch is its rarest window, leftmost of equals
    key = np.where(_inside(n, begin, end), rank[entropy].astype(np.int64), STEPS) << 40 | np.arange(n)
    least, width = key, 1
    while width < WIDTH:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    chosen = np.bincount(least[(least >> 40) < STEPS] & ((1 << 40) - 1), minlength=n)
    at = np.flatnonzero(chosen >= POPULAR)
    view = np.lib.stride_tricks.sliding_window_view(buffer, WIDTH)
    words = np.ascontiguousarray(view[at]).view(np.uint64) if len(at) else np.zeros((0, WIDTH // 8), np.uint64)
    hashed = np.zeros(len(at), np.uint64)
    for j in range(words.shape[1]):
        hashed = (hashed ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    hashed = hashed * np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    low, high = np.searchsorted(at, begin), np.searchsorted(at, end)
    out = [hashed[a:b] for a, b in zip(low, high)]
    for i, t in enumerate(texts_):
        if len(out[i]) == 0 and t:  # too short for windows: the whole text is the feature
            out[i] = np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), np.uint64)
    return out


def bloom_chain(found: np.ndarray) -> np.ndarray:
    """filters x FILTER_BITS, as 0 and 1."""
    chain = np.zeros((-(-len(found) // LOAD), FILTER_BITS), np.uint8)
    row = np.arange(len(found)) // LOAD
    for j in range(FEATURE_BITS):
        chain[row, (found >> np.uint64(11 * j)).astype(np.int64) & (FILTER_BITS - 1)] = 1
    return chain


def fingerprint(chain: np.ndarray) -> str:
    return base64.b64encode(np.packbits(chain).tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best overlap with a filter of the longer
    one, beyond what chance gives and as a share of what is possible; the mean by load."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    elif len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    m, n = a.sum(1, dtype=np.float32), b.sum(1, dtype=np.float32)
    common = a.astype(np.float32) @ b.astype(np.float32).T
    chance = np.outer(m, n) / FILTER_BITS
    most = np.minimum(m[:, None], n[None, :])
    score = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    return float(round(float(score @ m / m.sum()), 12))


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy step by its frequency over all windows of all texts (0: the rarest);
    only STEPS sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS, np.int64)
        for batch in pieces(batches, limit=BUFFER):
            total += entropy_counts(raw(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS), pa.int32()), pa.array(total)], names=["step", "n"])

    counts = np.zeros(STEPS, np.int64)
    for step, n in docs.select("text").mapInArrow(run, "step int, n long").groupBy("step").agg(F.sum("n")).collect():
        counts[step] = n
    rank = np.empty(STEPS, np.int64)
    rank[np.lexsort((np.arange(STEPS), counts))] = np.arange(STEPS)
    return rank


def fingerprints(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=BUFFER):
            prints = [fingerprint(bloom_chain(f)) for f in features(raw(batch.column(1)), rank)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first letters of ``following`` (or all)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Neighbours:
    """Results of a run of documents, each of which needs the one after it."""

    def __init__(self, rank: np.ndarray):
        self.rank = rank

    def chains(self, column: list[str]) -> list[np.ndarray]:
        return [bloom_chain(f) for f in features([t.encode() for t in column], self.rank)]

    def rows(self, ids: list[int], column: list[str]) -> pa.RecordBatch:
        """Results of all documents but the last."""
        changed = [edited(t, u) for t, u in zip(column, column[1:])]
        own, other = self.chains(column), self.chains(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if i == NO_ID else i for i in ids[:-1]], pa.int64()),
                pa.array([len(t) for t in column[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([fingerprint(c) for c in own[:-1]], pa.string()),
                pa.array([fingerprint(c) for c in other], pa.string()),
                pa.array([likeness(c, d) for c, d in zip(own, other)], pa.float64()),
                pa.array([likeness(c, d) for c, d in zip(own, own[1:])], pa.float64()),
            ],
            names=[c.split()[0] for c in COLUMNS.split(", ")],
        )


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """For every document, in descending id order, its fingerprint, that of its edited text, and
    its likeness to that text and to the next document (after the last: the first).

    Ids are cut into ranges of about PART_BYTES of text; each range gets a copy of the first document
    of the next one, so that no order over all documents is needed and texts are shuffled once."""
    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    spark = docs.sparkSession
    rank = entropy_ranks(rows)
    parts = max(1, -(-total_bytes(rows) // PART_BYTES))
    cuts = rows.select("doc_id").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = np.unique(np.array(cuts, np.int64))[::-1]  # range 0 has the largest ids

    def ranged(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = np.searchsorted(-cuts, -batch.column(0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *batch.columns], names=["part", *names])
        return run

    heads = rows.select("doc_id").mapInArrow(ranged(["doc_id"]), "part long, doc_id long").groupBy("part").agg(F.max("doc_id"))
    heads = sorted((r[0], r[1]) for r in heads.collect())  # one id for each range
    before = [(heads[k - 1][0], head) for k, (_, head) in enumerate(heads)]
    extra = F.broadcast(spark.createDataFrame(before, "part long, doc_id long"))
    extra = rows.join(extra, "doc_id").groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    both = rows.mapInArrow(ranged(["doc_id", "text"]), "part long, doc_id long, text string").withColumn("extra", F.lit(False))
    both = both.union(extra.select("part", "doc_id", "text", F.lit(True))).repartition("part")
    both = both.sortWithinPartitions("part", "extra", F.col("doc_id").desc(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare, ids, column, held = Neighbours(rank), [], [], 0
        for batch in pieces(batches, limit=BUFFER):
            for i, text, last in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                ids.append(i)
                column.append(text)
                held += len(text)
                if last or held > BUFFER:
                    if len(ids) > 1:
                        yield compare.rows(ids, column)
                    ids, column, held = ([], [], 0) if last else (ids[-1:], column[-1:], len(text))

    return both.mapInArrow(run, COLUMNS)
