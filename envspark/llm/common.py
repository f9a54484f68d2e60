"""Helpers shared by the operators: scratch tables, text chunks, bounded samples, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows handed to Python code are cut into pieces of about this many text bytes.
CHUNK_BYTES = 2 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the whole cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor
    repeats at most the stage it was working on."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; nothing else is read."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def total_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: what partition counts are derived from."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in ``column`` (at least one row each), so
    that memory in a Python worker does not depend on the Arrow batch size."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            n = (n or 0) + 64
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Return what this Python worker no longer uses to the system: workers outlive their tasks, and
    several of them share the memory of an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def trimmed(run):
    """The batch function ``run``, with unused memory given back at the end of the task."""

    @functools.wraps(run)
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column (null: empty)."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LETTER = np.random.default_rng(64).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once, about; a longer text is hashed alone.
_HASH_BYTES = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0 to n - 1 (at least) of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNDO)):
            steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(texts_: list[bytes]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words: differences of one running sum over all bytes
    (a random number for each byte value times a power for its place), brought to a common place."""
    out: list[np.ndarray] = []
    begin = held = 0
    for i, t in enumerate(texts_):
        if held and held + len(t) > _HASH_BYTES:
            out += _word_hashes(texts_[begin:i])
            begin, held = i, 0
        held += len(t) + 1
    return out + _word_hashes(texts_[begin:])


def _word_hashes(texts_: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts_), np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, undo = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * undo[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts_])
    # copies, so that a text's hashes do not hold those of its neighbours
    return [x.copy() for x in np.split(h, np.searchsorted(starts, begin[1:-1]))] if texts_ else []


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _state(edges: DataFrame) -> tuple:
    """Count and hash sum of an edge table, to see whether a round changed it."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected ``edges`` (a, b), component = smallest node reachable;
    nodes that are their own component are left out.

    Alternating large-star / small-star rounds: every round turns the edges into stars around the
    smallest neighbours, so the number of rounds is logarithmic in the diameter and no node list
    is ever gathered (neighbour minima are plain aggregates).  Each round is a table in the shared
    folder; the loop ends when a round changes nothing.
    """
    ordered = lambda d: d.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = store(ordered(edges), "edges")
    before = _state(edges)
    while before[0]:
        # large star: neighbours above a node move to the smallest node of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ordered(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: a node and its neighbours below it move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = store(ordered(small), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
