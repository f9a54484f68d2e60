"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Every word that training texts hold at least MIN_COUNT times is a unit of its own, with an embedding as
target and another as context, and so is the end of a text; the vocabulary grows with the corpus.
Rarer words share the unit of their last letters (one for all endings that are rare themselves),
within which smoothed counts over the whole corpus decide.  Units are the leaves of a tree of three
levels, in the order of their letters read backwards; a node has about as many children as the cube
root of the number of units.  A unit's probability given the two units before it is the product of
a log-bilinear choice among siblings at each level: the two context embeddings, each scaled by a
vector of its place, add up to a prediction that is compared with the embeddings of the siblings.
Tasks, as many as run at once, train it on their share of the training texts, starting from the
same parameters (in numpy, with the products over siblings and the sums of rows in ONNX Runtime where it is installed); the noise of the leaves is drawn, above them its expectation over all siblings is taken;
changed rows are averaged after each round, weighted by the squared gradients they met, and the
rounds together use every training text once.  Scoring normalises over all siblings of each level.

Texts are kept in blocks, as numbers of their block's dictionary, and are not shuffled.  What is shuffled
are the counts of each block's words and, once the units are known to all tasks, the rare words of each block,
whose counts come back to it.

Cases: null and empty texts are the end token alone; a null id has the empty text as its name (and is
held out); words that training texts lack are unknown and share one smoothed mass of the
unit of their last letters; repeated rows are scored, and counted, as often as they occur; with no training text all
counts are 0 and units are equally likely; an empty table gives no rows; texts of any length are scored whole.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs
from .common import pieces, raw, store, texts, trimmed
from .phrases import _pack, _unpack

#: Training count from which a word, or the last letters (as bytes) of rarer words, is a unit of its own.
MIN_COUNT, END_BYTES = 16, 3
SMOOTH = 0.1
BLOCK_BYTES = 8 << 20
#: Size of the embeddings, tokens of a step, noise nodes of a token at the top level and at others, and rounds of averaging.
DIM, STEP_TOKENS, NOISE, NOISE_EACH, ROUNDS = 16, 4096, 32, 4, 3
RATE, FIRST_SQUARES = 0.15, 10.0
#: Levels of the tree, rows of a parameter table that are averaged together, tokens handled at once, and rows of an Arrow batch.
LEVELS, CHUNK_ROWS, PIECE_TOKENS, ROWS = 3, 8192, 1 << 18, 1 << 14
#: Tokens of one parent that a graph handles together, and chunks of them (or such a share of the tokens, at the top level) in a call.
CHUNK_TOKENS, CALL_CHUNKS = 32, 128
#: Dictionaries whose words are looked up at once.
LOOKUP_BLOCKS = 4

CODED = "block long, doc_ids array<long>, stops long, folds binary, sizes binary, ids binary, words binary, counts binary"


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10


_SPACES = b" \t\n\r\x0b\x0c"
_MARKS = bytes(x in _SPACES for x in range(256))
_ONE = np.ones(1, np.int8)


def coded_words(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words of each text, the words of all as numbers in the order of first use, and the
    words; words are in small letters and end where bytes.split() ends them."""
    data = b"\n".join(texts_).lower()
    edges = np.flatnonzero(np.diff(np.frombuffer(data.translate(_MARKS), np.int8), prepend=_ONE, append=_ONE))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(None, _SPACES))]).dictionary_encode()
    begin = np.cumsum([0] + [len(t) + 1 for t in texts_])
    sizes = np.diff(np.searchsorted(starts, begin))
    return sizes, words.indices.to_numpy(), words.dictionary


def block_dictionaries(docs: DataFrame) -> DataFrame:
    """One row for each block of texts: ids, folds and sizes of the texts, their words as numbers of
    the block's dictionary, and the dictionary with the count of each word in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        doc_ids, folds, held_texts = [], [], []

        def row() -> pa.RecordBatch:
            sizes, ids, words = coded_words(held_texts)
            count = np.bincount(ids[np.repeat(np.array(folds) > 0, sizes)], minlength=len(words))
            blobs = [_pack(np.array(folds, np.int8)), _pack(sizes), _pack(ids), zstandard.compress(b" ".join(words.to_pylist()), 3), _pack(count.astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sum(f > 0 for f in folds)], pa.int64())] + [pa.array([x], pa.binary()) for x in blobs], names=["block", "doc_ids", "stops", "folds", "sizes", "ids", "words", "counts"])

        for batch in pieces(batches):
            for i, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                doc_ids.append(i)
                folds.append(fold_of(i))
                held_texts.append(text)
                held += len(text) + 16
                if held >= BLOCK_BYTES:
                    yield row()
                    number, held = number + 1, 0
                    doc_ids, folds, held_texts = [], [], []
        if doc_ids:
            yield row()

    return store(texts(docs).mapInArrow(run, CODED), "coded")


def word_rows(coded: DataFrame) -> DataFrame:
    """(word, n) for the words that training texts of a block hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = _unpack(counts, np.int64)
                found = pa.RecordBatch.from_arrays([word_column(words), pa.array(n)], names=["word", "n"]).filter(pa.array(n > 0))
                for i in range(0, len(found), ROWS):
                    yield found.slice(i, ROWS)

    return coded.select("words", "counts").mapInArrow(run, "word binary, n long")


class Classes:
    """Unit numbers: words, ends, one for all other ends, then the end of the text; and their counts."""

    def __init__(self, words: list[bytes], ends: list[bytes], count: np.ndarray):
        self.words, self.ends, self.count = words, ends, count
        self.other, self.stop = len(words) + len(ends), len(words) + len(ends) + 1

    @property
    def size(self) -> int:
        return self.stop + 1

    def places(self) -> np.ndarray:
        """Leaf of each unit: in the order of the letters read backwards, the last two units last."""
        order = sorted(range(self.other), key=lambda i, names=[x[::-1] for x in (*self.words, *self.ends)]: names[i])
        place = np.arange(self.size)
        place[order] = np.arange(self.other)
        return place

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Units of words, known or not."""
        if not hasattr(self, "sets"):
            self.sets = [pa.array(x, pa.binary()) for x in (self.words, self.ends)]
        unit = pc.fill_null(pc.index_in(words, self.sets[0]), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        rare = np.flatnonzero(unit < 0)
        # a slice of binary values counts in bytes
        end = pc.index_in(pc.binary_slice(words.take(pa.array(rare)), -END_BYTES), self.sets[1])
        unit[rare] = pc.fill_null(pc.add(end, len(self.words)), self.other).to_numpy(zero_copy_only=False)
        return unit


def word_column(blob: bytes) -> pa.Array:
    """The words of a block's dictionary."""
    text = zstandard.decompress(blob)
    data = np.frombuffer(text, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data)) if text else np.zeros(0, np.int64)
    offsets = np.zeros(len(ends) + 1, np.int64)
    np.cumsum(np.diff(ends, prepend=-1) - 1, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 32])]).cast(pa.binary())


def word_classes(counts: DataFrame, stops: int) -> tuple[Classes, DataFrame]:
    """The units, and (word, c, class) of the training words.
    The words and ends of MIN_COUNT or more, and the sums of the units, reach the driver."""
    spark = counts.sparkSession
    own = counts.where(F.col("c") >= MIN_COUNT).orderBy(F.desc("c"), "word").select("word", "c").toArrow()
    words = [bytes(w) for w in own.column(0).to_pylist()]
    ends = counts.where(F.col("c") < MIN_COUNT).groupBy(word_end("word").alias("end")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    ends = ends.groupBy(F.when(F.col("c") >= MIN_COUNT, F.col("end")).alias("end")).agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
    rest = next((r for r in ends if r["end"] is None), None)  # of all ends that are rare themselves
    ends = sorted(((bytes(r["end"]), r["c"], r["v"]) for r in ends if r["end"] is not None), key=lambda e: (-e[1], e[0]))
    sums = [(rest["c"], rest["v"]) if rest else (0, 0), (stops, 0)]
    classes = Classes(words, [e[0] for e in ends], np.array([*own.column(1).to_pylist(), *(e[1] for e in ends), *(x[0] for x in sums)], float))
    classes.distinct = np.array([1] * len(words) + [e[2] for e in ends] + [x[1] for x in sums], float)
    index = spark.createDataFrame(pa.table({"word": pa.array(words, pa.binary()), "own": pa.array(range(len(words)), pa.int32())}))
    classed = counts.join(index, "word", "left").withColumn("end", word_end("word")).join(end_numbers(spark, classes.ends, len(words)), "end", "left")
    return classes, classed.select("word", "c", F.coalesce("own", "end_class", F.lit(classes.other)).alias("class"))


def word_end(column: str):
    return F.substring(F.col(column), -END_BYTES, END_BYTES) if END_BYTES else F.lit(b"")


def end_numbers(spark, ends: list[bytes], start: int) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(bytearray(e), start + i) for i, e in enumerate(ends)], "end binary, end_class int"))


class Model:
    """Log-bilinear tree: context embeddings of the units, place vectors, and for each level the
    target embeddings and biases of its nodes.  Leaves are units; node k of a level has the nodes
    from k * fan on of the next as children."""

    def __init__(self, classes: Classes):
        k = classes.size
        rng = np.random.default_rng(5)
        self.fan = max(2, math.ceil(round(k ** (1 / LEVELS), 6)))
        self.place_of = classes.places()
        mass = np.empty(k)
        mass[self.place_of] = classes.count + 1
        levels = [mass]
        for _ in range(LEVELS - 1):
            levels.insert(0, np.add.reduceat(levels[0], np.arange(0, len(levels[0]), self.fan)))
        above = [np.full(len(levels[0]), levels[0].sum()), *[np.repeat(u, self.fan)[: len(v)] for u, v in zip(levels, levels[1:])]]
        self.noise = [v / u for u, v in zip(above, levels)]  # of a node among its siblings
        self.cumulative = [np.concatenate([[0], np.cumsum(v)]) for v in levels]
        self.target = [(rng.standard_normal((len(v), DIM)) * 0.01).astype(np.float32) for v in levels]
        self.bias = [np.log(q).astype(np.float32) for q in self.noise]
        self.context = (rng.standard_normal((k, DIM)) * 0.3).astype(np.float32)
        self.place = np.ones((2, DIM), np.float32)

    def tables(self) -> list[np.ndarray]:
        """All parameters, as tables with one row for each node or unit."""
        return [self.context, self.place, *self.target, *[b[:, None] for b in self.bias]]

    def predict(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        r, other = self.context.take(one, axis=0), self.context.take(two, axis=0)
        r *= self.place[0]
        other *= self.place[1]
        r += other
        return r

    def nodes(self, word: np.ndarray) -> list[np.ndarray]:
        """Nodes on the way to each unit, one array for each level."""
        leaf = self.place_of.take(word)
        return [leaf // self.fan ** (LEVELS - 1 - k) for k in range(LEVELS - 1)] + [leaf]

    def log_p(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
        """Normalised log-probability of each token, given the units one and two places before it.
        (Contexts are too many to keep normalisers, so ``z`` is left as it is.)"""
        order = _order(self.place_of[word])
        one, two, word = one.take(order), two.take(order), word.take(order)
        r = self.predict(one, two)
        far = math.sqrt(float(np.einsum("ij,ij->i", r, r).max(initial=0)))
        found = np.zeros(len(word), np.float64)
        if graphs.usable():
            ra = np.ones((len(r) + 1, DIM + 1), np.float32)
            ra[:-1, :DIM], ra[-1] = r, 0
        for level, node in enumerate(self.nodes(word)):
            target, bias = self.target[level], self.bias[level]
            parent = node // self.fan if level else np.zeros(len(node), np.int64)
            begin = np.flatnonzero(np.diff(parent, prepend=-1))
            # where no score can leave the range of exp, the largest need not be subtracted
            small = far * math.sqrt(float(np.einsum("ij,ij->i", target, target).max())) + float(np.abs(bias).max()) < 60
            if graphs.usable():
                self._add_choices(found, level, ra, node, parent, small)
                continue
            for p, a, b in zip(parent[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(node)]):
                first, last = p * self.fan, min((p + 1) * self.fan, len(bias))
                if last - first == 1:
                    continue
                t, c = target[first:last], bias[first:last]
                for i in range(a, b, 2048):
                    j = min(i + 2048, b)
                    s = r[i:j] @ t.T
                    s += c
                    own = s[np.arange(j - i), node[i:j] - first]
                    if not small:
                        top = s.max(1)
                        s -= top[:, None]
                        own -= top
                    np.exp(s, out=s)
                    found[i:j] += own - np.log(s.sum(1))
        out = np.empty(len(word))
        out[order] = found
        return out

    def _siblings(self, level: int) -> np.ndarray:
        """Target embeddings and biases by parent; what the last parent lacks is never chosen."""
        if hasattr(self, "kept"):
            return self.kept[level]
        target, bias = self.target[level], self.bias[level]
        width = self.fan if level else len(bias)
        rows = np.zeros((-(-len(bias) // width) * width, DIM + 1), np.float32)
        rows[:, DIM] = -1e30
        rows[: len(bias), :DIM], rows[: len(bias), DIM] = target, bias
        return rows.reshape(-1, width, DIM + 1)

    def keep(self) -> None:
        """From now on the model is not trained any more: what scoring derives from its parameters is made once."""
        if graphs.usable() and not hasattr(self, "kept"):
            self.kept = [self._siblings(level) for level in range(LEVELS)]

    def _add_choices(self, found: np.ndarray, level: int, ra: np.ndarray, node: np.ndarray, parent: np.ndarray, small: bool) -> None:
        """What ``log_p`` adds at a level, for tokens in the order of their nodes."""
        families = self._siblings(level)
        width = families.shape[1]
        if width == 1:
            return
        own = np.append(node - parent * width, 0)
        if not level:
            for a in range(0, len(node), CHUNK_TOKENS * CALL_CHUNKS):
                some = slice(a, min(a + CHUNK_TOKENS * CALL_CHUNKS, len(node)))
                found[some] += graphs.log_choice(ra[None, some], families, own[None, some, None], small).ravel()
            return
        at, held, parents, _ = graphs.chunks(parent, CHUNK_TOKENS)
        p = np.empty(at.shape, np.float32)
        for a in range(0, len(at), CALL_CHUNKS):
            some = slice(a, a + CALL_CHUNKS)
            p[some] = graphs.log_choice(ra.take(at[some], axis=0), families.take(parents[some], axis=0), own.take(at[some])[:, :, None], small)[:, :, 0]
        found += p.ravel().take(held)


def _order(at: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers from 0, by 16 bits at a time (numpy sorts those by radix)."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    top, shift = int(at.max(initial=0)), 16
    while top >> shift:
        order = order[np.argsort((at >> shift).astype(np.uint16)[order], kind="stable")]
        shift += 16
    return order


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places, the order that brings equal ones together, and where each begins in it."""
    order = _order(at)
    ordered = at[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[first], order, first


def _sum_runs(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each run.  Most runs are short: their rows are added place by place, and only
    what is left of the others goes through ``reduceat``, whose time is that of the number of runs."""
    size = np.diff(first, append=len(rows))
    out = rows.take(first, axis=0)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if k == 3 and len(more):
            cuts = np.stack([first[more] + k, first[more] + size[more]], axis=1).ravel()
            cuts = cuts[:-1] if cuts[-1] == len(rows) else cuts
            out[more] += np.add.reduceat(rows, cuts, axis=0)[::2]
        elif len(more):
            out[more] += rows.take(first[more] + k, axis=0)
    return out


class Trainer:
    """Noise-contrastive steps with Adagrad on one task's tokens."""

    def __init__(self, model: Model, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.log_q = [np.log(q).astype(np.float32) for q in model.noise]
        # one row for each leaf, so that it is read and changed at once: embedding, bias, and what the noise takes off the score (fixed)
        self.leaf = np.concatenate([model.target[-1], model.bias[-1][:, None], (self.log_q[-1] + np.float32(math.log(NOISE_EACH)))[:, None]], axis=1)
        model.target[-1], model.bias[-1] = self.leaf[:, :DIM], self.leaf[:, DIM]
        self.tables = model.tables()
        self.seen = [np.full(x.shape, FIRST_SQUARES, np.float32) for x in (*self.tables[: 1 + LEVELS], self.leaf, *self.tables[2 + LEVELS : -1])]
        # one value for each row, so that a row is moved at once
        self.rows, self.seen_rows = ([x.view(f"V{x[0].nbytes}")[:, 0] if x.shape[1] > 1 else x[:, 0] for x in held] for held in ([*self.tables[: 1 + LEVELS], self.leaf, *self.tables[2 + LEVELS : -1]], self.seen))
        leaf_seen = self.seen[1 + LEVELS]
        self.seen = [*self.seen[: 1 + LEVELS], leaf_seen[:, :DIM], *self.seen[2 + LEVELS :], leaf_seen[:, DIM : DIM + 1]]
        self.sums = np.append(model.cumulative[-1], np.full(2 * model.fan, np.inf))  # a search may look beyond the last leaf
        if graphs.usable():
            self.slot = np.zeros(model.context.shape[0], np.int64)
            sizes = [-(-len(t) // model.fan) * model.fan if level else len(t) for level, t in enumerate(model.target[:-1])]
            self.padded, self.scaled = [np.zeros((n, DIM + 1), np.float32) for n in sizes], [np.zeros((n, DIM), np.float32) for n in sizes]
            self.times = [(q * -(NOISE_EACH if level else NOISE)).astype(np.float32) for level, q in enumerate(model.noise[:-1])]

    def _add(self, which: int, at: np.ndarray, gradient: np.ndarray) -> None:
        """An Adagrad step of the rows ``at`` (distinct)."""
        x, seen = self.rows[which], self.seen_rows[which]
        held = gradient * gradient
        held += seen.take(at).view(np.float32).reshape(held.shape)
        np.put(seen, at, np.ascontiguousarray(held).view(seen.dtype)[:, 0])
        np.sqrt(held, out=held)
        step = np.divide(gradient, held, out=held)
        step *= RATE
        step += x.take(at).view(np.float32).reshape(held.shape)
        np.put(x, at, np.ascontiguousarray(step).view(x.dtype)[:, 0])

    def _upper(self, level: int, ra: np.ndarray, node: np.ndarray) -> np.ndarray:
        """A step of a level above the leaves, returning its part of the gradient of the predictions (``ra``: with
        a last column of ones).  Its parents have many tokens each, so that all siblings take the place
        of the noise, each as often as is expected."""
        m, t, k = self.m, self.m.target[level], NOISE_EACH if level else NOISE
        width = m.fan if level else len(t)
        half = np.empty((len(t), DIM + 1), np.float32)  # of the scores, as 1 / (1 + exp(-s)) is (tanh(s / 2) + 1) / 2
        half[:, :DIM] = t
        half[:, DIM] = m.bias[level] - self.log_q[level] - np.float32(math.log(k))
        half *= 0.5
        times = (m.noise[level] * (-0.5 * k)).astype(np.float32)
        parent = node // width
        order = _order(parent)
        ra, parent, own = ra.take(order, axis=0), parent[order], (node - parent * width)[order]
        begin = np.flatnonzero(np.diff(parent, prepend=-1)).tolist()
        dr, gradient, at, token = np.empty((len(node), DIM), np.float32), [], [], np.arange(len(node))
        for p, begins, ends in zip(parent[begin].tolist(), begin, [*begin[1:], len(node)]):
            some = slice(p * width, min((p + 1) * width, len(t)))
            rows, times_, total = t[some], times[some], 0
            for a in range(begins, ends, 512):
                b = min(a + 512, ends)
                s = ra[a:b] @ half[some].T
                np.tanh(s, out=s)
                mine = token[: b - a], own[a:b]
                up = 0.5 - 0.5 * s[mine]
                s *= times_
                s += times_
                s[mine] += up
                np.matmul(s, rows, out=dr[a:b])
                total = total + s.T @ ra[a:b]
            gradient.append(total)
            at.append(np.arange(some.start, some.stop))
        at, gradient = np.concatenate(at), np.concatenate(gradient)
        self._add(2 + level, at, gradient[:, :DIM])
        self._add(2 + LEVELS + level, at, gradient[:, DIM:])
        out = np.empty_like(dr)
        out[order] = dr
        return out

    def _upper_graph(self, level: int, r: np.ndarray, ra: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The same step as ``_upper`` by a graph, for tokens in the order of their nodes (``r`` and ``ra``: with a last row of zeros)."""
        m, table, k, n = self.m, self.m.target[level], NOISE_EACH if level else NOISE, len(node)
        width = m.fan if level else len(table)
        times, t, rows = self.times[level], self.padded[level], self.scaled[level]
        t[: len(table), :DIM] = table
        t[: len(table), DIM] = m.bias[level] - self.log_q[level] - np.float32(math.log(k))
        np.multiply(table, times[: len(table), None], out=rows[: len(table)])
        per = 1 / times.take(node)
        t, rows = t.reshape(-1, width, DIM + 1), rows.reshape(-1, width, DIM)
        if level:
            parent = node // width
            at, held, parents, first = graphs.chunks(parent, CHUNK_TOKENS)
            own = held * width + (node - parent * width)
            ra, r, t, rows, mask = ra.take(at, axis=0), r.take(at, axis=0), t.take(parents, axis=0), rows.take(parents, axis=0), at < n
        else:
            ra, r, own, mask = ra[None, :-1], r[None, :-1], np.arange(n) * width + node, np.ones((1, n))
        dr, total, total_bias = graphs.upper(ra, r, t, rows, own, per, mask.astype(np.float32)[:, None, :])
        if not level:
            self._add(2, np.arange(width), total[0] * times[:, None])
            self._add(2 + LEVELS, np.arange(width), total_bias[0].T * times[:, None])
            return dr[0]
        some, family = (parents[first, None] * width + np.arange(width)).ravel(), np.repeat(np.arange(len(first)), np.diff(first, append=len(parents)))
        total, total_bias = graphs.sums(total.reshape(len(parents), -1), family, len(first)).reshape(-1, DIM), graphs.sums(total_bias[:, 0], family, len(first)).reshape(-1, 1)
        if some[-1] >= len(table):  # the last parent may lack some
            some = some[some < len(table)]
            total, total_bias = total[: len(some)], total_bias[: len(some)]
        times = times.take(some)[:, None]
        total *= times
        self._add(2 + level, some, total)
        self._add(2 + LEVELS + level, some, total_bias * times)
        return dr.reshape(-1, DIM).take(held, axis=0)

    def _distinct(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct places, and the number of each one's place among them."""
        number = np.arange(len(at))
        self.slot[at] = number
        places = at[self.slot.take(at) == number]
        self.slot[places] = number[: len(places)]
        return places, self.slot.take(at)

    def _leaves(self, r: np.ndarray, node: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """A step of the leaves, returning its part of the gradient of the predictions; the noise of a token are siblings of its leaf,
        chosen by the numbers ``drawn`` from 0 to 1."""
        sums, first = self.sums, node // self.m.fan * self.m.fan
        last = np.minimum(first + self.m.fan, len(self.leaf))
        low = sums.take(first)
        u = drawn * (sums.take(last) - low) + low
        noise, jump = np.repeat(first[None], NOISE_EACH, axis=0), 1 << (self.m.fan - 1).bit_length()
        at, mass = np.empty_like(noise), np.empty_like(u)
        while jump := jump >> 1:
            np.add(noise, jump, out=at)
            np.multiply(sums.take(at, out=mass, mode="clip") <= u, jump, out=at)
            noise += at
        at = np.concatenate([node[None], np.minimum(noise, last - 1)])
        rows = self.leaf.take(at, axis=0)
        wide = np.ones((len(r), DIM + 2), np.float32)
        wide[:, :DIM], wide[:, -1] = r, -1
        s = ((rows * wide).reshape(-1, DIM + 2) @ np.ones(DIM + 2, np.float32)).reshape(at.shape)
        s[1:] *= -1
        np.clip(s, -30, 30, out=s)
        g = 1 / (1 + np.exp(s, out=s))
        g[1:] *= -1
        wide[:, -1] = 0
        factor = np.repeat(g.ravel(), DIM + 2).reshape(rows.shape)
        rows *= factor
        dr = np.ascontiguousarray(rows.sum(0)[:, :DIM])
        if graphs.usable():
            places, number = self._distinct(at.ravel())
            factor *= wide
            gradient = graphs.sums(factor.reshape(-1, DIM + 2), number, len(places))
        else:
            places, order, first = _runs(at.ravel())
            gradient = wide.take(order % len(r), axis=0)
            gradient *= g.ravel()[order, None]
            gradient = _sum_runs(gradient, first)
        self._add(1 + LEVELS, places, gradient)
        return dr

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> None:
        m = self.m
        order = _order(m.place_of.take(word))  # tables are read from begin to end, and siblings lie together
        one, two, word = one.take(order), two.take(order), word.take(order)
        c1, c2 = m.context.take(one, axis=0), m.context.take(two, axis=0)
        r = c1 * m.place[0]
        r += c2 * m.place[1]
        *upper, leaf = m.nodes(word)
        dr = self._leaves(r, leaf, self.rng.random((NOISE_EACH, len(word))).take(order, axis=1))
        ra = np.ones((len(r) + 1, DIM + 1), np.float32)
        ra[:-1, :DIM], ra[-1] = r, 0
        for level, node in enumerate(upper):
            dr += self._upper_graph(level, np.ascontiguousarray(ra[:, :DIM]), ra, node) if graphs.usable() else self._upper(level, ra[:-1], node)
        at, both = np.concatenate([one, two]), np.concatenate([dr * m.place[0], dr * m.place[1]])
        dplace = np.stack([np.einsum("ij,ij->j", dr, c1), np.einsum("ij,ij->j", dr, c2)])
        if graphs.usable():
            at, number = self._distinct(at)
            gradient = graphs.sums(both, number, len(at))
        else:
            at, order, first = _runs(at)
            gradient = _sum_runs(both.take(order, axis=0), first)
        self._add(0, at, gradient)
        self._add(1, np.arange(2), dplace)


def contexts(classes: list[np.ndarray], stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one before, two before, token) of all tokens of some texts; before a text stand two ends."""
    joined = np.concatenate([np.concatenate([[stop, stop], c]) for c in classes]).astype(np.int64)
    size = np.array([len(c) for c in classes])
    at = np.arange(size.sum()) + 2 * (np.repeat(np.arange(len(size)), size) + 1)
    return joined[at - 1], joined[at - 2], joined[at]


def units_of(blobs: list[bytes], classes: Classes) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """The place, the words and their units of each dictionary.  Some are looked up together, as a lookup
    goes over the whole vocabulary first."""
    for a in range(0, len(blobs), LOOKUP_BLOCKS):
        words = [word_column(blob) for blob in blobs[a : a + LOOKUP_BLOCKS]]
        units = np.split(classes.numbers(pa.concat_arrays(words)), np.cumsum([len(w) for w in words])[:-1])
        for k, (word, unit) in enumerate(zip(words, units)):
            yield a + k, word, unit


class Block:
    """A stored row: texts as word numbers, and the units of its words."""

    def __init__(self, row: dict, unit: np.ndarray, stop: int):
        self.unit, self.stop = unit, stop
        self.folds, self.sizes, self.ids = _unpack(row["folds"], np.int8), _unpack(row["sizes"], np.int64), _unpack(row["ids"], np.int32)

    def sequences(self, of: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Unit sequences of the texts ``of``, in lists of about PIECE_TOKENS tokens."""
        begin, found, held = np.cumsum(self.sizes) - self.sizes, [], 0
        for i in of.tolist():
            if held and held + self.sizes[i] > PIECE_TOKENS:
                yield found
                found, held = [], 0
            found.append(np.append(self.unit[self.ids[begin[i] : begin[i] + self.sizes[i]]], self.stop))
            held += len(found[-1])
        if found:
            yield found


def block_rows(batches: Iterator[pa.RecordBatch], classes: Classes) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i, _, unit in units_of(batch.column("words").to_pylist(), classes):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names) if name != "words"}
            yield row, Block(row, unit, classes.stop)


def average(table: pa.Table) -> pa.Table:
    """For one chunk of a parameter table: the changed rows and their averages over tasks."""
    which, chunk, width = (table.column(c)[0].as_py() for c in ("which", "chunk", "width"))
    sums, weight = np.zeros((CHUNK_ROWS, width)), np.zeros(CHUNK_ROWS)
    for at, x, w in zip(*(table.column(c).to_pylist() for c in ("at", "x", "w"))):
        at, w = np.frombuffer(at, np.int32), np.frombuffer(w, np.float32)
        sums[at] += np.frombuffer(x, np.float16).reshape(-1, width) * w[:, None].astype(float)
        weight[at] += w
    at = np.flatnonzero(weight)
    x = (sums[at] / weight[at, None]).astype(np.float32)
    return pa.table({"which": pa.array([which], pa.int32()), "at": pa.array([(at + chunk * CHUNK_ROWS).astype(np.int32).tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})


def train(coded: DataFrame, classes: Classes, units) -> Model:
    """ROUNDS rounds over the training texts, cut by their folds; each task returns the rows it
    changed (as differences), which are averaged by chunks of each parameter table.  There are no
    more tasks than run at once: what is shuffled grows with the copies of the model, not with the texts.
    ``units`` is the broadcast of ``classes``."""
    model, stop = Model(classes), classes.stop
    context = coded.sparkSession.sparkContext
    for round_ in range(ROUNDS):
        folds = [f for f in range(1, 10) if f % ROUNDS == round_]
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_, folds=folds) -> Iterator[pa.RecordBatch]:
            trainer = None
            for _, block in block_rows(batches, units.value):
                for sequences in block.sequences(np.flatnonzero(np.isin(block.folds, folds))):
                    trainer = trainer or Trainer(copy.deepcopy(shared.value), round_)
                    one, two, word = contexts(sequences, stop)
                    order = trainer.rng.permutation(len(word))
                    for i in range(0, len(word), STEP_TOKENS):
                        part = order[i : i + STEP_TOKENS]
                        trainer.step(one[part], two[part], word[part])
            for which, (before, x, seen) in enumerate(zip(shared.value.tables(), trainer.tables, trainer.seen) if trainer else ()):
                weight = (seen - FIRST_SQUARES).sum(1)
                for a in range(0, len(x), CHUNK_ROWS):
                    at = np.flatnonzero(weight[a : a + CHUNK_ROWS] > 0)
                    if len(at):
                        blobs = [at.astype(np.int32).tobytes(), (x[a + at] - before[a + at]).astype(np.float16).tobytes(), weight[a + at].astype(np.float32).tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()) for n in (which, a // CHUNK_ROWS, x.shape[1])] + [pa.array([b], pa.binary()) for b in blobs], names=["which", "chunk", "width", "at", "x", "w"])

        rows = coded.select("folds", "sizes", "ids", "words").coalesce(max(1, context.defaultParallelism))
        found = rows.mapInArrow(trimmed(run), "which int, chunk int, width int, at binary, x binary, w binary")
        tables = model.tables()
        for r in found.groupBy("which", "chunk").applyInArrow(average, "which int, at binary, x binary").toLocalIterator():  # as many numbers as the model has parameters
            at = np.frombuffer(r["at"], np.int32)
            tables[r["which"]][at] += np.frombuffer(r["x"], np.float32).reshape(len(at), -1)
        shared.unpersist()
    return model


def rare_words(coded: DataFrame, units) -> DataFrame:
    """(block, k, word): the words of each block that are no units of their own, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = units.value
        for batch in batches:
            blocks = batch.column(0).to_pylist()
            for i, words, unit in units_of(batch.column(1).to_pylist(), classes):
                block, rare = blocks[i], words.filter(pa.array(unit >= len(classes.words)))
                for a in range(0, len(rare), ROWS):
                    part = rare[a : a + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(np.arange(a, a + len(part), dtype=np.int32)), part], names=["block", "k", "word"])

    return coded.select("block", "words").mapInArrow(run, "block long, k int, word binary")


SCORED = "block long, doc_ids array<long>, folds binary, sizes binary, known binary, base binary, log_p binary, rares binary, rare binary, kind binary"


def score_blocks(coded: DataFrame, shared, units, floor: float) -> DataFrame:
    """For each block what its texts have without their rare words: the number of words, their base
    score, log P(units); and the rare words of each text, with the unit of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, classes = shared.value, units.value
        model.keep()
        alone, stop = len(classes.words), classes.stop
        for row, block in block_rows(batches, classes):
            n = len(block.sizes)
            log_p = []
            for sequences in block.sequences(np.arange(n)):
                p = model.log_p(*contexts(sequences, stop))
                log_p.append(np.add.reduceat(p, np.cumsum([0] + [len(s) for s in sequences[:-1]])))
            own = block.unit < alone
            text, is_rare = np.repeat(np.arange(n), block.sizes), ~own[block.ids]
            log_base = np.where(own, np.log10((classes.count[block.unit] + SMOOTH) / floor), 0.0)
            rares = np.bincount(text[is_rare], minlength=n)
            found = [block.sizes - rares, np.bincount(text, log_base[block.ids], n), np.concatenate(log_p), rares, (np.cumsum(~own) - 1)[block.ids[is_rare]].astype(np.int32), block.unit[~own]]
            blobs = [row["folds"], row["sizes"], *map(_pack, found)]
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["doc_ids"]], pa.list_(pa.int64()))] + [pa.array([b], pa.binary()) for b in blobs], names=["block", "doc_ids", "folds", "sizes", "known", "base", "log_p", "rares", "rare", "kind"])

    return coded.select("block", "doc_ids", "folds", "sizes", "ids", "words").mapInArrow(trimmed(run), SCORED)


def add_rare(scored: DataFrame, answers: DataFrame, classes: Classes, tokens: int, floor: float) -> DataFrame:
    """The texts with all their words, given (block, entry) of the rare ones: number << 32 and training count."""
    mass, stops = classes.count + SMOOTH * (classes.distinct + 1), classes.count[-1]
    end = math.log10((stops + SMOOTH) / floor)
    first = len(classes.words)  # rare words have the units from here on
    mass = mass[first:]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {name: left.column(name)[0].as_py() for name in left.schema.names}
        folds, sizes, known, rares = (_unpack(row[k], t) for k, t in (("folds", np.int8), ("sizes", np.int64), ("known", np.int64), ("rares", np.int64)))
        base, log_p = _unpack(row["base"], np.float64), _unpack(row["log_p"], np.float64)
        rare, kind, n = _unpack(row["rare"], np.int32), _unpack(row["kind"], np.int32), len(sizes)
        c, entry = np.zeros(len(kind)), right.column("entry").to_numpy()
        c[entry >> 32] = entry & 0xFFFFFFFF
        text = np.repeat(np.arange(n), rares)
        known = known + np.bincount(text, c[rare] > 0, n).astype(np.int64) + int(stops > 0)
        base = base + np.bincount(text, np.log10((c + SMOOTH) / floor)[rare], n) + end
        inner = np.bincount(text, np.log((c + SMOOTH) / mass[kind - first])[rare], n)
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(folds == 0), "n_tokens": pa.array(sizes + 1), "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, tokens, np.int64)),
                         "base_score": pa.array(base), "score": pa.array((log_p + inner) / math.log(10))})

    return scored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    context = docs.sparkSession.sparkContext
    coded = block_dictionaries(docs)
    counts = store(word_rows(coded).groupBy("word").agg(F.sum("n").alias("c")), "counts")
    words, tokens = (int(x or 0) for x in counts.agg(F.count(F.lit(1)), F.sum("c")).first())
    stops = int(coded.agg(F.sum("stops")).first()[0] or 0)
    tokens, distinct = tokens + stops, words + (stops > 0)
    floor = tokens + SMOOTH * (distinct + 1)
    classes, _ = word_classes(counts, stops)
    units = context.broadcast(classes)
    shared = context.broadcast(train(coded, classes, units))
    answers = rare_words(coded, units).join(counts.where(F.col("c") < MIN_COUNT), "word")
    answers = answers.select("block", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("c")).alias("entry"))
    return add_rare(score_blocks(coded, shared, units, floor), answers, classes, tokens, floor)
