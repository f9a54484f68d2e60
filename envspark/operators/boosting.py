"""Histogram gradient boosting for squared error (J10), several models at once.

Rows are binned once (at most 255 bins and one for missing values) and packed, by a hash of
their key, into blocks of bounded size.  A level of a tree needs one sum per (model, node): the
histogram of residuals and counts over bins, from which the best split and the side of missing
values follow by gain.  All models, the cross-validation folds and the final one, grow a level in the
same step.

* Few rows (one block, its size is bounded): a block is its own sum, so each model grows in one
  task, all models side by side, in a single Spark job.
* More blocks: every block writes histograms of the open nodes; they are summed per (model,
  node) in two steps, so no task meets more than the square root of the blocks, and only splits
  come back.  Blocks replay the trees since the last stored scores, so a lost task needs nothing but its block.

Both run the same code (``boost`` with another way to ask for splits).  A full tree of the given
depth is grown, then cut back to what growing leaf by leaf in order of gain, up to the number of
leaves, would have split.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block, trees that blocks replay before their scores are stored.
ROWS_PER_BLOCK, REPLAY = 200_000, 20
MISSING = 255
BLOCK = "block long, n long, codes binary, label binary, fold binary, score binary"
FOUND = "model int, node int, total double, n double, gain double, feature int, code int, missing_left boolean, left_total double, left_n double"


@dataclass(frozen=True)
class Settings:
    iterations: int
    rate: float
    depth: int
    least: int
    bins: int = 255
    leaves: int = 31
    #: residuals are multiples of this power of two (set from the labels), so that their sums are exact
    #: and the model is the same however rows are cut into blocks
    unit: float = 2.0**-20


# ------------------------------------------------------------------ bins and blocks
def bin_edges(frame: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins: halfway between neighbours where a feature has at most
    ``bins`` values, else quantiles (each an observed value, rank error 1e-5)."""
    bins = min(bins, MISSING)
    long = frame.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(features)])).alias("p")).select("p.*")
    values = long.where("v is not null and not isnan(v)").groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    sizes = {r["k"]: r["n"] for r in values.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [k for k, n in sizes.items() if n <= bins]
    edges: list[np.ndarray] = [np.zeros(0)] * len(features)
    for r in values.where(F.col("k").isin(few)).groupBy("k").agg(F.array_sort(F.collect_set("v")).alias("v")).collect():  # at most 255 numbers a feature
        v = np.array(r["v"], float)
        edges[r["k"]] = (v[:-1] + v[1:]) / 2
    many = [k for k, n in sizes.items() if n > bins]
    if many:
        levels = [float(x) for x in np.arange(1, bins) / bins]
        clean = lambda c: F.when(~F.isnan(c), F.col(c))
        row = frame.agg(*[F.percentile_approx(clean(features[k]), levels, 100_000).alias(f"e{k}") for k in many]).first()
        for k in many:
            edges[k] = np.unique(np.array(row[f"e{k}"], float))
    return edges


def codes_of(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """(rows, features) bin numbers; missing values have their own."""
    out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint8)
    for k, x in enumerate(columns):
        out[:, k] = np.where(np.isnan(x), MISSING, np.searchsorted(edges[k], x, side="left"))
    return out


def floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Numbers of an Arrow column; nulls are not-a-number."""
    return np.array(column.cast(pa.float64()).to_pandas(), float)


def pack_blocks(frame: DataFrame, keys: list[str], features: list[str], label: str, fold: str, edges: list[np.ndarray], count: int) -> DataFrame:
    """``frame`` as blocks of about ROWS_PER_BLOCK rows, dealt by a hash of the row's key: the
    blocks, and so the model, do not depend on files or on the size of the cluster."""
    number = max(1, -(-count // ROWS_PER_BLOCK))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in keys])
        codes = codes_of([floats(table.column(c)) for c in features], edges)
        y, f = floats(table.column(label)), np.asarray(floats(table.column(fold)), np.int16)
        one = lambda b: pa.array([b], pa.binary())
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "n": pa.array([len(y)], pa.int64()), "codes": one(codes.tobytes()),
                         "label": one(y.tobytes()), "fold": one(f.tobytes()), "score": one(b"")})

    dealt = frame.select(F.pmod(F.xxhash64(*keys), F.lit(number)).alias("block"), *keys, *[c for c in features if c not in keys], label, fold)
    return dealt.groupBy("block").applyInArrow(pack, BLOCK)


# ------------------------------------------------------------------ trees
class Tree:
    """Nodes by number (children of i: 2i + 1 and 2i + 2); feature -1 marks a leaf."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth, self.feature, self.code = depth, np.full(size, -1, np.int16), np.zeros(size, np.uint8)
        self.missing_left, self.value = np.zeros(size, bool), np.zeros(size)

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(self.depth):
            feature = self.feature[at]
            split = feature >= 0
            if not split.any():
                break
            c = codes[row, np.maximum(feature, 0)]
            left = np.where(c == MISSING, self.missing_left[at], c <= self.code[at])
            at = np.where(split, 2 * at + 2 - left, at)
        return at


def split_of(found: tuple) -> dict:
    return dict(zip(("total", "n", "gain", "feature", "code", "missing_left", "left_total", "left_n"), found))


def histogram(codes_t: np.ndarray, residual: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """(slots, features, 256, 2): sums of residuals and rows of each bin, for rows with a slot >= 0."""
    inside = slot >= 0
    if not inside.all():
        codes_t, residual, slot = codes_t[:, inside], residual[inside], slot[inside]
    out = np.empty((slots, len(codes_t), 256, 2))
    base = slot * 256
    for k, c in enumerate(codes_t):
        key = base + c
        out[:, k, :, 0] = np.bincount(key, residual, slots * 256).reshape(slots, 256)
        out[:, k, :, 1] = np.bincount(key, minlength=slots * 256).reshape(slots, 256)
    return out


def best_split(h: np.ndarray, least: int) -> tuple:
    """(total, n, gain, feature, code, missing left, total and n of the left side) of one node's histogram (features, 256, 2);
    gain 0 where no split leaves ``least`` rows on both sides."""
    total, n = float(h[0, :, 0].sum()), float(h[0, :, 1].sum())
    miss, body = h[:, MISSING], np.cumsum(h[:, :MISSING], axis=1)
    left = np.stack([body, body + miss[:, None]])  # missing values to the right, to the left
    g, m = left[..., 0], left[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / m + (total - g) ** 2 / (n - m) - total * total / n
    gain[~((m >= least) & (n - m >= least))] = -1
    side, feature, code = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = float(gain[side, feature, code])
    if not best > 1e-12:
        return total, n, 0.0, -1, 0, False, 0.0, 0.0
    gl, nl = float(g[side, feature, code]), float(m[side, feature, code])
    # without missing values here, later ones go where most rows went
    to_left = bool(side) if miss[feature, 1] else nl > n - nl
    return total, n, best, int(feature), int(code), to_left, gl, nl


def cut_back(grown: dict[int, dict], s: Settings) -> Tree:
    """The tree that growing leaf by leaf, the largest gain first, makes of all possible splits."""
    tree = Tree(s.depth)
    worth = lambda node: s.rate * node["total"] / node["n"] if node["n"] else 0.0
    tree.value[0] = worth(grown[0])
    open_ = [(-grown[0]["gain"], 0)] if grown[0]["gain"] > 0 else []
    leaves = 1
    while open_ and leaves < s.leaves:
        _, i = heapq.heappop(open_)
        node = grown[i]
        tree.feature[i], tree.code[i], tree.missing_left[i] = node["feature"], node["code"], node["missing_left"]
        sides = ({"total": node["left_total"], "n": node["left_n"]}, {"total": node["total"] - node["left_total"], "n": node["n"] - node["left_n"]})
        for j, side in zip((2 * i + 1, 2 * i + 2), sides):
            tree.value[j] = worth(side)
            if j in grown and grown[j]["gain"] > 0:
                heapq.heappush(open_, (-grown[j]["gain"], j))
        leaves += 1
    return tree


def boost(models: list[int], s: Settings, ask: Callable[[dict[int, list[int]], dict[int, Tree]], dict[tuple[int, int], dict]], done: Callable[[dict[int, Tree]], None]) -> None:
    """Grow ``s.iterations`` trees per model.  ``ask(open nodes, trees so far)`` gives the split of each
    (model, node); ``done(trees)`` takes the finished trees of an iteration."""
    for _ in range(s.iterations):
        grown: dict[int, dict[int, dict]] = {m: {} for m in models}
        partial = {m: Tree(s.depth) for m in models}
        open_ = {m: [0] for m in models}
        for level in range(s.depth):
            found = ask(open_, partial)
            open_ = {m: [] for m in models}
            for (m, i), split in found.items():
                grown[m][i] = split
                if split["gain"] > 0:
                    tree = partial[m]
                    tree.feature[i], tree.code[i], tree.missing_left[i] = split["feature"], split["code"], split["missing_left"]
                    if level + 1 < s.depth:
                        open_[m] += [2 * i + 1, 2 * i + 2]
            open_ = {m: sorted(x) for m, x in open_.items()}
            if not any(open_.values()):
                break
        done({m: cut_back(grown[m], s) for m in models})


class Held:
    """One block in a task: binned rows and, per model, the scores and residuals that its trees give."""

    def __init__(self, row: dict, models: list[int], base: dict[int, float], features: int, unit: float):
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, features)
        self.codes_t = np.ascontiguousarray(self.codes.T)
        self.label, self.fold = np.frombuffer(row["label"], float), np.frombuffer(row["fold"], np.int16)
        self.unit = unit
        held = np.frombuffer(row["score"], float).reshape(len(models), -1) if row["score"] else None
        self.score = {m: held[k].copy() if held is not None else np.full(len(self.label), base[m]) for k, m in enumerate(models)}

    def learn(self, trees: dict[int, Tree]) -> None:
        for m, t in trees.items():
            self.score[m] += t.value[t.nodes(self.codes)]

    def open_histograms(self, m: int, nodes: list[int], partial: Tree) -> np.ndarray:
        slot_of = np.full(len(partial.feature), -1, np.int64)
        slot_of[nodes] = np.arange(len(nodes))
        slot = np.where(self.fold == m, -1, slot_of[partial.nodes(self.codes)])
        residual = np.round((self.label - self.score[m]) / self.unit) * self.unit
        return histogram(self.codes_t, residual, slot, len(nodes))

    def errors(self, m: int) -> tuple[int, float, float]:
        """Rows held out of a model (all for the final one), sums of absolute and squared errors."""
        out = self.fold == m if m >= 0 else np.ones(len(self.fold), bool)
        e = self.label[out] - self.score[m][out]
        return int(out.sum()), float(np.abs(e).sum()), float((e * e).sum())


class Boosted:
    """A fitted model: bins, base value and trees."""

    def __init__(self, features: list[str], edges: list[np.ndarray], base: float, trees: list[Tree]):
        self.features, self.edges, self.base, self.trees = features, edges, base, trees

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        codes = codes_of(columns, self.edges)
        out = np.full(len(codes), self.base)
        for t in self.trees:
            out += t.value[t.nodes(codes)]
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the predictions of its rows; the model (a few hundred small trees) is broadcast."""
        from pyspark.sql.types import DoubleType, StructField, StructType

        shared = df.sparkSession.sparkContext.broadcast(self)
        schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for b in batches:
                columns = [floats(b.column(b.schema.get_field_index(c))) for c in model.features]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(columns), pa.float64())], names=[*b.schema.names, out])

        return df.mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, int(i), int(t.feature[i]), int(t.code[i]), bool(t.missing_left[i]), float(t.value[i])) for k, t in enumerate(self.trees)
                for i in np.flatnonzero((t.feature >= 0) | (t.value != 0))]
        spark.createDataFrame(rows, "tree int, node int, feature int, code int, missing_left boolean, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        depth, base, n = self.trees[0].depth if self.trees else 0, self.base, len(self.trees)
        bins = [(k, c, [float(x) for x in e], depth, base, n) for k, (c, e) in enumerate(zip(self.features, self.edges))]
        spark.createDataFrame(bins, "k int, feature string, edges array<double>, depth int, base double, trees int").coalesce(1).write.mode("overwrite").parquet(f"{path}/bins")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        bins = sorted(spark.read.parquet(f"{path}/bins").collect(), key=lambda r: r["k"])  # one row a feature
        trees = [Tree(bins[0]["depth"]) for _ in range(bins[0]["trees"])]
        for r in spark.read.parquet(f"{path}/trees").collect():  # at most 61 rows a tree
            t, i = trees[r["tree"]], r["node"]
            t.feature[i], t.code[i], t.missing_left[i], t.value[i] = r["feature"], r["code"], r["missing_left"], r["value"]
        return Boosted([r["feature"] for r in bins], [np.array(r["edges"], float) for r in bins], bins[0]["base"], trees)


# ------------------------------------------------------------------ fitting
def fit(frame: DataFrame, keys: list[str], features: list[str], label: str, fold: str, folds: int, s: Settings) -> tuple[Boosted, dict[int, tuple[int, float, float]], int]:
    """The model of all rows, (rows, absolute, squared error sums) of each held-out fold (and, under -1, of the final model on its
    own rows), and the number of rows.  ``fold``: 0 to ``folds`` - 1; ``keys`` tell rows apart."""
    from ..session import cut_lineage

    models = [-1, *range(folds)]
    means = [F.avg(F.when(F.col(fold) != m, F.col(label).cast("double"))).alias(f"m{m + 1}") for m in models]
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col(label).cast("double"))).alias("top"), *means).first()
    if row["top"]:
        s = replace(s, unit=2.0 ** (math.ceil(math.log2(row["top"])) - 26))
    base = {m: float(row[f"m{m + 1}"] or 0.0) for m in models}
    edges = bin_edges(frame, features, s.bins)
    blocks = cut_lineage(pack_blocks(frame, keys, features, label, fold, edges, row["n"]))
    run = _fit_block if blocks.count() <= 1 else _fit_blocks
    trees, errors = run(blocks, models, base, len(features), s)
    return Boosted(features, edges, base[-1], trees[-1]), errors, int(row["n"])


def _fit_block(blocks: DataFrame, models: list[int], base: dict[int, float], features: int, s: Settings):
    """Every model in a task of its own, over the one block."""

    def grow(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        m = row["model"]
        held, rows = Held(row, [m], base, features, s.unit), []

        def ask(open_, partial):
            h = held.open_histograms(m, open_[m], partial[m])
            return {(m, i): split_of(best_split(h[k], s.least)) for k, i in enumerate(open_[m])}

        def done(trees):
            held.learn(trees)
            t = trees[m]
            for a in (t.feature.astype("<i2"), t.code, t.missing_left, t.value.astype("<f8")):
                rows.append(a.tobytes())

        boost([m], s, ask, done)
        n, absolute, squared = held.errors(m)
        return pa.table({"model": pa.array([m], pa.int32()), "n": pa.array([n], pa.int64()), "absolute": pa.array([absolute]), "squared": pa.array([squared]),
                         "trees": pa.array([rows], pa.list_(pa.binary()))})

    copies = blocks.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    out = copies.repartition(len(models), "model").groupBy("model").applyInArrow(grow, "model int, n long, absolute double, squared double, trees array<binary>").collect()
    trees, errors = {}, {}
    for r in out:
        errors[r["model"]] = (r["n"], r["absolute"], r["squared"])
        grown = trees[r["model"]] = []
        for i in range(0, len(r["trees"]), 4):
            t = Tree(s.depth)
            blobs = [bytes(b) for b in r["trees"][i : i + 4]]
            t.feature, t.code = np.frombuffer(blobs[0], "<i2").astype(np.int16), np.frombuffer(blobs[1], np.uint8)
            t.missing_left, t.value = np.frombuffer(blobs[2], bool), np.frombuffer(blobs[3], "<f8")
            grown.append(t)
    return {m: trees.get(m, []) for m in models}, errors


def _fit_blocks(blocks: DataFrame, models: list[int], base: dict[int, float], features: int, s: Settings):
    """All models a level at a time: histograms by block, summed per node; only splits reach the driver."""
    from ..session import cut_lineage

    trees: dict[int, list[Tree]] = {m: [] for m in models}
    state = {"blocks": blocks, "new": []}
    parts = max(1, math.isqrt(blocks.count()))

    def replayed(row: dict, new: list[dict[int, Tree]]) -> Held:
        held = Held(row, models, base, features, s.unit)
        for t in new:
            held.learn(t)
        return held

    def ask(open_, partial):
        new = list(state["new"])

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    held = replayed(row, new)
                    for m, nodes in open_.items():
                        if nodes:
                            h = held.open_histograms(m, nodes, partial[m])
                            k = len(nodes)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([m] * k, pa.int32()), pa.array(nodes, pa.int32()), pa.array([row["block"] % parts] * k, pa.int64()), pa.array([x.tobytes() for x in h], pa.binary())],
                                names=["model", "node", "part", "h"])

        def add(table: pa.Table) -> np.ndarray:
            total = np.zeros(features * 512)
            for x in table.column("h"):
                total += np.frombuffer(x.as_buffer(), float)
            return total

        def some(table: pa.Table) -> pa.Table:
            return pa.table({"model": table.column("model")[:1], "node": table.column("node")[:1], "h": pa.array([add(table).tobytes()], pa.binary())})

        def choose(table: pa.Table) -> pa.Table:
            found = best_split(add(table).reshape(features, 256, 2), s.least)
            names = [f.split()[0] for f in FOUND.split(", ")]
            kinds = [pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64()]
            columns = [table.column("model")[:1], table.column("node")[:1], *[pa.array([x], t) for x, t in zip(found, kinds)]]
            return pa.table(dict(zip(names, columns)))

        sums = state["blocks"].mapInArrow(histograms, "model int, node int, part long, h binary")
        sums = sums.groupBy("model", "node", "part").applyInArrow(some, "model int, node int, h binary")
        rows = sums.groupBy("model", "node").applyInArrow(choose, FOUND).collect()  # one split a node
        return {(r["model"], r["node"]): split_of(tuple(r)[2:]) for r in rows}

    def done(grown):
        for m, t in grown.items():
            trees[m].append(t)
        state["new"].append(grown)
        if len(state["new"]) >= REPLAY:
            new = list(state["new"])

            def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    at = b.schema.get_field_index("score")
                    out = [np.stack([h.score[m] for m in models]).tobytes() for h in (replayed(row, new) for row in b.to_pylist())]
                    yield b.set_column(at, "score", pa.array(out, pa.binary()))

            state["blocks"], state["new"] = cut_lineage(state["blocks"].mapInArrow(scored, BLOCK)), []

    boost(models, s, ask, done)
    new = list(state["new"])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                held = replayed(row, new)
                n, absolute, squared = zip(*[held.errors(m) for m in models])
                yield pa.RecordBatch.from_arrays([pa.array(models, pa.int32()), pa.array(n, pa.int64()), pa.array(absolute), pa.array(squared)], names=["model", "n", "absolute", "squared"])

    out = state["blocks"].mapInArrow(errors, "model int, n long, absolute double, squared double").groupBy("model").agg(F.sum("n"), F.sum("absolute"), F.sum("squared")).collect()
    return trees, {r[0]: (r[1], r[2], r[3]) for r in out}
