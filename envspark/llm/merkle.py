"""Merkle manifest of a table by sibling-shift self-joins.

Rows are hashed to leaves and numbered within their group by a range exchange and per-range counts,
so that no group has to be sorted by one task.  Every level of all trees at once is one equijoin of
the nodes with themselves: a node asks for the index beside its own (index XOR 1 in a binary tree;
slot + 1, ... modulo the arity otherwise), which gives it its siblings, and the nodes of slot zero
emit the parents.  The subroots are leaves of one tree above, built by the same function.  Proofs run
the other way: a level's nodes join the proof of their parent, from the root down.  All join keys
are unique (group, index) pairs, so no hot group can gather in a task.  Each level is a table in the
shared folder; the driver holds only the number of nodes.

Cases: nulls hash as ``-``; a null group is a group of its own and the first; rows are ordered by id,
nulls first, then by leaf; rows that are equal throughout follow each other in either order (their
leaves are equal, their proofs are not); a null id or a null counter is never tampered with; a single leaf
is its subroot and a single subroot is the root, with the digest of nothing as the proof's; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store

#: Rows of a numbered range; nodes that a task of a level joins at most and at least, about.
ROWS_PER_RANGE, MOST_NODES, LEAST_NODES = 100_000, 200_000, 10_000
#: Levels of proofs that one plan joins: the levels above them are a table of their own.
HOP = 4
#: Columns of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    """The 32 bytes of sha256; nodes are kept so and hashed as lowercase hex."""
    return F.unhex(F.sha2(value, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns.values()]))


def numbered(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    """``rows`` (a stored table with a group ``g``) with ``idx``, the place within the group by ``order``
    from 0, and ``n``, the rows of the group."""
    ranges = max(1, -(-count // ROWS_PER_RANGE), min(count // 1000, rows.sparkSession.sparkContext.defaultParallelism))
    # the row's place in the stored table parts equal rows, so that no range can be all of one value
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    cut = store(tied.repartitionByRange(ranges, "g", *order, "tie").withColumn("part", F.spark_partition_id()), "merkle-ranges")
    held = cut.groupBy("g", "part").agg(F.count(F.lit(1)).alias("held"))
    group = Window.partitionBy("g")  # as many rows as there are ranges at most
    before = held.select(
        "g", "part", F.sum("held").over(group).alias("n"),
        (F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("before"),
    )
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order, "tie"))
    joined = cut.withColumn("place", place).join(before, ["g", "part"])
    return joined.withColumn("idx", F.col("before") + F.col("place") - 1).drop("tie", "part", "place", "before")


def dealt(nodes: DataFrame, count: int, *keys: str) -> DataFrame:
    """``nodes`` by their keys, over more partitions than a session's shuffle has where they are many."""
    tasks = -(-count // MOST_NODES)
    return nodes.repartition(tasks, *keys) if tasks > int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")) else nodes


def climb(leaves: DataFrame, count: int, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees over ``leaves`` (g, idx, n, h, ... with ``n`` leaves in the tree), the lowest first, and
    their roots (g, level, h).

    A level holds (g, idx, n, h, sides, ...): ``n`` counts the nodes of the tree at this level and ``sides`` has
    the siblings' digests from left to right, each as one byte (0: to the left, 1: to the right) and the digest."""
    levels, roots, nodes, height, top = [], None, leaves, 0, 0
    while height <= top:
        mine, sides = nodes, []
        slot = F.col("idx") % arity
        for shift in range(1, arity):
            sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + shift) % arity
            name = f"s{shift}"
            other = dealt(nodes.select(F.col("g").alias("g2"), F.col("idx").alias(f"i{shift}"), F.col("h").alias(name)), count, "g2", f"i{shift}")
            asking = dealt(mine.withColumn("ask", sibling), count, "g", "ask")
            mine = asking.join(other, (F.col("g") == F.col("g2")) & (F.col("ask") == F.col(f"i{shift}")), "left").drop("g2", "ask")
            sides.append((f"i{shift}", name))
        entry = [F.struct(F.col(i).alias("i"), F.concat(F.when(F.col(i) < F.col("idx"), F.lit(b"\0")).otherwise(F.lit(b"\1")), F.col(s)).alias("side")) for i, s in sides]
        found = F.array_sort(F.filter(F.array(*entry), lambda x: x["i"].isNotNull()))
        mine = mine.withColumn("sides", F.transform(found, lambda x: x["side"])).drop(*[c for pair in sides for c in pair])
        # small levels are few tasks and files; coalesce never adds any
        level = store(mine.coalesce(max(1, -(-count // LEAST_NODES))), f"merkle-level-{height}")
        levels.append(level)
        if not height:  # the largest tree tells the levels, the number of trees bounds the nodes that a level has more than half
            trees, largest = level.where("idx = 0").agg(F.count(F.lit(1)), F.max("n")).first()
            while arity**top < (largest or 1):
                top += 1
        done = level.where("n = 1").select("g", F.lit(height).alias("level"), "h")
        roots = done if roots is None else roots.union(done)
        first = level.where((F.col("n") > 1) & (F.col("idx") % arity == 0))
        others = F.array_join(F.transform("sides", lambda x: hexed(F.substring(x, 2, 32))), "")
        nodes = first.select(
            "g", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), digest(F.concat(hexed(F.col("h")), others)).alias("h")
        )
        count, height = count // arity + trees, height + 1
    return levels, roots


def descend(levels: list[DataFrame], above: DataFrame, heights: set[int], count: int, arity: int = 2) -> DataFrame:
    """The lowest level (of ``count`` nodes) with ``proof``: the siblings from the node up to its root, then what
    ``above`` (g, level, proof, and columns that every node of the tree gets) has for the root.  ``heights``: the
    levels at which a tree ends."""
    extra = [c for c in above.columns if c not in ("g", "level", "proof")]
    below = None
    for height in range(len(levels) - 1, -1, -1):
        level = levels[height]
        columns = [*level.columns, "proof", *extra]
        parts = []
        if height in heights or below is None:
            # the root of a tree of this height takes its proof from above, one row for each tree
            ends = above.where(F.col("level") == height).select(F.col("g").alias("g2"), "proof", *extra)
            parts.append(level.where("n = 1").join(ends, F.col("g") == F.col("g2")).select(*columns))
        if below is not None:
            size = -(-count // arity**height)
            parents = dealt(below.select(F.col("g").alias("g2"), F.col("idx").alias("up"), F.col("proof").alias("rest"), *extra), size, "g2", "up")
            inner = dealt(level.where("n > 1").withColumn("ask", F.floor(F.col("idx") / arity)), size, "g", "ask")
            inner = inner.join(parents, (F.col("g") == F.col("g2")) & (F.col("ask") == F.col("up")))
            parts.append(inner.withColumn("proof", F.concat(F.array("sides"), "rest")).select(*columns))
        below = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        if height and height % HOP == 0:
            below = store(below.coalesce(max(1, -(-count // (LEAST_NODES * arity**height)))), f"merkle-proofs-{height}")
    return below


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give (hex)."""

    def step(node: Column, run: Column) -> Column:
        left = F.filter(run, lambda x: F.substring(x, 1, 1) == F.lit(b"\0"))
        right = F.filter(run, lambda x: F.substring(x, 1, 1) == F.lit(b"\1"))
        text = lambda side: F.array_join(F.transform(side, lambda x: hexed(F.substring(x, 2, 32))), "")
        return F.sha2(F.concat(text(left), node, text(right)), 256)

    return F.aggregate(proof, hexed(leaf), step)


def proof_text(proof: Column) -> Column:
    """Hex digests of all siblings of a proof, from the leaf up, left to right."""
    return F.array_join(F.transform(F.flatten(proof), lambda x: hexed(F.substring(x, 2, 32))), "")


def manifest(docs: DataFrame, group: str = "lang", tampered: Column | None = None, arity: int = 2) -> DataFrame:
    """(doc_id, leaf, forged, subroot, root, proof) of every row: binary digests and, level by level, the siblings that
    lead from the leaf to the root.  ``tampered``: where true, ``forged`` is the leaf of the row with 1 added to n_chars."""
    columns = {c: F.col(c) for c in FIELDS}
    forged = leaf_of(columns | {"n_chars": F.col("n_chars") + 1})
    change = F.col("n_chars").isNotNull() & F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    # null sorts first: it is the empty string, other groups have a letter before them
    g = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group)))
    leaves = store(docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(columns).alias("h"), F.when(change, forged).alias("forged")), "merkle-leaves")
    count = leaves.count()
    levels, subroots = climb(numbered(leaves, ["doc_id", "h"], count), count, arity)
    trees = store(subroots.select(F.lit("").alias("g"), F.col("g").alias("tree"), "level", "h"), "merkle-subroots")
    groups = trees.count()
    upper, top = climb(numbered(trees, ["tree"], groups), groups, arity)
    nothing = F.array().cast("array<array<binary>>")
    proofs = descend(upper, top.select("g", F.col("level"), nothing.alias("proof"), F.col("h").alias("root")), {len(upper) - 1}, groups, arity)
    above = store(proofs.select(F.col("tree").alias("g"), "level", "proof", F.col("h").alias("subroot"), "root"), "merkle-upper")
    heights = {r["level"] for r in above.select("level").distinct().collect()}  # at most one for each level
    lower = descend(levels, above, heights, count, arity)
    return lower.select("doc_id", F.col("h").alias("leaf"), "forged", "subroot", "root", "proof")
