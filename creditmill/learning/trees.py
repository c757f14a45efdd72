"""Decision trees, forests and boosted trees grown level by level from histograms.

Inputs are cut into bins of equal width within three deviations of the mean. A level of all trees is one pass:
(tree, node, input, bin) sums are combined on the executors, and what meets is bounded by trees x nodes x
inputs x bins, whatever the number of rows. Splits are chosen by windows over that table and
become an expression that finds the node of a row, so rows are never dealt anew.

Every node has a weight and a weighted sum of its target; a split gains sl^2 / nl + sr^2 / nr - s^2 / n. With 0/1 targets
that is the fall of the Gini impurity; with gradients and hessians it is Newton boosting.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditmill.learning.design import Scale
from creditmill.operators.splits import key_hash
from creditmill.session import stage, staged

BINS = 32
REACH = 3.0
DEPTH = 3
#: Rows that a child needs.
LEAST_ROWS = 20
#: Digits of a gain; closer ones are ties, which go to the first input and the lowest bin.
DIGITS = 9
TREES = 10
#: Inputs that a node of a forest may split by, chosen by a hash of tree, node and input.
INPUTS_PER_NODE = 4
ROUNDS = 3
RATE = 0.3
RIDGE = 1.0
#: Distribution function of the Poisson law of mean one, from its definition; 8 and more count as 8.
POISSON = []
_term = 2.718281828459045**-1
for _k in range(8):
    POISSON.append(_term + (POISSON[-1] if POISSON else 0.0))
    _term /= _k + 1


@dataclass(frozen=True)
class Node:
    """A node; ``input`` and ``bin`` are None in leaves. Rows of bins up to ``bin`` go to node 2i, others to 2i + 1."""

    tree: int
    node: int
    rows: int
    weight: float
    value: float
    input: int | None = None
    bin: int | None = None
    gain: float | None = None


def bin_of(standardised: Column) -> Column:
    place = F.floor((standardised + REACH) / (2 * REACH) * BINS)
    return F.greatest(F.lit(0), F.least(place, F.lit(BINS - 1))).cast("int")


def binned(rows: DataFrame, scale: Scale, *kept: str) -> DataFrame:
    """The kept columns and ``bins``, one per input, of standardised rows."""
    return rows.select(*kept, F.array(*[bin_of(F.col(name)) for name in scale.inputs]).alias("bins"))


def _path(nodes: dict[int, Node], node: int, wanted, bins: str = "bins") -> Column:
    """What ``wanted`` says of the node that a row ends in."""
    own = nodes.get(node)
    if own is None or own.input is None:
        return wanted(node)
    left, right = _path(nodes, 2 * node, wanted, bins), _path(nodes, 2 * node + 1, wanted, bins)
    return F.when(F.col(bins)[own.input] <= own.bin, left).otherwise(right)


def value(nodes: Sequence[Node], bins: str = "bins") -> Column:
    """The value of the leaf that a row of bins falls into, for the nodes of one tree."""
    own = {n.node: n for n in nodes}
    return _path(own, 1, lambda node: F.lit(own[node].value), bins)


def grow(rows: DataFrame, inputs: int, trees: int, depth: int, ridge: float = 0.0, inputs_per_node: int | None = None) -> list[Node]:
    """Nodes of all trees from rows of ``bins`` and ``parts``, an array of (tree, weight, target sum).

    ``rows`` is read once per level; give it as a written table. A node is not split when a child
    would have fewer than LEAST_ROWS rows or nothing is gained.
    """
    done: dict[int, dict[int, Node]] = {tree: {} for tree in range(trees)}
    parts = rows.select("bins", F.explode("parts").alias("part")).select("bins", "part.*")
    for level in range(depth):
        place = F.lit(None).cast("int")
        for tree in range(trees):
            here = _path(done[tree], 1, lambda node: F.lit(node if node >> level == 1 else None).cast("int"))
            place = F.when(F.col("tree") == tree, here).otherwise(place)
        at = parts.withColumn("node", place).where("node is not null")
        sums = (
            at.select("tree", "node", "weight", "target", F.posexplode("bins").alias("input", "bin"))
            .groupBy("tree", "node", "input", "bin")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight"), F.sum("target").alias("target"))
        )
        found = _best_splits(sums, inputs, ridge, inputs_per_node).collect()
        if not found:
            break
        for r in found:
            own = done[r["tree"]]
            total = Node(r["tree"], r["node"], r["all_rows"], r["all_weight"], r["all_target"] / (r["all_weight"] + ridge))
            own.setdefault(r["node"], total)
            if r["input"] is None:
                continue
            own[r["node"]] = Node(**{**own[r["node"]].__dict__, "input": r["input"], "bin": r["bin"], "gain": r["gain"]})
            for child, n, w, s in (
                (2 * r["node"], r["left_rows"], r["left_weight"], r["left_target"]),
                (2 * r["node"] + 1, r["all_rows"] - r["left_rows"], r["all_weight"] - r["left_weight"], r["all_target"] - r["left_target"]),
            ):
                own[child] = Node(r["tree"], child, n, w, s / (w + ridge))
    return [node for own in done.values() for _, node in sorted(own.items())]


def _best_splits(sums: DataFrame, inputs: int, ridge: float, inputs_per_node: int | None) -> DataFrame:
    """One row per node: its totals and its best split, nulls where there is none."""
    below = Window.partitionBy("tree", "node", "input").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("tree", "node", "input")
    amounts = ("rows", "weight", "target")
    run = sums.select(
        "tree", "node", "input", "bin",
        *[F.sum(a).over(below).alias(f"left_{a}") for a in amounts],
        *[F.sum(a).over(whole).alias(f"all_{a}") for a in amounts],
    )
    right_w, right_s = F.col("all_weight") - F.col("left_weight"), F.col("all_target") - F.col("left_target")
    gain = F.round(
        F.col("left_target") * F.col("left_target") / (F.col("left_weight") + ridge)
        + right_s * right_s / (right_w + ridge)
        - F.col("all_target") * F.col("all_target") / (F.col("all_weight") + ridge),
        DIGITS,
    )
    enough = (F.col("left_rows") >= LEAST_ROWS) & (F.col("all_rows") - F.col("left_rows") >= LEAST_ROWS)
    allowed = F.lit(True)
    if inputs_per_node is not None:
        name = F.concat_ws("-", "tree", "node", "input")
        order = Window.partitionBy("tree", "node").orderBy(key_hash(name, salt="inputs"), "input")
        chosen = sums.select("tree", "node", "input").distinct().withColumn("_n", F.row_number().over(order))
        run = run.join(chosen, ["tree", "node", "input"])
        allowed = F.col("_n") <= inputs_per_node
    run = run.withColumn("gain", F.when(enough & allowed, gain))
    good = F.col("gain") > 0
    run = run.withColumn("gain", F.when(good, F.col("gain")))
    best = Window.partitionBy("tree", "node").orderBy(F.desc_nulls_last("gain"), "input", "bin")
    first = run.withColumn("_best", F.row_number().over(best)).where("_best = 1")
    kept = [F.when(F.col("gain").isNotNull(), F.col(c)).alias(c) for c in ("input", "bin", "gain", "left_rows", "left_weight", "left_target")]
    return first.select("tree", "node", *kept, "all_rows", "all_weight", "all_target")


def nodes_table(spark: SparkSession, nodes: Sequence[Node], inputs: Sequence[str]) -> DataFrame:
    """(tree, node, rows, weight, value, input, bin, gain); leaves have no input. Values keep twelve decimals, and zero has no sign."""
    rows = [
        (n.tree, n.node, n.rows, float(n.weight), round(float(n.value), 12) + 0.0, None if n.input is None else inputs[n.input], n.bin, n.gain)
        for n in nodes
    ]
    return spark.createDataFrame(
        rows, "tree int, node int, rows bigint, weight double, value double, input string, bin int, gain double"
    )


def fit_tree(rows: DataFrame, scale: Scale, depth: int = DEPTH) -> list[Node]:
    """A tree of standardised rows with a label ``y``; leaf values are shares of the label 1."""
    part = F.array(F.struct(F.lit(0).alias("tree"), F.lit(1.0).alias("weight"), F.col("y").cast("double").alias("target")))
    with staged(binned(rows, scale, "y").select("bins", part.alias("parts")), "tree-rows") as own:
        return grow(own, len(scale.inputs), 1, depth)


def fit_without_each_fold(rows: DataFrame, scale: Scale, folds: int, depth: int = DEPTH, fold: str = "fold") -> list[list[Node]]:
    """For every fold the tree of all other folds, as ``fit_tree`` gives it; all trees are grown in one pass a level."""
    others = F.filter(F.array(*[F.lit(n) for n in range(folds)]), lambda n: n != F.col(fold))
    target = F.col("y").cast("double")
    parts = F.transform(others, lambda n: F.struct(n.alias("tree"), F.lit(1.0).alias("weight"), target.alias("target")))
    with staged(binned(rows, scale, "y", fold).select("bins", parts.alias("parts")), "fold-rows") as own:
        nodes = grow(own, len(scale.inputs), folds, depth)
    return [[n for n in nodes if n.tree == number] for number in range(folds)]


def draws(key: Column, tree: int) -> Column:
    """How often a row is drawn for a tree: a Poisson draw of mean one from a hash of its key."""
    u = (key_hash(key, tree, "bootstrap") + 0.5) / float(1 << 32)
    count = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        count = F.when(u < POISSON[k], k).otherwise(count)
    return count


def fit_forest(
    rows: DataFrame, scale: Scale, key: str, trees: int = TREES, depth: int = DEPTH, inputs_per_node: int = INPUTS_PER_NODE
) -> list[Node]:
    """All trees in one pass a level; the same forest however the rows are partitioned."""
    drawn = [
        F.struct(
            F.lit(t).alias("tree"),
            draws(F.col(key), t).cast("double").alias("weight"),
            (draws(F.col(key), t) * F.col("y")).cast("double").alias("target"),
        )
        for t in range(trees)
    ]
    parts = F.filter(F.array(*drawn), lambda p: p["weight"] > 0)
    with staged(binned(rows, scale, key, "y").select("bins", parts.alias("parts")), "forest-rows") as own:
        return grow(own, len(scale.inputs), trees, depth, 0.0, inputs_per_node)


def forest_probability(nodes: Sequence[Node], bins: str = "bins") -> Column:
    """The mean of the trees' leaf shares."""
    trees = sorted({n.tree for n in nodes})
    total = F.lit(0.0)
    for t in trees:
        total = total + value([n for n in nodes if n.tree == t], bins)
    return total / len(trees)


@dataclass(frozen=True)
class Boosted:
    """Trees added to the log odds of the label's share, and the mean log loss before each round and after the last."""

    start: float
    nodes: tuple[Node, ...]
    losses: tuple[float, ...]

    def log_odds(self, bins: str = "bins") -> Column:
        total = F.lit(self.start)
        for t in sorted({n.tree for n in self.nodes}):
            total = total + RATE * value([n for n in self.nodes if n.tree == t], bins)
        return total

    def probability(self, bins: str = "bins") -> Column:
        return 1.0 / (1.0 + F.exp(-self.log_odds(bins)))


def fit_boosted(rows: DataFrame, scale: Scale, rounds: int = ROUNDS, depth: int = DEPTH) -> Boosted:
    """Newton boosting; the scores of a round are written, so that lineage stays one round long."""
    share = rows.agg(F.avg("y")).first()[0]
    if not share or share == 1.0:
        raise ValueError("boosting needs rows of both classes")
    start = math.log(share / (1 - share))
    now = stage(binned(rows, scale, "y").withColumn("score", F.lit(start)), "boosting")
    nodes: list[Node] = []
    losses = []
    for number in range(rounds):
        p = 1.0 / (1.0 + F.exp(-F.col("score")))
        losses.append(now.agg(_loss()).first()[0])
        part = F.array(F.struct(F.lit(0).alias("tree"), (p * (1 - p)).alias("weight"), (F.col("y") - p).alias("target")))
        own = grow(now.select("bins", part.alias("parts")), len(scale.inputs), 1, depth, RIDGE)
        now = stage(now.withColumn("score", F.col("score") + RATE * value(own)), "boosting")
        nodes += [Node(**{**n.__dict__, "tree": number}) for n in own]
    losses.append(now.agg(_loss()).first()[0])
    return Boosted(start, tuple(nodes), tuple(losses))


def _loss() -> Column:
    """Mean log loss, without overflow at large scores."""
    score, y = F.col("score"), F.col("y")
    return F.avg(F.log1p(F.exp(-F.abs(score))) + F.greatest(score, F.lit(0.0)) - y * score)
