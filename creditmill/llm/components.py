"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.session import delete_folder, scratch_path


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of a node are linked to its smallest neighbour.

    The large form moves the larger neighbours, the small form the smaller ones
    and the node itself. Minima are combined before the shuffle and the joins
    carry two integers, so a node with very many neighbours can be split.
    """
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = pairs.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    moved = pairs.join(low, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        )
    return moved.where("a <> b").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(edges.sparkSession, "edges")
    edges.write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path), path


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    ``edges`` has two columns of one comparable type. Loops, repeats and edges
    with a null end are ignored; without edges the result is empty. Every round is
    written to the shared folder, so that lineage stays short, and the round before is deleted; it ends when a round changes
    nothing, after a number of rounds logarithmic in the number of nodes.
    """
    a, b = edges.columns
    now, path = _written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    state = _state(now)
    while state[0]:
        old = path
        now, path = _written(_stars(_stars(now, True), False))
        delete_folder(now.sparkSession, old)
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
