"""A fitted risk model as a table of its trees' nodes, and scoring from that table alone."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convoy.session import shared_dir


def export_trees(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row per node: tree, weight, node, feature, cut, left, right, value.

    A row goes left where its feature is at most ``cut``; ``feature``, ``cut``, ``left`` and ``right`` are null at a
    leaf, node 0 is a tree's root. The nodes are those that Spark stores with a model.
    """
    assembler, boosted = model.stages
    path = shared_dir(spark, "risk-model")
    boosted.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "document", "weight").select("tree", "weight")
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    names = F.array(*[F.lit(c) for c in assembler.getInputCols()])

    def inner(value: Column) -> Column:
        return F.when(F.col("leftChild") >= 0, value)

    return nodes.join(weights, "tree").select(
        "tree",
        "weight",
        F.col("id").alias("node"),
        inner(F.get(names, F.col("split.featureIndex"))).alias("feature"),
        inner(F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("cut"),
        inner(F.col("leftChild")).alias("left"),
        inner(F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"),
    )


def _placed(trees: DataFrame, depth: int) -> DataFrame:
    """The nodes with ``place``: 1 at the root, twice a node's place to its left, one more to its right."""
    level = trees.filter("node = 0").withColumn("place", F.lit(1))
    out = level
    for _ in range(depth):
        sides = F.explode(F.array(*[F.struct(F.col(c).alias("node"), (F.col("place") * 2 + k).alias("place")) for k, c in enumerate(("left", "right"))]))
        children = level.filter("feature IS NOT NULL").select("tree", sides.alias("c")).select("tree", "c.*")
        level = trees.join(children, ["tree", "node"]).select(*trees.columns, "place")
        out = out.unionByName(level)
    return out


def score_by_table(features: DataFrame, trees: DataFrame, depth: int = 3) -> DataFrame:
    """``features`` with ``risk``, the probability by the boosted trees of ``trees`` (:func:`export_trees`).

    ``depth`` is the depth that the model was trained with. Every tree becomes one array of nodes by place and the model
    one value that all rows share: its size goes by the model's trees and depth, and rows are neither multiplied nor
    shuffled. A row walks down level by level; a missing feature counts as zero.
    """
    used = sorted(r.feature for r in trees.filter("feature IS NOT NULL").select("feature").distinct().collect())  # column names
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in features.columns else F.lit(0.0) for c in used], F.lit(0.0))
    numbers = F.array(*[F.lit(c) for c in used], F.lit(""))
    node = F.struct("place", (F.array_position(numbers, F.col("feature")) - 1).cast("int").alias("of"), "cut", "value")
    arrays = (
        _placed(trees, depth)
        .groupBy("tree", "weight")
        .agg(F.collect_list(node).alias("found"))
        .select(
            "tree",
            "weight",
            F.expr(f"transform(sequence(1, {2 ** (depth + 1) - 1}), p -> get(filter(found, n -> n.place = p), 0))").alias("nodes"),
        )
    )
    model = arrays.agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "nodes")))).scalar()
    scored = features.withColumn("_model", model).withColumn("_x", values)
    walk = (
        f"aggregate(sequence(1, {depth}), 1, (at, level) -> CASE WHEN t.nodes[at - 1].of IS NULL THEN at "
        "WHEN _x[t.nodes[at - 1].of] <= t.nodes[at - 1].cut THEN 2 * at ELSE 2 * at + 1 END)"
    )
    margin = F.expr(f"aggregate(_model, 0D, (sum, t) -> sum + t.weight * t.nodes[{walk} - 1].value)")
    return scored.withColumn("risk", 1 / (1 + F.exp(-2 * margin))).drop("_model", "_x")
