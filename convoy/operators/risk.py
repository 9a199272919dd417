"""Breakdown risk: features, rule score, model, thresholds and metrics."""

from __future__ import annotations

import datetime as dt
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from convoy.operators.insights import trailing
from convoy.operators.numbering import exact_quantiles, running_by_value
from convoy.operators.state import positive
from convoy.schemas import RISK_FEATURES
from convoy.session import ensure_checkpoint_dir, staged


def risk_features(
    rollup: DataFrame,
    as_of: dt.datetime,
    hours: int = 24,
    min_events: int = 30,
    cap: int | None = None,
    days: int | None = None,
) -> DataFrame:
    """Ratios per vehicle with enough events.

    ``days`` takes the window's length in days; ``cap`` keeps only the worst by fault and braking counts.
    """
    window = {"days": days} if days is not None else {"hours": hours}
    agg = (
        trailing(rollup, "hour", as_of, **window)
        .groupBy("vin")
        .agg(
            F.sum("event_count").alias("n"),
            F.sum("idle_events").alias("idle"),
            F.sum("harsh_events").alias("harsh"),
            F.sum("dtc_events").alias("dtc"),
            F.sum("overspeed_events").alias("over"),
            F.sum("lowfuel_events").alias("low"),
            (F.max("odo_max") - F.min("odo_min")).alias("km"),
            F.max("odo_max").alias("odo"),
            (F.unix_seconds(F.max("hour")) - F.unix_seconds(F.min("hour")) + 3600).alias("secs"),
        )
        .filter(F.col("n") >= min_events)
    )
    if cap is not None:
        agg = agg.orderBy(F.desc("dtc"), F.desc("harsh"), "vin").limit(cap)
    n = F.col("n")
    return agg.select(
        "vin",
        (F.col("idle") / n).alias("idle_ratio"),
        (F.col("harsh") / n).alias("harsh_ratio"),
        (F.col("dtc") / n).alias("dtc_ratio"),
        (F.col("over") / n).alias("overspeed_ratio"),
        (F.col("low") / n).alias("lowfuel_ratio"),
        (F.col("km") / (F.col("secs") / 3600)).alias("km_per_hour"),
        F.col("odo").alias("odo_km"),
    )


def rule_risk_score() -> Column:
    total = (
        F.col("dtc_ratio") * 400
        + F.col("harsh_ratio") * 300
        + F.col("idle_ratio") * 1.5
        + F.col("overspeed_ratio") * 20
        + F.col("lowfuel_ratio")
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / 10))


def rule_risk(features: DataFrame) -> DataFrame:
    return features.withColumn("risk", rule_risk_score())


def score(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Model probability per row; a missing feature counts as zero."""
    for name in RISK_FEATURES:
        value = F.coalesce(F.col(name), F.lit(0.0)) if name in features.columns else F.lit(0.0)
        features = features.withColumn(name, value)
    out = model.transform(features)
    keep = features.columns
    return out.select(*keep, vector_to_array("probability")[1].alias("risk"))


def risk_ranking(
    features: DataFrame, model: PipelineModel | None = None, limit: int = 10
) -> DataFrame:
    """Riskiest vehicles by the model, or by the rules where there is no model."""
    scored = rule_risk(features) if model is None else score(features, model)
    source = "rules_fallback" if model is None else "ml"
    return (
        scored.orderBy(F.desc("risk"), "vin")
        .limit(positive(limit, "limit"))
        .withColumn("risk", F.round("risk", 4))
        .withColumn("source", F.lit(source))
    )


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "vin", test_share: float = 0.25
) -> DataFrame:
    """Add ``is_test``: the same share of every label, chosen by hash order.

    The cut is an exact quantile of the hash per label, so no label is ranked in one task.
    """
    hashed = df.withColumn("_h", F.xxhash64(key))
    cuts = None
    for value in (0, 1):
        one = exact_quantiles(
            hashed.filter(F.col(label) == value).select(F.col("_h").cast("double").alias("_h")),
            "_h",
            [test_share],
        ).select(F.lit(value).alias(label), F.col("value").alias("_cut"))
        cuts = one if cuts is None else cuts.unionByName(one)
    return (
        hashed.join(cuts, label)
        .withColumn("is_test", F.col("_h").cast("double") < F.col("_cut"))
        .drop("_h", "_cut")
    )


def train_risk_model(
    df: DataFrame, trees: int = 150, depth: int = 3, step: float = 0.08, seed: int = 1
) -> PipelineModel:
    """Gradient-boosted trees on the risk features; lineage is cut by checkpoints every ten trees."""
    ensure_checkpoint_dir(df.sparkSession)
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(RISK_FEATURES), outputCol="features"),
            GBTClassifier(
                featuresCol="features",
                labelCol="label",
                maxIter=trees,
                maxDepth=depth,
                stepSize=step,
                seed=seed,
            ),
        ]
    ).fit(df)


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    whole = 2 * tp + fp + fn
    return F.when(whole > 0, 2 * tp / whole).otherwise(F.lit(0.0))


def best_threshold(
    scored: DataFrame, lo: float = 0.05, hi: float = 0.9, n: int = 60, score_col: str = "risk"
) -> DataFrame:
    """The threshold of an even grid with the best F1 (the lowest on ties).

    A row is counted once, under the number of grid points it reaches; totals per threshold are then
    sums over those n + 1 groups, so rows are never multiplied by the grid.
    """
    grid = [lo + (hi - lo) * i / (n - 1) for i in range(n)]
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col(score_col)))
    counts = scored.groupBy(reached.alias("reached")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    points = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    )
    per_point = (
        counts.select("*", points.alias("g"))
        .groupBy("g.i", "g.threshold")
        .agg(
            F.sum(F.when(F.col("reached") > F.col("g.i"), F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("reached") > F.col("g.i"), F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(F.col("reached") <= F.col("g.i"), F.col("pos")).otherwise(0)).alias("fn"),
        )
        .withColumn("f1", _f1(F.col("tp"), F.col("fp"), F.col("fn")))
    )
    best = F.max_by(F.struct("threshold", "f1", "tp", "fp", "fn"), F.struct("f1", -F.col("i")))
    return per_point.agg(best.alias("b")).select("b.*")


def rule_baseline(
    df: DataFrame, grid: int = 25, lo: float = 0.5, hi: float = 0.99
) -> DataFrame:
    """Best F1 of ``dtc_ratio > a OR harsh_ratio > b`` over a grid of training quantiles.

    Each row is counted under the number of cuts it exceeds on either axis; the grid is evaluated
    on those counts. The first best pair in (a, b) order wins, and F1 must be above zero. The three columns read
    are staged; the ``grid`` cuts of each axis come to the driver.
    """
    shares = [lo + (hi - lo) * i / (grid - 1) for i in range(grid)]
    rows = df = staged(df.select("dtc_ratio", "harsh_ratio", "label"))
    for name, column in {"dtc": "dtc_ratio", "harsh": "harsh_ratio"}.items():
        cuts = [r.value for r in sorted(exact_quantiles(df.select(column), column, shares).collect(), key=lambda r: r.i)]
        rows = rows.withColumn(f"_{name}_cuts", F.array(*map(F.lit, cuts)).cast("array<double>"))
        rows = rows.withColumn(
            f"_{name}_over", F.size(F.filter(f"_{name}_cuts", lambda c: c < F.col(column)))
        )
    counts = rows.groupBy("_dtc_over", "_harsh_over", "_dtc_cuts", "_harsh_cuts").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    pairs = counts.select("*", F.posexplode("_dtc_cuts").alias("a", "dtc_cut")).select(
        "*", F.posexplode("_harsh_cuts").alias("b", "harsh_cut")
    )
    said_yes = (F.col("_dtc_over") > F.col("a")) | (F.col("_harsh_over") > F.col("b"))
    per_pair = (
        pairs.groupBy("a", "b", "dtc_cut", "harsh_cut")
        .agg(
            F.sum(F.when(said_yes, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(said_yes, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(said_yes, 0).otherwise(F.col("pos"))).alias("fn"),
        )
        .withColumn("f1", _f1(F.col("tp"), F.col("fp"), F.col("fn")))
        .filter(F.col("f1") > 0)
    )
    best = F.max_by(
        F.struct("dtc_cut", "harsh_cut", "f1", "tp", "fp", "fn"),
        F.struct(F.col("f1"), -F.col("a"), -F.col("b")),
    )
    return per_pair.agg(best.alias("b")).select("b.*")


def binary_metrics(scored: DataFrame, threshold: float | Column, score_col: str = "risk") -> DataFrame:
    """Precision, recall, F1 at a threshold, and ROC-AUC with tied scores sharing their rank.

    Rows collapse to one per distinct score before any ordering.
    """
    per_score = scored.groupBy(F.col(score_col).alias("s")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    said_yes = F.col("s") >= threshold
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    sums = running_by_value(per_score, "s", ["neg"]).agg(
        F.sum(F.when(said_yes, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(said_yes, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(said_yes, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(won).alias("won"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return sums.select(
        "tp",
        "fp",
        "fn",
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias(
            "roc_auc"
        ),
    )



def evaluate_model(df: DataFrame, trees: int = 150, test_share: float = 0.25) -> DataFrame:
    """Model against rule baseline on held-out rows: one row of metrics each.

    Both operating points are chosen on the training rows. The labelled features (one row per
    vehicle) are staged, as training and scoring read them many times.
    """
    rows = staged(stratified_split(df, test_share=test_share))
    train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
    model = train_risk_model(train, trees)
    point = best_threshold(score(train.drop("risk"), model)).first()
    by_model = binary_metrics(score(test.drop("risk"), model), point["threshold"])
    cut = rule_baseline(train).first()
    said_yes = (F.col("dtc_ratio") > cut["dtc_cut"]) | (F.col("harsh_ratio") > cut["harsh_cut"])
    by_rule = binary_metrics(test.withColumn("risk", said_yes.cast("double")), 0.5)
    return by_model.withColumn("method", F.lit("gradient_boosting")).unionByName(
        by_rule.withColumn("method", F.lit("baseline_rule"))
    )
