"""Rank correlation of every feature with the target, with false-discovery control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.functions.statistics import with_spearman_p
from wheelbase.operators.ordering import average_ranks, with_minimum_from, with_sums_before
from wheelbase.staging import written


def pearson(df: DataFrame, group: Sequence[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """Count and correlation per group; fewer than 3 rows or no variance gives NULL.

    With ``weight``, each row stands for that many equal rows.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    if weight is None:
        # These aggregates work on deviations from the mean, so a large offset costs no digits.
        rho = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        found = df.groupBy(*group).agg(F.count("*").alias("n"), varied.alias("varied"), rho.alias("rho"))
        return found.select(*group, "n", F.when((F.col("n") >= 3) & F.col("varied"), F.col("rho")).alias("rho"))
    w = F.col(weight)
    sums = df.groupBy(*group).agg(
        F.sum(w).alias("n"),
        varied.alias("varied"),
        F.sum(w * a).alias("sx"),
        F.sum(w * b).alias("sy"),
        F.sum(w * a * a).alias("sxx"),
        F.sum(w * b * b).alias("syy"),
        F.sum(w * a * b).alias("sxy"),
    )
    n = F.col("n")
    cross = n * F.col("sxy") - F.col("sx") * F.col("sy")
    spread = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    return sums.select(*group, "n", F.when((n >= 3) & F.col("varied") & (spread > 0), cross / F.sqrt(spread)).alias("rho"))


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str, ranges: int | None = None, stage=written) -> DataFrame:
    """Pearson correlation of average ranks per group.

    Equal (x, y) pairs are folded to one counted row first and stored, so ``df`` is evaluated once; ranks are taken from and joined to that smaller table.
    """
    pairs = stage(df.groupBy(*group, x, y).agg(F.count("*").alias("_w")))
    rank_x = average_ranks(pairs, group, x, "rank_x", ranges, stage, "_w").drop("n_ties")
    rank_y = average_ranks(pairs, group, y, "rank_y", ranges, stage, "_w").drop("n_ties")
    ranked = pairs.join(rank_x, [*group, x]).join(rank_y, [*group, y])
    # Doubled ranks are whole numbers, so the sums are exact as long as they fit a double.
    doubled = ranked.withColumns({"rank_x": F.col("rank_x") * 2, "rank_y": F.col("rank_y") * 2})
    return pearson(doubled, group, "rank_x", "rank_y", "_w")


def fdr_bh(df: DataFrame, p: str, name: str = "fdr_q_value", ranges: int | None = None) -> DataFrame:
    """Benjamini–Hochberg adjusted p-values over the whole frame; NULL stays NULL and is not counted."""
    known = df.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n"))
    total = df.agg(F.count(p)).scalar()
    placed = with_sums_before(known, [], [p], {"before": F.col("_n")}, ranges)
    level = F.col(p) * total / (F.col("before") + F.col("_n"))
    adjusted = with_minimum_from(placed, [], p, level, "_q", ranges)
    capped = adjusted.select(p, F.least(F.lit(1.0), "_q").alias(name))
    return df.join(capped, p, "left")


def feature_pairs(features: DataFrame, target: DataFrame, controls: DataFrame | None) -> DataFrame:
    """(feature_name, x, y, minimum rows) of the features and, unpivoted, of the numeric controls."""
    from_features = features.join(target, "series_id").select(
        "feature_name", F.col("feature_value").alias("x"), F.col("target_log_sales").alias("y"), F.lit(1).alias("least")
    )
    if controls is None:
        return from_features
    from_controls = (
        target.join(controls, "series_id")
        .select(
            F.col("target_log_sales").alias("y"),
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("x"))
                        for c in vocab.NUMERIC_CONTROLS
                    ]
                )
            ).alias("cell"),
        )
        .select("cell.feature_name", "cell.x", "y", F.lit(3).alias("least"))
        .filter(F.col("x").isNotNull())
    )
    return from_features.unionByName(from_controls)


def univariate_associations(
    features: DataFrame, target: DataFrame, controls: DataFrame | None = None, stage=written, ranges: int | None = None
) -> DataFrame:
    """(feature_name, n, spearman_rho, p_value, fdr_q_value) over features and numeric controls.

    The correlations (one row per feature) are written once; the adjustment reads them several times.
    """
    pairs = feature_pairs(features, target, controls)
    correlated = spearman(pairs, ["feature_name", "least"], "x", "y", ranges, stage).filter(F.col("n") >= F.col("least"))
    named = correlated.select("feature_name", "n", F.col("rho").alias("spearman_rho"))
    return fdr_bh(stage(with_spearman_p(named, "spearman_rho", "n")), "p_value", ranges=ranges)


def association_order() -> list:
    return [F.asc_nulls_last("fdr_q_value"), F.abs(F.col("spearman_rho")).desc_nulls_last(), F.asc("feature_name")]


def significance_counts(associations: DataFrame, level: float = 0.05) -> DataFrame:
    """Tested features and those strictly below the level."""
    return associations.agg(
        F.count("*").alias("tested"),
        F.count_if(F.col("fdr_q_value") < level).alias("significant"),
    )
