"""Answer length against grade, accuracy and confidence."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scoreloom.functions.bins import Bins, LENGTH_BINS, RATIO_BINS
from scoreloom.functions.fdist import f_tail
from scoreloom.functions.stats import pearson
from scoreloom.operators.quantiles import exact_quantiles
from scoreloom.schema import GRADE, REFERENCE, STUDENT
from scoreloom.session import gathered, settle

QUARTILES = (0.25, 0.5, 0.75)


def length_columns(student: Column, reference: Column) -> dict[str, Column]:
    """Length expressions for two text columns."""
    return {"answer_length": F.length(student), "reference_length": F.length(reference)}


def length_ratios(df: DataFrame) -> DataFrame:
    """Ratio and difference of the two lengths; no ratio for an empty reference."""
    return df.withColumns({
        "length_ratio": F.try_divide(F.col("answer_length").cast("double"),
                                     F.col("reference_length").cast("double")),
        "length_difference": F.col("answer_length") - F.col("reference_length"),
    })


def length_features(df: DataFrame, student: str = STUDENT, reference: str = REFERENCE) -> DataFrame:
    """The four length columns of a graded table.

    Where the two texts come from different tables, take ``length_columns`` at
    the scans and call ``length_ratios`` after the join, so that the join
    moves whole numbers and not texts.
    """
    return length_ratios(df.withColumns(length_columns(F.col(student), F.col(reference))))


def with_bins(df: DataFrame, column: str, bins: Bins, prefix: str = "bin") -> DataFrame:
    index = bins.index(F.col(column))
    return df.withColumn(f"{prefix}_id", index).withColumn(
        f"{prefix}_label", bins.label(F.col(f"{prefix}_id")))


def _by_bin(df: DataFrame, column: str, bins: Bins, *stats: Column) -> DataFrame:
    """(bin_id, bin_label, n, stats...) for every bin, empty bins with n = 0.

    One aggregation yields at most one row per bin. They become one map, in
    which the full bin list is looked up, so no join is needed.
    """
    used = gathered(
        df.withColumn("bin_id", bins.index(F.col(column))).where(F.col("bin_id").isNotNull())
        .groupBy("bin_id").agg(F.count("*").alias("n"), *stats))
    names = [c for c in used.columns if c not in ("bin_id", "n")]
    found = used.agg(F.map_from_entries(F.collect_list(
        F.struct("bin_id", F.struct("n", *names).alias("s")))).alias("found"))
    labels = F.array(*[F.lit(x) for x in bins.labels])
    return (found.select("found", F.posexplode(labels).alias("bin_id", "bin_label"))
            .withColumn("s", F.col("found")[F.col("bin_id")])
            .select("bin_id", "bin_label", F.coalesce("s.n", F.lit(0).cast("bigint")).alias("n"),
                    *[F.col(f"s.{c}") for c in names]))


def bin_counts(df: DataFrame, column: str, bins: Bins) -> DataFrame:
    """Rows per bin, empty bins included; values outside every bin are not counted."""
    return _by_bin(df, column, bins)


def accuracy_by_bin(df: DataFrame, column: str, bins: Bins,
                    y: str = "y", p: str = "p") -> DataFrame:
    """Accuracy, error rate and rows per bin; an empty bin has 0 rows and no accuracy."""
    right = (F.col(y) == F.col(p)).cast("int")
    return _by_bin(df, column, bins, F.avg(right).alias("accuracy")).withColumn(
        "error_rate", 1 - F.col("accuracy"))


def mean_by_bin(df: DataFrame, column: str, bins: Bins, value: str, name: str) -> DataFrame:
    """Mean of another column per bin, empty bins included."""
    return _by_bin(df, column, bins, F.avg(value).alias(name))


def crosstab(df: DataFrame, column: str, bins: Bins, grades: Sequence[str],
             grade: str = GRADE) -> DataFrame:
    """Rows per bin and grade, one column per listed grade and one for all others.

    The closed list of grades makes this a single aggregation. Bins without
    rows do not appear, as in a contingency table.
    """
    binned = df.select(bins.index(F.col(column)).alias("bin_id"), F.col(grade)).where(
        F.col("bin_id").isNotNull() & F.col(grade).isNotNull())
    wide = binned.groupBy("bin_id").agg(*[
        F.count_if(F.col(grade) == g).alias(f"grade_{g}") for g in grades],
        F.count_if(~F.col(grade).isin(*grades)).alias("grade_other"))
    return wide.withColumn("bin_label", bins.label(F.col("bin_id")))


def crosstab_percent(counts: DataFrame, grades: Sequence[str], decimals: int = 1) -> DataFrame:
    """Row percentages of a crosstab, rounded half to even."""
    names = [*[f"grade_{g}" for g in grades], "grade_other"]
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return counts.select("bin_id", "bin_label", *[
        F.bround(F.try_divide(F.col(c).cast("double"), total.cast("double")) * 100, decimals).alias(c)
        for c in names])


def length_correlation(df: DataFrame, label: str = "y", predicted: str = "p") -> DataFrame:
    """Pearson correlations of length and ratio with the labels, in one pass."""
    y, p = F.col(label).cast("double"), F.col(predicted).cast("double")
    length = F.col("answer_length").cast("double")
    return df.agg(
        pearson(length, y).alias("corr_length_grade"),
        pearson(F.col("length_ratio"), y).alias("corr_ratio_grade"),
        pearson(length, p).alias("corr_length_predicted"))


def anova(df: DataFrame, by: str = GRADE, value: str = "answer_length",
          alpha: float = 0.05) -> DataFrame:
    """One-way analysis of variance: F, degrees of freedom, p and the decision.

    The rows are reduced to (count, mean, variance) per group; the rest is
    arithmetic on those groups, gathered into one row.
    """
    groups = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    return anova_from_groups(gathered(groups), alpha)


def anova_from_groups(groups: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``anova`` from a table of (n, mean, variance) per group."""
    totals = groups.agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"),
        F.sum((F.col("n") - 1) * F.coalesce("variance", F.lit(0.0))).alias("within"),
        F.collect_list(F.struct("n", "mean")).alias("means"))
    between = F.aggregate("means", F.lit(0.0), lambda acc, g: (
        acc + g["n"] * (g["mean"] - F.col("centre")) * (g["mean"] - F.col("centre"))))
    result = totals.select(
        "rows", (F.col("groups") - 1).alias("df_between"),
        (F.col("rows") - F.col("groups")).alias("df_within"),
        between.alias("ss_between"), F.col("within").alias("ss_within"))
    mean_between = F.try_divide(F.col("ss_between"), F.col("df_between").cast("double"))
    mean_within = F.try_divide(F.col("ss_within"), F.col("df_within").cast("double"))
    return (result.withColumn("f", F.try_divide(mean_between, mean_within))
            .withColumn("p", f_tail(F.col("f"), F.col("df_between").cast("double"),
                                           F.col("df_within").cast("double")))
            .withColumn("significant", F.col("p") < alpha))


def grade_length_stats(df: DataFrame, by: str = GRADE, decimals: int = 1) -> DataFrame:
    """Length and ratio statistics per grade, rounded half to even."""
    def r(c: Column) -> Column:
        return F.bround(c, decimals)

    return df.groupBy(by).agg(
        r(F.avg("answer_length")).alias("length_mean"),
        r(F.stddev_samp("answer_length")).alias("length_std"),
        F.min("answer_length").alias("length_min"), F.max("answer_length").alias("length_max"),
        r(F.avg("length_ratio")).alias("ratio_mean"),
        r(F.stddev_samp("length_ratio")).alias("ratio_std"),
        F.count("*").alias("n"))


def describe(df: DataFrame, by: str = GRADE, value: str = "answer_length") -> DataFrame:
    """count, mean, std, min, quartiles and max per group, for numbers of any kind."""
    basics = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"),
        F.stddev_samp(F.col(value).cast("double")).alias("std"),
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"))
    quartiles = exact_quantiles(df, by, value, QUARTILES).select(by, *_named_quartiles())
    return basics.join(quartiles, by, "left")


def _named_quartiles() -> list[Column]:
    return [F.col("quantiles")[i].alias(f"q{i + 1}") for i in range(3)]


def boxplot(df: DataFrame, value: str, by: str = GRADE, reach: float = 1.5) -> DataFrame:
    """Box-plot numbers per group: quartiles, whisker ends and outlier count.

    Whiskers end at the outermost values within ``reach`` box heights. The
    second pass carries the quartiles to the rows; they are one short row per
    group and the join is left to Spark when there are many groups.
    """
    boxes = settle(exact_quantiles(df, by, value, QUARTILES).select(by, *_named_quartiles()))
    margin = F.lit(reach) * (F.col("q3") - F.col("q1"))
    v = F.col(value).cast("double")
    inside = (v >= F.col("q1") - margin) & (v <= F.col("q3") + margin)
    return (df.select(by, value).where(F.col(value).isNotNull()).join(boxes, by)
            .groupBy(by, "q1", "q2", "q3").agg(
                F.min(F.when(inside, v)).alias("whisker_low"),
                F.max(F.when(inside, v)).alias("whisker_high"),
                F.count_if(~inside).alias("outliers"), F.count("*").alias("n")))


def quartile_edges(df: DataFrame, value: str) -> tuple[float, ...]:
    """Edges of four bands at the quartiles of a column, open at both ends."""
    found = exact_quantiles(df.select(F.lit(0).alias("all"), value), "all", value, QUARTILES).first()
    if found is None or len(set(found["quantiles"])) < 3:
        raise ValueError("the quartiles coincide; give the band edges instead")
    return (-math.inf, *found["quantiles"], math.inf)


def length_density(df: DataFrame, width: int, by: Sequence[str] = (GRADE, "predicted_grade"),
                   value: str = "answer_length") -> DataFrame:
    """Counts over (grade, prediction, length step): the table behind a scatter plot."""
    step = F.floor(F.col(value) / width).cast("int")
    return df.groupBy(*by, step.alias("length_step")).agg(F.count("*").alias("n"))


def best_and_worst(stats: DataFrame) -> DataFrame:
    """The bins with the highest and lowest accuracy among bins with rows.

    On ties the bin that comes first is reported.
    """
    used = stats.where(F.col("n") > 0)
    return used.agg(
        F.max_by("bin_label", F.struct("accuracy", -F.col("bin_id"))).alias("best_bin"),
        F.max("accuracy").alias("best_accuracy"),
        F.min_by("bin_label", F.struct("accuracy", "bin_id")).alias("worst_bin"),
        F.min("accuracy").alias("worst_accuracy"))

