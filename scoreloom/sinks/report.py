"""Nested result documents and table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scoreloom.functions.bins import Bins, LENGTH_BINS, RATIO_BINS
from scoreloom.functions.fdist import f_tail
from scoreloom.functions.stats import pearson
from scoreloom.operators import metrics, progress, strategies
from scoreloom.operators.labels import ClassIndex, REMAPPINGS
from scoreloom.operators.lengths import QUARTILES
from scoreloom.operators.quantiles import exact_quantiles
from scoreloom.schema import FOUR_GRADES, GRADE
from scoreloom.session import gathered

# Fixed value: time format of a run tag.
RUN_ID_FORMAT = "yyyyMMdd_HHmmss"


def run_id() -> Column:
    """Tag of a run, from the time the query starts."""
    return F.date_format(F.current_timestamp(), RUN_ID_FORMAT)


def write_report(report: DataFrame, path: str) -> None:
    """UTF-8 JSON, one folder per run tag. Undefined numbers are written as null.

    A run that is written again replaces its own documents when the job commits;
    those of other runs stay.
    """
    (report.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("ignoreNullFields", False).json(path))


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("split",)) -> None:
    """Enriched rows as Parquet, partitioned by the split."""
    df.write.partitionBy(*by).mode("append").parquet(path)


def evaluation_report(df: DataFrame, index: ClassIndex, tag: Column | None = None) -> DataFrame:
    """One document: matrix, class names, sample count, scores and confidence range.

    The rows are read once, into cells that also carry the confidence range.
    """
    classes = len(index)
    counts = metrics.cell_counts(classes)
    cells = gathered(df.groupBy("y", "p").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c_sum"),
        F.min("confidence").alias("c_min"), F.max("confidence").alias("c_max"))).withColumns(counts)
    carry = {"c_sum": F.sum, "c_min": F.min, "c_max": F.max} | {c: F.sum for c in counts}
    matrix = F.array(*[F.array(*[f"n_{i}{j}" for j in range(classes)]) for i in range(classes)])
    spread = F.struct(F.try_divide(F.col("c_sum"), F.col("n").cast("double")).alias("mean"),
                      F.col("c_min").alias("min"), F.col("c_max").alias("max"))
    return metrics.metrics_summary(cells, (), carry).select(
        (tag if tag is not None else run_id()).alias("run_id"),
        (tag if tag is not None else run_id()).alias("timestamp"), matrix.alias("confusion_matrix"),
        F.array(*[F.lit(c) for c in index.classes]).alias("class_names"),
        F.struct(F.col("n").alias("total_samples"), "accuracy", "f1_macro",
                 spread.alias("confidence_stats")).alias("summary"))


def strategy_report(grade_cells: DataFrame, tag: Column | None = None, remappings=REMAPPINGS,
                    grades: Sequence[str] = FOUR_GRADES) -> DataFrame:
    """One document: grade counts, every strategy's numbers, and the best strategy.

    The grade counts add up to all rows: those with a grade that is not listed,
    or none, are counted as ``other`` where there are any.
    """
    scores = strategies.strategy_metrics(grade_cells, remappings, grades)
    document = F.struct(
        "description", "accuracy", "f1_macro", "f1_weighted",
        F.array(F.array("n_00", "n_01"), F.array("n_10", "n_11")).alias("confusion_matrix"),
        F.array("true_0", "true_1").alias("true_distribution"),
        F.array("pred_0", "pred_1").alias("pred_distribution"))
    # Every strategy sees all rows, so any of them knows the grade counts.
    listed = F.create_map(*[x for g in grades for x in (F.lit(g), F.max(f"grade_{g}"))])
    other = F.max("grade_other")
    distribution = F.when(other > 0, F.map_concat(listed, F.create_map(F.lit("other"), other))).otherwise(listed)
    return scores.groupBy().agg(
        distribution.alias("original_distribution"),
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("strategy", document.alias("d"))))).alias("strategies"),
        F.struct(
            F.max("n").alias("total_samples"),
            F.max_by("strategy", F.struct("accuracy", -F.col("strategy_order"))).alias("best_strategy"),
            F.max("accuracy").alias("best_accuracy")).alias("summary"),
    ).select((tag if tag is not None else run_id()).alias("run_id"),
             (tag if tag is not None else run_id()).alias("timestamp"), "*")


def baseline_report(scores: DataFrame, baseline: str, trained: str,
                    tag: Column | None = None) -> DataFrame:
    """One document: an untrained and a trained run side by side with the gain."""
    gain = progress.improvement_over(scores, baseline).where(F.col("run") == trained)
    return gain.select(
        (tag if tag is not None else run_id()).alias("run_id"),
        "baseline_accuracy", "baseline_f1_macro",
        F.col("accuracy").alias("trained_accuracy"), F.col("f1_macro").alias("trained_f1_macro"),
        "improvement_accuracy", "improvement_f1_macro")


_BY_LENGTH, _BY_RATIO, _BY_GRADE, _OVERALL = 3, 5, 6, 7
_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def length_profile(df: DataFrame, grade: str = GRADE, length_bins: Bins = LENGTH_BINS,
                   ratio_bins: Bins = RATIO_BINS) -> DataFrame:
    """Statistics by length bin, by ratio bin, by grade and overall, from one scan.

    Grouping sets fan every row out four times inside the task; one map-side
    combined aggregation then yields all groups. ``part`` tells them apart.
    """
    rows = df.select(
        length_bins.index(F.col("answer_length")).alias("length_bin"),
        ratio_bins.index(F.col("length_ratio")).alias("ratio_bin"), F.col(grade).alias("grade"),
        F.col("answer_length").alias("len"), "length_ratio", F.col("y").cast("double").alias("yd"),
        F.col("p").cast("double").alias("pd"), (F.col("y") == F.col("p")).cast("int").alias("right"),
        "confidence")
    keys = ("length_bin", "ratio_bin", "grade")
    return rows.groupingSets([("length_bin",), ("ratio_bin",), ("grade",), ()], *keys).agg(
        F.grouping_id().cast("int").alias("part"), F.count("*").alias("n"),
        F.avg("right").alias("accuracy"), F.avg("confidence").alias("confidence"),
        F.avg("len").alias("mean"), F.stddev_samp("len").alias("std"),
        F.var_samp("len").alias("variance"), F.min("len").alias("min"), F.max("len").alias("max"),
        pearson(F.col("len").cast("double"), F.col("yd")).alias("corr_length"),
        pearson(F.col("length_ratio"), F.col("yd")).alias("corr_ratio"),
        pearson(F.col("len").cast("double"), F.col("pd")).alias("corr_predicted"))


def length_report(df: DataFrame, grades: Sequence[str], tag: Column | None = None,
                  length_bins: Bins = LENGTH_BINS, ratio_bins: Bins = RATIO_BINS) -> DataFrame:
    """One document with everything the length study reports."""
    def pick(part: int, key: str, value, c: Column) -> Column:
        return F.max(F.when((F.col("part") == part) & (F.col(key) == value), c))

    def by_bin(part: int, key: str, bins: Bins) -> Column:
        return F.create_map(*[x for i, name in enumerate(bins.labels)
                              for x in (F.lit(name), pick(part, key, i, F.col("accuracy")))])

    def overall(c: str) -> Column:
        return F.max(F.when(F.col("part") == _OVERALL, F.col(c)))

    stat = {"count": F.col("n"), "mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"),
            "25%": F.col("quartiles")[0], "50%": F.col("quartiles")[1],
            "75%": F.col("quartiles")[2], "max": F.col("max")}
    statistics = F.create_map(*[
        x for name in _STATS for x in (F.lit(name), F.create_map(*[
            y for g in grades
            for y in (F.lit(g), pick(_BY_GRADE, "grade", g, stat[name].cast("double")))]))])
    groups = F.collect_list(F.when(
        (F.col("part") == _BY_GRADE) & F.col("grade").isNotNull(),
        F.struct("n", "mean", F.coalesce("variance", F.lit(0.0)).alias("variance"))))
    # Quartiles do not combine across tasks like sums; they have their own counts.
    quartiles = exact_quantiles(df, "grade", "answer_length", QUARTILES).withColumnRenamed(
        "quantiles", "quartiles")
    profile = length_profile(df, "grade", length_bins, ratio_bins).join(quartiles, "grade", "left")
    studied = profile.agg(
        by_bin(_BY_LENGTH, "length_bin", length_bins).alias("accuracy_by_length"),
        by_bin(_BY_RATIO, "ratio_bin", ratio_bins).alias("accuracy_by_relation"),
        overall("corr_length").alias("correlation_length_grade"),
        overall("corr_ratio").alias("correlation_relation_grade"),
        statistics.alias("grade_statistics"), groups.alias("_g"))

    def total(f) -> Column:
        return F.aggregate("_g", F.lit(0.0), lambda acc, g: acc + f(g))

    spread = (studied.withColumn("_n", total(lambda g: g["n"]))
              .withColumn("_centre", F.try_divide(total(lambda g: g["n"] * g["mean"]), F.col("_n"))))
    between = total(lambda g: g["n"] * F.pow(g["mean"] - F.col("_centre"), F.lit(2.0)))
    within = total(lambda g: (g["n"] - 1) * g["variance"])
    tested = spread.withColumns({
        "_d1": (F.size("_g") - 1).cast("double"), "_d2": F.col("_n") - F.size("_g")}).withColumn(
        "anova_f", F.try_divide(F.try_divide(between, F.col("_d1")), F.try_divide(within, F.col("_d2"))))
    return tested.withColumn("anova_p", f_tail(F.col("anova_f"), F.col("_d1"), F.col("_d2"))).select(
        (tag if tag is not None else run_id()).alias("run_id"), "accuracy_by_length",
        "accuracy_by_relation", "correlation_length_grade", "correlation_relation_grade",
        "anova_f", "anova_p", "grade_statistics")
