"""Classification metrics, all derived from one table of confusion cells.

``confusion_cells`` is the only step that reads the scored rows: one map-side
combined aggregation whose output has at most K x K rows per run. Everything
else is arithmetic on those rows in one partition, without another shuffle.
``by`` names columns with few values, such as the run or the strategy.

Other sums over the same rows (losses, confidence ranges) travel along as
``carry`` columns of the cells. Joining two results of one table of cells would
read the rows twice, since each side prunes the aggregation differently.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from scoreloom.session import gathered, settle

# Column name -> aggregate function that merges it.
Carry = Mapping[str, Callable[[str], Column]]


def confusion_cells(df: DataFrame, y: str = "y", p: str = "p",
                    by: Sequence[str] = ()) -> DataFrame:
    """(by..., y, p, n): number of rows per true and predicted label."""
    return gathered(
        df.groupBy(*by, F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p"))
        .agg(F.count("*").alias("n")))


def sum_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merge cells that share (by..., y, p), e.g. after relabelling."""
    return gathered(cells.groupBy(*by, "y", "p").agg(F.sum("n").alias("n")))


def class_totals(cells: DataFrame, by: Sequence[str] = (), carry: Carry = {}) -> DataFrame:
    """(by..., label, support, predicted, hits) for labels seen as truth or prediction.

    Each cell adds to its true label and to its predicted label, which gives
    predicted-only labels their row without an outer join. Carried columns
    follow the true label.
    """
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("s"), none.alias("q"), hit.alias("h"),
                 *[F.col(c) for c in carry]),
        F.struct(F.col("p").alias("label"), none.alias("s"), F.col("n").alias("q"), none.alias("h"),
                 *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in carry]))
    return (cells.select(*by, F.inline(sides))
            .groupBy(*by, "label")
            .agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"),
                 *[merge(c).alias(c) for c, merge in carry.items()]))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_scores(cells: DataFrame, by: Sequence[str] = (), carry: Carry = {}) -> DataFrame:
    """class_totals with precision, recall and F1; 0 where a denominator is 0."""
    return class_totals(cells, by, carry).withColumns({
        "precision": _ratio(F.col("hits"), F.col("predicted")),
        "recall": _ratio(F.col("hits"), F.col("support")),
        "f1": _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")),
    })


def _weighted(c: str) -> Column:
    return _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))


def metrics_summary(cells: DataFrame, by: Sequence[str] = (), carry: Carry = {}) -> DataFrame:
    """(by..., n, accuracy, f1_macro, f1_weighted, carried columns...)."""
    return class_scores(cells, by, carry).groupBy(*by).agg(
        F.sum("support").alias("n"),
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        _weighted("f1").alias("f1_weighted"),
        *[merge(c).alias(c) for c, merge in carry.items()])


def classification_report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per class followed by accuracy, macro and weighted averages.

    Every class row is fanned out to its own line and the three summary lines,
    and one aggregation forms all of them.
    """
    lines = F.array(*[
        F.struct(F.lit(order).alias("line_order"), name.alias("line"))
        for order, name in ((0, F.col("label").cast("string")), (1, F.lit("accuracy")),
                            (2, F.lit("macro avg")), (3, F.lit("weighted avg")))])
    fanned = class_scores(cells, by).select("*", F.inline(lines))
    is_accuracy = F.col("line_order") == 1
    is_weighted = F.col("line_order") == 3
    accuracy = _ratio(F.sum("hits"), F.sum("support"))

    def cell(c: str) -> Column:
        return F.when(is_weighted, _weighted(c)).otherwise(F.avg(c))

    return fanned.groupBy(*by, "line_order", "line").agg(
        F.when(~is_accuracy, cell("precision")).alias("precision"),
        F.when(~is_accuracy, cell("recall")).alias("recall"),
        F.when(is_accuracy, accuracy).otherwise(cell("f1")).alias("f1"),
        F.sum("support").alias("support"))


def per_class_accuracy(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy inside each true class; classes without rows do not appear."""
    return cells.groupBy(*by, "y").agg(
        F.sum("n").alias("n"),
        _ratio(F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)),
               F.sum("n")).alias("accuracy"))


def label_grid(cells: DataFrame, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Cells completed to the full K x K matrix of every run, zeros included.

    The cells of a run become one map of at most K x K entries, in which every
    pair of labels is looked up; no join and no cross product is needed.
    """
    labels = F.sequence(F.lit(0), F.lit(classes - 1))
    runs = sum_cells(cells, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("y") * classes + F.col("p"), "n"))).alias("found"))
    pairs = runs.withColumn("y", F.explode(labels)).withColumn("p", F.explode(labels))
    return pairs.select(*by, "y", "p", F.coalesce(
        F.col("found")[F.col("y") * classes + F.col("p")], F.lit(0).cast("bigint")).alias("n"))


def cell_counts(classes: int) -> dict[str, Column]:
    """``n_ij`` columns for the cells of a K x K matrix, ready to be carried."""
    return {f"n_{i}{j}": F.when((F.col("y") == i) & (F.col("p") == j), F.col("n"))
            .otherwise(F.lit(0).cast("bigint")) for i in range(classes) for j in range(classes)}


def matrix_rows(cells: DataFrame, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Display form: one row per true label, one column per predicted label."""
    wide = (label_grid(cells, classes, by).groupBy(*by, "y")
            .pivot("p", list(range(classes))).sum("n"))
    return wide.withColumnsRenamed({str(k): f"pred_{k}" for k in range(classes)})


def normalised_matrix(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells with their share of the true class, and a printable annotation.

    The annotation shows whole percents on the diagonal of matrices with more
    than two classes and one decimal elsewhere, rounded half to even.
    """
    row = W.partitionBy(*by, "y")
    matrix = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    share = F.try_divide(F.col("n").cast("double"), F.sum("n").over(row).cast("double"))
    whole = (F.col("y") == F.col("p")) & (F.max("y").over(matrix) > 1)
    return cells.withColumn("share", share).withColumn(
        "annotation",
        F.concat(F.col("n").cast("string"), F.lit(" ("),
                 F.when(whole, F.format_string("%.0f", F.bround(F.col("share") * 100, 0)))
                 .otherwise(F.format_string("%.1f", F.bround(F.col("share") * 100, 1))), F.lit("%)")))


def bincount(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """(label, n) for every label from 0 to the largest one, zeros included.

    The zeros are a distributed range up to the largest label, so a column
    with ids for labels makes many rows and no large one.
    """
    amount = F.sum(weight) if weight else F.count("*")
    counts = settle(df.where(F.col(label).isNotNull())
                    .groupBy(F.col(label).cast("int").alias("label")).agg(amount.alias("n")))
    top = counts.agg(F.max("label")).first()[0]
    zeros = df.sparkSession.range(0, -1 if top is None else top + 1).select(
        F.col("id").cast("int").alias("label"), F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(zeros).where(F.col("label") >= 0).groupBy("label").agg(F.sum("n").alias("n"))


def collapse_check(df: DataFrame, label: str, weight: str | None = None,
                   threshold: float = 0.1) -> DataFrame:
    """Warn when predictions gather in one class.

    Raised if the histogram has a single bin or its smallest bin holds less
    than ``threshold`` of its largest.
    """
    return bincount(df, label, weight).agg(
        F.count("*").alias("bins"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
    ).withColumn("collapsed", (F.col("bins") == 1) | (
        F.try_divide(F.col("smallest").cast("double"), F.col("largest").cast("double")) < threshold))


def confidence_stats(df: DataFrame, confidence: str = "confidence",
                     by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(confidence).alias("n"), F.avg(confidence).alias("confidence_mean"),
        F.min(confidence).alias("confidence_min"), F.max(confidence).alias("confidence_max"))
