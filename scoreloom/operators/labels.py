"""Grade <-> label index encoding and label remapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from scoreloom.schema import FOUR_GRADES, GRADE
from scoreloom.session import scratch_path

# Up to this many classes the index is a literal array inside the expression.
LITERAL_CLASSES = 256


@dataclass(frozen=True)
class ClassIndex:
    """Sorted class names; the position of a name is its label."""

    classes: tuple[str, ...]

    def __len__(self):
        return len(self.classes)

    def _names(self) -> Column:
        return F.array(*[F.lit(c) for c in self.classes])

    def encode(self, c: Column) -> Column:
        """Label of a class name, NULL for a name that was not fitted."""
        position = F.array_position(self._names(), c.cast("string"))
        return F.when(position > 0, position - 1).cast("int")

    def encode_strict(self, c: Column) -> Column:
        """Label of a class name; an unseen name stops the job."""
        complaint = F.concat(F.lit("unseen class: "), F.coalesce(c.cast("string"), F.lit("NULL")))
        return F.coalesce(self.encode(c), F.raise_error(complaint).cast("int"))

    def decode(self, label: Column) -> Column:
        """Class name of a label, NULL outside the fitted range."""
        return F.get(self._names(), label.cast("int"))


FOUR_GRADE_INDEX = ClassIndex(FOUR_GRADES)


@dataclass(frozen=True)
class ClassTable:
    """The index of a column with many classes: (class, label) rows."""

    rows: DataFrame


def class_dimension(df: DataFrame, column: str = GRADE) -> DataFrame:
    """(class, label) rows for any number of classes, ordered by name.

    Names are range-partitioned and numbered inside their partition; the
    partitions' sizes, one row each, give the offsets.
    """
    spark = df.sparkSession
    names = df.select(F.col(column).cast("string").alias("class")).where(F.col("class").isNotNull()).distinct()
    path = scratch_path(spark, "classes")
    names.repartitionByRange("class").select("class", F.spark_partition_id().alias("part")).write.parquet(path)
    placed = spark.read.schema("class string, part int").parquet(path)
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = (placed.groupBy("part").agg(F.count("*").alias("n"))
               .select("part", F.coalesce(before, F.lit(0)).alias("offset")))
    inside = F.row_number().over(W.partitionBy("part").orderBy("class"))
    return placed.join(offsets, "part").select("class", (F.col("offset") + inside - 1).cast("int").alias("label"))


def fit_classes(df: DataFrame, column: str = GRADE) -> ClassIndex | ClassTable:
    """The index of all distinct names, literal if there are few, else a table.

    The driver receives at most LITERAL_CLASSES + 1 names.
    """
    names = df.select(F.col(column).cast("string").alias("class")).where(
        F.col("class").isNotNull()).distinct().limit(LITERAL_CLASSES + 1).collect()
    if len(names) > LITERAL_CLASSES:
        return ClassTable(class_dimension(df, column))
    return ClassIndex(tuple(sorted(r["class"] for r in names)))


def encode_with(df: DataFrame, index: ClassIndex | ClassTable, column: str = GRADE, label: str = "label") -> DataFrame:
    """Add the label of every row; NULL for names the index was not fitted on.

    Few classes: a narrow projection. Many classes: an equi-join with the
    class table, left without a hint so that Spark picks the strategy from
    the size it measures.
    """
    if isinstance(index, ClassIndex):
        return df.withColumn(label, index.encode(F.col(column)))
    dimension = index.rows.withColumnsRenamed({"class": "_class", "label": label})
    return df.join(dimension, F.col(column).cast("string") == F.col("_class"), "left").drop("_class")


def encode_labels(df: DataFrame, column: str = GRADE, label: str = "label") -> DataFrame:
    """Fit the index on a table and encode the same table."""
    return encode_with(df, fit_classes(df, column), column, label)


def unseen_classes(df: DataFrame, index: ClassIndex | ClassTable, column: str = GRADE) -> DataFrame:
    """How many rows carry a name the index was not fitted on, per name."""
    counts = df.groupBy(F.col(column).cast("string").alias("class")).agg(F.count("*").alias("n"))
    return encode_with(counts, index, "class", "_label").where(F.col("_label").isNull()).select("class", "n")


def checked_labels(df: DataFrame, index: ClassIndex | ClassTable, column: str = GRADE, label: str = "label") -> DataFrame:
    """``encode_with`` that stops the job on a name the index was not fitted on."""
    complaint = F.concat(F.lit("unseen class: "), F.coalesce(F.col(column).cast("string"), F.lit("NULL")))
    return encode_with(df, index, column, label).withColumn(
        label, F.coalesce(F.col(label), F.raise_error(complaint).cast("int")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Number of rows per value, ordered by value; its values are also the
    sorted distinct values of the column."""
    return (df.where(F.col(column).isNotNull())
            .groupBy(column).agg(F.count("*").alias("n")).orderBy(column))


@dataclass(frozen=True)
class Remapping:
    """A named reduction of grades to two labels: listed grades become 0."""

    name: str
    description: str
    zero_grades: tuple[str, ...]

    def label(self, grade: Column) -> Column:
        """0 for the listed grades, 1 for others, NULL for no grade."""
        return F.when(grade.isNotNull(), F.when(
            grade.cast("string").isin(*self.zero_grades), F.lit(0)).otherwise(F.lit(1)))


# The three reductions of the four-grade scale, in order.
REMAPPINGS = (
    Remapping("strict", "Строгая (2,3->0; 4,5->1)", ("2", "3")),
    Remapping("liberal", "Либеральная (2->0; 3,4,5->1)", ("2",)),
    Remapping("middle", "Средняя (2,3,4->0; 5->1)", ("2", "3", "4")),
)


def remap(df: DataFrame, remappings: Sequence[Remapping] = REMAPPINGS,
          column: str = GRADE) -> DataFrame:
    """Every input row once per remapping, with its two-valued label.

    Meant for grade counts or confusion cells; on raw rows it multiplies the
    table, without a shuffle, by the number of remappings.
    """
    variants = F.array(*[
        F.struct(F.lit(i).alias("strategy_order"), F.lit(m.name).alias("strategy"),
                 F.lit(m.description).alias("description"),
                 m.label(F.col(column)).alias("binary_label"))
        for i, m in enumerate(remappings)])
    return df.select("*", F.inline(variants))


def literal_map(values: Mapping, key: Column, default) -> Column:
    """Look a column up in a handful of literal values."""
    result = F.lit(default)
    for k, v in values.items():
        result = F.when(key == F.lit(k), F.lit(v)).otherwise(result)
    return result
