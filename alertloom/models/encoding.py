"""Feature vectors: one-hot categories followed by standardised numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.joins import HOT_FRACTION, lookup
from alertloom.schemas import is_categorical_feature, model_input_columns
from alertloom.storage import BROADCAST_ROWS, materialise


@dataclass(frozen=True)
class Encoder:
    """Fitted categories and population mean and deviation.

    The categories stay a table (column_name, value, place, share), however many
    they are; place counts the column's values in text order.
    """

    table: DataFrame | None
    sizes: dict[str, int]
    scaler: dict[str, tuple[float, float]]

    @property
    def width(self) -> int:
        return sum(self.sizes.values()) + len(self.scaler)

    def __call__(self, engineered: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
        """Adds the sparse vector `features` (size, indices, values); an unseen category is all zeros."""
        df = engineered.withColumns({f"_cat_{c}": F.col(c).cast("string") for c in self.sizes})
        places, offset = [], 0
        for column, size in self.sizes.items():
            part = self.table.where(F.col("column_name") == column)
            side = part.select(F.col("value").alias("_value"), F.col("place").alias(f"_at_{column}"))
            hot = part.where(F.col("share") > 1 / HOT_FRACTION).select("value")
            df = lookup(df, side, f"_cat_{column}", "_value", small=size <= broadcast_rows, hot_keys=hot)
            places.append((F.col(f"_at_{column}") + offset).cast("int"))
            offset += size
        ones = F.array_compact(F.array(*places)) if places else F.array().cast("array<int>")
        numbers = [standardise(c, *stats) for c, stats in self.scaler.items()]
        indices = F.concat(ones, F.array(*[F.lit(offset + k) for k in range(len(numbers))]).cast("array<int>"))
        values = F.concat(F.array_repeat(F.lit(1.0), F.size(ones)), F.array(*numbers).cast("array<double>"))
        vector = F.struct(F.lit(self.width).alias("size"), indices.alias("indices"), values.alias("values"))
        return df.select(*engineered.columns, vector.alias("features"))


def standardise(column: str, mean: float, deviation: float) -> Column:
    """Population z-score; a constant column is only centred, null becomes 0."""
    z = (F.col(column).cast("double") - F.lit(mean)) / F.lit(deviation if deviation > 0 else 1.0)
    return F.coalesce(z, F.lit(0.0))


def scaler_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of all columns from one aggregation."""
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns}


def category_places(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, place, share) of every non-null value of the columns.

    Values are range-partitioned in order and numbered within each partition; what
    precedes a partition is added afterwards, so no task sees all of a column.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("_p")).select("_p.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    ordered = materialise(counts.repartitionByRange("column_name", "value").withColumn("part", F.spark_partition_id()), "categories")
    inside = F.row_number().over(Window.partitionBy("part", "column_name").orderBy("value"))
    # One row per column and partition.
    parts = ordered.groupBy("part", "column_name").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"before": F.coalesce(F.sum("values").over(before), F.lit(0)), "total": F.sum("rows").over(Window.partitionBy("column_name"))})
    placed = ordered.withColumn("inside", inside).join(parts.drop("values", "rows"), ["part", "column_name"])
    return placed.select("column_name", "value", (F.col("before") + F.col("inside") - 1).alias("place"), (F.col("n") / F.col("total")).alias("share"))


def fit_encoder(engineered: DataFrame) -> Encoder:
    features = model_input_columns(engineered.columns)
    cats = [c for c in features if is_categorical_feature(c)]
    numbers = [c for c in features if c not in cats]
    table, sizes = None, {}
    if cats:
        table = materialise(category_places(engineered, cats), "category-places")
        found = {r["column_name"]: r["n"] for r in table.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        sizes = {c: found[c] for c in cats if c in found}
    return Encoder(table, sizes, scaler_stats(engineered, numbers))
