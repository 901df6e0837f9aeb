"""Joins with keys that may hold a large share of all rows, and rows that take long for their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast, at most, and rows that a key has at least before it is one of them.
HOT_KEYS, LEAST = 10_000, 200
#: Rows of a task of spread, at least, and tasks for each core, at most.
TASK_ROWS, TASKS = 32, 8


def counted_join(left: DataFrame, right: DataFrame, on: list[str], n: str, rows: int, spread: Column, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, whose keys are unique and whose column n counts the rows of left for each.

    Keys of more than rows / HOT_KEYS rows are fewer than HOT_KEYS whatever the data, so they are broadcast. Their rows
    are spread by the hash of `spread` and the others meet in a shuffle, where no key has more than that many rows.
    left is read once. Columns: those of left, then those of right but for the keys and n.
    """
    bound = max(rows // HOT_KEYS, LEAST)
    extra = [c for c in right.columns if c not in (*on, n)]
    packed = right.select(*on, n, F.struct(F.lit(True).alias("_is"), *extra).alias("_found"))
    hot = packed.filter(F.col(n) > bound).select(*on, F.col("_found").alias("_hot"))
    cold = packed.filter(F.col(n) <= bound).select(*on, F.lit(0).cast("long").alias("_salt"), "_found")
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 30))).cast("long")
    out = left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).join(cold, [*on, "_salt"], "left")
    out = out.withColumn("_found", F.coalesce("_hot", "_found"))
    if how == "inner":
        out = out.filter(F.col("_found").isNotNull())
    return out.select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in extra))


def spread(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """About n rows that a kernel takes long over, dealt to tasks by their keys, by number: by size they would all be one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(-(-n // TASK_ROWS), TASKS * cores)), *by)
