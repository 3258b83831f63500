"""Row numbers and prefix sums that stay spread when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygraph.session import written

HOT_ROWS = 1_000_000


def grouped_row_number(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    out: str,
    hot_rows: int = HOT_ROWS,
    most: DataFrame | None = None,
) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)``.

    ``bucket`` must not decrease along ``order``. Groups above ``hot_rows`` rows are
    ranked bucket by bucket, each bucket shifted by the rows before it, so one
    group is never one task. Smaller groups keep a single window. ``most``: a column
    ``n`` that no group exceeds, cheap to read; where it says that no group is so large,
    ``df`` is gone through once instead of twice.
    """
    if most is not None and most.where(F.col("n") > hot_rows).isEmpty():
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    tagged = df.withColumn("_bucket", bucket)
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_total", F.sum("_n").over(per_key))
        .where(F.col("_total") > hot_rows)
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*keys, "_bucket", "_offset")
    )
    placed = tagged.join(offsets, [*keys, "_bucket"], "left").withColumn(
        "_part", F.when(F.col("_offset").isNotNull(), F.col("_bucket"))
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return placed.withColumn(
        out, (F.row_number().over(inside) + F.coalesce("_offset", F.lit(0))).cast("long")
    ).drop("_bucket", "_part", "_offset")


def range_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Exact row number (from 0) over the whole table: ranges in order, their counts, and places inside.

    ``order`` must be unique, or equal rows take any order. The ranges are written once, so counts and
    places are of the same rows; the only window without a key runs on one row per range.
    """
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(starts, "_range").withColumn(out, (F.col("_start") + inside - 1).cast("long")).drop("_range", "_start")


def hash_order(seed: int, *cols: str) -> Column:
    """Portable seeded shuffle key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_bucket(hash_col: str) -> Column:
    """4096 even buckets that follow the order of a hex digest."""
    return F.conv(F.substring(hash_col, 1, 3), 16, 10).cast("int")


def bucketed_prefix_sum(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """Exclusive running sum per key, computed bucket by bucket.

    The only window over a whole key runs on one row per bucket.
    """
    tagged = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.sum(value).alias("_v"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_start"))
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        tagged.join(starts, [*keys, "_bucket"])
        .withColumn(out, (F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_bucket", "_start")
    )


def expand_counts(df: DataFrame, keys: list[str], count: str, out: str, block: int = 65_536, also: dict[str, Column] | None = None) -> DataFrame:
    """One row per integer in ``[0, count)``.

    Large counts are cut into blocks, and the blocks are spread over the cluster
    before they are written out, so that a few large counts do not meet in one task.
    ``also``: columns made once per block, after it was spread.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (
        df.where(F.col(count) > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / block).cast("long"))))
        .repartition(parts, *keys, "_block")
    )
    blocks = blocks.withColumns(also) if also else blocks
    first = F.col("_block") * block
    last = F.least(first + block, F.col(count)) - 1
    return blocks.withColumn(out, F.explode(F.sequence(first, last.cast("long")))).drop("_block")


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles from a value histogram: index ``bround(p * (n - 1))``.

    The window runs over distinct values only, so its size does not follow the rows.
    """
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(*keys)
    cum = (
        hist.withColumn("_cum", F.sum("_n").over(per_key.orderBy(value)))
        .withColumn("_total", F.sum("_n").over(per_key))
    )
    picks = [
        F.min(F.when(F.col("_cum") > F.bround(F.lit(float(p)) * (F.col("_total") - 1), 0), F.col(value)))
        .cast("long").alias(name)
        for name, p in shares.items()
    ]
    return cum.groupBy(*keys).agg(F.max("_total").cast("long").alias("n"), *picks)
