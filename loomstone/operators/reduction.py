"""Map-reduce by levels: the parts of a job become one, a bounded number at a time and in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.prefix import earlier, placed
from loomstone.sources.folders import settle


def reduce_levels(parts: DataFrame, by: list[str], order: str, value: str, combine: Callable[[Column], Column], width: int = 8) -> DataFrame:
    """(*by, value, parts): one row a job, its parts combined by ``width`` neighbours at a time, level by level.

    ``combine`` makes one value of the array of up to ``width`` neighbours in order (an expression, or an Arrow function of
    it); a part left alone goes up as it is.  A level is a table a ``width``-th as long as the one before, grouped by job and
    neighbourhood, so a job of any size is spread over as many groups as it needs.  Ties in the order are broken by where
    rows lie; a null value is combined as any other.
    """
    named = parts.select(*by, F.col(order).alias("order_"), F.col(value).alias("value"))
    numbered = earlier(placed(named, [*by, "order_"]).withColumn("one", F.lit(1)), by, {"n": "one"})
    level = settle(numbered.select(*by, "n", "value", F.lit(1).cast("long").alias("parts")), "level")
    while level.agg(F.max("n")).first()[0]:
        items = F.sort_array(F.collect_list(F.struct(F.col("n").alias("k"), F.col("value").alias("v"))))  # at most ``width``
        grouped = level.groupBy(*by, F.floor(F.col("n") / width).alias("up")).agg(items.alias("items"), F.sum("parts").alias("parts"))
        values = grouped.withColumn("values", F.transform("items", lambda x: x["v"]))
        joined = F.when(F.size("values") == 1, F.get("values", F.lit(0))).otherwise(combine(F.col("values")))
        level = settle(values.select(*by, F.col("up").alias("n"), joined.alias("value"), "parts"), "level")
    return level.select(*by, F.col("value").alias(value), "parts")
