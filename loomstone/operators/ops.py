"""Operational aggregates with rules that plain grouping doesn't state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_p95(values: DataFrame, by: str, value: str, order: list[Column], most: int = 1000) -> DataFrame:
    """Per key, over the latest ``most`` rows, the value at index min(n - 1, floor(0.95 n)) of the sorted list."""
    recent = values.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= most)
    ordered = recent.groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("v"))  # at most ``most`` values a key
    at = F.least(F.size("v") - 1, F.floor(F.size("v") * 0.95)).cast("int")
    return ordered.select(by, F.get("v", at).alias("recent_p95"))


def error_rate_latency(events: DataFrame) -> DataFrame:
    base = events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("slow"), F.round(F.avg("value"), 4).alias("mean"))
    late = recent_p95(events, "event_type", "value", [F.desc("ts"), F.col("event_id")])
    return base.join(late, "event_type")


def cost(inputs: Column, outputs: Column, input_price: str, output_price: str) -> Column:
    """Whole cost units, rounded up, in exact decimals."""
    price = lambda p: F.lit(p).cast("decimal(6,2)")
    return F.ceil(inputs.cast("decimal(18,0)") * price(input_price) + outputs.cast("decimal(18,0)") * price(output_price)).cast("long")


def usage_by_model(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    return lineitem.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(
        F.count("*").alias("jobs"),
        F.sum(F.col("l_quantity").cast("long")).alias("input_units"),
        F.sum(F.floor("l_extendedprice").cast("long")).alias("output_units"),
        F.sum(cost(F.col("l_quantity"), F.col("l_linenumber"), "0.15", "0.60")).alias("cost_units"),
    )


def telemetry(events: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One row of numbers over all sources."""
    e = events.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    o = orders.agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "O").alias("queue_depth"))
    units = lineitem.agg(F.sum(F.col("l_quantity").cast("long")).alias("units"))
    return e.crossJoin(o).crossJoin(units)  # one row each


def _daily(events: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "ts").alias("day")
    return events.groupBy("user_id", day).agg(F.count("*").alias("jobs"), F.sum(F.floor(F.abs("value")).cast("long")).alias("units"))


def daily_quota(events: DataFrame, most_jobs: int, most_units: int) -> DataFrame:
    """Charges of each user and UTC day, and what is left of the limits."""
    left = lambda limit, used: F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col(used))
    return _daily(events).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "jobs", "units", left(most_jobs, "jobs").alias("jobs_left"), left(most_units, "units").alias("units_left"))


def quota_violations(events: DataFrame, most_jobs: int, most_units: int) -> DataFrame:
    """The first limit that each user and day breaks."""
    code = F.coalesce(F.when(F.col("jobs") > most_jobs, "jobs"), F.when(F.col("units") > most_units, "units"))
    return _daily(events).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), code.alias("violation")).where("violation IS NOT NULL")


def account_export(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """The profile and the record set of every owner."""
    keys = F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    own = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), keys.alias("k"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("t"))
    joined = customer.join(own, F.col("o_custkey") == F.col("c_custkey"), "left")
    zero = F.lit(0).cast("long")
    return joined.select("c_custkey", "c_name", F.coalesce("n", zero).alias("n_orders"), F.coalesce("k", F.lit("")).alias("order_keys"), F.coalesce("t", zero).alias("cents"))
