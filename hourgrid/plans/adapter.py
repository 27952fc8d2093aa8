"""The three feeds, made from the given tables: four hours a day from 2022-05-01 on, and their SQL twins."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where the invented year begins and its monthly temperatures.
BASE, FIRST_DAY = "2022-05-01 00:00:00", "1995-01-01"
MONTHLY = (-3, 0, 8, 15, 20, 25, 28, 27, 23, 16, 8, 0)
TRAIN_END, VALIDATION_END = "2022-12-31 23:00:00", "2023-03-31 23:00:00"
PRICE, LOAD = ["lmp", "congestion", "marginal_loss"], ["load_mw"]
WEATHER = ["temp_c", "dewpoint_c", "rh_pct", "heat_index_c", "wind_chill_c", "wind_speed_ms", "slp_hpa", "precip_1h_mm", "precip_6h_mm", "cdd", "hdd", "n_stations"]


def _hour(day: str, slot: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{BASE}' + make_dt_interval(0, cast(datediff({day}, DATE'{FIRST_DAY}') * 4 + ({slot}) AS INT))")


def price_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        _hour("l_shipdate", "(l_linenumber - 1) div 2").alias("ts"), F.expr("l_extendedprice / l_quantity / 50").alias("lmp"),
        F.expr("l_discount * 100").alias("congestion"), F.expr("l_tax * 10").alias("marginal_loss"),
    )


def load_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(_hour("o_orderdate", "o_orderkey % 4").alias("ts"), F.expr("o_totalprice / 20").alias("load_mw"))


def weather_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ts", _hour("l_shipdate", "(l_linenumber - 1) div 2"))
    hours = lines.groupBy("ts").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.count("*").alias("n"))
    table = "array(" + ", ".join(f"{m}.0D" for m in MONTHLY) + ")"
    return (
        hours.withColumn("temp_c", F.expr(f"round(element_at({table}, month(ts)) + 6 - abs(hour(ts) - 15) / 2D + (q - 25.4D) / 2 + 3.3e-8D, 6)"))
        .withColumns({"precip_1h_mm": F.expr("round(greatest(t * 10 - 0.3D, 0D) + 3.3e-8D, 6)"), "wind_speed_ms": F.expr("round(d * 100 + 3.3e-8D, 6)")})
        .select(
            "ts", "temp_c", F.expr("temp_c - 4").alias("dewpoint_c"), F.expr("50 + wind_speed_ms").alias("rh_pct"), F.expr("CASE WHEN temp_c > 25 THEN temp_c + 1 END").alias("heat_index_c"),
            F.expr("CASE WHEN temp_c < 8 THEN temp_c - 2 END").alias("wind_chill_c"), "wind_speed_ms", F.expr("CASE WHEN n > 1 THEN 1013D + n END").alias("slp_hpa"), "precip_1h_mm",
            F.expr("CASE WHEN precip_1h_mm > 0 THEN precip_1h_mm * 3 END").alias("precip_6h_mm"), F.expr("greatest(temp_c - 18.3D, 0D)").alias("cdd"), F.expr("greatest(18.3D - temp_c, 0D)").alias("hdd"),
            F.col("n").cast("double").alias("n_stations"),
        )
    )


def _hour_sql(day: str, slot: str) -> str:
    return f"(TIMESTAMP '{BASE}' + to_hours(CAST(date_diff('day', DATE '{FIRST_DAY}', CAST({day} AS DATE)) * 4 + ({slot}) AS INTEGER)))"


FEEDS_SQL = f"""
price AS (SELECT {_hour_sql("l_shipdate", "(l_linenumber - 1) // 2")} AS ts, l_extendedprice / l_quantity / 50 AS lmp, l_discount * 100 AS congestion, l_tax * 10 AS marginal_loss FROM lineitem),
load AS (SELECT {_hour_sql("o_orderdate", "o_orderkey % 4")} AS ts, o_totalprice / 20 AS load_mw FROM orders),
weather_q AS (SELECT {_hour_sql("l_shipdate", "(l_linenumber - 1) // 2")} AS ts, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t, count(*) AS n FROM lineitem GROUP BY 1),
weather_r AS (SELECT *, round(([{", ".join(f"{m}.0::DOUBLE" for m in MONTHLY)}])[month(ts)] + 6 - abs(hour(ts) - 15) / 2 + (q - 25.4::DOUBLE) / 2 + 3.3e-8, 6) AS temp_c,
  round(greatest(t * 10 - 0.3::DOUBLE, 0) + 3.3e-8, 6) AS precip_1h_mm, round(d * 100 + 3.3e-8, 6) AS wind_speed_ms FROM weather_q),
weather AS (SELECT ts, temp_c, temp_c - 4 AS dewpoint_c, 50 + wind_speed_ms AS rh_pct, CASE WHEN temp_c > 25 THEN temp_c + 1 END AS heat_index_c, CASE WHEN temp_c < 8 THEN temp_c - 2 END AS wind_chill_c,
  wind_speed_ms, CASE WHEN n > 1 THEN 1013::DOUBLE + n END AS slp_hpa, precip_1h_mm, CASE WHEN precip_1h_mm > 0 THEN precip_1h_mm * 3 END AS precip_6h_mm,
  greatest(temp_c - 18.3::DOUBLE, 0) AS cdd, greatest(18.3::DOUBLE - temp_c, 0) AS hdd, n::DOUBLE AS n_stations FROM weather_r)"""
