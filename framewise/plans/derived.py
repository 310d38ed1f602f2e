"""Dirt and series derived from the driver's tables by fixed rules.

The driver's tables have no nulls or duplicate rows, so cleaning operators are
exercised on copies made dirty by rule. Each rule exists twice - as a Spark
DataFrame and as a DuckDB SQL ``WITH`` clause - and the two must stay equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.session import read_table


def events_missing(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
        "props")


def events_dup(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.unionByName(e.where(F.col("event_id") % 50 == 0))


def events_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """events_missing plus the events_dup copies of its rows."""
    e = events_missing(spark, sf)
    return e.unionByName(e.where(F.col("event_id") % 50 == 0))


def events_text_time(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id",
                    F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(ts).alias("ts_mostly"),
                    F.when(F.col("event_id") % 5 < 3, F.lit("n/a")).otherwise(ts).alias("ts_rarely"),
                    "value")


def lineitem_text_num(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_orderkey") % 13 == 0, F.lit("bad"))
                     .otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
                     "l_extendedprice")


def orders_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily order totals and counts: a two-"asset" price panel."""
    o = read_table(spark, sf, "orders")
    return (o.groupBy(F.col("o_orderdate").alias("day"))
            .agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).cast("double").alias("orders")))


def user_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user: arm by ``user_id % 2`` and whether any purchase happened."""
    e = read_table(spark, sf, "events")
    return (e.groupBy("user_id")
            .agg(F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("converted"))
            .select("user_id", F.when(F.col("user_id") % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("arm"),
                    "converted"))


def user_survival(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: days from the first event to the first purchase (event=1),
    or to the last event when there is none (censored, event=0)."""
    e = read_table(spark, sf, "events")
    u = e.groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"),
                                 F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("tp"))
    end = F.coalesce("tp", "t1")
    days = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / F.lit(86_400e6)
    return u.select("user_id", F.floor(days).cast("double").alias("duration"),
                    F.when(F.col("tp").isNotNull(), 1).otherwise(0).alias("event"))


# DuckDB twins, as WITH-clause bodies
SQL = {
    "events_missing": """SELECT event_id, ts, user_id,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events""",
    "events_dup": "SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0",
    "events_dirty": """SELECT * FROM events_missing UNION ALL
        SELECT * FROM events_missing WHERE event_id % 50 = 0""",
    "events_text_time": """SELECT event_id,
        CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_mostly,
        CASE WHEN event_id % 5 < 3 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_rarely,
        value FROM events""",
    "lineitem_text_num": """SELECT l_orderkey, l_linenumber,
        CASE WHEN l_orderkey % 13 = 0 THEN 'bad' ELSE CAST(l_quantity AS VARCHAR) END AS l_quantity,
        l_extendedprice FROM lineitem""",
    "orders_daily": """SELECT o_orderdate AS day, sum(o_totalprice) AS total,
        CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY o_orderdate""",
    "user_conversion": """SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm,
        max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS converted
        FROM events GROUP BY user_id""",
    "user_survival": """SELECT user_id,
        CAST(floor((epoch_us(coalesce(tp, t1)) - epoch_us(t0)) / 86400e6) AS DOUBLE) AS duration,
        CASE WHEN tp IS NOT NULL THEN 1 ELSE 0 END AS event
        FROM (SELECT user_id, min(ts) t0, max(ts) t1,
                     min(CASE WHEN event_type = 'purchase' THEN ts END) tp
              FROM events GROUP BY user_id)""",
}


def with_sql(*names: str) -> str:
    """``WITH`` prefix defining the named derived tables (in dependency order)."""
    order = ["events_missing", "events_dup", "events_dirty", "events_text_time", "lineitem_text_num", "orders_daily",
             "user_conversion", "user_survival"]
    need = set(names)
    if "events_dirty" in need:
        need.add("events_missing")
    parts = [f"{n} AS ({SQL[n]})" for n in order if n in need]
    return "WITH " + ",\n".join(parts) + "\n"
