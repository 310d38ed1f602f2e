"""SQL passthrough over registered views, and JDBC databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Run Spark SQL over the session's temp views; errors propagate
    (the reference swallows them and returns nothing)."""
    return spark.sql(sql)


def read_jdbc(spark: SparkSession, url: str, sql: str | None = None, table: str | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None, **props) -> DataFrame:
    """A6 against a database: a query or a table; give ``partition_column`` with
    bounds to read in parallel ranges instead of through one connection."""
    r = spark.read.format("jdbc").option("url", url)
    if sql is not None:
        r = r.option("query", sql)
    else:
        r = r.option("dbtable", table)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions or 8))
    return r.options(**props).load()


def write_jdbc(df: DataFrame, url: str, table: str, if_exists: str = "replace", **props) -> None:
    """Replace -> overwrite, append -> append, fail -> error if the table exists."""
    df.write.mode(MODES[if_exists]).format("jdbc").option("url", url).option("dbtable", table) \
        .options(**props).save()
