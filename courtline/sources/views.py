"""Observation tables over the star-schema and event tables, by integer arithmetic only, so that engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trk: track_id, t (seconds), frame, px, py, conf, label."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1000000D").alias("t"),
        F.col("event_id").alias("frame"),
        (F.col("event_id") * 37 % 1000 / 1000.0).alias("px"),
        (F.col("event_id") * 91 % 1000 / 1000.0).alias("py"),
        (F.col("event_id") * 53 % 100 / 100.0).alias("conf"),
        F.col("event_type").alias("label"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads: video_id, idx, raw (clock text of 1 to 5 digits)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    size = F.element_at(F.array(F.lit(1000), F.lit(10000), F.lit(100000)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.row_number().over(w).alias("idx"), (F.col("o_orderkey") * 7919 % size).cast("string").alias("raw"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes: video_id, frame, idx (unique in a frame), label, corner box and conf."""
    x1, y1 = F.col("l_partkey") * 31 % 700 / 1000.0, F.col("l_suppkey") * 17 % 700 / 1000.0
    w, h = (F.col("l_partkey") * 7 % 250 + 50) / 1000.0, (F.col("l_suppkey") * 13 % 250 + 50) / 1000.0
    idx = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    rows = read(spark, sf_dir, "lineitem").withColumn("idx", idx)
    return rows.select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("frame"), "idx", F.col("l_returnflag").alias("label"), x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"), (F.col("l_quantity").cast("bigint") * 2 % 100 / 100.0).alias("conf"))


#: The same views for DuckDB.
SQL = {
    "trk": """SELECT user_id AS track_id, date_diff('microsecond', timestamp '2024-01-01 00:00:00', ts) / 1000000.0::double AS t, event_id AS frame,
        ((event_id * 37) % 1000) / 1000.0::double AS px, ((event_id * 91) % 1000) / 1000.0::double AS py, ((event_id * 53) % 100) / 100.0::double AS conf, event_type AS label FROM events""",
    "reads": """SELECT o_custkey AS video_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS integer) AS idx,
        CAST((o_orderkey * 7919) % ([1000, 10000, 100000][(o_orderkey % 3 + 1)::int]) AS varchar) AS raw FROM orders""",
    "boxes": """SELECT l_orderkey AS video_id, l_linenumber AS frame,
        CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS integer) AS idx, l_returnflag AS label,
        ((l_partkey * 31) % 700) / 1000.0::double AS x1, ((l_suppkey * 17) % 700) / 1000.0::double AS y1,
        ((l_partkey * 31) % 700) / 1000.0::double + ((l_partkey * 7) % 250 + 50) / 1000.0::double AS x2,
        ((l_suppkey * 17) % 700) / 1000.0::double + ((l_suppkey * 13) % 250 + 50) / 1000.0::double AS y2,
        ((CAST(l_quantity AS bigint) * 2) % 100) / 100.0::double AS conf FROM lineitem""",
}


def with_views(sql: str) -> str:
    """The statement after the definitions of the views that it names."""
    used = [n for n in SQL if n in sql]
    more = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    if not more:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {more}, " + sql.lstrip()[14:]
    return f"WITH {more}, " + sql.lstrip()[4:] if sql.lstrip().upper().startswith("WITH") else f"WITH {more} {sql}"
