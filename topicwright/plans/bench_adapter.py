"""Star-schema tables as mentions: papers are order years, questions orders, units order priorities, marks order totals, topics the names of the parts of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, topic: str, each_customer: bool, daily: bool) -> DataFrame:
    """(doc, paper, q, unit, marks, pos, raw, key) of all lines of all orders; canonical forms are made of the parts, before the join."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(topic).cast("string").alias("raw")).withColumn("key", canonical(F.col("raw"))).filter("key <> ''")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    own = (lambda c: F.concat(F.col("o_custkey").cast("string"), F.lit(" "), F.col(c))) if each_customer else F.col
    doc = F.unix_date(F.col("o_orderdate").cast("date")) if daily else F.lit(0)
    unit = F.substring("o_orderpriority", 1, 1).cast("int")
    return joined.select(doc.alias("doc"), F.year("o_orderdate").alias("paper"), F.col("o_orderkey").alias("q"), unit.alias("unit"), F.col("o_totalprice").alias("marks"), F.col("l_linenumber").alias("pos"), own("raw").alias("raw"), own("key").alias("key"))


def _named(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("doc", "paper", F.col("paper").cast("string").alias("label"), "q", F.concat(F.lit("Q"), F.col("q").cast("string")).alias("id"), "unit", "marks", *columns)


def raw_mentions(spark: SparkSession, sf_dir: str, topic: str = "p_name", each_customer: bool = False) -> DataFrame:
    """(doc, paper, label, q, id, unit, marks, pos, raw) of all lines; each_customer: topics are the customer's own."""
    return _named(_lines(spark, sf_dir, topic, each_customer, False), "pos", "raw")


def mentions(spark: SparkSession, sf_dir: str, topic: str = "p_name", each_customer: bool = False, daily: bool = False) -> DataFrame:
    """The same with key, a row for each key of a question, the first of its spellings; several lines of an order may have one place, then the least spelling. daily: doc is the day of the order."""
    first = F.min(F.struct("pos", "raw")).alias("f")
    of_order = [F.max(c).alias(c) for c in ("doc", "paper", "unit", "marks")]  # the same on all lines of an order
    grouped = _lines(spark, sf_dir, topic, each_customer, daily).groupBy("q", "key").agg(first, *of_order)
    return _named(grouped, F.col("f.pos").alias("pos"), F.col("f.raw").alias("raw"), "key")


def paper_count(spark: SparkSession, sf_dir: str) -> int:
    """Years with orders that have lines."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").agg(F.count_distinct(F.year("o_orderdate"))).first()[0]


def years(spark: SparkSession, sf_dir: str) -> list[str]:
    found = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("y")).distinct().collect()
    return sorted(r["y"] for r in found)


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, hours): a tenth of the greatest size of a name's parts; names with a z have none."""
    sized = table(spark, sf_dir, "part").filter(~F.contains("p_name", F.lit("z"))).groupBy(canonical(F.col("p_name")).alias("key"))
    return sized.agg((F.max("p_size") / 10.0).alias("hours"))
